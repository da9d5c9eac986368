"""The corpus operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from netspark.llm import byte_bpe, chunkprint, impactsearch, langid, packing, queries, sharding, simhash, toxicity, urlfilter
from netspark.llm.pretoken import safe_cuts
from tests.oracle import differs, duck

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, rank int, key long"
ODD = [None, "", "  \n\t ", "one", "It's WE'RE they'll 's 'sun ''s", "x " * 3000, "a" * 3000, "日本語 テキスト ½   x", "same text here again", "same text here again", "\U0001f600 " * 50]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 1, "f", 1, 2) for i, t in enumerate(ODD)] + [(None, "no id at all", None, None, None, None, None, None), (3, "one", "en", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_bpe_equals_tiktoken(spark, odd, real):
    ranks = byte_bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd, real):
        texts = {(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()}
        found = byte_bpe.encode_digests(docs, RANKS).collect()
        wanted = {(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts for ids in [own.encode_ordinary(t)]}
        assert {tuple(r) for r in found} == wanted and len(found) == docs.count()


def test_bpe_fuzz():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab's  \n\t1é日'tredlv!?."), rng.integers(0, 40))) for _ in range(3000)]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    ids, at = byte_bpe.encoder(RANKS).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.encode_ordinary(t) for t in texts]
    assert "".join(safe_cuts("ab cd  ef gh" * 50, 20)) == "ab cd  ef gh" * 50


def test_packing(spark, odd, real):
    coder = Tokenizer.from_file(JSON)
    for docs in (odd, real):
        pieces = packing.pack(docs, JSON).toPandas()
        sums = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert (sums["length"].cumsum() - pieces["length"] == pieces["offset"]).all()
        assert sums["length"].sum().max() <= packing.WINDOW
    unique = real.dropDuplicates(["doc_id"])
    whole = {r["doc_id"]: [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in unique.collect()}
    for p in packing.pack(unique, JSON).collect():
        ids = np.array(whole[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert ids.size == p["length"] and zlib.crc32(ids.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(whole[p["doc_id"]])


def test_packing_plan_is_whole():
    rng = np.random.default_rng(2)
    for counts in ({5: 100_000}, {2048: 3, 1: 7, 2047: 2}, {int(k): int(v) for k, v in zip(rng.integers(1, 2049, 300), rng.integers(1, 5000, 300))}, {}):
        plan = packing.plan_windows(counts)
        taken = {}
        for length, first, past, _, _ in plan.rows:
            assert taken.get(length, 0) == first
            taken[length] = past
        assert taken == counts and len(plan.rows) <= packing.most_plan_rows(2048)
    assert packing.nnls(np.array([[1.0, 0], [0, 1]]), np.array([2.0, -1])).tolist() == pytest.approx([2, 0])


def _brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, odd, real):
    for docs in (odd, real):
        rows = [(r["doc_id"], _brute_print(r["text"])) for r in docs.collect()]
        group = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 4 and group[i] != group[j]:
                    group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
        least = {}
        for g, (i, _) in zip(group, rows):
            least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
        wanted = sorted(map(repr, ((i, f"{f:016x}", least[g]) for g, (i, f) in zip(group, rows))))
        assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == wanted


def test_anchors_meet_every_pair_two_bits_apart():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 32))
        b = a
        for bit in rng.choice(32, rng.integers(0, 3), replace=False).tolist():
            b ^= 1 << bit
        first, second = (set(simhash.anchors(np.array([x], np.uint32))[1].tolist()) for x in (a, b))
        assert first & second and len(first) <= 17


def test_copies_are_the_groups_of_similar_shingle_sets(spark, odd):
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(5000)]
    texts = []
    for size in (30, 120, 700):
        for _ in range(6):
            base = rng.choice(vocabulary, size).tolist()
            texts.append(" ".join(base))
            for edits in (1, max(1, size // 100), max(2, size // 45), size // 20, size // 8):
                other = list(base)
                for place in rng.choice(size, edits, replace=False).tolist():
                    other[place] = "changed"
                texts.append(" ".join(other))
    rows = [(i * 7 % 997, t, "en", "s", 1, "f", 1, 2) for i, t in enumerate(texts + texts[:9])]
    docs = spark.createDataFrame(rows, SCHEMA).union(odd.filter("doc_id is not null").withColumn("doc_id", odd["doc_id"] + 5000))
    held = [(r["doc_id"], set(simhash.shingle_hashes(r["text"], 5).tolist())) for r in docs.collect()]
    group = list(range(len(held)))
    for i in range(len(held)):
        for j in range(i):
            a, b = held[i][1], held[j][1]
            if (a == b or len(a & b) >= 0.8 * len(a | b)) and group[i] != group[j]:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    least = {g: min(i for h, (i, _) in zip(group, held) if h == g) for g in set(group)}
    wanted = sorted((i, least[g]) for g, (i, _) in zip(group, held))
    assert _kept(simhash.copies_of(docs)) == wanted


def _copies_by_brute_force(docs):
    held = [(i, set(simhash.shingle_hashes(t, 5).tolist())) for i, t in docs]
    group = list(range(len(held)))
    for i in range(len(held)):
        for j in range(i):
            a, b = held[i][1], held[j][1]
            if group[i] != group[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    least = {g: min(i for h, (i, _) in zip(group, held) if h == g) for g in set(group)}
    return sorted((i, least[g]) for g, (i, _) in zip(group, held))


def _kept(found):
    return sorted((r["doc_id"], r["kept_id"]) for r in found.collect())


def test_cut_and_extended_copies_are_found(spark):
    rng = np.random.default_rng(4)
    rows = []
    for size in (60, 200, 900):
        for _ in range(8):
            words, other = (rng.choice(8000, size).astype(str).tolist() for _ in range(2))
            rows.append(words)
            # Alone each in its pair: a cut tail, a cut head, another text behind or inside, at 0.82 to 0.9.
            for part in (0.83, 0.9):
                for kind in range(4):
                    words = rng.choice(8000, size).astype(str).tolist()
                    cut, half = int(size * part) + 1, size // 2
                    more = other[: int(size * (1 / part - 1)) - 4]
                    rows += [words, (words[:cut], words[-cut:], words + more, words[:half] + more + words[half:])[kind]]
    docs = [(i, " ".join(words)) for i, words in enumerate(rows)]
    wanted = _copies_by_brute_force(docs)
    assert sum(i != kept for i, kept in wanted) > 150
    assert _kept(simhash.copies_of(spark.createDataFrame(docs, "doc_id long, text string"))) == wanted


def test_families_around_the_threshold(spark):
    docs = []
    for seed in (247, 284, 504):  # families in which many pairs fall just short
        rng = np.random.default_rng(seed)
        base = rng.choice(8000, 30).astype(str).tolist()
        docs.append((len(docs), " ".join(base)))
        for _ in range(7):
            words, cut, head = list(base), int(rng.integers(0, 6)), rng.integers(0, 2)
            if cut:
                words = words[cut:] if head else words[:-cut]
            more = [f"e{rng.integers(1e6)}" for _ in range(int(rng.integers(0, 4)))]
            docs.append((len(docs), " ".join(words + more)))
    assert _kept(simhash.copies_of(spark.createDataFrame(docs, "doc_id long, text string"))) == _copies_by_brute_force(docs)


@pytest.mark.parametrize("block", [4, 1024])
def test_large_family_is_dealt_into_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "CROWD", 64)
    rng = np.random.default_rng(8)
    base = rng.choice(8000, 80).astype(str).tolist()
    docs = []
    for i in range(150):
        words = list(base[: int(rng.integers(50, 80))])
        for place in rng.choice(len(words), int(rng.integers(0, 5)), replace=False).tolist():
            words[place] = f"e{rng.integers(1e6)}"
        docs.append((i, " ".join(words)))
    wanted = _copies_by_brute_force(docs)
    assert 2 < len({least for _, least in wanted}) < 150
    assert _kept(simhash.copies_of(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))) == wanted


def test_similar_links_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = rng.integers(0, 1 << 62, 30)
        sets = [np.unique(np.concatenate((rng.choice(base, int(rng.integers(0, 30)), replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 4)))))).astype("<u8") for _ in range(int(rng.integers(0, 25)))]
        group = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
        own = list(range(len(sets)))
        for u, v in simhash.similar_links(sets):
            own = [min(own[u], own[v]) if g in (own[u], own[v]) else g for g in own]
        assert own == group


def test_ids_with_two_texts_and_no_id(spark):
    words = np.random.default_rng(18409).choice(8000, 46).astype(str).tolist()
    docs = [(0, " ".join(words)), (0, " ".join(words[:40] + ["other"])), (0, " ".join(words[:20] * 3)), (90, " ".join(words[:40] + ["more"])), (None, " ".join(words)), (None, "alone without an id"), (None, "alone without an id")]
    held = spark.createDataFrame([(*row, 1) for row in docs], "doc_id long, text string, gone int")
    left = simhash.drop_copies(held)
    assert left.columns == held.columns
    # The first two and the fourth are one group, and so is the copy without an id; rows that repeat id and text stay together.
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in left.collect())
    assert [(none, i) for none, i, _ in kept] == [(False, 0), (False, 0), (True, 0), (True, 0)] and kept[-1][2] == kept[-2][2] == docs[-1][1]


def test_crowded_anchor_is_dealt_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)
    rows = [(0, 1 << i, 1 << i) for i in range(40)]
    found = simhash.links(spark.createDataFrame(rows, "table int, fp long, node long"), 4).collect()
    group = {r[1]: r[1] for r in rows}
    for u, v in found:
        old, new = group[u], group[v]
        group = {k: new if g == old else g for k, g in group.items()}
    assert len(set(group.values())) == 1


def test_fingerprints(spark, odd, real):
    for docs in (odd.dropDuplicates(["doc_id"]), real):
        rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in docs.collect()), reverse=True)
        found = {r["doc_id"] if r["doc_id"] is not None else -(1 << 63): r for r in chunkprint.print_edits(docs).collect()}
        assert len(found) == len(rows)
        for k, (name, text) in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            r = found[name]
            assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert r["fingerprint"] == chunkprint.written(chunkprint.chunks(text)) and r["edited_fingerprint"] == chunkprint.written(chunkprint.chunks(edited))
            assert r["near_next"] == chunkprint.likeness(chunkprint.chunks(text), chunkprint.chunks(after)) and 0 <= r["near_edited"] <= 1
    moved = chunkprint.likeness(chunkprint.chunks("word " * 3 + rows[0][1]), chunkprint.chunks(rows[0][1]))
    assert moved > 0.7


def test_sharding(spark, odd, real):
    for docs in (odd, real):
        found = sharding.shard_by_size(docs).toPandas()
        assert len(found) == docs.count() and found["shard"].between(0, 15).all()
        assert found.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s)))).all()
    sizes = found.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= found["size"].max()
    for name in ("id", "cast(null as long)", "7"):
        hot = spark.range(6000).selectExpr(f"case when id % 3 = 0 then {name} else id end as doc_id", "case when id % 3 = 0 then 'the same text' else concat('text ', id) end as text", "1 as number", "'x' as shard")
        sizes = sharding.shard_by_size(hot).groupBy("shard").sum("size").toPandas()["sum(size)"]
        assert len(sizes) == 16 and sizes.max() <= 1.02 * sizes.mean()
    hot = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the same text' else concat('text ', id) end as text")
    sizes = sharding.shard_by_size(hot).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sizes) == 16 and sizes.max() <= 1.02 * sizes.mean()


def test_topk_matches_sql_and_brute_force(spark):
    assert differs(spark, duck(SF), "op8_topk", queries.QUERIES["op8_topk"], queries.ORACLE_SQL["op8_topk"], SF) is None
    rng = np.random.default_rng(1)
    for _ in range(100):
        rows, width = int(rng.integers(1, 40)), int(rng.integers(1, 6))
        values, query = rng.integers(-4, 5, (rows, width)).astype(np.int32), rng.integers(-3, 4, width)
        ids, scores = impactsearch.ImpactIndex(np.arange(rows), np.arange(rows), values).top(0, query, 5)
        every = sorted(((-int(values[i] @ query), i) for i in range(1, rows)))[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == every
    odd = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (50, [2.0, 1.0]), (51, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in impactsearch.top_k(odd).collect()) == [(0, 1, 50, 4 * 256 * 256), (50, 1, 0, 4 * 256 * 256)]


def test_topk_of_repeated_ids_empty_vectors_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(impactsearch, "ROWS", 7)
    monkeypatch.setattr(impactsearch, "QUERIES", 3)
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.integers(-3, 4, 2).astype(float).tolist()) for i in rng.choice([0, 1, 2, 50, 51, 100], 40)]
    rows += [(50, []), (7, []), (8, []), (50, [70000.0, 1.0]), (50, [70000.0, 1.0])]
    wanted = []
    for n, (q, x) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-sum(int(a * 256) * int(b * 256) for a, b in zip(x, y)), i) for m, (i, y) in enumerate(rows) if m != n and len(x) == len(y))[:5]
            wanted += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    table = spark.createDataFrame([(*row, "x", 1) for row in rows], "vec_id long, embedding array<double>, own string, block int").repartition(3)
    found = impactsearch.top_k(table)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    con = duck(SF)
    con.register("found", table.select("vec_id", "embedding").toPandas())
    con.execute("CREATE OR REPLACE VIEW embeddings AS SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM found")
    assert sorted(con.execute(queries.ORACLE_SQL["op8_topk"]).fetchall()) == sorted(wanted)
    assert impactsearch.top_k(table.limit(0)).count() == 0


def test_topk_keeps_large_components(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 1, (60, 3))
    vectors[::7] *= 1e6
    vectors[10] = (1e7, 1e-3, -2e4)  # products beyond 2 ** 53
    rows = [(i * 5, x) for i, x in enumerate(vectors.tolist())] + [(1000, [float("inf"), 1.0, 1.0])]
    wanted = []
    whole = {i: [int(np.floor(c * 256)) for c in x] for i, x in rows[:-1]}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5]
        wanted += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    found = impactsearch.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_urls(spark):
    urls = [None, "", "nothing", "http://A.Example.com/en/1", "http://www.example.com/en/1?x", "https://x.net/es/", "https://net/es/2#a", "https://example.com", "https://cheappills.org/en/?q", "https://a.org/x", "https://badexample.com/en/"]
    pages = spark.createDataFrame([(i, u, "<p>cheap pills example</p>") for i, u in enumerate(urls)] + [(None, "http://q.com/", None)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in urlfilter.judge(pages, queries.RULES).collect()}
    assert [found[i]["host"] for i in (0, 2, 3, 7)] == ["", "", "a.example.com", "example.com"]
    assert [found[i]["path"] for i in (3, 4, 7, 8)] == ["/en/1", "/en/1", "", "/en/"]
    assert [found[i]["rule"] for i in (3, 4, 5, 6, 7, 8, 10, None)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/es/", None, None, "com/", "com/"]
    assert {r["verdict"] for r in found.values()} <= {"allow", "block"} and len(found) == len(urls) + 1
    logs = {"cheap": -3.0, "pills": -3.0, "cheapp": -9.0}
    assert urlfilter.viterbi("cheappills", logs, -5.0) == ["cheap", "pills"]
    assert urlfilter.judge(pages.limit(0), queries.RULES).count() == 0


def test_toxicity_and_language_on_held_out_folds(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op6_toxicity(spark, SF).filter("held_out").join(labels, "doc_id").toPandas()
    assert ((found["score"] >= 0.5) == (found["toxic"] == 1)).mean() > 0.9
    found = queries.op9_language(spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.95
    found = queries.op3_quality(spark, SF).filter("held_out").join(labels, "doc_id").toPandas()
    assert (found["selected"] == (found["quality"] == 1)).mean() > 0.9


def test_pipeline_stages_keep_what_brute_force_keeps(spark, monkeypatch):
    folder, kept = "/root/testdata/sf0.001", []
    write = corpus_pipeline.materialise
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df, name: kept.append(write(df, name)) or kept[-1])
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    clean, named, single = ({r["doc_id"]: r["text"] for r in x.collect()} for x in kept)
    scored = toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect()
    assert set(clean) == {r["doc_id"] for r in scored if not r["predicted"]}
    found = langid.identify(kept[0], langid.learn(kept[0])).collect()
    assert set(named) == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert set(single) == {i for i, least in _copies_by_brute_force(sorted(named.items())) if i == least}
    assert packed == set(single)


def test_language_document_frequencies_are_of_all_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in docs.collect() if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    wanted = np.zeros(1 << langid.BITS)
    for ids, _, _ in langid.bags([r["text"] for r in rows], langid.SIZES, langid.BITS, langid._FOLD):
        wanted[ids] += 1
    held = {}
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    monkeypatch.setattr(langid, "fit", lambda texts, langs, **more: held.update(more))
    langid.learn(docs)
    assert (held["frequencies"][0] == wanted).all() and held["frequencies"][1] == len(rows)


def test_models_on_odd_and_empty_tables(spark, odd, empty):
    model = toxicity.fit(["you idiot", "a fine day"] * 20, np.array([1, 0] * 20))
    assert toxicity.score_documents(odd, model).count() == odd.count() and toxicity.score_documents(empty, model).count() == 0
    names = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, langid.fit(["hello there", "guten tag"] * 10, ["en", "de"] * 10)).collect()}
    assert names[0] == names[1] == names[2] == "und" and names[3] in ("en", "de")
    assert langid.identify(odd, langid.fit([], [])).select("lang_pred").distinct().collect() == [("und",)]
    assert simhash.drop_copies(odd).count() == odd.count() - 3  # the two of white space or nothing, and one copy
    for operator in (simhash.near_duplicates, sharding.shard_by_size, chunkprint.print_edits, lambda d: packing.pack(d, JSON), lambda d: byte_bpe.encode_digests(d, RANKS)):
        assert operator(empty).count() == 0
