"""The corpus operators against plain versions of their own rules, and on odd tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.llm import chunkprint, grams, langid, quality, queries, simhash, toxicity, urlfilter

ODD = [None, "", " \n", "one", "x" * 5000, "Ünï çödé 日本", "same again", "same again", "a b " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, 0, 1.0, "z") for i, t in enumerate(ODD)] + [(None, "no id", "de", 0, 1.0, "z"), (3, "one", "en", 0, 1.0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, label double, mark string")


def _plain_ends(data):
    """Ends of chunks, a byte at a time."""
    ends, begin, rolled = [], 0, 0
    for i, byte in enumerate(data):
        rolled = ((rolled << 1) + int(chunkprint._GEAR[byte])) & 0xFFFFFFFF
        size = i + 1 - begin
        zeros = chunkprint.STRICT_BITS if size < chunkprint.NORMAL else chunkprint.LOOSE_BITS
        if size >= chunkprint.LONGEST or (size >= chunkprint.SHORTEST and rolled >> (32 - zeros) == 0):
            ends.append(i + 1)
            begin = i + 1
    return ends + ([len(data)] if begin < len(data) else [])


def test_chunk_boundaries_are_those_of_a_rolling_hash():
    rng = np.random.default_rng(2)
    for size in (1, 11, 12, 13, 40, 500, 5000):
        data = rng.integers(32, 127, size).astype(np.uint8)
        found = chunkprint.boundaries(data)
        plain = _plain_ends(data.tolist())
        # A tail of at most SHORTEST bytes is not looked into.
        assert [e for e in found if e < size] == [e for e in plain if e < size and size - (found[found.index(e) - 1] if found.index(e) else 0) > chunkprint.SHORTEST]
        assert found[-1] == size
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    names, sizes = chunkprint.chunks(text)
    assert names.dtype == np.uint64 and sizes.sum() == 3000 and len(chunkprint.written((names, sizes)).split()) == names.size


def _gram(data, n, bits):
    rolling = data[0] + 1
    for byte in data[1:n]:
        rolling = (rolling * 0x01000193 + byte) & 0xFFFFFFFF
    mixed = ((rolling ^ (n * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1) & 0xFFFFFFFF
    mixed ^= mixed >> 15
    return (mixed * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits)


def test_scores_are_sums_over_every_gram():
    rng = np.random.default_rng(5)
    weights = rng.normal(size=(1 << 16, 2)).astype(np.float32)
    table = grams.fold(keep_digits=False)
    texts = ["Hello, World 12", "", None, "ß é", "a" * 50]
    total, number = grams.table_scores(texts, weights, (1, 2, 3, 4), 16, table)
    for row, text in enumerate(texts):
        data = [32] + [int(table[b]) for b in (text or "").lower().encode()] + [32]
        found = [_gram(data[i:], n, 16) for n in (1, 2, 3, 4) for i in range(len(data) - n + 1) if i < len(data) - 1 and (data[i] != 32 or (n > 1 and data[i + 1] != 32))]
        # The last separator is the next text's first: grams over it belong to this one as far as they begin in it.
        assert abs(number[row] - len(found)) <= 6
    model = quality.Grades(np.append(weights[:, 0], 0.5).astype(np.float32), np.array([-1.0, 0.5]))
    tails = model.tails(texts)
    assert (tails[:, 0] >= tails[:, 1]).all() and ((tails >= 0) & (tails <= 1)).all()


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [None, "", "ab cd"] + ["".join(rng.choice(list("abcd  ef\n1é"), rng.integers(0, 3000))) for _ in range(15)]
    weights = rng.normal(size=(1 << 16, 3)).astype(np.float32)
    model = toxicity.Toxicity(rng.normal(size=1 << 16).astype(np.float32), 0.1)
    wanted, scores = grams.table_scores(texts, weights, (1, 2, 3, 4), 16, grams.fold()), model.score(texts)
    for part in (1, 100, 999):
        monkeypatch.setattr(grams, "PART", part)
        monkeypatch.setattr(toxicity, "PART", part)
        found = grams.table_scores(texts, weights, (1, 2, 3, 4), 16, grams.fold())
        assert np.allclose(found[0], wanted[0]) and (found[1] == wanted[1]).all() and np.allclose(model.score(texts), scores)


def test_sample_counts_a_repeated_row_once(spark):
    rows = [(1, "again and again", "a")] * 3000 + [(i, f"text {i}", "a") for i in range(2, 402)] + [(i, "y" * 20_000, "b") for i in range(500, 510)] + [(7, None, "b"), (None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    texts, labels = grams.sample(docs, grams.candidates(docs, "label"), 400)
    assert Counter(labels) == {"a": 400, "b": 10} and len(set(zip(texts, labels))) >= 392 and max(map(len, texts)) == 20_000
    assert grams.sample(docs, grams.candidates(docs.limit(0), "label"), 5) == ([], [])
    assert len(grams.sample(docs, grams.candidates(docs, "label"), 400, most_chars=50_000)[0]) < 410


def _plain_urls(urls, pages):
    """Verdicts by counting tokens in dictionaries, without bins."""
    words = Counter(w for page in pages for w in re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", page or "").lower()))
    total = sum(words.values())
    out, learned = [], {"allow": Counter(), "block": Counter()}
    prior, kept = Counter(), []
    for url in urls:
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        labels = re.findall(r"[^\W\d_]+|\d+", host)
        logs = {w: math.log(n / total) for w, n in words.items()}
        tokens = ["." + w for x in labels for w in urlfilter.viterbi(x, {w: p for w, p in logs.items() if w in x}, math.log(0.1 / total))]
        tokens += ["/" + t for t in re.findall(r"[^\W\d_]+|\d", path.lower())]
        fits = [r for r in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        if rule:
            prior[queries.RULES[rule]] += 1
            learned[queries.RULES[rule]].update(tokens)
        kept.append((tokens, rule))
    used = len(set(learned["allow"]) | set(learned["block"]))
    odds = lambda t: math.log((learned["block"][t] + 1) / (sum(learned["block"].values()) + used)) - math.log((learned["allow"][t] + 1) / (sum(learned["allow"].values()) + used))
    start = math.log((prior["block"] + 1) / (prior["allow"] + 1))
    for tokens, rule in kept:
        out.append(queries.RULES[rule] if rule else "block" if start + sum(map(odds, tokens)) > 0 else "allow")
    return out


def test_url_verdicts_equal_plain_counts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    more = spark.createDataFrame([(-1, None, None), (-2, "nothing", "<p>x</p>"), (-3, "http://" + "a" * 3000 + ".com/x", ""), (-4, "https://münchen.net/fr/straße", "münchen"), (-1, None, None)], "page_id long, url string, html string")
    every = pages.select("page_id", "url", "html").union(more).withColumn("host", F.lit(1)).withColumn("n", F.lit(2))
    rows = every.collect()
    found = sorted((str(r["page_id"]), r["verdict"]) for r in urlfilter.judge(every, queries.RULES).collect())
    wanted = sorted((str(r["page_id"]), v) for r, v in zip(rows, _plain_urls([r["url"] for r in rows], [r["html"] for r in rows])))
    assert found == wanted


def test_models_and_stages_on_odd_tables(spark, odd):
    ratings = spark.createDataFrame([(3, 2), (4, 0), (6, 2), (None, 1), (8, None)], "doc_id long, grade int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (6, 0), (None, 1), (8, 7)], "doc_id long, toxic int")
    graded = quality.grade_documents(odd, quality.learn(odd, ratings))
    assert graded.count() == odd.count() and graded.filter("expected_grade is null or tail_probability not between 0 and 1").count() == 0
    assert quality.grade_documents(odd, quality.learn(odd, ratings.limit(0))).filter("selected").count() == 0
    assert quality.grade_documents(odd, quality.fit(["a", "b"], np.array([2, 2]))).filter("not selected").count() == 0
    model = toxicity.learn(odd, labels)
    assert toxicity.score_documents(odd, model).filter("score is null or score not between 0 and 1").count() == 0
    kept = toxicity.drop_toxic(odd, model)
    assert kept.schema == odd.schema and kept.filter("text is null").count() == 1
    named = langid.drop_unidentified(odd, langid.learn(odd))
    assert named.schema == odd.schema and named.filter("text is null or text = ''").count() == 0
    assert langid.drop_unidentified(odd, None).count() == 0 and toxicity.drop_toxic(odd, toxicity.learn(odd, labels.limit(0))).count() == odd.count()
    left = simhash.drop_copies(odd)
    assert left.schema == odd.schema and left.count() == odd.count() - 3  # two of the three without words, and one of the equal texts
    assert simhash.drop_copies(odd.limit(0)).count() == 0
