"""SimHash near-duplicates found with covering-code anchors.

Fingerprints are 64-bit majority votes over XXH64 of word shingles.  Two
fingerprints at most ``bits`` (up to 5) apart differ in at most two bits of one
32-bit half.  The anchors of a half are the words of a perfect Hamming [31, 26]
code with the 32nd bit free: covering radius 1.  If two halves differ in two bits,
a word half way lies one bit from both, and its anchor at most one bit further;
so a fingerprint is replicated to the anchors within the covering radius plus the
threshold's half (2 bits: at most 17 anchors a half), and every linked pair meets
at an anchor.  There the whole fingerprints are compared.

Only distinct fingerprints are replicated.  At an anchor a spanning forest
of the links is emitted, never all pairs.  An anchor with more than
``CROWD`` fingerprints (estimated on a sample of nodes) is dealt into cells, one
for each pair of chunks, so no task compares many more than ``CROWD`` rows with
each other and still every pair of the anchor meets.  Components of the links are found by star contraction.

Defined results: a null or empty text, or one of white space, has fingerprint
zero and is linked like any other; a text of fewer words than a shingle is one
shingle; a null ``doc_id`` keeps its row and never names a component unless all
are null; repeated rows give repeated rows; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from netspark.llm.arrow_text import hand_back, slices
from netspark.operators.components import connected_components
from netspark.plans.skew import checked, join_counted
from netspark.plans.workspace import materialise

SEED = 42
CROWD = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(sizes) - 1
    begins = (stops - sizes + 1)[: len(words) - shingle_words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, stops[shingle_words - 1 :].tolist(), strict=True)], "<u8")


def _majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of hashes."""
    if not hashes.size:
        return 0
    votes = np.zeros(64, np.int64)
    for a in range(0, hashes.size, 1 << 16):
        votes += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > hashes.size, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """The 64-bit fingerprint of one text."""
    return _majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            found = np.array([fingerprint(text, shingle_words) for text in texts], np.uint64).view(np.int64)
            yield pa.record_batch([rows.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _partners() -> np.ndarray:
    """For each syndrome 1..31 the fifteen pairs of places whose numbers XOR to it, as bit masks."""
    out = np.zeros((32, 15), np.uint32)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s and i != s]
        out[s] = [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    return out


_PARTNERS = _partners()
_PLACES = np.arange(1, 32, dtype=np.uint32)


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within two bits of each 32-bit word: indexes into ``halves``, and the anchors."""
    word = halves & np.uint32(0x7FFFFFFF)
    syndrome = np.zeros(word.size, np.uint32)
    for place in _PLACES.tolist():
        syndrome ^= np.where((word >> np.uint32(place - 1)) & np.uint32(1), np.uint32(place), np.uint32(0))
    rows = np.arange(word.size)
    off = np.flatnonzero(syndrome)
    mend = np.zeros(word.size, np.uint32)
    mend[off] = np.uint32(1) << (syndrome[off] - np.uint32(1))
    near = halves ^ mend  # the code word at most one bit away
    other = near ^ np.uint32(0x80000000)  # the same with the free bit turned
    two = halves[off][:, None] ^ _PARTNERS[syndrome[off]]
    return np.concatenate((rows, rows, np.repeat(off, 15))), np.concatenate((near, other, two.ravel()))


def replicas(prints: DataFrame, payload: tuple[str, ...]) -> DataFrame:
    """``anchor, fp`` and the payload for both halves of every fingerprint; each table has its own anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, fps, *rest = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "fp", *payload))
            for half in (0, 1):
                row, anchor = anchors((fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32))
                places = anchor.astype(np.int64) | (half << 32) | (table[row] << 33)
                yield pa.record_batch([pa.array(x) for x in (places, fps[row], *(x[row] for x in rest))], names=["anchor", "fp", *payload])

    return prints.select("table", "fp", *payload).mapInArrow(run, ", ".join(f"{c} long" for c in ("anchor", "fp", *payload)))


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one anchor's fingerprints: places of both ends."""
    edges: list[tuple[int, int]] = []
    left = np.arange(fps.size)
    while left.size:
        frontier, left = [int(left[0])], left[1:]
        while frontier and left.size:
            at = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= bits
            taken = left[near].tolist()
            left = left[~near]
            edges += [(at, x) for x in taken]
            frontier += taken
    return edges


def _links(anchor: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Links of whole runs of equal anchors: places of both ends."""
    edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1], [True])))
    sizes = np.diff(edge)
    begin = edge[:-1]
    hit = sizes > 32
    some = np.flatnonzero((sizes > 1) & ~hit)
    if some.size:
        # Compare rows one, two, ... places apart within their run, for all short runs at once.
        left = np.repeat(np.where(hit, 0, sizes), sizes) - (np.arange(anchor.size) - np.repeat(begin, sizes))
        owner = np.repeat(np.arange(sizes.size), sizes)
        at = np.flatnonzero(left > 1)
        lag = 1
        while at.size:
            linked = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= bits]
            hit[owner[linked]] = True
            lag += 1
            at = at[left[at] > lag]
    out = []
    for run in np.flatnonzero(hit).tolist():
        here = slice(begin[run], begin[run] + sizes[run])
        out += [(begin[run] + u, begin[run] + v) for u, v in _forest(fps[here], bits)]
    return np.array(out, np.int64).reshape(-1, 2)


def _deal(copies: DataFrame, some: DataFrame, rate: int) -> DataFrame:
    """``copies(anchor, node, ...)`` with every anchor of over ``CROWD`` rows dealt into cells where each of its pairs meets.

    Sizes are estimated on ``some``, the rows of one node in ``rate``, so that counting does not
    shuffle every replica.  They only decide how an anchor is dealt out, never which pairs meet.
    """
    crowded = some.groupBy("anchor").agg((F.count("*") * rate).alias("n")).filter(F.col("n") > CROWD)
    crowded = materialise(crowded.select("anchor", F.ceil(F.col("n") * 2 / CROWD).cast("int").alias("chunks")), "crowded")
    if crowded.isEmpty():
        return copies
    held = copies.join(crowded, "anchor", "left")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda x: F.least(own, x) * F.col("chunks") + F.greatest(own, x))
    dealt = held.withColumn("cell", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(cells)))
    return dealt.select(F.xxhash64("anchor", "cell").alias("anchor"), *(c for c in copies.columns if c != "anchor"))


def _one_in(prints: DataFrame, rate: int) -> DataFrame:
    """The rows of one node in ``rate``."""
    return prints.filter(F.pmod(F.xxhash64(F.lit("crowd"), "node"), F.lit(rate)) == 0)


def _by_anchor(copies: DataFrame, found: Callable[[list[np.ndarray]], Iterable[pa.RecordBatch]]) -> DataFrame:
    """``u, v`` that ``found`` makes of the columns of whole runs of equal anchors."""
    names = copies.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            kept = [np.concatenate((old, batch.column(c).to_numpy(zero_copy_only=False))) for old, c in zip(kept, names, strict=True)]
            cut = int(np.searchsorted(kept[0], kept[0][-1])) if kept[0].size else 0  # the last run may go on
            if cut:
                yield from found([x[:cut] for x in kept])
                kept = [x[cut:] for x in kept]
        if kept[0].size:
            yield from found(kept)
        hand_back()

    return copies.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "u long, v long")


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def links(prints: DataFrame, bits: int = 4) -> DataFrame:
    """``u, v``: enough of the linked pairs of ``prints(table, fp, node)`` to connect all of them.

    Two nodes are linked if their fingerprints in some table are at most ``bits`` apart.
    """
    if not 0 <= bits <= 5:
        raise ValueError("the anchors cover at most 5 differing bits")
    rate = max(1, CROWD // 64)
    copies = _deal(replicas(prints, ("node",)), replicas(_one_in(prints, rate), ("node",)), rate)

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, fps, nodes = rows
        pairs = _links(anchor, fps.view(np.uint64), bits)
        yield _edges(nodes[pairs[:, 0]], nodes[pairs[:, 1]])

    return _by_anchor(copies, found)


def near_duplicates(docs: DataFrame, shingle_words: int = 4, bits: int = 4) -> DataFrame:
    """One row a document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    prints = materialise(fingerprints(docs, shingle_words), "prints")
    rows = prints.count()
    # One row a fingerprint: its least document.  Partial minima keep a fingerprint of many copies from meeting in one task.
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    parts = materialise(connected_components(links(distinct.select(F.lit(0).alias("table"), "fp", F.col("fp").alias("node")), bits)).withColumnRenamed("node", "fp"), "parts")
    # Most fingerprints are linked to no other; the rest are named by the least document of their component.
    linked = distinct.join(parts, "fp")
    named = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    names = join_counted(linked.select("fp", "component"), named, "component", "members", rows).select("fp", "component_id")
    by_print = materialise(distinct.join(names, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "copies"), "names")
    return join_counted(prints, by_print, "fp", "copies", rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- copies at a shingle similarity -------------------------------------------

SIMILAR = 0.8
#: A candidate shares all BAND least hashes of one of BANDS bands, which texts of similarity j do
#: with a chance of 1 - (1 - j ** BAND) ** BANDS, wherever they differ: at 0.8 all but 6 in 10 ** 5, at 0.85 all but 3 in 10 ** 7.
BANDS, BAND = 32, 6
#: Texts that a task compares with each other, and the bytes of their sets, about.
BLOCK = 1024
BLOCK_BYTES = 1 << 27


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_FACTORS = (_mix(np.arange(1, BANDS * BAND + 1, dtype=np.uint64) * np.uint64(_STEP)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of hashes under each permutation, of their upper 32 bits."""
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(_FACTORS.size, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, upper.size, 1024):
        np.minimum(least, (_FACTORS[:, None] * upper[None, a : a + 1024]).min(axis=1), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """One long a band of the least hashes; each band has its own."""
    x = np.arange(BANDS, dtype=np.uint64)
    for part in least.astype(np.uint64).reshape(BANDS, BAND).T:
        x = _mix((x ^ part) + np.uint64(_STEP))
    return x.view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    """One long for a set of hashes in ascending order: texts of one set are one node."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED) - (1 << 63)


def band_stars(nodes: DataFrame) -> DataFrame:
    """``u, v``: the nodes of each band of ``nodes(node, bands)`` joined to one of them.

    A band's nodes need not meet: those of a crowded band (estimated on one node in
    ``CROWD / 64``) are joined to a node known beforehand, where they stand.
    """
    spread = nodes.select(F.explode("bands").alias("anchor"), "node")
    rate = max(1, CROWD // 64)
    crowded = _one_in(nodes, rate).select(F.explode("bands").alias("anchor"), "node").groupBy("anchor").agg((F.count("*") * rate).alias("n"), F.min("node").alias("centre"))
    crowded = materialise(crowded.filter(F.col("n") > CROWD).select("anchor", "centre"), "crowded")
    stars = None
    if not crowded.isEmpty():
        stars = spread.join(checked(crowded), "anchor").select(F.col("node").alias("u"), F.col("centre").alias("v"))
        spread = spread.join(checked(crowded), "anchor", "left_anti")

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, node = rows
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        centre = np.repeat(node[new], np.diff(np.append(new, anchor.size)))
        pairs = np.unique(np.stack((node, centre), axis=1)[node != centre], axis=0)
        yield _edges(pairs[:, 0], pairs[:, 1])

    own = _by_anchor(spread, found)
    return own if stars is None else own.union(stars)


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that share at least ``SIMILAR`` of their members: places of both ends.

    Members that no other set has are counted but not compared; a set of which less
    than ``SIMILAR`` is found in any other cannot be in a pair and is left out.
    """
    size = np.array([x.size for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, member = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    # Empty sets equal each other.
    empty = np.flatnonzero(size == 0).tolist()
    edges = [(empty[0], x) for x in empty[1:]]
    while True:
        shared = np.bincount(member)[member] > 1 if member.size else np.zeros(0, bool)
        own = np.bincount(owner[shared], minlength=size.size)
        hopeful = (own >= SIMILAR * size) & (size > 0)
        keep = shared & hopeful[owner]
        if keep.all():
            break
        owner, member = owner[keep], member[keep]
    if not member.size:
        return edges
    _, member = np.unique(member, return_inverse=True)
    by_member = np.argsort(member, kind="stable")
    holders, at = owner[by_member], np.concatenate(([0], np.cumsum(np.bincount(member))))
    places = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=size.size))))
    fresh = np.zeros(size.size, bool)
    fresh[np.unique(owner)] = True
    for start in np.flatnonzero(fresh).tolist():
        frontier = [start] if fresh[start] else []
        fresh[start] = False
        while frontier:
            one = frontier.pop()
            both = np.zeros(size.size, np.int64)
            mine = member[places[one] : places[one + 1]]
            first, count = at[mine], at[mine + 1] - at[mine]
            for a in range(0, mine.size, 1024):  # the holders of so many members at a time
                c, ends = count[a : a + 1024], np.cumsum(count[a : a + 1024])
                both += np.bincount(holders[np.repeat(first[a : a + 1024] - (ends - c), c) + np.arange(ends[-1])], minlength=size.size)
            near = np.flatnonzero(fresh & (both >= SIMILAR * (size[one] + size - both))).tolist()
            edges += [(one, x) for x in near]
            fresh[near] = False
            frontier += near
    return edges


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``node, size, shingles``: the distinct word shingles of ``docs(node, text)`` as 64-bit hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            found = [np.unique(shingle_hashes(x, shingle_words)) for x in texts]
            yield pa.record_batch([rows.column("node"), pa.array([x.size for x in found], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["node", "size", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, size long, shingles binary")


def verified(families: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v``: in each family of ``families(node, family)`` enough of the pairs of sets at ``SIMILAR`` to connect all such pairs.

    Sets can only be that similar if the smaller has ``SIMILAR`` of the larger's
    members, so a set meets those of its own rung of sizes and the next.  A rung
    of more than ``BLOCK`` sets is dealt into chunks, and each two of them meet in a task.
    """
    rung = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.log(F.lit(1.0 / (SIMILAR - 1e-9)))).cast("int")
    held = materialise(families.join(sets.select("node", "size"), "node").select("node", "family", rung.alias("rung")), "rungs")
    # A rung's task holds its sets and those of the rung below; without any of its own it has nothing new to compare.
    meet = held.select("node", "family", F.explode(F.array(F.struct("rung", F.lit(True).alias("own")), F.struct((F.col("rung") + 1).alias("rung"), F.lit(False).alias("own")))).alias("at")).select("node", "family", "at.*")
    sizes = materialise(meet.groupBy("family", "rung").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 and own"), "rung_sizes")
    rows = 2 * held.count()
    mean = F.pow(F.lit(1 / SIMILAR), F.col("rung") + 1) * 8 / BLOCK_BYTES  # blocks that a set fills by its bytes
    blocks = F.greatest(F.col("n") / BLOCK, F.col("n") * mean)
    sizes = sizes.select(F.xxhash64("family", "rung").alias("place"), F.when(blocks > 1, F.least(F.ceil(2 * blocks), F.col("n"))).otherwise(1).cast("int").alias("chunks"), "n")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.least(own, x) * F.col("chunks") + F.greatest(own, x))
    placed = join_counted(meet.select("node", F.xxhash64("family", "rung").alias("place")), sizes, "place", "n", rows)
    placed = placed.select("node", F.explode(cells).alias("cell"), "place").select("node", F.xxhash64("place", "cell").alias("anchor"))
    work = placed.join(sets.select("node", "shingles"), "node").select("anchor", "node", "shingles")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, raw = None, [], []

        def found() -> pa.RecordBatch:
            pairs = np.array(similar_links([np.frombuffer(x, "<u8") for x in raw]), np.int64).reshape(-1, 2)
            names = np.array(nodes, np.int64)
            return _edges(names[pairs[:, 0]], names[pairs[:, 1]])

        for batch in batches:
            for anchor, node, shingles in zip(batch.column("anchor").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if anchor != at:
                    if len(nodes) > 1:
                        yield found()
                    at, nodes, raw = anchor, [], []
                nodes.append(node)
                raw.append(shingles)
        if len(nodes) > 1:
            yield found()
        hand_back()

    return work.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "u long, v long")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def copies_of(docs: DataFrame, shingle_words: int = 5, bits: int = 4) -> DataFrame:
    """``doc_id, mark, kept_id, kept_mark`` of every row: the document that stays of its group of near copies.

    Near copies share at least ``SIMILAR`` of their distinct word shingles, and a
    group is all that such pairs connect.  Candidates are the SimHash links of the
    anchors at ``bits``, and, as SimHash alone misses most pairs of that similarity,
    texts that share a band of least hashes of their shingles, wherever their edits
    stand.  Candidates' families are then compared in whole, by the exact shingle sets.

    A document is an id and a text, whose hash is the mark; rows that repeat both
    stay or go together, rows of one id and other texts are documents of their own.
    A text stays if its id is its group's least, ties by the mark; null ids are
    greatest.  Null and empty texts and those of white space alone are equal; a text
    of fewer words than a shingle is one shingle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            every = [shingle_hashes(x, shingle_words) for x in texts]
            sets = [np.unique(x) for x in every]
            columns = [rows.column("doc_id"), rows.column("mark"), pa.array([node_of(x) for x in sets], pa.int64()), pa.array(np.array([_majority(x) for x in every], np.uint64).view(np.int64)), pa.array([bands_of(least_hashes(x)) for x in sets], pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "mark", "node", "fp", "bands"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    prints = materialise(rows.mapInArrow(run, "doc_id long, mark long, node long, fp long, bands array<long>"), "prints")
    # The least document of each node; a struct's first field puts null ids last.
    least = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"), F.count("*").alias("copies"))
    least = materialise(least, "least")
    nodes = materialise(prints.select("node", "fp", "bands").dropDuplicates(["node"]), "nodes")
    near = links(nodes.select(F.lit(0).alias("table"), "fp", "node"), bits)
    families = materialise(connected_components(band_stars(nodes).union(near)).withColumnRenamed("component", "family"), "families")
    # Whole texts of one document a node, of nodes that have a family.
    chosen = materialise(least.join(families.select("node"), "node", "left_semi").select("node", "first.doc_id", "first.mark"), "chosen")
    chosen = checked(chosen.select("node", F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark")))
    texts = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")))
    sets = materialise(_sets(texts, shingle_words).dropDuplicates(["node"]), "sets")
    groups = connected_components(verified(families, sets))
    grouped = materialise(least.join(groups, "node", "left").select("node", "first", "copies", F.coalesce("component", "node").alias("group")), "labels")
    total = prints.count()
    named = grouped.groupBy("group").agg(F.min("first").alias("kept"), F.count("*").alias("members"))
    kept = materialise(join_counted(grouped, named, "group", "members", total).select("node", "copies", "kept"), "kept")
    return join_counted(prints.select("doc_id", "mark", "node"), kept, "node", "copies", total).select("doc_id", "mark", F.col("kept.doc_id").alias("kept_id"), F.col("kept.mark").alias("kept_mark"))


def drop_copies(docs: DataFrame, shingle_words: int = 5, bits: int = 4) -> DataFrame:
    """``docs`` without the rows that ``copies_of`` does not keep; all columns as they are."""
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    name, own, mark = (_free(docs, x) for x in ("gone", "gone_mark", "own_mark"))
    gone = copies_of(docs, shingle_words, bits).filter(~stays).select(F.col("doc_id").alias(name), F.col("mark").alias(own)).distinct()
    gone = checked(materialise(gone, "gone"))  # if few, they are broadcast and no text is shuffled
    marked = docs.withColumn(mark, F.xxhash64("text"))
    return marked.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(mark) == F.col(own)), "left_anti").drop(mark)
