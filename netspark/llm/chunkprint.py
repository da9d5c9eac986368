"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes (each byte's random number, shifted in), so a
boundary depends on the last 32 bytes only and an insertion moves no boundary
beyond it.  Chunk lengths are normalised: below ``NORMAL`` bytes a boundary needs
more zero bits than above it, with ``SHORTEST`` and ``LONGEST`` as limits.  The
fingerprint is the set of chunk digests with the chunks' total length for each;
the likeness of one document to another is the share of its own length whose
chunks the other also has (containment).

The next document by descending id is met without gathering anything: ids are cut
into ranges, each range is sorted in one task and streams through it, and only the
first row of a range is also sent to the range before it.  An id that fills whole
ranges by itself, such as null, is cut by the hash of its texts; rows that are equal
in id and text stay in one range.

Defined results: a null text counts as empty; an empty text has fingerprint ""
and likeness 1 to an empty text, 0 to any other; null ids come last (as least),
ties of id are ordered by the text's hash and text; a single document is its own
next; repeated rows follow each other; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netspark.llm.arrow_text import slices
from netspark.llm.sharding import numbers, range_of

SHORTEST, NORMAL, LONGEST = 12, 32, 128
STRICT_BITS, LOOSE_BITS = 6, 4
#: Characters of text a range of ids holds about; beyond MOST_RANGES ranges, which go through the driver, they hold more and stream for longer.
RANGE_CHARS = 8 << 20
MOST_RANGES = 50_000
_NO_ID = -(1 << 63)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RNG = np.random.default_rng(977)
_GEAR = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or _POWERS[0].size < n:
        _POWERS[:] = [np.cumprod(np.full(max(n, 1 << 16), x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a byte string."""
    n = data.size
    if not n:
        return []
    rolled = _GEAR[data]
    for width in (1, 2, 4, 8, 16):  # the last 2 * width bytes
        if n > width:
            rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint32(width))
    top = rolled >> np.uint32(32 - STRICT_BITS)
    loose = np.flatnonzero(top < np.uint32(1 << (STRICT_BITS - LOOSE_BITS)))
    strict = loose[top[loose] == 0] + 1
    loose, strict = (loose + 1).tolist(), strict.tolist()
    ends, at, i, j = [], 0, 0, 0
    some, many = len(strict), len(loose)
    while n - at > SHORTEST:
        i = bisect_left(strict, at + SHORTEST, i)
        if i < some and strict[i] < at + NORMAL:
            at = strict[i]
        else:
            j = bisect_left(loose, at + NORMAL, j)
            at = min(loose[j] if j < many else n, at + LONGEST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chunk digests of a text, ascending, and the bytes each stands for."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not data.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.asarray(boundaries(data), np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    power, inverse = _powers(data.size)
    total = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: data.size], out=total[1:])
    digest = (total[ends] - total[begins]) * inverse[begins]
    digest = (digest ^ (digest >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    digest ^= digest >> np.uint64(32)
    names, of = np.unique(digest, return_inverse=True)
    return names, np.bincount(of, weights=ends - begins, minlength=names.size).astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of ``a``'s length whose chunks ``b`` has, at most as long as ``b`` has them."""
    if not a[0].size or not b[0].size:
        return float(a[0].size == b[0].size)
    at = np.minimum(np.searchsorted(b[0], a[0]), b[0].size - 1)
    same = b[0][at] == a[0]
    return float(np.minimum(a[1], b[1][at])[same].sum() / a[1].sum())


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint as text: each chunk's digest (64 bits in base 64) and length in hexadecimal."""
    coded = base64.urlsafe_b64encode(print_[0].astype(">u8").view(np.uint8).reshape(-1, 8).repeat([1] * 7 + [2], axis=1).tobytes()).decode()  # 12 signs each; the last byte again fills the last
    return " ".join(f"{coded[12 * i : 12 * i + 11]}:{n:x}" for i, n in enumerate(print_[1].tolist()))


def _dealt(keyed: DataFrame) -> DataFrame:
    """``keyed(doc_id, text, order, hash)`` with ``part`` from 0, the range of each row; those of the greatest ids first."""
    facts = keyed.agg(F.sum(F.length("text") + 64).alias("chars")).first()
    number = int(min(MOST_RANGES, max(1, (facts["chars"] or 0) // RANGE_CHARS)))
    shares = [i / number for i in range(1, number)]
    cuts = keyed.agg(F.percentile_approx("order", shares, 20 * number).alias("q")).first()["q"] if shares else []
    if not cuts:
        return keyed.withColumn("part", F.lit(0))
    # Upper ends of ranges, and how many ranges each closes: an id that is several cuts fills as many by itself.
    same = Counter(cuts)
    ends = sorted(same)
    begins = [0, *accumulate(same[x] for x in ends)]
    which = range_of(F.col("order"), [x + 1 for x in ends if x < (1 << 63) - 1]) + 1
    at, many, end = (F.element_at(numbers(x, "bigint"), which) for x in (begins, [*(same[x] for x in ends), 1], [*ends, 0]))
    # Hashes are even, so the rows of such an id are cut at even steps of them.
    step = F.least(many - 1, F.floor((F.col("hash").cast("double") / float(1 << 64) + 0.5) * many))
    upwards = at + F.when((F.col("order") == end) & (many > 1), step).otherwise(0)
    return keyed.withColumn("part", (F.lit(begins[-1]) - upwards).cast("int"))


def print_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("order", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("hash", F.xxhash64("text"))
    spread = _dealt(keyed)
    # The first row of each range, one row a range: the greatest id, ties to the greatest hash.
    firsts = [(r["part"], r["top"]["order"], r["top"]["hash"]) for r in spread.groupBy("part").agg(F.max(F.struct("order", "hash")).alias("top")).orderBy("part").collect()]
    if not firsts:
        return keyed.mapInArrow(lambda batches: iter(()), SCHEMA)
    # It also closes the range before it; that of the first range closes the last.
    ends = docs.sparkSession.createDataFrame([(part, order, hash_, firsts[i - 1][0]) for i, (part, order, hash_) in enumerate(firsts)], "part int, order long, hash long, closes int")
    leading = spread.join(F.broadcast(ends), ["part", "order", "hash"]).select("doc_id", "text", "order", "hash", F.col("closes").alias("part"))
    # Rows that repeat it are equal in id and hash; the greatest text of them comes first, and one of it is enough.
    closing = leading.groupBy("part").agg(F.max(F.struct("text", "doc_id", "order", "hash")).alias("x")).select("x.doc_id", "x.text", "x.order", "x.hash", "part", F.lit(1).alias("tail"))
    dealt = spread.select("doc_id", "text", "order", "hash", "part", F.lit(0).alias("tail")).unionByName(closing)
    dealt = dealt.repartition(len(firsts), "part").sortWithinPartitions("part", "tail", F.desc("order"), F.desc("hash"), F.desc("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for rows, texts in slices(batches):
            out = []
            for name, text, tail in zip(rows.column("doc_id").to_pylist(), texts, rows.column("tail").to_pylist(), strict=True):
                own = chunks(text)
                if held is not None:
                    out.append(_compare(held, (name, text, own)))
                held = None if tail else (name, text, own)
            yield _batch(out)

    return dealt.select("doc_id", "text", "tail").mapInArrow(run, SCHEMA)


def _compare(this: tuple, after: tuple) -> tuple:
    name, text, own = this
    half = len(text) // 2
    edited = text[: len(text) - half] + after[1][:half]
    changed = chunks(edited)
    return (name, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, after[2]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
