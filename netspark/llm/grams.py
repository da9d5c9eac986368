"""Hashed byte n-grams of whole slices of documents, as array operations.

Texts are lower-cased, joined with separators and folded byte by byte through a
table.  An n-gram at a place is hashed from the (n-1)-gram there, so all sizes
cost one multiply and one add each.  A linear model over averaged n-grams is then
a table lookup at every place and a sum over each document's stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from netspark.plans.workspace import materialise

SEPARATOR = 0x20
#: Bytes that are scored at a time.
PART = 1 << 20
#: Characters of a fitting sample's texts of one label, beside its bound on rows.
SAMPLE_CHARS = 8_000_000
#: Labels that a model can tell apart; a model holds 256 KB for each.
MOST_LABELS = 256


def fold(keep_digits: bool = True, keep_marks: bool = False) -> np.ndarray:
    """Byte table: letters and bytes over 127 stay, all else is a separator (unless kept)."""
    table = np.full(256, SEPARATOR, np.uint8)
    kept = [*range(65, 91), *range(97, 123), *range(128, 256), *(range(48, 58) if keep_digits else ())]
    if keep_marks:
        kept = [b for b in range(33, 256)]
    table[kept] = kept
    return table


def stream(texts: list[str | None], table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, a separator before each and at the end; where each text's separator is, and the end."""
    parts = [((text.lower() if lower else text).encode("utf-8", "surrogatepass") if text else b"") for text in texts]
    begins = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)))
    return table[np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)], begins


def buckets(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each n in ``sizes`` (ascending) the bucket of the n-gram at every place that has one."""
    rolling = data.astype(np.uint32) + np.uint32(1)
    for n in range(1, sizes[-1] + 1):
        if n > 1:
            if data.size < n:
                return
            rolling = rolling[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in sizes:
            mixed = (rolling ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            yield n, mixed >> np.uint32(32 - bits)


def table_scores(texts: list[str | None], weights: np.ndarray, sizes: tuple[int, ...], bits: int, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights of each text's n-grams (one column a class) and their number; an n-gram of separators alone doesn't count.

    Long data are taken a part at a time, each with the bytes behind that its last n-grams reach into.
    """
    data, begins = stream(texts, table, lower)
    sum_, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for a in range(0, int(begins[-1]), PART):
        places = min(PART, int(begins[-1]) - a)
        total, number = np.zeros((places, weights.shape[1]), np.float32), np.zeros(places, np.float32)
        for _, bucket, valid in valid_buckets(data[a : a + places + sizes[-1] - 1], sizes, bits):
            bucket, valid = bucket[:places], valid[:places]
            total[: bucket.size] += weights[bucket] * valid[:, None]
            number[: bucket.size] += valid
        first, last = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, a + places, "left")
        edges = np.clip(begins[first : last + 1] - a, 0, places)
        sum_[first:last] += np.add.reduceat(total, edges[:-1], axis=0, dtype=np.float64)
        count[first:last] += np.add.reduceat(number, edges[:-1], dtype=np.float64)
    return sum_, count


def valid_buckets(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``buckets`` with a mask of the n-grams that start on a visible byte or, from two bytes on, just before one."""
    seen = data != SEPARATOR
    for n, bucket in buckets(data, sizes, bits):
        valid = seen[: bucket.size].copy()
        if n > 1:
            valid |= seen[1 : bucket.size + 1]
        yield n, bucket, valid


def bags(texts: list[str], sizes: tuple[int, ...], bits: int, table: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each text: its buckets, their counts and the number of n-grams."""
    for text in texts:
        data, _ = stream([text], table, lower)
        found = [bucket[valid] for _, bucket, valid in valid_buckets(data, sizes, bits)]
        ids, counts = np.unique(np.concatenate(found), return_counts=True)
        yield ids, counts, int(counts.sum())


def candidates(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id, mark, chars`` and ``more`` of texts that are not empty; the mark is a hash of id and text. No text leaves the scan."""
    return docs.filter((F.length("text") > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("mark"), F.length("text").alias("chars"), *more)


def sample(docs: DataFrame, marked: DataFrame, per_label: int, most_chars: int = SAMPLE_CHARS) -> tuple[list[str], list]:
    """Whole texts and labels of a bounded sample to fit on: at most ``per_label`` documents of each label.

    ``marked`` holds ``doc_id, mark, chars, label`` rows; rows that repeat a document
    count once.  Those of the least marks are taken whatever their length, until their
    texts hold ``most_chars`` characters (the first is taken in any case), so the
    sample does not depend on how the table is stored.  Only the chosen ids (a bounded
    number) are sent to the scan that fetches their texts.  Over ``MOST_LABELS``
    labels are an error, as every label's texts and weights go through the driver.
    """
    marked = marked.filter("label is not null").groupBy("doc_id", "mark").agg(F.max("chars").alias("chars"), F.min("label").alias("label"))
    marked = materialise(marked, "marked")
    sizes = marked.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels to learn")
    if not sizes:
        return [], []
    order = Window.partitionBy("label").orderBy("mark", "doc_id")
    # Marks are even, so those of a frequent label that can be among the least lie below a bound: no label's rows meet in one task.
    # Four times as many are kept as are wanted; should they ever be too few, all are ranked.
    bounds = [(r["label"], -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * per_label // r["n"])) for r in sizes]
    low = docs.sparkSession.createDataFrame(bounds, f"label {dict(marked.dtypes)['label']}, bound long")
    near = marked.join(F.broadcast(low), "label").filter(F.col("mark") <= F.col("bound")).drop("bound")
    ranked = materialise(near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_label), "ranked")
    if ranked.count() < sum(min(per_label, r["n"]) for r in sizes):
        ranked = materialise(marked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_label), "ranked")
    upto = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    chosen = ranked.withColumn("upto", upto).filter((F.col("upto") <= most_chars) | (F.col("rank") == 1)).collect()  # at most per_label * MOST_LABELS rows
    if not chosen:
        return [], []
    wanted = {(r["doc_id"], r["mark"]): r["label"] for r in chosen}
    ids = docs.sparkSession.createDataFrame(list(wanted), "doc_id long, mark long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("mark"), "text")
    texts = {(r["doc_id"], r["mark"]): r["text"] for r in own.join(F.broadcast(ids), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).collect()}
    keys = sorted(wanted, key=lambda k: (k[1], k[0]))
    return [texts[k] for k in keys], [wanted[k] for k in keys]


def residue(column, modulus: int):
    """CRC-32 of the id as text, modulo ``modulus``; null where the id is null."""
    return F.crc32(column.cast("string")) % modulus
