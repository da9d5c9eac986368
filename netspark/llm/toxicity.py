"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every word is the bag of its byte n-grams of 3 to 6, marked at both ends, so a
misspelling shares most of its vectors with the word it comes from.  The vectors
of a window of words are averaged and go through a linear softmax; a document's
logits are those of its most toxic window, so a few words in a long text are not
averaged away.  Embeddings and softmax are trained jointly with AdaGrad in numpy:
first on all windows, then on each document's highest window.

Because the head is linear, a document is scored through one number a bucket, and
a gradient reaches the embeddings as one number a bucket too.

The fit takes a bounded sample (the parameter ``per_label``, whole texts); scoring
reads every whole text, a part of bounded size at a time.

Defined results: a null or empty text, or one without words, has score 0; a null
``doc_id`` has ``held_out`` false and takes no part in the fit; null labels take no
part; without both labels the score is 0; repeated rows give repeated rows and
count once in the fit; an empty table gives an empty table; other columns are
ignored, but that ``drop_toxic`` keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netspark.llm.arrow_text import slices
from netspark.llm.grams import PART, SEPARATOR, buckets, candidates, fold, residue, sample, stream

PER_LABEL = 4000
BITS = 16
SIZES = (3, 4, 5, 6)
WORDS = 16
_FOLD = fold()


def windows(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows of words begin (ending with the data's end), and each window's document."""
    seen = data != SEPARATOR
    start = np.flatnonzero(seen[1:] & ~seen[:-1])  # the separator before each word
    owner = np.searchsorted(begins, start, side="right") - 1
    number = np.bincount(owner, minlength=begins.size - 1)
    first = np.concatenate(([0], np.cumsum(number)))[:-1]
    nth = np.arange(start.size) - first[owner]
    window = np.minimum(nth // WORDS, np.maximum(number // WORDS - 1, 0)[owner])
    new = np.ones(start.size, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1])
    return np.append(start[new], data.size), owner[new]


def subwords(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and validity of the n-grams at each place: no separator inside."""
    inside = np.concatenate(([0], np.cumsum(data == SEPARATOR)))
    for n, bucket in buckets(data, SIZES, BITS):
        m = bucket.size
        yield bucket, inside[n - 1 : n - 1 + m] == inside[1 : 1 + m]


@dataclass
class Toxicity:
    """One number a bucket (its vector times the softmax's difference) and the bias."""

    bucket: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text."""
        data, begins = stream(texts, _FOLD)
        edges, owner = windows(data, begins)
        out = np.full(len(texts), -np.inf)
        sums, counts = np.zeros(owner.size), np.zeros(owner.size)
        for a in range(int(edges[0]), data.size, PART):
            places = min(PART, data.size - a)
            total, number = np.zeros(places, np.float32), np.zeros(places, np.float32)
            for bucket, valid in subwords(data[a : a + places + SIZES[-1] - 1]):
                bucket, valid = bucket[:places], valid[:places]
                total[: bucket.size] += self.bucket[bucket] * valid
                number[: bucket.size] += valid
            first, last = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, a + places, "left")
            begins = np.clip(edges[first : last + 1] - a, 0, places)[:-1]
            sums[first:last] += np.add.reduceat(total, begins, dtype=np.float64)
            counts[first:last] += np.add.reduceat(number, begins, dtype=np.float64)
        np.maximum.at(out, owner, sums / np.maximum(counts, 1))
        return np.where(np.isinf(out), 0.0, 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60))))


def fit(texts: list[str], toxic: np.ndarray, size: int = 16, rounds: int = 24, rate: float = 0.25, seed: int = 7) -> Toxicity:
    """Train vectors and softmax on whole texts and their labels."""
    if len(set(toxic.tolist())) < 2:
        return Toxicity(np.zeros(1 << BITS, np.float32), -60.0)
    grams, edges, owners = [], [], []
    for at in range(0, len(texts), 200):
        data, begins = stream(texts[at : at + 200], _FOLD)
        places, owner = windows(data, begins)
        if not owner.size:
            continue
        # Place by place, so that a window's grams stand together.
        table = np.zeros((data.size, len(SIZES)), np.uint16)
        there = np.zeros((data.size, len(SIZES)), bool)
        for j, (bucket, valid) in enumerate(subwords(data)):
            table[: bucket.size, j], there[: bucket.size, j] = bucket, valid
        grams.append(table[there])
        edges.append(np.add.reduceat(there.sum(axis=1), places[:-1]))
        owners.append(owner + at)
    flat, owner = np.concatenate(grams), np.concatenate(owners)
    edge = np.concatenate(([0], np.cumsum(np.concatenate(edges))))
    held = np.diff(edge)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (1 << BITS, size)).astype(np.float32)
    soft, bias = np.zeros((2, size), np.float32), np.zeros(2)
    seen_v, seen_s, seen_b = np.full(1 << BITS, 1e-8, np.float32), np.full((2, size), 1e-8, np.float32), 1e-8

    def means() -> np.ndarray:
        value = vectors @ (soft[1] - soft[0])
        out = np.empty(held.size)
        for a in range(0, held.size, 20_000):
            b = min(a + 20_000, held.size)
            out[a:b] = np.add.reduceat(value[flat[edge[a] : edge[b]]], edge[a:b] - edge[a], dtype=np.float64) / held[a:b]
        return out

    def step(chosen: np.ndarray) -> None:
        nonlocal bias, seen_b, soft
        count = held[chosen]
        ends = np.cumsum(count)
        ids = flat[np.repeat(edge[chosen] - (ends - count), count) + np.arange(ends[-1])]
        turn = soft[1] - soft[0]
        value = (vectors @ turn)[ids]
        logit = np.add.reduceat(value, ends - count) / count + (bias[1] - bias[0])
        label = toxic[owner[chosen]]
        weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
        wrong = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - label) * weight
        pull = np.bincount(ids, weights=np.repeat(wrong / count, count), minlength=1 << BITS).astype(np.float32)
        at = np.flatnonzero(pull)
        grad_s = pull[at] @ vectors[at]
        seen_v[at] += pull[at] ** 2
        vectors[at] -= (rate * pull[at] / np.sqrt(seen_v[at]))[:, None] * (turn if turn.any() else np.full(size, 1 / size, np.float32) * rng.choice([-1, 1], size).astype(np.float32))
        for c, sign in ((1, 1), (0, -1)):
            seen_s[c] += grad_s**2
            soft[c] -= sign * rate * grad_s / np.sqrt(seen_s[c])
        seen_b += wrong.sum() ** 2
        bias += np.array([1, -1]) * rate * wrong.sum() / np.sqrt(seen_b)

    usable = np.arange(held.size)
    for turn in range(rounds):
        if turn == 0:
            chosen = usable
        else:
            order = np.lexsort((means(), owner))
            chosen = order[np.append(owner[order][1:] != owner[order][:-1], True)]
        chosen = rng.permutation(chosen)
        for a in range(0, chosen.size, 256):
            step(chosen[a : a + 256])
    return Toxicity((vectors @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, per_label: int = PER_LABEL) -> Toxicity:
    """Fit on at most ``per_label`` documents of each label outside the held-out fold."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(residue(F.col("doc_id"), folds) != held_fold)
    marked = candidates(docs).join(marks.withColumnRenamed("toxic", "label"), "doc_id")
    texts, toxic = sample(docs, marked, per_label)
    return fit(texts, np.array(toxic, np.int64))


def score_documents(docs: DataFrame, model: Toxicity, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    # 256 KB of bucket values whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket, model.bias))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.coalesce(residue(docs["doc_id"].cast("long"), folds) == held_fold, F.lit(False)).alias("held_out"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(*shared.value)
        for batch, texts in slices(batches):
            score = model.score(texts)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the documents that reach ``threshold``; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket, model.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(*shared.value)
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(model.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
