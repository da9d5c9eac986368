"""Ordinal quality: cumulative-link regression on graded ratings.

One weight for each hashed feature is shared by all grades; ordered thresholds
split the resulting scale, so P(grade > k) = logistic(score - threshold k).  The
features are hashed byte n-grams of 1 to 4 of the text as it stands (case and
marks kept) and the share of words that repeat the word before.  Thresholds are
kept in order by learning the logarithm of their gaps.  Training is AdaGrad on
the likelihood in numpy.

A document's expected grade is the sum of its tail probabilities;
``tail_probability`` is the chance of a grade of at least ``SELECT_GRADE``, and
``selected`` keeps what reaches ``SELECT_CHANCE``.

The fit takes a bounded sample (the parameter ``per_grade``, whole texts); scoring
reads every whole text, a part of bounded size at a time.

Defined results: a null or empty text has no features and gets the thresholds'
own grade; null ratings take no part; if only one grade is rated, every document
has that grade, and grade 0 if none is; so it is selected if that grade is at
least ``SELECT_GRADE``.  A null ``doc_id`` is scored but not learned from; of
several ratings of a document the least counts; repeated rows give repeated rows
and count once in the fit; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netspark.llm.arrow_text import slices
from netspark.llm.grams import bags, candidates, fold, residue, sample, table_scores

PER_GRADE = 2000
BITS = 16
SIZES = (1, 2, 3, 4)
SELECT_GRADE = 1
SELECT_CHANCE = 0.5
_FOLD = fold(keep_marks=True)
_SCALE = 32.0


def repeats(text: str | None) -> float:
    """Share of words equal to the word before."""
    words = text.split() if text else []
    return sum(map(str.__eq__, words, words[1:])) / len(words) if words else 0.0


@dataclass
class Grades:
    """Shared weights (the last is of ``repeats``) and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        total, number = table_scores(texts, self.weights[:-1, None], SIZES, BITS, _FOLD, lower=False)
        score = total[:, 0] / np.maximum(number, 1) * _SCALE + self.weights[-1] * np.array([repeats(x) for x in texts])
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -60, 60)))


def fit(texts: list[str], grades: np.ndarray, rounds: int = 6, rate: float = 0.5, seed: int = 5) -> Grades:
    """Train on texts and integer grades from 0."""
    top = int(grades.max()) if grades.size else 0
    if len(set(grades.tolist())) < 2:
        return Grades(np.zeros((1 << BITS) + 1, np.float32), np.where(np.arange(max(top, 1)) < top, -60.0, 60.0))
    held = list(bags(texts, SIZES, BITS, _FOLD, lower=False))
    extra = [repeats(x) for x in texts]
    weights, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.sort(-np.log(share / (1 - share)))
    gaps = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    seen_gaps = np.full(top, 1e-8)
    balance = 1 / np.maximum(np.bincount(grades, minlength=top + 1), 1)
    balance = balance / balance[grades].mean()
    for turn in range(rounds):
        for i in np.random.default_rng(seed + turn).permutation(len(held)).tolist():
            ids, counts, number = held[i]
            ids = np.append(ids, 1 << BITS)
            x = np.append(counts / max(number, 1) * _SCALE, extra[i])
            cuts = np.concatenate((gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))))
            y, score = int(grades[i]), float(x @ weights[ids])
            tail = np.concatenate(([1.0], 1 / (1 + np.exp(-np.clip(score - cuts, -30, 30))), [0.0]))
            slope = tail * (1 - tail)
            chance = max(tail[y] - tail[y + 1], 1e-9)
            # Gradient of -log(chance) by the score, and by the two thresholds around the grade.
            by_score = -(slope[y] - slope[y + 1]) / chance * balance[y]
            by_cut = np.zeros(top)
            if y > 0:
                by_cut[y - 1] += slope[y] / chance * balance[y]
            if y < top:
                by_cut[y] -= slope[y + 1] / chance * balance[y]
            grad = np.clip(by_score, -5, 5) * x
            seen[ids] += grad**2
            weights[ids] -= rate * grad / np.sqrt(seen[ids])
            later = np.cumsum(by_cut[::-1])[::-1]
            pull = np.clip(np.concatenate((later[:1], later[1:] * np.exp(gaps[1:]))), -5, 5)
            seen_gaps += pull**2
            gaps -= 0.1 * pull / np.sqrt(seen_gaps)
    return Grades(weights.astype(np.float32), np.concatenate((gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:])))))


def rating(quality: Column, toxic: Column) -> Column:
    """Grade of a labelled document: 0 poor, 1 well written but toxic, 2 well written and clean."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def learn(docs: DataFrame, ratings: DataFrame, folds: int = 5, held_fold: int = 0, per_grade: int = PER_GRADE) -> Grades:
    """Fit on at most ``per_grade`` documents of each grade of ``ratings(doc_id, grade)`` outside the held-out fold."""
    marks = ratings.filter("doc_id is not null and grade is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = marks.filter(residue(F.col("doc_id"), folds) != held_fold).withColumnRenamed("grade", "label")
    texts, grades = sample(docs, candidates(docs).join(rated, "doc_id"), per_grade)
    return fit(texts, np.array(grades, np.int64))


def grade_documents(docs: DataFrame, model: Grades, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_probability, selected`` of every document."""
    # 256 KB of weights whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.coalesce(residue(docs["doc_id"].cast("long"), folds) == held_fold, F.lit(False)).alias("held_out"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Grades(*shared.value)
        at = min(SELECT_GRADE, model.thresholds.size) - 1
        for batch, texts in slices(batches):
            tails = model.tails(texts)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(tails.sum(axis=1)), pa.array(tails[:, at]), pa.array(tails[:, at] >= SELECT_CHANCE)], names=["doc_id", "held_out", "expected_grade", "tail_probability", "selected"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, tail_probability double, selected boolean")
