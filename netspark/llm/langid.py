"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are hashed byte n-grams of 1 to 4 of the lower-cased letters; the weight
of a feature is its share of the text's n-grams times its inverse document
frequency.  Training is follow-the-regularised-leader with an elastic-net penalty
(so most weights stay exactly zero), followed by one temperature fitted on
documents kept aside, which turns the top probability into a confidence.

The fit takes a bounded sample (the parameter ``per_language``, whole texts);
document frequencies are counted over every whole text outside the held-out fold
that has a language, and prediction reads every whole text, a part of bounded size
at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
if nothing can be learned every text is ``und``; a null ``doc_id`` has
``held_out`` false and takes no part in the fit; repeated rows give repeated rows
and count once in the fitting sample; an empty table gives an empty table; more
than 256 languages to learn are an error; other columns are ignored, but that
``drop_unidentified`` keeps them as they are (without a model it keeps nothing, as
every text is ``und``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from netspark.llm.arrow_text import slices
from netspark.llm.grams import bags, candidates, fold, residue, sample, table_scores

PER_LANGUAGE = 1500
BITS = 16
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
_FOLD = fold(keep_digits=False)
_SCALE = 64.0


@dataclass
class Languages:
    """Names, one weight a bucket and language (inverse document frequency included), biases and temperature."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        total, number = table_scores(texts, self.weights, SIZES, BITS, _FOLD)
        return total / np.maximum(number, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language and its calibrated probability."""
        chance = _softmax(self.logits(texts) / self.temperature)
        best = chance.argmax(axis=1)
        return best, chance[np.arange(best.size), best]


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], rounds: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 3, frequencies: tuple[np.ndarray, int] | None = None) -> Languages | None:
    """Train on texts and their languages; one in five is kept aside for the temperature.

    ``frequencies`` are the document frequencies of the buckets and the number of
    documents; without them those of the training texts are taken.
    """
    names = sorted(set(langs))
    if not names:
        return None
    order = np.random.default_rng(seed).permutation(len(texts))
    aside, use = order[: len(order) // 5], order[len(order) // 5 :]
    label = np.array([names.index(x) for x in langs])
    held = list(bags([texts[i] for i in use], SIZES, BITS, _FOLD))
    if frequencies is None:
        frequencies = np.zeros(1 << BITS), len(held)
        for ids, _, _ in held:
            frequencies[0][ids] += 1
    seen, every = frequencies
    idf = np.log((1 + every) / (1 + seen)) + 1
    classes = len(names)
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    z_bias, n_bias = np.zeros(classes), np.zeros(classes)

    def lead(z: np.ndarray, n: np.ndarray, first: float, second: float) -> np.ndarray:
        w = -(z - np.sign(z) * first) / ((beta + np.sqrt(n)) / alpha + second)
        return np.where(np.abs(z) <= first, 0.0, w)

    for _ in range(rounds):
        for i in np.random.default_rng(seed).permutation(len(held)).tolist():
            ids, counts, number = held[i]
            if not number:
                continue
            x = counts / number * idf[ids] * _SCALE
            w, w_bias = lead(z[ids], n[ids], l1, l2), lead(z_bias, n_bias, 0.0, l2)
            wrong = _softmax((x @ w + w_bias)[None])[0]
            wrong[label[use[i]]] -= 1
            for at, grad, old, zz, nn in ((ids, x[:, None] * wrong, w, z, n), (slice(None), wrong, w_bias, z_bias, n_bias)):
                more = grad**2
                zz[at] += grad - (np.sqrt(nn[at] + more) - np.sqrt(nn[at])) / alpha * old
                nn[at] += more
    weights = lead(z, n, l1, l2) * idf[:, None] * _SCALE
    model = Languages(names, weights.astype(np.float32), lead(z_bias, n_bias, 0.0, l2), 1.0)
    if aside.size:
        logits, truth = np.concatenate([model.logits([texts[i] for i in aside[a : a + 200]]) for a in range(0, aside.size, 200)]), label[aside]
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(truth.size), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each bucket occurs, and the number of texts; 2 ** BITS numbers whatever the corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << BITS) + 1, np.int64)
        for _, texts in slices(batches):
            for ids, _, _ in bags(texts, SIZES, BITS, _FOLD):
                seen[ids] += 1
                seen[-1] += 1
        found = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(found), pa.array(seen[found])], names=["bucket", "n"])

    counted = docs.select("text").filter("text is not null").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((1 << BITS) + 1)
    for row in counted:
        seen[row["bucket"]] = row["n"]
    return seen[:-1], int(seen[-1])


def learn(docs: DataFrame, folds: int = 4, held_fold: int = 2, per_language: int = PER_LANGUAGE) -> Languages | None:
    """Fit on at most ``per_language`` documents of each language outside the held-out fold, with the document frequencies of them all."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (residue(F.col("doc_id").cast("long"), folds) != held_fold))
    marked = candidates(known, "lang").withColumnRenamed("lang", "label")
    texts, langs = sample(docs, marked, per_language)
    return fit(texts, langs, frequencies=document_frequencies(known)) if texts else None


def _named(model: Languages | None, batch: pa.RecordBatch, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted names and scores of a slice; ``und`` without a letter or a model."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best, score = model.predict(texts)
    return [model.names[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0)


def identify(docs: DataFrame, model: Languages | None, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    # One row of 2 ** BITS buckets for each learned language, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.coalesce(residue(docs["doc_id"].cast("long"), folds) == held_fold, F.lit(False)).alias("held_out"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            names, score = _named(shared.value, batch, texts)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: Languages | None, least_score: float = 0.5) -> DataFrame:
    """``docs`` without those that are ``und`` or less sure than ``least_score``; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            names, score = _named(shared.value, batch, texts)
            yield batch.filter(pa.array((np.array(names) != UNKNOWN) & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)
