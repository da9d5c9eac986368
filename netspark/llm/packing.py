"""Pack tokenised documents into fixed windows with non-negative least squares.

A document longer than the window is cut into full windows and a rest, so only
lengths 1..window are left and their histogram has at most ``window`` bins
whatever the corpus.  The plan is made from that histogram alone:

1. Lengths of at least ``least`` are grouped in steps of ``quantum``; every
   combination of at most three groups that fills the window is a column, and
   Lawson-Hanson non-negative least squares solves how often each is used.
2. The counts are rounded, never beyond what the histogram holds.
3. What is left is packed greedily, longest first, again by whole counts.

A piece finds its place by its rank among pieces of its length.  Ranks are
counted per task and offset by a running sum over tasks, so one length that holds
a third of all rows never meets in one task.  The plan's rows are bounded by the
window (not the corpus), which is checked before it is broadcast.

Defined results: a null or empty text is the closing id alone; a null ``doc_id``
stays null; repeated rows are packed once each; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from netspark.llm.arrow_text import hand_back, slices
from netspark.llm.pretoken import PieceMemory
from netspark.plans.workspace import materialise

WINDOW = 2048
CLOSING_ID = 1
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, task_rank long"
PLAN = "length int, first_rank long, past_rank long, first_sequence long, offset long"


# --- tokens -------------------------------------------------------------------

_TOKENIZERS: dict[str, PieceMemory] = {}


def _memory(path: str) -> PieceMemory:
    """Ids by the ``tokenizers`` file at ``path``, each distinct piece encoded once a worker."""
    if path not in _TOKENIZERS:
        import json
        import os

        import tiktoken
        from public_tokenizers import PATTERN

        # The file's own vocabulary, run by the faster library; the tests hold it against `tokenizers`.
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {x["content"] for x in vocabulary["added_tokens"] if x["special"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
        coder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode_many(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = list(map(coder.encode_ordinary, pieces))  # the batch call would start a thread a piece
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((x for ids in lists for x in ids), np.int32, int(counts.sum())), counts

        memory = PieceMemory(encode_many)
        memory.special = {x["content"]: x["id"] for x in vocabulary["added_tokens"] if x["special"]}
        _TOKENIZERS[path] = memory
        del vocabulary, ranks
        hand_back()
    return _TOKENIZERS[path]


def token_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text as the ``tokenizers`` library gives them: a special token's string is its own id."""
    memory = _memory(path)
    flat, offsets = memory.encode(texts)
    out = [flat[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    if memory.special:
        names = re.compile("(" + "|".join(re.escape(x) for x in sorted(memory.special, key=len, reverse=True)) + ")")
        for i, text in enumerate(texts):
            if text and names.search(text):
                parts = names.split(text)  # every second part is a special token
                plain = memory.encode(parts[::2])
                out[i] = plain[0][: plain[1][1]]
                for name, a, b in zip(parts[1::2], plain[1][1:].tolist(), plain[1][2:].tolist(), strict=True):
                    out[i] = np.concatenate((out[i], np.array([memory.special[name]], np.int32), plain[0][a:b]))
    return out


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of every document, with their rank among the task's pieces of that length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(window + 1, np.int64)
        task = TaskContext.get().partitionId()
        for rows, texts in slices(batches):
            names, out = rows.column("doc_id").to_pylist(), []
            for name, ids in zip(names, token_ids(texts, tokenizer_path), strict=True):
                ids = np.append(ids, closing_id).astype("<u4")
                for start in range(0, ids.size, window):
                    piece = ids[start : start + window]
                    out.append((name, start, piece.size, zlib.crc32(piece.tobytes()), ids.size, task, int(seen[piece.size])))
                    seen[piece.size] += 1
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


# --- plan ---------------------------------------------------------------------


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson-Hanson: the non-negative ``x`` that minimises ``|columns @ x - target|``.

    Ends at the least, or after ``rounds`` columns have come in (three a row of
    ``columns`` unless stated); ``x`` is then near the least, and what it leaves is packed greedily.
    """
    n = columns.shape[1]
    x, chosen = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, np.abs(target).max())
    for _ in range(rounds or 3 * columns.shape[0]):
        gradient = columns.T @ (target - columns @ x)
        gradient[chosen] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= slack:
            break
        chosen[best] = True
        while True:
            at = np.flatnonzero(chosen)
            part = columns[:, at]
            square = part.T @ part
            square[np.diag_indices_from(square)] += 1e-9
            trial = np.linalg.solve(square, part.T @ target)
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            step = (x[at][low] / np.maximum(x[at][low] - trial[low], 1e-300)).min()
            x[at] += step * (trial - x[at])
            chosen[at[x[at] <= slack * 1e-3]] = False
            x[~chosen] = 0
            if not chosen.any():
                break
    return x


def combinations(bins: int, least: int) -> list[tuple[int, ...]]:
    """Every combination of at most three groups in ``least..bins - 1`` that sums to ``bins``."""
    pairs = [(bins - b, b) for b in range(least, bins // 2 + 1)]
    triples = [(bins - b - c, b, c) for c in range(least, bins // 3 + 1) for b in range(c, (bins - c) // 2 + 1)]
    return pairs + triples


@dataclass
class Plan:
    """Rows of PLAN, and how many sequences they make."""

    sequences: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=dict)

    def take(self, slots: list[int], times: int) -> None:
        """``times`` sequences that hold ``slots``, by length."""
        offset = 0
        for length in slots:
            rank = self.used.get(length, 0)
            self.rows.append((length, rank, rank + times, self.sequences, offset))
            self.used[length] = rank + times
            offset += length
        self.sequences += times


def plan_windows(histogram: dict[int, int], window: int = WINDOW, quantum: int = 8, least: int = 64) -> Plan:
    """Where each piece goes, from the counts of lengths ``1..window``."""
    left = np.zeros(window + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan = Plan()
    if left[window]:
        plan.take([window], int(left[window]))
        left[window] = 0
    bins = window // quantum
    group = -(-np.arange(window + 1) // quantum)
    group[:least] = 0
    held = np.bincount(group, weights=left, minlength=bins + 1).astype(np.int64)
    shapes = combinations(bins, -(-least // quantum))
    shapes = [s for s in shapes if all(held[b] for b in s)]
    if shapes:
        columns = np.zeros((bins + 1, len(shapes)))
        for j, shape in enumerate(shapes):
            np.add.at(columns[:, j], list(shape), 1)
        target = held.astype(float)
        target[0] = 0
        repeats = nnls(columns, target)
        for j in np.argsort(-repeats, kind="stable").tolist():
            if repeats[j] < 0.5:
                break
            need = np.bincount(shapes[j], minlength=bins + 1)
            times = min(int(np.rint(repeats[j])), int((held[need > 0] // need[need > 0]).min()))
            if times:
                _fill(plan, left, group, held, shapes[j], times)
    _greedy(plan, left, window)
    return plan


def _fill(plan: Plan, left: np.ndarray, group: np.ndarray, held: np.ndarray, shape: tuple[int, ...], times: int) -> None:
    """Use a combination of groups ``times`` times, the longest pieces of each group first."""
    runs = []
    for b in shape:
        need, run = times, []
        for length in np.flatnonzero((group == b) & (left > 0))[::-1].tolist():
            got = min(need, int(left[length]))
            run.append((length, got))
            left[length] -= got
            need -= got
            if not need:
                break
        held[b] -= times
        runs.append(run)
    # Between two changes of length in any slot the offsets are the same.
    while times:
        step = min(run[0][1] for run in runs)
        plan.take([run[0][0] for run in runs], step)
        runs = [[(run[0][0], run[0][1] - step), *run[1:]] if run[0][1] > step else run[1:] for run in runs]
        times -= step


def _greedy(plan: Plan, left: np.ndarray, window: int) -> None:
    """Longest first: fill each window with the longest pieces that still fit, as often as counts allow."""
    there = np.flatnonzero(left).tolist()
    while there:
        slots, room, upto = [], window, len(there)
        while room and (upto := bisect_right(there, room, 0, upto)):
            length = there[upto - 1]
            fit = min(room // length, int(left[length]))
            slots += [(length, fit)]
            room -= fit * length
            upto -= 1
        times = min(int(left[length]) // fit for length, fit in slots)
        plan.take([length for length, fit in slots for _ in range(fit)], times)
        for length, fit in slots:
            left[length] -= fit * times
        there = [x for x in there if left[x]]


#: No plan has more rows: see _fill (changes of length) and _greedy (each round ends or halves a length).
def most_plan_rows(window: int) -> int:
    return 64 * window * 2


# --- operator -----------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, tokenizer_path, window, closing_id), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("count"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    plan = plan_windows(counts, window)
    if len(plan.rows) > most_plan_rows(window):
        raise RuntimeError(f"a plan of {len(plan.rows)} rows")
    places = spark.createDataFrame(plan.rows, PLAN)
    ranked = pieces.join(bases.select("length", "task", "base"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (ranked["rank"] >= places["first_rank"]) & (ranked["rank"] < places["past_rank"]))
    return placed.select(
        "doc_id",
        "start",
        ranked["length"].cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
