"""Forbidden runs of edges as an automaton table.

A run is a sequence of two or more edges that may not be walked in order.  The
automaton follows the longest suffix of the walk that begins a run; it is built on
the driver (its size is the total length of the runs) and used as a table
``(state, edge) -> (next, refused)``.  Edges not listed for a state lead to 0.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F


class Turns:
    """Transitions of the automaton of some runs."""

    def __init__(self, runs: Iterable[Iterable[int]] = ()):
        self.runs = [tuple(run) for run in runs]
        self.runs = [run for run in self.runs if len(run) >= 2]
        trie: list[dict[int, int]] = [{}]
        ends = {0: False}
        for run in self.runs:
            state = 0
            for edge in run:
                if edge not in trie[state]:
                    ends[len(trie)] = False
                    trie[state][edge] = len(trie)
                    trie.append({})
                state = trie[state][edge]
            ends[state] = True
        self.moves: list[dict[int, int]] = [dict(trie[0])] + [{}] * (len(trie) - 1)
        self.refuse = ends
        fall = {child: 0 for child in trie[0].values()}
        queue = deque(fall)
        while queue:
            state = queue.popleft()
            self.refuse[state] |= self.refuse[fall[state]]
            self.moves[state] = self.moves[fall[state]] | trie[state]
            for edge, child in trie[state].items():
                fall[child] = self.moves[fall[state]].get(edge, 0)
                queue.append(child)

    @property
    def empty(self) -> bool:
        return not self.runs

    def advance(self, state: int, edge: int) -> int | None:
        """The next state, or None where the step completes a forbidden run."""
        following = self.moves[state].get(edge, 0)
        return None if self.refuse[following] else following

    def reversed(self) -> Turns:
        return Turns(run[::-1] for run in self.runs)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, e, n, bool(self.refuse[n])) for s, moves in enumerate(self.moves) for e, n in moves.items()]
        return spark.createDataFrame(rows, "state int, edge long, next int, refused boolean")


def runs_of(edges: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """``edge, run`` of a text column: ``"77 91>34"`` on edge e means runs [e, 77] and [e, 91, 34].

    The numbers are edges of ``edges``, or ids of ``known(edge, id)``; a run that names
    one that is not there is dropped, the others stay.
    """
    ids = edges.select("edge", F.col("edge").cast("string").alias("id")) if known is None else known
    told = edges.filter(F.col(column).isNotNull()).select("edge", F.posexplode(F.split(F.trim(column), r"\s+")).alias("nth", "text")).filter("text <> ''")
    each = told.select("edge", "nth", F.posexplode(F.split("text", ">")).alias("at", "id"))
    found = each.join(ids.select(F.col("edge").alias("step"), "id"), "id", "left")
    whole = found.groupBy("edge", "nth").agg(F.sort_array(F.collect_list(F.struct("at", "step"))).alias("steps"), F.count("*").alias("n"), F.count("step").alias("there")).filter("n = there")
    return whole.select("edge", F.concat(F.array("edge"), F.transform("steps", lambda s: s["step"])).alias("run"))
