"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pieces of a slice are put in buckets by byte length, one padded matrix a
bucket.  Each round every row merges its leftmost pair of least rank; pair ranks
come from an open-addressed hash table probed for whole columns, the row is
compacted over the gap, and rows without a mergeable pair leave.  Pieces longer
than the widest bucket follow the same rule with a heap, so that one run of a
million letters stays O(n log n).

Defined results: a null or empty text has no ids, and the digests of empty
strings; repeated rows give repeated rows; an empty table gives an empty table;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netspark.llm.arrow_text import slices
from netspark.llm.pretoken import PieceMemory

WIDEST = 256
_NONE = np.int32(0x7FFFFFFF)
_BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, WIDEST)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class RankedPairs:
    """Which two neighbouring ids merge, and into what; looked up by hashing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.names = ranks, {rank: token for token, rank in ranks.items()}
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(ranks[token[:i]], ranks[token[i:]], rank) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.bits = max(10, int(np.ceil(np.log2(max(1, left.size) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int32)
        key = (left << 32) | right
        slot = self._slot(key)
        todo = np.arange(key.size)
        while todo.size:
            free = self.keys[slot[todo]] < 0
            takers = todo[free]
            places, chosen = np.unique(slot[takers], return_index=True)
            takers = takers[chosen]
            self.keys[places], self.values[places] = key[takers], merged[takers]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the largest int where the two do not merge (padding is negative)."""
        out = np.full(left.size, _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left[todo].astype(np.int64) << 32) | right[todo]
        slot = self._slot(key)
        while todo.size:
            held = self.keys[slot]
            hit = held == key
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & (self.keys.size - 1)
        return out

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merge each row of a matrix padded with -1 until no pair is left; result by row."""
        rows, width = ids.shape
        done: list[np.ndarray | None] = [None] * rows
        alive = np.arange(rows)
        rank = np.full(ids.shape, _NONE, np.int32)
        rank[:, :-1] = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1)
        while alive.size:
            at = rank.argmin(axis=1)  # the first of equal ranks is the leftmost
            best = rank[np.arange(alive.size), at]
            over = best == _NONE
            if over.any():
                for i in np.flatnonzero(over).tolist():
                    row = ids[i]
                    done[alive[i]] = row[row >= 0]
                keep = ~over
                alive, ids, rank, at, best = alive[keep], ids[keep], rank[keep], at[keep], best[keep]
                if not alive.size:
                    break
            r = np.arange(alive.size)
            ids[r, at] = best
            column = np.arange(width)
            source = np.minimum(column + (column > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            rank = np.take_along_axis(rank, source, axis=1)
            ids[:, -1], rank[:, -1] = -1, _NONE
            following = ids[r, np.minimum(at + 1, width - 1)]
            rank[r, at] = self.lookup(best, np.where(at + 1 < width, following, -1))
            prior = np.flatnonzero(at > 0)
            rank[prior, at[prior] - 1] = self.lookup(ids[prior, at[prior] - 1], best[prior])
            if width > 4 and (ids[:, width // 2] < 0).all():
                width = width // 2 + 1
                ids, rank = ids[:, :width].copy(), rank[:, :width].copy()
        return done

    def merge_long(self, piece: bytes) -> list[int]:
        """The same rule for one long piece, with a heap of pairs by (rank, place)."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def pair(i: int) -> int | None:
            return self.ranks.get(self.names[ids[i]] + self.names[ids[after[i]]]) if after[i] != -1 else None

        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j == -1 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, None
            after[i] = after[j]
            if after[j] != -1:
                before[after[j]] = i
            for k in (before[i], i):
                if k != -1 and (new := pair(k)) is not None:
                    heapq.heappush(heap, (new, k, ids[k], ids[after[k]]))
        return [x for x in ids if x is not None]

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces and the number of ids of each."""
        raw = [piece.encode("utf-8", "surrogatepass") for piece in pieces]
        out: list = [None] * len(raw)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif len(piece) > WIDEST:
                out[i] = self.merge_long(piece)
            else:
                by_width.setdefault(next(w for w in _BUCKETS if len(piece) <= w), []).append(i)
        for width, members in by_width.items():
            step = max(1, (1 << 18) // width)
            for a in range(0, len(members), step):
                chosen = members[a : a + step]
                sizes = np.fromiter((len(raw[i]) for i in chosen), np.int64, len(chosen))
                matrix = np.full((len(chosen), width), -1, np.int32)
                matrix[np.arange(width) < sizes[:, None]] = self.bytes_to_id[np.frombuffer(b"".join(raw[i] for i in chosen), np.uint8)]
                for i, ids in zip(chosen, self.merge_rows(matrix), strict=True):
                    out[i] = ids
        counts = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.concatenate([np.asarray(x, np.int32) for x in out]) if out else np.zeros(0, np.int32)
        return flat, counts


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.memory = PieceMemory(RankedPairs(ranks).encode_many)
        names = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            names[rank] = token
        self.sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.vocabulary = np.frombuffer(b"".join(names), np.uint8)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the offset of each text's ids."""
        return self.memory.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes the ids stand for."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not ends.size:
            return b""
        place = np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.vocabulary[place].tobytes()


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def encode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded again.

    ``ranks_path`` is a ``.tiktoken`` file present on every executor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        written = [str(i) for i in range(bpe.sizes.size)]
        for rows, texts in slices(batches):
            ids, offsets = bpe.encode(texts)
            words = list(map(written.__getitem__, ids.tolist()))
            cuts = offsets.tolist()
            coded = [hashlib.sha256(" ".join(words[a:b]).encode()).hexdigest() for a, b in zip(cuts, cuts[1:])]
            plain = [hashlib.sha256(bpe.decode(ids[a:b])).hexdigest() for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
