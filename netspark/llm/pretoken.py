"""Vectorised pre-tokenisation and a bounded memory of encoded pieces.

``public_tokenizers.PATTERN`` splits a text at changes of character class
(letter, number, white space, other), lets one blank join the run after it, and
cuts English contractions off an apostrophe.  All of that is decided here with
array operations over code points, so a slice of documents is split at once; the
tests hold it against the ``regex`` module.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_BLANK, _QUOTE = 0x20, 0x27
_WEIGHED = 64
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 0x110000, dtype=np.uint64)
_POWERS: list[np.ndarray] = []
_CLASSES: list[np.ndarray] = []
#: Single documents above this are cut at places where a piece must start.
LONG_TEXT = 1 << 18


def classes() -> np.ndarray:
    """Character class of every code point, by the ``regex`` module's properties."""
    if not _CLASSES:
        import regex

        table = np.zeros(0x110000, np.uint8)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        places = np.asarray(points)
        for pattern, mark in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for found in regex.finditer(pattern, every):
                table[places[found.start() : found.end()]] = mark
        _CLASSES.append(table)
    return _CLASSES[0]


def split(joined: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``joined`` and the piece starts; documents have ``sizes`` code points."""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = cp.size
    if not n:
        return cp, np.zeros(0, np.int64)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    first[edges] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= first
    run = start.copy()
    # The last white space before a visible run: it starts a piece, and a blank takes the run along.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == _BLANK]] = False
    quote = np.flatnonzero((cp[: n - 1] == _QUOTE) & start[: n - 1] & run[1:n] & (kind[1:] == LETTER) & ~first[1:n])
    if quote.size:
        a = cp[quote + 1]
        b = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        b = np.where(first[np.minimum(quote + 2, n)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    return cp, np.flatnonzero(start[:n])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``n`` of each at least."""
    if not _POWERS or _POWERS[0].size < n:
        base, size = 0x9E3779B97F4A7C15, max(n, LONG_TEXT)
        _POWERS[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1]


def _keys(joined: str, cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key for each piece: a polynomial over random code point values, or XXH3 of pieces over 64 code points."""
    power, inverse = _powers(cp.size)
    sums = np.empty(cp.size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[cp] * power, out=sums[1:])
    stops = np.append(starts[1:], cp.size)
    sizes = stops - starts
    keys = (sums[stops] - sums[starts]) * inverse[starts]
    keys ^= keys >> np.uint64(31)
    keys += sizes.astype(np.uint64)
    long = np.flatnonzero(sizes > _WEIGHED)
    if long.size:
        import xxhash

        for i in long.tolist():
            piece = joined[starts[i] : starts[i] + sizes[i]]
            keys[i] = xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"))
    return keys


def safe_cuts(text: str, limit: int = LONG_TEXT) -> list[str]:
    """Cut a very long text before single blanks between visible characters; a piece starts there anyway."""
    parts, at = [], 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while cut != -1 and cut + 1 < len(text) and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1 or cut + 1 >= len(text):
            break
        parts.append(text[at:cut])
        at = cut
    parts.append(text[at:])
    return parts


class PieceMemory:
    """Token ids of texts, encoding each distinct piece once.

    ``encode_many`` maps distinct pieces to ``(flat ids, ids per piece)``.  At
    most ``limit`` pieces are remembered; beyond that the memory starts anew.
    Pieces are found by a 64-bit key and then compared by all their code points.
    """

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 18):
        self.encode_many, self.limit = encode_many, limit
        self._forget()

    def _forget(self) -> None:
        # Open addressing at most half full: a free place has slot -1.
        self.bits = 12
        self._table(self.bits)
        self.known = np.zeros(0, np.uint64)
        self.offsets = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.points, self.point_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _table(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.full(1 << bits, -1, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        place = self._place(keys)
        out = self.slots[place]
        todo = np.flatnonzero((out >= 0) & (self.keys[place] != keys))
        place, mask = place[todo], (1 << self.bits) - 1
        while todo.size:
            place = (place + 1) & mask
            wanted = keys[todo]
            found = self.slots[place]
            out[todo] = found
            on = (found >= 0) & (self.keys[place] != wanted)
            todo, place = todo[on], place[on]
        return out

    def _insert(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """Add distinct keys that are not there."""
        place, mask = self._place(keys), (1 << self.bits) - 1
        todo = np.arange(keys.size)
        while todo.size:
            free = np.flatnonzero(self.slots[place[todo]] < 0)
            where, first = np.unique(place[todo[free]], return_index=True)
            takers = todo[free[first]]
            self.keys[where], self.slots[where] = keys[takers], slots[takers]
            todo = todo[self.slots[place[todo]] != slots[todo]]
            place[todo] = (place[todo] + 1) & mask

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        flat, counts = self.encode_many(pieces)
        base = self.known.size
        self.known = np.concatenate((self.known, keys))
        if 2 * self.known.size > self.slots.size:
            self._table(int(np.ceil(np.log2(4 * self.known.size))))
            self._insert(self.known, np.arange(self.known.size, dtype=np.int32))
        else:
            self._insert(keys, np.arange(base, self.known.size, dtype=np.int32))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(counts)))
        self.flat = np.concatenate((self.flat, flat))
        self.points = np.concatenate((self.points, np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)))
        self.point_ends = np.concatenate((self.point_ends, self.point_ends[-1] + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))

    def _are(self, slots: np.ndarray, cp: np.ndarray, starts: np.ndarray) -> bool:
        """Whether the pieces that begin at ``starts`` are those remembered in ``slots``."""
        sizes = np.diff(np.append(starts, cp.size))
        if (self.point_ends[slots + 1] - self.point_ends[slots] != sizes).any():
            return False
        return bool((self.points[np.repeat(self.point_ends[slots] - starts, sizes) + np.arange(cp.size)] == cp).all())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offset of each text's ids (one more than texts)."""
        parts: list[str] = []
        owners = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                parts += [text] if len(text) <= LONG_TEXT else safe_cuts(text)
            owners[i + 1] = len(parts)
        got, ends, group, held = [], [0], [], 0
        for part in [*parts, None]:
            if group and (part is None or held + len(part) > LONG_TEXT):
                ids, counts = self._encode_group(group)
                got.append(ids)
                ends.extend((ends[-1] + np.cumsum(counts)).tolist())
                group, held = [], 0
            if part is not None:
                group.append(part)
                held += len(part)
        flat = np.concatenate(got) if got else np.zeros(0, np.int32)
        return flat, np.asarray(ends, np.int64)[owners]

    def _encode_group(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        cp, starts = split(joined, sizes)
        keys = _keys(joined, cp, starts)
        if self.known.size > self.limit:
            self._forget()
        slots = self._find(keys)
        missing = np.flatnonzero(slots < 0)
        if missing.size:
            new, at = np.unique(keys[missing], return_index=True)
            where = missing[at]
            stops = np.append(starts, cp.size)[where + 1]
            self._learn(new, [joined[a:b] for a, b in zip(starts[where].tolist(), stops.tolist(), strict=True)])
            slots[missing] = self._find(keys[missing])
        if self._are(slots, cp, starts):
            begin = self.offsets[slots]
            counts = self.offsets[slots + 1] - begin
            ends = np.cumsum(counts)
            found = self.flat[np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1])]
        else:  # two pieces have one key
            found, counts = self.encode_many([joined[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), cp.size], strict=True)])
            ends = np.cumsum(counts)
        edges = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
        by_piece = np.concatenate(([0], ends))
        return found, np.diff(by_piece[edges])
