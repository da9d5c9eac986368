"""The single-file binary container of a network: written, read and checked.

The layout is the published one: a 64-byte header, a directory of 64-byte records
and one zstd frame a section.  The magic is the caller's.  Geometry sections are
encoded and compressed in tasks, a tile each; the graph and the properties are one
section each by the layout, so they go through the driver, within the layout's own
bound of 32-bit counts.  Reading decodes every file in a task of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from netspark.functions import geo, values
from netspark.operators.compile import CHANNELS, Network

# Fixed values of the layout.
VERSION, SUPPORTED = (0, 1, 0), (0, 4, 1)
HEADER, RECORD = struct.Struct("<8s6HIQIIQ16s"), struct.Struct("<4sI3IQQQIHBB12s")
LEVEL = 19
TYPES = {"double": 1, "long": 2, "string": 3, "boolean": 4}
SINGLE = (b"GRPH", b"PROP", b"STCH")


# --- bits ---------------------------------------------------------------------


def _table() -> np.ndarray:
    """CRC-32C of every byte, from the reflected polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0x82F63B78), out >> 1)
    return out


_CRC = _table()


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli) of a byte string."""
    lanes, table = 256, _CRC
    held = np.frombuffer(data, np.uint8)
    width = held.size // lanes
    crc = 0xFFFFFFFF
    if width > 64:
        # Lanes side by side, each from zero; then joined by the operator that appends a lane of zeros.
        block = held[: width * lanes].reshape(lanes, width)
        part = np.zeros(lanes, np.uint32)
        for column in block.T:
            part = table[(part ^ column) & 0xFF] ^ (part >> 8)
        shift = _zeros(width)
        for x in part.tolist():
            crc = _apply(shift, crc) ^ x
        held = held[width * lanes :]
    steps = table.tolist()
    for byte in held.tolist():
        crc = steps[(crc ^ byte) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _apply(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _zeros(count: int) -> list[int]:
    """The linear map of a register over ``count`` zero bytes, by its value on each bit."""
    one = [int(_CRC[(1 << i) & 0xFF]) ^ ((1 << i) >> 8) for i in range(32)]
    out = [1 << i for i in range(32)]
    while count:
        if count & 1:
            out = [_apply(one, x) for x in out]
        one = [_apply(one, x) for x in one]
        count >>= 1
    return out


def varints(numbers: list[int]) -> bytes:
    """Unsigned LEB128 of each number."""
    out = bytearray()
    for x in numbers:
        while x > 0x7F:
            out.append(x & 0x7F | 0x80)
            x >>= 7
        out.append(x)
    return bytes(out)


def gaps(ids: list[int]) -> bytes:
    """Ascending ids as the first and the gaps between them."""
    return varints([b - a for a, b in zip([0, *ids], ids)])


def from_gaps(block: bytes, count: int) -> tuple[list[int], int]:
    """``count`` ids, and how many bytes they took; a gap of zero, an overlong or a cut block is an error."""
    out, at, last = [], 0, 0
    for i in range(count):
        value = shift = 0
        while True:
            if at >= len(block):
                raise ValueError("the ids run past their block")
            byte = block[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                break
            if shift > 63:
                raise ValueError("an id of more than 64 bits")
        if i and not value:
            raise ValueError("ids do not ascend")
        last += value
        if last >= 1 << 64:
            raise ValueError("an id of more than 64 bits")
        out.append(last)
    return out, at


def zigzag(x: int) -> int:
    """A signed number as an unsigned one of like size."""
    return x << 1 if x >= 0 else (-x << 1) - 1


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8), bitorder="little").tobytes()


def _strings(texts: list[str]) -> bytes:
    raw = [t.encode() for t in texts]
    return struct.pack("<I", len(raw)) + b"".join(struct.pack("<I", len(r)) + r for r in raw)


# --- writing ------------------------------------------------------------------


def tile_section(edge: np.ndarray, sizes: np.ndarray, xy: np.ndarray) -> bytes:
    """A tile's paths: their edges, how many vertices each has, and all vertices."""
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    heads = np.stack((edge, first, sizes, np.zeros_like(first)), axis=1).astype("<u4").tobytes()
    points = xy.astype("<u2").tobytes()
    at = 32 + len(heads)
    end = at + len(points)
    return struct.pack("<8I", len(edge), int(sizes.sum()), 0, 0, 32, at, end, end) + heads + points


def _tiles(geometry: DataFrame) -> DataFrame:
    """``x, y, payload, stored, refs``: a tile's section, its frame, and the (edge, piece) of each path in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["edge_idx", "piece"])
        sizes = np.array([len(v) for v in frame.vertices], np.int64)
        xy = np.array([(p["qx"], p["qy"]) for v in frame.vertices for p in v], np.int64)
        payload = tile_section(frame.edge_idx.to_numpy(np.int64), sizes, xy)
        refs = np.stack((frame.edge_idx.to_numpy(np.int64), frame.piece.to_numpy(np.int64)), axis=1).astype("<i8").tobytes()
        return pd.DataFrame({"x": [frame.x.iloc[0]], "y": [frame.y.iloc[0]], "payload": [payload], "stored": [_frame(payload)], "refs": [refs]})

    return geometry.groupBy("x", "y").applyInPandas(run, "x int, y int, payload binary, stored binary, refs binary")


def _frame(payload: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(payload)


def graph_section(node_ids: list[int], edges: pd.DataFrame, refs: dict[int, list[tuple[int, int]]]) -> bytes:
    """Ids, topology, adjacency and geometry references; ``edges`` are ``edge_id, src_idx, dst_idx, directed`` in order."""
    n, m = len(node_ids), len(edges)
    src, dst, directed = (edges[c].to_numpy() for c in ("src_idx", "dst_idx", "directed"))
    index = np.arange(m)
    back = ~directed.astype(bool)
    start, edge, sign = np.concatenate((src, dst[back])), np.concatenate((index, index[back])), np.concatenate((np.ones(m, int), -np.ones(int(back.sum()), int)))
    order = np.lexsort((-sign, edge, start))  # of one edge, its own direction first
    offsets = np.concatenate(([0], np.cumsum(np.bincount(start, minlength=n))))
    adjacency = b"".join(struct.pack("<Ib3x", int(e), int(s)) for e, s in zip(edge[order], sign[order], strict=True))
    counts = [len(refs.get(i, ())) for i in range(m)]
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1] if m else np.zeros(0, int)
    listed = b"".join(struct.pack("<IIb3x", tile, path, 1) for i in range(m) for tile, path in refs.get(i, ()))
    nodes = np.stack((np.arange(n), np.zeros(n, int)), axis=1).astype("<u4").tobytes()
    rows = np.stack((src, dst, index, firsts, counts, directed.astype(int)), axis=1).astype("<u4").tobytes() if m else b""
    csr = offsets.astype("<u8").tobytes()
    blocks = [nodes, rows, csr, adjacency, listed, gaps(node_ids), gaps([int(x) for x in edges.edge_id])]
    at = 44 + np.concatenate(([0], np.cumsum([len(b) for b in blocks])))[:-1]
    return struct.pack("<11I", n, m, len(order), sum(counts), *at.tolist()) + b"".join(blocks)


def property_section(nodes: list[dict], edges: list[dict], kinds: tuple[dict[str, str], dict[str, str]]) -> bytes:
    """Typed nullable columns of both kinds of entity; rows are dicts of decoded values."""
    keys = sorted({*kinds[0], *kinds[1]}, key=str.encode)
    texts = sorted({v for rows in (nodes, edges) for r in rows for v in r.values() if isinstance(v, str)}, key=str.encode)
    key_at, text_at = {k: i for i, k in enumerate(keys)}, {t: i for i, t in enumerate(texts)}
    tables = [_strings(keys), _strings(texts), struct.pack("<I", 0)]
    offsets = np.concatenate(([40], 40 + np.cumsum([len(t) for t in tables]))).tolist()
    values_at = offsets[3] + 20 * (len(kinds[0]) + len(kinds[1]))
    columns, bodies = b"", b""
    for number, (rows, own) in enumerate(((nodes, kinds[0]), (edges, kinds[1])), 1):
        for key in sorted(own, key=str.encode):
            held = [r.get(key) for r in rows]
            present = np.array([v is not None for v in held], bool)
            dense = [v for v in held if v is not None]
            bitmap, at = _bits(present), values_at + len(bodies)
            columns += struct.pack("<IBBHIII", key_at[key], number, TYPES[own[key]], 1, len(rows), at, at + len(bitmap))
            body = {"double": lambda: np.array(dense, "<f8").tobytes(), "long": lambda: np.array(dense, "<i8").tobytes(), "string": lambda: np.array([text_at[v] for v in dense], "<u4").tobytes(), "boolean": lambda: _bits(np.array(dense, bool))}[own[key]]()
            bodies += bitmap + body
    head = struct.pack("<10I", len(keys), len(texts), 0, len(kinds[0]), len(kinds[1]), *offsets[:3], offsets[3], offsets[3] + 20 * len(kinds[0]))
    return head + b"".join(tables) + columns + bodies


def channel_section(channels: list) -> bytes:
    """Declarations of state channels; a text that two share is written once."""
    texts: list[str] = []

    def text(value: str) -> int:
        if value not in texts:
            texts.append(value)
        return texts.index(value)

    records = b""
    for c in channels:
        ranged = c["low"] is not None
        name, unit = text(c["name"]), text(c["unit"])
        records += struct.pack("<HBBIIffI", c["channel_id"], 1 if c["entity_kind"] == "node" else 2, 1, name, unit, c["low"] or 0.0, c["high"] or 0.0, ranged | (2 if c["interpolated"] else 0))
    table = _strings(texts)
    return struct.pack("<III", len(channels), 12, 12 + len(table)) + table + records


def extra_section(owner: str, media_type: str, payload: bytes) -> bytes:
    a, b = owner.encode(), media_type.encode()
    return struct.pack("<7I", 28, len(a), 28 + len(a), len(b), 28 + len(a) + len(b), len(payload), 0) + a + b + payload


def write(network: Network, magic: bytes) -> bytes:
    """The bytes of a container; the same network gives the same bytes."""
    tiles = sorted(_tiles(network.geometry).collect(), key=lambda r: (r["x"], r["y"]))
    refs: dict[int, list[tuple[int, int, int]]] = {}
    for number, tile in enumerate(tiles):
        for path, (edge, piece) in enumerate(np.frombuffer(tile["refs"], "<i8").reshape(-1, 2).tolist()):
            refs.setdefault(edge, []).append((piece, number, path))
    ordered = {e: [(t, p) for _, t, p in sorted(r)] for e, r in refs.items()}
    nodes, edges = network.nodes.orderBy("node_idx"), network.edges.orderBy("edge_idx")
    graph = edges.select(F.col("edge_id").cast("string").alias("edge_id"), "src_idx", "dst_idx", "directed").toPandas()
    kinds = tuple(values.column_kinds(values.long_properties(r.withColumn("idx", F.lit(0)), "idx")) for r in (nodes, edges))
    rows = []
    for table, key, own in ((nodes, "node_idx", kinds[0]), (edges, "edge_idx", kinds[1])):
        wide = values.wide(table.select(key, "properties"), keys=own).orderBy(key).drop(key)
        rows.append([{c: v for c, v in r.asDict().items() if v is not None} for r in wide.collect()] if own else [{}] * table.count())
    payloads = [(b"GEOM", 1, (geo.ZOOM, t["x"], t["y"]), bytes(t["payload"]), bytes(t["stored"])) for t in tiles]
    ids = [int(r["i"]) for r in nodes.select("node_idx", F.col("node_id").cast("string").alias("i")).collect()]
    own = [(b"GRPH", graph_section(ids, graph, ordered)), (b"PROP", property_section(*rows, kinds)), (b"STCH", channel_section([] if network.channels is None else network.channels.orderBy("channel_id").collect()))]
    payloads += [(kind, 1, (0, 0, 0), payload, _frame(payload)) for kind, payload in own]
    for e in [] if network.extras is None else sorted(network.extras.collect()):
        payload = extra_section(e["owner"], e["media_type"], bytes(e["payload"]))
        payloads.append((b"XTRA", 0, (0, 0, 0), payload, _frame(payload)))
    uuid = hashlib.sha256(b"".join(p[3] for p in payloads)).digest()[:16]
    offset, records = 64 + 64 * len(payloads), b""
    for kind, flags, key, payload, stored in payloads:
        records += RECORD.pack(kind, flags, *key, offset, len(stored), len(payload), crc32c(payload), 1, 0, 0, b"")
        offset += len(stored)
    return HEADER.pack(magic, *VERSION, *VERSION, 64, 64, len(payloads), 0, offset, uuid) + records + b"".join(p[4] for p in payloads)


# --- reading ------------------------------------------------------------------


@dataclass
class Section:
    kind: bytes
    flags: int
    key: tuple[int, int, int]
    payload: bytes


def read_sections(data: bytes, magic: bytes) -> list[Section]:
    """Every section, decoded and checked."""
    if len(data) < 64:
        raise ValueError("shorter than its header")
    found, a, b, c, *least, size, at, count, _, total, uuid = HEADER.unpack_from(data)
    if found != magic:
        raise ValueError("another magic")
    if tuple(least) > SUPPORTED:
        raise ValueError(f"needs a reader of version {'.'.join(map(str, least))}")
    if size != 64 or total != len(data):
        raise ValueError("header or file of another length")
    if at + 64 * count > len(data):
        raise ValueError("the directory runs past the file")
    out, seen = [], set()
    for i in range(count):
        kind, flags, x, y, z, offset, stored, plain, crc, codec, _, _, _ = RECORD.unpack_from(data, at + 64 * i)
        if kind not in (b"GEOM", b"XTRA", *SINGLE):
            if flags & 1:
                raise ValueError(f"unknown required section {kind!r}")
            continue
        if codec != 1 or offset + stored > len(data):
            raise ValueError(f"{kind.decode()} of another codec or past the file")
        if kind == b"XTRA" and (flags & 1 or (x, y, z) != (0, 0, 0)):
            raise ValueError("an extra that is required or has a key")
        name = (kind, x, y, z) if kind == b"GEOM" else (kind,)
        if kind != b"XTRA" and name in seen:
            raise ValueError(f"two sections {kind.decode()} of one key")
        seen.add(name)
        raw = data[offset : offset + stored]
        try:
            if zstandard.frame_content_size(raw) != plain:
                raise ValueError(f"{kind.decode()} of another decoded length")
            payload = zstandard.ZstdDecompressor().decompress(raw, max_output_size=plain)
        except zstandard.ZstdError as error:
            raise ValueError(f"{kind.decode()} is no zstd frame") from error
        if len(payload) != plain or crc32c(payload) != crc:
            raise ValueError(f"{kind.decode()} of another checksum")
        out.append(Section(kind, flags, (x, y, z), payload))
    if any((k,) not in seen for k in SINGLE):
        raise ValueError("a section is missing")
    if hashlib.sha256(b"".join(s.payload for s in out)).digest()[:16] != uuid:
        raise ValueError("another file identity")
    return out


def _u32(payload: bytes, at: int, count: int = 1) -> list[int]:
    if at < 0 or at + 4 * count > len(payload):
        raise ValueError("a field runs past its section")
    return list(struct.unpack_from(f"<{count}I", payload, at))


def read_tile(payload: bytes) -> list[tuple[int, list[tuple[int, int]]]]:
    """Each path's edge and vertices."""
    paths, vertices, mesh, indices, paths_at, vertices_at, *_ = _u32(payload, 0, 8)
    if indices % 3 or (not mesh and indices):
        raise ValueError("a mesh of no triangles")
    out = []
    for i in range(paths):
        edge, first, count, _ = _u32(payload, paths_at + 16 * i, 4)
        start = vertices_at + 4 * first
        if count < 2 or first + count > vertices or start + 4 * count > len(payload):
            raise ValueError("a path runs past its vertices")
        out.append((edge, [tuple(p) for p in np.frombuffer(payload, "<u2", 2 * count, start).reshape(-1, 2).tolist()]))
    return out


def read_graph(payload: bytes) -> tuple[list[int], list[tuple], list[tuple[int, int]], list[int], list[tuple[int, int, int]]]:
    """Node ids, edges ``(id, source, target, row, first ref, refs, directed)``, adjacency, its offsets, references."""
    n, m, arcs, refs, _, edges_at, csr_at, arcs_at, refs_at, node_ids_at, edge_ids_at = _u32(payload, 0, 11)
    node_ids, _ = from_gaps(payload[node_ids_at:edge_ids_at], n)
    edge_ids, _ = from_gaps(payload[edge_ids_at:], m)
    if csr_at + 8 * (n + 1) > len(payload) or arcs_at + 8 * arcs > len(payload) or refs_at + 12 * refs > len(payload):
        raise ValueError("the graph runs past its section")
    offsets = list(struct.unpack_from(f"<{n + 1}Q", payload, csr_at))
    if offsets[0] or offsets[-1] != arcs or any(a > b for a, b in zip(offsets, offsets[1:])):
        raise ValueError("adjacency offsets do not ascend to their count")
    edges = []
    for i, name in enumerate(edge_ids):
        a, b, row, first, count, flags = _u32(payload, edges_at + 24 * i, 6)
        if a >= n or b >= n or first + count > refs:
            raise ValueError("an edge names a node or reference that is not there")
        edges.append((name, a, b, row, first, count, bool(flags & 1)))
    adjacency = [struct.unpack_from("<Ib", payload, arcs_at + 8 * i) for i in range(arcs)]
    if any(e >= m or s not in (1, -1) for e, s in adjacency):
        raise ValueError("an arc names an edge that is not there")
    return node_ids, edges, adjacency, offsets, [struct.unpack_from("<IIb", payload, refs_at + 12 * i) for i in range(refs)]


def _read_strings(payload: bytes, at: int) -> list[str]:
    (count,) = _u32(payload, at)
    out, at = [], at + 4
    for _ in range(count):
        (size,) = _u32(payload, at)
        if at + 4 + size > len(payload):
            raise ValueError("a text runs past its section")
        out.append(payload[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return out


def read_properties(payload: bytes) -> tuple[list[dict], list[dict]]:
    """Rows of decoded values of nodes and edges; absent values have no key."""
    _, _, _, nodes, edges, keys_at, texts_at, enums_at, nodes_at, edges_at = _u32(payload, 0, 10)
    keys, texts, enums = (_read_strings(payload, at) for at in (keys_at, texts_at, enums_at))
    out: tuple[list[dict], list[dict]] = ([], [])
    for number, (start, count) in enumerate(((nodes_at, nodes), (edges_at, edges))):
        for i in range(count):
            at = start + 20 * i
            key, _, entities, bitmap_at, values_at = _u32(payload, at, 5)
            kind = payload[at + 5]
            rows = out[number]
            rows.extend({} for _ in range(entities - len(rows)))
            raw = payload[bitmap_at : bitmap_at + -(-entities // 8)]
            if len(raw) * 8 < entities or key >= len(keys):
                raise ValueError("a column runs past its section")
            there = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:entities]).tolist()
            size = {1: 8, 2: 8, 3: 4, 5: 4}.get(kind)
            if kind not in (1, 2, 3, 4, 5) or values_at + (size * len(there) if size else -(-len(there) // 8)) > len(payload):
                raise ValueError("a column of an unknown type, or past its section")
            if kind == 4:
                held = np.unpackbits(np.frombuffer(payload, np.uint8, -(-len(there) // 8), values_at), bitorder="little").astype(bool).tolist()
            else:
                held = np.frombuffer(payload, {1: "<f8", 2: "<i8"}.get(kind, "<u4"), len(there), values_at).tolist()
            if kind in (3, 5):
                held = [(texts if kind == 3 else enums)[v] for v in held]
            if kind == 1 and not np.isfinite(held).all():
                raise ValueError("a number that is not finite")
            for entity, value in zip(there, held):
                rows[entity][keys[key]] = value
    return out


def read_channels(payload: bytes) -> list[tuple]:
    """Rows of ``CHANNELS``."""
    count, texts_at, at = _u32(payload, 0, 3)
    texts, out = _read_strings(payload, texts_at), []
    for i in range(count):
        if at + 24 * (i + 1) > len(payload):
            raise ValueError("a channel runs past its section")
        number, kind, _, name, unit, low, high, flags = struct.unpack_from("<HBBIIffI", payload, at + 24 * i)
        out.append((number, texts[name], "node" if kind == 1 else "edge", texts[unit], low if flags & 1 else None, high if flags & 1 else None, bool(flags & 2)))
    return out


def read_extra(payload: bytes) -> tuple[str, str, bytes]:
    a, n, b, m, c, k, _ = _u32(payload, 0, 7)
    if max(a + n, b + m, c + k) > len(payload):
        raise ValueError("an extra runs past its section")
    return payload[a : a + n].decode(), payload[b : b + m].decode(), payload[c : c + k]


def _text(row: dict) -> str:
    """A row's values as JSON texts, in one JSON object."""
    import json

    return json.dumps({k: json.dumps(v, ensure_ascii=False) for k, v in row.items()}, ensure_ascii=False)


def read(spark: SparkSession, path: str, magic: bytes) -> Network:
    """The network in a container file; what the layout forbids is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _network(files, magic)


def _network(files: DataFrame, magic: bytes) -> Network:
    from netspark.plans.workspace import materialise

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                yield pd.DataFrame(_rows(bytes(content), magic), columns=["part", "a", "b", "c", "d", "flag", "text", "more", "low", "high", "points", "payload"])

    schema = "part string, a decimal(20,0), b long, c long, d long, flag boolean, text string, more string, low double, high double, points array<struct<qx:int,qy:int>>, payload binary"
    rows = materialise(files.mapInPandas(run, schema), "container")
    texts = F.coalesce(F.from_json("text", "map<string,string>"), F.create_map().cast("map<string,string>"))
    nodes = rows.filter("part = 'node'").select(F.col("b").cast("int").alias("node_idx"), F.col("a").alias("node_id"), F.col("low").alias("lon"), F.col("high").alias("lat"), texts.alias("properties"))
    edges = rows.filter("part = 'edge'").select(F.col("b").cast("int").alias("edge_idx"), F.col("a").alias("edge_id"), F.col("c").cast("int").alias("src_idx"), F.col("d").cast("int").alias("dst_idx"), F.col("flag").alias("directed"), F.lit(None).cast("string").alias("name"), texts.alias("properties"))
    pieces = rows.filter("part = 'piece'").select(F.col("b").cast("int").alias("edge_idx"), F.col("c").cast("int").alias("piece"), F.lit(geo.ZOOM).alias("z"), F.col("a").cast("int").alias("x"), F.col("d").cast("int").alias("y"), F.col("points").alias("vertices"))
    channels = rows.filter("part = 'channel'").select(F.col("b").cast("int").alias("channel_id"), F.col("text").alias("name"), F.when(F.col("c") == 1, "node").otherwise("edge").alias("entity_kind"), F.col("more").alias("unit"), F.col("low").cast("float").alias("low"), F.col("high").cast("float").alias("high"), F.col("flag").alias("interpolated"))
    extras = rows.filter("part = 'extra'").select(F.col("text").alias("owner"), F.col("more").alias("media_type"), "payload")
    return Network(nodes, edges, pieces, channels, extras)


def _rows(data: bytes, magic: bytes) -> list[tuple]:
    from decimal import Decimal

    sections = read_sections(data, magic)
    one = {s.kind: s.payload for s in sections if s.kind in SINGLE}
    node_ids, edges, _, _, refs = read_graph(one[b"GRPH"])
    node_rows, edge_rows = read_properties(one[b"PROP"])
    tiles = {i: (s.key, read_tile(s.payload)) for i, s in enumerate(sections) if s.kind == b"GEOM"}
    out: list[tuple] = []
    ends: dict[int, tuple[float, float]] = {}
    for i, (name, a, b, row, first, count, directed) in enumerate(edges):
        out.append(("edge", Decimal(name), i, a, b, directed, _text(edge_rows[row]) if row < len(edge_rows) else "{}", None, None, None, None, None))
        line: list[tuple[float, float]] = []
        for piece, (section, path, sign) in enumerate(refs[first : first + count]):
            if section not in tiles or path >= len(tiles[section][1]) or tiles[section][1][path][0] != i:
                raise ValueError("an edge names geometry that is not its own")
            (_, x, y), points = tiles[section][0], tiles[section][1][path][1]
            points = points[::-1] if sign < 0 else points
            out.append(("piece", Decimal(x), i, piece, y, None, None, None, None, None, [{"qx": qx, "qy": qy} for qx, qy in points], None))
            line += [((x + qx / geo.EXTENT) / geo.TILES, (y + qy / geo.EXTENT) / geo.TILES) for qx, qy in points]
        if not line:
            raise ValueError("an edge without geometry")
        ends[a], ends[b] = line[0], line[-1]
    for i, name in enumerate(node_ids):
        x, y = ends.get(i, (None, None))
        lon = None if x is None else x * 360 - 180
        lat = None if y is None else float(np.degrees(2 * np.arctan(np.exp(np.pi * (1 - 2 * y))) - np.pi / 2))
        out.append(("node", Decimal(name), i, None, None, None, _text(node_rows[i]) if i < len(node_rows) else "{}", None, lon, lat, None, None))
    for number, name, kind, unit, low, high, soft in read_channels(one[b"STCH"]):
        out.append(("channel", None, number, 1 if kind == "node" else 2, None, soft, name, unit, low, high, None, None))
    seen = set()
    for s in sections:
        if s.kind == b"XTRA":
            owner, media, payload = read_extra(s.payload)
            if (owner, media) in seen:
                raise ValueError("two extras of one owner and media type")
            seen.add((owner, media))
            out.append(("extra", None, None, None, None, None, owner, media, None, None, None, payload))
    return out


def shares(data: bytes, magic: bytes) -> dict[str, int]:
    """Stored bytes of each kind of section."""
    read_sections(data, magic)
    out: dict[str, int] = {}
    at, count = struct.unpack_from("<QI", data, 0x18)
    for i in range(count):
        kind, *_, stored, _, _, _, _, _, _ = RECORD.unpack_from(data, at + 64 * i)
        out[kind.decode()] = out.get(kind.decode(), 0) + stored
    return out
