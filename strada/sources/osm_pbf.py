"""A data source for OSM PBF files: spark.read.format("osm_pbf").option("type", "node" | "way" | "relation").load(path).

The file's blobs are listed once by their headers alone; a partition is a run of blobs, which its task reads by their
offsets, inflates and decodes on its own. Rows: node (id, lat, lon, tags), way (id, node_refs, tags), relation (id, tags,
members). The header must ask for no feature beyond the known ones and must be sorted by type, then id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strada.steps import opened, ship

SCHEMAS = {
    "node": "id long, lat double, lon double, tags map<string,string>",
    "way": "id long, node_refs array<long>, tags map<string,string>",
    "relation": "id long, tags map<string,string>, members array<struct<type:string,id:long,role:string>>",
}
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
SORTED = "Sort.Type_then_ID"
RUN = 4 << 20


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def whole(v: int) -> int:
    """A plain int64, which a varint holds as its two's complement."""
    return v - (1 << 64) if v >= 1 << 63 else v


def deltas(data: bytes) -> list[int]:
    out, last = [], 0
    for v in packed(data):
        last += signed(v)
        out.append(last)
    return out


def one(data: bytes, number: int, default=None):
    return next((v for k, v in fields(data) if k == number), default)


def blob_list(f) -> list[tuple[str, int, int]]:
    """(type, offset, size) of each blob, from the headers only."""
    out = []
    while head := f.read(4):
        n = struct.unpack(">I", head)[0]
        header = f.read(n)
        kind, size = one(header, 1).decode(), one(header, 3)
        out.append((kind, f.tell(), size))
        f.seek(size, 1)
    return out


def inflate(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("only raw and zlib blobs are read")


def check_header(block: bytes) -> None:
    required = {v.decode() for k, v in fields(block) if k == 4}
    optional = {v.decode() for k, v in fields(block) if k == 5}
    if required - FEATURES:
        raise ValueError(f"unknown required features: {sorted(required - FEATURES)}")
    if SORTED not in optional:
        raise ValueError(f"the file must be sorted ({SORTED})")


def rows(block: bytes, kind: str) -> Iterator[tuple]:
    """The rows of one kind in a primitive block."""
    parts = list(fields(block))
    strings = [v.decode() for k, v in fields(next(v for k, v in parts if k == 1)) if k == 1]
    scale = next((v for k, v in parts if k == 17), 100)
    lat0, lon0 = (whole(next((v for k, v in parts if k == n), 0)) for n in (19, 20))
    degrees = lambda v, zero: (zero + scale * v) / 1e9

    def tags(message: dict) -> dict:
        return {strings[a]: strings[b] for a, b in zip(packed(message.get(2, b"")), packed(message.get(3, b"")), strict=True)}

    for group in (v for k, v in parts if k == 2):
        for number, raw in fields(group):
            if number == 1 and kind == "node":
                m = dict(fields(raw))
                yield signed(m[1]), degrees(signed(m[8]), lat0), degrees(signed(m[9]), lon0), tags(m)
            elif number == 2 and kind == "node":
                m = dict(fields(raw))
                flat = iter(packed(m.get(10, b"")))
                for i, y, x in zip(deltas(m[1]), deltas(m[8]), deltas(m[9]), strict=True):
                    t = {}
                    while k := next(flat, 0):
                        t[strings[k]] = strings[next(flat)]
                    yield i, degrees(y, lat0), degrees(x, lon0), t
            elif number == 3 and kind == "way":
                m = dict(fields(raw))
                yield whole(m[1]), deltas(m.get(8, b"")), tags(m)
            elif number == 4 and kind == "relation":
                m = dict(fields(raw))
                names = ("node", "way", "relation")
                yield whole(m[1]), tags(m), [(names[t], i, strings[r]) for r, i, t in zip(packed(m.get(8, b"")), deltas(m.get(9, b"")), packed(m.get(10, b"")), strict=True)]


@dataclass
class Blobs(InputPartition):
    places: list[tuple[int, int]]


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self):
        with opened(self.path) as f:
            blobs = blob_list(f)
            if not blobs or blobs[0][0] != "OSMHeader":
                raise ValueError("the file has no header")
            f.seek(blobs[0][1])
            check_header(inflate(f.read(blobs[0][2])))
        out, size = [Blobs([])], 0
        for kind, at, n in blobs:
            if kind == "OSMData":
                if size > RUN:
                    out.append(Blobs([]))
                    size = 0
                out[-1].places.append((at, n))
                size += n
        return out

    def read(self, partition):
        with opened(self.path) as f:
            for at, n in partition.places:
                f.seek(at)
                yield from rows(inflate(f.read(n)), self.kind)


class OsmPbf(DataSource):
    @classmethod
    def name(cls):
        return "osm_pbf"

    def _kind(self) -> str:
        kind = self.options.get("type", "node")
        if kind not in SCHEMAS:
            raise ValueError(f"type must be one of {sorted(SCHEMAS)}")
        return kind

    def schema(self):
        return SCHEMAS[self._kind()]

    def reader(self, schema):
        return Reader(self.options["path"], self._kind())


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(OsmPbf)


def _put(number: int, value) -> bytes:
    def v(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return v(number << 3) + v(value)
    if isinstance(value, list):
        value = b"".join(v(x) for x in value)
    return v(number << 3 | 2) + v(len(value)) + value


def _zig(v: int) -> int:
    return v << 1 if v >= 0 else (-v << 1) - 1


def _steps(values) -> list[int]:
    return [_zig(b - a) for a, b in zip([0, *values], values, strict=False)]


def encode(nodes=(), ways=(), relations=(), features=("OsmSchema-V0.6", "DenseNodes"), optional=(SORTED,), dense: bool = True) -> bytes:
    """A small file, for fixtures: nodes (id, lat, lon, tags), ways (id, refs, tags), relations (id, tags, members)."""

    def blob(kind: str, block: bytes) -> bytes:
        body = _put(2, len(block)) + _put(3, zlib.compress(block))
        header = _put(1, kind.encode()) + _put(3, len(body))
        return struct.pack(">I", len(header)) + header + body

    out = blob("OSMHeader", b"".join(_put(4, f.encode()) for f in features) + b"".join(_put(5, f.encode()) for f in optional))
    for kind, items in (("node", list(nodes)), ("way", list(ways)), ("relation", list(relations))):
        if not items:
            continue
        strings = [b""]

        def at(s: str) -> int:
            if (b := s.encode()) not in strings:
                strings.append(b)
            return strings.index(b)

        nano = lambda x: round(x * 1e7)
        tagged = lambda t: _put(2, [at(k) for k in t]) + _put(3, [at(x) for x in t.values()])
        if kind == "node" and dense:
            flat = [x for *_, t in items for x in [*(y for k, v in t.items() for y in (at(k), at(v))), 0]]
            group = _put(2, _put(1, _steps([i for i, *_ in items])) + _put(8, _steps([nano(y) for _, y, _, _ in items])) + _put(9, _steps([nano(x) for _, _, x, _ in items])) + _put(10, flat))
        elif kind == "node":
            group = b"".join(_put(1, _put(1, _zig(i)) + tagged(t) + _put(8, _zig(nano(y))) + _put(9, _zig(nano(x)))) for i, y, x, t in items)
        elif kind == "way":
            group = b"".join(_put(3, _put(1, i) + tagged(t) + _put(8, _steps(refs))) for i, refs, t in items)
        else:
            names = ("node", "way", "relation")
            group = b"".join(_put(4, _put(1, i) + tagged(t) + _put(8, [at(r) for _, _, r in ms]) + _put(9, _steps([m for _, m, _ in ms])) + _put(10, [names.index(k) for k, _, _ in ms])) for i, t, ms in items)
        out += blob("OSMData", _put(1, b"".join(_put(1, s) for s in strings)) + _put(2, group))
    return out
