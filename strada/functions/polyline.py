"""The polyline text format, precision 5: expressions over arrays of {lat, lon}, and plain functions for the edges of the system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISION = 100_000


def _encode():
    """Built here, so that the workers need no module of this package."""

    def run(lines):
        import numpy as np
        import pyarrow as pa

        starts = np.asarray(lines.offsets)
        flat = lines.flatten()  # without the points of null lines
        starts = starts - starts[0]
        whole = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1) if len(flat) else np.zeros((0, 2), dtype=np.int64)
        step = whole.copy()
        step[1:] -= whole[:-1]
        first = starts[:-1][starts[:-1] < starts[1:]]
        step[first] = whole[first]
        v = step.ravel()
        z = ((v << 1) ^ (v >> 63)).view(np.uint64)
        rest = z[:, None] >> (np.arange(13, dtype=np.uint64) * np.uint64(5))
        used = rest > 0
        used[:, 0] = True
        chars = (rest & np.uint64(31)).astype(np.uint8) + np.uint8(63)
        chars[:, :-1][used[:, 1:]] += np.uint8(32)
        ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[2 * starts]
        return pa.Array.from_buffers(pa.large_string(), len(lines), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(chars[used].tobytes())]).cast(pa.string())

    return F.arrow_udf(run, "string")


def encode(points: Column) -> Column:
    """points: array<struct<lat, lon>>; halves are rounded away from zero, points without both coordinates are left out. In time proportional to the line."""
    full = F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    whole = F.transform(full, lambda p: F.struct(F.round(p["lat"] * PRECISION).cast("long").alias("a"), F.round(p["lon"] * PRECISION).cast("long").alias("b")))
    return _encode()(F.coalesce(whole, F.array().cast("array<struct<a:long,b:long>>")))


def _decode(precision: int):
    def run(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        null = np.asarray(pc.is_null(texts))
        raw = pc.fill_null(texts, "").cast(pa.large_binary())
        sizes = np.asarray(pc.binary_length(raw)).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).astype(np.int64) - 63
        ends = codes < 32
        count = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[starts])  # noqa: E731  of each text
        last = np.zeros(len(sizes), dtype=bool)
        last[sizes > 0] = ends[starts[1:][sizes > 0] - 1]
        begin = np.ones(len(codes), dtype=bool)
        begin[1:] = ends[:-1]
        begin[starts[:-1][sizes > 0]] = True
        heads = np.flatnonzero(begin)
        place = np.arange(len(codes)) - heads[np.cumsum(begin) - 1]
        good = ~null & (count((codes < 0) | (codes > 63) | (place > 12)) == 0) & (count(ends) % 2 == 0) & (last | (sizes == 0))
        kept = np.repeat(good, sizes)
        heads = np.flatnonzero(begin[kept])
        z = np.add.reduceat((codes[kept] & 31).astype(np.uint64) << (np.minimum(place[kept], 12) * 5).astype(np.uint64), heads) if len(heads) else np.zeros(0, dtype=np.uint64)
        v = ((z >> np.uint64(1)) ^ -(z & np.uint64(1))).view(np.int64).reshape(-1, 2)
        n = np.where(good, count(ends) // 2, 0)
        at = np.concatenate([[0], np.cumsum(n)])
        sums = np.concatenate([np.zeros((1, 2), dtype=np.int64), np.cumsum(v, axis=0)])
        points = (sums[1:] - np.repeat(sums[at[:-1]], n, axis=0)) / float(precision)
        values = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["lat", "lon"])
        offsets = pa.array([None if bad and k < len(good) else x for k, (x, bad) in enumerate(zip(at.tolist(), [*(~good), False], strict=True))], pa.int32())
        return pa.ListArray.from_arrays(offsets, values)

    return F.arrow_udf(run, "array<struct<lat:double,lon:double>>")


def decode(text: Column) -> Column:
    """array<struct<lat, lon>>; null for a text with a character outside 63..126, an unfinished number or one of over 13 characters. In time proportional to the text."""
    return _decode(PRECISION)(text)


def encode_points(points) -> str:
    out, last = [], (0, 0)
    for lat, lon in points:
        now = tuple(int(abs(x) * PRECISION + 0.5) * (1 if x >= 0 else -1) for x in (lat, lon))
        for new, old in zip(now, last, strict=True):
            v = (new - old) * 2 if new >= old else -(new - old) * 2 - 1
            while v >= 32:
                out.append(chr(v % 32 + 95))
                v //= 32
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def decode_points(text: str) -> list[tuple[float, float]]:
    numbers, v, scale = [], 0, 1
    for c in text:
        k = ord(c) - 63
        if not 0 <= k <= 63:
            raise ValueError(f"not a polyline: {c!r}")
        v += k % 32 * scale
        scale *= 32
        if k < 32:
            numbers.append(-(v + 1) // 2 if v % 2 else v // 2)
            v, scale = 0, 1
    if scale != 1 or len(numbers) % 2:
        raise ValueError("the polyline is cut off")
    out, lat, lon = [], 0, 0
    for a, b in zip(numbers[::2], numbers[1::2], strict=True):
        lat, lon = lat + a, lon + b
        out.append((lat / PRECISION, lon / PRECISION))
    return out
