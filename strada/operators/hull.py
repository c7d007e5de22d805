"""The convex hull of groups of points."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def convex_hull(points) -> list[tuple[float, float]]:
    """The strict hull, closed (its first point again at the end), counter-clockwise from the smallest point.

    Points are parted by the line from the smallest to the largest; the one farthest to the right of a line is a corner, and
    only what lies outside the two new lines is looked at further. None give none; one gives it twice; two, or points on one
    line, give a line and back.
    """
    pts = {(float(x), float(y)) for x, y in points}
    if len(pts) < 3:
        return [*sorted(pts), *sorted(pts)[:1]]
    first, last = min(pts), max(pts)
    ring = [first]
    todo = [(last, first, pts), (first, last, pts)]  # lines still to be bent outwards, the next one on top
    while todo:
        a, b, among = todo.pop()
        dx, dy = b[0] - a[0], b[1] - a[1]
        outside = [(off, (p[0] - a[0]) * dx + (p[1] - a[1]) * dy, p) for p in among if (off := (p[0] - a[0]) * dy - (p[1] - a[1]) * dx) > 0]
        if outside:
            corner, rest = max(outside)[2], [p for _, _, p in outside]
            todo += [(corner, b, rest), (a, corner, rest)]
        else:
            ring.append(b)
    return ring


def hulls(points: DataFrame, keys: list[str], x: str = "lat", y: str = "lon") -> DataFrame:
    """One row per group: keys and ring, array<struct<lat, lon>>. Each batch of rows is cut down to its groups' corners before
    the shuffle, so that a group's task sees corners only, however many points a group has. Null coordinates are left out;
    an empty table gives no rows."""
    fields = [f for f in points.schema if f.name in keys]
    names = [f.name for f in fields]
    own = points.select(*names, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def corners(batches):
        for b in batches:
            groups: dict[tuple, list] = {}
            for *key, p, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                groups.setdefault(tuple(key), []).append((p, q))
            rows = [(*key, p, q) for key, held in groups.items() for p, q in dict.fromkeys(convex_hull(held))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(b.schema)], b.schema.names)

    def run(t: pa.Table) -> pa.Table:
        ring = convex_hull(zip(t["x"].to_pylist(), t["y"].to_pylist(), strict=True))
        return pa.table({**{n: t[n].slice(0, 1) for n in names}, "ring": pa.array([[{"lat": a, "lon": b} for a, b in ring]], pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))})

    return own.mapInArrow(corners, f"{schema}, x double, y double").groupBy(*names).applyInArrow(run, f"{schema}, ring array<struct<lat:double,lon:double>>")
