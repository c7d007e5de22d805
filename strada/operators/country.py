"""The country of a point: polygons on a raster, and an exact containment test where the raster doesn't decide.

Each polygon is listed under the cells of its bounds. A cell that no ring touches is decided by its centre; in the others
the point itself is tested by the even-odd rule. Points meet polygons by an equi-join on the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strada.functions import geo

CELL = 0.1


def inside(rings: Column, lat: Column, lon: Column) -> Column:
    """Even-odd over the edges of all rings; rings: array<array<struct<lat, lon>>>, closed."""

    def crossings(ring):
        def edge(k):
            a, b = F.get(ring, k), F.get(ring, k + 1)
            spans = (a["lat"] > lat) != (b["lat"] > lat)
            at = a["lon"] + (lat - a["lat"]) / F.when(spans, b["lat"] - a["lat"]).otherwise(F.lit(1.0)) * (b["lon"] - a["lon"])
            return F.when(spans & (lon < at), 1).otherwise(0)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(ring) - 2), edge), F.lit(0), lambda s, x: s + x)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, x: s + x) % 2 == 1


def _touched(rings: Column, min_lat: Column, min_lon: Column, size: float) -> Column:
    """Does any edge's bounds overlap the cell? (A wider test than crossing it: more cells are tested exactly, none wrongly decided.)"""
    return F.exists(
        rings,
        lambda ring: F.exists(
            F.sequence(F.lit(0), F.size(ring) - 2),
            lambda k: (F.least(F.get(ring, k)["lat"], F.get(ring, k + 1)["lat"]) <= min_lat + size)
            & (F.greatest(F.get(ring, k)["lat"], F.get(ring, k + 1)["lat"]) >= min_lat)
            & (F.least(F.get(ring, k)["lon"], F.get(ring, k + 1)["lon"]) <= min_lon + size)
            & (F.greatest(F.get(ring, k)["lon"], F.get(ring, k + 1)["lon"]) >= min_lon),
        ),
    )


def raster(polygons: DataFrame, size: float = CELL) -> DataFrame:
    """(row, col, country, whole, rings) for the cells of polygons (country, rings) that lie in them or on their border."""
    all_ = F.flatten("rings")
    b = geo.box(F.transform(all_, lambda p: p["lat"]), F.transform(all_, lambda p: p["lon"]))
    lo, hi = geo.cell("b.min_lat", "b.min_lon", size), geo.cell("b.max_lat", "b.max_lon", size)
    cells = polygons.select("country", "rings", b.alias("b")).select("country", "rings", lo.alias("lo"), hi.alias("hi"))
    cells = cells.withColumn("row", F.explode(F.sequence("lo.row", "hi.row"))).withColumn("col", F.explode(F.sequence("lo.col", "hi.col")))
    lat, lon = F.col("row") * size - 90.0, F.col("col") * size - 180.0
    cells = cells.withColumn("border", _touched(F.col("rings"), lat, lon, size)).withColumn("whole", ~F.col("border") & inside(F.col("rings"), lat + size / 2, lon + size / 2))
    return cells.where("border OR whole").select("row", "col", "country", "whole", F.when(F.col("border"), F.col("rings")).alias("rings"))


def countries(points: DataFrame, cells: DataFrame, size: float = CELL) -> DataFrame:
    """points (id, lat, lon) with country, null where no polygon holds them; the first by name where several do."""
    at = points.withColumn("at", geo.cell("lat", "lon", size)).withColumn("row", F.col("at.row")).withColumn("col", F.col("at.col")).drop("at")
    found = at.join(cells, ["row", "col"]).where(F.col("whole") | F.coalesce(inside(F.col("rings"), F.col("lat"), F.col("lon")), F.lit(False)))
    first = found.groupBy("id").agg(F.min("country").alias("country"))
    return points.join(first, "id", "left")


def with_country(edges: DataFrame, cells: DataFrame, size: float = CELL) -> DataFrame:
    """edges with the country of their first point."""
    p = F.get("points", F.lit(0))
    starts = edges.select(F.col("en_id").alias("id"), p["lat"].alias("lat"), p["lon"].alias("lon"))
    return edges.join(countries(starts, cells, size).select(F.col("id").alias("en_id"), "country"), "en_id")


def iso_ids(codes: DataFrame) -> DataFrame:
    """(country, country_id): 1 and up in the order of the codes, 0 stands for none."""
    return codes.select("country").distinct().withColumn("country_id", F.row_number().over(W.orderBy("country")))
