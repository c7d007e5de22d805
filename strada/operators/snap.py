"""The nearest-neighbour join of locations to segments, as an equi-join on cells.

Segments are listed under each cell that their bounds touch, locations under each cell of their radius' bounds; cells wrap
at the antimeridian. What meets is an id with its bounds: a segment whose bounds are farther than the radius, or than the
first point of another segment, goes before any line is fetched. The few that stay are measured exactly, and the nearest
are kept with all their ties. The bounds searched are widened by the latitude, so that no segment within the radius is missed.

Cases. A location without a segment within its radius has no row; a null coordinate reaches nothing; repeated locations
count once; of equal distances, in whole millimetres, all stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strada.functions import geo

CELL, METRES_PER_DEGREE, RADIUS = 0.01, 111_194.0, 1000.0


def _cells(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, size: float) -> Column:
    """Every cell that a box touches, as one long each."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    around = round(360.0 / size)  # a location at 180 meets a segment at -180
    return F.array_distinct(F.flatten(F.transform(span(min_lat, max_lat), lambda y: F.transform(span(min_lon, max_lon), lambda x: y * 100_000_000 + F.pmod(x, F.lit(around))))))


def cell_index(edges: DataFrame, size: float = CELL) -> DataFrame:
    """(cell, en_id, b, p) for each cell that a segment's bounds b touch; p is its first point."""
    b = geo.box(F.transform("points", lambda p: p["lat"]), F.transform("points", lambda p: p["lon"]))
    out = edges.select("en_id", b.alias("b"), F.get("points", F.lit(0)).alias("p"))
    return out.select(F.explode(_cells(F.col("b.min_lat"), F.col("b.min_lon"), F.col("b.max_lat"), F.col("b.max_lon"), size)).alias("cell"), "en_id", "b", "p")


def near_cells(locations: DataFrame, size: float = CELL) -> DataFrame:
    """locations (loc, lat, lon, radius_m) with each cell that their radius reaches."""
    dy = F.col("radius_m") / METRES_PER_DEGREE * 1.001
    dx = dy / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.9), F.abs("lat") + dy))))
    return locations.withColumn("cell", F.explode(_cells(F.col("lat") - dy, F.col("lon") - dx, F.col("lat") + dy, F.col("lon") + dx, size)))


def snap(locations: DataFrame, edges: DataFrame, size: float = CELL, most_m: float = RADIUS) -> DataFrame:
    """(loc, en_id, distance_m, lat, lon, fraction) of the segments nearest to each location within its radius, all ties.

    locations: (loc, lat, lon) and, if it has one, radius_m, which most_m caps. Distances are compared in millimetres, so
    both directions of a road tie. edges: only what the profile may use, so that the access filter lies below the join.
    """
    radius = F.least(F.coalesce(F.col("radius_m").cast("double"), F.lit(most_m)), F.lit(most_m)) if "radius_m" in locations.columns else F.lit(most_m)
    asked = near_cells(locations.select("loc", "lat", "lon", radius.alias("radius_m")), size)
    met = asked.join(cell_index(edges, size), "cell")
    least = geo.distance_to_box_m("lat", "lon", "b.min_lat", "b.min_lon", "b.max_lat", "b.max_lon") * 0.999 - 0.01
    around = F.abs(F.col("lon") - F.col("p.lon")) > 180  # bounds across the antimeridian tell nothing
    met = met.withColumn("least", F.when(around, 0.0).otherwise(least)).where("least <= radius_m")
    met = met.groupBy("loc", "lat", "lon", "radius_m", "en_id").agg(F.min("least").alias("least"), F.min(geo.haversine_m("lat", "lon", F.col("p.lat"), F.col("p.lon"))).alias("most"))
    near = met.withColumn("nearest", F.min("most").over(W.partitionBy("loc"))).where("least <= nearest + 0.01").select("loc", "lat", "lon", "radius_m", "en_id")
    pair = lambda k: F.struct(F.get("points", k).alias("a"), F.get("points", k + 1).alias("b"))
    lines = near.join(edges.select("en_id", "points"), "en_id").select("loc", "lat", "lon", "radius_m", "en_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("points") - 2), pair)).alias("k", "p"))
    turned = lambda x: x + F.round((F.col("lon") - x) / 360.0) * 360.0  # noqa: E731  across the antimeridian
    pieces = lines.select("loc", "lat", "lon", "radius_m", "en_id", "k", F.col("p.a.lat").alias("a"), turned(F.col("p.a.lon")).alias("b"), F.col("p.b.lat").alias("c"), turned(F.col("p.b.lon")).alias("d"))
    pieces = pieces.withColumn("t", geo.project("lat", "lon", "a", "b", "c", "d")).withColumn("long", geo.haversine_m("a", "b", "c", "d"))
    pieces = pieces.withColumn("y", F.col("a") + (F.col("c") - F.col("a")) * F.col("t")).withColumn("x", F.col("b") + (F.col("d") - F.col("b")) * F.col("t"))
    pieces = pieces.withColumn("off", F.round(geo.haversine_m("lat", "lon", "y", "x"), 3))
    ahead = W.partitionBy("loc", "en_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("long").over(ahead), F.lit(0.0)))
    found = pieces.groupBy("loc", "en_id").agg(F.min(F.struct("off", "k", "t", "y", "x", "before", "long")).alias("at"), F.sum("long").alias("total"), F.first("radius_m").alias("radius_m")).where("at.off <= radius_m")
    best = found.withColumn("r", F.rank().over(W.partitionBy("loc").orderBy("at.off"))).where("r = 1")
    lon = F.col("at.x") - F.when(F.col("at.x") > 180, 360.0).when(F.col("at.x") < -180, -360.0).otherwise(0.0)
    along = F.when(F.col("total") > 0, F.least(F.lit(1.0), (F.col("at.before") + F.col("at.long") * F.col("at.t")) / F.col("total"))).otherwise(F.lit(0.0))
    return best.select("loc", "en_id", F.col("at.off").alias("distance_m"), F.col("at.y").alias("lat"), lon.alias("lon"), along.alias("fraction"))


def nearest_points(locations: DataFrame, points: DataFrame, radius_m: float, size: float = CELL) -> DataFrame:
    """(loc, id, distance_m): the same join to points (id, lat, lon)."""
    place = lambda c, x: F.floor(F.col(x) / size).cast("long")
    listed = points.select((place(points, "lat") * 100_000_000 + F.pmod(place(points, "lon"), F.lit(round(360.0 / size)))).alias("cell"), "id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    pairs = near_cells(locations.select("loc", "lat", "lon", F.lit(radius_m).alias("radius_m")), size).join(listed, "cell")
    found = pairs.withColumn("distance_m", F.round(geo.haversine_m("lat", "lon", "p_lat", "p_lon"), 3)).where("distance_m <= radius_m")
    return found.withColumn("r", F.rank().over(W.partitionBy("loc").orderBy("distance_m"))).where("r = 1").select("loc", "id", "distance_m")
