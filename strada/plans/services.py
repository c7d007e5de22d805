"""The six kinds of query over a network: info, locate, route, inspect, matrix and isochrone.

A position on a segment is a fraction of its length, in its direction of travel. A path from a snap S to a snap G costs
what remains of S, each turn with the whole of the segment it leads to, the turn into G, and the part of G up to the snap;
on the same segment, with G ahead, the part between. Lengths are metres truncated, times follow from them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strada.functions import geo, polyline
from strada.functions import tags as T
from strada.operators import cost, hull, search, snap
from strada.steps import materialize, work_dir

VERSION = "0.1.0"


# fixed values: the kinds of manoeuvre that a leg may list, and their directions; none is made yet
MANEUVERS = ("Start", "Destination", "Continue", "Turn", "SlightTurn", "SharpTurn", "UTurn", "Ramp", "Exit", "Stay", "Merge", "RoundaboutEnter", "RoundaboutExit", "FerryEnter", "FerryExit")
DIRECTIONS = ("Straight", "Left", "Right")


class InvalidRequest(ValueError):
    status = 400


class LocationNotFound(LookupError):
    status = 404


class NoRoute(LookupError):
    status = 404


def problem(error: Exception) -> dict:
    """An error as a problem document."""
    return {"type": "about:blank", "title": type(error).__name__, "status": getattr(error, "status", 500), "detail": str(error)}


@dataclass
class Network:
    """edges: network.edge_nodes(); turns: network.turns(); ways: one row per way and direction."""

    edges: DataFrame
    turns: DataFrame
    ways: DataFrame
    overrides: DataFrame | None = None
    max_radius_m: float = snap.RADIUS

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession


@dataclass(frozen=True)
class Options:
    profile: str | None = None
    model: str = "time"
    avoid_toll: bool = False
    avoid_ferry: bool = False
    radius_m: float = snap.RADIUS
    backend: str | None = None
    algorithm: str | None = None


def info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Ok", VERSION, list(cost.PROFILES))], "status string, version string, profiles array<string>")


def _usable(net: Network, o: Options) -> DataFrame:
    return cost.costed(net.edges, cost.profile(o.profile), o.model, o.avoid_toll, net.overrides)


def _part(p: cost.Profile, o: Options, metres):
    """The cost of so many metres of a segment (speed, toll)."""
    if o.model == "distance":
        return metres
    return cost.segment_time_ms(p, metres, F.col("speed"), F.col("toll"))


def snapped(net: Network, locations: DataFrame, o: Options) -> DataFrame:
    """snap.snap() with ahead_m and behind_m of the segment, and their costs. Locations at the same point are snapped once."""
    p, usable = cost.profile(o.profile), _usable(net, o)
    point = F.struct(*[c for c in ("lat", "lon", "radius_m") if c in locations.columns])
    points = locations.groupBy("loc").agg(F.array_sort(F.collect_set(point)).alias("at")).groupBy("at").agg(F.min("loc").alias("first"), F.collect_list("loc").alias("locs"))
    out = snap.snap(points.select(F.col("first").alias("loc"), F.inline("at")), usable, most_m=o.radius_m).withColumnRenamed("loc", "first")
    out = out.join(points.select("first", F.explode("locs").alias("loc")), "first").drop("first").join(usable.select("en_id", "dist_m", "speed", "toll"), "en_id")
    out = out.withColumn("behind_m", F.floor(F.col("dist_m") * F.col("fraction")).cast("long")).withColumn("ahead_m", F.col("dist_m") - F.col("behind_m"))
    return out.withColumn("ahead", _part(p, o, F.col("ahead_m"))).withColumn("behind", _part(p, o, F.col("behind_m")))


def graph_of(net: Network, o: Options) -> DataFrame:
    usable = _usable(net, o)
    g = cost.adjacency(net.turns, usable, cost.profile(o.profile), o.model, o.avoid_toll, o.avoid_ferry)
    return g.join(usable.select(F.col("en_id").alias("to_en"), F.col("dist_m").alias("metres")), "to_en").select("from_en", "to_en", "turn", "cost", "metres")


def _seeds(snaps: DataFrame) -> DataFrame:
    return snaps.select(F.col("loc").alias("origin"), "en_id", F.col("ahead").alias("cost"), F.col("ahead_m").alias("metres"))


def _places(snaps: DataFrame, path: str) -> DataFrame:
    """(loc, place): locations with the same snaps are one place, named by the smallest of them."""
    each = snaps.groupBy("loc").agg(F.array_sort(F.collect_set(F.struct("en_id", "fraction", "ahead_m", "behind_m", "ahead", "behind"))).alias("at"))
    return materialize(each.select("loc", F.min("loc").over(W.partitionBy("at")).alias("place")), path)


def matrix(net: Network, origins: DataFrame, targets: DataFrame, pairs: DataFrame | None = None, options: Options = Options(), with_path: bool = True, snaps: DataFrame | None = None) -> DataFrame:
    """(from, to, duration_ms, length_m, from_en, to_en, last_en, path) of the pairs with a path; all pairs by default.

    origins and targets: (loc, lat, lon); pairs: (from, to). A location and itself, or two with the same snaps, are 0 apart.
    last_en and path are null where the way stays on one segment; path lists the segments up to last_en, if pairs are given.
    One search an origin ends with the last of its goals; options.algorithm asks for a search a pair. Where only the costs
    are wanted, with_path is false: to_en and last_en may be null then, too. snaps: those of origins, where they are at hand.
    Locations with the same snaps are searched once, and what is found is told of each; of all pairs they are joined as lists.
    """
    o, p = options, cost.profile(options.profile)
    path = work_dir(net.spark)
    graph = materialize(graph_of(net, o), f"{path}/graph")
    s = materialize(snapped(net, origins, o), f"{path}/from") if snaps is None else snaps
    g = s if targets is origins else materialize(snapped(net, targets, o), f"{path}/to")
    starts = _places(s, f"{path}/starts")
    goals = starts if g is s else _places(g, f"{path}/goals")
    starts, goals = starts.select(F.col("loc").alias("from"), F.col("place").alias("origin")), goals.select(F.col("loc").alias("to"), F.col("place").alias("goal"))
    s, g = s.join(starts.select(F.col("origin").alias("loc")).distinct(), "loc", "left_semi"), g.join(goals.select(F.col("goal").alias("loc")).distinct(), "loc", "left_semi")
    if pairs is not None:
        each = materialize(pairs.select("from", "to").distinct().join(starts, "from").join(goals, "to"), f"{path}/each")
        pairs = materialize(each.select("origin", "goal").distinct(), f"{path}/pairs")
    goal = g.select(F.col("loc").alias("goal"), F.col("en_id").alias("goal_en"), "behind", "behind_m")
    into = goal.join(graph.select("from_en", F.col("to_en").alias("goal_en"), "turn"), "goal_en")
    into = materialize(into.select("goal", "goal_en", "from_en", (F.col("turn") + F.col("behind")).alias("cost"), F.col("behind_m").alias("metres")), f"{path}/into")
    end = F.element_at("points", -1)
    ends = net.edges.select("en_id", end["lat"].alias("lat"), end["lon"].alias("lon"))
    here = s.select(F.col("loc").alias("origin"), "en_id", "speed", "toll", F.col("behind_m").alias("from_m"), F.col("fraction").alias("from_f"))
    there = g.select(F.col("loc").alias("goal"), "en_id", F.col("behind_m").alias("to_m"), F.col("fraction").alias("to_f"))
    ahead = F.greatest(F.lit(0), F.col("to_m") - F.col("from_m")).cast("long")
    along = here.join(there, "en_id").where("to_f >= from_f").select("origin", "goal", _part(p, o, ahead).alias("cost"), ahead.alias("metres"), F.col("en_id").alias("to_en"))
    best = search.to_goals(graph.select("from_en", "to_en", "cost", "metres"), _seeds(s), into, pairs, o.algorithm if pairs is not None else None, ends, o.backend, along, with_path)
    if pairs is None:  # what is joined is a row for some locations here and some there, which is laid out afterwards
        best = best.join(search.in_lists(starts, "origin", "from", "froms"), "origin").join(search.in_lists(goals, "goal", "to", "tos"), "goal")
        best = best.withColumn("from", F.explode("froms")).withColumn("to", F.explode("tos"))
    else:
        best = best.join(each, ["origin", "goal"])
    return best.select("from", "to", F.col("cost").alias("duration_ms"), F.col("metres").alias("length_m"), "to_en", "last_en", "path")


def check_pairs(pairs: list[tuple[int, int]], n_from: int, n_to: int) -> None:
    for a, b in pairs:
        if not (0 <= a < n_from and 0 <= b < n_to):
            raise InvalidRequest(f"the pair ({a}, {b}) is out of range")


def _by_pair(o: Options) -> Options:
    return o if o.algorithm else replace(o, algorithm="bidir_a_star")


def legs(net: Network, stops: DataFrame, options: Options = Options()) -> DataFrame:
    """(trip, leg, from, to, duration_ms, length_m) of each trip's consecutive stops (trip, pos, loc, lat, lon); legs without a path are left out."""
    by = W.partitionBy("trip").orderBy("pos")
    each = stops.select("trip", "pos", F.col("loc").alias("from"), F.lead("loc").over(by).alias("to")).where("to IS NOT NULL")
    places = stops.select("loc", "lat", "lon").dropDuplicates(["loc"])
    found = matrix(net, places, places, each.select("from", "to"), _by_pair(options), with_path=False)
    return each.join(found, ["from", "to"]).select("trip", F.col("pos").alias("leg"), "from", "to", "duration_ms", "length_m")


def trips(found: DataFrame) -> DataFrame:
    return found.groupBy("trip").agg(F.count(F.lit(1)).alias("n_legs"), F.sum("duration_ms").alias("duration_ms"), F.sum("length_m").alias("length_m"))


def route(net: Network, stops: DataFrame, options: Options = Options(), with_path: bool = True) -> DataFrame:
    """legs() with bounds {min_lat, min_lon, max_lat, max_lon} and, unless with_path is false, the path as a polyline.

    A leg's line follows the snaps that its path uses: the rest of the first segment, whole segments, the part of the last.
    """
    if stops.groupBy("trip").count().where("count < 2").limit(1).count():
        raise InvalidRequest("a route needs two locations")
    o, path = options, work_dir(net.spark)
    by = W.partitionBy("trip").orderBy("pos")
    each = stops.select("trip", "pos", F.col("loc").alias("from"), F.lead("loc").over(by).alias("to")).where("to IS NOT NULL")
    places = stops.select("loc", "lat", "lon").dropDuplicates(["loc"])
    s = materialize(snapped(net, places, o), f"{path}/snaps")
    found = materialize(matrix(net, places, places, each.select("from", "to"), _by_pair(o), snaps=s), f"{path}/matrix")
    points = net.edges.select("en_id", "points")
    at = s.select("loc", "en_id", "lat", "lon", "fraction")
    lines = found.select(F.col("from").alias("origin"), F.col("to").alias("goal"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "en_id")).join(points, "en_id")
    lines = lines.join(at.select(F.col("loc").alias("origin"), "en_id", F.col("fraction").alias("f0")), ["origin", "en_id"], "left")
    body = lines.select("origin", "goal", (F.col("pos") - F.col("n")).cast("long").alias("k"), _cut(F.col("points"), F.when(F.col("pos") == 0, F.coalesce("f0", F.lit(0.0))).otherwise(0.0), F.lit(1.0)).alias("line"))
    ends = found.select(F.col("from").alias("origin"), F.col("to").alias("goal"), F.col("to_en").alias("en_id"), F.col("last_en").isNull().alias("same")).join(points, "en_id")
    ends = ends.join(at.select(F.col("loc").alias("goal"), "en_id", F.col("fraction").alias("f1")), ["goal", "en_id"]).join(at.select(F.col("loc").alias("origin"), "en_id", F.col("fraction").alias("f0")), ["origin", "en_id"], "left")
    tail = ends.select("origin", "goal", F.lit(1).cast("long").alias("k"), _cut(F.col("points"), F.when(F.col("same"), F.col("f0")).otherwise(0.0), F.col("f1")).alias("line"))
    whole = body.unionByName(tail).groupBy("origin", "goal").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("parts"))
    whole = _without_repeats(whole.withColumn("lines", F.col("parts.line")), "lines", "line")
    whole = whole.select(F.col("origin").alias("from"), F.col("goal").alias("to"), "line")
    b = geo.box(F.transform("line", lambda q: q["lat"]), F.transform("line", lambda q: q["lon"]))
    whole = whole.select("from", "to", b.alias("bounds"), (polyline.encode(F.col("line")) if with_path else F.lit(None).cast("string")).alias("path"))
    return each.join(found.drop("path"), ["from", "to"]).join(whole, ["from", "to"]).select("trip", F.col("pos").alias("leg"), "from", "to", "duration_ms", "length_m", "bounds", "path")


def _bound(value, body):
    """body(value), with value computed once a row and not wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_repeats(df: DataFrame, lines: str, to: str) -> DataFrame:
    """df with the points of its lines, an array of arrays, in one array; joined in a step of its own, as each point looks for the one before."""
    df = df.withColumn("_all", F.flatten(lines))
    return df.withColumn(to, F.filter("_all", lambda q, k: (k == 0) | ~geo.same_point(q["lat"], q["lon"], F.get("_all", k - 1)["lat"], F.get("_all", k - 1)["lon"]))).drop("_all")


def _cut(points, f0, f1):
    """The part of a line between two fractions of its length."""
    lengths = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda k: geo.haversine_m(F.get(points, k)["lat"], F.get(points, k)["lon"], F.get(points, k + 1)["lat"], F.get(points, k + 1)["lon"]))
    total = lambda each: F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    sums = lambda each: F.transform(F.sequence(F.lit(0), F.size(points) - 1), lambda k: total(F.slice(each, 1, k)))
    places = lambda s: _bound(F.element_at(s, -1), lambda t: F.transform(s, lambda x: x / F.when(t > 0, t).otherwise(1.0)))

    def place(at, f):
        def on(k):
            a, b, x, y = F.get(points, k), F.get(points, k + 1), F.get(at, k), F.get(at, k + 1)
            t = F.when(y > x, (f - x) / F.when(y > x, y - x).otherwise(1.0)).otherwise(0.0)
            return F.struct((a["lat"] + (b["lat"] - a["lat"]) * t).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * t).alias("lon"))

        return _bound(F.greatest(F.lit(0), F.least(F.size(points) - 2, F.size(F.filter(at, lambda x: x <= f)) - 1)), on)

    def part(at):
        inner = F.filter(points, lambda q, k: (F.get(at, k) > f0) & (F.get(at, k) < f1))
        return F.concat(F.array(place(at, f0)), inner, F.array(place(at, f1)))

    return _bound(lengths, lambda each: _bound(sums(each), lambda s: _bound(places(s), part)))


def ranges_of(values: list[float]) -> list[float]:
    """The finite ranges above 0, sorted, each once."""
    out: list[float] = []
    for v in sorted(v for v in values if math.isfinite(v) and v > 0):
        if not out or v - out[-1] > 2.220446049250313e-16:
            out.append(v)
    if not out:
        raise InvalidRequest("no range above 0")
    return out


def isochrone_points(net: Network, origins: DataFrame, ranges: list[float], unit: str = "km", options: Options = Options()) -> DataFrame:
    """(loc, value, en_id, lat, lon): the ends of the segments whose cost is within each range, after one search for the largest.

    km and mi are distances and heed access alone; min is time.
    """
    values = ranges_of(ranges)
    o = Options(options.profile, "time" if unit == "min" else "distance", options.avoid_toll and unit == "min", options.avoid_ferry and unit == "min", options.radius_m, options.backend)
    limits = {v: math.floor(v * {"km": geo.KM_M, "mi": geo.MILE_M, "min": 60_000.0}[unit]) for v in values}
    found = search.shortest_paths(graph_of(net, o).select("from_en", "to_en", "cost", "metres"), _seeds(snapped(net, origins, o)), budget=max(limits.values()), backend=o.backend, preds=False)
    end = F.element_at("points", -1)
    placed = found.join(net.edges.select("en_id", end["lat"].alias("lat"), end["lon"].alias("lon")), "en_id")
    each = placed.withColumn("r", F.explode(F.array(*[F.struct(F.lit(float(v)).alias("value"), F.lit(m).cast("long").alias("limit")) for v, m in limits.items()])))
    return each.where("cost <= r.limit").select(F.col("origin").alias("loc"), "r.value", "en_id", "cost", "lat", "lon")


def isochrone(net: Network, origins: DataFrame, ranges: list[float], unit: str = "km", options: Options = Options()) -> DataFrame:
    """(loc, value, ring, polygon): the hull of what each range reaches; a range that reaches nothing has no row."""
    out = hull.hulls(isochrone_points(net, origins, ranges, unit, options), ["loc", "value"])
    return out.withColumn("polygon", polyline.encode(F.col("ring")))


def locate(net: Network, locations: DataFrame, unit: str = "km", with_meta: str = "None", options: Options = Options()) -> DataFrame:
    """(loc, lat, lon, distance, and by with_meta edge_meta, way_meta, points) of the nearest segment, the smallest en_id of ties.

    A location without a segment within its radius comes back as it was. with_meta: None, Light (the segment's two ends),
    FullEdge (all its points) or FullWay (all the way's points, from_node_idx and to_node_idx telling the segment's part).
    """
    if with_meta not in ("None", "Light", "FullEdge", "FullWay"):
        raise InvalidRequest(f"unknown detail: {with_meta}")
    usable = _usable(net, options)
    found = snap.snap(locations, usable, most_m=options.radius_m)
    first = found.withColumn("r", F.row_number().over(W.partitionBy("loc").orderBy("en_id"))).where("r = 1").select("loc", "en_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "distance_m", "fraction")
    out = locations.join(first, "loc", "left").withColumn("distance", F.round(geo.in_unit("distance_m", F.lit(unit)), 6))
    out = out.withColumn("lat", F.coalesce("s_lat", "lat")).withColumn("lon", F.coalesce("s_lon", "lon")).drop("s_lat", "s_lon")
    if with_meta == "None":
        return out.drop("en_id", "fraction", "distance_m")
    country = F.col("country") if "country" in net.edges.columns else F.lit(None).cast("string")
    way = F.struct("way_id", "class", "surface", "flags", "access", "max_speed", "dim")
    e = net.edges.select("en_id", "dir", "points", F.col("p0").alias("e_p0"), F.col("p1").alias("e_p1"), "dist_m", country.alias("e_country"), F.col("way_id").alias("e_way"), T.way_meta(way).alias("way_meta"))
    out = out.join(e, "en_id", "left")
    if with_meta == "FullWay":
        whole = net.edges.where("dir = 1").groupBy(F.col("way_id").alias("e_way")).agg(F.array_sort(F.collect_list(F.struct("p0", "points"))).alias("parts"))
        whole = _without_repeats(whole.withColumn("lines", F.col("parts.points")), "lines", "way_points").drop("parts", "lines")
        out = out.join(whole, "e_way", "left").withColumn("meta_points", F.coalesce("way_points", "points")).drop("way_points")
        a, b = F.when(F.col("dir") == 1, F.col("e_p0")).otherwise(F.col("e_p1")), F.when(F.col("dir") == 1, F.col("e_p1")).otherwise(F.col("e_p0"))
    else:
        light = F.when(F.col("points").isNotNull(), F.array(F.get("points", F.lit(0)), F.element_at("points", -1)))
        out = out.withColumn("meta_points", light if with_meta == "Light" else F.col("points"))
        a, b = F.lit(0), F.size("meta_points") - 1
    meta = F.when(F.col("en_id").isNotNull(), F.struct(F.col("e_country").alias("country_id"), "dist_m", a.cast("int").alias("from_node_idx"), b.cast("int").alias("to_node_idx")))
    return out.withColumn("edge_meta", meta).select("loc", "lat", "lon", "distance", "way_meta", "edge_meta", "meta_points")


def inspect(net: Network, way_id: int) -> DataFrame:
    """(way_id, way_meta, path): the way as it lies in the data; an unknown way is an invalid request."""
    return inspected(net.edges, net.ways, way_id)


def inspected(edges: DataFrame, ways: DataFrame, way_id: int) -> DataFrame:
    """inspect() on a network's tables or their plans, which are run once: the one row is written."""
    one = ways.where(F.col("way_id") == way_id)
    forward = one.withColumn("r", F.row_number().over(W.partitionBy("way_id").orderBy(F.desc("dir")))).where("r = 1")
    parts = edges.where(F.col("way_id") == way_id).withColumn("line", F.when(F.col("dir") == 1, F.col("points")).otherwise(F.reverse("points")))
    parts = parts.groupBy("way_id", "p0").agg(F.first("line").alias("line")).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("p0", "line"))).alias("parts"))
    parts = _without_repeats(parts.withColumn("lines", F.col("parts.line")), "lines", "line")
    out = forward.join(parts, "way_id").select("way_id", T.way_meta(F.struct("way_id", "class", "surface", "flags", "access", "max_speed", "dim")).alias("way_meta"), polyline.encode(F.col("line")).alias("path"))
    out = materialize(out, f"{work_dir(edges.sparkSession)}/way")
    if out.limit(1).count() == 0:
        raise InvalidRequest(f"unknown way: {way_id}")
    return out
