"""From nodes, ways and restrictions to a directed graph of road segments and turns.

Each step is one DataFrame transformation keyed by a node, a way or a segment, so that it scales by shuffling rows of a
few bytes. Segments are keyed by a 64-bit id made of (way_id, direction, first position): no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strada.functions import geo
from strada.functions import tags as T


def refs_of(ways: DataFrame) -> DataFrame:
    """(way_id, pos, node) from ways (way_id, node_refs)."""
    return ways.select("way_id", F.posexplode("node_refs").alias("pos", "node"))


def missing_nodes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References to nodes that don't exist."""
    return refs.join(nodes.select(F.col("id").alias("node")), "node", "left_anti")


def node_reference_counts(refs: DataFrame) -> DataFrame:
    """(node, n_refs, is_end, flags): references are counted, so a way that touches a node twice counts twice; two make an intersection."""
    last = F.max("pos").over(W.partitionBy("way_id"))
    marked = refs.withColumn("end", (F.col("pos") == 0) | (F.col("pos") == last))
    out = marked.groupBy("node").agg(F.count(F.lit(1)).alias("n_refs"), F.max("end").alias("is_end"))
    return out.withColumn("flags", F.when(F.col("is_end"), T.NODE_ENDPOINT).otherwise(0) + F.when(F.col("n_refs") >= 2, T.NODE_INTERSECTION).otherwise(0))


def segments(refs: DataFrame, nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(way_id, p0, p1, a, b, dist_m, points): ways cut at each node that has any flag, and at their ends.

    dist_m sums the truncated lengths of the pieces between consecutive nodes. points are the segment's coordinates.
    """
    by = W.partitionBy("way_id").orderBy("pos")
    at = refs.join(nodes.select(F.col("id").alias("node"), "lat", "lon", "tagflags"), "node").join(counts.select("node", "flags"), "node")
    step = F.coalesce(geo.haversine_whole_m(F.lag("lat").over(by), F.lag("lon").over(by), F.col("lat"), F.col("lon")), F.lit(0).cast("long"))
    at = at.withColumn("step", step).withColumn("cum", F.sum("step").over(by.rowsBetween(W.unboundedPreceding, 0)))
    at = at.withColumn("cut", F.col("tagflags").bitwiseOR(F.col("flags")) != 0)
    at = at.withColumn("seg", F.sum(F.col("cut").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)))
    cuts = at.where("cut").select("way_id", F.col("pos").alias("p0"), F.col("node").alias("a"), "cum", F.lead("pos").over(by).alias("p1"), F.lead("node").over(by).alias("b"), F.lead("cum").over(by).alias("cum1"), F.struct("lat", "lon").alias("start"))
    inner = at.where(F.col("seg").isNotNull()).groupBy("way_id", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("tail"))
    out = cuts.where("b IS NOT NULL").withColumn("seg", F.row_number().over(W.partitionBy("way_id").orderBy("p0"))).join(inner, ["way_id", "seg"])
    points = F.concat(F.array("start"), F.transform("tail", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))))
    return out.select("way_id", "p0", "p1", "a", "b", (F.col("cum1") - F.col("cum")).alias("dist_m"), points.alias("points"))


def segment_key(way_id, position, forward) -> Column:
    """The id of a directed segment: 40 bits of way, 22 of position, one of direction; no numbering of rows is needed."""
    return F.shiftleft(way_id.cast("long"), 23).bitwiseOR(F.shiftleft(position.cast("long"), 1)).bitwiseOR(F.when(forward, 0).otherwise(1).cast("long"))


def edge_nodes(segs: DataFrame, ways: DataFrame) -> DataFrame:
    """Directed segments (en_id, way_id, dir, from_node, to_node, dist_m, points in travel order, and the way's columns).

    ways: one row per way and direction (dir 1 or -1), as tags.expand_directions gives them.
    """
    carried = [c for c in ways.columns if c not in ("way_id", "dir", "node_refs", "tags")]
    along = F.col("dir") == 1
    out = segs.join(ways.select("way_id", "dir", *carried), "way_id")
    return out.select(
        segment_key(F.col("way_id"), F.col("p0"), along).alias("en_id"), "way_id", "dir", F.when(along, F.col("a")).otherwise(F.col("b")).alias("from_node"), F.when(along, F.col("b")).otherwise(F.col("a")).alias("to_node"),
        "p0", "p1", "dist_m", F.when(along, F.col("points")).otherwise(F.reverse("points")).alias("points"), *carried,
    )


def edge_boxes(edges: DataFrame) -> DataFrame:
    b = geo.box(F.transform("points", lambda p: p["lat"]), F.transform("points", lambda p: p["lon"]))
    return edges.select("en_id", b.alias("box")).select("en_id", "box.*")


def restrictions(relations: DataFrame) -> DataFrame:
    """(from_way, via, to_way, only) from relations (tags, members array<struct<type, id, role>>): values that begin with only_ or no_."""
    value = F.get(F.filter(F.map_entries("tags"), lambda e: (e["key"] == "restriction") | e["key"].startswith("restriction:")), F.lit(0))["value"]
    member = lambda kind, role: F.get(F.filter("members", lambda m: (m["type"] == kind) & (m["role"] == role)), F.lit(0))["id"]
    out = relations.select(value.alias("value"), member("way", "from").alias("from_way"), member("node", "via").alias("via"), member("way", "to").alias("to_way"))
    good = (F.col("value").startswith("only_") | F.col("value").startswith("no_")) & F.col("from_way").isNotNull() & F.col("via").isNotNull() & F.col("to_way").isNotNull()
    return out.where(good).select("from_way", "via", "to_way", F.col("value").startswith("only_").alias("only"))


def turns(edges: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_en, to_en, via, angle, mask, flags): each arriving segment with each leaving one at a shared node, but itself.

    mask forbids vehicles: a `no` rule its own pair, an `only` rule every other way out. flags: 1 signals, 2 toll booth,
    4 boarding a ferry. Restrictions are grouped by where they apply before the join, so that a row matches one at most.
    """
    first, second = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    last, before = F.element_at("points", -1), F.element_at("points", -2)
    x = edges.select(F.col("en_id").alias("from_en"), F.col("way_id").alias("x_way"), F.col("to_node").alias("via"), F.col("class").alias("x_class"), geo.bearing(before["lat"], before["lon"], last["lat"], last["lon"]).alias("b_in"))
    y = edges.select(F.col("en_id").alias("to_en"), F.col("way_id").alias("y_way"), F.col("from_node").alias("via"), F.col("class").alias("y_class"), geo.bearing(first["lat"], first["lon"], second["lat"], second["lon"]).alias("b_out"))
    banned = rules.groupBy(F.col("from_way").alias("x_way"), "via").agg(F.collect_set(F.when(~F.col("only"), F.col("to_way"))).alias("no"), F.collect_set(F.when(F.col("only"), F.col("to_way"))).alias("only"))
    x = x.join(nodes.select(F.col("id").alias("via"), "tagflags"), "via").join(banned, ["x_way", "via"], "left")
    out = x.join(y, "via").where("from_en <> to_en")
    none = F.array().cast("array<long>")
    no, only = F.coalesce("no", none), F.coalesce("only", none)
    forbidden = F.array_contains(no, F.col("y_way")) | ((F.size(only) > 0) & (F.exists(only, lambda w: w != F.col("y_way"))))
    flag = lambda bit, value: F.when(F.col("tagflags").bitwiseAND(F.lit(bit)) != 0, value).otherwise(0)
    ferry = F.when((F.col("y_class") == "ferry") & (F.col("x_class") != "ferry"), 4).otherwise(0)
    return out.select(
        "from_en", "to_en", "via", geo.turn_angle("b_in", "b_out").alias("angle"), F.when(forbidden, T.NO_ALL).otherwise(0).alias("mask"), (flag(T.NODE_SIGNALS, 1) + flag(T.NODE_TOLL, 2) + ferry).alias("flags")
    )


def clustered(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """Segments by the Morton key of their first point: near ones share files, and statistics can skip the others."""
    p = F.get("points", F.lit(0))
    keyed = edges.withColumn("morton", geo.morton(p["lat"], p["lon"]))
    return keyed.repartitionByRange(*([] if partitions is None else [partitions]), "morton").sortWithinPartitions("morton", "en_id")
