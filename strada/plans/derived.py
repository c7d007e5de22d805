"""A deterministic road network from ordinary tables, so that every operator runs on data of any size.

Customers are nodes on a jittered grid (W columns), rows and every third column are ways, parts are the ways' tags, some
orders are turn restrictions, suppliers are the places that queries start from.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.functions import tags as T
from strada.operators import network
from strada.plans.services import Network
from strada.steps import materialize, work_dir


#: Orders below this price are restrictions.
CHEAP = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(columns, rows) of the grid, from the number of customers."""
    n = read(spark, sf_dir, "customer").count()
    w = max(1, math.ceil(math.sqrt(n)))
    return w, math.ceil(n / w)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r, c, lat, lon, tagflags)."""
    w, _ = grid(spark, sf_dir)
    n = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / w).cast("long").alias("r"), (F.col("c_custkey") % w).alias("c"))
    flags = F.when(F.col("id") % 11 == 0, T.NODE_SIGNALS).otherwise(0) + F.when(F.col("id") % 97 == 5, T.NODE_TOLL).otherwise(0) + F.when(F.col("id") % 53 == 7, T.NODE_NO_MOTOR | T.NODE_NO_HGV).otherwise(0)
    return n.select("id", "r", "c", (F.lit(48.0) + F.col("r") * 0.002 + (F.col("id") * 7919 % 97) * 0.000005).alias("lat"), (F.lit(11.0) + F.col("c") * 0.003 + (F.col("id") * 104729 % 89) * 0.000005).alias("lon"), flags.alias("tagflags"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, pos, node)."""
    n = nodes(spark, sf_dir)
    rows = n.select((F.lit(1000) + F.col("r")).alias("way_id"), F.col("c").alias("pos"), F.col("id").alias("node"))
    return rows.unionByName(n.where("c % 3 = 0").select((F.lit(5000) + F.col("c")).alias("way_id"), F.col("r").alias("pos"), F.col("id").alias("node")))


def tagged_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, tags map<string,string>)."""
    n = nodes(spark, sf_dir)
    keys = n.select((F.lit(1000) + F.col("r")).alias("way_id"), (F.col("r") * 2).alias("p_partkey")).unionByName(n.where("c % 3 = 0").select((F.lit(5000) + F.col("c")).alias("way_id"), (F.col("c") * 2 + 1).alias("p_partkey"))).distinct()
    p = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    highway = F.coalesce(F.element_at(T.literal_map({"ECONOMY": "residential", "SMALL": "service", "MEDIUM": "tertiary", "PROMO": "motorway", "STANDARD": "primary"}), F.col("p_type")), F.lit("track"))
    tag = {
        "highway": highway,
        "maxspeed": F.when(F.col("p_size") % 5 == 1, "30").when(F.col("p_size") % 5 == 2, "DE:urban").when(F.col("p_size") % 5 == 3, "20 mph").when(F.col("p_size") % 5 == 4, "100"),
        "oneway": F.when(F.col("p_partkey") % 7 == 3, "yes").when(F.col("p_partkey") % 7 == 5, "-1"),
        "surface": F.when(F.col("p_size") % 4 == 0, "asphalt").when(F.col("p_size") % 4 == 1, "paving_stones").when(F.col("p_size") % 4 == 2, "gravel"),
        "maxheight": F.when(F.col("p_size") % 10 == 7, "3.8"),
        "toll": F.when(F.col("p_partkey") % 13 == 6, "yes"),
    }
    tags = F.map_filter(F.create_map(*[x for k, v in tag.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return keys.join(p, "p_partkey").select("way_id", tags.alias("tags"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tags, members) of the turn restrictions."""
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')").where(F.col("o_totalprice") < CHEAP).select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "only_right_turn").otherwise("no_left_turn").alias("value")).distinct()
    at = o.join(nodes(spark, sf_dir).where("c % 3 = 0").select("id", "r", "c"), "id")
    member = lambda kind, id_, role: F.struct(F.lit(kind).alias("type"), id_.cast("long").alias("id"), F.lit(role).alias("role"))
    return at.select(F.create_map(F.lit("restriction"), F.col("value")).alias("tags"), F.array(member("way", 1000 + F.col("r"), "from"), member("node", F.col("id"), "via"), member("way", 5000 + F.col("c"), "to")).alias("members"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(loc, lat, lon)."""
    w, r = grid(spark, sf_dir)
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("loc"), (F.lit(48.0) + (k * 37 % r) * 0.002 + 0.0007).alias("lat"), (F.lit(11.0) + (k * 53 % w) * 0.003 + 0.0011).alias("lon"))


def unwritten(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, ways) of the network as plans, for a query on one way: of the others nothing is made but the nodes' reference counts."""
    r = refs(spark, sf_dir)
    ways = T.expand_directions(tagged_ways(spark, sf_dir)).drop("tags")
    return network.edge_nodes(network.segments(r, nodes(spark, sf_dir), network.node_reference_counts(r)), ways), ways


def build(spark: SparkSession, sf_dir: str) -> Network:
    """The network, each table written once in the shared folder."""
    path = work_dir(spark)
    n, r = nodes(spark, sf_dir), refs(spark, sf_dir)
    ways = materialize(T.expand_directions(tagged_ways(spark, sf_dir)).drop("tags"), f"{path}/ways")
    segs = network.segments(r, n, network.node_reference_counts(r))
    edges = materialize(network.edge_nodes(segs, ways), f"{path}/edges")
    turns = materialize(network.turns(edges, network.restrictions(relations(spark, sf_dir)), n), f"{path}/turns")
    return Network(edges, turns, ways)
