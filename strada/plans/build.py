"""A network from map data: nodes (id, lat, lon, tags), ways (id, node_refs, tags) and relations (tags, members)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.functions import tags as T
from strada.operators import cost, country, network
from strada.plans.services import Network
from strada.sources import files, osm_pbf
from strada.steps import materialize, work_dir


def from_tables(nodes: DataFrame, ways: DataFrame, relations: DataFrame, borders: DataFrame | None = None, country_speed: dict | None = None, maxspeed: dict[str, int] | None = None) -> Network:
    """Excluded ways are left out before their nodes are counted; a reference to a node that isn't there is an error."""
    path = work_dir(nodes.sparkSession)
    used = ways.where(~T.way_excluded(F.col("tags"))).select(F.col("id").alias("way_id"), "node_refs", "tags")
    refs = materialize(network.refs_of(used), f"{path}/refs")
    flagged = materialize(nodes.select("id", "lat", "lon", T.node_flags(F.col("tags")).alias("tagflags")).join(refs.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), f"{path}/nodes")
    lost = network.missing_nodes(refs, flagged).limit(5).collect()
    if lost:
        raise ValueError(f"ways refer to nodes that don't exist: {[(r['way_id'], r['node']) for r in lost]}")
    directed = materialize(T.expand_directions(used.select("way_id", "tags"), maxspeed).drop("tags"), f"{path}/ways")
    edges = network.edge_nodes(network.segments(refs, flagged, network.node_reference_counts(refs)), directed)
    if borders is not None:
        edges = country.with_country(edges, materialize(country.raster(borders), f"{path}/raster"))
    edges = materialize(edges, f"{path}/edges")
    turns = materialize(network.turns(edges, network.restrictions(relations), flagged), f"{path}/turns")
    return configured(Network(edges, turns, directed), {"country_speed": country_speed or {}}, borders)


def configured(net: Network, conf: dict, borders: DataFrame | None = None) -> Network:
    """The network with a configuration's country speeds and largest radius; the countries known are those of borders, or of the segments."""
    overrides = None
    if conf.get("country_speed") and "country" in net.edges.columns:
        known = (net.edges if borders is None else borders).select("country").where("country IS NOT NULL").distinct()
        overrides = cost.country_speeds(net.spark, conf["country_speed"], [r["country"] for r in known.orderBy("country").collect()])  # ISO codes
    return Network(net.edges, net.turns, net.ways, overrides, float(conf.get("server", {}).get("max_radius_m", net.max_radius_m)))


def from_pbf(spark: SparkSession, path: str, conf: dict | None = None) -> Network:
    osm_pbf.register(spark)
    kind = {k: spark.read.format("osm_pbf").option("type", k).load(path) for k in osm_pbf.SCHEMAS}
    conf = conf or files.DEFAULTS
    borders = files.geojson_borders(spark, conf["import"]["boundaries"]) if conf["import"].get("boundaries") else None
    return from_tables(kind["node"], kind["way"], kind["relation"], borders, conf.get("country_speed"), conf.get("maxspeed"))
