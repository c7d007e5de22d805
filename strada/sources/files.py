"""The other sources and sinks: country borders, configuration, requests, responses, and a network as Parquet tables."""

from __future__ import annotations

import json
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.functions import polyline
from strada.operators import network
from strada.plans.services import InvalidRequest, Network

# fixed values: what a configuration holds without a file
DEFAULTS = {"import": {"boundaries": None}, "storage": {"dir": "network"}, "server": {"host": "127.0.0.1", "port": 3000, "max_radius_m": 1000}, "maxspeed": {}, "country_speed": {}}


def geojson_borders(spark: SparkSession, path: str) -> DataFrame:
    """(country, rings) of a FeatureCollection: one row per polygon, features without a two-letter code skipped.

    Ring points are [lon, lat]; coordinates are read as JSON text, since polygons and multipolygons nest differently.
    """
    raw = spark.read.option("multiLine", True).schema("features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").json(path)
    f = raw.select(F.explode("features").alias("f")).select(F.element_at(F.col("f.properties"), F.lit("ISO_A2")).alias("country"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    f = f.where(F.col("country").rlike("^[A-Z]{2}$") & F.col("type").isin("Polygon", "MultiPolygon"))
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", "array<array<array<double>>>"))).otherwise(F.from_json("c", "array<array<array<array<double>>>>"))
    rings = F.transform("p", lambda ring: F.transform(ring, lambda x: F.struct(F.get(x, F.lit(1)).alias("lat"), F.get(x, F.lit(0)).alias("lon"))))
    return f.select("country", F.explode(polygons).alias("p")).select("country", rings.alias("rings"))


def config(path: str | None = None) -> dict:
    """The sections of a TOML file over the defaults; relative paths are taken from the file's folder; no file gives the defaults."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            given = tomllib.load(f)
        if unknown := set(given) - set(out):
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        for section, values in given.items():
            out[section] |= values
        for section, key in (("storage", "dir"), ("import", "boundaries")):
            if (p := out[section].get(key)) and not os.path.isabs(p):
                out[section][key] = os.path.join(os.path.dirname(os.path.abspath(path)), p)
    elif path:
        raise FileNotFoundError(path)
    return out


def write_network(net: Network, folder: str, partitions: int | None = None) -> None:
    """A table has `partitions` files, or by default as many as Spark cuts its shuffles into. Segments lie in Morton order, so that a region's files are few; turns lie by the segment they leave."""
    network.clustered(net.edges, partitions).write.mode("overwrite").parquet(f"{folder}/edges")
    cut = [] if partitions is None else [partitions]
    net.turns.repartitionByRange(*cut, "from_en").sortWithinPartitions("from_en").write.mode("overwrite").parquet(f"{folder}/turns")
    net.ways.repartitionByRange(*cut, "way_id").sortWithinPartitions("way_id").write.mode("overwrite").parquet(f"{folder}/ways")


def read_network(spark: SparkSession, folder: str, overrides: DataFrame | None = None) -> Network:
    return Network(*(spark.read.parquet(f"{folder}/{t}") for t in ("edges", "turns", "ways")), overrides)


def places(value) -> list[dict]:
    """Locations of a request: a list of {lat, lon or lng, radius?, id?, ...} or pairs, or a polyline."""
    if isinstance(value, str):
        try:
            value = [{"lat": a, "lon": b} for a, b in polyline.decode_points(value)]
        except ValueError as e:
            raise InvalidRequest(str(e)) from e
    out = []
    for v in value:
        if isinstance(v, (list, tuple)):
            v = {"lat": v[0], "lon": v[1]}
        lon = v.get("lon", v.get("lng"))
        if not isinstance(v.get("lat"), (int, float)) or not isinstance(lon, (int, float)):
            raise InvalidRequest(f"not a location: {v}")
        out.append({"lat": float(v["lat"]), "lon": float(lon), "radius": v.get("radius"), "id": v.get("id"), "extra": {k: str(x) for k, x in v.items() if k not in ("lat", "lon", "lng", "radius", "id")}})
    return out


def locations(spark: SparkSession, value, units: str = "km") -> DataFrame:
    """(loc, lat, lon, radius_m, id, extra) of a request's locations, loc counting from 0."""
    per = {"km": 1000.0, "mi": 1609.344}
    if units not in per:
        raise InvalidRequest(f"unknown unit: {units}")
    rows = [(k, p["lat"], p["lon"], None if p["radius"] is None else float(p["radius"]) * per[units], p["id"], p["extra"]) for k, p in enumerate(places(value))]
    return spark.createDataFrame(rows, "loc long, lat double, lon double, radius_m double, id string, extra map<string,string>")


def read_request(text: str) -> dict:
    try:
        out = json.loads(text)
    except ValueError as e:
        raise InvalidRequest(str(e)) from e
    if not isinstance(out, dict):
        raise InvalidRequest("a request is an object")
    return out


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, without null fields."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
