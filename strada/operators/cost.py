"""What travelling costs: profiles, country speeds, and the cost of segments and turns as expressions.

A cost is whole milliseconds (time) or metres (distance); null means that the profile may not go there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strada.functions import tags as T


@dataclass(frozen=True)
class Profile:
    name: str
    vehicle: str
    mask: int
    max_speed: int
    speeds: tuple[int, ...]
    surface_pct: tuple[int, ...]
    dims: dict = field(hash=False)
    signal_ms: int = 0
    toll_ms_per_km: int = 0
    booth_ms: int = 0
    ferry_ms: int = 0
    turn_ms: int = 0


# fixed values: default km/h by class in the order of tags.CLASSES, percent of it by surface in the order of tags.SURFACES,
# the vehicle's dm and 250 kg, and penalties
PROFILES = {
    "car": Profile("car", "car", T.NO_CAR, 130, (0, 110, 90, 80, 60, 50, 90, 70, 60, 50, 40, 50, 30, 10, 20, 20, 40, 0, 0, 0, 0, 0, 5, 10, 10, 15), (100, 100, 100, 80, 60, 40, 20, 0), {"h": 0, "w": 19, "l": 0, "wt": 0}, 15_000, 6_000, 90_000, 1_800_000, 30_000),
    "hgv": Profile("hgv", "hgv", T.NO_HGV, 90, (0, 80, 80, 70, 60, 50, 70, 60, 60, 50, 40, 50, 30, 10, 20, 20, 40, 0, 0, 0, 0, 0, 5, 10, 10, 15), (100, 100, 100, 85, 60, 30, 0, 0), {"h": 40, "w": 26, "l": 0, "wt": 160}, 20_000, 12_000, 90_000, 1_800_000, 45_000),
    "bike": Profile("bike", "bike", T.NO_BICYCLE, 25, (0, 0, 0, 15, 18, 18, 0, 0, 15, 18, 18, 16, 16, 10, 12, 8, 16, 6, 6, 20, 10, 4, 5, 8, 5, 10), (100, 100, 95, 85, 70, 50, 30, 0), {"h": 0, "w": 6, "l": 0, "wt": 0}, 10_000, 0, 0, 1_800_000, 5_000),
    "foot": Profile("foot", "foot", T.NO_FOOT, 6, (0, 0, 0, 5, 5, 5, 0, 0, 5, 5, 5, 5, 5, 4, 4, 3, 5, 5, 5, 4, 5, 4, 5, 4, 4, 4), (100, 100, 100, 95, 85, 75, 60, 0), {"h": 0, "w": 0, "l": 0, "wt": 0}, 5_000, 0, 0, 1_200_000, 1_000),
}
VEHICLES = ("car", "motorcycle", "hgv", "bike", "foot")


class UnknownProfile(ValueError):
    status = 404


def profile(name: str | None) -> Profile:
    """By name, in any case; the first one without a name."""
    if not name:
        return PROFILES["car"]
    if name.lower() not in PROFILES:
        raise UnknownProfile(f"unknown profile: {name}")
    return PROFILES[name.lower()]


def blocked(mask: Column, p: Profile) -> Column:
    return mask.bitwiseAND(F.lit(p.mask)) != 0


def too_large(dim: Column, p: Profile) -> Column:
    """A limit applies where both it and the vehicle's size are known."""
    out = F.lit(False)
    for k, size in p.dims.items():
        if size > 0:
            out = out | ((dim[k] > 0) & (F.lit(size) > dim[k]))
    return out


def country_speeds(spark: SparkSession, config: dict, countries: list[str]) -> DataFrame:
    """(country, vehicle, class, kmh) of a configuration {country or *: {vehicle or *: {class: kmh}}}; the most specific entry counts.

    A wildcard country is every known one, so a segment without a country never has an override.
    """
    rows = []
    for c, vehicles in config.items():
        if c != "*" and c.upper() not in countries:
            raise ValueError(f"unknown country code: {c}")
        for v, classes in vehicles.items():
            if v != "*" and v.lower() not in VEHICLES:
                raise ValueError(f"unknown profile: {v}")
            for k, kmh in classes.items():
                if k not in T.CLASSES:
                    raise ValueError(f"unknown highway class: {k}")
                rows.append((c if c == "*" else c.upper(), v if v == "*" else v.lower(), k, int(kmh)))
    given = spark.createDataFrame(rows, "c string, v string, class string, kmh int")
    all_c = spark.createDataFrame([(c,) for c in countries], "country string")
    all_v = spark.createDataFrame([(v,) for v in VEHICLES], "vehicle string")
    each = given.join(all_c, (F.col("c") == "*") | (F.col("c") == F.col("country"))).join(all_v, (F.col("v") == "*") | (F.col("v") == F.col("vehicle")))
    rank = F.row_number().over(W.partitionBy("country", "vehicle", "class").orderBy((F.col("c") == "*").cast("int"), (F.col("v") == "*").cast("int")))
    return each.withColumn("r", rank).where("r = 1").select("country", "vehicle", "class", "kmh")


def default_speed(p: Profile, kind: Column, override: Column | None = None) -> Column:
    own = F.element_at(T.literal_map(dict(zip(T.CLASSES, p.speeds, strict=True))), kind)
    return own if override is None else F.coalesce(override, own)


def effective_speed(p: Profile, kind: Column, max_speed: Column, surface: Column, override: Column | None = None) -> Column:
    """km/h, at least 1; null where the class's default or the surface's percentage is 0, tagged speed or not."""
    default = default_speed(p, kind, override)
    pct = F.element_at(F.array(*[F.lit(x) for x in p.surface_pct]), surface + 1)
    speed = F.least(F.when(max_speed > 0, max_speed).otherwise(default), F.lit(p.max_speed))
    return F.when((default > 0) & (pct > 0), F.greatest(F.lit(1), F.floor(speed * pct / 100).cast("int")))


def segment_time_ms(p: Profile, metres: Column, speed: Column, toll: Column, avoid_toll: bool = False) -> Column:
    time = F.floor(metres * 3600.0 / speed).cast("long")
    if avoid_toll:
        return F.when(~toll, time)
    return time + F.when(toll, F.floor(metres * p.toll_ms_per_km / 1000).cast("long")).otherwise(0)


def costed(edges: DataFrame, p: Profile, model: str = "time", avoid_toll: bool = False, overrides: DataFrame | None = None) -> DataFrame:
    """edges with speed, toll and cost, those that the profile may use; model: time or distance.

    overrides: country_speeds(), joined on the segment's country; it has some thousand rows at most.
    """
    toll = F.col("flags").bitwiseAND(F.lit(T.WAY_TOLL)) != 0
    if model == "distance":
        return edges.withColumn("speed", F.lit(None).cast("int")).withColumn("toll", toll).withColumn("cost", F.when(~blocked(F.col("access"), p), F.col("dist_m"))).where("cost IS NOT NULL")
    override = None
    if overrides is not None:
        mine = overrides.where(F.col("vehicle") == p.vehicle).select("country", "class", F.col("kmh").alias("override_kmh"))
        edges = edges.join(mine, ["country", "class"], "left")
        override = F.col("override_kmh")
    speed = F.when(~blocked(F.col("access"), p) & ~too_large(F.col("dim"), p), effective_speed(p, F.col("class"), F.col("max_speed"), F.col("surface"), override))
    out = edges.withColumn("speed", speed).where("speed IS NOT NULL").withColumn("toll", toll)
    out = out.withColumn("cost", segment_time_ms(p, F.col("dist_m"), F.col("speed"), F.col("toll"), avoid_toll)).where("cost IS NOT NULL")
    return out.drop("override_kmh") if overrides is not None else out


def turn_cost(p: Profile, model: str = "time", avoid_toll: bool = False, avoid_ferry: bool = False) -> Column:
    """Of a turn (mask, flags, angle); null where it is forbidden."""
    from strada.functions.geo import turn_penalty_ms

    open_ = ~blocked(F.col("mask"), p)
    if model == "distance":
        return F.when(open_, F.lit(0).cast("long"))
    flag = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    if avoid_toll:
        open_ = open_ & ~flag(2)
    if avoid_ferry:
        open_ = open_ & ~flag(4)
    cost = F.when(flag(1), p.signal_ms).otherwise(0) + F.when(flag(2), p.booth_ms).otherwise(0) + F.when(flag(4), p.ferry_ms).otherwise(0) + turn_penalty_ms("angle", p.turn_ms)
    return F.when(open_, cost.cast("long"))


def adjacency(turns: DataFrame, edges: DataFrame, p: Profile, model: str = "time", avoid_toll: bool = False, avoid_ferry: bool = False) -> DataFrame:
    """(from_en, to_en, turn, cost): open turns between segments that the profile may use; cost is the turn and the whole of to_en."""
    t = turns.withColumn("turn", turn_cost(p, model, avoid_toll, avoid_ferry)).where("turn IS NOT NULL").select("from_en", "to_en", "turn")
    to = edges.select(F.col("en_id").alias("to_en"), F.col("cost").alias("whole"))
    return t.join(to, "to_en").join(edges.select(F.col("en_id").alias("from_en")), "from_en", "left_semi").select("from_en", "to_en", "turn", (F.col("turn") + F.col("whole")).alias("cost"))
