"""What the tags of ways and nodes mean: expressions over map<string,string> columns.

A tag with conditions is an array of items {mode, direction, condition, value}: keys are split at colons into a mode, a
direction and `conditional`, conditional values at `;` and then `@`. A tag is simple when its only item has neither mode,
direction nor condition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the vocabulary of the map data, each group under the name that stands for it
ACCESS = {
    "yes": ["yes", "public"], "no": ["no", "private", "discouraged", "disabled"], "permissive": ["permissive"], "permit": ["permit"],
    "destination": ["destination"], "delivery": ["delivery"], "customers": ["customers", "visitors"], "designated": ["designated", "official"],
    "use_sidepath": ["use_sidepath"], "dismount": ["dismount"], "agricultural": ["agricultural"], "forestry": ["forestry"],
    "residents": ["residents", "employees", "students", "university", "members", "staff"], "military": ["military"], "emergency": ["emergency"],
}
ACCESS_EXCLUDED = ["no", "unknown", "permit", "military", "emergency", "forestry", "agricultural"]
HIGHWAY = {k: [k] for k in ["motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "unclassified", "residential", "living_street", "service", "track", "road", "footway", "bridleway", "path", "cycleway"]} | {
    "pedestrian": ["pedestrian", "crossing", "steps"], "busway": ["busway", "platform"],
    "no": ["no", "construction", "proposed", "emergency_bay", "corridor", "raceway", "via_ferrata", "abandoned", "disused", "escape", "bus_guideway"],
}
ONEWAY = {"no": ["no", "disabled", "false"], "yes": ["yes", "recommended", "true"], "reverse": ["reverse", "-1"], "alternating": ["alternating", "reversivle", "reversible", "conditional"]}
SMOOTHNESS = {"excellent": 1, "good": 2, "intermediate": 2, "bad": 4, "very_bad": 5, "horrible": 6, "very_horrible": 6, "impassable": 7}
TRACKTYPE = {"grade1": 2, "grade2": 3, "grade3": 4, "grade4": 5, "grade5": 6}
SURFACE = {
    "asphalt": 1, "concrete": 1, "metal": 1, "rubber": 1, "paved": 2, "paving_stones": 2, "sett": 2, "bricks": 2, "cobblestone": 3, "unhewn_cobblestone": 3,
    "wood": 3, "stepping_stones": 3, "compacted": 3, "unpaved": 4, "gravel": 5, "fine_gravel": 5, "shells": 5, "pebblestone": 5, "ground": 5, "dirt": 5,
    "earth": 5, "grass": 6, "sand": 7, "ice": 7, "snow": 7,
}
BARRIER = {
    "bollard": ["bollard", "block", "chain", "jersey_barrier", "log", "planter", "rope", "spikes"],
    "gate": ["gate", "lift_gate", "swing_gate", "sliding_gate", "hampshire_gate", "bump_gate", "wicket_gate"],
    "kissing_gate": ["kissing_gate", "stile", "turnstile", "full_height_turnstile", "sump_buster"],
    "cycle_barrier": ["cycle_barrier", "motorcycle_barrier"],
}
MODES = ["foot", "horse", "vehicle", "bicycle", "trailer", "motor_vehicle", "motorcycle", "moped", "mofa", "motorcar", "motorhome", "tourist_bus", "coach", "goods", "hgv"]
CLASSES = [
    "unknown", "motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
    "unclassified", "residential", "living_street", "service", "track", "road", "pedestrian", "footway", "cycleway", "path", "bridleway", "ferry",
    "service_driveway", "service_parking_aisle", "service_alley",
]
SURFACES = ["Unknown", "Excellent", "Good", "Intermediate", "Bad", "VeryBad", "Horrible", "Impassable"]
NO_CAR, NO_MOTORCYCLE, NO_HGV, NO_BICYCLE, NO_FOOT, NO_MOTOR, NO_ALL = 1, 2, 4, 8, 16, 7, 31
#: What an item of a mode forbids or allows.
MODE_BITS = {"default": NO_ALL, "vehicle": NO_MOTOR | NO_BICYCLE, "motor_vehicle": NO_MOTOR, "motorcar": NO_MOTOR, "motorcycle": NO_MOTOR, "moped": NO_MOTOR, "mofa": NO_MOTOR, "motorhome": NO_MOTOR, "hgv": NO_HGV, "goods": NO_HGV, "coach": NO_HGV, "tourist_bus": NO_HGV, "bicycle": NO_BICYCLE, "foot": NO_FOOT}
WAY_ONEWAY, WAY_TOLL, WAY_TUNNEL, WAY_BRIDGE, WAY_FORWARD, WAY_BACKWARD, WAY_PAIR = 1, 2, 4, 8, 16, 32, 64
NODE_NO_MOTOR, NODE_NO_HGV, NODE_NO_BICYCLE, NODE_NO_FOOT, NODE_SIGNALS, NODE_TOLL, NODE_ENDPOINT, NODE_INTERSECTION = 1, 2, 4, 8, 16, 32, 64, 128
NODE_ALL = NODE_NO_MOTOR | NODE_NO_HGV | NODE_NO_BICYCLE | NODE_NO_FOOT
NODE_MODE_BITS = {"default": NODE_ALL, "vehicle": NODE_NO_MOTOR | NODE_NO_HGV | NODE_NO_BICYCLE, "motor_vehicle": NODE_NO_MOTOR | NODE_NO_HGV, "motorcar": NODE_NO_MOTOR, "motorcycle": NODE_NO_MOTOR, "moped": NODE_NO_MOTOR, "mofa": NODE_NO_MOTOR, "motorhome": NODE_NO_MOTOR, "hgv": NODE_NO_HGV, "goods": NODE_NO_HGV, "coach": NODE_NO_HGV, "tourist_bus": NODE_NO_HGV, "bicycle": NODE_NO_BICYCLE, "foot": NODE_NO_FOOT}
# fixed values: named speeds in km/h
GENERIC_SPEEDS = {"walk": 7, "walking": 7, "living_street": 10, "urban": 50, "rural": 90, "motorway": 130}
COUNTRY_SPEEDS = {  # living_street, urban, rural, motorway
    "DE": (10, 50, 100, 130), "AT": (10, 50, 100, 130), "CH": (10, 50, 80, 120), "FR": (20, 50, 80, 130), "NL": (15, 50, 80, 100), "BE": (20, 50, 90, 120),
    "IT": (10, 50, 90, 130), "ES": (20, 50, 90, 120), "PT": (20, 50, 90, 120), "PL": (20, 50, 90, 140), "CZ": (20, 50, 90, 130), "GB": (10, 48, 96, 112),
    "RU": (20, 60, 90, 110), "UA": (20, 60, 90, 130), "US": (25, 40, 88, 104),
}
NAMED_SPEEDS = GENERIC_SPEEDS | {f"{c}:{k}": v for c, speeds in COUNTRY_SPEEDS.items() for k, v in zip(("living_street", "urban", "rural", "motorway"), speeds, strict=True)} | {"GB:nsl_single": 96, "GB:nsl_dual": 112}


def literal_map(d: dict) -> Column:
    """A map of constants. Plain words and small numbers are parsed at once: a call to the JVM for each of them took seconds a plan."""
    plain = lambda x: type(x) is int and abs(x) < 1 << 31 or type(x) is str and re.fullmatch(r"[A-Za-z0-9_:;. -]*", x)
    if d and all(plain(x) for kv in d.items() for x in kv):
        return F.expr(f"map({', '.join(repr(x) for kv in d.items() for x in kv)})")
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _named(groups: dict[str, list[str]]) -> dict[str, str]:
    return {v: k for k, vs in groups.items() for v in vs}


def tag(tags: Column, key: str) -> Column:
    return F.element_at(tags, F.lit(key))


def known(value: Column, groups: dict[str, list[str]]) -> Column:
    """The group's name; unknown for another value, null for null."""
    return F.when(value.isNotNull(), F.coalesce(F.element_at(literal_map(_named(groups)), value), F.lit("unknown")))


def truth(value: Column) -> Column:
    """A yes/no tag: false where it is absent."""
    return F.coalesce(~value.isin("no", "false", "unknown"), F.lit(False))


def excluded(access: Column) -> Column:
    return access.isin(*ACCESS_EXCLUDED)


def items(tags: Column, first: list[str], groups: dict[str, list[str]], lanes: bool = False) -> Column:
    """The items of the tags whose key begins with one of `first`, as array<struct<mode, direction, condition, value>>."""

    def entry(e):
        parts = F.split(e["key"], ":")
        mode = F.coalesce(F.get(F.filter(parts, lambda p: p.isin(*MODES)), F.lit(0)), F.lit("default"))
        direction = F.coalesce(F.get(F.filter(parts, lambda p: p.isin("both", "both_ways", "forward", "backward", "left", "right")), F.lit(0)), F.lit("both"))
        direction = F.when(direction == "both_ways", "both").otherwise(direction)
        whole = F.array(F.struct(mode.alias("mode"), direction.alias("direction"), F.lit(None).cast("string").alias("condition"), known(F.trim(e["value"]), groups).alias("value")))
        each = F.transform(
            F.split(e["value"], ";"),
            lambda v: F.struct(mode.alias("mode"), direction.alias("direction"), F.trim(F.get(F.split(v, "@"), F.lit(1))).alias("condition"), known(F.trim(F.get(F.split(v, "@"), F.lit(0))), groups).alias("value")),
        )
        return F.when(F.array_contains(parts, "conditional"), each).otherwise(whole)

    def wanted(e):
        parts = F.split(e["key"], ":")
        ok = F.get(parts, F.lit(0)).isin(*first)
        return ok if lanes else ok & ~F.array_contains(parts, "lanes")

    entries = F.array_sort(F.filter(F.map_entries(tags), wanted))
    return F.coalesce(F.flatten(F.transform(entries, entry)), F.array().cast("array<struct<mode:string,direction:string,condition:string,value:string>>"))


def _general(i: Column) -> Column:
    return (i["mode"] == "default") & (i["direction"] == "both") & i["condition"].isNull()


def simple(parsed: Column) -> Column:
    """The value of a simple tag, else null."""
    return F.when((F.size(parsed) == 1) & _general(F.get(parsed, F.lit(0))), F.get(parsed, F.lit(0))["value"])


def access_items(tags: Column) -> Column:
    return items(tags, ["access", *MODES], ACCESS)


def oneway_items(tags: Column) -> Column:
    return items(tags, ["oneway"], ONEWAY, lanes=True)


def generally_excluded(parsed: Column) -> Column:
    """An unqualified item forbids access, and none allows it."""
    general = F.filter(parsed, _general)
    return (F.size(general) > 0) & F.forall(general, lambda i: excluded(i["value"]))


def way_excluded(tags: Column) -> Column:
    highway = known(tag(tags, "highway"), HIGHWAY)
    ferry = F.coalesce(tag(tags, "route") == "ferry", F.lit(False))
    no_road = ~ferry & F.coalesce(highway.isin("unknown", "no"), F.lit(True))
    gone = truth(tag(tags, "area")) | truth(tag(tags, "disused")) | truth(tag(tags, "abandoned")) | truth(tag(tags, "impassable")) | F.coalesce(tag(tags, "status") == "impassable", F.lit(False))
    return no_road | generally_excluded(access_items(tags)) | gone


def highway_class(tags: Column) -> Column:
    """One of CLASSES. A ferry route without a highway tag is a ferry."""
    highway, service = known(tag(tags, "highway"), HIGHWAY), tag(tags, "service")
    return (
        F.when((highway == "service") & service.isin("driveway", "parking_aisle", "alley"), F.concat(F.lit("service_"), service))
        .when(highway.isin(*[c for c in CLASSES if c not in ("unknown", "ferry")]), highway)
        .when(highway.isNull() & (tag(tags, "route") == "ferry"), "ferry")
        .otherwise("unknown")
    )


def surface_quality(tags: Column) -> Column:
    """0 (unknown) to 7 (impassable): smoothness goes before tracktype, tracktype before surface."""
    out = F.lit(0)
    for key, quality in (("surface", SURFACE), ("tracktype", TRACKTYPE), ("smoothness", SMOOTHNESS)):
        out = F.when(tag(tags, key).isNotNull(), F.coalesce(F.element_at(literal_map(quality), tag(tags, key)), F.lit(0))).otherwise(out)
    return out


def _oneway(tags: Column) -> Column:
    """The value of the unqualified oneway item; a oneway for one mode doesn't change it."""
    return F.get(F.filter(oneway_items(tags), _general), F.lit(0))["value"]


def oneway_reverse(tags: Column) -> Column:
    return F.coalesce(_oneway(tags) == "reverse", F.lit(False))


def bicycle_contraflow(tags: Column) -> Column:
    return F.exists(oneway_items(tags), lambda i: (i["mode"] == "bicycle") & (i["value"] == "no"))


def way_flags(tags: Column) -> Column:
    oneway = F.coalesce(_oneway(tags).isin("yes", "reverse"), F.lit(False)) | F.coalesce(tag(tags, "junction").isin("roundabout", "circular"), F.lit(False))
    built = lambda key: tag(tags, key).isNotNull() & ~tag(tags, key).isin("no", "false")
    bit = lambda c, b: F.when(c, b).otherwise(0)
    return bit(oneway, WAY_ONEWAY) + bit(truth(tag(tags, "toll")), WAY_TOLL) + bit(built("tunnel"), WAY_TUNNEL) + bit(built("bridge"), WAY_BRIDGE)


def _or_bits(parsed: Column, bits: dict[str, int]) -> Column:
    of = literal_map(bits)
    return F.aggregate(parsed, F.lit(0), lambda a, i: a.bitwiseOR(F.coalesce(F.element_at(of, i["mode"]), F.lit(0))))


def _access_mask(base: Column, parsed: Column, bits: dict[str, int]) -> Column:
    """Forbidden items are added, then allowed ones taken away; an allowed unqualified item takes nothing away."""
    forbidden = _or_bits(F.filter(parsed, lambda i: excluded(i["value"])), bits)
    allowed = _or_bits(F.filter(parsed, lambda i: ~excluded(i["value"]) & (i["mode"] != "default")), bits)
    return base.bitwiseOR(forbidden).bitwiseAND(F.bitwise_not(allowed))


def access_mask(tags: Column, forward: bool) -> Column:
    """What is forbidden in one direction of travel. Conditions are not evaluated."""
    kind = highway_class(tags)
    base = (
        F.when(kind.isin("footway", "pedestrian", "cycleway", "path"), NO_MOTOR)
        .when(kind == "bridleway", NO_MOTOR | NO_BICYCLE)
        .when(kind.isin("motorway", "motorway_link"), NO_BICYCLE | NO_FOOT)
        .otherwise(0)
    )
    base = base.bitwiseOR(F.when(truth(tag(tags, "motorroad")), NO_BICYCLE | NO_FOOT).otherwise(0))
    here = F.filter(access_items(tags), lambda i: i["direction"].isin("both", "forward" if forward else "backward"))
    return _access_mask(base, here, MODE_BITS)


def max_speed(value: Column, named: dict[str, int] | None = None) -> Column:
    """km/h of a maxspeed value, at most 255; null where it says none. named goes before the built-in names."""
    v = F.trim(value)
    mph = F.regexp_extract(v, r"^([0-9]+) *mph$", 1)
    number = F.regexp_extract(v, r"^\+?([0-9]+)$", 1)
    kmh = F.coalesce(
        F.element_at(literal_map(NAMED_SPEEDS | (named or {})), v).cast("long"),
        F.when(mph != "", F.floor(mph.try_cast("long") * 1609 / 1000)),
        F.when(number != "", number.try_cast("long")),
    )
    return F.when(kmh > 255, 255).otherwise(kmh).cast("int")  # least() would pass over a null


def speeds(tags: Column, named: dict[str, int] | None = None) -> Column:
    """{forward, backward}: the direction's own limit, else the way's, else the advised one, else 0."""
    base = F.coalesce(max_speed(F.coalesce(tag(tags, "maxspeed"), tag(tags, "maxspeed:advisory")), named), F.lit(0))
    one = lambda d: F.coalesce(max_speed(tag(tags, f"maxspeed:{d}"), named), base)
    return F.struct(one("forward").alias("forward"), one("backward").alias("backward"))


_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"


def metres(value: Column) -> Column:
    """Metres of `3.8`, `3.8 m` or `12'6"`; null where it says none."""
    v = F.trim(value)
    feet = F.regexp_extract(v, rf"^({_NUMBER})\s*'", 1).try_cast("double")
    inches = F.coalesce(F.regexp_extract(v, rf"'\s*({_NUMBER})\s*\"?$", 1).try_cast("double"), F.lit(0.0))
    plain = F.regexp_extract(v, rf"^({_NUMBER})\s*m?$", 1).try_cast("double")
    return F.when(v.contains("'"), feet * 0.3048 + inches * 0.0254).otherwise(plain)


def tonnes(value: Column) -> Column:
    return F.regexp_extract(F.trim(value), rf"^({_NUMBER})\s*t?$", 1).try_cast("double")


def dimensions(tags: Column) -> Column:
    """{h, w, l: dm, wt: 250 kg}, 0 for no limit; the legal and the physical limit's lesser one, at most 255."""
    byte = lambda x, k: F.coalesce(F.least(F.lit(255), F.greatest(F.lit(0), F.round(x * k).cast("int"))), F.lit(0))
    both = lambda key: F.least(metres(tag(tags, key)), metres(tag(tags, f"{key}:physical")))
    return F.struct(byte(both("maxheight"), 10).alias("h"), byte(both("maxwidth"), 10).alias("w"), byte(metres(tag(tags, "maxlength")), 10).alias("l"), byte(tonnes(tag(tags, "maxweight")), 4).alias("wt"))


def node_flags(tags: Column) -> Column:
    kind = known(tag(tags, "barrier"), BARRIER)
    base = (
        F.when(kind.isin("bollard", "gate"), NODE_NO_MOTOR | NODE_NO_HGV)
        .when(kind == "kissing_gate", NODE_NO_MOTOR | NODE_NO_HGV | NODE_NO_BICYCLE)
        .when(kind == "cycle_barrier", NODE_NO_BICYCLE)
        .otherwise(0)
    )
    mask = _access_mask(base, items(tags, ["access", *MODES], ACCESS, lanes=True), NODE_MODE_BITS)
    signals = F.when(tag(tags, "highway") == "traffic_signals", NODE_SIGNALS).otherwise(0)
    return mask + signals + F.when(truth(tag(tags, "toll")), NODE_TOLL).otherwise(0)


def way_meta(way: Column) -> Column:
    """What is told about a way {way_id, class, surface, flags, access, max_speed, dim}: names in CamelCase, cm and kg, 0 for no limit."""
    camel = F.replace(F.initcap(F.replace(way["class"], F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    flag = lambda b: way["flags"].bitwiseAND(F.lit(b)) != 0
    no = lambda b: way["access"].bitwiseAND(F.lit(b)) == b
    return F.struct(
        way["way_id"].alias("id"), way["max_speed"].alias("max_speed"), camel.alias("highway"), F.element_at(literal_map(dict(enumerate(SURFACES))), way["surface"]).alias("surface_quality"),
        flag(WAY_ONEWAY).alias("oneway"), flag(WAY_TOLL).alias("toll"), flag(WAY_TUNNEL).alias("tunnel"), flag(WAY_BRIDGE).alias("bridge"), (way["class"] == "ferry").alias("ferry"),
        (way["dim"]["h"] * 10).alias("max_height_cm"), (way["dim"]["w"] * 10).alias("max_width_cm"), (way["dim"]["wt"] * 250).alias("max_weight_kg"),
        no(NO_MOTOR).alias("no_motor"), no(NO_HGV).alias("no_hgv"), no(NO_BICYCLE).alias("no_bicycle"), no(NO_FOOT).alias("no_foot"),
    )


def expand_directions(ways, named: dict[str, int] | None = None):
    """One row per direction of travel of each way that isn't excluded: dir 1 along the nodes, -1 against them.

    A oneway has its own direction; with a bicycle contraflow the other one too, open to bicycles alone.
    """
    t = F.col("tags")
    one, reverse, contraflow = F.col("flags").bitwiseAND(F.lit(WAY_ONEWAY)) != 0, F.col("reverse"), F.col("contraflow")
    out = ways.where(~way_excluded(t)).select(
        "*", highway_class(t).alias("class"), surface_quality(t).alias("surface"), way_flags(t).alias("flags"), speeds(t, named).alias("speed"), dimensions(t).alias("dim"),
        oneway_reverse(t).alias("reverse"), bicycle_contraflow(t).alias("contraflow"), access_mask(t, True).alias("fwd"), access_mask(t, False).alias("bwd"),
    )
    main = F.when(reverse, -1).otherwise(1)
    out = out.withColumn("dir", F.explode(F.when(one & ~contraflow, F.array(main)).otherwise(F.array(F.lit(1), F.lit(-1)))))
    against = one & (F.col("dir") != main)
    mask = F.when(F.col("dir") == 1, F.col("fwd")).otherwise(F.col("bwd"))
    speed = F.when(F.col("dir") == 1, F.col("speed.forward")).otherwise(F.col("speed.backward"))
    mask = F.when(against, F.lit(NO_ALL & ~NO_BICYCLE).bitwiseOR(mask.bitwiseAND(F.lit(NO_BICYCLE)))).otherwise(mask)
    return out.withColumn("access", mask).withColumn("max_speed", speed).drop("fwd", "bwd", "speed", "reverse", "contraflow")
