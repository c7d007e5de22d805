import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strada.functions import fixed, geo, polyline
from strada.functions import tags as T
from strada.operators import hull
from strada.operators.cost import PROFILES, effective_speed, profile, segment_time_ms, too_large, turn_cost
from strada.sources import files

LINE = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
TEXT = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances_and_turns(spark):
    assert value(spark, geo.haversine_whole_m(F.lit(48.0), F.lit(11.0), F.lit(49.0), F.lit(11.0))) == 111_194
    assert value(spark, geo.distance_to_box_m(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))) == 0
    assert [value(spark, geo.turn_angle(F.lit(a), F.lit(b))) for a, b in ((10.0, 10.0), (0.0, 90.0), (0.0, -90.0), (0.0, 180.0), (170.0, -170.0))] == [0, 90, -90, -180, 20]
    assert [value(spark, geo.turn_penalty_ms(F.lit(a), F.lit(30_000))) for a in (0, 30, 105, -105, 180)] == [0, 0, 7500, 7500, 30_000]
    assert abs(value(spark, geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 90) < 1e-9


def test_projection_and_points(spark):
    p = lambda y, x: value(spark, geo.project(F.lit(y), F.lit(x), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    assert (p(1.0, 1.0), p(1.0, -5.0), p(0.0, 9.0)) == (0.5, 0.0, 1.0)
    assert value(spark, geo.project(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))) == 0
    assert value(spark, geo.same_point(F.lit(1.0), F.lit(1.0), F.lit(1.0 + 1e-8), F.lit(1.0)))
    assert not value(spark, geo.same_point(F.lit(1.0), F.lit(1.0), F.lit(1.0001), F.lit(1.0)))
    assert value(spark, geo.cross(F.lit(0), F.lit(0), F.lit(1), F.lit(0), F.lit(1), F.lit(1))) == 1


def test_morton_interleaves(spark):
    for lat, lon in ((0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (48.1, 11.5)):
        x, y = (int((v + h) / (2 * h) * ((1 << 31) - 1)) for v, h in ((lat, 90.0), (lon, 180.0)))
        assert value(spark, geo.morton(F.lit(lat), F.lit(lon))) == sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(31))


def test_units(spark):
    assert value(spark, geo.in_unit(F.lit(1609.344), F.lit("mi"))) == 1 and value(spark, geo.in_unit(F.lit(500), F.lit("km"))) == 0.5
    assert [value(spark, geo.range_of(F.lit(1.5), F.lit(u))) for u in ("km", "mi", "min")] == [1500, 2414, 90_000]


def test_polyline_of_the_well_known_line(spark):
    points = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in LINE])
    assert value(spark, polyline.encode(points)) == TEXT == polyline.encode_points(LINE)
    assert [tuple(p) for p in value(spark, polyline.decode(F.lit(TEXT)))] == LINE == polyline.decode_points(TEXT)
    assert value(spark, polyline.encode(F.array().cast("array<struct<lat:double,lon:double>>"))) == ""
    assert value(spark, polyline.decode(F.lit(""))) == []
    for bad in ("_p~", " ", "\x7f\x7f", "_"):
        assert value(spark, polyline.decode(F.lit(bad))) is None
        with pytest.raises(ValueError):
            polyline.decode_points(bad)


@given(st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), max_size=8))
def test_polyline_round_trip(points):
    got = polyline.decode_points(polyline.encode_points(points))
    assert len(got) == len(points)
    assert all(abs(a - c) <= 0.5000001e-5 and abs(b - d) <= 0.5000001e-5 for (a, b), (c, d) in zip(points, got, strict=True))


@pytest.mark.parametrize(("x", "shown"), [(1.5, "1.500000"), (-0.0000123, "-0.000012"), (-0.000000123, "0.000000"), (0.0, "0.000000"), (-12.25, "-12.250000"), (123456.789, "123456.789000")])
def test_fixed_decimals(spark, x, shown):
    assert value(spark, fixed.display(fixed.from_double(F.lit(x)))) == shown


def test_fixed_conversion(spark):
    assert value(spark, fixed.convert(F.lit(1_234_567), 6, 2)) == 123 and value(spark, fixed.convert(F.lit(-1_234_567), 6, 2)) == -123
    assert value(spark, fixed.convert(F.lit(5), 2, 6)) == 50_000 and value(spark, fixed.to_double(F.lit(1_500_000))) == 1.5


@pytest.mark.parametrize(("tags", "excluded", "forward", "backward"), [
    ({"highway": "footway"}, False, 7, 7), ({"highway": "motorway"}, False, 24, 24), ({"highway": "residential", "bicycle": "no"}, False, 8, 8),
    ({"highway": "residential", "motor_vehicle:backward": "no"}, False, 0, 7), ({"highway": "residential", "access": "no", "bicycle": "yes"}, True, 23, 23),
    ({"highway": "x"}, True, 0, 0), ({}, True, 0, 0), ({"highway": "track", "access:conditional": "no @ (Mo-Fr); yes @ (Sa)"}, False, 31, 31),
])
def test_access(spark, tags, excluded, forward, backward):
    t = T.literal_map(tags) if tags else F.create_map().cast("map<string,string>")
    assert [value(spark, x) for x in (T.way_excluded(t), T.access_mask(t, True), T.access_mask(t, False))] == [excluded, forward, backward]


@pytest.mark.parametrize(("text", "kmh"), [("30 mph", 48), ("DE:urban", 50), ("GB:rural", 96), ("none", None), ("300", 255), ("45 mph", 72), ("100 mph", 160), ("", None), ("-5", None), ("99999999999999999999", None)])
def test_speeds(spark, text, kmh):
    assert value(spark, T.max_speed(F.lit(text))) == kmh


def test_named_speeds_can_be_replaced(spark):
    assert value(spark, T.max_speed(F.lit("urban"), {"urban": 45})) == 45
    assert len(T.NAMED_SPEEDS) == 68


def test_dimensions(spark):
    t = T.literal_map({"maxheight": "4", "maxheight:physical": "12'6\"", "maxweight": "7.5 t", "maxlength": "x"})
    assert value(spark, T.dimensions(t)).asDict() == {"h": 38, "w": 0, "l": 0, "wt": 30}


def test_costs(spark):
    car = profile(None)
    time = lambda p, kind, limit, surface, toll=False: value(spark, segment_time_ms(p, F.lit(1000), effective_speed(p, F.lit(kind), F.lit(limit), F.lit(surface)), F.lit(toll)))
    assert time(car, "primary", 0, 0) == 45_000 and time(car, "motorway", 140, 0) == 27_692 and time(car, "primary", 0, 5) == 112_500
    assert time(car, "primary", 0, 0, True) == 51_000 and time(profile("BIKE"), "motorway", 100, 0) is None and time(car, "cycleway", 30, 0) is None and time(car, "primary", 0, 7) is None
    assert value(spark, too_large(F.struct(F.lit(38).alias("h"), F.lit(0).alias("w"), F.lit(0).alias("l"), F.lit(0).alias("wt")), PROFILES["hgv"]))
    turn = spark.createDataFrame([(0, 3, 105), (4, 1, 0), (31, 0, 0)], "mask int, flags int, angle int")
    assert [r[0] for r in turn.select(turn_cost(car)).collect()] == [112_500, 15_000, None]
    assert [r[0] for r in turn.select(turn_cost(car, avoid_toll=True)).collect()] == [None, 15_000, None]
    with pytest.raises(ValueError):
        profile("tank")


@pytest.mark.parametrize(("points", "ring"), [
    ([], []), ([(1, 2)], [(1, 2), (1, 2)]), ([(0, 0), (1, 0), (2, 0), (3, 0)], [(0, 0), (3, 0), (0, 0)]),
    ([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)], [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]), ([(0, 0), (2, 0), (2, 2), (0, 2), (1, 2)], [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]),
    ([(0, 0), (1, 0), (0, 1), (0, 0)], [(0, 0), (1, 0), (0, 1), (0, 0)]),
])
def test_hulls(points, ring):
    assert hull.convex_hull(points) == ring


@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=40))
def test_every_point_lies_in_its_hull(points):
    ring = hull.convex_hull(points)
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-9 for x, y in points) or len(ring) == 3


def test_hulls_of_groups(spark):
    data = [(g, float(x), float(y)) for g in (1, 2) for x in range(12) for y in range(12)]
    got = {r["g"]: [tuple(p) for p in r["ring"]] for r in hull.hulls(spark.createDataFrame(data, "g long, lat double, lon double"), ["g"]).collect()}
    assert got == {g: [(0, 0), (11, 0), (11, 11), (0, 11), (0, 0)] for g in (1, 2)}
    assert hull.hulls(spark.createDataFrame([], "g long, lat double, lon double"), ["g"]).count() == 0


def test_config(tmp_path):
    assert files.config()["server"]["port"] == 3000
    (tmp_path / "c.toml").write_text('[storage]\ndir = "net"\n[maxspeed]\nurban = 45\n[country_speed.DE.car]\nmotorway = 130\n')
    c = files.config(str(tmp_path / "c.toml"))
    assert c["storage"]["dir"] == str(tmp_path / "net") and c["maxspeed"] == {"urban": 45} and c["country_speed"]["DE"]["car"]["motorway"] == 130
    with pytest.raises(FileNotFoundError):
        files.config(str(tmp_path / "none.toml"))
    assert math.isfinite(c["server"]["max_radius_m"])


def test_locations_of_requests(spark):
    got = files.locations(spark, [{"lat": 1, "lng": 2, "radius": 2, "id": "a", "note": "n"}, [3, 4]], "mi").collect()
    assert [(r["loc"], r["lat"], r["lon"], r["radius_m"], r["id"]) for r in got] == [(0, 1.0, 2.0, 3218.688, "a"), (1, 3.0, 4.0, None, None)]
    assert got[0]["extra"] == {"note": "n"}
    assert [(r["lat"], r["lon"]) for r in files.locations(spark, TEXT).collect()] == LINE
    for bad in ([{"lat": 1}], "!"):
        with pytest.raises(ValueError):
            files.locations(spark, bad)


def test_long_polylines_and_odd_texts(spark):
    line = [(48 + k * 0.002 + k * 7919 % 97 * 5e-6, 11 - k * 0.003) for k in range(20_000)]
    rows = spark.createDataFrame([(0, line), (1, []), (2, None), (3, line[:1]), (4, [(-0.000005, 0.000015), (-90.0, 180.0)])], "k long, p array<struct<lat:double,lon:double>>")
    rows = rows.coalesce(1).select("k", "p", polyline.encode(F.col("p")).alias("text"))
    got = {r["k"]: r for r in rows.select("k", "p", "text", polyline.decode(F.col("text")).alias("back")).collect()}  # once minutes, by quadratic expressions
    assert all(got[k]["text"] == polyline.encode_points(got[k]["p"] or []) for k in got)
    assert all([tuple(q) for q in got[k]["back"]] == polyline.decode_points(got[k]["text"]) for k in got)
    odd = spark.createDataFrame([(0, "??"), (1, None), (2, "_p~"), (3, TEXT), (4, "é?"), (5, "?"), (6, "")], "k long, t string").coalesce(1)
    back = {r["k"]: r["x"] for r in odd.select("k", polyline.decode(F.col("t")).alias("x")).collect()}
    assert [back[k] for k in (1, 2, 4, 5)] == [None] * 4 and back[6] == [] and [tuple(q) for q in back[0]] == [(0.0, 0.0)] and [tuple(q) for q in back[3]] == LINE


def test_maps_of_constants(spark):
    for d in ({"a": 1, "b:c d": -2, "": 0}, {1: "x", 2: ""}, {"it's": 1, 'a"\\': 2}, {"a": 1.5}, {"a": True}, T.NAMED_SPEEDS):
        got = spark.range(1).select(T.literal_map(d).alias("m"))
        assert got.first()["m"] == d
    assert got.schema["m"].dataType.simpleString() == "map<string,int>"
