import heapq
import json
import random
import threading
import urllib.error
import urllib.request
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strada import steps
from strada.functions import polyline
from strada.operators import country, network, search, snap
from strada.plans import api, build, services
from strada.plans.services import Options
from strada.sources import files, osm_pbf

# a cross: 1-2-3-4 west to east (2 is a shape point), 5-3-6 south to north, a toll way 4-7 and an island 8-9
NODES = [(1, 48.0, 11.0, {}), (2, 48.0, 11.005, {}), (3, 48.0, 11.01, {"highway": "traffic_signals"}), (4, 48.0, 11.02, {}), (5, 47.99, 11.01, {}), (6, 48.01, 11.01, {}), (7, 48.0, 11.03, {}), (8, 48.2, 11.0, {}), (9, 48.2, 11.01, {}), (10, 0.0, 0.0, {})]
WAYS = [(100, [1, 2, 3, 4], {"highway": "primary"}), (101, [5, 3, 6], {"highway": "residential"}), (102, [4, 7], {"highway": "primary", "toll": "yes"}), (103, [8, 9], {"highway": "tertiary", "oneway": "yes"}), (104, [1, 10], {"highway": "proposed"})]
RELATIONS = [(1, {"type": "restriction", "restriction": "no_left_turn"}, [("way", 100, "from"), ("node", 3, "via"), ("way", 101, "to")]), (2, {"restriction": "give_way"}, [("way", 100, "from")])]


@pytest.fixture(scope="module")
def pbf(tmp_path_factory):
    path = tmp_path_factory.mktemp("pbf") / "small.pbf"
    path.write_bytes(osm_pbf.encode(NODES, WAYS, RELATIONS))
    return str(path)


@pytest.fixture(scope="module")
def net(spark, pbf):
    return build.from_pbf(spark, pbf)


@pytest.mark.parametrize("dense", [True, False])
def test_pbf_rows(spark, tmp_path, dense):
    (tmp_path / "x.pbf").write_bytes(osm_pbf.encode(NODES, WAYS, RELATIONS, dense=dense))
    osm_pbf.register(spark)
    load = lambda kind: spark.read.format("osm_pbf").option("type", kind).load(str(tmp_path / "x.pbf"))
    assert sorted((r["id"], round(r["lat"], 7), round(r["lon"], 7), r["tags"]) for r in load("node").collect()) == NODES
    assert sorted((r["id"], r["node_refs"], r["tags"]) for r in load("way").collect()) == WAYS
    assert sorted((r["id"], r["tags"], [tuple(m) for m in r["members"]]) for r in load("relation").collect()) == RELATIONS


def test_pbf_by_any_address(spark, tmp_path):
    (tmp_path / "x y.pbf").write_bytes(osm_pbf.encode(NODES, WAYS, RELATIONS))
    osm_pbf.register(spark)
    for path in (f"{tmp_path}/x y.pbf", f"file://{tmp_path}/x y.pbf"):
        assert spark.read.format("osm_pbf").option("type", "way").load(path).count() == len(WAYS)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, getConf = "spark://host:7077", staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    monkeypatch.setattr(steps, "ship", lambda spark: None)
    with pytest.raises(ValueError, match="share"):
        steps.work_dir(Session)


def test_pbf_headers():
    with pytest.raises(ValueError, match="required"):
        osm_pbf.check_header(osm_pbf._put(4, b"HistoricalInformation"))
    with pytest.raises(ValueError, match="sorted"):
        osm_pbf.check_header(osm_pbf._put(4, b"DenseNodes"))


def test_segments_are_cut_at_shared_and_flagged_nodes(net):
    got = sorted((r["way_id"], r["dir"], r["from_node"], r["to_node"]) for r in net.edges.collect())
    assert got == sorted([(100, 1, 1, 3), (100, 1, 3, 4), (101, 1, 5, 3), (101, 1, 3, 6), (102, 1, 4, 7), (103, 1, 8, 9), (100, -1, 3, 1), (100, -1, 4, 3), (101, -1, 3, 5), (101, -1, 6, 3), (102, -1, 7, 4)])
    assert {len(r["points"]) for r in net.edges.where("way_id = 100 AND p0 = 0").collect()} == {3}


def test_turns_and_their_rules(net):
    e = {(r["from_node"], r["to_node"]): r["en_id"] for r in net.edges.collect()}
    t = {(r["from_en"], r["to_en"]): r for r in net.turns.collect()}
    straight, left, right, back = (t[e[1, 3], e[3, to]] for to in (4, 6, 5, 1))
    assert (straight["angle"], straight["mask"], straight["flags"]) == (0, 0, 1)
    assert (left["mask"], right["mask"]) == (31, 31) and left["angle"] in (-90, -89) and right["angle"] in (89, 90)
    assert back["mask"] == 0 and abs(back["angle"]) >= 179


def test_an_only_rule_forbids_the_other_ways_out(spark):
    relations = spark.createDataFrame([({"restriction": "only_straight_on"}, [("way", 100, "from"), ("node", 3, "via"), ("way", 100, "to")])], "tags map<string,string>, members array<struct<type:string,id:long,role:string>>")
    rule = network.restrictions(relations).first()
    assert (rule["from_way"], rule["via"], rule["to_way"], rule["only"]) == (100, 3, 100, True)


def test_missing_nodes_are_an_error(spark):
    node = spark.createDataFrame(NODES[:2], "id long, lat double, lon double, tags map<string,string>")
    way = spark.createDataFrame(WAYS[:1], "id long, node_refs array<long>, tags map<string,string>")
    none = spark.createDataFrame([], "tags map<string,string>, members array<struct<type:string,id:long,role:string>>")
    with pytest.raises(ValueError, match="don't exist"):
        build.from_tables(node, way, none)


def _places(spark, *points):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(points)], "loc long, lat double, lon double")


def test_snapping_keeps_ties_and_the_radius(spark, net):
    got = snap.snap(_places(spark, (48.0001, 11.0025), (0.0, 0.0), (48.0, 11.02)), net.edges).collect()
    at = {k: [r for r in got if r["loc"] == k] for k in range(3)}
    assert len(at[0]) == 2 and abs(sum(r["fraction"] for r in at[0]) - 1) < 1e-9 and {round(r["fraction"], 2) for r in at[0]} == {0.25, 0.75}
    assert not at[1] and len(at[2]) == 4 and {r["distance_m"] for r in at[2]} == {0.0}
    near = _places(spark, (48.0001, 11.0025)).withColumn("radius_m", F.lit(5.0))
    assert snap.snap(near, net.edges).count() == 0


def test_nearest_points(spark):
    points = spark.createDataFrame([(k, 48 + k / 1000, 11 + k / 1000) for k in range(1000)], "id long, lat double, lon double")
    assert [r["id"] for r in snap.nearest_points(_places(spark, (48.5, 11.5)), points, 100.0).collect()] == [500]
    assert [r["id"] for r in snap.nearest_points(_places(spark, (48.0009, 11.0009)), points.where("id < 2"), 1000.0).collect()] == [1]
    assert snap.nearest_points(_places(spark, (52.509, 13.4)), points, 100.0).count() == 0


def test_matrix(spark, net):
    at = _places(spark, (48.0, 11.0025), (48.0, 11.015), (48.2, 11.005), (48.0, 11.025))
    got = {(r["from"], r["to"]): (r["duration_ms"], r["length_m"]) for r in services.matrix(net, at, at).collect()}
    assert all(got[k, k] == (0, 0) for k in range(4))
    assert set(got) == {(k, k) for k in range(4)} | {(a, b) for a in (0, 1, 3) for b in (0, 1, 3) if a != b}
    e = {(r["from_node"], r["to_node"]): r["dist_m"] for r in net.edges.collect()}
    ahead, part = e[1, 3] - e[1, 3] // 4, e[3, 4] // 2
    assert abs(got[0, 1][1] - (ahead + part)) <= 1
    assert abs(got[0, 1][0] - (15_000 + (ahead + part) * 45)) <= 100
    free = {(r["from"], r["to"]): r["length_m"] for r in services.matrix(net, at, at, options=Options(avoid_toll=True)).collect()}
    assert free[0, 1] == got[0, 1][1] and free[0, 3] < got[0, 3][1]  # the nearest free road ends before the toll road
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "from long, to long")
    assert [(r["from"], r["to"]) for r in services.matrix(net, at, at, pairs).collect()] == [(0, 1)]


def test_routes_follow_their_snaps(spark, net):
    stops = _places(spark, (48.0, 11.0025), (48.0, 11.015), (48.0, 11.0025)).select(F.lit(7).cast("long").alias("trip"), F.col("loc").alias("pos"), "loc", "lat", "lon")
    out = sorted(services.route(net, stops).collect(), key=lambda r: r["leg"])
    assert [r["leg"] for r in out] == [0, 1]
    line = polyline.decode_points(out[0]["path"])
    assert line == [(48.0, 11.0025), (48.0, 11.005), (48.0, 11.01), (48.0, 11.015)]
    assert polyline.decode_points(out[1]["path"]) == line[::-1]
    assert round(out[0]["bounds"]["max_lon"], 6) == 11.015
    assert services.route(net, stops, with_path=False).first()["path"] is None
    total = services.trips(services.legs(net, stops)).first()
    assert total["n_legs"] == 2 and total["length_m"] == sum(r["length_m"] for r in out)
    with pytest.raises(services.InvalidRequest):
        services.route(net, stops.limit(1))


def test_isochrones(spark, net):
    at = _places(spark, (48.0, 11.0025))
    got = services.isochrone_points(net, at, [1.0, float("nan"), 0.6, 1.0, -2.0], "km").collect()
    assert {r["value"] for r in got} == {0.6, 1.0}
    assert {(round(r["lat"], 4), round(r["lon"], 4)) for r in got if r["value"] == 0.6} == {(48.0, 11.0), (48.0, 11.01)}
    ring = services.isochrone(net, at, [1.5], "km").first()["ring"]
    assert ring[0] == ring[-1] and len(ring) >= 3
    with pytest.raises(services.InvalidRequest):
        services.ranges_of([float("inf"), 0.0])


def test_locate_and_inspect(spark, net):
    at = _places(spark, (48.0001, 11.0025), (0.0, 0.0))
    got = {r["loc"]: r for r in services.locate(net, at, "mi", "Light").collect()}
    assert got[0]["way_meta"]["id"] == 100 and got[0]["way_meta"]["highway"] == "Primary" and len(got[0]["meta_points"]) == 2 and abs(got[0]["distance"] - 11.119 / 1609.344) < 1e-5
    assert got[1]["distance"] is None and (got[1]["lat"], got[1]["lon"]) == (0.0, 0.0) and got[1]["way_meta"] is None
    whole = services.locate(net, at, "km", "FullWay").where("loc = 0").first()
    assert len(whole["meta_points"]) == 4
    assert polyline.decode_points(services.inspect(net, 100).first()["path"]) == [(48.0, 11.0), (48.0, 11.005), (48.0, 11.01), (48.0, 11.02)]
    with pytest.raises(services.InvalidRequest):
        services.inspect(net, 999)


def _by_hand(edges, seeds, budget=None):
    out = {}
    for origin in {s[0] for s in seeds}:
        heap, best = [(c, m, e) for o, e, c, m in seeds if o == origin], {}
        heapq.heapify(heap)
        while heap:
            c, m, e = heapq.heappop(heap)
            if e in best or (budget is not None and c > budget):
                continue
            best[e] = (c, m)
            for to, cost, metres in edges[e]:
                heapq.heappush(heap, (c + cost, m + metres, to))
        out |= {(origin, e): x for e, x in best.items()}
    return out


@pytest.mark.parametrize("backend", ["arrow", "relational"])
@pytest.mark.parametrize("budget", [None, 60])
def test_both_searches_find_what_a_heap_finds(spark, backend, budget):
    r = random.Random(5)
    rows = list({(a, b): (a, b, r.randint(1, 20), r.randint(0, 5)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(200)) if a != b}.values())
    seeds = [(1, 0, 3, 1), (1, 5, 0, 0), (2, 7, 10, 2), (3, 999, 1, 1)]
    edges = defaultdict(list)
    for a, b, c, m in rows:
        edges[a].append((b, c, m))
    got = search.shortest_paths(spark.createDataFrame(rows, "from_en long, to_en long, cost long, metres long"), spark.createDataFrame(seeds, "origin long, en_id long, cost long, metres long"), budget, backend).collect()
    assert {(x["origin"], x["en_id"]): (x["cost"], x["metres"]) for x in got} == _by_hand(edges, seeds, budget)
    at = {(x["origin"], x["en_id"]): x for x in got}
    step = {(a, b): (c, m) for a, b, c, m in rows}
    for x in got:
        if x["pred"] >= 0:
            p, (c, m) = at[x["origin"], x["pred"]], step[x["pred"], x["en_id"]]
            assert (p["cost"] + c, p["metres"] + m) == (x["cost"], x["metres"])


def test_searches_go_together_and_are_dealt_to_many_tasks(spark):
    r = random.Random(9)
    step = {(a, b): (r.choice((0, 3, 7)), r.randint(0, 4)) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(260)) if a != b}
    edges = defaultdict(list)
    for (a, b), (c, m) in step.items():
        edges[a].append((b, c, m))
    seeds = [(o, o, 1, 2) for o in range(40)] + [(o, o + 40, 5, 0) for o in range(40)]
    want = _by_hand(edges, seeds)
    graph = spark.createDataFrame([(a, b, c, m) for (a, b), (c, m) in step.items()], "from_en long, to_en long, cost long, metres long")
    start = spark.createDataFrame(seeds, "origin long, en_id long, cost long, metres long")
    found = search.shortest_paths(graph, start).withColumn("task", F.spark_partition_id()).collect()
    assert {(x["origin"], x["en_id"]): (x["cost"], x["metres"]) for x in found} == want
    assert len({x["task"] for x in found}) > 4  # once one task, as the seeds are few bytes
    into = spark.createDataFrame([(g, 1000 + g, e, 2, 1) for g in range(10) for e in (g * 7 % 80, g * 11 % 80)], "goal long, goal_en long, from_en long, cost long, metres long")
    pairs = spark.createDataFrame([(o, o % 10) for o in range(40)], "origin long, goal long")
    ends = spark.createDataFrame([(k, 48.0, 11.0) for k in range(80)], "en_id long, lat double, lon double")
    least = {}
    for o, g in ((o, o % 10) for o in range(40)):
        if some := [(want[o, e][0] + 2, want[o, e][1] + 1) for e in (g * 7 % 80, g * 11 % 80) if (o, e) in want]:
            least[o, g] = min(some)
    first = {(o, e): (c, m) for o, e, c, m in seeds}
    for algorithm in (None, *search.ALGORITHMS):
        got = search.to_goals(graph, start, into, pairs, algorithm, ends).collect()
        assert {(x["origin"], x["goal"]): (x["cost"], x["metres"]) for x in got} == least
        for x in got:
            walk = [first[x["origin"], x["path"][0]], *(step[e] for e in zip(x["path"], x["path"][1:]))]
            assert (sum(c for c, _ in walk) + 2, sum(m for _, m in walk) + 1) == (x["cost"], x["metres"]) and x["path"][-1] == x["last_en"]


def test_countries(spark, tmp_path):
    square = lambda y, x, n: [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"ISO_A2": "DE"}, "geometry": {"type": "Polygon", "coordinates": [square(47.95, 10.95, 0.5), square(48.1, 11.1, 0.1)]}},
        {"properties": {"ISO_A2": "AT"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(40.0, 10.0, 1.0)], [square(45.0, 10.0, 1.0)]]}},
        {"properties": {"ISO_A2": "-99"}, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 1)]}},
    ]}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    borders = files.geojson_borders(spark, str(tmp_path / "b.json"))
    assert borders.count() == 3
    points = spark.createDataFrame([(1, 48.0, 11.0), (2, 48.15, 11.15), (3, 40.5, 10.5), (4, 45.01, 10.99), (5, 60.0, 10.0), (6, 0.5, 0.5)], "id long, lat double, lon double")
    for size in (0.1, 0.03, 1.0):
        got = {r["id"]: r["country"] for r in country.countries(points, country.raster(borders, size), size).collect()}
        assert got == {1: "DE", 2: None, 3: "AT", 4: "AT", 5: None, 6: None}
    assert [(r["country"], r["country_id"]) for r in country.iso_ids(borders).collect()] == [("AT", 1), ("DE", 2)]


def test_a_network_survives_its_tables(spark, net, tmp_path):
    files.write_network(net, str(tmp_path / "net"), 2)
    again = files.read_network(spark, str(tmp_path / "net"))
    at = _places(spark, (48.0, 11.0025), (48.0, 11.015))
    assert sorted(map(tuple, services.matrix(again, at, at).collect())) == sorted(map(tuple, services.matrix(net, at, at).collect()))


def test_requests_and_problems(net):
    a, b = {"lat": 48.0, "lon": 11.0025, "id": "x"}, {"lat": 48.0, "lng": 11.015}
    ask = lambda kind, **r: api.answer(net, kind, json.dumps(r))
    assert ask("info") == (200, {"status": "Ok", "version": services.VERSION, "profiles": ["car", "hgv", "bike", "foot"]})
    status, out = ask("route", locations=[a, b], algorithm="dijkstra", id="r1")
    assert status == 200 and out["id"] == "r1" and len(out["legs"]) == 1 and out["duration"] == out["legs"][0]["duration"]
    assert out["legs"] == ask("route", locations=[a, b], algorithm="a_star")[1]["legs"]
    assert ask("route", locations=[a, {"lat": 48.2, "lon": 11.005}])[1]["legs"] == []
    status, out = ask("matrix", **{"from": [a], "to": [a, b]}, units="mi", pairs=[[0, 1], [0, 0]])
    assert status == 200 and [(r["from"], r["to"]) for r in out["result"]] == [(0, 1), (0, 0)]
    status, out = ask("locate", locations=[a, {"lat": 0, "lon": 0}], with_meta="FullEdge")
    assert status == 200 and out["locations"][0]["id"] == "x" and "distance" not in out["locations"][1]
    assert ask("isochrone", lat=48.0, lon=11.0025, ranges=[1.5])[0] == 200
    assert ask("inspect", way_id=100) == (200, {"points": polyline.encode_points([x[1:3] for x in NODES[:4]]), "way": {"id": 100, "max_speed": 0, "highway": "Primary", "surface_quality": "Unknown"}})
    for kind, request, code in [("inspect", {"way_id": 1}, 400), ("route", {"locations": [a]}, 400), ("route", {}, 400), ("matrix", {"locations": [a], "pairs": [[0, 5]]}, 400), ("route", {"locations": [a, b], "profile": "tank"}, 404), ("isochrone", {"lat": 0, "lon": 0, "ranges": [1]}, 404), ("isochrone", {"lat": 48.0, "lon": 11.0, "ranges": [-1]}, 400), ("nothing", {}, 404)]:
        status, out = ask(kind, **request)
        assert (status, out["status"]) == (code, code), (kind, request)
    assert api.answer(net, "route", "no json")[0] == 400


def test_server(net):
    server = api.serve(net, "127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{base}/api/v1/info"))["status"] == "Ok"
    assert set(json.load(urllib.request.urlopen(f"{base}/openapi.json"))["paths"]) == {f"/api/v1/{k}" for k in api.ENDPOINTS}
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(f"{base}/api/v1/route", data=b"{}"))
    assert e.value.code == 400 and e.value.headers["Content-Type"] == "application/problem+json"
    server.shutdown()


def test_the_open_api_command(capsys):
    assert api.main(["open-api"]) == 0
    assert json.loads(capsys.readouterr().out)["openapi"] == "3.1.0"


def test_a_stream_is_snapped(spark, net, tmp_path):
    from strada.streaming.snapping import snap_stream

    at = _places(spark, (48.0001, 11.0025), (0.0, 0.0))
    at.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(at.schema).parquet(str(tmp_path / "in"))
    snap_stream(stream, net, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert {r["loc"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {0}


def test_ways_on_one_segment_merge_in_arrays(monkeypatch):
    """All goals of an origin were once turned into Python's numbers for the few that lie on its segment."""
    at = {"goal": [2, 5, 6, 9], "w": [7, 7, 7, 7], "to_en": [1, 2, 3, 4], "last_en": [11, 12, 13, 14]}
    along = [{"goal": g, "w": w, "to_en": e} for g, w, e in [(2, 8, 0), (5, 7, 2), (6, 7, 4), (9, 6, 8), (9, 6, 7), (1, 5, 5), (12, 3, 6)]]
    want = sorted([(1, 5, 5, None), (2, 7, 1, 11), (5, 7, 2, None), (6, 7, 3, 13), (9, 6, 7, None), (12, 3, 6, None)])
    for near, kind in ((along, list), (along, np.array)):
        got = search._answers(0, *(kind(x) for x in at.values()), None, near).to_pydict()
        assert sorted(zip(*(got[c] for c in at), strict=True)) == want and set(got["path"]) == {None}
    empty = np.zeros(0, dtype=np.int64)
    assert search._answers(0, empty, empty, empty, empty, None, along[-1:]).column("goal").to_pylist() == [12]


def test_a_route_snaps_its_stops_once(net, spark, monkeypatch):
    times = []
    monkeypatch.setattr(services, "snapped", lambda n, places, o, f=services.snapped: times.append(1) or f(n, places, o))
    stops = spark.createDataFrame([(1, 0, 1, 48.0, 11.001), (1, 1, 2, 48.0, 11.009)], "trip long, pos long, loc long, lat double, lon double")
    services.route(net, stops, services.Options("car"))
    assert len(times) == 1


def test_places_alike_are_searched_once(net, spark, monkeypatch):
    """Every location was once searched for itself, also where many lie on the same point."""
    asked = []
    monkeypatch.setattr(search, "to_goals", lambda graph, seeds, into, pairs, *more, f=search.to_goals: asked.append((seeds.select("origin").distinct().count(), pairs and pairs.count())) or f(graph, seeds, into, pairs, *more))
    points = [(48.0, 11.0025), (48.0, 11.015), (48.0, 11.025)]
    few, many = _places(spark, *points), _places(spark, *points * 5)
    once = {(r["from"], r["to"]): (r["duration_ms"], r["length_m"]) for r in services.matrix(net, few, few).collect()}
    assert len(once) == 9
    got = {(r["from"], r["to"]): (r["duration_ms"], r["length_m"]) for r in services.matrix(net, many, many).collect()}
    assert got == {(a, b): once[a % 3, b % 3] for a in range(15) for b in range(15)}
    stops = many.select(F.lit(1).cast("long").alias("trip"), F.col("loc").alias("pos"), "loc", "lat", "lon")
    for algorithm in search.ALGORITHMS[:2]:
        legs = services.legs(net, stops, Options(algorithm=algorithm)).collect()
        assert {(r["leg"], r["from"], r["to"]): (r["duration_ms"], r["length_m"]) for r in legs} == {(k, k, k + 1): once[k % 3, (k + 1) % 3] for k in range(14)}
    assert len(legs) == 14 and asked == [(3, None), (3, None)] + [(3, 3)] * 2


def test_points_alike_are_snapped_once(net, spark, monkeypatch):
    asked = []
    monkeypatch.setattr(snap, "snap", lambda locations, *more, f=snap.snap, **named: asked.append(locations.count()) or f(locations, *more, **named))
    rows = [(1, 48.0, 11.0025, 900.0), (2, 48.0, 11.0025, 900.0), (3, 48.0, 11.0025, None), (4, 48.0, 11.0025, None), (5, 48.001, 11.0025, 50.0), (6, None, 11.0, None), (1, 48.0, 11.0025, 900.0), (7, 48.0, 11.015, 9.0), (7, 48.0, 11.0025, 900.0)]
    at = spark.createDataFrame(rows, "loc long, lat double, lon double, radius_m double")
    got = sorted(services.snapped(net, at, Options("car")).select("loc", "en_id", "distance_m").collect())
    assert got == sorted(snap.snap(at, services._usable(net, Options("car"))).select("loc", "en_id", "distance_m").collect())
    assert {r["loc"] for r in got} == {1, 2, 3, 4, 7} and asked == [6, 9]


def test_origins_with_the_same_seeds_share_a_search(spark, monkeypatch):
    """Every origin was once searched for itself; shared or not, the rows are those of a heap."""
    r = random.Random(3)
    step = {(a, b): (r.randint(1, 9), r.randint(0, 4)) for a, b in ((r.randrange(50), r.randrange(50)) for _ in range(150)) if a != b}
    edges = defaultdict(list)
    for (a, b), (c, m) in step.items():
        edges[a].append((b, c, m))
    seeds = [(o, e, 1 + o % 3, 2) for o in range(150) for e in (o % 3, 20 + o % 3, 900)] + [(0, 0, 1, 2), (200, 7, 0, 0), (201, 901, 4, 4)]
    want = _by_hand(edges, seeds)
    graph = spark.createDataFrame([(a, b, c, m) for (a, b), (c, m) in step.items()], "from_en long, to_en long, cost long, metres long")
    start = spark.createDataFrame(seeds, "origin long, en_id long, cost long, metres long")
    assert search._by_seeds(start.withColumn("w", search.weight(F.col("cost"), F.col("metres")))).count() == 5
    for together, shared, preds in ((64, 1 << 16, True), (7, 20, False)):
        monkeypatch.setattr(search, "TOGETHER", together)
        monkeypatch.setattr(search, "SHARED", shared)
        got = search.shortest_paths(graph, start, preds=preds).collect()
        assert len(got) == len(want) and {(x["origin"], x["en_id"]): (x["cost"], x["metres"]) for x in got} == want
        assert all((x["pred"] is not None) == preds or x["en_id"] >= 900 for x in got)
    lists = list(search._found([[1, 2, 3], [4]], np.repeat([0, 1], [50, 9]), np.arange(59), np.arange(59) * search.METRES + 7, None))
    assert all(len(o) * len(e) <= search.SHARED for b in lists for o, e in zip(b["origins"].to_pylist(), b["en"].to_pylist(), strict=True))
    assert [(c, m) for b in lists for x, y in zip(b["costs"].to_pylist(), b["lengths"].to_pylist(), strict=True) for c, m in zip(x, y, strict=True)] == [(k, 7) for k in range(59)]


def test_searches_are_dealt_where_a_shuffle_has_as_many_tasks(spark):
    """Dealt by origin, as they are grouped, all searches to goals lay in one task, which the seeds' few bytes filled."""
    graph = spark.createDataFrame([(k, k + 1, 2, 1) for k in range(40)], "from_en long, to_en long, cost long, metres long")
    start = spark.createDataFrame([(o, o, 1, 0) for o in range(40)], "origin long, en_id long, cost long, metres long")
    into = spark.createDataFrame([(7, 41, 40, 3, 3)], "goal long, goal_en long, from_en long, cost long, metres long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 4 * spark.sparkContext.defaultParallelism)
    try:
        for pairs in (None, start.select("origin", F.lit(7).cast("long").alias("goal"))):
            got = search.to_goals(graph, start, into, pairs).withColumn("task", F.spark_partition_id()).collect()
            assert {x["origin"]: (x["cost"], x["metres"]) for x in got} == {o: (1 + 2 * (40 - o) + 3, 40 - o + 3) for o in range(40)}
            assert len({x["task"] for x in got}) > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_all_pairs_are_laid_out_from_lists(net, spark, monkeypatch):
    """Each pair of locations was once a row of a join."""
    monkeypatch.setattr(search, "TOGETHER", 2)
    points = [(48.0, 11.0025), (48.0, 11.015)]
    once = {(r["from"], r["to"]): r["duration_ms"] for r in services.matrix(net, _places(spark, *points), _places(spark, *points)).collect()}
    many = _places(spark, *points * 5)
    got = services.matrix(net, many, many)
    rows = got.collect()
    assert len(rows) == 100 and {(r["from"], r["to"]): r["duration_ms"] for r in rows} == {(a, b): once[a % 2, b % 2] for a in range(10) for b in range(10)}
    assert "explode(tos" in got._jdf.queryExecution().optimizedPlan().toString()


def test_what_many_origins_share_is_searched_in_parts(spark, monkeypatch):
    """Each task once gave the labels of whole searches, origin by origin, which makes larger files."""
    step = {(a, b): (2 + a % 3, 1) for a in range(50) for b in (a + 1, (a * 7 + 3) % 50) if a != b}
    edges = defaultdict(list)
    for (a, b), (c, m) in step.items():
        edges[a].append((b, c, m))
    seeds = [(o, e, 1, 2) for o in range(20) for e in (o % 2, 900)] + [(77, 5, 0, 0), (78, 901, 4, 4)]
    want = _by_hand(edges, seeds)
    graph = spark.createDataFrame([(a, b, c, m) for (a, b), (c, m) in step.items()], "from_en long, to_en long, cost long, metres long")
    start = spark.createDataFrame(seeds, "origin long, en_id long, cost long, metres long")
    monkeypatch.setattr(search, "PART", 20)
    monkeypatch.setattr(search, "PARTED", 8)
    lists = search._in_parts(search._by_seeds(start.withColumn("w", search.weight(F.col("cost"), F.col("metres")))), 3)
    assert sorted((len(x["origins"]), x["part"], x["parts"]) for x in lists.collect()) == [(1, 0, 1)] * 2 + sorted((10, k, 3) for k in (0, 1, 2) * 2)
    got = search.shortest_paths(graph, start).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) and {(x["origin"], x["en_id"]): (x["cost"], x["metres"]) for x in got} == want
    runs = [k for k, x in enumerate(got) if not k or (x["task"], x["en_id"]) != (got[k - 1]["task"], got[k - 1]["en_id"])]
    assert len(runs) < len(got) / 5  # of 10 origins that share a search, a label's rows lie together
    assert len({x["task"] for x in got if x["origin"] == 0}) == 3
    within = {(x["origin"], x["en_id"]): (x["cost"], x["metres"]) for x in search.shortest_paths(graph, start, 9).collect()}
    assert within == _by_hand(edges, seeds, 9)
