"""Requests in, responses out: the six endpoints as functions of a request object, and an HTTP server and command over them."""

from __future__ import annotations

import argparse
import json
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from strada.functions import polyline
from strada.operators import cost
from strada.operators.search import ALGORITHMS
from strada.plans import services
from strada.plans.services import InvalidRequest, Network, Options
from strada.sources import files

PREFIX = "/api/v1"


def _options(net: Network, request: dict) -> Options:
    cost.profile(request.get("profile"))
    if (a := str(request.get("algorithm", "bidir_a_star")).lower()) not in ALGORITHMS:
        raise InvalidRequest(f"unknown algorithm: {a}")
    return Options(request.get("profile"), "time", bool(request.get("avoid_toll")), bool(request.get("avoid_ferry")), net.max_radius_m, algorithm=a if "algorithm" in request else None)


def _head(request: dict) -> dict:
    out = {"profile": cost.profile(request.get("profile")).name, "units": request.get("units", "km")}
    return out | ({"id": request["id"]} if request.get("id") is not None else {})


def _need(request: dict, *keys: str) -> None:
    if missing := [k for k in keys if k not in request]:
        raise InvalidRequest(f"missing: {', '.join(missing)}")


def _all(df, limit: int = 1_000_000) -> list[dict]:
    """A response is one document; what a request asks for bounds it."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise InvalidRequest("the response would be too large; use the DataFrame functions")
    return [r.asDict(recursive=True) for r in rows]


def _duration(ms: int) -> dict:
    return {"secs": ms // 1000, "nanos": ms % 1000 * 1_000_000}


def _bounds(b: dict | None) -> dict | None:
    return b and {"min": {"lat": b["min_lat"], "lon": b["min_lon"]}, "max": {"lat": b["max_lat"], "lon": b["max_lon"]}}


def _told(meta: dict) -> dict:
    """A description without what is unknown, absent or unlimited."""
    return {k: v for k, v in meta.items() if v is not None and v is not False and not (v == 0 and k.startswith("max_") and k != "max_speed")}


def _location(p: dict) -> dict:
    return {"lat": p["lat"], "lon": p["lon"], **{k: p[k] for k in ("radius", "id") if p[k] is not None}, **p["extra"]}


def info(net: Network, request: dict) -> dict:
    return _all(services.info(net.spark))[0]


def locate(net: Network, request: dict) -> dict:
    _need(request, "locations")
    unit = request.get("units", "km")
    at = files.locations(net.spark, request["locations"], unit)
    found = services.locate(net, at, unit, request.get("with_meta", "None"), _options(net, request))
    given = files.places(request["locations"])
    rows = sorted(_all(found), key=lambda r: r["loc"])
    shown = lambda k, v: _told(v) if k in ("way_meta", "edge_meta") else polyline.encode_points((q["lat"], q["lon"]) for q in v) if k == "meta_points" else v
    return _head(request) | {"locations": [_location(g) | {k: shown(k, v) for k, v in r.items() if v is not None and k not in ("loc", "id", "extra", "radius_m")} for g, r in zip(given, rows, strict=True)]}


def matrix(net: Network, request: dict) -> dict:
    unit = request.get("units", "km")
    if "locations" in request:
        a = b = files.locations(net.spark, request["locations"], unit)
        n = m = len(files.places(request["locations"]))
    else:
        _need(request, "from", "to")
        a, b = (files.locations(net.spark, request[k], unit) for k in ("from", "to"))
        n, m = (len(files.places(request[k])) for k in ("from", "to"))
    pairs = [tuple(p) for p in request.get("pairs", [])]
    services.check_pairs(pairs, n, m)
    wanted = net.spark.createDataFrame(pairs, "from long, to long") if pairs else None
    found = services.matrix(net, a, b, wanted, _options(net, request))
    per = 1609.344 if unit == "mi" else 1000.0
    rows = _all(found.select("from", "to", F.col("duration_ms").alias("duration"), (F.col("length_m") / per).alias("length")))
    place = {p: k for k, p in enumerate(pairs)}
    rows.sort(key=lambda r: (place.get((r["from"], r["to"]), 0), r["from"], r["to"]))
    ends = {"from": request.get("locations", request.get("from")), "to": request.get("locations", request.get("to"))}
    return _head(request) | {k: [_location(p) for p in files.places(v)] for k, v in ends.items()} | {"result": [r | {"duration": _duration(r["duration"])} for r in rows]}


def route(net: Network, request: dict) -> dict:
    _need(request, "locations")
    stops = files.locations(net.spark, request["locations"], request.get("units", "km"))
    if len(files.places(request["locations"])) < 2:
        raise InvalidRequest("a route needs two locations")
    stops = stops.select(F.lit(0).cast("long").alias("trip"), F.col("loc").alias("pos"), "loc", "lat", "lon")
    legs = sorted(_all(services.route(net, stops, _options(net, request), bool(request.get("with_path", True)))), key=lambda r: r["leg"])
    out = [{"duration": _duration(r["duration_ms"]), "length": r["length_m"], "bounds": _bounds(r["bounds"]), **({"path": r["path"]} if r["path"] else {})} for r in legs]
    b = [r["bounds"] for r in legs]
    bounds = {k: (min if k.startswith("min") else max)(x[k] for x in b) for k in b[0]} if b else None
    at = [_location(p) for p in files.places(request["locations"])]
    return _head(request) | {"locations": at, "duration": _duration(sum(r["duration_ms"] for r in legs)), "length": sum(r["length_m"] for r in legs), "bounds": _bounds(bounds), "legs": out}


def isochrone(net: Network, request: dict) -> dict:
    _need(request, "lat", "ranges")
    unit = request.get("unit", "km")
    if unit not in ("km", "mi", "min"):
        raise InvalidRequest(f"unknown unit: {unit}")
    at = files.locations(net.spark, [request])
    if services.snapped(net, at, _options(net, request)).limit(1).count() == 0:
        raise services.LocationNotFound("no road near the location")
    rows = _all(services.isochrone(net, at, request["ranges"], unit, _options(net, request)))
    return {"profile": cost.profile(request.get("profile")).name, "unit": unit, "ranges": [{"value": r["value"], "polygon": r["polygon"]} for r in sorted(rows, key=lambda r: r["value"])]}


def inspect(net: Network, request: dict) -> dict:
    _need(request, "way_id")
    found = _all(services.inspect(net, int(request["way_id"])))[0]
    return {"points": found["path"], "way": _told(found["way_meta"])}


ENDPOINTS = {"info": info, "locate": locate, "route": route, "inspect": inspect, "matrix": matrix, "isochrone": isochrone}


def answer(net: Network, endpoint: str, text: str = "{}") -> tuple[int, dict]:
    """(status, document); an error is a problem document with its status."""
    if endpoint not in ENDPOINTS:
        return 404, {"type": "about:blank", "title": "NotFound", "status": 404, "detail": endpoint}
    try:
        return 200, ENDPOINTS[endpoint](net, files.read_request(text or "{}"))
    except (ValueError, LookupError) as e:
        out = services.problem(e)
        return out["status"], out


def openapi() -> dict:
    """The description of the endpoints."""
    what = {"info": "Status, version and profiles", "locate": "Nearest places on roads", "route": "Paths through locations", "inspect": "A way and its line", "matrix": "Times and lengths between locations", "isochrone": "What can be reached within ranges"}
    reply = {"200": {"description": "OK", "content": {"application/json": {}}}, "default": {"description": "Problem", "content": {"application/problem+json": {}}}}
    return {"openapi": "3.1.0", "info": {"title": "Road network", "version": services.VERSION}, "paths": {f"{PREFIX}/{k}": {"get" if k == "info" else "post": {"summary": v, "responses": reply}} for k, v in what.items()}}


def serve(net: Network, host: str, port: int) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, document: dict) -> None:
            body = json.dumps(document).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json" if status == 200 else "application/problem+json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            if self.path == "/openapi.json":
                self._reply(200, openapi())
            else:
                self._reply(*answer(net, self.path.removeprefix(f"{PREFIX}/") if self.path == f"{PREFIX}/info" else ""))

        def do_POST(self):
            text = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            self._reply(*answer(net, self.path.removeprefix(f"{PREFIX}/") if self.path.startswith(f"{PREFIX}/") else "", text))

        def log_message(self, *args):
            pass

    return HTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strada")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("serve", "route", "open-api"):
        sub.add_parser(name)
    sub.add_parser("import").add_argument("pbf")
    a = p.parse_args(argv)
    if a.command == "open-api":
        print(json.dumps(openapi()))
        return 0
    from pyspark.sql import SparkSession

    spark, conf = SparkSession.builder.getOrCreate(), files.config(a.config)
    if a.command == "import":
        from strada.plans.build import from_pbf

        files.write_network(from_pbf(spark, a.pbf, conf), conf["storage"]["dir"])
        return 0
    from strada.plans.build import configured

    net = configured(files.read_network(spark, conf["storage"]["dir"]), conf)
    if a.command == "route":
        status, out = answer(net, "route", sys.stdin.read())
        print(json.dumps(out))
        return int(status != 200)
    serve(net, conf["server"]["host"], int(conf["server"]["port"])).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
