"""Shortest paths over segments and turns, from many origins at once.

The graph is (from_en, to_en, cost, metres): a turn and the whole of the segment it leads to. Paths are least in cost and,
of equal cost, in metres; ties of both take the smallest predecessor. Both numbers travel as one long, the weight.

Two back-ends keep one contract. `arrow` searches many origins together, in arrays over a broadcast adjacency; in
shortest_paths() origins with the same seeds share a search, and the JVM lays out its labels for each of them, a label's rows together
(_in_parts() says how large graphs are dealt). It is used while the graph has at most BROADCAST_TURNS turns (counted, not assumed). `relational` relaxes all origins' frontiers by a join
and a minimum per round, writing what a round improves in the shared folder; it has no such bound.

shortest_paths() reaches whatever a budget allows; to_goals() stops as soon as all goals wanted from an origin are settled.
A single goal can be searched by four algorithms that find the same weight: dijkstra, a_star, and both from the two ends at
once. A* needs the segments' ends; its bound is the straight line (the chord) times the least cost per metre of any turn and segment in
the graph, so it holds for every profile and model.

Cases. A seed on a segment without turns is reached and leads nowhere. Null costs, no turns, no seeds or no goals give no
rows; repeated seeds count once, at their least weight; a goal that can't be reached has no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strada.steps import materialize, work_dir

ALGORITHMS = ("dijkstra", "bidir_dijkstra", "a_star", "bidir_a_star")
BROADCAST_TURNS, BROADCAST_GOALS, METRES = 5_000_000, 1_000_000, 10_000_000
#: No label; places for the labels of the searches that a worker advances together; rise of their limits, in mean steps of weight, doubled.
INF, PLACES, STEP = 1 << 60, 3_000_000, 4.0
#: Origins that share a search; rows that a line of lists, some origins by some labels, makes at most.
TOGETHER, SHARED = 64, 1 << 16
#: Segments of a part, whose numbers and costs a Parquet dictionary of 1 MB holds; origins for which a search is made once a part; tasks at most.
PART, PARTED, MOST_TASKS = 120_000, 16, 20_000
#: Rounds of the relational back-end after which its improvements are merged into one table.
MERGE = 8
SCHEMA = "origin long, en_id long, cost long, metres long, pred long"


def weight(cost, metres):
    return cost.cast("long") * METRES + metres.cast("long")


def _unpacked(df: DataFrame) -> DataFrame:
    return df.select("origin", "en_id", F.floor(F.col("w") / METRES).cast("long").alias("cost"), (F.col("w") % METRES).alias("metres"), "pred")


class Adjacency:
    """The graph as arrays: each segment's out-turns in one run, and its in-turns in another; ends: (en_id, lat, lon), for A*.

    Many searches advance together, one a row: labels stand in one flat array, a round relaxes at once all labels whose key
    is below its row's limit, and when none is left, all limits rise by one step. So keys below the limit are settled, as
    with a heap, and a round is a few operations on arrays.
    """

    def __init__(self, t: pa.Table, ends: pa.Table | None = None):
        a, b, w = (t[c].to_numpy() for c in ("from_en", "to_en", "w"))
        self.ids = np.unique(np.concatenate([a, b])) if len(a) else np.zeros(0, dtype=np.int64)
        a, b, n = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b), len(self.ids)
        self.out, self.back = self._side(a, b, w, n), self._side(b, a, w, n)
        self.place, self.rate = None, 0.0
        if ends is not None and len(a):
            ids, order = np.unique(ends["en_id"].to_numpy(), return_index=True)
            at = order[np.minimum(np.searchsorted(ids, self.ids), len(ids) - 1)]
            lat, lon = (np.radians(ends[c].to_numpy()[at]) for c in ("lat", "lon"))
            self.place = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
            far = np.sqrt(((self.place[a] - self.place[b]) ** 2).sum(axis=1))
            apart = far > 0
            self.rate = float(((w // METRES)[apart] / far[apart]).min()) * (1 - 1e-6) if apart.any() else 0.0

    def __getstate__(self):
        """What is broadcast: without the arrays that a worker's searches share."""
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @staticmethod
    def _side(a, b, w, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        return tuple(np.asarray(x, dtype=np.int64) for x in (np.searchsorted(a[order], np.arange(n + 1)), b[order], w[order]))

    def _turns(self, two: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The out-turns; for searches from both ends the in-turns follow, as a graph of their own."""
        if not two:
            return self.out
        if "_both" not in self.__dict__:
            (s, to, w), (s2, to2, w2) = self.out, self.back
            self._both = np.concatenate([s[:-1], s2 + len(to)]), np.concatenate([to, to2 + len(self.ids)]), np.concatenate([w, w2])
        return self._both

    def _space(self, size: int, preds: bool) -> None:
        """Labels, all INF, room to tell doubles, and predecessors, in at least size places."""
        if len(self.__dict__.get("_dist", ())) < size:
            self._dist, self._stamp = np.full(size, INF, dtype=np.int64), np.empty(size, dtype=np.int32)
        if preds and len(self.__dict__.get("_pred", ())) < size:
            self._pred = np.empty(size, dtype=np.int64)

    def rows(self, two: bool = False) -> int:
        """How many searches go together."""
        return max(1, min(256, PLACES // max(1, len(self.ids) * (1 + two))))

    def numbers(self, en) -> np.ndarray:
        """The segments' numbers, -1 of those without turns."""
        en = np.asarray(en, dtype=np.int64)
        if not len(self.ids):
            return np.full(len(en), -1, dtype=np.int64)
        k = np.minimum(np.searchsorted(self.ids, en), len(self.ids) - 1)
        return np.where(self.ids[k] == en, k, -1)

    def _heights(self, m: int, seeds, into, two: bool):
        """A function of flat places: what A* adds to their doubled weights. From both ends the average of the bounds keeps turns from getting negative."""
        points = []
        for r, k, _ in ((into, seeds) if two else (into,)):
            pairs = np.unique(np.stack([r, k], axis=1), axis=0)
            nth = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
            each = np.full((m, int(nth.max(initial=0)) + 1, 3), 9.0)  # farther than any other
            each[pairs[:, 0], nth] = self.place[pairs[:, 1]]
            points.append(each)
        n, rate = len(self.ids), self.rate

        def bound(xyz, targets):
            far = np.full(len(xyz), np.inf)
            for k in range(targets.shape[1]):
                d = xyz - targets[:, k]
                np.minimum(far, np.einsum("ij,ij->i", d, d), out=far)
            return (np.sqrt(far) * rate).astype(np.int64) * METRES

        def heights(f):
            side = f // n
            r = side // (1 + two)
            xyz = self.place[f - side * n]
            if not two:
                return 2 * bound(xyz, points[0][r])
            h = bound(xyz, points[0][r]) - bound(xyz, points[1][r])
            return np.where(side % 2 == 0, h, -h)

        return heights

    def search(self, m: int, seeds, budget: int | None = None, ways=None, algorithm: str | None = None, preds: bool = False) -> tuple:
        """(flat places reached, and of searches from both ends the least weight and the place where they meet, by row).

        m rows at once; seeds: arrays (row, number, weight); budget bounds the cost. ways: arrays (slot, row, number, weight
        from there), sorted by slot: what is to be settled, a row ends with the last of its slots. algorithm: one of
        ALGORITHMS, then a row has one slot. The labels stand in _dist, at row * len(ids) + number (twice that many places a
        row from both ends), and predecessors, also flat, in _pred; forget() clears the places reached.
        """
        two, n = bool(algorithm) and algorithm.startswith("bidir"), len(self.ids)
        sides = 1 + two
        wide = n * sides
        starts, to, step = self._turns(two)
        self._space(m * wide, preds)
        dist, stamp, pred = self._dist, self._stamp, self._pred if preds else None
        most = INF - 1 if budget is None else (budget + 1) * METRES - 1
        least, meet, alive = np.full(m, INF, dtype=np.int64), np.full(m, -1, dtype=np.int64), np.ones(m, dtype=bool)
        f, x = seeds[0] * wide + seeds[1], seeds[2]
        into = None if ways is None or algorithm is None else (ways[1], ways[2], ways[3])
        if two:
            f, x = np.concatenate([f, into[0] * wide + n + into[1]]), np.concatenate([x, into[2]])
            ways = None
        f, x = f[x <= most], x[x <= most]
        np.minimum.at(dist, f, x)
        f = np.unique(f)
        touched = [f]
        if preds:
            pred[f] = -1
        zero = lambda f: 0
        height = self._heights(m, seeds, into, two) if self.place is not None and algorithm and algorithm.endswith("a_star") else zero
        limit = np.full(m * sides, INF, dtype=np.int64)
        x = dist[f]
        key = 2 * x + height(f)
        np.minimum.at(limit, f // n, key)
        if two:  # without seeds on one side there is no path
            alive = (limit.reshape(m, 2) < INF).all(axis=1)
            mate = f[(f // n) % 2 == 0]
            s = dist[mate] + dist[mate + n]
            np.minimum.at(least, mate // wide, s)
            hit = (s < INF) & (s == least[mate // wide])
            meet[mate[hit] // wide] = mate[hit]
        width = max(1, int(STEP * step.mean())) if len(step) else 1
        limit[limit < INF] += width
        if ways is not None and len(ways[0]):
            heads = np.flatnonzero(np.diff(ways[0], prepend=-1))
            slot_row, goals = ways[1][heads], ways[1] * wide + ways[2]
        held = [(f, x, key)]
        while True:
            f, x, key = (np.concatenate(c) for c in zip(*held, strict=True))
            use = (dist[f] == x) & alive[f // wide]
            f, x, key = f[use], x[use], key[use]
            if not len(f):
                break
            gap = key - limit[f // n]
            now = gap < 0
            held = [(f[~now], x[~now], key[~now])]
            f, x = f[now], x[now]
            if not len(f):
                limit[limit < INF] += (int(gap.min()) // width + 1) * width
            while len(f):
                base = f // wide * wide
                k = f - base
                first = starts[k]
                count = starts[k + 1] - first
                ends = np.cumsum(count)
                at = np.repeat(np.arange(len(f)), count)
                j = np.arange(len(at)) + (first - ends + count)[at]
                v, y = to[j] + base[at], step[j] + x[at]
                was = dist[v]
                better = (y < was) if budget is None else (y < was) & (y <= most)
                v, y, was, at = v[better], y[better], was[better], at[better]
                if not len(v):
                    break
                np.minimum.at(dist, v, y)
                order = np.arange(len(v), dtype=np.int32)
                won = np.flatnonzero(dist[v] == y)
                stamp[v[won]] = order[won]
                won = won[stamp[v[won]] == order[won]]
                v, y, was = v[won], y[won], was[won]
                if preds:
                    pred[v] = f[at[won]]
                touched.append(v[was == INF])
                side = v // n
                if two:
                    other = np.where(side % 2 == 0, v + n, v - n)
                    s, r = y + dist[other], side // 2
                    np.minimum.at(least, r, s)
                    hit = (s < INF) & (s == least[r])
                    meet[r[hit]] = np.minimum(v[hit], other[hit])
                new = 2 * y + height(v)
                now = new < limit[side]
                held.append((v[~now], y[~now], new[~now]))
                f, x = v[now], y[now]
            if two:
                tops = limit.reshape(m, 2).sum(axis=1)
                alive &= tops < 2 * least
            elif ways is not None and len(ways[0]):
                last = np.zeros(m, dtype=np.int64)
                np.maximum.at(last, slot_row, np.minimum.reduceat(dist[goals] + ways[3], heads))
                alive &= limit < 2 * last
            elif ways is not None:
                break
            limit[limit < INF] += width
        return np.concatenate(touched), least, meet

    def forget(self, touched: np.ndarray) -> None:
        self._dist[touched] = INF

    def before(self, v: np.ndarray, seeds, wide: int) -> np.ndarray:
        """The smallest predecessor on a least path to each flat place v of a search with preds, flat; -1 where a path begins."""
        starts, to, step = self.back
        base = v // wide * wide
        first = starts[v - base]
        count = starts[v - base + 1] - first
        at = np.repeat(np.arange(len(v)), count)
        j = np.arange(len(at)) + (first - np.cumsum(count) + count)[at]
        u = to[j] + base[at]
        tight = (self._dist[u] + step[j] == self._dist[v][at]) & (step[j] > 0)  # a step of no weight could lead in a circle
        least = np.full(len(v), INF, dtype=np.int64)
        np.minimum.at(least, at[tight], u[tight])
        out = np.where(least < INF, least, self._pred[v])
        start = seeds[0] * wide + seeds[1]
        return np.where(np.isin(v, start[self._dist[start] == seeds[2]]), -1, out)

    def path(self, place: int) -> list[int]:
        """The flat places from a search's begin to place, by _pred."""
        out = []
        while place >= 0:
            out.append(place)
            place = int(self._pred[place])
        return out[::-1]


def _sent(graph: DataFrame, ends: DataFrame | None = None) -> tuple:
    """(the graph's arrays as they are broadcast, how many segments they have)."""
    t = graph.where("w IS NOT NULL").select("from_en", "to_en", "w").toArrow()  # at most BROADCAST_TURNS turns
    g = Adjacency(t, None if ends is None or not len(t) else _ends_of(graph, ends).toArrow())
    return graph.sparkSession.sparkContext.broadcast(g), len(g.ids)


def _ends_of(graph: DataFrame, ends: DataFrame) -> DataFrame:
    used = graph.select(F.explode(F.array("from_en", "to_en")).alias("en_id")).distinct()
    return ends.join(used, "en_id", "left_semi").select("en_id", "lat", "lon")


def _by_origin(seeds: DataFrame, *lists: DataFrame) -> DataFrame:
    """One row an origin with its seeds (en, ws), and joined to it lists: (origin, ...). The rows are few and each is a search, so that
    they are dealt to a fixed number of tasks, which is not cut down to what their bytes would fill. They are dealt in turn: by origin, as
    they are grouped, into as many tasks as a shuffle has, no step of its own would deal them, and all could come to lie in one task."""
    out = seeds.where("origin IS NOT NULL AND en_id IS NOT NULL AND w IS NOT NULL").select("origin", "en_id", "w")
    out = out.groupBy("origin").agg(F.collect_list(F.struct("en_id", "w")).alias("s")).select("origin", F.col("s.en_id").alias("en"), F.col("s.w").alias("ws"))
    for other, how in lists:
        out = out.join(other, "origin", how)
    return out.repartition(_tasks(seeds))


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)


def _batches(batches, n: int):
    """The rows of Arrow batches as lists of at most n dictionaries."""
    for b in batches:
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n).to_pylist()


def _seeded(g: Adjacency, rows: list[dict], en: str = "en", ws: str = "ws"):
    """(row, number, weight) of the rows' seeds, and the same with ids of those without turns."""
    r = np.repeat(np.arange(len(rows)), [len(x[en]) for x in rows])
    ids, w = (np.array([y for x in rows for y in x[c]], dtype=np.int64) for c in (en, ws))
    k = g.numbers(ids)
    return (r[k >= 0], k[k >= 0], w[k >= 0]), (r[k < 0], ids[k < 0], w[k < 0])


def in_lists(df: DataFrame, key: str, name: str, lists: str) -> DataFrame:
    """(key, lists): the column name of df by key, in lists of at most TOGETHER."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / TOGETHER).cast("int")), lambda k: F.slice("all", k * TOGETHER + 1, TOGETHER))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("all")).select(key, F.explode(parts).alias(lists))


def _by_seeds(seeds: DataFrame) -> DataFrame:
    """One row (origins, en, ws) a search: at most TOGETHER origins with the same seeds share it. The rows are dealt like those of _by_origin."""
    each = seeds.where("origin IS NOT NULL AND en_id IS NOT NULL AND w IS NOT NULL").groupBy("origin").agg(F.array_sort(F.collect_set(F.struct("en_id", "w"))).alias("s"))
    alike = in_lists(each, "s", "origin", "origins")
    return alike.select("origins", F.col("s.en_id").alias("en"), F.col("s.w").alias("ws")).repartition(_tasks(seeds))


def _in_parts(lists: DataFrame, parts: int) -> DataFrame:
    """_by_seeds() with part and parts. Of a graph of several parts, what many origins share is searched once for each, in a task that returns
    the labels of its part alone: searching is little beside the rows, and a file of few values repeated stays a small part of its size."""
    if parts == 1:
        return lists.withColumns({"part": F.lit(0), "parts": F.lit(1)})
    lists = lists.withColumn("parts", F.when(F.size("origins") >= PARTED, parts).otherwise(1))
    lists = materialize(lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), f"{work_dir(lists.sparkSession)}/searches")
    return lists.coalesce(1).repartition(max(_tasks(lists), min(MOST_TASKS, lists.count())))  # dealt by one task, so that each gets as many


def _by_waves(graph: DataFrame, seeds: DataFrame, budget: int | None, preds: bool) -> DataFrame:
    sent, size = _sent(graph)
    parts = 1 if budget is not None else max(1, -(-size // PART))

    def run(batches):
        g, most = sent.value, None if budget is None else (budget + 1) * METRES
        n = len(g.ids)
        for rows in _batches(batches, g.rows()):
            origins = [x["origins"] for x in rows]
            known, lost = _seeded(g, rows)
            bare: dict[tuple[int, int], int] = {}
            for r, en, w in zip(*(x.tolist() for x in lost), strict=True):
                if rows[r]["part"] == 0 and (most is None or w < most):
                    bare[r, en] = min(w, bare.get((r, en), w))
            alone = np.array(sorted((r, en, w) for (r, en), w in bare.items()), dtype=np.int64).reshape(-1, 3)
            yield from _found(origins, alone[:, 0], alone[:, 1], alone[:, 2], np.full(len(alone), -1, dtype=np.int64))
            if not len(known[0]):
                continue
            places, _, _ = g.search(len(rows), known, budget, preds=preds)
            lo, hi = (np.array([n * (x["part"] + k) // x["parts"] for x in rows]) for k in (0, 1))
            r = places // n
            v = np.sort(places[(places - r * n >= lo[r]) & (places - r * n < hi[r])])
            r = v // n
            before = np.empty(len(v), dtype=np.int64) if preds else None
            for k in range(0, len(v) if preds else 0, 1 << 20):
                u = g.before(v[k : k + (1 << 20)], known, n)
                before[k : k + (1 << 20)] = np.where(u < 0, -1, g.ids[u % n])
            yield from _found(origins, r, g.ids[v - r * n], g._dist[v], before)
            g.forget(places)

    lists = _in_parts(_by_seeds(seeds), parts).mapInArrow(run, "origins array<long>, en array<long>, costs array<long>, lengths array<long>, preds array<long>")
    # a label's rows lie together, so that equal values do
    labels = lists.select("origins", F.posexplode("en").alias("k", "en_id"), "costs", "lengths", "preds")
    labels = labels.select("origins", "en_id", F.get("costs", "k").alias("cost"), F.get("lengths", "k").alias("metres"), F.get("preds", "k").alias("pred"))
    return labels.select(F.explode("origins").alias("origin"), "en_id", "cost", "metres", "pred")


def _found(origins: list[list[int]], r, en, w, pred):
    """Arrow batches of lists: some origins, and labels that all of them have, at most SHARED rows of both together. r, ascending, is each label's row of origins."""
    heads = np.searchsorted(r, np.arange(len(origins) + 1))
    cuts = [np.arange(a, z, max(1, SHARED // len(o))) for o, a, z in zip(origins, heads, heads[1:], strict=False)]
    row, cuts = np.repeat(np.arange(len(origins)), [len(c) for c in cuts]), np.append(np.concatenate(cuts), len(r))
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + (1 << 20), "right")) - 1)
        part, at = slice(cuts[i], cuts[j]), pa.array(cuts[i : j + 1] - cuts[i], pa.int32())
        cost = w[part] // METRES
        labels = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (en[part], cost, w[part] - cost * METRES)]
        before = pa.nulls(j - i, pa.list_(pa.int64())) if pred is None else pa.ListArray.from_arrays(at, pa.array(pred[part]))
        yield pa.RecordBatch.from_arrays([pa.array([origins[k] for k in row[i:j]], pa.list_(pa.int64())), *labels, before], ["origins", "en", "costs", "lengths", "preds"])
        i = j


def _goals_by_waves(graph: DataFrame, seeds: DataFrame, into: DataFrame, pairs: DataFrame | None, algorithm: str | None, ends: DataFrame | None, along: DataFrame | None, paths: bool) -> DataFrame:
    sent, _ = _sent(graph, ends if algorithm and algorithm.endswith("a_star") else None)
    table = into.select("goal", "from_en", "w", "goal_en").sort("goal", "goal_en", "from_en").toArrow()  # at most BROADCAST_GOALS rows
    goals = graph.sparkSession.sparkContext.broadcast({c: table[c].to_numpy() for c in table.column_names})
    schema = "origin long, goal long, w long, to_en long, last_en long, path array<long>"
    paths = paths and pairs is not None
    two, every = bool(algorithm) and algorithm.startswith("bidir"), pairs is None

    def run(batches):
        g, h = sent.value, goals.value
        k = g.numbers(h["from_en"])
        use = k >= 0
        goal, on, w, k = h["goal"][use], h["goal_en"][use], h["w"][use], k[use]
        for rows in _batches(batches, g.rows(two)):
            if algorithm:  # a search a pair
                rows = [x | {"wanted": [y]} for x in rows for y in x["wanted"]]
            for at in range(0, len(rows), g.rows(two)):
                yield from found(g, rows[at : at + g.rows(two)], goal, on, w, k)

    def found(g: Adjacency, rows: list[dict], goal, on, w, k):
        m, wide = len(rows), len(g.ids) * (1 + two)
        known, _ = _seeded(g, rows)
        if every:
            heads = np.unique(goal, return_index=True)[1]
            cut, _, _ = g.search(m, known) if len(known[0]) and len(goal) else (None, 0, 0)
            for r, x in enumerate(rows):
                if cut is None:
                    best = np.zeros(0, dtype=np.int64)
                else:
                    cost = g._dist[r * wide + k] + w
                    best = np.minimum.reduceat(cost, heads)
                    hit = np.flatnonzero((cost == np.repeat(best, np.diff(heads, append=len(goal)))) & (cost < INF))
                    hit = hit[np.flatnonzero(np.diff(goal[hit], prepend=goal[hit[0]] - 1))] if len(hit) else hit
                one = (goal[hit], cost[hit], on[hit], g.ids[k[hit]]) if len(best) else (np.zeros(0, dtype=np.int64),) * 4
                yield _answers(x["origin"], *one, None, x.get("along"))
            if cut is not None:
                g.forget(cut)
            return
        wanted = [np.unique(x["wanted"]) for x in rows]
        each = np.concatenate(wanted)
        row = np.repeat(np.arange(m), [len(x) for x in wanted])
        lo, hi = np.searchsorted(goal, each), np.searchsorted(goal, each, "right")
        slot = np.repeat(np.arange(len(each)), hi - lo)
        j = np.arange(len(slot)) + (lo - np.cumsum(hi - lo) + (hi - lo))[slot]
        ways = slot, row[slot], k[j], w[j]
        cut, least, meet = (None, None, None)
        if len(known[0]) and len(slot):
            cut, least, meet = g.search(m, known, None, ways, algorithm, paths)
        rest: list[list] = [[] for _ in rows]
        if cut is not None and not two:
            cost = g._dist[ways[1] * wide + ways[2]] + ways[3]
            for s, a in zip(*np.unique(slot, return_index=True), strict=True):
                z = np.searchsorted(slot, s, "right")
                b = int(a + np.argmin(cost[a:z]))
                if cost[b] < INF:
                    path = (np.array(g.path(int(row[s] * wide + ways[2][b]))) % wide).tolist() if paths else None
                    rest[row[s]].append((int(each[s]), int(cost[b]), int(on[j[b]]), int(ways[2][b]), path))
        elif cut is not None:
            for r in np.flatnonzero(meet >= 0).tolist():
                path, last = [], None
                if paths:
                    path = (np.array(g.path(int(meet[r]))) % wide).tolist() + (np.array(g.path(int(meet[r]) + wide // 2)[-2::-1], dtype=np.int64) % wide - wide // 2).tolist()
                    last = path[-1]
                mine = np.flatnonzero(ways[1] == r)
                if last is not None:
                    mine = mine[ways[2][mine] == last]
                b = int(mine[np.argmin(ways[3][mine])])
                rest[r].append((int(each[slot[b]]), int(least[r]), int(on[j[b]]) if paths else None, last, path if paths else None))
        if cut is not None:
            g.forget(cut)
        for x, got in zip(rows, rest, strict=True):
            ids = [None if y[3] is None else int(g.ids[y[3]]) for y in got]
            walks = [None if y[4] is None else g.ids[y[4]].tolist() for y in got]
            near = None if not x.get("along") else [y for y in x["along"] if y["goal"] in x["wanted"]]
            yield _answers(x["origin"], [y[0] for y in got], [y[1] for y in got], [y[2] for y in got], ids, walks, near)

    lists = []
    if pairs is not None:
        lists.append((pairs.groupBy("origin").agg(F.collect_set("goal").alias("wanted")), "inner"))
    if along is not None:
        near = along.withColumn("w", weight(F.col("cost"), F.col("metres")))
        lists.append((near.groupBy("origin").agg(F.collect_list(F.struct("goal", "w", "to_en")).alias("along")), "left"))
    return _by_origin(seeds, *lists).mapInArrow(run, schema)


def _answers(origin: int, goal, w, to_en, last_en, paths: list | None, along: list | None) -> pa.RecordBatch:
    """The least ways of one origin, along: those that stay on a segment, which may be less."""
    if along and isinstance(goal, np.ndarray):  # sorted, without paths
        least: dict[int, tuple[int, int]] = {}
        for x in along:
            least[x["goal"]] = min(least.get(x["goal"], (INF, INF)), (x["w"], x["to_en"]))
        g = np.array(sorted(least), dtype=np.int64)
        new, en = np.array([least[x] for x in g.tolist()], dtype=np.int64).T
        k = np.searchsorted(goal, g)
        known = np.zeros(len(g), dtype=bool)
        known[k < len(goal)] = goal[k[k < len(goal)]] == g[k < len(goal)]
        k = np.where(known, k, 0)
        won = known.copy()
        won[known] = (new < w[k])[known] | ((new == w[k]) & (en <= to_en[k]))[known] if known.any() else False
        keep = np.ones(len(goal), dtype=bool)
        keep[k[won]] = False
        use = won | ~known
        single = pa.concat_arrays([pa.array(last_en[keep]), pa.nulls(int(use.sum()), pa.int64())])
        goal, w, to_en, last_en = np.concatenate([goal[keep], g[use]]), np.concatenate([w[keep], new[use]]), np.concatenate([to_en[keep], en[use]]), single
    elif along:
        at = {x: k for k, x in enumerate(goal)}
        paths = paths or [None] * len(goal)
        for x in along:
            if (k := at.get(x["goal"])) is None:
                at[x["goal"]] = len(goal)
                for column, value in zip((goal, w, to_en, last_en, paths), (x["goal"], x["w"], x["to_en"], None, None), strict=True):
                    column.append(value)
            elif x["w"] < w[k] or (x["w"] == w[k] and (to_en[k] is None or x["to_en"] <= to_en[k])):
                w[k], to_en[k], last_en[k], paths[k] = x["w"], x["to_en"], None, None
    walks = pa.nulls(len(goal), pa.list_(pa.int64())) if paths is None else pa.array(paths, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(goal), origin, dtype=np.int64)), *(pa.array(x, pa.int64()) for x in (goal, w, to_en, last_en)), walks], ["origin", "goal", "w", "to_en", "last_en", "path"])


def to_goals(graph: DataFrame, seeds: DataFrame, into: DataFrame, pairs: DataFrame | None = None, algorithm: str | None = None, ends: DataFrame | None = None, backend: str | None = None, along: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """(origin, goal, cost, metres, to_en, last_en, path): the least way from each origin to its goals.

    graph and seeds as for shortest_paths; into: (goal, goal_en, from_en, cost, metres), the segments from which a turn leads
    into a segment that the goal lies on, and what is left from there; pairs: (origin, goal), all by default. path lists the
    segments up to last_en, and is null for all pairs. algorithm: None for one search an origin, which ends with its last
    goal, or one of ALGORITHMS for a search a pair. along: (origin, goal, cost, metres, to_en), ways that stay on one segment;
    where they are less, last_en and path are null. Without paths, path is null, and from both ends to_en and last_en may be, too.
    """
    graph, seeds, into = (df.withColumn("w", weight(F.col("cost"), F.col("metres"))) for df in (graph, seeds, into))
    if backend is None:
        small = graph.limit(BROADCAST_TURNS + 1).count() <= BROADCAST_TURNS and into.limit(BROADCAST_GOALS + 1).count() <= BROADCAST_GOALS
        backend = "arrow" if small else "relational"
    if backend == "arrow":
        found = _goals_by_waves(graph, seeds, into, pairs, algorithm, ends, along, paths)
        return found.select("origin", "goal", F.floor(F.col("w") / METRES).cast("long").alias("cost"), (F.col("w") % METRES).alias("metres"), "to_en", "last_en", "path")
    reached = materialize(shortest_paths(graph.drop("w"), seeds.drop("w"), backend=backend), f"{work_dir(graph.sparkSession)}/reached")
    ways = reached.join(into.select("goal", "goal_en", "from_en", F.col("cost").alias("c"), F.col("metres").alias("m")), F.col("en_id") == F.col("from_en"))
    if pairs is not None:
        ways = ways.join(pairs.select("origin", "goal").distinct(), ["origin", "goal"], "left_semi")
    best = ways.groupBy("origin", "goal").agg(F.min(F.struct((F.col("cost") + F.col("c")).alias("cost"), (F.col("metres") + F.col("m")).alias("metres"), F.col("goal_en").alias("to_en"), F.col("en_id").alias("last_en"))).alias("m"))
    best = best.select("origin", "goal", "m.cost", "m.metres", "m.to_en", "m.last_en")
    if pairs is None or not paths:
        best = best.withColumn("path", F.lit(None).cast("array<long>"))
    else:
        parts = unroll(reached, best.select("origin", "goal", F.col("last_en").alias("en_id"))).groupBy("origin", "goal").agg(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("k"), "en_id"))).alias("p"))
        best = best.join(parts.select("origin", "goal", F.transform("p", lambda x: x["en_id"]).alias("path")), ["origin", "goal"])
    if along is None:
        return best
    if pairs is not None:
        along = along.join(pairs.select("origin", "goal").distinct(), ["origin", "goal"], "left_semi")
    along = along.select("origin", "goal", "cost", "metres", "to_en", F.lit(None).cast("long").alias("last_en"), F.lit(None).cast("array<long>").alias("path"))
    return best.unionByName(along).groupBy("origin", "goal").agg(F.min(F.struct("cost", "metres", "to_en", "last_en", "path")).alias("m")).select("origin", "goal", "m.*")


def _by_rounds(graph: DataFrame, seeds: DataFrame, budget: int | None, rounds: int) -> DataFrame:
    """Each round joins what the last one improved with the graph, and writes what that improves in turn; nothing else is
    written, but for a merge of all improvements every MERGE rounds."""
    path = work_dir(graph.sparkSession)
    within = F.lit(True) if budget is None else F.floor(F.col("w") / METRES) <= budget
    graph = materialize(graph.where("w IS NOT NULL").select("from_en", "to_en", F.col("w").alias("step")), f"{path}/graph")
    least = lambda df: df.groupBy("origin", "en_id").agg(F.min(F.struct("w", "pred")).alias("m")).select("origin", "en_id", "m.w", "m.pred")
    start = seeds.where(within).groupBy("origin", "en_id").agg(F.min("w").alias("w")).withColumn("pred", F.lit(-1).cast("long"))
    known = front = materialize(start.select("origin", "en_id", "w", "pred"), f"{path}/0")
    for k in range(1, rounds + 1):
        offered = front.join(graph, F.col("en_id") == F.col("from_en")).select("origin", F.col("to_en").alias("en_id"), (F.col("w") + F.col("step")).alias("w"), F.col("from_en").alias("pred"))
        held = known.groupBy("origin", "en_id").agg(F.min(F.struct("w", "pred")).alias("old"))
        better = least(offered.where(within)).join(held, ["origin", "en_id"], "left")
        # of equals a smaller predecessor counts, unless it leads on at no cost
        news = F.col("old").isNull() | (F.col("w") < F.col("old.w")) | ((F.col("w") == F.col("old.w")) & (F.col("pred") < F.col("old.pred")) & (F.col("old.pred") >= 0))
        front = materialize(better.where(news).select("origin", "en_id", "w", "pred"), f"{path}/{k}")
        if front.limit(1).count() == 0:
            return least(known)
        known = known.unionByName(front)
        if k % MERGE == 0:
            known = materialize(least(known), f"{path}/known{k}")
    raise RuntimeError("the search did not settle")


def shortest_paths(graph: DataFrame, seeds: DataFrame, budget: int | None = None, backend: str | None = None, rounds: int = 100_000, preds: bool = True) -> DataFrame:
    """(origin, en_id, cost, metres, pred): the least cost to the end of each segment reached; pred is -1 where a path begins, and may be null without preds.

    graph: (from_en, to_en, cost, metres); seeds: (origin, en_id, cost, metres), any number for an origin.
    """
    graph = graph.withColumn("w", weight(F.col("cost"), F.col("metres")))
    seeds = seeds.withColumn("w", weight(F.col("cost"), F.col("metres")))
    if backend is None:
        backend = "arrow" if graph.limit(BROADCAST_TURNS + 1).count() <= BROADCAST_TURNS else "relational"
    return _by_waves(graph, seeds, budget, preds) if backend == "arrow" else _unpacked(_by_rounds(graph, seeds, budget, rounds))


def unroll(paths: DataFrame, goals: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(origin, goal, pos, en_id): the segments of the path to each goal (origin, goal, en_id), pos counted backwards from 0.

    The paths' predecessors are followed in the JVM, one join per doubling of the length.
    """
    path = work_dir(paths.sparkSession)
    jump = materialize(paths.select("origin", "en_id", F.col("pred").alias("to")), f"{path}/jump0")
    known = materialize(goals.select("origin", "goal", F.lit(0).cast("long").alias("pos"), "en_id"), f"{path}/known0")
    step = 1
    for k in range(1, 40):
        more = known.join(jump, ["origin", "en_id"]).where("to >= 0").select("origin", "goal", (F.col("pos") + step).alias("pos"), F.col("to").alias("en_id"))
        if more.limit(1).count() == 0:
            return known
        known = materialize(known.unionByName(more), f"{path}/known{k}")
        far = jump.select("origin", F.col("en_id").alias("to"), F.col("to").alias("further"))
        jump = materialize(jump.join(far, ["origin", "to"]).where("further >= 0").select("origin", "en_id", F.col("further").alias("to")), f"{path}/jump{k}")
        step *= 2
    return known
