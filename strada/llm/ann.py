"""Approximate nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Vectors are lengthened by one component, sqrt(max norm^2 - norm^2) for indexed rows and 0 for queries, so that the largest
inner product is the smallest angle. Rotations are learned by iterative quantisation on a bounded sample (SAMPLE rows in
the order of a hash of their ids), each from its own random start, and the signs of the rotated components are the code.
A code is split into 16-bit substrings, each with its own bucket table; a code within the Hamming radius r of a query has
a substring within floor(r / substrings) of the query's, so probing every occupied bucket that near retrieves every code
within the radius. What is retrieved is checked on the full code and reranked on the original floats in double precision.
Once the tables probed have brought up half of a block, the others would bring up codes that are cheaper checked than
probed for: the whole block is checked, with the same codes within the radius as the outcome.
The radius is learned on the sample as the quantile WITHIN of the true neighbours' distances; the neighbours of a sample
are farther than those of the whole table, so the radius errs to the wide side. A block that retrieves fewer than k rows
widens its radius until it has k or all.

Every row is indexed. Rows are dealt to blocks by a hash of their id and queries likewise; each pair of blocks is one task
of bounded size, which returns k rows a query, and the best k of those are kept.

Cases. Vectors that are null, empty, zero or hold null or non-finite components, and those whose length isn't the most
frequent one, take no part. Rows with a null vec_id are left out; of rows that repeat a vec_id, each is a candidate for
other queries. Ties go to the smaller vec_id. Fewer candidates than k give all of them. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strada.llm.common import materialize, ship, table, work_dir

SAMPLE, BITS, WITHIN = 4096, 256, 0.95
ROWS, QUERIES = 8192, 4096
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)
_ONES16 = (_ONES[np.arange(65536) >> 8] + _ONES[np.arange(65536) & 255]).astype(np.uint8)


def _lengthened(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(axis=1)))[:, None]])


def learn(x: np.ndarray, top: float, k: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, projection, radius) from sample vectors x."""
    long = _lengthened(x, top)
    mean = np.append(long[:, :-1].mean(axis=0), 0.0)
    mean[-1] = long[:, -1].mean() if len(long) else 0.0
    centred = long - mean
    width = long.shape[1]
    _, vectors = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(width))
    v = centred @ vectors
    parts, made, rng = [], 0, np.random.RandomState(7)
    while made < bits:
        take = min(width, bits - made)
        r = np.linalg.qr(rng.randn(width, width))[0][:, :take]
        for _ in range(20):  # alternate the signs and the rotation that fits them best
            u, _, t = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0), full_matrices=False)
            r = u @ t
        parts.append(vectors @ r)
        made += take
    projection = np.hstack(parts)
    q = x[:256]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
    code, own = codes(x, top, mean, projection), codes(q, None, mean, projection)
    far = np.bitwise_count(own[:, None, :].view(np.uint64) ^ code[best].view(np.uint64)).sum(axis=2, dtype=np.int64)
    return mean, projection, int(np.quantile(far, WITHIN, method="higher")) if far.size else bits


def codes(x: np.ndarray, top: float | None, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """(n, bits / 8) bytes; top: None for queries."""
    long = np.hstack([x, np.zeros((len(x), 1))]) if top is None else _lengthened(x, top)
    if top is None:  # a query's angle doesn't depend on its length
        long = long / np.maximum(np.linalg.norm(long, axis=1, keepdims=True), 1e-300) * max(np.linalg.norm(mean), 1.0)
    return np.packbits((long - mean) @ projection >= 0, axis=1)


class MultiIndex:
    """The bucket tables of one block's substrings."""

    def __init__(self, code: np.ndarray):
        self.code = np.ascontiguousarray(code).view(np.uint64)
        parts = np.ascontiguousarray(code).view(np.uint16)
        self.tables = []
        for s in range(parts.shape[1]):
            order = np.argsort(parts[:, s], kind="stable")
            values, starts = np.unique(parts[order, s], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code is within radius of the query's code, each once."""
        marked = np.zeros(len(self.code), dtype=bool)
        each = radius // len(self.tables)
        for part, (values, starts, order) in zip(query.view(np.uint16), self.tables, strict=True):
            hit = _ONES16[values ^ part] <= each
            if hit.any():
                marked[order[np.repeat(hit, np.diff(starts))]] = True
                if 2 * np.count_nonzero(marked) >= len(marked):
                    return np.flatnonzero(self._distances(slice(None), query) <= radius)
        found = np.flatnonzero(marked)
        return found[self._distances(found, query) <= radius]

    def _distances(self, rows, query: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.code[rows] ^ query.view(np.uint64)).sum(axis=1, dtype=np.int64)


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the vectors that take part, and their length."""
    v = F.col(vector).cast("array<double>")
    good = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    width = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = width[0]["n"] if width else 0
    return good.where(F.size("v") == n), n


def neighbours(df: DataFrame, path: str, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which the condition is_query on vec_id holds, against all others."""
    spark = df.sparkSession
    ship(spark)
    good, width = usable(df, key, vector)
    rows = materialize(good, f"{path}/vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.count(F.when(is_query, 1)).alias("q")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = facts["top"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    mean, projection, radius = learn(np.array([r["v"] for r in sample], dtype=np.float64), top, k)
    blocks, asked = math.ceil(facts["n"] / ROWS), max(1, math.ceil(facts["q"] / QUERIES))

    def coded(batches):
        for b in batches:
            if len(b):
                x = _vectors(pa.chunked_array([b.column(1)]), width)
                code = codes(x, top, mean, projection)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "v", "code"])

    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    index = materialize(rows.mapInArrow(coded, "vec_id long, v array<double>, code binary").withColumn("b", block(blocks, 1)), f"{path}/index")
    left = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))))
    right = rows.where(is_query).withColumn("q", block(asked, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(t: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(t) and len(asks):
            ids, x = t["vec_id"].to_numpy(), _vectors(t["v"], width)
            held = MultiIndex(np.frombuffer(b"".join(t["code"].to_pylist()), dtype=np.uint8).reshape(len(t), -1))
            qids, q = asks["vec_id"].to_numpy(), _vectors(asks["v"], width)
            for qid, vector, code in zip(qids, q, codes(q, None, mean, projection), strict=True):
                r = radius
                while True:
                    found = held.within(code, r)
                    found = found[ids[found] != qid]
                    if len(found) >= k or r >= BITS:
                        break
                    r = min(BITS, r + 8)
                score = (x[found] * vector).sum(axis=1)
                if len(found) > k:
                    near = score >= np.partition(score, len(score) - k)[len(score) - k]
                    found, score = found[near], score[near]
                best = np.lexsort((ids[found], -score))[:k]
                for column, values in zip(out, (np.full(len(best), qid), ids[found[best]], score[best]), strict=True):
                    column.append(values)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, dtype=kind) for n, c, kind in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), work_dir(spark), F.col("vec_id") % 20 == 0)
