"""Exact dedup against a minimal perfect hash over the distinct digests of a history.

Every row becomes (doc_id, digest of its normalised text). The history's distinct digests, pre-aggregated to their winner
and count, are dealt to shards by digest; each shard holds a minimal perfect hash (levels of collision-free bit sets,
ranked by popcount) whose slots store the full 32-byte digest, the winner's doc_id and the count. The batch's distinct
digests, pre-aggregated too, are looked up in their shard: the slot's digest is compared byte for byte, members are
merged with the slot, nonmembers form groups of their own. A hot text is one row per map task before any shuffle. Groups of
more than one row in HOT are fewer than HOT: they are broadcast to the rows, and only the rows of smaller groups are
shuffled by their digest to meet theirs.

Cases. Null text is the empty text, and empty texts are equal to each other. Rows with a null doc_id are left out.
Rows that repeat a doc_id count as rows: each is returned, and each counts in group_size. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm.common import materialize, prepared, table, work_dir

#: Distinct digests a shard holds on average; a shard is one group of one task.
SHARD_KEYS = 512
#: A group with more than this part of all rows is hot.
HOT = 1000
_WORDS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
_SLOT = np.dtype([("digest", "V32"), ("winner", "<i8"), ("size", "<i8")])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the UTF-8 text after lower-casing A-Z only."""

    def run(batches):
        for b in batches:
            out = [hashlib.sha256(t.lower()).digest() for t in b.column(1).to_pylist()]  # bytes.lower() is ASCII only
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])

    return prepared(docs, key, text).select(F.col(key).alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, digest binary")


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = words[:, level % 4] + np.uint64(level + 1) * _WORDS[0]
        h = (h ^ (h >> np.uint64(30))) * _WORDS[1]
        h = (h ^ (h >> np.uint64(27))) * _WORDS[2]
        return (h ^ (h >> np.uint64(31))) % np.uint64(size)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """words: (n, 4) uint64, distinct rows. Level sizes, the bits of all levels, and each key's slot in 0..n-1."""
    sizes, levels, places = [], [], np.zeros(len(words), dtype=np.int64)
    left, base = np.arange(len(words)), 0
    while len(left):
        size = max(8, 2 * len(left))
        at = _positions(words[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        places[left[placed]] = base + at[placed]
        left, base = left[~placed], base + size
        sizes.append(size)
        levels.append(alone)
    bits = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
    return sizes, bits, (np.cumsum(bits) - 1)[places] if len(words) else places


def find_slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot that the hash gives to each key, -1 where it gives none; whether it is the key's own the digest must tell."""
    rank, slots, base, left = np.cumsum(bits) - 1, np.full(len(words), -1, dtype=np.int64), 0, np.arange(len(words))
    for level, size in enumerate(sizes):
        at = base + _positions(words[left], level, size).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return slots


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="V32")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("size"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The index of the distinct digests of history (doc_id, digest), one row per shard, written below path; and the number of shards."""
    groups = materialize(_grouped(history), f"{path}/history")
    shards = max(64, math.ceil(groups.count() / SHARD_KEYS))

    def build(t: pa.Table) -> pa.Table:
        raw = _raw(t["digest"])
        sizes, bits, slots = build_hash(raw.view("<u8").reshape(-1, 4))
        held = np.zeros(len(raw), dtype=_SLOT)
        held["digest"][slots], held["winner"][slots], held["size"][slots] = raw, t["winner"].to_numpy(), t["size"].to_numpy()
        return pa.table({"shard": t["shard"].slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()), "slots": pa.array([held.tobytes()], pa.binary())})

    return materialize(_sharded(groups, shards).groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, slots binary"), f"{path}/index"), shards


def probe(index: DataFrame, shards: int, batch: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, seen): the groups of history and batch together; seen: the history had the text."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        held = np.frombuffer(left["slots"][0].as_py(), dtype=_SLOT).copy() if len(left) else np.zeros(0, dtype=_SLOT)
        raw = _raw(right["digest"])
        winner, size = right["winner"].to_numpy(), right["size"].to_numpy()
        own = np.zeros(len(raw), dtype=bool)
        if len(held) and len(raw):
            sizes = left["sizes"][0].as_py()
            bits = np.unpackbits(np.frombuffer(left["bits"][0].as_py(), dtype=np.uint8), count=sum(sizes)).astype(bool)
            slots = find_slots(raw.view("<u8").reshape(-1, 4), sizes, bits)
            own = (slots >= 0) & (held["digest"][slots] == raw)
            s = slots[own]
            held["winner"][s] = np.maximum(held["winner"][s], winner[own])
            held["size"][s] += size[own]
        digest = [bytes(x) for x in held["digest"]] + [bytes(x) for x in raw[~own]]
        return pa.table({
            "digest": pa.array(digest, pa.binary()), "keep_id": pa.array(np.concatenate([held["winner"], winner[~own]]), pa.int64()),
            "group_size": pa.array(np.concatenate([held["size"], size[~own]]), pa.int64()), "seen": pa.array([True] * len(held) + [False] * int((~own).sum()), pa.bool_()),
        })

    fresh = _sharded(_grouped(batch), shards)
    return index.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInArrow(look, "digest binary, keep_id long, group_size long, seen boolean")


def exact_dedup(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", history=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, seen_in_history.

    history: a condition on doc_id that marks the rows already indexed; by default those up to the middle of the ids' range.
    """
    rows = materialize(digests(docs, key, text), f"{path}/digests")
    if history is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history = F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2)
    index, shards = build_index(rows.where(history), path)
    groups = materialize(probe(index, shards, rows.where(~history)), f"{path}/groups")
    hot = F.col("group_size") * HOT > rows.count()
    met = rows.join(F.broadcast(groups.where(hot)), "digest", "left")
    others = met.where("group_size IS NULL").select("doc_id", "digest").join(groups.where(~hot), "digest")
    return met.where("group_size IS NOT NULL").unionByName(others).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("seen").alias("seen_in_history")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), work_dir(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g ON g.h = d.h
"""
