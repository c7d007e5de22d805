"""Concatenate and cut: documents' ids, one after the other, cut into windows of a fixed length.

The first pass encodes each document once and writes its ids with its place in its own partition, counted as the rows go
by, and adds up the ids of each partition. Prefix sums over these totals (one number a partition, on the driver) give each
partition's global offset. The second pass knows each document's global place, and so its windows: a document that
crosses a window's edge has one boundary record for each window. No row is shuffled and no window is gathered. Both passes
take few MB of texts or ids at a time, and no more, however many rows an Arrow batch has.

Cases. Null text is empty: the document is its end id alone. Rows with a null doc_id are left out; rows that repeat a
doc_id are documents of their own. An empty table gives an empty result. Only the last sequence may be short: it is padded
to the full length, unless its length is a power of two (padded_to says to what). Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm.common import materialize, prepared, slices, table, tidied, work_dir
from strada.llm.tokens import TOGETHER, encoder, resolve

LENGTH = 2048
#: Partitions whose offsets are broadcast.
BROADCAST = 500_000


def encoded(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str, text: str, together: int) -> DataFrame:
    """(part, doc_id, before, ids): before counts the ids of the same part ahead of the document; ids as unsigned 16 or 32 bits."""

    def run(batches):
        part, tokens, before = TaskContext.get().partitionId(), encoder(tokenizer, True), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        small = tokens.tokenizer.get_vocab_size() <= 1 << 16
        for b in slices(batches, 1, together):
            ids = [i + end for i in tokens.encode(b.column(1).to_pylist())]
            counts = np.array([len(i) // 4 for i in ids], dtype=np.int64)
            places = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            if small:
                ids = [np.frombuffer(i, dtype="<u4").astype("<u2").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ids), part, dtype=np.int64)), b.column(0), pa.array(places), pa.array(counts), pa.array(ids, pa.binary()),
            ], ["part", "doc_id", "before", "n", "ids"])

    return materialize(prepared(docs, key, text).mapInArrow(tidied(run, encodes=True), "part long, doc_id long, before long, n long, ids binary"), f"{path}/encoded")


def pack(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, length: int = LENGTH, key: str = "doc_id", text: str = "text", together: int = TOGETHER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to. together: bytes of texts or ids that a worker takes at a time."""
    spark = docs.sparkSession
    own = encoded(docs, path, tokenizer, end_id, key, text, together)
    totals = own.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a partition
    firsts, total = [], 0
    for r in totals:
        firsts.append((r["part"], total))
        total += r["n"]
    last = total % length
    last_padded = last if last and not last & (last - 1) else length
    n_full = total // length

    def run(batches):
        for b in slices(batches, 3, together):
            out: list[list] = [[] for _ in range(8)]
            for doc_id, first, n, ids in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                width = len(ids) // n
                ids = ids if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                at = 0
                while at < n:
                    sequence, offset = divmod(first + at, length)
                    take = min(n - at, length - offset)
                    for column, value in zip(out, (doc_id, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)]), n, sequence, offset, last_padded if sequence == n_full else length), strict=True):
                        column.append(value)
                    at += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"])

    bases = spark.createDataFrame(firsts, "part long, first long")
    if len(firsts) <= BROADCAST:  # 16 bytes a partition; beyond, the ids are shuffled by part
        bases = F.broadcast(bases)
    placed = own.join(bases, "part").select("doc_id", (F.col("first") + F.col("before")).alias("first"), "n", "ids")
    return placed.mapInArrow(tidied(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), work_dir(spark), tokenizer or resolve("byte_bpe_50k.json"))
