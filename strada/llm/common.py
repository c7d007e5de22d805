"""What the operators share: the work folder, materialised steps, code shipping and null-safe text."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm.tokens import forget
from strada.steps import materialize, ship, work_dir

__all__ = ["batch_of", "crc_mod", "materialize", "n_partitions", "prepared", "ship", "slices", "table", "texts_of", "tidied", "work_dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key long, text string) without other columns, so that no clashing name goes on; null text is empty, rows with a null key are left out."""
    ship(df.sparkSession)  # whoever calls an operator directly, its workers find this package
    return df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.col(key).isNotNull())


def crc_mod(col, n: int):
    return F.crc32(F.encode(col.cast("string"), "UTF-8")) % n


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)


def slices(batches, column: int, most: int):
    """Arrow batches cut so that the strings or binaries of column have at most so many bytes, or are one: what is made of a slice goes before the next is begun."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            last = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            yield b.slice(at, max(1, min(last, b.num_rows) - at))
            at = max(at + 1, last)


def tidied(run, encodes: bool = False):
    """run, a function of mapInArrow, that gives the worker's free memory back at its end: workers outlive stages, and what one stage has freed would else count against the next.

    Unless it encodes, the encoders that the worker keeps between tasks go before it begins: their stage is over.
    """

    def then(batches):
        if not encodes:
            forget()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return then


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
