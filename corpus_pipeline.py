"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and packing, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents; the last returns the pieces of the packed sequences. The stages set how many bytes an Arrow batch has
for the session, as what they return runs later; other queries of the session get the same rows, in smaller batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm import exact_dedup, language, mixing, near_dedup, packing
from strada.llm.common import materialize, table, work_dir
from strada.llm.tokens import resolve


#: Keys of dropped or repeated rows that are broadcast; more are met by a shuffle, hashed and not sorted.
BROADCAST = 100_000
#: Bytes of texts that a worker packs at a time: fewer than packing alone takes, as the stages before have left executors with less room.
TOGETHER = 2_000_000
#: Bytes of an Arrow batch for Python workers: a worker holds two at once, an executor buffers that grow by doubling for each.
BATCH = 4_000_000


def _begin(spark: SparkSession) -> str:
    """A new work folder, for a stage whose batches are small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return work_dir(spark)


def _kept(docs: DataFrame, kept: DataFrame, mark: Column, path: str) -> DataFrame:
    """The rows of docs whose doc_id and mark (of their text) are in kept; of rows with equal ones the first in the order of their columns.

    Texts are neither sorted nor, while few rows are dropped, shuffled: only the keys of those that go or repeat meet the rows.
    """
    by = ["doc_id", "_mark"]
    rows = docs.withColumn("_mark", mark).where("doc_id IS NOT NULL AND _mark IS NOT NULL")
    stay = kept.toDF(*by).distinct().withColumn("stays", F.lit(True))
    odd = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(stay, by, "left").where("stays IS NULL OR n > 1")
    odd = materialize(odd.select(*by, "stays"), f"{path}/odd")
    n, repeated = odd.agg(F.count(F.lit(1)), F.count("stays")).first()
    met = lambda some: F.broadcast(some) if n <= BROADCAST else some.hint("shuffle_hash")
    out = rows.join(met(odd.select(*by)), by, "left_anti").select(docs.columns)
    if not repeated:
        return out
    again = rows.join(met(odd.where("stays").select(*by)), by, "left_semi").groupBy(*by).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(again.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no letter at all); fills a null lang with the prediction."""
    _begin(spark)
    return language.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = _begin(spark)
    found = exact_dedup.exact_dedup(docs, path).where("kept").select("doc_id", "text_sha256")
    return _kept(docs, found, F.sha2(folded.cast("binary"), 256), path)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component's rows with its smallest doc_id, the one of the smallest mark stays; rows without words all stay."""
    path = _begin(spark)
    found = near_dedup.components_of(docs, path).where("doc_id = component_id")
    one = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "mark")).alias("one")).select("one.doc_id", "one.mark")
    return _kept(docs, one.unionByName(found.where("comp IS NULL").select("doc_id", "mark")), near_dedup.mark_of(F.col("text")), path)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs, _begin(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, _begin(spark), resolve("byte_bpe_50k.json"), together=TOGETHER)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the inference of languages or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{path}/stage{k}")
    return docs
