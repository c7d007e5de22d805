"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells by source, language and topic. The cells' token sums are raked: in turn, each dimension's sums
are scaled to its target shares, over all three at most SWEEPS times, and until no cell changes by more than SETTLED of
its weight. A cell's ratio is its raked share over its own share of the tokens. Documents are then sampled: a cell's
probability is min(1, lambda * ratio), with lambda solved so that the expected tokens are the stated fraction of all; a
document stays if a hash of its id, uniform in 0..1, lies below its cell's probability. So a document's fate depends on its
id and its cell alone.

Targets are given by dimension as {value: share}, or by a power: each value's share is its share of the tokens to that
power, renormalised (1: as it is; 0: all alike). Values without a target keep nothing; a target that no cell has is left
out, and the shares of the others are scaled up to fill it. Tokens are words here; a topic is a class of the wording:
`legal` with the text of a licence, `data` with long digit runs or addresses, `prose` otherwise.

Documents are summed to cells before any shuffle, and cells to a dimension's values before theirs: each scaling is a grouped
sum joined back, so no task holds all cells or all of one value, however many there are. lambda is found by sums over the
cells: those it would raise above 1 are set to 1 and it is solved for the others, until no more are; it only rises.

Cases. Null text is empty (0 tokens, topic prose); null source or lang is a value of its own, ''. Rows with a null doc_id
are left out; rows that repeat a doc_id fare alike if their cells are the same. A cell without tokens has probability 1.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strada.llm.common import materialize, table, work_dir

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
FRACTION, SWEEPS, SETTLED = 0.7, 20, 1e-10
WORD, LEGAL, DATA = r"[^\x20\x09-\x0D]+", "[Ll]icen[sc]", "[0-9]{7}|://|[0-9]@|[a-z]@[a-z]"


def tokens_of(text):
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic_of(text):
    return F.when(text.rlike(LEGAL), "legal").when(text.rlike(DATA), "data").otherwise("prose")


def uniform(key):
    """A number in 0..1 from a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), value("source").alias("source"), value("lang").alias("lang"), topic_of(text).alias("topic"), tokens_of(text).alias("n_tokens")
    )


def _targets(cells: DataFrame, total: float, targets: dict) -> DataFrame:
    """cells with t_<dimension>, the share that the dimension's value is to have."""
    for d in DIMENSIONS:
        given = targets.get(d, POWERS[d])
        if isinstance(given, dict):
            share = F.create_map(*[x for k, v in sorted(given.items()) for x in (F.lit(k), F.lit(float(v)))]) if given else F.create_map().cast("map<string,double>")
            cells = cells.withColumn(f"t_{d}", F.coalesce(F.element_at(share, F.col(d)), F.lit(0.0)))
        else:
            own = cells.groupBy(d).agg(F.sum("tokens").alias("own")).select(d, F.when(F.col("own") > 0, F.pow(F.col("own") / total, F.lit(float(given)))).otherwise(0.0).alias("own"))
            all_own = own.agg(F.sum("own")).first()[0]
            cells = cells.join(own.select(d, (F.col("own") / all_own if all_own else F.lit(0.0)).alias(f"t_{d}")), d)
    return cells


def _scaled(now: DataFrame, d: str) -> DataFrame:
    held = now.groupBy(d).agg(F.sum("w").alias("held"))
    return now.join(held, d).withColumn("w", F.when(F.col("held") > 0, F.col("w") * F.col(f"t_{d}") / F.col("held")).otherwise(0.0)).drop("held")


def _lambda(cells: DataFrame, wanted: float) -> float | None:
    """The l at which the sum of tokens * min(1, l * ratio) is wanted; None if all cells with a ratio together fall short."""
    found = 0.0
    while True:
        full = F.col("ratio") * found >= 1
        sums = cells.where("ratio > 0").agg(F.sum(F.when(full, F.col("tokens"))).alias("kept"), F.sum(F.when(~full, F.col("tokens") * F.col("ratio"))).alias("rest")).first()
        if not sums["rest"]:
            return None
        solved = (wanted - (sums["kept"] or 0.0)) / sums["rest"]
        if solved <= found * (1 + 1e-12):
            return max(found, solved)
        found = solved


def rake(cells: DataFrame, path: str, targets: dict | None = None, fraction: float = FRACTION, sweeps: int = SWEEPS) -> DataFrame:
    """(source, lang, topic, tokens, share, ratio, probability) from cells (source, lang, topic, tokens)."""
    cells = materialize(cells.select(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens")), f"{path}/cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    now = _targets(cells, total, targets or {}).withColumn("w", F.col("tokens") / total if total else F.lit(0.0))
    now = materialize(now, f"{path}/sweep0")
    for k in range(1, sweeps + 1):
        now = now.withColumn("was", F.col("w"))
        for d in DIMENSIONS:
            now = _scaled(now, d)
        now = materialize(now, f"{path}/sweep{k}")
        change = now.agg(F.max(F.when(F.col("was") > 0, F.abs(F.col("w") / F.col("was") - 1)))).first()[0]
        if change is None or change <= SETTLED:
            break
    every = now.agg(F.sum("w")).first()[0] or 0.0
    share = F.col("w") / every if every else F.lit(0.0)
    ratio = F.when(F.col("tokens") > 0, share / (F.col("tokens") / total)).otherwise(0.0) if total else F.lit(0.0)
    now = now.select(*DIMENSIONS, "tokens", share.alias("share"), ratio.alias("ratio"))
    lam = _lambda(now, fraction * total)
    inside = F.when(F.col("ratio") > 0, 1.0).otherwise(0.0) if lam is None else F.least(F.lit(1.0), F.lit(lam) * F.col("ratio"))
    return materialize(now.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).otherwise(inside)), f"{path}/raked")


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))


def mix(docs: DataFrame, path: str, targets: dict | None = None, fraction: float = FRACTION) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, ratio, probability, kept."""
    rows = materialize(described(docs), f"{path}/rows")
    raked = rake(cells_of(rows), path, targets, fraction)
    return rows.join(raked.drop("tokens", "share"), list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "n_tokens", F.round("ratio", 6).alias("ratio"), F.round("probability", 6).alias("probability"), (uniform(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sampled(docs: DataFrame, path: str, targets: dict | None = None, fraction: float = FRACTION) -> DataFrame:
    """The rows of docs that the sample keeps, with their columns; texts are not shuffled."""
    raked = rake(cells_of(described(docs)), path, targets, fraction)
    own = {d: f"__mix_{d}" for d in DIMENSIONS}
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.where("doc_id IS NOT NULL").withColumns({own["source"]: value("source"), own["lang"]: value("lang"), own["topic"]: topic_of(value("text"))})
    fate = raked.select(*[F.col(d).alias(own[d]) for d in DIMENSIONS], F.col("probability").alias("__mix_p"))
    return rows.join(fate, list(own.values())).where(uniform(F.col("doc_id")) < F.col("__mix_p")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), work_dir(spark))


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN regexp_matches(coalesce(text, ''), '{LEGAL}') THEN 'legal' WHEN regexp_matches(coalesce(text, ''), '{DATA}') THEN 'data' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens
  FROM documents WHERE doc_id IS NOT NULL),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
tot AS (SELECT sum(tokens) AS n FROM cells),
ts AS (SELECT source, pow(coalesce(sum(tokens) / nullif(any_value(n), 0), 0), 0.5) AS s FROM cells, tot GROUP BY source),
tl AS (SELECT lang, pow(coalesce(sum(tokens) / nullif(any_value(n), 0), 0), 0.7) AS s FROM cells, tot GROUP BY lang),
tt AS (SELECT topic, pow(coalesce(sum(tokens) / nullif(any_value(n), 0), 0), 0.8) AS s FROM cells, tot GROUP BY topic),
start AS (
  SELECT c.source, c.lang, c.topic, c.tokens, ts.s / (SELECT nullif(sum(s), 0) FROM ts) AS t0, tl.s / (SELECT nullif(sum(s), 0) FROM tl) AS t1, tt.s / (SELECT nullif(sum(s), 0) FROM tt) AS t2, coalesce(c.tokens / nullif(n, 0), 0) AS w
  FROM cells c JOIN ts USING (source) JOIN tl USING (lang) JOIN tt USING (topic), tot),
it AS (
  SELECT 0 AS k, * FROM start
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, t0, t1, t2,
    coalesce(w * CASE k % 3 WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END / nullif(sum(w) OVER (PARTITION BY CASE k % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END), 0), 0)
  FROM it WHERE k < {3 * SWEEPS}),
r AS (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN w / nullif(sum(w) OVER (), 0) / (tokens / sum(tokens) OVER ()) ELSE 0 END AS ratio FROM it WHERE k = {3 * SWEEPS}),
l AS (
  SELECT *, ({FRACTION} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(tokens * ratio) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS lam FROM r),
p AS (SELECT source, lang, topic, ratio, CASE WHEN tokens = 0 THEN 1.0 ELSE least(1.0, ratio * max(lam) FILTER (WHERE lam >= 0 AND lam * ratio <= 1) OVER ()) END AS probability FROM l)
SELECT doc_id, source, lang, topic, n_tokens, round(ratio, 6) AS ratio, round(probability, 6) AS probability,
  CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < probability AS kept
FROM d JOIN p USING (source, lang, topic)
"""
