"""Mixing sources to target weights by Pareto order sampling (operator 8).

Targets: sources share ``SHARE`` times all words by weight; no target exceeds ``MOST`` times its
source's words, and what is cut off is shared again by weight among the others. That is water filling:
target = min(cap, level * weight), with the level found from running sums over sources in order of cap
over weight. Every document then gets the whole part of target / source words as certain copies, and
the rest is a fixed-size sample: documents are ranked by random odds over inclusion odds, and taken in
this order until their words come nearest to the rest of the target. The cut needs no global
sort: ranks fall into ``BUCKETS`` buckets per source whose word sums are pre-aggregated; only the rows
of the one bucket that holds the cut are ordered.

The random number is a digest of the seed, doc_id and text, so reruns agree, and rows with null or repeated ids are
spread by their texts. Defined results: null text has
size 0, texts may be of any length; null source is a source of its own, last in order; only rows of one doc_id and one text tie; a corpus without words has targets of 0; an empty table gives an empty result; extra columns, of
whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
BUCKETS = 1 << 14
#: Sources up to this many are broadcast to the documents; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long"), F.lit(0).cast("long"))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1), from the first 48 bits of a digest."""
    whole = F.concat(F.lit(seed + "/"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    digits = F.substring(F.md5(whole), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: source_size, target, whole (certain copies), p (inclusion beyond them), need (words beyond them)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # sources only, a small table
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(everything) * F.lit(share)
    filled = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.withColumn("level", (total - filled) / left)
    level = level.withColumn("level", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    out = level.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("whole", F.floor(ratio).cast("long")).withColumn("p", ratio - F.floor(ratio))
    return out.select("source", "source_size", "target", "whole", "p", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))


def _ranked(sized: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Adds the source's figures, the Pareto rank ``_q`` and its ``_bucket``."""
    side = per_source.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if few else side
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    u = F.col("_u")
    odds = F.col("p") / (1.0 - F.col("p"))
    q = F.when(F.col("p") > 0, (u / (1.0 - u)) / odds)
    rows = rows.withColumn("_q", q)
    spread = F.col("_q") * odds
    return rows.withColumn("_bucket", F.when(F.col("_q").isNotNull(), F.least(F.lit(BUCKETS - 1), F.floor(BUCKETS * (spread / (1.0 + spread))))).cast("int"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` (with doc_id, source, text) plus size, source_size, target and ``copies``."""
    drawn = uniform(F.col("doc_id"), F.col("text"), seed).alias("_u")
    light = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), drawn))
    per_source = stored(targets(light, weights, share, most).coalesce(1))
    few = per_source.count() <= BROADCAST_SOURCES
    sums = _ranked(light, per_source, few).where("_bucket IS NOT NULL").groupBy("source", "need", "_bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("_bucket")
    cut = sums.withColumn("upto", F.sum("words").over(upto)).where("upto >= need")
    cut = cut.groupBy("source").agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    cut = cut.select("source", F.col("cut._bucket").alias("cut"), F.col("cut.before").alias("before"))
    figures = per_source.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    figures = stored(figures.coalesce(1))
    own = list(docs.columns)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "doc_id", "source", size_of(F.col("text")).alias("size"), drawn)
    rows = _ranked(packed, figures, few)
    sure = rows.where("_bucket IS NULL OR cut IS NULL OR _bucket <> cut")
    sure = sure.withColumn("_extra", F.when(F.col("_bucket").isNotNull() & (F.col("cut").isNull() | (F.col("_bucket") < F.col("cut"))), F.lit(1)).otherwise(F.lit(0)))
    ahead = Window.partitionBy("source").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("_bucket = cut").withColumn("_upto", F.sum("size").over(ahead) + F.col("before"))
    edge = edge.withColumn("_extra", F.when(F.col("_upto") - F.col("size") / 2.0 < F.col("need"), F.lit(1)).otherwise(F.lit(0))).drop("_upto")
    both = sure.unionByName(edge)
    return both.select("_row", "size", "source_size", "target", (F.col("whole") + F.col("_extra")).alias("copies"))


def resampled(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it was taken."""
    out = mixed(docs).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("_row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([3.0e0, 1.0e0, 2.0e0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), r AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r
), m AS (SELECT *, max(CASE WHEN cap > lv * weight THEN lv END) OVER () AS level FROM l
), t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM m
), w AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS ratio FROM t
), x AS (
  SELECT d.*, w.source_size, w.target, floor(w.ratio)::BIGINT AS whole, w.ratio - floor(w.ratio) AS p, w.target - floor(w.ratio)::BIGINT * w.source_size AS need,
    (('0x' || substr(md5('mix-1/' || coalesce(d.doc_id::VARCHAR, '') || '/' || md5(coalesce(d.text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5e0) / 281474976710656e0 AS u
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
), q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1e0 - u)) / (p / (1e0 - p)) END AS q FROM x
), c AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN q IS NOT NULL AND upto - size / 2e0 < need THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""
