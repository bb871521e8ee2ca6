"""Ordered analytics: smoothing, runs, intervals, weighted medians, neighbours in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.cloud import num


def over(by: Sequence[str], *order) -> Window:
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)


def smoothed(n: Column, window, side: float, middle: float) -> Column:
    """Three taps, zero beyond the ends."""
    zero = F.lit(0).cast("long")
    return F.coalesce(F.lag(n).over(window), zero) * num(side) + n * num(middle) + F.coalesce(F.lead(n).over(window), zero) * num(side)


def runs(cells: DataFrame, by: Sequence[str], index: str, gap: int = 1) -> DataFrame:
    """Gaps and islands: (by, start, end, cells) of indices at most ``gap`` apart."""
    w = over(by, index)
    new = F.when(F.col(index) - F.lag(index).over(w) <= gap, 0).otherwise(1)
    marked = cells.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run").agg(F.min(index).alias("start"), F.max(index).alias("end"), F.count(F.lit(1)).alias("cells")).drop("_run")


def interval_union(intervals: DataFrame, by: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Merged intervals; touching ones merge."""
    w = over(by, lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.when(F.col(lo) <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_run")


def interval_gaps(intervals: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts of each span (by, a, b) that no interval covers."""
    w = over(by, "lo")
    inside = intervals.join(spans, list(by)).where("hi > a AND lo < b").select(*by, F.greatest("lo", "a").alias("lo"), F.least("hi", "b").alias("hi"))
    merged = interval_union(inside, by)
    before = merged.join(spans, list(by)).withColumn("_from", F.coalesce(F.lag("hi").over(w), F.col("a"))).select(*by, F.col("_from").alias("lo"), F.col("lo").alias("hi"))
    tail = spans.join(merged.groupBy(*by).agg(F.max("hi").alias("_hi")), list(by), "left").select(*by, F.coalesce("_hi", "a").alias("lo"), F.col("b").alias("hi"))
    return before.unionByName(tail).where("hi > lo")


def weighted_median(histogram: DataFrame, by: Sequence[str], bin_: str = "bin", n: str = "n") -> DataFrame:
    """First bin whose running count reaches (total + 1) / 2."""
    w = over(by, bin_)
    running = histogram.withColumn("_run", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(n).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))
    return running.where(F.col("_run") * 2 >= F.col("_all") + 1).groupBy(*by).agg(F.min(bin_).alias("median_bin"), F.max("_all").alias("n"))


def pairs_in_order(rows: DataFrame, by: Sequence[str], order: str, least: float) -> DataFrame:
    """Each row with the next one, where the step is at least ``least``."""
    w = over(by, order)
    return rows.withColumn("upper", F.lead(order).over(w)).where(F.col("upper") - F.col(order) >= num(least))


def overlaps_in_order(rows: DataFrame, by: Sequence[str], bottom: str, top: str, tolerance: float = 1e-8) -> DataFrame:
    """Rows that begin below the top of the one before."""
    w = over(by, bottom)
    return rows.withColumn("previous_top", F.lag(top).over(w)).where(F.col("previous_top") > F.col(bottom) + num(tolerance))


def gaps_in_order(rows: DataFrame, by: Sequence[str], bottom: str, top: str, low: float, high: float) -> DataFrame:
    """Step to the storey before: a slab's thickness if plausible, else unresolved."""
    w = over(by, bottom)
    out = rows.withColumn("gap", F.col(bottom) - F.lag(top).over(w)).where("gap IS NOT NULL")
    return out.withColumn("kind", F.when(F.col("gap").between(num(low), num(high)), "slab").otherwise("unresolved"))


def clusters_in_order(rows: DataFrame, by: Sequence[str], value: str, gap: float) -> DataFrame:
    """Rows with ``cluster``: a new one where the step to the row before exceeds ``gap``."""
    w = over(by, value)
    new = F.when(F.col(value) - F.lag(value).over(w) > num(gap), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: there must be none where they identify records."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def numbered(rows: DataFrame, by: Sequence[str], *order: str, name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(over(by, *order)))
