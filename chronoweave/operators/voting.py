"""Robust statistics, votes, tolerances and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_median(rows: DataFrame, value: str, order: list[str], width: int = 5) -> DataFrame:
    """Centred median of `width` rows (odd), over fewer at the ends."""
    reach = width // 2
    w = Window.partitionBy("entity").orderBy(*order).rowsBetween(-reach, reach)
    return rows.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def percentiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """entity and a column for each share: the percentile, between two values rounded once, as lower * (1 - part) + upper * part in one fused step.

    That is DuckDB's `quantile_cont`; Spark's own rounds both products, and what is computed on may fall on another side of a tie.
    """
    w = Window.partitionBy("entity")
    ranked = rows.select("entity", F.col(value).cast("double").alias("_v"))
    ranked = ranked.withColumns({"_i": F.row_number().over(w.orderBy(F.col("_v").asc_nulls_last())) - 1, "_last": F.count("_v").over(w) - 1})
    at = {name: F.col("_last") * F.lit(share) for name, share in shares.items()}
    ends = [F.max(F.when(F.col("_i") == edge(x), F.col("_v"))).alias(f"{name}_{k}") for name, x in at.items() for k, edge in (("lower", F.floor), ("upper", F.ceil))]
    found = ranked.groupBy("entity").agg(F.max("_last").alias("_last"), *ends)
    part = {name: x - F.floor(x) for name, x in at.items()}
    fused = {name: F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col(f"{name}_lower"), 1 - d, F.col(f"{name}_upper") * d).cast("double") for name, d in part.items()}
    return found.select("entity", *(F.when(F.col("_last") >= 0, x).alias(name) for name, x in fused.items()))


def percentile_normalized(rows: DataFrame, value: str, low: float = 0.2, high: float = 0.9) -> DataFrame:
    """The value's place between two percentiles of its entity, cut to 0..1; one half where they are equal."""
    ends = percentiles(rows, value, {"_l": low, "_h": high})
    rows = rows.alias("r").join(ends.alias("p"), F.col("r.entity").eqNullSafe(F.col("p.entity"))).select("r.*", "_l", "_h")
    place = F.when(F.col("_h") - F.col("_l") <= 1e-12, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("_l")) / (F.col("_h") - F.col("_l")))))
    return rows.withColumn("normalized", place).drop("_l", "_h")


def mad(rows: DataFrame, value: str) -> DataFrame:
    """entity, median and median absolute deviation."""
    with_median = rows.withColumn("_m", F.percentile(value, F.lit(0.5)).over(Window.partitionBy("entity")))
    return with_median.groupBy("entity").agg(F.first("_m").alias("median"), F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("mad"))


def inliers(rows: DataFrame, value: str, least: float = 3.0, factor: float = 3.0) -> DataFrame:
    """Rows within max(least, factor * MAD) of their entity's median."""
    stats = mad(rows, value)
    return rows.join(stats, "entity").where(F.abs(F.col(value) - F.col("median")) <= F.greatest(F.lit(least), factor * F.col("mad")) + 1e-9).drop("median", "mad")


def run_lengths(rows: DataFrame, state: Column, at: str, order: list[str], gap: int) -> DataFrame:
    """For rows in a state, the number of rows of their run: consecutive rows in it with no gap above `gap`."""
    w = Window.partitionBy("entity").orderBy(*order)
    rows = rows.withColumn("_on", state)
    new = F.col("_on") & ~F.coalesce(F.lag("_on").over(w) & (F.col(at) - F.lag(at).over(w) <= gap), F.lit(False))
    rows = rows.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(w)).where("_on")
    return rows.withColumn("persistence", F.count(F.lit(1)).over(Window.partitionBy("entity", "_run"))).drop("_on", "_run")


def weighted_vote(rows: DataFrame, state: str, weight: str, floor: int = 50, prefer: str | None = None) -> DataFrame:
    """The state of each entity with the largest sum of weights (each at least `floor`); ties: the preferred one, then by name."""
    sums = rows.groupBy("entity", F.col(state).alias("state")).agg(F.sum(F.greatest(F.lit(floor), F.col(weight))).alias("score"), F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("entity").orderBy(F.col("score").desc(), (F.col("state") == F.lit(prefer or "")).desc(), "state")
    return sums.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def support_vote(rows: DataFrame, value: str, unit: str, weight: str, at: str) -> DataFrame:
    """The value with the most distinct units, then the highest mean weight, then the latest time; in conflict if the next has as many units."""
    groups = rows.groupBy("entity", F.col(value).alias("value")).agg(F.countDistinct(unit).alias("support"), F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"), F.max(at).alias("latest"))
    groups = groups.withColumn("_mean", F.floor(F.col("_w") * 1000 / F.col("_n")))
    w = Window.partitionBy("entity").orderBy(F.col("support").desc(), F.col("_mean").desc(), F.col("latest").desc(), "value")
    groups = groups.withColumns({"_k": F.row_number().over(w), "_next": F.lead("support").over(w)}).where("_k = 1")
    return groups.select("entity", "value", "support", "latest", F.coalesce(F.col("_next") >= F.col("support"), F.lit(False)).alias("conflict"))


def consensus(rows: DataFrame, value: str, unit: str, weight: str, least_units: int = 2, least_weight: int = 850) -> DataFrame:
    """Values that enough distinct units hold with enough weight."""
    return rows.where(F.col(weight) >= least_weight).groupBy("entity", F.col(value).alias("value")).agg(F.countDistinct(unit).alias("units")).where(F.col("units") >= least_units)


def strict_mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key where no other is as frequent, else null."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    top = counts.withColumn("_m", F.max("n").over(w)).where("n = _m")
    return top.groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, F.max(value)).alias("mode"), F.max("n").alias("n"))


def within(left: Column, right: Column, floor: float, span: Column, divisions: int = 30, factor: float = 1.25) -> Column:
    """Whether two readings agree within a scale division and a quarter, or the floor."""
    return F.abs(left - right) <= F.greatest(F.lit(floor), span / divisions * factor) + 1e-9


def gate(results: DataFrame, prerequisites: DataFrame, decision: str = "decision") -> DataFrame:
    """Fail what has a failed prerequisite; a missing one fails nothing."""
    failed = prerequisites.groupBy("entity").agg(F.max(F.when(F.col(decision) == "fail", 1).otherwise(0)).alias("_failed"))
    return results.join(failed, "entity", "left").withColumn("gated", F.when(F.col("_failed") == 1, "fail").otherwise(F.col(decision))).drop("_failed")


def pivot_counts(rows: DataFrame, key: str, decision: str, values: list[str]) -> DataFrame:
    """Counts of each decision per key; the values are given, so no job looks for them."""
    return rows.groupBy(key).agg(*(F.sum(F.when(F.col(decision) == v, 1).otherwise(0)).alias(v) for v in values))
