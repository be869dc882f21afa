"""One-dimensional two-means by aggregates: counts and sums on both sides of a moving cut, never a key's rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.session import written


def counted(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, v, n: how often each value occurs; null and non-number values are left out."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def two_means(rows: DataFrame, value: str, keys: list[str], *, rounds: int = 20, still: float = 1e-8, quartiles: bool = False, at_a_time: int = 5) -> DataFrame:
    """keys, low, high, size: two centres of the values of each key and the number of values.

    Centres begin at the extremes, or at the quartiles (with a line between neighbouring values), and move to the means of
    the values up to their middle and of those above it; a side without values keeps its centre. A key is done after
    `rounds`, or when both centres together move by less than `still`. Values are counted once and each round is a sum by
    key, combined before the shuffle; rounds are written `at_a_time`. Keys may be [] for one pair of centres of all rows;
    null keys are a key of their own, keys without a value give no row.
    """
    base = written(counted(rows, value, keys), "values")
    first = F.min("v"), F.max("v")
    if quartiles:
        first = F.percentile("v", F.lit(0.25), F.col("n")), F.percentile("v", F.lit(0.75), F.col("n"))
    now = base.groupBy(*keys).agg(first[0].alias("low"), first[1].alias("high"), F.sum("n").alias("size"), F.lit(False).alias("done")).where("size is not null")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    for k in range(rounds):
        below = F.col("v") <= (F.col("low") + F.col("high")) / 2
        if keys:
            met = base.alias("x").join(now.alias("c"), same).select(*(F.col(f"c.{n}") for n in keys), "v", "n", "low", "high", "size", "done")
        else:
            met = base.join(F.broadcast(now))  # one row
        side = lambda ok: F.try_divide(F.sum(F.when(ok, F.col("v") * F.col("n"))), F.sum(F.when(ok, F.col("n"))))
        moved = met.groupBy(*keys, "low", "high", "size", "done").agg(side(below).alias("a"), side(~below).alias("b"))
        low, high = F.coalesce("a", "low"), F.coalesce("b", "high")
        at_rest = F.abs(low - F.col("low")) + F.abs(high - F.col("high")) < still
        keep = lambda old, new: F.when(F.col("done"), F.col(old)).otherwise(new)
        now = moved.select(*keys, keep("low", low).alias("low"), keep("high", high).alias("high"), "size", (F.col("done") | at_rest).alias("done"))
        if (k + 1) % at_a_time == 0 or k + 1 == rounds:
            now = written(now, "centres")
            if now.where(~F.col("done")).isEmpty():
                break
    return now.drop("done")


def shared_threshold(rows: DataFrame, value: str, keys: list[str], *, fallback: float, apart: float, least_high: float, least_rows: int = 4, rounds: int = 50) -> DataFrame:
    """keys, threshold, low, high: the middle of two centres where they are `apart` and the upper one is high enough, else the fallback.

    Fewer than `least_rows` values have no centres. `value` has a bounded number of distinct values (scores rounded to a
    few places): quartiles are of their counts.
    """
    c = two_means(rows, value, keys, rounds=rounds, still=1e-6, quartiles=True)
    some = F.col("size") >= least_rows
    good = some & (F.col("high") - F.col("low") >= apart) & (F.col("high") >= least_high)
    kept = lambda c: F.when(some, F.col(c)).alias(c)
    return c.select(*keys, F.when(good, (F.col("low") + F.col("high")) / 2).otherwise(F.lit(float(fallback))).alias("threshold"), kept("low"), kept("high"))


def bounds(centres: DataFrame, low_share: float, high_share: float, median: Column, least: float = 0.025, share: float = 0.08) -> tuple[Column, Column]:
    """Two thresholds between centres that are far enough apart, else the median for both."""
    apart = F.col("high") - F.col("low") >= F.greatest(F.lit(least), share * F.greatest(F.col("high"), F.lit(1e-6)))
    at = lambda s: F.when(apart, F.col("low") + s * (F.col("high") - F.col("low"))).otherwise(median)
    return at(low_share), at(high_share)


def fused_rounds(rounds: list[DataFrame], value: str, at: str, *, gap: int, persist_gap: int, fallback: float, apart: float, least_high: float, width: int = 5) -> DataFrame:
    """All rows of several rounds with one threshold fitted to all of them: smoothed, state, and the size of the run of closed rows they are in.

    Rows are (entity, event_id, `at`, `value`). The threshold is `shared_threshold` of all rows; within groups of an entity's
    rows without a gap above `gap`, values are smoothed by a centred median of `width` rows (fewer at the ends), and a row is
    closed at or above the threshold. `persistence` counts the consecutive closed rows around one without a gap above
    `persist_gap`, 0 for open ones. Rows without a value or a time are left out; repeated rows count each, as rounds may
    have frames in common.
    """
    from pyspark.sql import Window

    from chronoweave.operators.tracking import gap_groups

    rows = rounds[0]
    for more in rounds[1:]:
        rows = rows.unionByName(more)
    rows = written(rows.where(F.col(value).isNotNull() & F.col(at).isNotNull()), "rounds")
    cut = shared_threshold(rows, value, [], fallback=fallback, apart=apart, least_high=least_high).select("threshold")
    grouped = gap_groups(rows, at, gap)
    here = Window.partitionBy("entity", "group_no").orderBy(at, "event_id")
    smooth = F.percentile(value, F.lit(0.5)).over(here.rowsBetween(-(width // 2), width // 2))
    states = grouped.withColumn("smoothed", smooth).join(F.broadcast(cut)).withColumn("closed", F.col("smoothed") >= F.col("threshold"))  # one row
    runs = gap_groups(states, at, persist_gap, name="_part")
    by = Window.partitionBy("entity", "_part").orderBy(at, "event_id")
    runs = runs.withColumn("_run", F.sum((~F.col("closed")).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count_if("closed").over(Window.partitionBy("entity", "_part", "_run"))
    return runs.withColumn("persistence", F.when(F.col("closed"), size).otherwise(F.lit(0)).cast("long")).drop("_part", "_run")
