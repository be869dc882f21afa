"""Matching rows by time: nearest, as-of, band, witness and anti joins, always within an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, at: str, value: str, strict: bool = False) -> DataFrame:
    """`left` with the last `value` of `right` at or before (strict: before) its time; one union and one window, no join.

    Of right rows at one time the one with the largest `value` counts.
    """
    rank = 1 if not strict else -1
    both = left.withColumns({"_side": F.lit(0), "_value": F.lit(None).cast(right.schema[value].dataType)}).unionByName(right.select("entity", at, F.col(value).alias("_value"), F.lit(-rank).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy("entity").orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value + "_asof", F.last("_value", ignorenulls=True).over(w)).where("_side = 0").drop("_side", "_value")


def nearest(left: DataFrame, right: DataFrame, at: str, value: str) -> DataFrame:
    """`left` with the `value` and distance of the right row nearest in time; an earlier one wins ties, then the smaller value."""
    kind = right.schema[value].dataType
    both = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(kind), "_at": F.lit(None).cast("long")}).unionByName(right.select("entity", at, F.col(value).alias("_value"), F.col(at).cast("long").alias("_at"), F.lit(0).alias("_side")), allowMissingColumns=True)
    hit = F.when(F.col("_side") == 0, F.struct("_at", "_value"))
    back = Window.partitionBy("entity").orderBy(F.col(at), F.col("_side"), F.col("_value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("entity").orderBy(F.col(at).desc(), F.col("_side"), F.col("_value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumns({"_b": F.last(hit, ignorenulls=True).over(back), "_a": F.last(hit, ignorenulls=True).over(ahead)}).where("_side = 1")
    before, after = F.col(at) - F.col("_b._at"), F.col("_a._at") - F.col(at)
    first = F.col("_a").isNull() | (F.col("_b").isNotNull() & (before <= after))
    return rows.withColumns({value + "_near": F.when(first, F.col("_b._value")).otherwise(F.col("_a._value")), "distance": F.when(first, before).otherwise(after)}).drop("_side", "_value", "_at", "_b", "_a")


def band(left: DataFrame, right: DataFrame, at: str, reach: int) -> DataFrame:
    """Pairs at most `reach` apart in time: buckets of that width make it an equality join with three buckets on one side."""
    a = left.withColumn("_bucket", F.floor(F.col(at) / reach)).alias("a")
    b = right.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(at) / reach) + k for k in (-1, 0, 1))))).alias("b")
    return a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a._bucket") == F.col("b._bucket")) & (F.abs(F.col(f"a.{at}") - F.col(f"b.{at}")) <= reach))


def gaps_without(rows: DataFrame, opening: str, closing: str, between: str) -> DataFrame:
    """From each `opening` to the first `closing` after it, where no `between` starts within: two windows ahead, no join."""
    later = Window.partitionBy("entity").orderBy("first_s", "event_id").rowsBetween(1, Window.unboundedFollowing)
    time = lambda action: F.min(F.when(F.col("action") == action, F.col("first_s"))).over(later)
    rows = rows.withColumns({"closes_s": time(closing), "_between": time(between)}).where((F.col("action") == opening) & F.col("closes_s").isNotNull())
    return rows.where(F.col("_between").isNull() | (F.col("_between") > F.col("closes_s"))).select("entity", "event_id", "last_s", "closes_s")


def with_witness(rows: DataFrame, others: DataFrame, same_action: bool = True, bucket: int = 86400) -> DataFrame:
    """Rows that overlap another row of the same (or another) action; rows meet in the time buckets that both touch, so a hot entity is split by time."""
    span = lambda x: F.explode(F.sequence(F.floor(F.col("first_s") / bucket), F.floor(F.col("last_s") / bucket)))
    a = rows.withColumn("_bucket", span(rows)).alias("a")
    b = others.select("entity", "event_id", "action", "first_s", "last_s").withColumn("_bucket", span(others)).alias("b")
    kind = F.col("a.action") == F.col("b.action") if same_action else F.col("a.action") != F.col("b.action")
    met = (F.col("a.entity") == F.col("b.entity")) & (F.col("a._bucket") == F.col("b._bucket")) & (F.col("a.event_id") != F.col("b.event_id")) & kind & (F.col("a.first_s") <= F.col("b.last_s")) & (F.col("b.first_s") <= F.col("a.last_s"))
    return a.join(b, met, "left_semi").drop("_bucket").dropDuplicates(["entity", "event_id"])


def known_rows_removed(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(known, on, "left_anti")


def lookups(base: DataFrame, *tables: tuple[DataFrame, str, dict[str, object]]) -> DataFrame:
    """Left lookups by key, with a default for each column where nothing is found; each table has one row a key."""
    for table, key, defaults in tables:
        base = base.join(table, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return base


def compare_by_position(actual: DataFrame, wanted: DataFrame, tolerance: float) -> DataFrame:
    """Runs of an entity compared by position: missing on either side, another stage or times apart by more than `tolerance`."""
    both = actual.alias("a").join(wanted.alias("w"), (F.col("a.entity") == F.col("w.entity")) & (F.col("a.run_no") == F.col("w.run_no")), "full")
    state = F.when(F.col("a.stage").isNull(), "missing").when(F.col("w.stage").isNull(), "unexpected").when(F.col("a.stage") != F.col("w.stage"), "stage")
    far = (F.abs(F.col("a.first_s") - F.col("w.first_s")) > tolerance) | (F.abs(F.col("a.last_s") - F.col("w.last_s")) > tolerance)
    return both.select(F.coalesce("a.entity", "w.entity").alias("entity"), F.coalesce("a.run_no", "w.run_no").alias("run_no"), state.when(far, "time").otherwise("same").alias("state"))
