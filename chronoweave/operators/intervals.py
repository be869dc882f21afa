"""Intervals of entities: merging, runs, boundaries, gap fill, conflicts. Everything is a window over one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("first_s", "last_s", "event_id")


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows within `keys`, a new one wherever `starts` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def merge_overlaps(rows: DataFrame, keys: tuple[str, ...] = ("entity", "action")) -> DataFrame:
    """Intervals of one key that overlap or touch become one, represented by the first row of the highest confidence."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    before = F.max("last_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = islands(rows, list(keys), list(ORDER), before.isNull() | (F.col("first_s") > before))
    best = F.max_by("event_id", F.struct("conf", -F.col("first_s"), -F.col("last_s"), -F.col("event_id")))
    return grouped.groupBy(*keys, "island").agg(F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.max("conf").alias("conf"), best.alias("event_id"), F.count(F.lit(1)).alias("members")).drop("island")


def parted(rows: DataFrame) -> DataFrame:
    """Rows dealt by entity to as many tasks as the session has shuffle partitions: without the number, small rows would be joined to a few large tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity")


def stage_runs(rows: DataFrame, stage: str = "action", gap: int = 3600) -> DataFrame:
    """Runs of one stage with gaps of at most `gap`; another stage in between always splits.

    Every window is in the one order, so that rows are sorted once; the running number of starts is the run's number.
    """
    w = Window.partitionBy("entity").orderBy(*ORDER)
    slim = parted(rows.select("entity", F.col(stage).alias("stage"), "first_s", "last_s", "event_id"))
    rows = islands(slim, ["entity"], list(ORDER), F.coalesce(F.col("stage") != F.lag("stage").over(w), F.lit(True)), "_block")
    # blocks only grow, so the largest (block, last_s) before a row has the latest end of its own block, if that has begun
    before = F.max(F.struct("_block", "last_s")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before)
    known = F.when(F.col("_before._block") == F.col("_block"), F.col("_before.last_s"))
    rows = islands(rows.withColumn("_before", known), ["entity"], list(ORDER), F.col("_before").isNull() | (F.col("first_s") > F.col("_before") + gap), "run_no")
    runs = rows.groupBy("entity", "stage", "run_no").agg(F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.count(F.lit(1)).alias("members"))
    return runs.select("entity", "stage", "first_s", "last_s", "members", F.col("run_no").cast("long").alias("run_no"))


def cycle_runs(rows: DataFrame, cycle: str, stage: str = "action", gap: int = 3600) -> DataFrame:
    """As `stage_runs`, but rows of one cycle stay together whatever the gap."""
    w = Window.partitionBy("entity").orderBy(*ORDER)
    other = F.coalesce(F.col(stage) != F.lag(stage).over(w), F.lit(True))
    far = F.col("first_s") > F.max("last_s").over(w.rowsBetween(Window.unboundedPreceding, -1)) + gap
    rows = islands(rows, ["entity"], list(ORDER), other | (far & ~F.col(cycle).eqNullSafe(F.lag(cycle).over(w))))
    return rows.groupBy("entity", F.col(stage).alias("stage"), "island").agg(F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.count(F.lit(1)).alias("members")).drop("island")


def boundaries(runs: DataFrame) -> DataFrame:
    """Where one run's stage gives way to the next one's: between its end and the next start, in either order."""
    w = Window.partitionBy("entity").orderBy("run_no")
    rows = runs.withColumns({"to_stage": F.lead("stage").over(w), "next_s": F.lead("first_s").over(w)})
    rows = rows.where("to_stage is not null and to_stage <> stage")
    return rows.select("entity", "run_no", F.col("stage").alias("from_stage"), "to_stage", F.least("last_s", "next_s").alias("low_s"), F.greatest("last_s", "next_s").alias("high_s"))


def monotone(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Keep the rows whose value is above all before it: those that accepting in order, one by one, would accept."""
    before = F.max(value).over(Window.partitionBy("entity").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(value) > F.col("_before"))).drop("_before")


def gap_fill(runs: DataFrame, low: Column, high: Column) -> DataFrame:
    """Cover [low, high] of each entity: observed pieces cut to what is not yet covered, and unclassified pieces between.

    One pass: each run gives its hole before, its own piece and, if it is the last one, what is left behind it.
    """
    order = Window.partitionBy("entity").orderBy("first_s", "last_s", "run_no")
    w = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumns({"_low": low, "_high": high}).where("last_s > _low and first_s < _high").withColumn("_end", F.least("last_s", "_high"))
    rows = rows.withColumns({"_before": F.max("_end").over(w), "_tops": F.max("_high").over(w), "_last": F.lead(F.lit(1)).over(order).isNull()})
    done, hole = F.greatest("_low", F.coalesce("_before", "_low")), F.lit("unclassified")
    piece = lambda stage, first, last: F.struct(stage.alias("stage"), first.alias("first_s"), last.alias("last_s"))
    tail = F.when(F.col("_last"), piece(hole, F.greatest("_before", "_end"), F.greatest("_tops", "_high")))
    pieces = F.array(piece(F.col("stage"), F.greatest(F.col("first_s"), done), F.col("_end")), piece(hole, done, F.col("first_s")), tail)
    return rows.select("entity", F.explode(pieces).alias("_piece")).select("entity", "_piece.*").where("last_s > first_s")


def bucketed(rows: DataFrame, first: str, last: str, bucket: int) -> DataFrame:
    """A row for each time bucket that an interval touches, so that overlap becomes an equality join."""
    return rows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.col(last) / bucket))))


def conflicts(rows: DataFrame, bucket: int = 86400) -> DataFrame:
    """Pairs of overlapping intervals of one entity with different certain actions, joined by entity and day."""
    sure = rows.where("action <> 'uncertain'").select("entity", "event_id", "action", "first_s", "last_s")
    b = bucketed(sure, "first_s", "last_s", bucket).alias("b")
    a = bucketed(sure, "first_s", "last_s", bucket).alias("a")
    met = (F.col("a.entity") == F.col("b.entity")) & (F.col("a._bucket") == F.col("b._bucket")) & (F.col("a.event_id") < F.col("b.event_id")) & (F.col("a.action") != F.col("b.action")) & (F.col("a.first_s") <= F.col("b.last_s")) & (F.col("b.first_s") <= F.col("a.last_s"))
    # a pair that meets in several buckets is kept in the first
    once = F.col("a._bucket") == F.floor(F.greatest("a.first_s", "b.first_s") / bucket)
    return a.join(b, met & once).select("a.entity", F.col("a.event_id").alias("event_a"), F.col("b.event_id").alias("event_b"), F.greatest("a.first_s", "b.first_s").alias("overlap_from"), F.least("a.last_s", "b.last_s").alias("overlap_to"))


def change_points(rows: DataFrame, stage: str, at: str, end: Column) -> DataFrame:
    """Stages from change to change, the last one up to `end`; of rows at one time the last by event_id counts."""
    rows = rows.groupBy("entity", at).agg(F.max_by(stage, "event_id").alias("stage"), F.max(end).alias("_end"))
    w = Window.partitionBy("entity").orderBy(at)
    rows = rows.withColumn("_was", F.lag("stage").over(w)).where("_was is null or _was <> stage")
    return rows.select("entity", "stage", F.col(at).alias("from_s"), F.coalesce(F.lead(at).over(w), F.col("_end")).alias("to_s"))


def longest_gap(rows: DataFrame, visible: str, at: str) -> DataFrame:
    """The longest run of rows that are not visible, of each entity: its rows and the middle of its time."""
    w = Window.partitionBy("entity").orderBy(at)
    runs = islands(rows, ["entity"], [at], F.coalesce(F.col(visible) != F.lag(visible).over(w), F.lit(True))).where(~F.col(visible))
    runs = runs.groupBy("entity", "island").agg(F.count(F.lit(1)).alias("rows"), ((F.min(at) + F.max(at)) / 2).alias("middle"), F.min(at).alias("_first"))
    return runs.groupBy("entity").agg(F.max("rows").alias("rows"), F.max_by("middle", F.struct("rows", -F.col("_first"))).alias("middle"))
