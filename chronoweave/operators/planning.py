"""Windows, episodes and samples planned from stage runs and scored rows; boundaries compiled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.folds import Fold, folded
from chronoweave.operators.intervals import islands


def snapped(times: DataFrame, at: str, rate: float, frames: Column) -> DataFrame:
    """Times to frame numbers within the video; of times that meet in a frame the first by position stays."""
    rows = times.withColumn("frame", F.least(frames - 1, F.greatest(F.lit(0), F.rint(F.col(at) * rate))).cast("long"))
    return rows.groupBy("entity", "frame").agg(F.min("position").alias("position"))


def coarse_chunks(runs: DataFrame, stages: list[str], length: int, whole: DataFrame) -> DataFrame:
    """Chunks of `length` of the wanted stages' runs; of an entity without one, chunks of its whole span (`whole`)."""
    cut = lambda rows, source: rows.where("last_s > first_s").select("entity", F.explode(F.sequence("first_s", F.col("last_s") - 1, F.lit(length).cast("long"))).alias("from_s"), F.col("last_s").alias("_end"), F.lit(source).alias("source")).select("entity", "from_s", F.least(F.col("from_s") + length, F.col("_end")).alias("to_s"), "source")
    wanted = runs.where(F.col("stage").isin(stages))
    return cut(wanted, "stage").unionByName(cut(whole.join(wanted.select("entity").distinct(), "entity", "left_anti"), "fallback"))


def cycle_windows(runs: DataFrame, recording: str, measuring: str, rewiring: str, *, before: int, after: int, inset: int) -> DataFrame:
    """For every recording run: the paper window, up to `after` later or the next recording, and the meter window before it.

    The meter window begins `inset` before the last measurement that ended by then, or `before` ahead, not before the
    last rewiring's end.
    """
    w = Window.partitionBy("entity").orderBy("first_s", "run_no")
    rows = runs.withColumn("next_s", F.min(F.when(F.col("stage") == recording, F.col("first_s"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    for name, stage in (("m", measuring), ("r", rewiring)):
        rows = rows.withColumn(name, F.max(F.when(F.col("stage") == stage, F.struct("last_s", "first_s"))).over(past))
    rows = rows.where(F.col("stage") == recording)
    own = F.col("m.last_s") <= F.col("first_s")
    meter = F.when(own, F.greatest(F.lit(0), F.col("m.first_s") - inset)).otherwise(F.greatest(F.lit(0), F.col("first_s") - before, F.when(F.col("r.last_s") <= F.col("first_s"), F.col("r.last_s")).otherwise(0)))
    return rows.select("entity", "run_no", F.col("first_s").alias("paper_from"), F.least(F.col("last_s") + after, F.greatest(F.col("last_s"), F.coalesce("next_s", F.col("last_s") + after))).alias("paper_to"), meter.alias("meter_from"), F.col("first_s").alias("meter_to"), F.coalesce(own, F.lit(False)).alias("measured"))


def episodes(runs: DataFrame, core: str, repeated: list[str], low: int, high: int) -> DataFrame:
    """Runs of the core stage, and gaps of `low` to `high` between repeated runs of another stage that touch no core run."""
    given = runs.where(F.col("stage") == core).select("entity", "first_s", "last_s", F.lit("stage").alias("source"))
    w = Window.partitionBy("entity", "stage").orderBy("first_s", "last_s")
    gaps = runs.where(F.col("stage").isin(repeated)).withColumn("next_s", F.lead("first_s").over(w))
    gaps = gaps.where((F.col("next_s") - F.col("last_s")).between(low, high)).select("entity", F.col("last_s").alias("first_s"), F.col("next_s").alias("last_s"), F.col("stage").alias("source"))
    # touching: the core run with the greatest end among those that begin by the gap's end
    both = gaps.withColumn("_at", F.col("last_s")).unionByName(given.withColumn("_at", F.col("first_s")))
    order = Window.partitionBy("entity").orderBy("_at", F.when(F.col("source") == "stage", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_reach", F.max(F.when(F.col("source") == "stage", F.col("last_s"))).over(order))
    return both.where((F.col("source") == "stage") | F.col("_reach").isNull() | (F.col("_reach") < F.col("first_s"))).select("entity", "first_s", "last_s", "source")


def next_stable(runs: DataFrame, opener: str, stable: list[str]) -> DataFrame:
    """Windows from a run of the opener to the first stable run that ends after it."""
    w = Window.partitionBy("entity").orderBy("last_s", "run_no")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    pick = F.min(F.when(F.col("stage").isin(stable), F.struct("last_s", "run_no", "stage", "first_s"))).over(after)
    return runs.withColumn("_n", pick).where((F.col("stage") == opener) & F.col("_n").isNotNull()).select("entity", "run_no", F.col("last_s").alias("from_s"), F.col("_n.last_s").alias("to_s"), F.col("_n.stage").alias("stable_stage"))


def followed_by(runs: DataFrame, first: str, then: str, guard: int) -> DataFrame:
    """Every run of `first`: the window around its end, up to `guard` into the next run, if that one is `then`; else why not."""
    w = Window.partitionBy("entity").orderBy("run_no")
    rows = runs.withColumns({"_next": F.lead("stage").over(w), "_from": F.lead("first_s").over(w), "_to": F.lead("last_s").over(w)}).where(F.col("stage") == first)
    good = F.coalesce(F.col("_next") == then, F.lit(False))
    return rows.select("entity", "run_no", F.when(good, F.col("last_s")).alias("from_s"), F.when(good, F.least("_to", F.col("_from") + guard)).alias("to_s"), F.when(~good, "not_immediately_followed").alias("reason"))


def profile_windows(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Windows of every profile (profile, stage, mode, before_s, after_s): around a run, before it, after it, or its tail."""
    rows = runs.join(profiles, "stage")  # Spark sends profiles out where they are as few as they should be
    mode = F.col("mode")
    low = F.when(mode == "after", F.col("last_s")).when(mode == "tail", F.greatest("first_s", F.col("last_s") - F.col("before_s"))).otherwise(F.greatest(F.lit(0), F.col("first_s") - F.col("before_s")))
    high = F.when(mode == "before", F.col("first_s")).otherwise(F.col("last_s") + F.when(mode == "tail", 0).otherwise(F.col("after_s")))
    return rows.select("profile", "entity", "run_no", mode, low.alias("from_s"), high.alias("to_s"))


def bucket_supplement(rows: DataFrame, base: DataFrame, at: str, score: str, *, bucket: int, apart: int, share: int = 25) -> DataFrame:
    """One peak a bucket that reaches the bucket's median and is `apart` from every base time; the best, up to a share of the base's number."""
    both = rows.select("entity", F.col(at).alias("_at"), "event_id", F.col(score).alias("_score")).unionByName(base.select("entity", F.col(at).alias("_at"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("_score")))
    w = Window.partitionBy("entity").orderBy("_at")
    known = F.when(F.col("event_id").isNull(), F.col("_at"))
    near = F.least(F.col("_at") - F.max(known).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.min(known).over(w.rangeBetween(0, Window.unboundedFollowing)) - F.col("_at"))
    both = both.withColumns({"_near": near, "_base": F.count(known).over(Window.partitionBy("entity")), "_bucket": F.floor(F.col("_at") / bucket)})
    free = both.where("event_id is not null").where(F.col("_near").isNull() | (F.col("_near") >= apart))
    b = Window.partitionBy("entity", "_bucket")
    free = free.withColumns({"_m": F.median("_score").over(b), "_k": F.row_number().over(b.orderBy(F.desc("_score"), "_at", "event_id"))}).where("_k = 1 and _score >= _m")
    free = free.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("_score"), "_bucket"))).where(F.col("_r") <= F.floor(F.col("_base") * share / 100))
    return free.select("entity", "event_id", F.col("_bucket").alias("bucket"))


def plateaus(rows: DataFrame, motion: str, view: str, at: str, *, share: float = 0.45, gap: int = 1) -> DataFrame:
    """Of each stretch of low motion, up to the nearest-rank percentile `share`, the row with the best view, the latest of equals."""
    w = Window.partitionBy("entity")
    rank = F.row_number().over(w.orderBy(motion, "event_id"))
    n = F.count(F.lit(1)).over(w)
    rows = rows.withColumn("_cut", F.when(rank == F.rint((n - 1) * share) + 1, F.col(motion))).withColumn("_cut", F.max("_cut").over(w)).where(F.col(motion) <= F.col("_cut"))
    o = Window.partitionBy("entity").orderBy(at, "event_id")
    rows = islands(rows, ["entity"], [at, "event_id"], ~F.coalesce(F.col(at) - F.lag(at).over(o) <= gap, F.lit(False)), "plateau")
    return rows.groupBy("entity", "plateau").agg(F.max_by("event_id", F.struct(view, at, "event_id")).alias("event_id"), F.count(F.lit(1)).alias("rows"))


def reason_first(rows: DataFrame, reason: str, order: list, limit: int) -> DataFrame:
    """One row a reason first, then the others, in order, up to `limit` of an entity."""
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("entity", reason).orderBy(*order)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.col("_n") > 1, *order))).where(F.col("rank") <= limit).drop("_n")


def cycles(states: DataFrame, order: list[str], at: str, end: Column) -> DataFrame:
    """Passes from the last switch to absent to the switch back to present, the last one perhaps open to the end.

    A table that begins absent has its first pass from 0 on, if it ever ends.
    """
    w = Window.partitionBy("entity").orderBy(*order)
    was = F.lag("state").over(w)
    rows = states.withColumns({"_was": was, "_end": end, "_first": F.first("state").over(w)}).withColumn("_gone", F.when((F.col("state") == "absent") & (F.col("_was") == "present"), F.col(at)))
    rows = rows.where(F.col("_was").isNull() | (F.col("_was") != F.col("state")))
    w = Window.partitionBy("entity").orderBy(*order)
    rows = rows.withColumns({"_start": F.coalesce(F.lag("_gone").over(w), F.when(F.col("_first") == "absent", F.lit(0))), "_last": F.lead("state").over(w).isNull()})
    whole = rows.where("state = 'present' and _was = 'absent'").select("entity", F.col("_start").cast("long").alias("from_s"), F.col(at).alias("to_s"), F.lit(True).alias("complete"))
    return whole.unionByName(rows.where("_last and _gone is not null").select("entity", F.col("_gone").alias("from_s"), F.greatest(F.col("_gone"), F.col("_end")).alias("to_s"), F.lit(False).alias("complete")))


def collapsed_boundaries(runs: DataFrame) -> DataFrame:
    """Runs of one stage in a row as one, and where each gives way to the next."""
    w = Window.partitionBy("entity").orderBy("run_no")
    rows = islands(runs, ["entity"], ["run_no"], F.coalesce(F.col("stage") != F.lag("stage").over(w), F.lit(True)), "_r").groupBy("entity", "_r", "stage").agg(F.min_by("first_s", "run_no").alias("first_s"))
    w = Window.partitionBy("entity").orderBy("_r")
    return rows.withColumns({"to_stage": F.lead("stage").over(w), "at_s": F.lead("first_s").over(w)}).where("to_stage is not null").select("entity", F.col("stage").alias("from_stage"), "to_stage", "at_s")


def promoted_end(rows: DataFrame, kind: str = "cleanup", window: int = 86400) -> DataFrame:
    """An entity's earliest row of `kind` within `window` of its last row is its end; later ones of other kinds are quarantined."""
    w = Window.partitionBy("entity")
    rows = rows.withColumn("_last", F.max("first_s").over(w)).withColumn("_end", F.min(F.when((F.col("action") == kind) & (F.col("first_s") >= F.col("_last") - window), F.struct("first_s", "event_id"))).over(w))
    me = F.struct("first_s", "event_id")
    return rows.withColumn("role", F.when(me == F.col("_end"), "end").when(me > F.col("_end"), "quarantined").otherwise("kept")).drop("_last", "_end")


class Increasing(Fold):
    """Starts that strictly increase; all that is kept is the last one."""

    def __init__(self):
        self.last = None

    def row(self, r):
        if self.last is None:
            start, source = r["low"], "fixed"
        else:
            fits = lambda v: v is not None and self.last + 1 < v < r["high"] - 1
            source = next((n for n in ("refined", "coarse") if fits(r[f"{n}_s"])), "unusable")
            start = r[f"{source}_s"] if source != "unusable" else min(r["high"] - 1, max(self.last + 1, r["coarse_s"]))
        self.last = start
        return [(r["entity"], r["position"], r["high"], start, source)]


def compiled(segments: DataFrame, low: Column, high: Column) -> DataFrame:
    """Segments with starts that strictly increase within (low, high): the refined one, else the coarse one, else the least that does.

    segments: entity, position (from 0), coarse_s, refined_s (may be null), all in thousandths. Segments stream past in order, so
    that an entity's number of them doesn't matter.
    """
    rows = segments.select("entity", "position", "coarse_s", "refined_s", low.alias("low"), high.alias("high"))
    out = folded(rows, ["entity"], ["position"], Increasing, f"entity {segments.schema['entity'].dataType.simpleString()}, position long, high long, start_s long, source string")
    return out.withColumn("end_s", F.coalesce(F.lead("start_s").over(Window.partitionBy("entity").orderBy("position")), F.col("high"))).where("end_s > start_s").drop("high")


def chain(rows: DataFrame) -> DataFrame:
    """Per entity and episode: does every relocation stand after the last switch being open and before the next being closed, with none against it?

    rows: entity, episode, at_s, event_id, kind ('open', 'closed', 'relocation').
    """
    w = Window.partitionBy("entity", "episode").orderBy("at_s", "event_id")
    switch = F.when(F.col("kind") != "relocation", F.col("kind"))
    before = F.last(switch, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(switch, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"_before": before, "_after": after}).where("kind = 'relocation'")
    good = F.coalesce((F.col("_before") == "open") & (F.col("_after") == "closed"), F.lit(False))
    return rows.groupBy("entity", "episode").agg(F.count(F.lit(1)).alias("relocations"), F.count_if(~good).alias("violations")).withColumn("decision", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def edge_touches(rows: DataFrame, window: int, tolerance: int, last: int | None = None) -> DataFrame:
    """Rows that touch a border between windows, by border and action; a border with rows of one action on both sides is bridged.

    Borders are the multiples of `window` above 0, up to `last` if it is given; a row touches those at most `tolerance` from its
    start or its end, both bounds included.
    """
    near = lambda x: (F.ceil((F.col(x) - tolerance) / window), F.floor((F.col(x) + tolerance) / window))
    borders = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    touched = F.array_distinct(F.concat(*(F.coalesce(borders(*near(x)), F.array().cast("array<bigint>")) for x in ("first_s", "last_s"))))
    sides = rows.withColumn("_b", F.explode(touched)).withColumn("_t", F.col("_b") * window)
    if last is not None:
        sides = sides.where(F.col("_t") <= last)
    left = F.abs(F.col("last_s") - F.col("_t")) <= tolerance
    right = F.abs(F.col("first_s") - F.col("_t")) <= tolerance
    sides = sides.where((F.col("_t") > 0) & (left | right))
    return sides.groupBy("entity", "action", F.col("_t").cast("long").alias("border_s")).agg(F.count_if(left).alias("before"), F.count_if(right).alias("after")).withColumn("bridged", (F.col("before") > 0) & (F.col("after") > 0))
