"""Reducers: many observations of one entity to a state, a value or a decision, with a group-by, a window or two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.intervals import islands


def first_supported(rows: DataFrame, keys: list[str], state: str, frame: str, conf: str, order: list[str], other: str, *, frames: int = 2, least: int = 850) -> DataFrame:
    """The first state of `order` that `frames` distinct frames show with `least` confidence, with its least confidence; else `other`."""
    sure = F.col(conf) >= least
    tell = [(s, F.count_distinct(F.when(sure & (F.col(state) == s), F.col(frame))), F.min(F.when(sure & (F.col(state) == s), F.col(conf)))) for s in order]
    rows = rows.groupBy(*keys).agg(*(x.alias(f"_{k}{i}") for i, (_, n, c) in enumerate(tell) for k, x in (("n", n), ("c", c))))
    pick = lambda value: F.coalesce(*(F.when(F.col(f"_n{i}") >= frames, value(i, s)) for i, s in enumerate(order)))
    return rows.select(*keys, F.coalesce(pick(lambda i, s: F.lit(s)), F.lit(other)).alias("state"), pick(lambda i, s: F.col(f"_c{i}")).alias("conf"))


def fused_geometry(rows: DataFrame, keys: list[str], raw: str, division: str, conf: str, *, most: float = 1.25) -> DataFrame:
    """Median of raw values snapped to the division, where two or more lie within `most` divisions; else a conflict."""
    got = rows.groupBy(*keys).agg(F.count(raw).alias("n"), (F.max(raw) - F.min(raw)).alias("spread"), F.median(raw).alias("median"), F.first(division).alias("division"), F.min(conf).alias("conf")).where("n >= 2")
    fits = F.col("spread") <= F.col("division") * most
    return got.select(*keys, F.when(fits, "fused").otherwise("conflict").alias("status"), F.when(fits, F.round(F.rint(F.col("median") / F.col("division")) * F.col("division"), 6)).alias("value"), F.when(fits, F.col("conf")).alias("conf"))


def robust(rows: DataFrame, keys: list[str], values: list[str], *, least: float = 3.0, times: float = 3.0) -> DataFrame:
    """Rows whose every value is within max(least, times * MAD) of the median of its key."""
    w = Window.partitionBy(*keys)
    for v in values:
        rows = rows.withColumn("_m", F.median(v).over(w)).withColumn("_off", F.abs(F.col(v) - F.col("_m"))).withColumn(f"_keep_{v}", F.col("_off") <= F.greatest(F.lit(least), times * F.median("_off").over(w))).drop("_m", "_off")
    keep = [F.col(f"_keep_{v}") for v in values]
    return rows.where(F.forall(F.array(*keep), lambda x: x)).drop(*(f"_keep_{v}" for v in values))


def grid_consensus(rows: DataFrame, keys: list[str], zero: str, full: str, pointer: str, divisions: int = 30) -> DataFrame:
    """After outliers of the ends are gone: median ends, and the median of the nearest division of each pointer, half up."""
    w = Window.partitionBy(*keys)
    kept = robust(rows, keys, [zero, full]).withColumns({"_z": F.median(zero).over(w), "_f": F.median(full).over(w)})
    raw = (F.col("_z") - F.col(pointer)) / (F.col("_z") - F.col("_f")) * divisions
    kept = kept.withColumn("_tick", F.least(F.lit(divisions), F.greatest(F.lit(0), F.floor(raw + 0.5).cast("int"))))
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("used"), F.first("_z").alias("zero"), F.first("_f").alias("full"), F.floor(F.median("_tick") + 0.5).cast("long").alias("division"))


def sequence_state(rows: DataFrame, keys: list[str], state: str, angle: str, order: list[str], *, share: float = 0.6, most: float = 8.0) -> DataFrame:
    """The commonest state (the first seen of equals) if it has `share` of the rows and the angles' MAD is within `most`; angles are unwrapped around the first."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_ref", F.first(angle).over(w.orderBy(*order))).withColumn("_at", F.row_number().over(w.orderBy(*order)))
    rows = rows.withColumn("_a", F.col("_ref") + F.pmod(F.col(angle) - F.col("_ref") + 180, F.lit(360.0)) - 180).withColumn("_off", F.abs(F.col("_a") - F.median("_a").over(w)))
    n, by_state = F.count(F.lit(1)), [*keys, state]
    best = rows.groupBy(*by_state).agg(n.alias("n"), F.min("_at").alias("first")).groupBy(*keys).agg(F.max_by(F.col(state), F.struct("n", -F.col("first"))).alias("best"), F.max("n").alias("votes"), F.sum("n").alias("rows"))
    spread = rows.groupBy(*keys).agg(F.median("_a").alias("median"), F.median("_off").alias("mad"))
    stable = (F.col("rows") == 1) | ((F.col("votes") >= share * F.col("rows")) & (F.col("mad") <= most))
    return best.join(spread, keys).select(*keys, "rows", "votes", "median", "mad", F.when(stable, F.col("best")).otherwise("uncertain").alias("state"))


def stability_windows(rows: DataFrame, frame: str, at: str, angle: str, *, frames: int = 3, gap: int = 1, most: float = 2.0) -> DataFrame:
    """Runs of consecutive frames with small time gaps: rows, median, MAD and whether they are stable."""
    w = Window.partitionBy("entity").orderBy(frame)
    rows = islands(rows, ["entity"], [frame], ~F.coalesce((F.col(frame) == F.lag(frame).over(w) + 1) & (F.col(at) - F.lag(at).over(w) <= gap), F.lit(False)), "run")
    rows = rows.withColumn("_off", F.abs(F.col(angle) - F.median(angle).over(Window.partitionBy("entity", "run"))))
    runs = rows.groupBy("entity", "run").agg(F.count(F.lit(1)).alias("rows"), F.min(frame).alias("first_frame"), F.median(angle).alias("median"), F.median("_off").alias("mad"))
    return runs.withColumn("status", F.when(F.col("rows") < frames, "evidence_insufficient").when(F.col("mad") > most, "unstable_candidate").otherwise("stable_candidate")).drop("run")


def first_of(rows: DataFrame, keys: list[str], first: Column, other: Column, order: list[str]) -> DataFrame:
    """Of each key the earliest row where `first` holds, else the earliest where `other` does."""
    tier = F.when(first, 0).when(other, 1)
    w = Window.partitionBy(*keys).orderBy("_tier", *order)
    return rows.withColumn("_tier", tier).where("_tier is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_tier")


def overridden_decision(results: DataFrame, evidence: DataFrame, key: str, bad: Column, good: Column, missing: Column) -> DataFrame:
    """Results with the decision that evidence forces: any bad row fails, a good one passes a result that only lacks evidence; confidence rises to the evidence's."""
    e = evidence.groupBy(key).agg(F.max(F.when(bad, F.col("conf"))).alias("_bad"), F.max(F.when(good, F.col("conf"))).alias("_good"))
    out = results.join(e, key, "left").withColumn("_why", F.when(F.col("_bad").isNotNull(), "abnormal_overrides").when(F.col("_good").isNotNull() & missing, "normal_resolves_missing").otherwise("unchanged"))
    decision = F.when(F.col("_why") == "abnormal_overrides", "fail").when(F.col("_why") == "normal_resolves_missing", "pass").otherwise(F.col("decision"))
    conf = F.when(F.col("_why") == "abnormal_overrides", F.greatest("conf", "_bad")).when(F.col("_why") == "normal_resolves_missing", F.greatest("conf", "_good")).otherwise(F.col("conf"))
    return out.select(key, decision.alias("decision"), conf.alias("conf"), F.col("_why").alias("fusion"))


def cycle_result(paper: DataFrame, meter: DataFrame, keys: list[str], matched: Column) -> DataFrame:
    """pass where written and read value are both there and match, with the least confidence; else fail with the greatest, 550 at least."""
    both = paper.join(meter, keys, "full")
    ok = F.coalesce(F.col("written").isNotNull() & F.col("read").isNotNull() & matched, F.lit(False))
    low, high = F.least("paper_conf", "meter_conf"), F.greatest(F.lit(550), F.coalesce("paper_conf", F.lit(0)), F.coalesce("meter_conf", F.lit(0)))
    return both.select(*keys, F.when(ok, "pass").otherwise("fail").alias("decision"), F.least(F.lit(1000), F.when(ok, low).otherwise(high)).alias("conf"))


def evidence_quality(rows: DataFrame, seen: Column, moving: Column, closed_run: Column, *, coverage: float = 0.5) -> DataFrame:
    """Counts and reason codes of an entity's evidence; more frames are wanted where there is a reason."""
    n = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.count_if(seen).alias("seen"), F.count_if(moving).alias("moving"), F.count_if(moving & ~seen).alias("hidden"), F.count_if(seen & closed_run.between(1, 2)).alias("borderline"))
    codes = [
        F.when(F.col("seen") == 0, "no_observation").when(F.col("seen") < coverage * F.col("rows"), "low_coverage"),
        F.when(F.col("moving") == 0, "no_activity_observed"),
        F.when(F.col("hidden") > 0, "not_visible_during_activity"),
        F.when(F.col("borderline") > 0, "persistence_boundary"),
    ]
    return n.withColumn("reasons", F.array_compact(F.array(*codes)))


def chunk_merge(rows: DataFrame, order: list[str]) -> DataFrame:
    """Neighbouring chunks of one stage become one: mean confidence and the distinct texts in order."""
    w = Window.partitionBy("entity").orderBy(*order)
    rows = islands(rows, ["entity"], order, F.coalesce(F.col("stage") != F.lag("stage").over(w), F.lit(True)), "run").withColumn("_at", F.row_number().over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"])
    return rows.groupBy("entity", "run", "stage").agg(F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.avg("conf").alias("conf"), F.array_distinct(texts).alias("texts")).drop("run")
