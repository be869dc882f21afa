"""Windows and what belongs to them: clusters, samples, lookups of frames, anchors and boundaries, and runs brought into one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.folds import Fold, folded
from chronoweave.operators.sampling import uniform_pick


def adjacent_clusters(rows: DataFrame, window: str, at: str, gap: float, order: list[str]) -> DataFrame:
    """rows with `cluster_no`: in time order over all windows of an entity, a row goes on a cluster if it is of the same window as the one before and later by at most `gap`."""
    w = Window.partitionBy("entity").orderBy(at, *order)
    step = F.col(at) - F.lag(at).over(w)
    on = (F.col(window).eqNullSafe(F.lag(window).over(w))) & (step > 0) & (step <= gap)
    new = (~F.coalesce(on, F.lit(False))).cast("long")
    return rows.withColumn("_new", new).withColumn("cluster_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


class AroundMean(Fold):
    """Numbers clusters of falling angles: a row begins one if it is farther than the tolerance from the mean of the cluster so far."""

    def __init__(self, tolerance: float):
        self.tolerance, self.no, self.total, self.n = tolerance, -1, 0.0, 0

    def row(self, r):
        if not self.n or abs(r["angle"] - self.total / self.n) > self.tolerance:
            self.no, self.total, self.n = self.no + 1, 0.0, 0
        self.total, self.n = self.total + r["angle"], self.n + 1
        return [(r["entity"], r["event_id"], self.no, r["angle"], r["size"], r["distance"])]


def angle_clusters(rows: DataFrame, tolerance: float) -> DataFrame:
    """entity, cluster_no, event_id, angle, members: clusters of angles around their running mean, from the largest angle on.

    rows: entity, event_id, angle, size, distance. A cluster is shown by its largest row, the nearest and then the smallest id
    among several, at its median angle. Angles stream past, so a cluster may have any number of them.
    """
    kind = rows.schema["event_id"].dataType.simpleString()
    used = rows.where(F.col("angle").isNotNull()).select("entity", "event_id", F.col("angle").cast("double").alias("angle"), "size", "distance").withColumn("_down", -F.col("angle"))
    entity, size, distance = (rows.schema[c].dataType.simpleString() for c in ("entity", "size", "distance"))
    numbered = folded(used, ["entity"], ["_down", "event_id"], lambda: AroundMean(tolerance), f"entity {entity}, event_id {kind}, cluster_no long, angle double, size {size}, distance {distance}")
    best = F.max_by("event_id", F.struct("size", -F.col("distance"), -F.col("event_id")))
    return numbered.groupBy("entity", "cluster_no").agg(best.alias("event_id"), F.median("angle").alias("angle"), F.count(F.lit(1)).alias("members"))


def normalized_runs(raw: DataFrame) -> DataFrame:
    """entity, run_no, stage, start_s, end_s, run_id: runs (entity, position, stage, start_s and end_s as text, run_id) without the malformed ones, in order.

    A run needs a stage and two numbers, the end not before the start. One without an id gets one of its place in the input.
    """
    rows = raw.withColumns({"start_s": F.expr("try_cast(start_s as double)"), "end_s": F.expr("try_cast(end_s as double)"), "stage": F.coalesce("stage", F.lit(""))})
    rows = rows.where((F.col("stage") != "") & (F.col("end_s") >= F.col("start_s")) & ~F.isnan("start_s"))
    name = F.when(F.coalesce("run_id", F.lit("")) != "", F.col("run_id")).otherwise(F.format_string("run_%03d", F.col("position")))
    w = Window.partitionBy("entity").orderBy("start_s", "end_s", "stage", "position")
    return rows.select("entity", F.row_number().over(w).alias("run_no"), "stage", "start_s", "end_s", name.alias("run_id"))


def normalized_segments(records: DataFrame) -> DataFrame:
    """entity, position, start_s, end_s, error of records (entity, segments, actions): the one of the two arrays that is there, in its order.

    A record without either has one row with the error `missing`; one whose segment begins before the end of the one before has
    the error `overlap` in all its rows.
    """
    given = F.coalesce("segments", "actions")
    rows = records.select("entity", F.posexplode_outer(given).alias("position", "s")).select("entity", "position", F.col("s.start_s").alias("start_s"), F.col("s.end_s").alias("end_s"))
    w = Window.partitionBy("entity")
    early = F.coalesce(F.col("start_s") < F.lag("end_s").over(w.orderBy("position")) - 1e-6, F.lit(False))
    rows = rows.withColumn("_early", early)
    return rows.withColumn("error", F.when(F.col("position").isNull(), "missing").when(F.max("_early").over(w), "overlap")).drop("_early")


def observations_of_frames(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """The observation of each frame (window_id, at): of those that name its image group the one of a dense phase, without fallback, and of the most confidence.

    observations: event_id, image_group, conf, in the order of event_id; frames: image_group, entity, window_id, at, dense, fallback.
    Observations without a frame are left out; the first of equals stays.
    """
    met = observations.join(frames, "image_group")
    best = Window.partitionBy("entity", "window_id", "at").orderBy(F.col("dense").desc(), F.col("fallback").asc(), F.coalesce("conf", F.lit(0)).desc(), "event_id")
    return met.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def boundary_centres(boundaries: DataFrame, intervals: DataFrame, reach: int, half: int, low: Column, high: Column) -> DataFrame:
    """entity, boundary_no, selected_s, from_s, to_s, candidates: the planned time nearest to each boundary (entity, boundary_no, at_s), else the boundary itself.

    intervals: entity, first_s, last_s, planned (an array of times). A time counts if it and its interval touch the `reach` around
    the boundary, cut to low and high. Times meet boundaries in buckets of the reach; the earlier of two as near wins.
    """
    b = boundaries.select("entity", "boundary_no", "at_s", F.greatest(low, F.col("at_s") - reach).alias("_from"), F.least(high, F.col("at_s") + reach).alias("_to"))
    times = intervals.select("entity", "first_s", "last_s", F.explode("planned").alias("t")).withColumn("_bucket", F.explode(F.array(*(F.floor(F.col("t") / reach) + k for k in (-1, 0, 1)))))
    near = b.withColumn("_bucket", F.floor(F.col("at_s") / reach)).join(times, ["entity", "_bucket"])
    near = near.where((F.col("t") >= F.col("_from")) & (F.col("t") <= F.col("_to")) & (F.col("last_s") >= F.col("_from")) & (F.col("first_s") <= F.col("_to")))
    best = near.groupBy("entity", "boundary_no").agg(F.min(F.struct(F.abs(F.col("t") - F.col("at_s")).alias("d"), "t")).alias("_best"), F.count(F.lit(1)).alias("candidates"))
    out = b.join(best, ["entity", "boundary_no"], "left").withColumn("selected_s", F.coalesce("_best.t", "at_s"))
    return out.select("entity", "boundary_no", "selected_s", F.greatest(low, F.col("selected_s") - half).alias("from_s"), F.least(high, F.col("selected_s") + half).alias("to_s"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def windows_of_anchors(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """entity, event_id, window_no, how: the window an anchor (entity, event_id, window_id, stage, at_s) names, else the first of its stage that holds its time.

    windows: entity, window_no, window_id, stage, first_s, last_s. An anchor without a stage may be in one of any stage. Anchors and
    windows meet in the days that windows touch.
    """
    named = windows.where(F.coalesce("window_id", F.lit("")) != "").groupBy("entity", "window_id").agg(F.min("window_no").alias("_named"))
    rows = anchors.join(named, ["entity", "window_id"], "left")
    left = rows.where("_named is null and at_s is not null")
    spans = windows.select("entity", "window_no", F.col("stage").alias("_stage"), "first_s", "last_s")
    day = 86400
    held = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first_s") / day), F.greatest(F.floor(F.col("first_s") / day), F.floor(F.col("last_s") / day)))))
    inside = left.withColumn("_bucket", F.floor(F.col("at_s") / day)).join(held, ["entity", "_bucket"]).where((F.col("at_s") >= F.col("first_s")) & (F.col("at_s") <= F.col("last_s")) & ((F.coalesce("stage", F.lit("")) == "") | (F.col("stage") == F.col("_stage"))))
    first = inside.groupBy("entity", "event_id").agg(F.min("window_no").alias("_held"))
    out = rows.join(first, ["entity", "event_id"], "left")
    return out.select("entity", "event_id", F.coalesce("_named", "_held").alias("window_no"), F.when(F.col("_named").isNotNull(), "named").when(F.col("_held").isNotNull(), "held").alias("how"))


def observed_boundaries(passes: DataFrame, frames: DataFrame, least: float) -> DataFrame:
    """boundary_id, from_s, to_s, needs_review of passes (boundary_id, valid, decision, last_from, first_to, conf, uncertainty) whose two frames (frame_id, at_s) are known.

    A boundary needs a review if its confidence is below `least` or an uncertainty is stated.
    """
    good = passes.where(F.col("valid") & (F.col("decision") == "observed"))
    at = lambda name, to: frames.select(F.col("frame_id").alias(name), F.col("at_s").alias(to))
    met = good.join(at("last_from", "from_s"), "last_from").join(at("first_to", "to_s"), "first_to")
    said = ~F.lower(F.trim(F.coalesce("uncertainty", F.lit("")))).isin("", "无", "none", "null", "n/a", "无不确定性")
    return met.select("boundary_id", "from_s", "to_s", ((F.col("conf") < least) | said).alias("needs_review"))


def phase_samples(rows: DataFrame, phase: str, preferred: Column, order: list[str], n: int) -> DataFrame:
    """n rows of each entity and phase spread evenly over its order, of the preferred rows alone where there are any."""
    rows = rows.withColumn("_p", F.coalesce(preferred, F.lit(False)))
    any_ = F.max("_p").over(Window.partitionBy("entity", phase))
    pool = rows.withColumn("_any", any_).where(F.col("_p") | ~F.col("_any")).drop("_p", "_any")
    return uniform_pick(pool, order, n, ("entity", phase))


def window_samples(windows: DataFrame, step: int, around: tuple[int, ...] = (-4, -2, 0, 2, 4), tail: int = 6) -> DataFrame:
    """window keys, at_s, role: times every `step` from first_s to review_s, and those `around` last_s, kept within first_s and review_s, each once.

    A time from `tail` before the end of a final window on is a candidate for the stable state, any other one a scan.
    """
    times = F.concat(F.sequence("first_s", F.greatest("first_s", "review_s"), F.lit(step).cast("long")), F.array(*(F.col("last_s") + k for k in around), F.col("review_s")))
    kept = F.array_distinct(F.transform(times, lambda t: F.least(F.col("review_s"), F.greatest(F.col("first_s"), t))))
    rows = windows.withColumn("at_s", F.explode(kept))
    return rows.withColumn("role", F.when(F.col("final") & (F.col("at_s") >= F.col("last_s") - tail), "stable_candidate").otherwise("process_scan"))


def mandatory_picks(rows: DataFrame, keys: list[str], order: list[str], motion: str, sharpness: str, n: int) -> DataFrame:
    """n rows of each key: an even spread with both ends, where the best by motion and then the best by sharpness take the place of the last but one of its inner rows.

    So a best row that the spread lacks is put in, and where both are lacking the second takes the place of the first. All rows of
    keys with no more than n; the first of equals is the best.
    """
    w = Window.partitionBy(*keys)
    place = w.orderBy(*order)
    rows = rows.withColumns({"_i": F.row_number().over(place) - 1, "_n": F.count(F.lit(1)).over(w)})
    top = lambda c: F.max_by("_i", F.struct(F.coalesce(c, F.lit(0)), -F.col("_i"))).over(w)
    rows = rows.withColumns({"_m": top(motion), "_s": top(sharpness)})
    at = lambda k: F.rint(k.cast("double") * (F.col("_n") - 1) / F.lit(max(1, n - 1))).cast("int")
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)
    rows = rows.withColumns({"_u": spread, "_q": at(F.lit(n - 3)) if n > 3 else F.lit(None).cast("int")})
    swap = lambda chosen, out, into: F.when(F.col("_q").isNull() | F.array_contains(chosen, into), chosen).otherwise(F.concat(F.array_remove(chosen, out), F.array(into)))
    rows = rows.withColumn("_c", swap(F.col("_u"), F.col("_q"), F.col("_m")))
    rows = rows.withColumn("_c", swap(F.col("_c"), F.when(F.array_contains("_u", F.col("_m")), F.col("_q")).otherwise(F.col("_m")), F.col("_s")))
    return rows.where((F.col("_n") <= n) | F.array_contains("_c", F.col("_i"))).drop("_i", "_n", "_m", "_s", "_u", "_q", "_c")
