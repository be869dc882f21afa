"""What to look at next: diverse picks, the best window under a budget, requests with a running budget, and validated requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.checking import first_error
from chronoweave.session import written

# ---- T9


def diverse_picks(rows: DataFrame, keys: list[str], id: str, score: str, tracks: str, source: str, order: list[Column], *, limit: int = 4, new_track: float = 0.18, new_source: float = 0.08) -> DataFrame:
    """The rows of `limit` picks of each key, with `pick` from 1 on: each the best of those left by a score that falls with what was picked before.

    A row gains `new_track` if it has no tracks (an array) or one that no pick had, and `new_source` if no pick had its source.
    `order` breaks ties, ascending, then the id does. Rows of one set of tracks and one source gain alike, so only the first
    `limit` of each such group can ever be picked; they are all that a pick compares. Null tracks are none, a null source is
    one of its own, rows without a score or an id are left out.
    """
    known = F.array_sort(F.array_distinct(F.coalesce(tracks, F.array().cast("array<string>"))))
    rows = rows.where(F.col(score).isNotNull() & F.col(id).isNotNull()).withColumns({"_tracks": known, "_source": F.coalesce(F.col(source).cast("string"), F.lit("\0"))})
    rows = rows.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    tail = [f"_o{i}" for i in range(len(order))]
    alike = Window.partitionBy(*keys, "_tracks", "_source").orderBy(F.col(score).desc(), *tail, id)
    few = written(rows.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= limit).drop("_r"), "diverse")
    had = few.select(*keys).distinct().withColumns({"_seen": F.array().cast("array<string>"), "_from": F.array().cast("array<string>"), "_ids": F.array().cast(few.select(F.array(id)).schema[0].dataType)})
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    for _ in range(limit):
        fresh = (F.size("_tracks") == 0) | (F.size(F.array_except("_tracks", "_seen")) > 0)
        now = F.col(score) + F.when(fresh, new_track).otherwise(0.0) + F.when(F.array_contains("_from", F.col("_source")), 0.0).otherwise(new_source)
        rank = F.struct((-now).alias("s"), *tail, id)
        left = few.alias("x").join(had.alias("h"), on("x", "h")).where(~F.array_contains("_ids", F.col(f"x.{id}")))
        best = left.groupBy(*(F.col(f"x.{k}") for k in keys)).agg(F.min_by(F.struct(F.col(f"x.{id}").alias("id"), "_tracks", "_source"), rank).alias("b"))
        met = had.alias("h").join(best.alias("n"), on("h", "n"), "left")
        add = lambda c, more: F.when(F.col("n.b").isNull(), F.col(c)).otherwise(F.concat(c, more)).alias(c)
        had = written(met.select(*(F.col(f"h.{k}") for k in keys), add("_seen", F.coalesce("n.b._tracks", F.array().cast("array<string>"))), add("_from", F.array("n.b._source")), add("_ids", F.array("n.b.id"))), "picks")
    picked = had.select(*keys, F.posexplode("_ids").alias("_at", id)).withColumn("pick", F.col("_at") + 1).drop("_at")
    met = few.drop("_tracks", "_source", *tail).alias("x").join(picked.alias("p"), [*on("x", "p"), F.col(f"x.{id}") == F.col(f"p.{id}")])
    return met.select("x.*", "p.pick")


# ---- T18, T19


def same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def fitted_windows(points: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, from, to, rows, new: of each key's points the stretch with most new points that its budget allows.

    Points are (keys, at, known, barred, budget, anchor), the last two of the key; those at one time count once. A stretch
    has no barred point between its ends and at least one new one, that is not known. Among stretches with as many new points
    the one with more points wins, then the one whose middle is nearer the anchor, then the earlier. For each first point
    only the longest stretch within the budget can win; it ends before the new point that would be one too many, which a
    join by the running number of new points finds. So the work is that of sorts, not of all pairs of ends.
    """
    rows = points.groupBy(*keys, at).agg(F.max("known").alias("known"), F.max("barred").alias("barred"), F.first("budget").alias("budget"), F.first("anchor").alias("anchor"))
    rows = rows.withColumn("_run", F.sum(F.col("barred").cast("long")).over(Window.partitionBy(*keys).orderBy(at))).where(~F.col("barred"))
    run = Window.partitionBy(*keys, "_run")
    new = (~F.col("known")).cast("long")
    rows = rows.withColumns({
        "_upto": F.sum(new).over(run.orderBy(at)), "_i": F.row_number().over(run.orderBy(at)).cast("long"), "_was": F.lag(at).over(run.orderBy(at)),
        "_all": F.sum(new).over(run), "_last": F.max(at).over(run), "_size": F.count(F.lit(1)).over(run),
    })
    ends = rows.where(~F.col("known")).select(*keys, "_run", F.col("_upto").alias("_stop"), F.col("_i").alias("_ends"), F.col("_was").alias("_to"))
    first = rows.withColumn("_stop", F.col("_upto") - new + F.col("budget") + 1).alias("x")
    met = first.join(ends.alias("e"), same("x", "e", [*keys, "_run"]) & (F.col("x._stop") == F.col("e._stop")), "left")
    cut = F.col("e._stop").isNotNull()
    to, count = F.when(cut, F.col("e._to")).otherwise(F.col("_last")), F.when(cut, F.col("e._ends") - F.col("_i")).otherwise(F.col("_size") - F.col("_i") + 1)
    fresh = F.when(cut, F.col("budget")).otherwise(F.col("_all") - F.col("_upto") + (~F.col("known")).cast("long"))
    found = met.where(F.col("budget") > 0).select(*(F.col(f"x.{k}") for k in keys), F.col(f"x.{at}").alias("from"), to.alias("to"), count.alias("rows"), fresh.alias("new"), "anchor").where("new > 0 and rows > 0")
    best = F.struct("new", "rows", (-F.abs(F.col("from") + F.col("to") - F.col("anchor") * 2)).alias("near"), (-F.col("from")).alias("early"))
    return found.groupBy(*keys).agg(F.max_by(F.struct("from", "to", "rows", "new"), best).alias("w")).select(*keys, "w.*")


def request_plan(anchors: DataFrame, known: DataFrame, *, step: int, budget: int, most: int = 3, tries: int = 6) -> DataFrame:
    """entity, request, rank, from, to, rows, new: up to `most` windows of each entity, within one budget of new points.

    Anchors are (entity, rank from 1 on, at, low, high); the points of an anchor are every `step` from low to high. `known` has
    (entity, at) of points that are there already; points of an earlier request are known and bar later ones. Anchors are
    taken by rank, the first `tries` of them; each that still fits gets its best stretch under what is left of the budget, so that
    the last one may be cut. An anchor is a round for all entities at once.
    """
    known = known.select("entity", "at").distinct()
    anchors = written(anchors.where(F.col("rank") <= tries).select("entity", "rank", "at", "low", "high").dropna(subset=["rank", "at", "low", "high"]), "anchors")
    state = anchors.select("entity").distinct().withColumns({"left": F.lit(budget).cast("long"), "made": F.lit(0)})
    taken = known.where("false").select("entity", "at")
    found = None
    for k in range(1, tries + 1):
        open_ = anchors.where(F.col("rank") == k).alias("a").join(state.alias("s"), same("a", "s", ["entity"])).where((F.col("made") < most) & (F.col("left") > 0))
        points = open_.select("a.entity", F.col("a.at").alias("anchor"), F.col("left").alias("budget"), "made", F.explode(F.expr(f"filter(sequence(low, greatest(low, high), {int(step)}L), t -> t <= high)")).alias("at")).alias("p")
        for name, of in (("known", known), ("barred", taken)):
            points = points.join(of.withColumn(name, F.lit(True)).alias("o"), same("p", "o", ["entity"]) & (F.col("p.at") == F.col("o.at")), "left").select("p.*", F.coalesce(F.col(f"o.{name}"), F.lit(False)).alias(name)).alias("p")
        points = written(points.withColumn("known", F.col("known") | F.col("barred")), "request-points")
        fit = fitted_windows(points, ["entity"], "at")
        fit = written(fit.alias("f").join(state.alias("s"), same("f", "s", ["entity"])).select("f.*", (F.col("made") + 1).alias("request"), F.lit(k).alias("rank")), "requests")
        found = fit if found is None else found.unionByName(fit)
        inside = points.alias("p").join(fit.alias("f"), same("p", "f", ["entity"]) & (F.col("p.at") >= F.col("f.from")) & (F.col("p.at") <= F.col("f.to"))).select("p.entity", "p.at")
        taken = written(taken.unionByName(inside).distinct(), "request-taken")
        state = written(state.alias("s").join(fit.alias("f"), same("s", "f", ["entity"]), "left").select("s.entity", (F.col("left") - F.coalesce("f.new", F.lit(0))).alias("left"), F.coalesce("f.request", "made").alias("made")), "request-state")
    return found.select("entity", "request", "rank", "from", "to", "rows", "new")


# ---- G33


def checked_requests(requests: DataFrame, stages: DataFrame, id: str, *, most: int = 3, longest: float = 4.0, total: float = 8.0, slack: float = 2.0) -> DataFrame:
    """requests (entity, id, ranges: array of struct start, end, and `duration`) with `error`: the first rule that they break, null if none.

    Rules: 1 to `most` ranges; each of numbers, 0 <= start < end <= duration, at most `longest` long, and inside an observed
    stage (entity, start, end) with `slack` on both sides, in the order of the ranges; `total` for all together. Whether a
    stage holds a range is the running maximum of stage ends up to the range's start: a union and a window, not a join.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    each = requests.where(F.size("ranges").between(1, most)).select("entity", F.col(id).alias("_id"), "duration", F.posexplode("ranges").alias("_n", "r")).select("*", "r.start", "r.end")
    both = each.select("entity", "_id", "_n", "duration", "start", "end", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_until"), F.col("start").cast("double").alias("_at"))
    held = stages.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select("entity", F.lit(0).alias("_side"), (F.col("end").cast("double") + slack).alias("_until"), F.greatest(F.lit(0.0), F.col("start").cast("double") - slack).alias("_at"))
    both = both.unionByName(held, allowMissingColumns=True)
    until = F.max("_until").over(Window.partitionBy("entity").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    each = both.withColumn("_held", until).where("_side = 1")
    rule = first_error({
        "not_a_number": number("start") & number("end"), "outside_video": (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("duration")),
        "too_long": F.col("end") - F.col("start") <= longest, "outside_stages": F.least("_held", F.col("duration").cast("double")) >= F.col("end"),
    })
    by = each.withColumn("_error", rule).groupBy("_id").agg(F.min(F.when(F.col("_error").isNotNull(), F.struct("_n", "_error"))).alias("_first"), F.sum(F.col("end") - F.col("start")).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    observed = stages.select("entity").distinct().withColumn("_observed", F.lit(True))
    rows = requests.alias("q").join(by.alias("b"), F.col(f"q.{id}") == F.col("b._id"), "left").join(observed.alias("o"), F.col("q.entity").eqNullSafe(F.col("o.entity")), "left")
    error = F.when(F.col("_rows").isNull(), "number_of_ranges").when(F.col("_observed").isNull(), "no_stages").when(F.col("_first").isNotNull(), F.col("_first._error")).when(F.col("_sum") > total, "too_long_together")
    return rows.select("q.*", error.alias("error"))
