"""The timeline operators as named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.operators import checking, decode, fusion, graph, intervals, matching, sampling, voting
from chronoweave.plans.registry import query
from chronoweave.session import table
from chronoweave.sources.timeline import timeline

TL = """tl AS (SELECT event_id, user_id AS entity, CASE event_type WHEN 'click' THEN 'wiring' WHEN 'view' THEN 'measurement' WHEN 'purchase' THEN 'writing' WHEN 'signup' THEN 'cleanup' ELSE 'uncertain' END AS action,
  date_diff('second', TIMESTAMP '2024-01-01', ts) AS first_s, date_diff('second', TIMESTAMP '2024-01-01', ts) + CAST(floor(value * 600) AS BIGINT) AS last_s, CAST(least(1000, floor(value * 2)) AS BIGINT) AS conf FROM events)"""
ORD = "ORDER BY first_s, last_s, event_id"
PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
RUNS = f"""{TL}, rb AS (SELECT *, CASE WHEN lag(action) OVER (PARTITION BY entity {ORD}) IS DISTINCT FROM action THEN 1 ELSE 0 END AS ch FROM tl),
  rc AS (SELECT *, sum(ch) OVER (PARTITION BY entity {ORD} ROWS UNBOUNDED PRECEDING) AS blk FROM rb),
  rd AS (SELECT *, max(last_s) OVER (PARTITION BY entity, blk {ORD} {PREV}) AS m FROM rc),
  re AS (SELECT *, sum(CASE WHEN m IS NULL OR first_s > m + 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY entity, blk {ORD} ROWS UNBOUNDED PRECEDING) AS prt FROM rd),
  rg AS (SELECT entity, action AS stage, blk, prt, min(first_s) AS first_s, max(last_s) AS last_s, count(*) AS members FROM re GROUP BY ALL),
  runs AS (SELECT entity, stage, first_s, last_s, members, row_number() OVER (PARTITION BY entity ORDER BY blk, prt) AS run_no FROM rg)"""
SPANS = f"{TL}, spans AS (SELECT entity, min(first_s) AS start_s, max(last_s) AS end_s FROM tl GROUP BY entity)"


def tl(spark: SparkSession, d: str) -> DataFrame:
    return timeline(table(spark, d, "events"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return intervals.stage_runs(tl(spark, d))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return tl(spark, d).groupBy("entity").agg(F.min("first_s").alias("start_s"), F.max("last_s").alias("end_s"))


def micro(c) -> F.Column:
    """A double as whole millionths, so that both engines print the same."""
    return F.rint(F.col(c) * 1e6 if isinstance(c, str) else c * 1e6).cast("long")


@query("timeline_adapter", f"WITH {TL} SELECT * FROM tl")
def _(spark, d):
    return tl(spark, d)


@query("dedup_overlap_islands", f"""WITH {TL}, b AS (SELECT *, max(last_s) OVER (PARTITION BY entity, action {ORD} {PREV}) AS m FROM tl),
  i AS (SELECT *, sum(CASE WHEN m IS NULL OR first_s > m THEN 1 ELSE 0 END) OVER (PARTITION BY entity, action {ORD} ROWS UNBOUNDED PRECEDING) AS isl FROM b)
  SELECT entity, action, min(first_s) AS first_s, max(last_s) AS last_s, max(conf) AS conf, first(event_id ORDER BY conf DESC, first_s, last_s, event_id) AS event_id, count(*) AS members FROM i GROUP BY entity, action, isl""")
def _(spark, d):
    return intervals.merge_overlaps(tl(spark, d))


@query("stage_run_merge", f"WITH {RUNS} SELECT * FROM runs")
def _(spark, d):
    return runs(spark, d)


@query("cycle_run_merge", f"""WITH {TL}, c AS (SELECT *, first_s // 86400 AS cyc FROM tl), b AS (SELECT *, lag(action) OVER w IS DISTINCT FROM action AS other, lag(cyc) OVER w IS NOT DISTINCT FROM cyc AS same,
  first_s > max(last_s) OVER (PARTITION BY entity {ORD} {PREV}) + 3600 AS far FROM c WINDOW w AS (PARTITION BY entity {ORD})),
  i AS (SELECT *, sum(CASE WHEN other OR (far AND NOT same) THEN 1 ELSE 0 END) OVER (PARTITION BY entity {ORD} ROWS UNBOUNDED PRECEDING) AS isl FROM b)
  SELECT entity, action AS stage, min(first_s) AS first_s, max(last_s) AS last_s, count(*) AS members FROM i GROUP BY entity, action, isl""")
def _(spark, d):
    return intervals.cycle_runs(tl(spark, d).withColumn("cyc", F.floor(F.col("first_s") / 86400)), "cyc")


@query("stage_boundaries", f"""WITH {RUNS}, l AS (SELECT *, lead(stage) OVER w AS to_stage, lead(first_s) OVER w AS next_s FROM runs WINDOW w AS (PARTITION BY entity ORDER BY run_no))
  SELECT entity, run_no, stage AS from_stage, to_stage, least(last_s, next_s) AS low_s, greatest(last_s, next_s) AS high_s FROM l WHERE to_stage IS NOT NULL AND to_stage <> stage""")
def _(spark, d):
    return intervals.boundaries(runs(spark, d))


@query("boundary_monotone", f"""WITH {TL}, b AS (SELECT *, max(last_s) OVER (PARTITION BY entity ORDER BY first_s, event_id {PREV}) AS m FROM tl) SELECT entity, event_id, last_s FROM b WHERE m IS NULL OR last_s > m""")
def _(spark, d):
    return intervals.monotone(tl(spark, d), "last_s", ["first_s", "event_id"]).select("entity", "event_id", "last_s")


@query("timeline_gap_fill", f"""WITH {RUNS}, b AS (SELECT entity, stage, run_no, first_s, least(last_s, 2592000) AS e, last_s FROM runs WHERE last_s > 0 AND first_s < 2592000),
  p AS (SELECT *, greatest(0, coalesce(max(e) OVER (PARTITION BY entity ORDER BY first_s, last_s, run_no {PREV}), 0)) AS done FROM b),
  t AS (SELECT entity, max(e) AS f FROM b GROUP BY entity)
  SELECT entity, stage, greatest(first_s, done) AS first_s, e AS last_s FROM p WHERE e > greatest(first_s, done)
  UNION ALL SELECT entity, 'unclassified', done, first_s FROM p WHERE first_s > done
  UNION ALL SELECT entity, 'unclassified', f, 2592000 FROM t WHERE f < 2592000""")
def _(spark, d):
    return intervals.gap_fill(runs(spark, d), F.lit(0).cast("long"), F.lit(2592000).cast("long"))


@query("temporal_conflicts", f"""WITH {TL} SELECT a.entity, a.event_id AS event_a, b.event_id AS event_b, greatest(a.first_s, b.first_s) AS overlap_from, least(a.last_s, b.last_s) AS overlap_to FROM tl a JOIN tl b
  ON a.entity = b.entity AND a.event_id < b.event_id AND a.action <> b.action AND a.action <> 'uncertain' AND b.action <> 'uncertain' AND a.first_s <= b.last_s AND b.first_s <= a.last_s""")
def _(spark, d):
    return intervals.conflicts(tl(spark, d))


@query("change_points", f"""WITH {TL}, g AS (SELECT entity, first_s AS t, arg_max(action, event_id) AS stage FROM tl GROUP BY entity, first_s), c AS (SELECT *, lag(stage) OVER (PARTITION BY entity ORDER BY t) AS was FROM g)
  SELECT entity, stage, t AS from_s, coalesce(lead(t) OVER (PARTITION BY entity ORDER BY t), 3000000) AS to_s FROM c WHERE was IS NULL OR was <> stage""")
def _(spark, d):
    return intervals.change_points(tl(spark, d), "action", "first_s", F.lit(3000000).cast("long"))


@query("longest_invisible_run", f"""WITH {TL}, v AS (SELECT *, action <> 'uncertain' AND conf >= 500 AS vis FROM tl), b AS (SELECT *, CASE WHEN lag(vis) OVER (PARTITION BY entity ORDER BY first_s) IS DISTINCT FROM vis THEN 1 ELSE 0 END AS ch FROM v),
  i AS (SELECT *, sum(ch) OVER (PARTITION BY entity ORDER BY first_s) AS isl FROM b), r AS (SELECT entity, isl, count(*) AS rows, min(first_s) AS f, max(first_s) AS l FROM i WHERE NOT vis GROUP BY entity, isl),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rows DESC, f) AS k FROM r) SELECT entity, rows, f + l AS twice_middle FROM k WHERE k = 1""")
def _(spark, d):
    rows = tl(spark, d).withColumn("vis", (F.col("action") != "uncertain") & (F.col("conf") >= 500))
    return intervals.longest_gap(rows, "vis", "first_s").select("entity", "rows", (F.col("middle") * 2).cast("long").alias("twice_middle"))


@query("minute_tumbling", f"WITH {SPANS} SELECT entity, (first_s - start_s) // 3600 AS minute, count(*) AS events, max(conf) AS conf FROM tl JOIN spans USING (entity) GROUP BY ALL")
def _(spark, d):
    rows = tl(spark, d).withColumn("start_s", F.min("first_s").over(Window.partitionBy("entity")))
    return sampling.tumbling(rows, "first_s", F.col("start_s"), 3600).groupBy("entity", "minute").agg(F.count(F.lit(1)).alias("events"), F.max("conf").alias("conf"))


@query("anchored_sliding_windows", f"""WITH {SPANS}, n AS (SELECT *, greatest(0, CAST(ceil((end_s - start_s - 60000) / 50000.0) AS BIGINT)) AS extra FROM spans WHERE end_s > start_s)
  SELECT entity, CAST(k AS BIGINT) AS window_no, start_s + k * 50000 AS from_s, least(start_s + k * 50000 + 60000, end_s) AS to_s FROM (SELECT *, unnest(generate_series(0, extra)) AS k FROM n)""")
def _(spark, d):
    return sampling.overlapping_windows(spans(spark, d), 60000, 10000)


@query("regular_sampling", f"""WITH {SPANS} SELECT DISTINCT entity, at_s FROM (SELECT entity, unnest(generate_series(start_s, end_s, 40000)) AS at_s FROM spans UNION ALL SELECT entity, end_s FROM spans)""")
def _(spark, d):
    return sampling.regular_times(spans(spark, d), 40000)


@query("uniform_pick", f"""WITH {TL}, r AS (SELECT entity, event_id, row_number() OVER (PARTITION BY entity ORDER BY first_s, event_id) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM tl)
  SELECT entity, event_id FROM r WHERE n <= 5 OR i IN (CAST(round_even(0 * (n - 1) / 4.0, 0) AS BIGINT), CAST(round_even(1 * (n - 1) / 4.0, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 4.0, 0) AS BIGINT), CAST(round_even(3 * (n - 1) / 4.0, 0) AS BIGINT), n - 1)""")
def _(spark, d):
    return sampling.uniform_pick(tl(spark, d), ["first_s", "event_id"], 5).select("entity", "event_id")


@query("bucket_round_robin", f"""WITH {TL}, b AS (SELECT *, least(7, greatest(0, first_s // 360000)) AS bucket FROM tl), c AS (SELECT *, row_number() OVER (PARTITION BY entity, bucket ORDER BY conf DESC, event_id) AS depth FROM b)
  SELECT entity, event_id, bucket, depth, row_number() OVER (PARTITION BY entity ORDER BY depth, bucket) AS rank FROM c""")
def _(spark, d):
    rows = sampling.bucket_round_robin(tl(spark, d), "first_s", F.lit(0), F.lit(360000), 8, [F.col("conf").desc(), "event_id"])
    return rows.select("entity", "event_id", "bucket", "depth", "rank")


@query("bucket_peak_topk", f"""WITH {TL}, b AS (SELECT *, first_s // 86400 AS day FROM tl), p AS (SELECT *, row_number() OVER (PARTITION BY entity, day ORDER BY conf DESC, event_id) AS r FROM b),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY conf DESC, event_id) AS k, count(*) OVER (PARTITION BY entity) AS n FROM p WHERE r = 1) SELECT entity, event_id, day, conf FROM k WHERE k <= greatest(1, n * 25 // 100)""")
def _(spark, d):
    return sampling.bucket_peaks(tl(spark, d).withColumn("day", F.floor(F.col("first_s") / 86400)), "day", "conf", ["event_id"]).select("entity", "event_id", "day", "conf")


@query("ranked_union_topk", f"""WITH {TL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY conf DESC, event_id) AS a, row_number() OVER (PARTITION BY entity ORDER BY last_s - first_s DESC, event_id) AS b FROM tl),
  t AS (SELECT *, CASE WHEN a <= 3 THEN 0 WHEN b <= 3 THEN 1 END AS tier FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY tier, event_id) AS k FROM t WHERE tier IS NOT NULL) SELECT entity, event_id, CAST(tier AS BIGINT) AS tier FROM k WHERE k <= 5""")
def _(spark, d):
    rows = sampling.ranked_union(tl(spark, d), [([F.col("conf").desc(), "event_id"], 3), ([(F.col("last_s") - F.col("first_s")).desc(), "event_id"], 3)], 5, ["event_id"])
    return rows.select("entity", "event_id", "tier")


@query("rows_around_interval", f"""WITH {TL}, s AS (SELECT *, CASE WHEN first_s < 1000000 THEN -1 WHEN first_s > 1500000 THEN 1 END AS side FROM tl),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity, side ORDER BY first_s * side, event_id) AS k FROM s WHERE side IS NOT NULL) SELECT entity, event_id, CAST(side AS BIGINT) AS side FROM k WHERE (side < 0 AND k <= 2) OR (side > 0 AND k <= 3)""")
def _(spark, d):
    return sampling.around(tl(spark, d), "first_s", F.lit(1000000), F.lit(1500000)).select("entity", "event_id", "side")


@query("local_maxima", f"""WITH {TL}, l AS (SELECT *, lag(conf) OVER w AS a, lead(conf) OVER w AS b FROM tl WINDOW w AS (PARTITION BY entity ORDER BY first_s, event_id)) SELECT entity, event_id, conf FROM l WHERE coalesce(conf > a, true) AND coalesce(conf >= b, true)""")
def _(spark, d):
    return sampling.local_maxima(tl(spark, d), "conf", ["first_s", "event_id"]).select("entity", "event_id", "conf")


@query("budget_round_robin", f"""WITH {RUNS}, w AS (SELECT entity, run_no AS window_no, members % 3 AS priority, members AS capacity FROM runs), t AS (SELECT *, unnest(generate_series(1, capacity)) AS turn FROM w),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY turn, priority, window_no) AS k FROM t) SELECT entity, window_no, count(*) AS samples FROM k WHERE k <= 12 GROUP BY ALL""")
def _(spark, d):
    windows = runs(spark, d).select("entity", F.col("run_no").alias("window_no"), (F.col("members") % 3).alias("priority"), F.col("members").cast("int").alias("capacity"))
    return sampling.budget_round_robin(windows, 12)


@query("nearest_time_join", f"""WITH {TL}, l AS (SELECT * FROM tl WHERE action = 'writing'), r AS (SELECT * FROM tl WHERE action = 'measurement'),
  j AS (SELECT l.entity, l.event_id, r.event_id AS near, abs(l.first_s - r.first_s) AS distance, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.first_s - r.first_s), r.first_s, r.event_id) AS k FROM l JOIN r USING (entity))
  SELECT l.entity, l.event_id, near AS event_id_near, distance FROM l LEFT JOIN (SELECT * FROM j WHERE k = 1) j ON l.event_id = j.event_id""")
def _(spark, d):
    rows = tl(spark, d)
    left = rows.where("action = 'writing'").select("entity", "first_s", F.col("event_id").alias("own"))
    return matching.nearest(left, rows.where("action = 'measurement'"), "first_s", "event_id").select("entity", F.col("own").alias("event_id"), "event_id_near", "distance")


@query("asof_state", f"""WITH {TL} SELECT l.entity, l.event_id, r.action AS state, r.first_s AS since_s FROM (SELECT * FROM tl WHERE action = 'writing') l ASOF LEFT JOIN (SELECT entity, first_s, max(action) AS action FROM tl WHERE action IN ('wiring', 'measurement') GROUP BY ALL) r ON l.entity = r.entity AND l.first_s >= r.first_s""")
def _(spark, d):
    rows = tl(spark, d)
    states = rows.where("action in ('wiring', 'measurement')").groupBy("entity", "first_s").agg(F.struct("first_s", F.max("action").alias("action")).alias("state"))
    out = matching.asof(rows.where("action = 'writing'").select("entity", "event_id", "first_s"), states, "first_s", "state")
    return out.select("entity", "event_id", F.col("state_asof.action").alias("state"), F.col("state_asof.first_s").alias("since_s"))


@query("band_neighbor_join", f"WITH {TL} SELECT a.entity, a.event_id AS event_a, b.event_id AS event_b, b.first_s - a.first_s AS delta FROM tl a JOIN tl b ON a.entity = b.entity AND abs(a.first_s - b.first_s) <= 7200 AND a.action = 'wiring' AND b.action = 'measurement'")
def _(spark, d):
    rows = tl(spark, d)
    pairs = matching.band(rows.where("action = 'wiring'"), rows.where("action = 'measurement'"), "first_s", 7200)
    return pairs.select("a.entity", F.col("a.event_id").alias("event_a"), F.col("b.event_id").alias("event_b"), (F.col("b.first_s") - F.col("a.first_s")).alias("delta"))


@query("gap_without_between", f"""WITH {TL}, g AS (SELECT *, min(CASE WHEN action = 'writing' THEN first_s END) OVER w AS closes_s, min(CASE WHEN action = 'measurement' THEN first_s END) OVER w AS btw FROM tl WINDOW w AS (PARTITION BY entity ORDER BY first_s, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT entity, event_id, last_s, closes_s FROM g WHERE action = 'wiring' AND closes_s IS NOT NULL AND (btw IS NULL OR btw > closes_s)""")
def _(spark, d):
    return matching.gaps_without(tl(spark, d), "wiring", "writing", "measurement")


@query("semi_witness", f"WITH {TL} SELECT entity, event_id FROM tl a WHERE EXISTS (SELECT 1 FROM tl b WHERE a.entity = b.entity AND a.event_id <> b.event_id AND a.action = b.action AND a.first_s <= b.last_s AND b.first_s <= a.last_s)")
def _(spark, d):
    return matching.with_witness(tl(spark, d), tl(spark, d)).select("entity", "event_id")


@query("anti_witness", f"WITH {TL} SELECT entity, event_id FROM tl a WHERE NOT EXISTS (SELECT 1 FROM tl b WHERE a.entity = b.entity AND a.event_id <> b.event_id AND a.action <> b.action AND a.first_s <= b.last_s AND b.first_s <= a.last_s)")
def _(spark, d):
    rows = tl(spark, d)
    return matching.known_rows_removed(rows, matching.with_witness(rows, rows, False).select("event_id"), ["event_id"]).select("entity", "event_id")


@query("resumed_activity", f"""WITH {TL}, s AS (SELECT *, min(CASE WHEN action = 'cleanup' THEN first_s END) OVER (PARTITION BY entity) AS stop FROM tl)
  SELECT entity, count(*) AS rows, count(DISTINCT action) AS kinds, max(last_s) - min(first_s) AS span_s FROM s WHERE first_s > stop AND action NOT IN ('cleanup', 'uncertain') GROUP BY entity HAVING count(*) >= 2 AND count(DISTINCT action) >= 2 AND max(last_s) - min(first_s) >= 20""")
def _(spark, d):
    return checking.resumed(tl(spark, d))


@query("terminal_truncation", f"""WITH {TL}, s AS (SELECT *, min(CASE WHEN action = 'cleanup' THEN first_s * 100000000 + event_id END) OVER (PARTITION BY entity) AS stop FROM tl) SELECT entity, event_id FROM s WHERE stop IS NULL OR first_s * 100000000 + event_id <= stop""")
def _(spark, d):
    return decode.terminal_prefix(tl(spark, d)).select("entity", "event_id")


@query("transition_validation", f"""WITH {RUNS}, l AS (SELECT *, lag(stage) OVER (PARTITION BY entity ORDER BY run_no) AS previous FROM runs) SELECT entity, run_no, previous, stage FROM l WHERE previous IS NOT NULL AND previous <> stage AND previous = 'cleanup'""")
def _(spark, d):
    return checking.illegal_transitions(runs(spark, d))


@query("moving_median", f"""WITH {TL} SELECT entity, event_id, CAST(round_even(quantile_cont(CAST(conf AS DOUBLE), 0.5) OVER (PARTITION BY entity ORDER BY first_s, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) * 1000000, 0) AS BIGINT) AS median FROM tl""")
def _(spark, d):
    return voting.moving_median(tl(spark, d), "conf", ["first_s", "event_id"]).select("entity", "event_id", micro("median").alias("median"))


@query("p20_p90_normalize", f"""WITH {TL}, q AS (SELECT *, quantile_cont(CAST(conf AS DOUBLE), 0.2) OVER (PARTITION BY entity) AS l, quantile_cont(CAST(conf AS DOUBLE), 0.9) OVER (PARTITION BY entity) AS h FROM tl)
  SELECT entity, event_id, CAST(round_even(CASE WHEN h - l <= 1e-12 THEN 0.5 ELSE greatest(0.0, least(1.0, (conf - l) / (h - l))) END * 10000, 0) AS BIGINT) AS normalized FROM q""")
def _(spark, d):
    return voting.percentile_normalized(tl(spark, d), "conf").select("entity", "event_id", F.rint(F.col("normalized") * 10000).cast("long").alias("normalized"))


@query("mad_stability", f"""WITH {TL}, m AS (SELECT *, quantile_cont(CAST(conf AS DOUBLE), 0.5) OVER (PARTITION BY entity) AS m FROM tl) SELECT entity, CAST(round_even(first(m) * 1000000, 0) AS BIGINT) AS median, CAST(round_even(quantile_cont(abs(conf - m), 0.5) * 1000000, 0) AS BIGINT) AS mad FROM m GROUP BY entity""")
def _(spark, d):
    return voting.mad(tl(spark, d), "conf").select("entity", micro("median").alias("median"), micro("mad").alias("mad"))


@query("robust_inliers", f"""WITH {TL}, m AS (SELECT *, quantile_cont(CAST(conf AS DOUBLE), 0.5) OVER (PARTITION BY entity) AS m FROM tl), s AS (SELECT entity, first(m) AS m, quantile_cont(abs(conf - m), 0.5) AS d FROM m GROUP BY entity)
  SELECT tl.entity, event_id FROM tl JOIN s ON tl.entity = s.entity WHERE abs(conf - s.m) <= greatest(3.0, 1.5 * d) + 1e-9""")
def _(spark, d):
    return voting.inliers(tl(spark, d), "conf", 3.0, 1.5).select("entity", "event_id")


@query("run_length_persistence", f"""WITH {TL}, b AS (SELECT *, conf >= 500 AS on_, lag(conf >= 500) OVER w AS was, first_s - lag(first_s) OVER w AS gap FROM tl WINDOW w AS (PARTITION BY entity ORDER BY first_s, event_id)),
  i AS (SELECT *, sum(CASE WHEN on_ AND NOT coalesce(was AND gap <= 50000, false) THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY first_s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
  SELECT entity, event_id, count(*) OVER (PARTITION BY entity, run) AS persistence FROM i WHERE on_""")
def _(spark, d):
    return voting.run_lengths(tl(spark, d), F.col("conf") >= 500, "first_s", ["first_s", "event_id"], 50000).select("entity", "event_id", "persistence")


@query("adjacent_pairs", f"""WITH {TL}, l AS (SELECT *, lead(event_id) OVER w AS next_id, lead(action) OVER w AS next_action, lead(first_s) OVER w AS next_s FROM tl WINDOW w AS (PARTITION BY entity ORDER BY first_s, event_id)) SELECT entity, event_id, next_id FROM l WHERE action = next_action AND next_s - first_s <= 50000""")
def _(spark, d):
    w = Window.partitionBy("entity").orderBy("first_s", "event_id")
    rows = tl(spark, d).withColumns({"next_id": F.lead("event_id").over(w), "next_action": F.lead("action").over(w), "next_s": F.lead("first_s").over(w)})
    return rows.where("action = next_action and next_s - first_s <= 50000").select("entity", "event_id", "next_id")


@query("weighted_vote", f"""WITH {TL}, s AS (SELECT entity, action AS state, sum(greatest(50, conf)) AS score, count(*) AS votes FROM tl GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, (state = 'measurement') DESC, state) AS k FROM s) SELECT entity, state, CAST(score AS BIGINT) AS score, votes FROM k WHERE k = 1""")
def _(spark, d):
    return voting.weighted_vote(tl(spark, d), "action", "conf", 50, "measurement")


@query("distinct_support_vote", f"""WITH {TL}, g AS (SELECT entity, action AS value, count(DISTINCT first_s // 86400) AS support, CAST(floor(sum(conf) * 1000 / count(*)) AS BIGINT) AS mean, max(first_s) AS latest FROM tl GROUP BY ALL),
  k AS (SELECT *, row_number() OVER w AS k, lead(support) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY entity ORDER BY support DESC, mean DESC, latest DESC, value)) SELECT entity, value, support, latest, coalesce(nxt >= support, false) AS conflict FROM k WHERE k = 1""")
def _(spark, d):
    return voting.support_vote(tl(spark, d).withColumn("day", F.floor(F.col("first_s") / 86400)), "action", "day", "conf", "first_s")


@query("consensus_threshold", f"WITH {TL} SELECT entity, action AS value, count(DISTINCT first_s // 86400) AS units FROM tl WHERE conf >= 300 GROUP BY ALL HAVING count(DISTINCT first_s // 86400) >= 2")
def _(spark, d):
    return voting.consensus(tl(spark, d).withColumn("day", F.floor(F.col("first_s") / 86400)), "action", "day", "conf", 2, 300)


@query("strict_mode", """WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY l_suppkey)) SELECT l_suppkey, CASE WHEN count(*) = 1 THEN CAST(max(l_quantity) AS BIGINT) END AS mode, max(n) AS n FROM t GROUP BY l_suppkey""")
def _(spark, d):
    return voting.strict_mode(table(spark, d, "lineitem"), "l_suppkey", "l_quantity").withColumn("mode", F.col("mode").cast("long"))


@query("tolerance_compare", """SELECT o_orderkey, count(*) AS lines, bool_or(abs(o_totalprice - l_extendedprice) <= greatest(0.05, o_totalprice / 30 * 1.25) + 1e-9) AS close FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def _(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.bool_or(voting.within(F.col("o_totalprice"), F.col("l_extendedprice"), 0.05, F.col("o_totalprice"))).alias("close"))


@query("prerequisite_gate", """WITH r AS (SELECT user_id AS entity, event_id, CASE WHEN value >= 50 THEN 'pass' ELSE 'fail' END AS decision FROM events WHERE event_type = 'purchase'),
  p AS (SELECT user_id AS entity, bool_or(value < 2) AS bad FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT r.entity, event_id, decision, CASE WHEN bad THEN 'fail' ELSE decision END AS gated FROM r LEFT JOIN p USING (entity)""")
def _(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "entity")
    results = e.where("event_type = 'purchase'").select("entity", "event_id", F.when(F.col("value") >= 50, "pass").otherwise("fail").alias("decision"))
    before = e.where("event_type = 'view'").select("entity", F.when(F.col("value") < 2, "fail").otherwise("pass").alias("decision"))
    return voting.gate(results, before)


@query("decision_pivot", "SELECT quality, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fail, CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pass FROM labels GROUP BY quality")
def _(spark, d):
    rows = table(spark, d, "labels").withColumn("decision", F.when(F.col("toxic") == 1, "fail").when(F.col("toxic") == 0, "pass"))
    return voting.pivot_counts(rows, "quality", "decision", ["fail", "pass"])


@query("multi_left_lookup", """SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment, coalesce(n_name, 'none') AS nation, coalesce(r_name, 'none') AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    out = matching.lookups(table(spark, d, "orders"), (c, "o_custkey", {"segment": "none"}), (n, "c_nationkey", {"nation": "none"}), (r, "n_regionkey", {"region": "none"}))
    return out.select("o_orderkey", "segment", "nation", "region")


@query("exact_duplicates", "SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("missing_members", f"WITH {TL}, w AS (SELECT unnest(['wiring', 'measurement', 'writing', 'cleanup', 'uncertain', 'inspection']) AS missing) SELECT entity, missing FROM (SELECT DISTINCT entity FROM tl), w EXCEPT SELECT entity, action FROM tl")
def _(spark, d):
    return checking.missing_members(tl(spark, d), "entity", "action", ["wiring", "measurement", "writing", "cleanup", "uncertain", "inspection"])


@query("validation_errors", f"""WITH {TL} SELECT event_id, list_filter([CASE WHEN last_s > first_s THEN NULL ELSE 'empty_interval' END, CASE WHEN conf >= 10 THEN NULL ELSE 'low_confidence' END, CASE WHEN action <> 'uncertain' THEN NULL ELSE 'uncertain' END], lambda x: x IS NOT NULL)::VARCHAR AS errors FROM tl""")
def _(spark, d):
    rows = checking.errors(tl(spark, d), {"empty_interval": F.col("last_s") > F.col("first_s"), "low_confidence": F.col("conf") >= 10, "uncertain": F.col("action") != "uncertain"})
    return rows.select("event_id", F.concat(F.lit("["), F.array_join("errors", ", "), F.lit("]")).alias("errors"))


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("negation_keywords", "SELECT conv_id, turn, regexp_matches(lower(text), 'the|of') AND NOT regexp_matches(lower(text), 'stupid|trash') AS supported FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.supports("text", ["the", "of"], ["stupid", "trash"]).alias("supported"))


@query("entity_id_normalize", """WITH p AS (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS last FROM pages) SELECT page_id, CASE WHEN regexp_extract(last, '^(\\d+)', 1) <> '' THEN regexp_extract(last, '^(\\d+)', 1) ELSE regexp_replace(regexp_replace(last, '\\.[^.]*$', ''), '[^A-Za-z0-9_-]+', '_', 'g') END AS entity FROM p""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.entity_id(F.col("url")).alias("entity"))


@query("stage_counters_route", f"""WITH {TL}, c AS (SELECT entity, count(*) FILTER (action = 'wiring') AS wiring, count(*) FILTER (action = 'measurement') AS measurement, count(*) FILTER (action = 'writing') AS writing FROM tl GROUP BY entity)
  SELECT *, CASE WHEN measurement = 0 THEN 'fallback' WHEN writing > measurement THEN 'record_first' ELSE 'standard' END AS route FROM c""")
def _(spark, d):
    c = voting.pivot_counts(tl(spark, d), "entity", "action", ["wiring", "measurement", "writing"])
    return c.withColumn("route", F.when(F.col("measurement") == 0, "fallback").when(F.col("writing") > F.col("measurement"), "record_first").otherwise("standard"))


#: Rubrics are parts by size and container; one needs those that the same order asks for before it, up to the ring of sizes.
@query("dependency_closure", """WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, p_size AS r FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT DISTINCT a.r AS a, b.r AS b FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber - 1 AND a.l_orderkey % 40 = a.r AND b.r <> a.r),
  c AS (SELECT a, b FROM d UNION SELECT c.a, d.b FROM c JOIN d ON c.b = d.a) SELECT CAST(a AS BIGINT) AS rubric, CAST(b AS BIGINT) AS needs FROM c WHERE a <> b""")
def _(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_size").cast("long").alias("r"))
    asked = lines.where(F.col("l_orderkey") % 40 == F.col("r")).alias("a").join(lines.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") - 1))
    links = asked.where("a.r <> b.r").select(F.col("a.r").alias("a"), F.col("b.r").alias("b"))
    found = graph.reachable(links, links.select(F.col("a").alias("start")))
    return found.where("steps > 0").select(F.col("start").alias("rubric"), F.col("node").alias("needs"))


@query("error_metrics_mae", """SELECT event_type, CAST(round_even(avg(abs(value - 50)) * 1000, 0) AS BIGINT) AS mae, count(*) FILTER (abs(value - 50) <= 2) AS within_2 FROM events GROUP BY event_type""")
def _(spark, d):
    off = F.abs(F.col("value") - 50)
    return table(spark, d, "events").groupBy("event_type").agg(F.rint(F.avg(off) * 1000).cast("long").alias("mae"), F.count_if(off <= 2).alias("within_2"))


#: Runs once more, with gaps of up to 90000: another real segmentation of the same events.
WIDE = """rd2 AS (SELECT *, max(last_s) OVER (PARTITION BY entity, blk ORDER BY first_s, last_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM rc),
  re2 AS (SELECT *, sum(CASE WHEN m IS NULL OR first_s > m + 90000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity, blk ORDER BY first_s, last_s, event_id ROWS UNBOUNDED PRECEDING) AS prt FROM rd2),
  rg2 AS (SELECT entity, action AS stage, blk, prt, min(first_s) AS first_s, max(last_s) AS last_s FROM re2 GROUP BY ALL), wide AS (SELECT entity, stage, first_s, last_s, row_number() OVER (PARTITION BY entity ORDER BY blk, prt) AS run_no FROM rg2)"""


@query("run_comparison", f"""WITH {RUNS}, {WIDE} SELECT coalesce(a.entity, w.entity) AS entity, coalesce(a.run_no, w.run_no) AS run_no, CASE WHEN a.stage IS NULL THEN 'missing' WHEN w.stage IS NULL THEN 'unexpected' WHEN a.stage <> w.stage THEN 'stage' WHEN abs(a.first_s - w.first_s) > 1 OR abs(a.last_s - w.last_s) > 1 THEN 'time' ELSE 'same' END AS state FROM runs a FULL JOIN wide w ON a.entity = w.entity AND a.run_no = w.run_no""")
def _(spark, d):
    return matching.compare_by_position(runs(spark, d), intervals.stage_runs(tl(spark, d), gap=90000), 1)


def machine_sql(stage: str, phase: str, last_phase: int) -> str:
    """SQL of a state machine whose moves are spelt out: the stage and the next phase of `action` in phase `p`."""
    return f"""WITH RECURSIVE {TL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first_s, event_id) AS k FROM tl), e AS (SELECT entity, coalesce(max(CASE WHEN action = 'cleanup' THEN k END), 1000000000) AS stop FROM o GROUP BY entity),
  r(entity, k, event_id, stage, phase) AS (SELECT entity, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM e UNION ALL
  SELECT entity, k, event_id, CASE WHEN k > stop THEN 'noise' WHEN k = stop THEN 'material_cleanup' ELSE {stage} END, CASE WHEN k > stop THEN p WHEN k = stop THEN {last_phase} ELSE {phase} END
  FROM (SELECT o.entity, o.k, o.event_id, o.action, r.phase AS p, stop FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1 JOIN e ON e.entity = o.entity)) SELECT entity, event_id, stage, phase FROM r WHERE k > 0"""


SEVEN_STAGE = """CASE WHEN action = 'wiring' AND p = 0 THEN 'circuit_wiring' WHEN action = 'wiring' AND p IN (1, 2, 3) THEN 'circuit_rewiring' WHEN action = 'measurement' AND p IN (0, 1) THEN 'measurement_1' WHEN action = 'measurement' AND p IN (3, 4) THEN 'measurement_2'
  WHEN action = 'writing' AND p IN (0, 1, 2) THEN 'recording_1' WHEN action = 'writing' AND p IN (3, 4, 5) THEN 'recording_2' END"""
SEVEN_PHASE = """CASE WHEN action = 'wiring' AND p IN (1, 2, 3) THEN 3 WHEN action = 'measurement' AND p IN (0, 1) THEN 1 WHEN action = 'measurement' AND p IN (3, 4) THEN 4 WHEN action = 'writing' AND p IN (0, 1, 2) THEN 2 WHEN action = 'writing' AND p IN (3, 4, 5) THEN 5 ELSE p END"""
FIVE_STAGE = """CASE WHEN action = 'wiring' AND p = 0 THEN 'circuit_wiring' WHEN action = 'wiring' AND p IN (1, 2) THEN 'circuit_rewiring' WHEN action IN ('measurement', 'writing') AND p IN (0, 1) THEN 'recording_1' WHEN action IN ('measurement', 'writing') AND p IN (2, 3) THEN 'recording_2' END"""
FIVE_PHASE = """CASE WHEN action = 'wiring' AND p IN (1, 2) THEN 2 WHEN action IN ('measurement', 'writing') AND p IN (0, 1) THEN 1 WHEN action IN ('measurement', 'writing') AND p IN (2, 3) THEN 3 ELSE p END"""


@query("state_machine_7", machine_sql(SEVEN_STAGE, SEVEN_PHASE, 6))
def _(spark, d):
    return decode.state_machine(tl(spark, d), decode.SEVEN, 6)


@query("state_machine_5", machine_sql(FIVE_STAGE, FIVE_PHASE, 4))
def _(spark, d):
    return decode.state_machine(tl(spark, d), decode.FIVE, 4)


@query("hysteresis", f"""WITH RECURSIVE {TL}, l AS (SELECT entity, list(CAST(conf AS DOUBLE)) AS xs, median(CAST(conf AS DOUBLE)) AS mid FROM tl GROUP BY entity),
  m(entity, i, low, high, done) AS (SELECT entity, 0, list_min(xs), list_max(xs), false FROM l UNION ALL SELECT entity, i + 1, a, b, abs(a - low) + abs(b - high) < 1e-8 FROM (SELECT m.entity, i, low, high, coalesce(list_sum(list_filter(xs, lambda x: x <= (low + high) / 2)) / len(list_filter(xs, lambda x: x <= (low + high) / 2)), low) AS a,
    coalesce(list_sum(list_filter(xs, lambda x: x > (low + high) / 2)) / nullif(len(list_filter(xs, lambda x: x > (low + high) / 2)), 0), high) AS b FROM m JOIN l USING (entity) WHERE i < 20 AND NOT done)),
  c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY i DESC) = 1), d AS (SELECT entity, CASE WHEN high - low >= greatest(0.025, 0.08 * greatest(high, 1e-6)) THEN low + 0.35::DOUBLE * (high - low) ELSE mid END AS down, CASE WHEN high - low >= greatest(0.025, 0.08 * greatest(high, 1e-6)) THEN low + 0.65::DOUBLE * (high - low) ELSE mid END AS up FROM c JOIN l USING (entity)),
  o AS (SELECT tl.*, down, up, row_number() OVER (PARTITION BY entity ORDER BY first_s, event_id) AS k FROM tl JOIN d USING (entity)), r(entity, k, event_id, side, streak) AS (SELECT entity, k, event_id, conf >= (down + up) / 2, 0 FROM o WHERE k = 1
  UNION ALL SELECT entity, k, event_id, CASE WHEN s = 2 THEN NOT side ELSE side END, s % 2 FROM (SELECT o.entity, o.k, o.event_id, r.side, CASE WHEN (r.side AND conf <= down) OR (NOT r.side AND conf >= up) THEN streak + 1 ELSE 0 END AS s FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1))
  SELECT entity, event_id, CASE WHEN side THEN 'present' ELSE 'absent' END AS state FROM r""")
def _(spark, d):
    return decode.hysteresis(tl(spark, d), "conf", ["first_s", "event_id"])


@query("greedy_conflicts", f"""WITH RECURSIVE {TL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first_s, event_id) AS k FROM tl), r(entity, k, kept) AS (SELECT DISTINCT entity, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, a VARCHAR, f BIGINT, l BIGINT, c BIGINT)[]) FROM tl
  UNION ALL SELECT entity, k, CASE WHEN len(met) = 0 OR c > top THEN list_append(list_filter(kept, lambda x: NOT list_contains(met, x)), {{'i': i, 'a': a, 'f': f, 'l': l, 'c': c}}) WHEN c < top AND len(list_filter(met, lambda x: x.c = top)) = 1 THEN list_filter(kept, lambda x: NOT list_contains(met, x) OR x.c = top) ELSE list_filter(kept, lambda x: NOT list_contains(met, x)) END
  FROM (SELECT *, list_max(list_transform(met, lambda x: x.c)) AS top FROM (SELECT o.entity, o.k, kept, event_id AS i, action AS a, first_s AS f, last_s AS l, conf AS c, list_filter(kept, lambda x: x.a <> 'uncertain' AND o.action <> 'uncertain' AND x.a <> o.action AND x.l >= o.first_s AND x.f <= o.last_s) AS met FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1))),
  z AS (SELECT entity, list_transform(kept, lambda x: x.i) AS ids FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k DESC) = 1) SELECT tl.entity, event_id, list_contains(ids, event_id) AS kept FROM tl JOIN z USING (entity)""")
def _(spark, d):
    return decode.greedy_conflicts(tl(spark, d))


@query("separated_topk", f"""WITH RECURSIVE {TL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY conf DESC, first_s, event_id) AS k FROM tl), r(entity, k, event_id, kept, times) AS (SELECT DISTINCT entity, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS BIGINT[]) FROM tl
  UNION ALL SELECT o.entity, o.k, o.event_id, len(times) < 4 AND len(list_filter(times, lambda x: abs(x - o.first_s) < 86400)) = 0, CASE WHEN len(times) < 4 AND len(list_filter(times, lambda x: abs(x - o.first_s) < 86400)) = 0 THEN list_append(times, o.first_s) ELSE times END FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1)
  SELECT tl.* FROM r JOIN tl ON r.event_id = tl.event_id WHERE kept""")
def _(spark, d):
    return decode.separated(tl(spark, d), "first_s", "conf", 86400, 4)


@query("capped_merge", f"""WITH RECURSIVE {TL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity {ORD}) AS k FROM tl), r(entity, k, g, f, l) AS (SELECT entity, k, CAST(1 AS BIGINT), first_s, last_s FROM o WHERE k = 1
  UNION ALL SELECT o.entity, o.k, CASE WHEN first_s <= l + 3600 AND greatest(l, last_s) - f <= 200000 THEN g ELSE g + 1 END, CASE WHEN first_s <= l + 3600 AND greatest(l, last_s) - f <= 200000 THEN f ELSE first_s END, CASE WHEN first_s <= l + 3600 AND greatest(l, last_s) - f <= 200000 THEN greatest(l, last_s) ELSE last_s END FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1)
  SELECT entity, min(f) AS first_s, max(l) AS last_s, count(*) AS members FROM r GROUP BY entity, g""")
def _(spark, d):
    return decode.capped_merge(tl(spark, d), 3600, 200000)


@query("farthest_first", f"""WITH RECURSIVE {TL}, l AS (SELECT entity, list({{'n': 1000000000000, 't': -first_s, 'i': -event_id}}) AS m FROM tl GROUP BY entity), r(entity, rank, id, left_) AS (SELECT entity, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), m FROM l
  UNION ALL SELECT entity, rank + 1, -b.i, list_transform(list_filter(left_, lambda x: x.i <> b.i), lambda x: {{'n': least(x.n, abs(x.t - b.t)), 't': x.t, 'i': x.i}}) FROM (SELECT *, list_max(left_) AS b FROM r WHERE len(left_) > 0)) SELECT entity, id AS event_id, rank FROM r WHERE rank > 0""")
def _(spark, d):
    return decode.farthest_first(tl(spark, d), "first_s")


@query("nms_iou", f"""WITH RECURSIVE {TL}, b AS (SELECT entity, event_id, first_s / 1e4::DOUBLE AS x0, conf / 1e2::DOUBLE AS y0, last_s / 1e4::DOUBLE AS x1, conf / 1e2::DOUBLE + 5::DOUBLE AS y1, CAST(conf AS DOUBLE) AS score, row_number() OVER (PARTITION BY entity ORDER BY conf DESC, event_id) AS k FROM tl),
  r(entity, k, kept) AS (SELECT DISTINCT entity, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) FROM b
  UNION ALL SELECT b.entity, b.k, CASE WHEN len(kept) < 20 AND len(list_filter(kept, lambda q: NOT coalesce(greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0)) / nullif((b.x1 - b.x0) * (b.y1 - b.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - greatest(0, least(q.x1, b.x1) - greatest(q.x0, b.x0)) * greatest(0, least(q.y1, b.y1) - greatest(q.y0, b.y0)), 0), 0) < 0.35)) = 0
    THEN list_append(kept, {{'i': b.event_id, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) ELSE kept END FROM r JOIN b ON b.entity = r.entity AND b.k = r.k + 1),
  z AS (SELECT entity, list_transform(kept, lambda x: x.i) AS ids FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k DESC) = 1) SELECT b.* EXCLUDE (k) FROM b JOIN z ON b.entity = z.entity AND list_contains(ids, event_id)""")
def _(spark, d):
    rows = tl(spark, d).select("entity", "event_id", (F.col("first_s") / 1e4).alias("x0"), (F.col("conf") / 1e2).alias("y0"), (F.col("last_s") / 1e4).alias("x1"), (F.col("conf") / 1e2 + 5).alias("y1"), F.col("conf").cast("double").alias("score"))
    return decode.suppressed(rows, 20)


@query("phase_aligned_sampling", f"WITH {SPANS}, f AS (SELECT *, start_s + ((7 - start_s) % 40000 + 40000) % 40000 AS f FROM spans) SELECT entity, unnest(generate_series(f, end_s, 40000)) AS at_s FROM f WHERE f <= end_s")
def _(spark, d):
    return sampling.phase_aligned(spans(spark, d), 40000, 7)


@query("half_open_buckets", f"""WITH {SPANS}, b AS (SELECT *, unnest(generate_series(0, CAST(ceil((end_s - start_s) / 30000.0) AS BIGINT) - 1)) AS k FROM spans WHERE end_s > start_s)
  SELECT entity, k AS bucket_no, start_s + k * 30000 AS from_s, least(start_s + (k + 1) * 30000, end_s) AS to_s FROM b""")
def _(spark, d):
    return sampling.half_open_buckets(spans(spark, d), 30000)


@query("overlapping_chunks", f"""WITH {TL}, r AS (SELECT entity, event_id, row_number() OVER (PARTITION BY entity ORDER BY first_s, event_id) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM tl),
  c AS (SELECT entity, unnest(generate_series(0, greatest(0, CAST(ceil((n - 1) / 4.0) AS BIGINT) - 1))) AS chunk_no FROM (SELECT DISTINCT entity, n FROM r)) SELECT r.entity, event_id, chunk_no FROM r JOIN c ON r.entity = c.entity AND i BETWEEN chunk_no * 4 AND chunk_no * 4 + 4""")
def _(spark, d):
    return sampling.overlapping_chunks(tl(spark, d), ["first_s", "event_id"], 5).select("entity", "event_id", "chunk_no")


@query("transition_bursts", f"""WITH {RUNS}, b AS (SELECT entity, first_s + dl AS at_s, dl FROM runs, (SELECT unnest(generate_series(-120, 120, 30)) AS dl)), n AS (SELECT entity, at_s, first(dl ORDER BY abs(dl), dl) AS delta FROM b GROUP BY ALL)
  SELECT entity, at_s, delta, CASE WHEN abs(delta) <= 30 THEN 'during' WHEN delta < 0 THEN 'before' ELSE 'after' END AS phase FROM n""")
def _(spark, d):
    return sampling.bursts(runs(spark, d), "first_s", 120, 30, 30)


@query("role_times", f"WITH {SPANS} SELECT entity, CAST(p AS BIGINT) AS share, start_s + CAST(floor((end_s - start_s) * p / 100.0) AS BIGINT) AS at_s FROM spans, (SELECT unnest([10, 50, 85]) AS p)")
def _(spark, d):
    return sampling.role_times(spans(spark, d), [10, 50, 85])


@query("best_per_key", f"WITH {TL} SELECT entity, action, event_id, conf FROM tl QUALIFY row_number() OVER (PARTITION BY entity, action ORDER BY conf DESC, first_s, event_id) = 1")
def _(spark, d):
    return fusion.best_per_key(tl(spark, d), ["entity", "action"], [F.col("conf").desc(), "first_s", "event_id"]).select("entity", "action", "event_id", "conf")


@query("first_wins_merge", f"WITH {TL}, u AS (SELECT entity, action, 0 AS f, min(first_s) AS s FROM tl WHERE conf >= 500 GROUP BY ALL UNION ALL SELECT entity, action, 1, min(first_s) FROM tl GROUP BY ALL) SELECT entity, action, s FROM u QUALIFY row_number() OVER (PARTITION BY entity, action ORDER BY f) = 1")
def _(spark, d):
    firsts = lambda rows: rows.groupBy("entity", "action").agg(F.min("first_s").alias("s"))
    return fusion.first_wins([firsts(tl(spark, d).where("conf >= 500")), firsts(tl(spark, d))], ["entity", "action"])


@query("verifier_override", "SELECT p_partkey, CASE WHEN l.q >= 40 THEN 'large' ELSE p_brand END AS p_brand FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY l_partkey) l ON p_partkey = l_partkey")
def _(spark, d):
    newer = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("q")).withColumn("p_brand", F.lit("large"))
    return fusion.overridden(table(spark, d, "part").select("p_partkey", "p_brand"), newer, "p_partkey", F.col("q") >= 40, ["p_brand"])


@query("two_pass_choice", "SELECT event_id, coalesce(CASE WHEN value >= 80 THEN 2 END, CASE WHEN value >= 40 THEN 1 END, 0) AS level, CASE WHEN value >= 80 THEN 'dense' WHEN value >= 40 THEN 'coarse' ELSE 'fallback' END AS origin FROM events")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("value") >= 80, 2).alias("dense"), F.when(F.col("value") >= 40, 1).alias("coarse"), F.lit(0).alias("fallback"))
    value, origin = fusion.chosen_pass("dense", "coarse", "fallback")
    return rows.select("event_id", value.alias("level"), origin.alias("origin"))


@query("plan_diff", """WITH o AS (SELECT doc_id, max(toxic) AS was FROM labels GROUP BY doc_id), n AS (SELECT doc_id, max(CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END) AS now FROM documents GROUP BY doc_id)
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, was, now, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR was IS DISTINCT FROM now""")
def _(spark, d):
    old = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("v"))
    new = table(spark, d, "documents").groupBy("doc_id").agg(F.max((F.col("n_chars") > 1500).cast("int")).alias("v"))
    return fusion.changed(old, new, "doc_id", "v")


@query("partition_errors", f"""WITH {TL}, k AS (SELECT event_id, conf >= 100 AS a, conf < 120 AND action <> 'uncertain' AS j FROM tl) SELECT event_id, CASE WHEN a AND j THEN 'both' ELSE 'missing' END AS error FROM k WHERE a = j""")
def _(spark, d):
    rows = tl(spark, d)
    return fusion.partition_errors(rows, rows.where("conf >= 100"), rows.where("conf < 120 and action <> 'uncertain'"), "event_id")


@query("bucket_coverage", f"""WITH {SPANS}, w AS (SELECT DISTINCT entity, unnest(generate_series(start_s // 86400, end_s // 86400)) AS day FROM spans), s AS (SELECT entity, first_s // 86400 AS day, count(*) AS times FROM tl GROUP BY ALL)
  SELECT coalesce(w.entity, s.entity) AS entity, coalesce(w.day, s.day) AS day, CASE WHEN times IS NULL THEN 'missing' WHEN w.day IS NULL THEN 'unexpected' ELSE 'duplicate' END AS state FROM w FULL JOIN s ON w.entity = s.entity AND w.day = s.day WHERE times IS NULL OR w.day IS NULL OR times > 1""")
def _(spark, d):
    wanted = spans(spark, d).select("entity", F.explode(F.sequence(F.floor(F.col("start_s") / 86400), F.floor(F.col("end_s") / 86400))).alias("day"))
    return fusion.coverage(wanted, tl(spark, d).select("entity", F.floor(F.col("first_s") / 86400).alias("day")), ["entity", "day"])


@query("episode_any_pass", f"WITH {TL}, e AS (SELECT entity, conf, conf >= 300 AS ok FROM tl) SELECT entity, CASE WHEN bool_or(ok) THEN 'pass' ELSE 'fail' END AS decision, coalesce(max(CASE WHEN ok THEN conf END), max(conf)) AS conf, count(*) AS episodes FROM e GROUP BY entity")
def _(spark, d):
    return fusion.any_pass(tl(spark, d).withColumn("decision", F.when(F.col("conf") >= 300, "pass").otherwise("fail")))


@query("stable_abnormal", f"WITH {TL} SELECT entity, count(DISTINCT first_s // 86400) AS units, max(conf) AS best FROM tl WHERE action = 'uncertain' AND conf >= 200 GROUP BY entity HAVING count(DISTINCT first_s // 86400) >= 2 OR max(conf) >= 900")
def _(spark, d):
    return fusion.stable_abnormal(tl(spark, d).where("action = 'uncertain' and conf >= 200").withColumn("day", F.floor(F.col("first_s") / 86400)), "day", "conf")


@query("dominant_cluster", f"""WITH {TL}, n AS (SELECT entity, conf, count(*) OVER (PARTITION BY entity ORDER BY conf RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS near, count(*) OVER (PARTITION BY entity) AS total FROM tl)
  SELECT entity, conf AS centre, near, near * 1000 // total AS share, near * 2 > total AS majority FROM n QUALIFY row_number() OVER (PARTITION BY entity ORDER BY near DESC, conf) = 1""")
def _(spark, d):
    return fusion.dominant_cluster(tl(spark, d), "conf", 30)


@query("entity_classes", f"WITH {TL} SELECT entity, CASE WHEN bool_or(conf >= 400) THEN 'over' WHEN bool_or(action = 'uncertain') THEN 'unsure' ELSE 'plain' END AS class FROM tl GROUP BY entity")
def _(spark, d):
    return fusion.classified(tl(spark, d), {"over": F.col("conf") >= 400, "unsure": F.col("action") == "uncertain"}, "plain")


@query("boundary_comparison", f"""WITH {RUNS}, {WIDE}, a AS (SELECT DISTINCT entity, stage, first_s FROM runs) SELECT a.entity, a.stage, a.first_s, min(abs(a.first_s - wide.last_s)) AS distance FROM a LEFT JOIN wide ON a.entity = wide.entity AND a.stage = wide.stage GROUP BY ALL""")
def _(spark, d):
    reference = intervals.stage_runs(tl(spark, d), gap=90000).select("entity", "stage", F.col("last_s").alias("first_s"))
    return fusion.nearest_reference(runs(spark, d).select("entity", "stage", "first_s").distinct(), reference, ["entity", "stage"], "first_s")


@query("beam_decode")
def _(spark, d):
    return decode.beam_decode(tl(spark, d), scale=3600)


@query("track_link")
def _(spark, d):
    rows = tl(spark, d).select("entity", "event_id", F.floor(F.col("first_s") / 86400).alias("frame"), (F.col("first_s") % 86400 / 1e3).alias("x0"), (F.col("conf") / 1e2).alias("y0"))
    return decode.linked_tracks(rows.withColumns({"x1": F.col("x0") + 30, "y1": F.col("y0") + 5}), 0.25, 2)
