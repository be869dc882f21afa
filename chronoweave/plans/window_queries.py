"""Windows, samples and lookups as named queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import tracking, windows
from chronoweave.plans.queries import RUNS, TL, runs, tl
from chronoweave.plans.registry import query


@query("gap_groups", f"""WITH {TL}, g AS (SELECT *, CASE WHEN first_s - lag(first_s) OVER (PARTITION BY entity ORDER BY first_s, event_id) > 40000 THEN 1 ELSE 0 END AS new FROM tl) SELECT entity, event_id, CAST(sum(new) OVER (PARTITION BY entity ORDER BY first_s, event_id) AS BIGINT) AS group_no FROM g""")
def _(spark, d):
    return tracking.gap_groups(tl(spark, d), "first_s", 40000).select("entity", "event_id", "group_no")


@query("adjacent_clusters", f"""WITH {TL}, g AS (SELECT *, lag(action) OVER w IS NOT DISTINCT FROM action AND first_s - lag(first_s) OVER w > 0 AND first_s - lag(first_s) OVER w <= 60000 AS on_ FROM tl WINDOW w AS (PARTITION BY entity ORDER BY first_s, event_id))
  SELECT entity, event_id, CAST(sum(CASE WHEN coalesce(on_, false) THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY first_s, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS cluster_no FROM g""")
def _(spark, d):
    return windows.adjacent_clusters(tl(spark, d), "action", "first_s", 60000, ["event_id"]).select("entity", "event_id", "cluster_no")


@query("angle_clusters", f"""WITH RECURSIVE {TL}, o AS (SELECT entity, event_id, CAST(conf AS DOUBLE) AS angle, last_s - first_s AS size, event_id % 50 AS distance, row_number() OVER (PARTITION BY entity ORDER BY conf DESC, event_id) AS k FROM tl),
  r(entity, k, event_id, no, total, n) AS (SELECT entity, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), 0 FROM o WHERE k = 1 UNION ALL SELECT entity, k, event_id, CASE WHEN new THEN no + 1 ELSE no END, CASE WHEN new THEN angle ELSE total + angle END, CASE WHEN new THEN 1 ELSE n + 1 END
  FROM (SELECT o.entity, o.k, o.event_id, o.angle, r.no, r.total, r.n, r.n = 0 OR abs(o.angle - r.total / r.n) > 4 AS new FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1)), c AS (SELECT o.*, r.no FROM r JOIN o ON o.entity = r.entity AND o.k = r.k WHERE r.k > 0)
  SELECT entity, no AS cluster_no, first(event_id ORDER BY size DESC, distance, event_id) AS event_id, CAST(round_even(median(angle) * 2, 0) AS BIGINT) AS twice_angle, count(*) AS members FROM c GROUP BY entity, no""")
def _(spark, d):
    rows = tl(spark, d).select("entity", "event_id", F.col("conf").alias("angle"), (F.col("last_s") - F.col("first_s")).alias("size"), (F.col("event_id") % 50).alias("distance"))
    return windows.angle_clusters(rows, 4.0).select("entity", "cluster_no", "event_id", F.rint(F.col("angle") * 2).cast("long").alias("twice_angle"), "members")


@query("normalized_runs", f"""WITH {RUNS}, r AS (SELECT entity, run_no AS position, CASE WHEN run_no % 11 <> 0 THEN stage ELSE '' END AS stage, CAST(first_s AS DOUBLE) AS s, CASE WHEN run_no % 7 = 0 THEN NULL WHEN run_no % 5 = 0 THEN CAST(first_s - 1 AS DOUBLE) ELSE CAST(last_s AS DOUBLE) END AS e, CASE WHEN run_no % 2 = 0 THEN 'r' || run_no ELSE '' END AS id FROM runs)
  SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY s, e, stage, position) AS run_no, stage, s AS start_s, e AS end_s, CASE WHEN id <> '' THEN id ELSE 'run_' || CASE WHEN position < 1000 THEN lpad(CAST(position AS VARCHAR), 3, '0') ELSE CAST(position AS VARCHAR) END END AS run_id FROM r WHERE stage <> '' AND e >= s""")
def _(spark, d):
    n = F.col("run_no")
    end = F.when(n % 7 == 0, "soon").when(n % 5 == 0, (F.col("first_s") - 1).cast("string")).otherwise(F.col("last_s").cast("string"))
    raw = runs(spark, d).select("entity", n.alias("position"), F.when(n % 11 != 0, F.col("stage")).alias("stage"), F.col("first_s").cast("string").alias("start_s"), end.alias("end_s"), F.when(n % 2 == 0, F.concat(F.lit("r"), n.cast("string"))).alias("run_id"))
    return windows.normalized_runs(raw)


@query("normalized_segments", f"""WITH {RUNS}, s AS (SELECT entity, run_no - 1 AS position, first_s + CASE WHEN entity % 3 = 0 THEN 0 ELSE 10000000 * run_no END AS start_s, last_s + CASE WHEN entity % 3 = 0 THEN 0 ELSE 10000000 * run_no END AS end_s FROM runs WHERE entity % 5 <> 0),
  e AS (SELECT *, coalesce(start_s < lag(end_s) OVER (PARTITION BY entity ORDER BY position), false) AS early FROM s) SELECT entity, CAST(position AS BIGINT) AS position, start_s, end_s, CASE WHEN max(early) OVER (PARTITION BY entity) THEN 'overlap' END AS error FROM e
  UNION ALL SELECT DISTINCT entity, NULL, NULL, NULL, 'missing' FROM runs WHERE entity % 5 = 0""")
def _(spark, d):
    apart = F.when(F.col("entity") % 3 == 0, 0).otherwise(10000000 * F.col("run_no"))
    one = F.struct("run_no", (F.col("first_s") + apart).alias("start_s"), (F.col("last_s") + apart).alias("end_s"))
    lists = runs(spark, d).groupBy("entity").agg(F.sort_array(F.collect_list(one)).alias("list"))
    records = lists.select("entity", F.when((F.col("entity") % 5 != 0) & (F.col("entity") % 2 == 0), F.col("list")).alias("segments"), F.when((F.col("entity") % 5 != 0) & (F.col("entity") % 2 != 0), F.col("list")).alias("actions"))
    return windows.normalized_segments(records).withColumn("position", F.col("position").cast("long"))


@query("observations_of_frames", f"""WITH {TL}, f AS (SELECT event_id AS g, entity, first_s // 86400 AS window_id, first_s // 3600 AS "at", event_id % 3 = 0 AS dense, event_id % 4 = 0 AS fallback FROM tl WHERE event_id % 2 = 0), o AS (SELECT event_id, (event_id * 7919) % 4000 AS g, conf FROM tl)
  SELECT f.entity, window_id, "at", event_id, o.g AS image_group FROM o JOIN f ON f.g = o.g QUALIFY row_number() OVER (PARTITION BY f.entity, window_id, "at" ORDER BY dense DESC, fallback, conf DESC, event_id) = 1""")
def _(spark, d):
    e, rows = F.col("event_id"), tl(spark, d)
    frames = rows.where("event_id % 2 = 0").select(e.alias("image_group"), "entity", F.floor(F.col("first_s") / 86400).alias("window_id"), F.floor(F.col("first_s") / 3600).alias("at"), (e % 3 == 0).alias("dense"), (e % 4 == 0).alias("fallback"))
    return windows.observations_of_frames(rows.select("event_id", ((e * 7919) % 4000).alias("image_group"), "conf"), frames).select("entity", "window_id", "at", "event_id", "image_group")


@query("boundary_centres", f"""WITH {RUNS}, b AS (SELECT entity, run_no AS boundary_no, first_s AS at_s, greatest(0, first_s - 5000) AS f, least(2592000, first_s + 5000) AS t FROM runs), i AS (SELECT entity, first_s, last_s, unnest([first_s + 700, (first_s + last_s) // 2, last_s - 900]) AS p FROM tl WHERE action <> 'uncertain'),
  c AS (SELECT b.entity, boundary_no, count(*) AS n, first(p ORDER BY abs(p - at_s), p) AS p FROM b JOIN i ON b.entity = i.entity AND p BETWEEN f AND t AND last_s >= f AND first_s <= t GROUP BY ALL)
  SELECT b.entity, b.boundary_no, coalesce(p, at_s) AS selected_s, greatest(0, coalesce(p, at_s) - 600) AS from_s, least(2592000, coalesce(p, at_s) + 600) AS to_s, coalesce(n, 0) AS candidates FROM b LEFT JOIN c ON b.entity = c.entity AND b.boundary_no = c.boundary_no""")
def _(spark, d):
    planned = F.array(F.col("first_s") + 700, F.floor((F.col("first_s") + F.col("last_s")) / 2), F.col("last_s") - 900)
    intervals = tl(spark, d).where("action <> 'uncertain'").select("entity", "first_s", "last_s", planned.alias("planned"))
    return windows.boundary_centres(runs(spark, d).select("entity", F.col("run_no").alias("boundary_no"), F.col("first_s").alias("at_s")), intervals, 5000, 600, F.lit(0).cast("long"), F.lit(2592000).cast("long"))


@query("windows_of_anchors", f"""WITH {RUNS}, w AS (SELECT entity, run_no AS no, 'w' || run_no AS id, stage, first_s, last_s + 20000 AS last_s FROM runs), a AS (SELECT entity, event_id, CASE WHEN event_id % 4 = 0 THEN 'w' || event_id % 90 END AS id, CASE WHEN event_id % 3 <> 0 THEN action END AS stage, first_s + 9000 AS at_s FROM tl),
  x AS (SELECT a.entity, event_id, min(n.no) AS named, min(h.no) AS held FROM a LEFT JOIN w n ON n.entity = a.entity AND n.id = a.id LEFT JOIN w h ON h.entity = a.entity AND at_s BETWEEN h.first_s AND h.last_s AND (a.stage IS NULL OR a.stage = h.stage) GROUP BY ALL)
  SELECT entity, event_id, coalesce(named, held) AS window_no, CASE WHEN named IS NOT NULL THEN 'named' WHEN held IS NOT NULL THEN 'held' END AS how FROM x""")
def _(spark, d):
    e = F.col("event_id")
    name = lambda c: F.concat(F.lit("w"), c.cast("string"))
    spans = runs(spark, d).select("entity", F.col("run_no").alias("window_no"), name(F.col("run_no")).alias("window_id"), "stage", "first_s", (F.col("last_s") + 20000).alias("last_s"))
    anchors = tl(spark, d).select("entity", "event_id", F.when(e % 4 == 0, name(e % 90)).alias("window_id"), F.when(e % 3 != 0, F.col("action")).alias("stage"), (F.col("first_s") + 9000).alias("at_s"))
    return windows.windows_of_anchors(anchors, spans)


@query("observed_boundaries", f"""WITH {TL}, f AS (SELECT event_id, first_s FROM tl WHERE conf >= 20), p AS (SELECT event_id AS b, event_id + 1 AS lf, event_id + 2 AS ft, conf / 1000.0::DOUBLE AS c, CASE event_id % 5 WHEN 0 THEN ' None ' WHEN 1 THEN '' WHEN 2 THEN 'blurred' WHEN 3 THEN '无' END AS u FROM tl WHERE event_id % 7 <> 0 AND event_id % 3 <> 1)
  SELECT b AS boundary_id, x.first_s AS from_s, y.first_s AS to_s, c < 0.05 OR lower(trim(coalesce(u, ''))) NOT IN ('', '无', 'none', 'null', 'n/a', '无不确定性') AS needs_review FROM p JOIN f x ON x.event_id = lf JOIN f y ON y.event_id = ft""")
def _(spark, d):
    e, rows = F.col("event_id"), tl(spark, d)
    said = F.when(e % 5 == 0, " None ").when(e % 5 == 1, "").when(e % 5 == 2, "blurred").when(e % 5 == 3, "无")
    passes = rows.select(e.alias("boundary_id"), (e % 7 != 0).alias("valid"), F.when(e % 3 != 1, "observed").otherwise("uncertain").alias("decision"), (e + 1).alias("last_from"), (e + 2).alias("first_to"), (F.col("conf") / 1000).alias("conf"), said.alias("uncertainty"))
    return windows.observed_boundaries(passes, rows.where("conf >= 20").select(e.alias("frame_id"), F.col("first_s").alias("at_s")), 0.05)


@query("phase_samples", f"""WITH {TL}, p AS (SELECT *, event_id % 13 = 0 AS pref, max(event_id % 13 = 0) OVER (PARTITION BY entity, action) AS any_ FROM tl), r AS (SELECT *, row_number() OVER (PARTITION BY entity, action ORDER BY first_s, event_id) - 1 AS i, count(*) OVER (PARTITION BY entity, action) AS n FROM p WHERE pref OR NOT any_)
  SELECT entity, action, event_id FROM r WHERE n <= 4 OR list_contains(list_transform([0, 1, 2, 3], lambda k: CAST(round_even(k * (n - 1) / 3.0::DOUBLE, 0) AS BIGINT)), i)""")
def _(spark, d):
    return windows.phase_samples(tl(spark, d), "action", F.col("event_id") % 13 == 0, ["first_s", "event_id"], 4).select("entity", "action", "event_id")


@query("window_samples", f"""WITH {RUNS}, w AS (SELECT entity, run_no, first_s, last_s, last_s + 3000 AS review_s, run_no % 2 = 0 AS fin FROM runs), t AS (SELECT *, unnest(list_distinct(list_transform(list_concat(generate_series(first_s, review_s, 5000), [last_s - 4000, last_s - 2000, last_s, last_s + 2000, last_s + 4000, review_s]), lambda x: least(review_s, greatest(first_s, x))))) AS at_s FROM w)
  SELECT entity, run_no, at_s, CASE WHEN fin AND at_s >= last_s - 6000 THEN 'stable_candidate' ELSE 'process_scan' END AS role FROM t""")
def _(spark, d):
    rows = runs(spark, d).select("entity", "run_no", "first_s", "last_s", (F.col("last_s") + 3000).alias("review_s"), (F.col("run_no") % 2 == 0).alias("final"))
    return windows.window_samples(rows, 5000, (-4000, -2000, 0, 2000, 4000), 6000).select("entity", "run_no", "at_s", "role")


@query("mandatory_picks", f"""WITH {TL}, r AS (SELECT *, event_id * 37 % 1000 AS motion, event_id * 91 % 1000 AS sharp, row_number() OVER (PARTITION BY entity ORDER BY first_s, event_id) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM tl),
  g AS (SELECT entity, n, first(i ORDER BY motion DESC, i) AS m, first(i ORDER BY sharp DESC, i) AS s, list_transform(range(8), lambda k: CAST(round_even(k * (n - 1) / 7.0::DOUBLE, 0) AS BIGINT)) AS u FROM r GROUP BY entity, n),
  a AS (SELECT *, CASE WHEN list_contains(u, m) THEN u ELSE list_append(list_filter(u, lambda x: x <> u[6]), m) END AS c, CASE WHEN list_contains(u, m) THEN u[6] ELSE m END AS gone FROM g),
  b AS (SELECT entity, n, CASE WHEN list_contains(c, s) THEN c ELSE list_append(list_filter(c, lambda x: x <> gone), s) END AS c FROM a) SELECT r.entity, event_id FROM r JOIN b ON r.entity = b.entity WHERE r.n <= 8 OR list_contains(c, i)""")
def _(spark, d):
    rows = tl(spark, d).withColumns({"motion": F.col("event_id") * 37 % 1000, "sharp": F.col("event_id") * 91 % 1000})
    return windows.mandatory_picks(rows, ["entity"], ["first_s", "event_id"], "motion", "sharp", 8).select("entity", "event_id")
