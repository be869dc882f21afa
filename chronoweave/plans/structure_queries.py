"""Similarity, graphs, tracking, windows under a budget, nested values and gates as named queries, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: F401
from pyspark.sql import functions as F

from chronoweave.operators import clusters, decode, gate, graph, nested, requests, scan, similarity, tracking
from chronoweave.plans.queries import RUNS, TL, runs, tl
from chronoweave.plans.registry import query
from chronoweave.session import shared_dir, table
from chronoweave.sources import runs as artifacts
from chronoweave.streaming import stateful

# ---- near duplicates of vectors

#: Three frames of each embedding, as if it had been encoded again: whole numbers, moved by 0, up to 2 and up to 5 steps.
FRAMES = """f AS (SELECT vec_id * 3 + k AS id, list_transform(range(len(embedding)), lambda i: CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 256) AS BIGINT) + CASE k WHEN 0 THEN 0 WHEN 1 THEN (vec_id + 7 * i) % 5 - 2 ELSE ((vec_id // 10 + 3 * i) % 11 - 5) * (vec_id % 3) END) AS v
  FROM embeddings, (SELECT unnest([0, 1, 2]) AS k))"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    moved = "case k when 0 then 0 when 1 then (vec_id + 7 * i) % 5 - 2 else ((vec_id div 10 + 3 * i) % 11 - 5) * (vec_id % 3) end"
    return rows.select((F.col("vec_id") * 3 + F.col("k")).alias("id"), F.expr(f"transform(embedding, (x, i) -> floor(cast(x as double) * 256) + {moved})").alias("v"))


NEAR = f"""{FRAMES}, p AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(range(len(a.v)), lambda i: abs(a.v[i + 1] - b.v[i + 1]))) AS total FROM f a JOIN f b ON a.id < b.id AND a.v <> b.v WHERE total <= 3 * len(a.v))"""


@query("near_duplicate_pairs", f"""WITH {NEAR}, r AS (SELECT v, min(id) AS rep FROM f GROUP BY v)
  SELECT a, b, CAST(total AS DOUBLE) AS total FROM p WHERE a IN (SELECT rep FROM r) AND b IN (SELECT rep FROM r)""")
def _(spark, d):
    return similarity.near_pairs(frames(spark, d), "id", "v", 3)


@query("near_duplicate_components", f"""WITH RECURSIVE {NEAR}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c(x, y) AS (SELECT a, a FROM e UNION SELECT c.x, e.b FROM c JOIN e ON c.y = e.a),
  m AS (SELECT x AS id, min(y) AS component FROM c GROUP BY x)
  SELECT id, component, count(DISTINCT v) OVER (PARTITION BY component) AS vectors, count(*) OVER (PARTITION BY component) AS members FROM m JOIN f USING (id)""")
def _(spark, d):
    return similarity.near_groups(frames(spark, d), "id", "v", 3)


# ---- state machines of live streams, replayed out of order

#: Seven stages spelt out: where each phase goes, and by what name.
SEVEN_NEXT = """CASE WHEN p = 7 OR action = 'cleanup' THEN 7 WHEN action = 'wiring' AND p IN (1, 2, 3) THEN 3 WHEN action = 'measurement' AND p IN (0, 1) THEN 1 WHEN action = 'measurement' AND p IN (3, 4) THEN 4
  WHEN action = 'writing' AND p < 3 THEN 2 WHEN action = 'writing' AND p < 6 THEN 5 ELSE p END"""
SEVEN_STAGE = """CASE WHEN p = 7 THEN 'noise' WHEN action = 'cleanup' THEN 'material_cleanup' WHEN action = 'wiring' AND p = 0 THEN 'circuit_wiring' WHEN action = 'wiring' AND p IN (1, 2, 3) THEN 'circuit_rewiring'
  WHEN action = 'measurement' AND p IN (0, 1) THEN 'measurement_1' WHEN action = 'measurement' AND p IN (3, 4) THEN 'measurement_2' WHEN action = 'writing' AND p < 3 THEN 'recording_1' WHEN action = 'writing' AND p < 6 THEN 'recording_2' END"""
LIVE_STAGES = f"""WITH RECURSIVE {TL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first_s, event_id) AS k FROM tl),
  r(entity, k, event_id, stage, q) AS (SELECT DISTINCT entity, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 0 FROM tl UNION ALL SELECT entity, k, event_id, {SEVEN_STAGE}, {SEVEN_NEXT} FROM (SELECT o.*, r.q AS p FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1))
  SELECT entity, event_id, stage, CAST(least(q, 6) AS BIGINT) AS phase FROM r WHERE k > 0"""
#: Seconds that a row may come behind the latest one.
LATE = 90000


def arrival() -> F.Column:
    """Rows arrive up to a day behind their time."""
    return F.col("first_s") + F.pmod(F.col("event_id") * 7919, F.lit(86400))


def staged(rows: DataFrame) -> DataFrame:
    stage = scan.protocol_stage(decode.SEVEN, 6, F.col("symbol"), F.col("before"))
    return rows.select("entity", "event_id", stage.alias("stage"), F.least("after", F.lit(6)).cast("long").alias("phase"))


@query("first_end_stages", LIVE_STAGES)
def _(spark, d):
    symbol = scan.protocol_symbol(F.col("action") == "cleanup")
    return staged(scan.scanned(tl(spark, d), scan.protocol(decode.SEVEN, 6), symbol, ["entity"], ["first_s", "event_id"]))


@query("live_stages", LIVE_STAGES)
def _(spark, d):
    symbol = scan.protocol_symbol(F.col("action") == "cleanup")
    return staged(stateful.replayed(spark, tl(spark, d), scan.protocol(decode.SEVEN, 6), symbol, arrival=arrival(), late_s=LATE))


LIVE_PRESENCE = f"""WITH RECURSIVE {TL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first_s, event_id) AS k FROM tl), r(entity, k, event_id, side, streak) AS (SELECT entity, k, event_id, conf >= 150, 0 FROM o WHERE k = 1
  UNION ALL SELECT entity, k, event_id, CASE WHEN s = 3 THEN NOT side ELSE side END, s % 3 FROM (SELECT o.entity, o.k, o.event_id, r.side, CASE WHEN (r.side AND conf <= 100) OR (NOT r.side AND conf >= 200) THEN streak + 1 ELSE 0 END AS s FROM r JOIN o ON o.entity = r.entity AND o.k = r.k + 1))
  SELECT entity, event_id, CASE WHEN side THEN 'present' ELSE 'absent' END AS state FROM r"""


@query("live_presence", LIVE_PRESENCE)
def _(spark, d):
    symbol = scan.persistence_symbol(F.col("conf"), F.lit(100), F.lit(200))
    rows = stateful.replayed(spark, tl(spark, d), scan.persistence(3), symbol, arrival=arrival(), late_s=LATE)
    return rows.select("entity", "event_id", F.when(F.col("after") >= 3, "present").otherwise("absent").alias("state"))


# ---- runs of artifacts


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("conversation_run", """SELECT CAST(conv_id AS VARCHAR) AS entity, count(*) AS turns, count(DISTINCT role) AS roles, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS letters, max(turn) AS last_turn, max(sha256(coalesce(text, ''))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id""")
def _(spark, d):
    path = folder(spark, "runs")
    artifacts.write_run(table(spark, d, "conversations"), path, "conversations", "conv_id")
    back = artifacts.read_runs(spark, path, "turn long, role string, text string").select("entity", "item.*")
    text = F.coalesce("text", F.lit(""))
    return back.groupBy("entity").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"), F.sum(F.length(text)).alias("letters"), F.max("turn").alias("last_turn"), F.max(F.sha2(text, 256)).alias("digest"))


@query("report_summary", f"""WITH {TL}, r AS (SELECT entity, count(*) AS n, max(conf) AS best FROM tl GROUP BY entity) SELECT entity, n, best, (SELECT count(*) FROM r) AS entities, (SELECT CAST(sum(n) AS BIGINT) FROM r) AS total FROM r""")
def _(spark, d):
    path, rows = folder(spark, "summary"), tl(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("best"))
    artifacts.write_summary(rows, path, ["entity"], {"entities": "count(*)", "total": "sum(n)"})
    rows, totals = artifacts.read_summary(spark, path, "entity long, n long, best long")
    return rows.join(F.broadcast(totals))  # one row


# ---- tracks and pairs in the plane

#: Candidates of a frame (six hours) with places and scores from their ids.
SPOT = f"""{TL}, c AS (SELECT *, first_s // 21600 AS frame, event_id * 37 % 200 AS x, event_id * 91 % 200 AS y, event_id * 7919 % 1000 AS score, event_id * 10473 % 1000 AS alike FROM tl)"""


def spots(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return tl(spark, d).withColumns({"frame": F.floor(F.col("first_s") / 21600), "x": e * 37 % 200, "y": e * 91 % 200, "score": e * 7919 % 1000, "alike": e * 10473 % 1000})


@query("anchor_tracks", f"""WITH RECURSIVE {SPOT}, g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY entity ORDER BY frame, event_id) AS BIGINT) AS group_no FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY entity ORDER BY frame, event_id) > 8 THEN 1 ELSE 0 END AS new FROM c)),
  f AS (SELECT *, row_number() OVER (PARTITION BY entity, group_no ORDER BY frame) AS k FROM (SELECT entity, group_no, frame, list({{'id': event_id, 'x': x, 'y': y, 't': score, 'h': alike}} ORDER BY score DESC, event_id) AS m FROM g GROUP BY entity, group_no, frame)),
  a AS (SELECT g.*, k FROM g JOIN f USING (entity, group_no, frame) QUALIFY row_number() OVER (PARTITION BY entity, group_no ORDER BY score DESC, frame, event_id) = 1),
  r(entity, group_no, dir, k, frame, id, x, y, t, h, step) AS (SELECT entity, group_no, dir, k, frame, event_id, x, y, score, alike, CAST(0 AS DOUBLE) FROM a, (SELECT unnest([1, -1]) AS dir)
  UNION ALL SELECT entity, group_no, dir, k, frame, CASE WHEN ok THEN b.id END, CASE WHEN ok THEN b.x ELSE x END, CASE WHEN ok THEN b.y ELSE y END, b.t, b.h, b.gap FROM (SELECT *, coalesce(b.t >= 240 AND b.h >= 340, false) AS ok FROM (SELECT f.entity, f.group_no, dir, f.k, f.frame, r.x, r.y,
    list_max(list_transform(list_filter(f.m, lambda c: sqrt((c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y)) <= 90), lambda c: {{'s': c.t / 1000.0::DOUBLE - sqrt((c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y)) / 360.0::DOUBLE, 't': c.t, 'i': -c.id, 'id': c.id, 'x': c.x, 'y': c.y, 'h': c.h, 'gap': sqrt((c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y))}})) AS b
    FROM r JOIN f ON f.entity = r.entity AND f.group_no = r.group_no AND f.k = r.k + r.dir)))
  SELECT DISTINCT entity, group_no, frame, id AS event_id, CAST(floor(step * 1000) AS BIGINT) AS step, t AS score, h AS alike FROM r WHERE id IS NOT NULL AND NOT (t < 340 AND step > 28) AND (t >= 400 OR (t >= 340 AND h >= 650))""")
def _(spark, d):
    groups = tracking.gap_groups(spots(spark, d), "frame", 8)
    return tracking.tracked_outwards(groups).withColumn("step", F.floor(F.col("step") * 1000))


@query("nearest_in_plane", f"""WITH {TL}, p AS (SELECT *, first_s // 60 AS x, conf * 5 AS y FROM tl), n AS (SELECT a.event_id AS left_id, b.event_id AS right_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS squared FROM p a JOIN p b ON a.action = 'wiring' AND b.action = 'measurement')
  SELECT * FROM n WHERE squared <= 90000 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY squared, right_id) = 1""")
def _(spark, d):
    rows = tl(spark, d).withColumns({"x": F.floor(F.col("first_s") / 60), "y": F.col("conf") * 5})
    return tracking.nearest_in_plane(rows.where("action = 'wiring'"), rows.where("action = 'measurement'"), [], "event_id", 300)


@query("nearest_apart", f"""WITH {SPOT}, n AS (SELECT a.entity, a.event_id AS left_id, b.event_id AS right_id, abs(a.first_s - b.first_s) AS gap, a.conf + b.conf AS quality FROM c a JOIN c b ON a.entity = b.entity AND a.action = 'wiring' AND b.action = 'measurement'
  WHERE abs(a.first_s - b.first_s) <= 40000 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) >= 3600) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY entity ORDER BY gap, quality DESC, left_id, right_id) = 1""")
def _(spark, d):
    rows = spots(spark, d)
    return tracking.nearest_apart(rows.where("action = 'wiring'"), rows.where("action = 'measurement'"), ["entity"], "event_id", "first_s", 40000, 60, "conf")


@query("role_collisions", f"""WITH {TL}, b AS (SELECT entity, first_s // 86400 AS day, action, event_id, conf AS strength, CAST(event_id * 37 % 100 AS DOUBLE) AS x, CAST(event_id * 91 % 20 AS DOUBLE) AS y FROM tl WHERE action IN ('wiring', 'measurement')
    QUALIFY row_number() OVER (PARTITION BY entity, first_s // 86400, action ORDER BY conf DESC, event_id) = 1),
  p AS (SELECT coalesce(a.entity, v.entity) AS entity, coalesce(a.day, v.day) AS day, a.event_id AS ai, v.event_id AS vi, a.strength AS s, v.strength AS t, a.x AS ax, v.x AS vx, CASE WHEN a.x IS NOT NULL AND v.x IS NOT NULL THEN greatest(0, 60 - abs(a.x - v.x)) * greatest(0, 40 - abs(a.y - v.y)) END AS w
    FROM (SELECT * FROM b WHERE action = 'wiring') a FULL JOIN (SELECT * FROM b WHERE action = 'measurement') v ON a.entity = v.entity AND a.day = v.day),
  q AS (SELECT *, CASE WHEN w IS NULL THEN NULL WHEN w / (4800 - w) >= 0.35 THEN CASE WHEN least(s, t) > 0 AND greatest(s, t) >= 1.25 * least(s, t) THEN 'weaker' ELSE 'ambiguous' END WHEN ax >= vx THEN 'order' END AS reason FROM p)
  SELECT entity, day, reason, ai IS NOT NULL AND NOT coalesce(reason IN ('ambiguous', 'order') OR (reason = 'weaker' AND s < t), false) AS ammeter_kept, vi IS NOT NULL AND NOT coalesce(reason IN ('ambiguous', 'order') OR (reason = 'weaker' AND t < s), false) AS voltmeter_kept FROM q""")
def _(spark, d):
    x, y = (F.col("event_id") * 37 % 100).cast("double"), (F.col("event_id") * 91 % 20).cast("double")
    rows = tl(spark, d).where("action in ('wiring', 'measurement')").withColumns({"day": F.floor(F.col("first_s") / 86400), "box": F.struct(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 40).alias("y1"), F.col("conf").alias("strength"))})
    best = lambda action: F.max_by(F.when(F.col("action") == action, F.col("box")), F.when(F.col("action") == action, F.struct("conf", -F.col("event_id"))))
    pairs = rows.groupBy("entity", "day").agg(best("wiring").alias("ammeter"), best("measurement").alias("voltmeter"))
    return tracking.resolved_collisions(pairs, "ammeter", "voltmeter", "strength", overlap=0.35, ratio=1.25).select("entity", "day", "reason", "ammeter_kept", "voltmeter_kept")


# ---- one threshold over all rounds


@query("shared_threshold_states", f"""WITH RECURSIVE {TL}, q AS (SELECT quantile_cont(CAST(conf AS DOUBLE), 0.25) AS low, quantile_cont(CAST(conf AS DOUBLE), 0.75) AS high, count(*) AS n FROM tl), xs AS (SELECT list({{'v': CAST(conf AS DOUBLE), 'n': n}}) AS xs FROM (SELECT conf, count(*) AS n FROM tl GROUP BY conf)),
  m(i, low, high, done) AS (SELECT 0, low, high, false FROM q UNION ALL SELECT i + 1, a, b, abs(a - low) + abs(b - high) < 1e-6 FROM (SELECT i, low, high, coalesce(list_sum(list_transform(list_filter(xs, lambda x: x.v <= (low + high) / 2), lambda x: x.v * x.n)) / list_sum(list_transform(list_filter(xs, lambda x: x.v <= (low + high) / 2), lambda x: x.n)), low) AS a,
    coalesce(list_sum(list_transform(list_filter(xs, lambda x: x.v > (low + high) / 2), lambda x: x.v * x.n)) / list_sum(list_transform(list_filter(xs, lambda x: x.v > (low + high) / 2), lambda x: x.n)), high) AS b FROM m, xs WHERE i < 50 AND NOT done)),
  t AS (SELECT CASE WHEN n >= 4 AND m.high - m.low >= 180 AND m.high >= 150 THEN (m.low + m.high) / 2 ELSE 800 END AS threshold FROM m, q QUALIFY row_number() OVER (ORDER BY i DESC) = 1),
  g AS (SELECT *, sum(CASE WHEN first_s - p > 90000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY first_s, event_id) AS gr, sum(CASE WHEN first_s - p > 40000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY first_s, event_id) AS part FROM (SELECT *, lag(first_s) OVER (PARTITION BY entity ORDER BY first_s, event_id) AS p FROM tl)),
  s AS (SELECT *, quantile_cont(CAST(conf AS DOUBLE), 0.5) OVER (PARTITION BY entity, gr ORDER BY first_s, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smoothed FROM g),
  c AS (SELECT s.*, smoothed >= threshold AS closed FROM s, t), r AS (SELECT *, sum(CASE WHEN closed THEN 0 ELSE 1 END) OVER (PARTITION BY entity, part ORDER BY first_s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
  SELECT entity, event_id, CAST(gr AS BIGINT) AS group_no, CAST(round_even(smoothed * 1000, 0) AS BIGINT) AS smoothed, closed, CASE WHEN closed THEN count(*) FILTER (WHERE closed) OVER (PARTITION BY entity, part, run) ELSE 0 END AS persistence FROM r""")
def _(spark, d):
    rows = tl(spark, d).select("entity", "event_id", "first_s", "conf")
    rounds = [rows.where(F.col("event_id") % 3 == k) for k in range(3)]
    fused = clusters.fused_rounds(rounds, "conf", "first_s", gap=90000, persist_gap=40000, fallback=800, apart=180, least_high=150)
    return fused.select("entity", "event_id", "group_no", F.rint(F.col("smoothed") * 1000).cast("long").alias("smoothed"), "closed", "persistence")


# ---- requests

#: Scores are counts of thousandths, so that sums of bonuses are exact in both engines.
@query("diverse_picks", f"""WITH RECURSIVE {TL}, c AS (SELECT entity, event_id, conf, CASE WHEN event_id % 5 = 0 THEN [] WHEN event_id % 5 = 1 THEN ['t' || event_id % 7] ELSE list_sort(list_distinct(['t' || event_id % 7, 't' || event_id % 4])) END AS tracks, action AS source, first_s FROM tl),
  l AS (SELECT entity, list({{'id': event_id, 's': conf, 't': tracks, 'a': source, 'f': first_s}}) AS m FROM c GROUP BY entity),
  r(entity, pick, id, seen, had, ids) AS (SELECT entity, 0, CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]) FROM l
  UNION ALL SELECT entity, pick + 1, -b.i, list_concat(seen, b.t), list_append(had, b.a), list_append(ids, -b.i) FROM (SELECT r.*, list_max(list_transform(list_filter(m, lambda x: NOT list_contains(r.ids, x.id)),
    lambda x: {{'s': x.s + CASE WHEN len(x.t) = 0 OR len(list_filter(x.t, lambda y: NOT list_contains(r.seen, y))) > 0 THEN 180 ELSE 0 END + CASE WHEN list_contains(r.had, x.a) THEN 0 ELSE 80 END, 'f': -x.f, 'i': -x.id, 't': x.t, 'a': x.a}})) AS b FROM r JOIN l USING (entity) WHERE pick < 4) WHERE b IS NOT NULL)
  SELECT r.entity, pick, id AS event_id, conf FROM r JOIN c ON c.event_id = id WHERE pick > 0""")
def _(spark, d):
    e = F.col("event_id")
    one = F.concat(F.lit("t"), (e % 7).cast("string"))
    tracks = F.when(e % 5 == 0, F.array().cast("array<string>")).when(e % 5 == 1, F.array(one)).otherwise(F.array(one, F.concat(F.lit("t"), (e % 4).cast("string"))))
    rows = tl(spark, d).withColumn("tracks", tracks)
    picks = requests.diverse_picks(rows, ["entity"], "event_id", "conf", "tracks", "action", [F.col("first_s")], limit=4, new_track=180, new_source=80)
    return picks.select("entity", "pick", "event_id", "conf")


PLAN = f"""{TL}, a AS (SELECT entity, first_s AS at, row_number() OVER (PARTITION BY entity ORDER BY conf DESC, first_s, event_id) AS rank, first_s // 3600 * 3600 AS h FROM tl QUALIFY rank <= 6),
  n AS (SELECT entity, list(DISTINCT first_s // 3600 * 3600) AS known FROM tl GROUP BY entity)"""


@query("request_plan", f"""WITH RECURSIVE {PLAN}, r(entity, k, budget, made, taken, w) AS (SELECT entity, CAST(0 AS BIGINT), CAST(14 AS BIGINT), 0, CAST([] AS BIGINT[]), {{'new': CAST(0 AS BIGINT), 'rows': CAST(0 AS BIGINT), 'near': CAST(0 AS BIGINT), 'early': CAST(0 AS BIGINT), 'f': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT)}} FROM n
  UNION ALL SELECT entity, k, CASE WHEN w IS NULL THEN budget ELSE budget - w.new END, CASE WHEN w IS NULL THEN made ELSE made + 1 END, CASE WHEN w IS NULL THEN taken ELSE list_concat(taken, range(w.f, w.t + 1, 3600)) END, w FROM (
    SELECT r.entity, a.rank AS k, budget, made, taken, CASE WHEN made < 3 AND budget > 0 THEN list_max(list_filter(list_transform(list_filter(flatten(list_transform(range(h - 21600, h + 21601, 3600), lambda f: list_transform(range(f, h + 21601, 3600), lambda t: {{'f': f, 't': t}}))), lambda p: NOT list_has_any(range(p.f, p.t + 1, 3600), r.taken)),
      lambda p: {{'new': CAST(len(list_filter(range(p.f, p.t + 1, 3600), lambda x: NOT list_contains(n.known, x))) AS BIGINT), 'rows': CAST(len(range(p.f, p.t + 1, 3600)) AS BIGINT), 'near': -abs(p.f + p.t - 2 * a.at), 'early': -p.f, 'f': p.f, 't': p.t}}), lambda c: c.new > 0 AND c.new <= r.budget)) END AS w
    FROM r JOIN a ON a.entity = r.entity AND a.rank = r.k + 1 JOIN n ON n.entity = r.entity))
  SELECT entity, made AS request, CAST(k AS INTEGER) AS rank, w.f AS "from", w.t AS "to", w.rows AS rows, w.new AS "new" FROM r WHERE k > 0 AND w IS NOT NULL""")
def _(spark, d):
    rows = tl(spark, d)
    hour = F.floor(F.col("first_s") / 3600) * 3600
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("conf").desc(), "first_s", "event_id"))
    anchors = rows.withColumn("rank", rank).where("rank <= 6").select("entity", "rank", F.col("first_s").alias("at"), (hour - 21600).alias("low"), (hour + 21600).alias("high"))
    return requests.request_plan(anchors, rows.select("entity", hour.alias("at")), step=3600, budget=14)


@query("checked_requests", f"""WITH {RUNS}, q AS (SELECT entity, event_id, first_s, conf, unnest(generate_series(0, CAST(conf % 5 AS BIGINT) - 1)) AS j FROM tl), e AS (SELECT *, first_s + j * 700 - CASE WHEN event_id % 17 = 0 THEN 3000000 ELSE 0 END AS s FROM q),
  f AS (SELECT *, s + 100 * (event_id % 6) AS t FROM e), x AS (SELECT *, CASE WHEN NOT (0 <= s AND s < t AND t <= 2592000) THEN 'outside_video' WHEN t - s > 400 THEN 'too_long' WHEN NOT EXISTS (SELECT 1 FROM runs WHERE runs.entity = f.entity AND s >= greatest(0, runs.first_s - 200) AND t <= least(2592000, runs.last_s + 200)) THEN 'outside_stages' END AS err FROM f),
  g AS (SELECT event_id, first(err ORDER BY j) FILTER (WHERE err IS NOT NULL) AS err, sum(t - s) AS total, count(*) AS n FROM x GROUP BY event_id)
  SELECT tl.entity, tl.event_id, CASE WHEN coalesce(n, 0) NOT BETWEEN 1 AND 3 THEN 'number_of_ranges' WHEN err IS NOT NULL THEN err WHEN total > 800 THEN 'too_long_together' END AS error FROM tl LEFT JOIN g USING (event_id)""")
def _(spark, d):
    ranges = F.expr("transform(filter(sequence(0L, 4L), j -> j < conf % 5), j -> named_struct('start', first_s + j * 700 - if(event_id % 17 = 0, 3000000, 0), 'end', first_s + j * 700 - if(event_id % 17 = 0, 3000000, 0) + 100 * (event_id % 6)))")
    asked = tl(spark, d).select("entity", "event_id", ranges.alias("ranges"), F.lit(2592000).alias("duration"))
    stages = runs(spark, d).select("entity", F.col("first_s").alias("start"), F.col("last_s").alias("end"))
    return requests.checked_requests(asked, stages, "event_id", longest=400, total=800, slack=200).select("entity", "event_id", "error")


# ---- nested values

NOTE = "CASE turn % 4 WHEN 0 THEN 'Bearer abcdefgh' || conv_id WHEN 1 THEN 'plain ' || turn WHEN 2 THEN 'key sk-12345678' || turn || ' end' ELSE 'bearer short' END"


def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document a conversation: its turns in order, with secrets in keys, under keys and in texts, at several depths."""
    note = F.expr("case turn % 4 when 0 then concat('Bearer abcdefgh', conv_id) when 1 then concat('plain ', turn) when 2 then concat('key sk-12345678', turn, ' end') else 'bearer short' end")
    token = F.when(F.col("turn") % 3 == 0, F.struct(F.lit("deep").alias("a"), F.array(F.col("turn")).alias("b")))
    turn = F.struct("turn", "role", F.struct(note.alias("note"), token.alias("Auth_Token"), F.array(F.array("turn", F.length("text")), F.array(F.length("text"))).alias("sizes")).alias("meta"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    body = F.to_json(F.struct(F.col("conv_id").alias("id"), F.lit("x").alias("api_key"), F.col("turns").alias("video_7"), F.struct(F.lit(1).alias("fixed_roi"), F.array(F.struct(F.lit(2).alias("video_12_left"))).alias("list")).alias("workflow")), {"ignoreNullFields": "false"})
    return rows.select("conv_id", F.parse_json(body).alias("root"))


@query("redacted_documents", """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, CASE turn % 4 WHEN 0 THEN '<redacted>' WHEN 1 THEN 'plain ' || turn WHEN 2 THEN 'key <redacted> end' ELSE 'bearer short' END AS note FROM conversations)
  SELECT conv_id AS id, '{"api_key":"<redacted>","id":' || conv_id || ',"video_7":[' || string_agg('{"meta":{"Auth_Token":"<redacted>","note":"' || note || '","sizes":[[' || turn || ',' || n || '],[' || n || ']]},"role":"' || role || '","turn":' || turn || '}', ',' ORDER BY turn, role, note) || '],"workflow":{"fixed_roi":1,"list":[{"video_12_left":2}]}}' AS body FROM t GROUP BY conv_id""")
def _(spark, d):
    return nested.redacted_documents(nested_documents(spark, d), "conv_id", "root")


@query("forbidden_paths", "SELECT DISTINCT conv_id AS id, unnest(['root.video_7', 'root.workflow.fixed_roi', 'root.workflow.list.0.video_12_left']) AS path FROM conversations")
def _(spark, d):
    return nested.forbidden_paths(nested_documents(spark, d), "conv_id", "root", ["fixed_roi", "fixed_video_roi"], root="root")


# ---- closure and producers

LINKS = """l AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey)"""


@query("reachable_producers", f"""WITH RECURSIVE {LINKS}, r(start, node, steps) AS (SELECT DISTINCT a, a, 0 FROM l WHERE a LIKE 'c%' UNION SELECT r.start, l.b, r.steps + 1 FROM r JOIN l ON r.node = l.a WHERE r.steps < 6)
  SELECT start, node, min(steps) AS steps FROM r GROUP BY start, node""")
def _(spark, d):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    link = lambda t, a, b: table(spark, d, t).select(a.alias("a"), b.alias("b"))
    links = link("orders", name("o", "o_orderkey"), name("c", "o_custkey")).unionByName(link("customer", name("c", "c_custkey"), name("n", "c_nationkey"))).unionByName(link("nation", name("n", "n_nationkey"), name("r", "n_regionkey")))
    back = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n")).select(name("r", "n_regionkey").alias("a"), name("n", "n").alias("b"))  # a cycle
    links = links.unionByName(back)
    return graph.reachable(links, links.where("a like 'c%'").select(F.col("a").alias("start")))


@query("producer_plan", """WITH p AS (SELECT l_suppkey AS tool, l_partkey AS produced, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL), w AS (SELECT p_partkey FROM part WHERE p_size >= 48),
  t AS (SELECT tool, min(pos) AS pos FROM p GROUP BY tool), n AS (SELECT DISTINCT tool FROM p JOIN w ON produced = p_partkey)
  SELECT tool, row_number() OVER (ORDER BY t.pos, tool) AS call_no, count(*) AS products, count(*) FILTER (WHERE produced IN (SELECT p_partkey FROM w)) AS wanted, min(produced) AS first_product FROM p JOIN n USING (tool) JOIN (SELECT tool, pos FROM t) t USING (tool) GROUP BY tool, t.pos""")
def _(spark, d):
    made = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tool"), F.col("l_partkey").alias("produced"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    wanted = table(spark, d, "part").where("p_size >= 48").select(F.col("p_partkey").alias("produced"))
    return graph.producer_plan(made, wanted)


# ---- artifacts and the gate

#: One JSON artifact an event: its type by event_id % 9 (the ninth is unknown), its faults by k = event_id div 9.
ARTIFACT = """case e % 9
  when 0 then concat('{"source_video":', if(k % 11 = 0, 'null', '"v"'), ',"frames":', if(k % 7 = 0, '5', concat('[{"timestamp_seconds":1,"output_path":"a"},{', if(k % 3 = 0, '', '"frame_path":"b",'), '"timestamp_seconds":', if(k % 5 = 0, 'null', '2'), '}', if(k % 13 = 0, ',7', ''), ']')), '}')
  when 1 then concat('{"rubric_id":1,"source_video":"v","review_method":"m","candidate_reviews":', if(k % 7 = 0, '{}', concat('[{"timestamp_seconds":1,"frame_path":"f","usable_for_qwen_evidence":true,"switch_visibility":"', if(k % 3 = 0, 'odd', 'full'), '"}', if(k % 4 = 0, ',[]', ''), ']')), '}')
  when 2 then concat('{"frames":[{"devices":{"voltmeter":{"status":"full","bbox":', if(k % 3 = 0, '[1,2,3]', '[1,2,3,4]'), '},"ammeter":', if(k % 5 = 0, '4', '{"status":"partial","bbox":[1,2,3,4.5]}'), ',"switch":{"status":"', if(k % 7 = 0, 'gone', 'not_visible'), '"', if(k % 4 = 0, ',"enhanced_crop":"c"', ''), '}}}]}')
  when 3 then concat('{"json_parsed":', if(k % 5 = 0, '"yes"', 'true'), ',"safety_valid":', if(k % 2 = 0, 'true', 'false'), ',"validation_errors":', if(k % 3 = 0, '["e"]', '[]'), if(k % 7 = 0, '', concat(',"structured_result":{', if(k % 11 = 0, '"score":1', ''), '}')), '}')
  when 4 then concat('{"rubric_id":1,"source_video":"v","automated_decision":"', case k % 4 when 0 then 'yes' when 1 then 'abstained' when 2 then 'perhaps' else 'no' end, '","automated_outcome":"', if(k % 3 = 0, 'abstained', 'scored'), '","predicted_score":', case k % 5 when 0 then '0' when 1 then '1' when 2 then 'null' when 3 then '2' else '1' end, if(k % 2 = 0, ',"abstention_reason":"r"', ''), '}')
  when 5 then concat('{"rubric_id":1,"source_video":"v","automated_decision":"no","automated_outcome":"scored","predicted_score":1', if(k % 2 = 0, ',"circuit_closed_evidence":{}', ''), '}')
  when 6 then concat('{"prediction_package_path":"p","prediction_package_sha256":"', if(k % 3 = 0, 'abc', repeat('aB', 32)), '","prediction_frozen_before_ground_truth":', if(k % 2 = 0, 'true', 'false'), '}')
  when 7 then concat('{"rubric_id":1,"status":"', if(k % 5 = 0, 'open', 'blocked_waiting_for_data'), '","required_new_data":', if(k % 3 = 0, '[]', '[1]'), ',"prohibited_actions":["a"],"frozen_artifacts":[{"path":"p"', if(k % 7 = 0, '', concat(',"sha256":"', if(k % 2 = 0, 'zz', repeat('0f', 32)), '"')), '}]}')
  else case k % 3 when 0 then '{broken' when 1 then '[1]' else '{"a":1}' end end"""
TYPES = ["frame_manifest", "evidence_availability_review", "dynamic_roi_results", "qwen_structured_result", "evidence_package", "prediction_package", "offline_evaluation", "validation_gate", "something_else"]


def artifact_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").selectExpr("event_id", "event_id as e", "event_id div 9 as k")
    return rows.select("event_id", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("e") % 9 + 1).cast("int")).alias("type"), F.expr(ARTIFACT).alias("body"))


FAULTS = """x AS (SELECT event_id, event_id % 9 AS t, event_id // 9 AS k FROM events), f AS (SELECT event_id, t, list_filter([
  CASE WHEN t = 8 AND k % 3 = 0 THEN 'JSON_PARSE_ERROR' END, CASE WHEN t = 8 AND k % 3 = 1 THEN 'INVALID_ROOT_TYPE' END, CASE WHEN t = 8 AND k % 3 = 2 THEN 'UNKNOWN_ARTIFACT_TYPE' END,
  CASE WHEN t = 0 AND (k % 11 = 0 OR (k % 7 <> 0 AND k % 5 = 0)) THEN 'MISSING_REQUIRED_FIELD' END, CASE WHEN t = 0 AND k % 7 = 0 THEN 'INVALID_FRAMES' END, CASE WHEN t = 0 AND k % 7 <> 0 AND k % 13 = 0 THEN 'INVALID_FRAME_RECORD' END, CASE WHEN t = 0 AND k % 7 <> 0 AND k % 3 = 0 THEN 'MISSING_FRAME_OUTPUT_PATH' END,
  CASE WHEN t = 1 AND k % 7 = 0 THEN 'INVALID_CANDIDATE_REVIEWS' END, CASE WHEN t = 1 AND k % 7 <> 0 AND k % 4 = 0 THEN 'INVALID_CANDIDATE_REVIEW' END, CASE WHEN t = 1 AND k % 7 <> 0 AND k % 3 = 0 THEN 'INVALID_ROI_STATUS' END, CASE WHEN t = 2 AND k % 7 = 0 THEN 'INVALID_ROI_STATUS' END,
  CASE WHEN t = 2 AND k % 5 = 0 THEN 'MISSING_DEVICE_RESULT' END, CASE WHEN t = 2 AND k % 7 <> 0 AND k % 4 = 0 THEN 'CROP_PRESENT_FOR_NOT_VISIBLE' END, CASE WHEN t = 2 AND k % 3 = 0 THEN 'MISSING_OR_INVALID_BBOX' END,
  CASE WHEN t = 3 AND k % 5 = 0 THEN 'INVALID_JSON_PARSED' END, CASE WHEN t = 3 AND k % 5 <> 0 AND k % 7 = 0 THEN 'MISSING_STRUCTURED_RESULT' END, CASE WHEN t = 3 AND k % 2 = 0 AND k % 3 = 0 THEN 'SAFETY_VALID_WITH_ERRORS' END, CASE WHEN t = 3 AND k % 7 <> 0 AND k % 11 = 0 THEN 'FORBIDDEN_QWEN_SCORING_FIELD' END,
  CASE WHEN t = 4 AND k % 4 = 2 THEN 'INVALID_DECISION' END, CASE WHEN t = 4 AND k % 4 = 1 AND k % 5 <> 2 THEN 'ABSTAINED_WITH_SCORE' END, CASE WHEN t = 4 AND k % 3 = 0 AND k % 2 = 1 THEN 'ABSTENTION_REASON_MISSING' END, CASE WHEN t = 4 AND k % 3 <> 0 AND k % 5 IN (2, 3) THEN 'SCORED_OUTCOME_INVALID_SCORE' END,
  CASE WHEN t = 4 AND (k % 4 = 1) <> (k % 3 = 0) THEN 'DECISION_OUTCOME_MISMATCH' END, CASE WHEN t = 5 AND k % 2 = 1 THEN 'MISSING_CIRCUIT_EVIDENCE' END, CASE WHEN t = 6 AND k % 3 = 0 THEN 'INVALID_PREDICTION_SHA256' END, CASE WHEN t = 6 AND k % 2 = 1 THEN 'PREDICTION_NOT_FROZEN_BEFORE_GROUND_TRUTH' END,
  CASE WHEN t = 7 AND k % 5 <> 0 AND k % 3 = 0 THEN 'MISSING_BLOCKED_GATE_REQUIREMENT' END, CASE WHEN t = 7 AND k % 5 <> 0 AND k % 7 = 0 THEN 'INVALID_FROZEN_ARTIFACT' END, CASE WHEN t = 7 AND k % 5 <> 0 AND k % 7 <> 0 AND k % 2 = 0 THEN 'INVALID_FROZEN_ARTIFACT_SHA256' END],
  lambda c: c IS NOT NULL) AS errors FROM x)"""


@query("artifact_errors", f"WITH {FAULTS} SELECT event_id, unnest(errors) AS error FROM f")
def _(spark, d):
    return gate.checked_artifacts(artifact_rows(spark, d), "type", "body").select("event_id", F.explode("errors").alias("error"))


@query("validation_gate", f"""WITH {FAULTS} SELECT t AS type_no, count(*) AS rows, count(*) FILTER (WHERE len(errors) > 0) AS wrong, 2 * count(*) FILTER (WHERE len(errors) > 0) <= count(*) AS opened, CASE WHEN 2 * count(*) FILTER (WHERE len(errors) > 0) <= count(*) THEN count(*) ELSE 0 END AS visible FROM f GROUP BY t""")
def _(spark, d):
    path, out = folder(spark, "gate"), []
    rows = gate.checked_artifacts(artifact_rows(spark, d), "type", "body")
    for i, kind in enumerate(TYPES):  # nine writes, each opened by its own counts
        opened, counts = gate.gated_write(rows.where(F.col("type") == kind), path, kind, most=0.5)
        seen = spark.read.parquet(f"{path}/{kind}") if opened else rows.where("false")
        out.append(seen.select("event_id").agg(F.count(F.lit(1)).alias("visible")).select(F.lit(i).alias("type_no"), F.lit(counts["rows"]).alias("rows"), F.lit(counts["wrong"]).alias("wrong"), F.lit(opened).alias("opened"), "visible"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.where("rows > 0")
