"""Sources, sinks and texts as named queries: what is written to the shared folder from the test tables and read back, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.operators import matching
from chronoweave.plans.queries import RUNS, TL, runs, tl
from chronoweave.plans.registry import query
from chronoweave.plans.structure_queries import folder
from chronoweave.session import table
from chronoweave.sources import timeline as S


def documents(spark: SparkSession, d: str) -> DataFrame:
    """A JSON document an entity, with its runs at two depths, some of them twice, written as files and read back."""
    path = folder(spark, "documents")
    run = F.struct("stage", F.col("first_s").cast("double").alias("start_seconds"), F.col("last_s").cast("double").alias("end_seconds"), F.when(F.col("run_no") % 3 == 0, F.col("run_no")).alias("frame_number"))
    lists = runs(spark, d).groupBy("entity").agg(F.collect_list(run).alias("runs"))
    short = F.transform("runs", lambda r: F.struct(r["stage"].alias("stage"), r["start_seconds"].alias("start_seconds"), r["end_seconds"].alias("end_seconds")))
    body = F.to_json(F.struct("entity", F.struct(F.struct("runs").alias("inner")).alias("result"), short.alias("again"), F.array(F.array(F.struct((F.col("entity") + 100000).alias("frame_number")))).alias("deep")))
    mark = F.when(F.col("entity") % 2 == 0, F.lit("﻿")).otherwise(F.lit(""))
    lists.select("entity", F.concat(mark, body).alias("value")).write.partitionBy("entity").text(path)
    files = S.read_documents(spark, f"{path}/*/*.txt")
    return files.withColumn("path", F.regexp_extract("path", r"entity=(\d+)", 1))


@query("nested_runs", f"""WITH {RUNS}, r AS (SELECT entity, stage, first_s, last_s, max(CASE WHEN run_no % 3 = 0 THEN 4 ELSE 3 END) AS fields FROM runs GROUP BY ALL) SELECT entity, stage, CAST(first_s AS DOUBLE) AS start_s, CAST(last_s AS DOUBLE) AS end_s, fields FROM r""")
def _(spark, d):
    return S.nested_runs(documents(spark, d)).select(F.col("path").cast("long").alias("entity"), "stage", "start_s", "end_s", "fields")


@query("nested_numbers", f"""WITH {RUNS} SELECT DISTINCT entity, run_no AS number FROM runs WHERE run_no % 3 = 0 UNION SELECT DISTINCT entity, entity + 100000 FROM runs""")
def _(spark, d):
    return S.nested_numbers(documents(spark, d)).select(F.col("path").cast("long").alias("entity"), "number")


@query("media_manifest", """WITH c AS (SELECT conv_id, 'clip ' || count(*) || ' ' || sum(turn) AS body FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id) SELECT conv_id, CAST(strlen(body) + 1 AS BIGINT) AS length, sha256(body || chr(10)) AS sha256 FROM c WHERE conv_id % 2 = 0""")
def _(spark, d):
    path = folder(spark, "media")
    bodies = table(spark, d, "conversations").where("conv_id is not null").groupBy("conv_id").agg(F.concat(F.lit("clip "), F.count(F.lit(1)), F.lit(" "), F.sum("turn")).alias("value"))
    S.write_files(bodies.withColumn("kind", F.when(F.col("conv_id") % 2 == 0, "mp4").otherwise("txt")), path, ["kind", "conv_id"])
    # Spark names its own files .txt; those that are asked for are the ones under the folder of the suffix
    known = S.manifest(S.media_files(spark, f"{path}/kind=mp4", ("txt",), content=True), keep=("length",))
    return known.select(F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), "length", "sha256")


@query("markdown_table", """WITH e AS (SELECT event_type, count(*) AS n, CASE WHEN event_type <> 'view' THEN max(event_id) END AS last FROM events GROUP BY event_type) SELECT CAST(0 AS BIGINT) AS n, '| event_type | n | last |' AS line UNION ALL SELECT 1, '|---|---|---|'
  UNION ALL SELECT row_number() OVER (ORDER BY event_type) + 1, '| ' || event_type || ' | ' || n || ' | ' || coalesce(CAST(last AS VARCHAR), '') || ' |' FROM e""")
def _(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last")).withColumn("last", F.when(F.col("event_type") != "view", F.col("last")))
    return S.table_lines(rows, "event_type", ["event_type", "n", "last"])


@query("first_decimals", """SELECT event_id, CAST(nullif(regexp_extract(CASE event_id % 4 WHEN 0 THEN 'U = ' || value || ' V, ' || event_id WHEN 1 THEN '-' || (event_id % 100) || ',5 A' WHEN 2 THEN 'no reading' ELSE '+' || event_id END, '[-+]?[0-9]+([.,][0-9]+)?'), '') IS NOT NULL AS BOOLEAN) AS found,
  CASE event_id % 4 WHEN 0 THEN CAST(round_even(value * 1000, 0) AS BIGINT) WHEN 1 THEN -(event_id % 100) * 1000 - 500 WHEN 3 THEN event_id * 1000 END AS thousandths FROM events""")
def _(spark, d):
    e = F.col("event_id")
    said = F.when(e % 4 == 0, F.concat(F.lit("U = "), F.format_string("%.12f", "value"), F.lit(" V, "), e)).when(e % 4 == 1, F.concat(F.lit("-"), e % 100, F.lit(",5 A"))).when(e % 4 == 2, "no reading").otherwise(F.concat(F.lit("+"), e))
    value = X.first_decimal(said)
    return table(spark, d, "events").select("event_id", value.isNotNull().alias("found"), F.rint(value * 1000).cast("long").alias("thousandths"))


WORDS = ["the switch is closed", "the switch is not closed", "no one saw that it is closed", "open, then CLOSED again", "without a doubt, though from far away, it is closed"]


@query("mentioned_words", "SELECT event_id, event_id % 5 <> 1 AS closed FROM events")
def _(spark, d):
    said = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.mentions(said, "closed").alias("closed"))


@query("known_rows_removed", f"WITH {TL} SELECT entity, first_s // 3600 AS frame, event_id FROM tl WHERE NOT EXISTS (SELECT 1 FROM tl k WHERE k.conf >= 300 AND k.entity = tl.entity AND k.first_s // 3600 = tl.first_s // 3600)")
def _(spark, d):
    rows = tl(spark, d).withColumn("frame", F.floor(F.col("first_s") / 3600))
    return matching.known_rows_removed(rows, rows.where("conf >= 300").select("entity", "frame"), ["entity", "frame"]).select("entity", "frame", "event_id")
