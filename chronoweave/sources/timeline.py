"""Sources and sinks of timelines: the events adapter, JSON artifacts, no-overwrite runs, tables as text, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import written

ACTIONS = {"click": "wiring", "view": "measurement", "purchase": "writing", "signup": "cleanup", "error": "uncertain"}
START = "2024-01-01 00:00:00"


def timeline(events: DataFrame) -> DataFrame:
    """events to interval facts: event_id, entity, action, first_s, last_s (whole seconds), conf (thousandths)."""
    action = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))[F.col("event_type")]
    first = F.expr(f"timestampdiff(SECOND, timestamp_ntz'{START}', ts)")
    return events.select("event_id", F.col("user_id").alias("entity"), action.alias("action"), first.alias("first_s"), (first + F.floor(F.col("value") * 600)).alias("last_s"), F.least(F.lit(1000), F.floor(F.col("value") * 2)).cast("long").alias("conf"))


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object per file, with the file's name; a leading byte-order mark is ignored, broken files have null fields."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("body"))
    if schema:
        return text.select("path", F.from_json("body", schema).alias("root"))
    return text.select("path", F.try_parse_json("body").alias("root"))


def nodes(documents: DataFrame):
    """The objects and arrays of VARIANT documents (path, root), level by level, to whatever depth they have.

    Each level is written, so that documents are read and parsed once and a level is one pass over the last.
    """
    level = written(documents.select("path", F.col("root").alias("node")), "levels")
    while not level.isEmpty():
        yield level
        level = written(level.selectExpr("path", "explode(concat(coalesce(try_cast(node as array<variant>), array()), coalesce(map_values(try_cast(node as map<string, variant>)), array()))) as node").where("schema_of_variant(node) like 'OBJECT<%' or schema_of_variant(node) like 'ARRAY<%'"), "levels")


def nested_runs(documents: DataFrame) -> DataFrame:
    """Every object {stage, start_seconds, end_seconds} at any depth of VARIANT documents.

    Of equal (stage, start, end) in a document, the one with the most fields stays, as JSON in `node`.
    """
    found = None
    for level in nodes(documents):
        here = level.select("path", F.expr("try_variant_get(node, '$.stage', 'string')").alias("stage"), F.expr("try_variant_get(node, '$.start_seconds', 'double')").alias("start_s"), F.expr("try_variant_get(node, '$.end_seconds', 'double')").alias("end_s"), F.expr("size(try_cast(node as map<string, variant>))").alias("fields"), F.to_json("node").alias("node"))
        here = here.where("stage is not null and start_s is not null and end_s is not null")
        found = here if found is None else found.unionByName(here)
    if found is None:
        return documents.sparkSession.createDataFrame([], "path string, stage string, start_s double, end_s double, fields int, node string")
    return found.groupBy("path", "stage", "start_s", "end_s").agg(F.max("fields").alias("fields"), F.max_by("node", F.struct("fields", "node")).alias("node"))


def nested_numbers(documents: DataFrame, field: str = "frame_number") -> DataFrame:
    """path and every distinct whole number that a field of that name has, at any depth."""
    found = None
    for level in nodes(documents):
        here = level.select("path", F.expr(f"try_variant_get(node, '$.{field}', 'bigint')").alias("number")).where("number is not null")
        found = here if found is None else found.unionByName(here)
    return documents.sparkSession.createDataFrame([], "path string, number long") if found is None else found.distinct()


def media_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("mp4", "mov", "avi", "mkv", "webm"), content: bool = False) -> DataFrame:
    """path, length and modification time of media files under a folder, by suffix; contents are not read, unless `content` asks for them too.

    Spark reckons each file as some MB to open, so that a task would read few; here tasks are no more than shuffle partitions.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "length", "modificationTime", *(["content"] if content else [])).where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))


def write_files(rows: DataFrame, path: str, keys: list[str]) -> None:
    """A text file of each row's `value`, in a folder of its keys.

    A file costs the same however small: rows are dealt by number, as they would else be joined to one task, and tasks
    put their own files in place, where the driver would else move one after the other.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*keys).text(path)


def write_run(rows: DataFrame, path: str) -> None:
    """Write a run's rows; an existing run is never overwritten."""
    rows.write.mode("errorifexists").parquet(path)


def manifest(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """path, bytes and SHA-256 of binary files, and what else of them is to be kept."""
    return files.select("path", F.length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"), *keep)


def table_lines(rows: DataFrame, order: Column | str, columns: list[str]) -> DataFrame:
    """A markdown table as ordered lines of text (n, line); null cells are empty."""
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "n long, line string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    from pyspark.sql import Window

    return head.unionByName(rows.select((F.row_number().over(Window.orderBy(order)) + 1).cast("long").alias("n"), cells.alias("line")))
