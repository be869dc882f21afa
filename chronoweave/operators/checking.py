"""Contracts: rows get an array of error codes instead of being dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages that may follow a stage.
NEXT = {
    "wiring": ("measurement", "writing", "cleanup", "uncertain"),
    "measurement": ("writing", "wiring", "cleanup", "uncertain"),
    "writing": ("measurement", "wiring", "cleanup", "uncertain"),
    "uncertain": ("wiring", "measurement", "writing", "cleanup"),
    "cleanup": (),
}


def errors(rows: DataFrame, checks: dict[str, Column], name: str = "errors") -> DataFrame:
    """Add the codes of all checks that don't hold; an unknown outcome is an error."""
    return rows.withColumn(name, F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()))))


def first_error(checks: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks.items()))


def illegal_transitions(runs: DataFrame, allowed: dict[str, tuple[str, ...]] = NEXT) -> DataFrame:
    """Runs whose stage may not follow the one before."""
    legal = F.create_map(*(x for a, b in allowed.items() for x in (F.lit(a), F.array(*map(F.lit, b)) if b else F.array().cast("array<string>"))))
    w = Window.partitionBy("entity").orderBy("run_no")
    rows = runs.withColumn("previous", F.lag("stage").over(w)).where("previous is not null and previous <> stage")
    return rows.where(~F.coalesce(F.array_contains(legal[F.col("previous")], F.col("stage")), F.lit(False))).select("entity", "run_no", "previous", "stage")


def missing_members(rows: DataFrame, key: str, member: str, wanted: list[str]) -> DataFrame:
    """The wanted members that a key lacks."""
    have = rows.groupBy(key).agg(F.collect_set(member).alias("_have"))
    return have.select(key, F.explode(F.array_except(F.array(*map(F.lit, wanted)), "_have")).alias("missing"))


def resumed(rows: DataFrame, terminal: str = "cleanup", least_rows: int = 2, least_kinds: int = 2, least_span: int = 20) -> DataFrame:
    """Entities that go on after their first terminal action: enough rows, kinds and time."""
    stop = F.min(F.when(F.col("action") == terminal, F.col("first_s"))).over(Window.partitionBy("entity"))
    later = rows.withColumn("_stop", stop).where(F.col("first_s") > F.col("_stop")).where(~F.col("action").isin(terminal, "uncertain"))
    later = later.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("action").alias("kinds"), (F.max("last_s") - F.min("first_s")).alias("span_s"))
    return later.where((F.col("rows") >= least_rows) & (F.col("kinds") >= least_kinds) & (F.col("span_s") >= least_span))
