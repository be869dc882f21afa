"""Rows against what they should be: full coverage of keys, contracts with error codes, whole runs of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(known: DataFrame, given: DataFrame, key: str, order: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Every known key with the first row given for it, or defaults; `error` says what is missing."""
    first = given.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1")
    out = known.join(first.withColumn("_there", F.lit(True)), key, "left")
    return out.select(*known.columns, *(F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()), F.when(F.col("_there").isNull(), "missing").alias("error"))


def rejected(known: DataFrame, given: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows given for no known key, or after the first for one."""
    rows = given.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    return rows.where("_known is null or _k > 1").withColumn("reason", F.when(F.col("_known").isNull(), "unknown").otherwise("duplicate")).drop("_k", "_known")


def first_reason(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row with the first reason whose rule it breaks; null where it keeps them all."""
    return rows.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items())))


def run_errors(wanted: DataFrame, results: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Of every wanted result the first thing wrong with it, `missing` if there is none; those without fault don't appear."""
    rows = first_reason(wanted.join(results.withColumn("_there", F.lit(True)), keys, "left"), {"missing": F.col("_there").isNotNull(), **rules})
    return rows.where("reason is not null").select(*keys, "reason")


def either(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first table's rows, and the second's for keys that the first hasn't."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of every key the row that comes last."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))).where("_k = 1").drop("_k")


def oversized(rois: DataFrame, most: float = 0.8) -> DataFrame:
    """Regions (x0, y0, x1, y1 as shares of the frame) that cover more than `most` of it, each once."""
    return rois.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > most).select("entity", "roi").distinct()


def redundant(rois: DataFrame, least: float = 0.95) -> DataFrame:
    """Regions nearly as wide and as high as the frame."""
    return rois.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least)).select("entity", "roi").distinct()


def bound_identities(observations: DataFrame, candidates: DataFrame, frame: list[str]) -> DataFrame:
    """Observed identities with a candidate of their frame: the one named, else the only one of that identity; conflicting ones share a candidate."""
    only = candidates.groupBy(*frame, "identity").agg(F.count(F.lit(1)).alias("_n"), F.min("candidate").alias("_only"))
    named = candidates.select(*frame, F.col("candidate").alias("ref"), F.lit(True).alias("_named"))
    rows = observations.join(named, [*frame, "ref"], "left").join(only, [*frame, "identity"], "left")
    rows = rows.withColumn("candidate", F.when(F.col("_named"), F.col("ref")).when(F.col("ref").isNull() & (F.col("_n") == 1), F.col("_only")))
    w = Window.partitionBy(*frame, "candidate")
    clash = F.col("candidate").isNotNull() & (F.min("identity").over(w) != F.max("identity").over(w))
    return rows.withColumn("status", F.when(F.col("candidate").isNull(), "unsupported").when(clash, "conflicting").otherwise("bound")).drop("_named", "_n", "_only")


def resolved(wanted: DataFrame, videos: DataFrame) -> DataFrame:
    """wanted (name) to the one video of that name, else to the only one of that stem; error where neither is unique. videos: name, path."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    exact = videos.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_p"))
    loose = videos.groupBy(stem(F.col("name")).alias("_stem")).agg(F.count(F.lit(1)).alias("_m"), F.min("path").alias("_q"))
    rows = wanted.join(exact, "name", "left").withColumn("_stem", stem(F.col("name"))).join(loose, "_stem", "left")
    path = F.when(F.col("_n") == 1, F.col("_p")).when(F.col("_n").isNull() & (F.col("_m") == 1), F.col("_q"))
    return rows.select("name", path.alias("path"), F.when(path.isNotNull(), None).when(F.coalesce("_n", "_m") > 1, "ambiguous").otherwise("not_found").alias("error"))
