"""Fusing observations of several rounds, sources and passes: best rows, overrides, coverage, differences of plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def first_wins(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of tables; of rows with one key that of the earliest table stays, within a table the first by all other columns, nulls first."""
    tagged = [t.withColumn("_from", F.lit(i)) for i, t in enumerate(tables)]
    rest = [F.col(f"`{c}`") for c in tables[0].columns if c not in keys]
    return best_per_key(reduce(DataFrame.unionByName, tagged), keys, ["_from", *rest]).drop("_from")


def overridden(base: DataFrame, newer: DataFrame, key: str, usable: Column, columns: list[str]) -> DataFrame:
    """`base` with columns replaced by those of `newer` where there is a usable row for the key."""
    other = newer.where(usable).select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    rows = base.join(other, key, "left")
    return rows.withColumns({c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_there", *(f"_{c}" for c in columns))


def chosen_pass(dense: str, coarse: str, fallback: str) -> tuple[Column, Column]:
    """The value of the finest pass that has one, and which pass that is."""
    value = F.coalesce(F.col(dense), F.col(coarse), F.col(fallback))
    return value, F.when(F.col(dense).isNotNull(), "dense").when(F.col(coarse).isNotNull(), "coarse").otherwise("fallback")


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that are new, gone or of another value."""
    both = old.select(key, F.col(value).alias("was"), F.lit(True).alias("_o")).join(new.select(key, F.col(value).alias("now"), F.lit(True).alias("_n")), key, "full")
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.withColumn("state", state).where("state is not null").select(key, "was", "now", "state")


def partition_errors(rows: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Keys that are not in exactly one of accepted and rejected, or in neither of rows: missing, both or unknown."""
    marks = rows.select(key, F.lit(1).alias("r"), F.lit(0).alias("a"), F.lit(0).alias("j")).unionByName(accepted.select(key, F.lit(0).alias("r"), F.lit(1).alias("a"), F.lit(0).alias("j"))).unionByName(rejected.select(key, F.lit(0).alias("r"), F.lit(0).alias("a"), F.lit(1).alias("j")))
    sums = marks.groupBy(key).agg(F.max("r").alias("r"), F.max("a").alias("a"), F.max("j").alias("j"))
    return sums.withColumn("error", F.when(F.col("r") == 0, "unknown").when(F.col("a") + F.col("j") == 0, "missing").when(F.col("a") + F.col("j") == 2, "both")).where("error is not null").select(key, "error")


def coverage(wanted: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted buckets not seen, seen ones not wanted, and those seen more than once."""
    got = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    both = wanted.select(*keys).distinct().withColumn("_w", F.lit(True)).join(got, keys, "full")
    state = F.when(F.col("times").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(F.col("times") > 1, "duplicate")
    return both.withColumn("state", state).where("state is not null").select(*keys, "state")


def any_pass(episodes: DataFrame, decision: str = "decision", confidence: str = "conf") -> DataFrame:
    """An entity passes if one of its episodes does; its confidence is the highest of the episodes that decide."""
    rows = episodes.groupBy("entity").agg(F.max(F.when(F.col(decision) == "pass", F.col(confidence))).alias("_p"), F.max(confidence).alias("_f"), F.count(F.lit(1)).alias("episodes"))
    return rows.select("entity", F.when(F.col("_p").isNotNull(), "pass").otherwise("fail").alias("decision"), F.coalesce("_p", "_f").alias("conf"), "episodes")


def stable_abnormal(rows: DataFrame, unit: str, weight: str, alone: int = 900) -> DataFrame:
    """Entities where two units or one sure one agree."""
    groups = rows.groupBy("entity").agg(F.countDistinct(unit).alias("units"), F.max(weight).alias("best"))
    return groups.where((F.col("units") >= 2) | (F.col("best") >= alone))


def dominant_cluster(rows: DataFrame, value: str, reach: int) -> DataFrame:
    """The value of each entity with the most rows within `reach`, its share in thousandths and whether that is a majority; ties: the smallest."""
    w = Window.partitionBy("entity").orderBy(value).rangeBetween(-reach, reach)
    rows = rows.withColumns({"near": F.count(F.lit(1)).over(w), "total": F.count(F.lit(1)).over(Window.partitionBy("entity"))})
    best = best_per_key(rows, ["entity"], [F.col("near").desc(), value])
    return best.select("entity", F.col(value).alias("centre"), "near", F.floor(F.col("near") * 1000 / F.col("total")).alias("share"), (F.col("near") * 2 > F.col("total")).alias("majority"))


def classified(rows: DataFrame, flags: dict[str, Column], default: str) -> DataFrame:
    """The first flag, in order, that any row of the entity has."""
    marks = rows.groupBy("entity").agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, c in flags.items()))
    return marks.select("entity", F.coalesce(*(F.when(F.col(f"_{n}"), F.lit(n)) for n in flags), F.lit(default)).alias("class"))


def nearest_reference(actual: DataFrame, reference: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each row the distance to the nearest reference of its keys, in time; null without one. One union and two windows, no pairs."""
    both = actual.select(*keys, at, F.lit(False).alias("_ref")).unionByName(reference.select(*keys, at, F.lit(True).alias("_ref")))
    w, known = Window.partitionBy(*keys).orderBy(at), F.when(F.col("_ref"), F.col(at))
    before, after = F.max(known).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.min(known).over(w.rangeBetween(0, Window.unboundedFollowing))
    return both.withColumn("distance", F.least(F.col(at) - before, after - F.col(at))).where("not _ref").drop("_ref")


def resolved(names: DataFrame, files: DataFrame) -> DataFrame:
    """Files of names: the only file of that name, else the only one of that stem, else none."""
    one = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("path").alias("path")).where("_n = 1").drop("_n")
    files = files.withColumn("file", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    exact = one(files, "file").select(F.col("file").alias("name"), F.col("path").alias("exact"))
    loose = one(files, "stem").select(F.col("stem").alias("name"), F.col("path").alias("loose"))
    return names.join(exact, "name", "left").join(loose, "name", "left").select("name", F.coalesce("exact", "loose").alias("path"))
