"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies, target words over source words. The whole
part is taken at once. The fractional parts are rounded dependently: two documents trade words, one giving what
the other gets, until one of them holds all of its words or none, with odds that keep each one's expectation.
The words taken from a source therefore stay the same throughout, but for the last document, which is rounded at
its own odds. The trades run in chunks; the one undecided document of each chunk goes on to the next level of a
reduction tree, so no task sees more than a chunk and no source is too large.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import materialize, numbered, whole_rows

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words split by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, weigh `cycle` in turn and share the sum of all sizes; no target is
    above `most` times its source, and what is cut off is shared again by weight. Sharing again until none is
    above ends where all uncapped targets are one multiple of their weights: the sources are capped in the order
    of cap over weight, up to the first that need not be. One row per source, so plain windows do it.
    """
    weigh = F.element_at(F.array(*map(F.lit, cycle)), (F.col("_n") % len(cycle) + 1).cast("int")).cast("double")
    order, up = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = sources.withColumn("_n", F.row_number().over(order) - 1).withColumn("_w", weigh).withColumn("_cap", most * F.col("source_size").cast("double"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_all": F.sum("source_size").over(everything).cast("double"), "_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)), "_used": F.coalesce(F.sum("_cap").over(before), F.lit(0.0))})
    rows = rows.withColumn("_level", (F.col("_all") - F.col("_used")) / F.col("_left"))
    # the level of the first source that need not be capped holds for all after it
    rows = rows.withColumn("_open", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", F.col("_n"), F.col("_level")))).over(everything))
    level = F.col("_open._level")
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("_cap"), level * F.col("_w")), F.col("_cap")).alias("target"))


def round_chunk(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Trade words along the rows, long ones first; at most one row stays undecided, none if `last`.

    Neighbours are alike in size, so the undecided row is passed down to short rows and what its rounding adds or
    takes is small.

    `_part`: words held, from 0 to `size`; `_take`: 1 all, 0 none, -1 undecided; `_u`: a number in [0, 1) that depends on the row alone.
    """
    rows = rows.sort_values(["size", "_key", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    size, held, u = rows["size"].to_numpy(float), rows["_part"].to_numpy(float).copy(), rows["_u"].to_numpy(float)
    take = rows["_take"].to_numpy().copy()
    open_ = -1
    for i in range(len(rows)):
        if take[i] >= 0:
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = open_, i
        give, get = min(size[a] - held[a], held[b]), min(held[a], size[b] - held[b])  # a gains `give`, or b gains `get`
        if u[b] * (give + get) < get:
            held[a] += give
            held[b] -= give
        else:
            held[a] -= get
            held[b] += get
        open_ = -1
        for x in (a, b):
            slack = 1e-9 * max(1.0, size[x])
            if held[x] <= slack or held[x] >= size[x] - slack:
                take[x] = int(held[x] > slack)
            else:
                open_ = x
    if last and open_ >= 0:
        take[open_] = int(u[open_] * size[open_] < held[open_])
    rows["_part"], rows["_take"] = held, take
    return rows


def trader(last: bool):
    return lambda rows: round_chunk(rows, last)


def mix(docs: DataFrame, *, seed: int = 17, chunk: int = 8192, fan: int = 64, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and the columns in `carry`.

    Documents without words hold nothing to mix: they stay once and take 0. Null texts count as empty, a null
    source is a source of its own, repeated rows are mixed each on its own, and an empty table gives no rows.
    The order and the random numbers come from the seed and the rows' own values, so reruns agree.
    """
    # the id travels as text: pandas would turn a nullable long into a double
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", word_count().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_crc"), *carry)
    # rows that are equal here may be exchanged for each other: numbered, they can be dealt out singly, however many
    slim = numbered(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("_times")), "_times", "_copy").drop("_times")
    slim = materialize(slim, "mix-sizes")
    by_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most)
    chunks = slim.groupBy("source").agg(F.count(F.lit(1)).alias("_docs")).select(F.col("source").alias("_s"), F.greatest(F.lit(1), F.ceil(F.col("_docs") / chunk)).alias("_chunks"))
    plan = by_source.join(chunks, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_source")
    plan = materialize(plan, "mix-plan")
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    whole, key = F.floor(F.col("_ratio") + 1e-12), F.xxhash64(F.lit(seed), "doc_id", "size", "_crc", "_copy")
    rows = rows.withColumn("_ratio", ratio).withColumn("_whole", whole).withColumn("_key", key)
    rows = rows.withColumn("_part", F.greatest(F.lit(0.0), F.col("_ratio") - F.col("_whole")) * F.col("size"))
    rows = rows.withColumn("_take", F.when((F.col("_part") <= 1e-9) | (F.col("size") == 0), 0).otherwise(-1))
    rows = rows.withColumn("_u", F.pmod(F.xxhash64(F.lit(seed + 1), "_key", "doc_id"), F.lit(1 << 52)) / float(1 << 52))
    rows = rows.withColumn("_node", F.pmod(F.col("_key"), F.col("_chunks")))
    schema = rows.schema
    levels, widest = 1, plan.agg(F.max("_chunks")).first()[0] or 1
    decided, level = [rows.where("_take >= 0")], rows.where("_take < 0")
    while True:
        last = widest <= 1
        level = level.groupBy("source", "_node").applyInPandas(trader(last), schema)
        level = materialize(level, f"mix-level{levels}")
        decided.append(level.where("_take >= 0"))
        if last:
            break
        level, widest, levels = level.where("_take < 0").withColumn("_node", F.floor(F.col("_node") / fan)), -(-widest // fan), levels + 1
    done = reduce(DataFrame.unionByName, decided)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_whole") + F.col("_take")).cast("int")
    return done.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), *carry)


def repeated(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus itself: each document as many times as it has copies, in the columns of `docs`.

    Rows that are equal in every column share one name (128 bits of all columns) and get the sum of their copies, so the
    same rows come out whichever of them the copies were given to.
    """
    rows = whole_rows(docs, "doc_id", "text", "source")
    copies = mix(rows, carry=("row_id",), **params).groupBy("row_id").agg(F.sum("copies").alias("times")).where("times > 0")
    once = rows.select("row_id", "row").dropDuplicates(["row_id"])
    return numbered(once.join(copies, "row_id").select("row", "times"), "times", "copy").select("row.*")
