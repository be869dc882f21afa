"""What the operators share: tables, scratch tables, folds and tree sums."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        sc = spark.sparkContext
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronoweave-"))
        found = sc.getCheckpointDir()
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that no column of `docs` has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(columns: list[str]) -> Column:
    """128 bits that name a row by the values of all its columns; nulls count as values of their own."""
    marked = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.struct(F.xxhash64(F.lit(1), *marked).alias("a"), F.xxhash64(F.lit(2), *reversed(marked)).alias("b"))


def whole_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """row (all columns, as a struct), row_id and the `columns` that an operator works on: no name of its own can meet a user's."""
    return docs.select(F.struct("*").alias("row"), row_key(docs.columns).alias("row_id"), *columns)


#: Numbers that one row is exploded to at a time.
WIDE = 1 << 15


def numbered(rows: DataFrame, times: str, column: str) -> DataFrame:
    """Each row `times` times, numbered from 1 on in `column`, in two steps: no array has more than WIDE numbers, or a WIDEth of the times."""
    block, n = fresh(rows, "_block"), F.col(times).cast("long")
    rows = rows.where(n > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / WIDE))))
    first = F.col(block) * WIDE + 1
    return rows.withColumn(column, F.explode(F.sequence(first, F.least(n, first + (WIDE - 1))))).drop(block)


#: Slots of a filter of keys; a fixed size, so it may be broadcast whatever the number of keys.
FILTER = 1 << 22


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """True at the slots (FILTER of them) that the 64-bit keys of a column fall into: lets through all of them and, beside, a share of others."""

    def run(batches):
        from pyspark import TaskContext

        seen = np.zeros(FILTER, np.uint16)
        for b in batches:
            seen[slot(b.column(0).to_numpy())] = 1
        yield packed_rows([(0, TaskContext.get().partitionId(), seen)])

    got = gathered(tree_sum(keys.select(column).mapInArrow(run, "part int, task int, data binary"), "uint16"), "uint16")
    return got > 0 if len(got) else np.zeros(FILTER, bool)


def give_back() -> None:
    """Return memory that this Python worker has freed but keeps to the machine: workers live on from stage to stage, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def trimmed(run):
    """`run` over batches, as it is, but for the memory that earlier tasks and it have freed, which goes back before and after."""

    def inner(batches):
        give_back()
        yield from run(batches)
        give_back()

    return inner


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.int64).view(np.uint64) >> np.uint64(20)).astype(np.int64) & (FILTER - 1)


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % k


def utf8(text: str) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def pieces(batches, column: str = "text", most: int = 4 << 20):
    """Slices of Arrow batches holding at most `most` bytes of `column`, or one row that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = buffers(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes behind a binary or text column and the offsets of its rows in them (rows + 1 of them); null rows are empty."""
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = column.buffers()
    n, at = len(column), column.offset
    offsets = np.frombuffer(raw[1], np.int64 if large else np.int32)[at : at + n + 1].astype(np.int64) if raw[1] and n else np.zeros(n + 1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def tree_sum(parts: DataFrame, dtype: str, fan: int = 48, tasks: int | None = None) -> DataFrame:
    """Sum of packed arrays by `part` (of uint16: their maximum), through levels of at most `fan` partials each.

    `parts` has (part int, task int, data binary): zlib-packed numpy arrays, equal in length within a part.
    Each level streams its rows, so a task holds one accumulator per part, whatever the number of partials.
    """
    n, level = tasks or parts.rdd.getNumPartitions(), parts

    def add(batches):
        acc: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for part, task, data in zip(b["part"].to_pylist(), b["task"].to_pylist(), b["data"], strict=True):
                x = np.frombuffer(zlib.decompress(data.as_py()), dtype)
                if (part, task) in acc:
                    acc[part, task] = np.maximum(acc[part, task], x) if dtype == "uint16" else acc[part, task] + x
                else:
                    acc[part, task] = x.copy()
        for (part, task), x in acc.items():
            yield packed_rows([(part, task, x)])

    while True:
        grouped = level.select("part", F.expr(f"cast(floor(task / {fan}) as int)").alias("task"), "data")
        n = -(-n // fan)
        level = grouped.repartition("part", "task").mapInArrow(add, "part int, task int, data binary")
        if n <= 1:
            return level.select("part", "data")


def packed_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    part, task, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(task, pa.int32()), pa.array([zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in data], pa.binary())], ["part", "task", "data"])


def gathered(sums: DataFrame, dtype: str) -> np.ndarray:
    """The summed parts in order, as one array; its size is fixed by the parameters, not by the data."""
    got = sorted(sums.collect())
    return np.concatenate([np.frombuffer(zlib.decompress(bytes(r["data"])), dtype) for r in got]) if got else np.zeros(0, dtype)
