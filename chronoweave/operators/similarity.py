"""Exact similarity joins of dense vectors by their mean absolute difference, and the groups that near vectors form.

Two vectors whose absolute differences sum to at most L differ by at most L / bands in one band of components at least,
and any sum of a band's components with signs differs by no more than that. So each band has axes, sums with the signs of
a Hadamard matrix, cut into cells; near vectors meet in the same or a neighbouring cell of every axis of one band. Keys
start with two axes and take on another one wherever more than WORTH vectors share one, so that small tables make few rows
and large ones small keys. Which keys are parted is counted first, a round an axis, with one row a vector and band; rows of
all cells that near vectors may be in are then made once, with their axes in 16 bytes. Where all axes are used up, the
vectors are as good as equal or a dense cluster; there a few pivots tie most of them together first, and only rows that the
pivots left apart meet the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.graph import components
from chronoweave.session import written

#: A key takes on an axis when it has more vectors than this; pivots of a key that has no axis left.
WORTH, PIVOTS = 256, 8
#: Axes of a band and of the whole vector; cells are so many times as wide as what near vectors may differ by.
AXES, CELL = 8, 4
#: Keys of one axis that are parted at most, the largest first: they go to every task. Others are compared as they are.
ROOM = 1 << 18
#: Steps of what near vectors may differ by that an axis is rounded to, in a byte that wraps.
STEPS = 8


def hadamard(n: int) -> np.ndarray:
    """The first n columns of the smallest matrix of orthogonal rows of signs that has as many."""
    h = np.ones((1, 1))
    while h.shape[1] < n:
        h = np.block([[h, h], [h, -h]])
    return h[:, :n]


def axes(v: np.ndarray, limit: float, bands: int) -> np.ndarray:
    """(rows, bands, 2 * AXES): sums with signs of each band and of the whole vector, in units of what near vectors may differ by."""
    n, size = v.shape
    out, spread = np.zeros((n, bands, 2 * AXES)), size * limit
    # components are dealt to bands in turn, so that neighbouring, often equal ones don't share a band
    for k in range(bands):
        band = v[:, k::bands]
        signs = hadamard(max(1, band.shape[1]))[:AXES]
        out[:, k, : len(signs)] = band @ signs[:, : band.shape[1]].T / (spread / bands)
    signs = hadamard(max(1, size))
    signs = signs[np.linspace(0, len(signs) - 1, min(AXES, len(signs))).astype(int)]
    out[:, :, AXES : AXES + len(signs)] = (v @ signs.T / spread)[:, None, :]
    return out


def distinct_vectors(rows: DataFrame, id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rep, v, size) of each distinct usable vector, rep its smallest id, and (id, rep) of all their rows.

    Vectors with a null or non-finite component, null and empty ones, and rows without an id, are not usable. Copies are
    told by two 64-bit hashes and combined before the shuffle, so that one vector may hold most of the rows.
    """
    whole = F.expr(f"forall(`{vector}`, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))")
    used = rows.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & whole)
    used = used.select(F.col(id).alias("id"), F.expr(f"transform(`{vector}`, x -> cast(x as double) + 0D)").alias("v"))
    used = used.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), F.reverse("v"))})
    reps = written(used.groupBy("h", "g").agg(F.min("id").alias("rep"), F.first("v").alias("v")), "vectors")
    return reps.select("rep", "v", F.size("v").alias("size")), used.select("id", "h", "g").join(reps.select("h", "g", "rep"), ["h", "g"]).select("id", "rep")


def mixed(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Keys with another cell in them, as 64-bit hashes."""
    x = (key.view(np.uint64) ^ cell.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def within(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ones."""
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def walked(x: np.ndarray, key: np.ndarray, parted: list[np.ndarray], probe: bool):
    """(row, key, axes in it) of the keys that rows end in; `parted` has the keys of 2, 3 .. axes that take on another. Probes go to all cells that near vectors may be in."""
    row, slack = np.arange(len(x)), 1 + 1e-6
    for axis in range(x.shape[1]):
        at = x[row, axis]
        own = np.floor(at / CELL)
        cells = [(row, key, own)]
        for moved in (at - slack, at + slack) if probe else ():
            cell = np.floor(moved / CELL)
            other = cell != own
            cells.append((row[other], key[other], cell[other]))
        row, key = np.concatenate([c[0] for c in cells]), np.concatenate([mixed(c[1], c[2]) for c in cells])
        if axis:
            on = within(key, parted[axis - 1]) if axis <= len(parted) and axis < x.shape[1] - 1 else np.zeros(len(key), bool)
            yield row[~on], key[~on], axis + 1
            row, key = row[on], key[on]


def banded(b: pa.RecordBatch, limit: float, bands: int):
    """(places of vectors in the batch, their axes, their first keys), a row a vector and band, of the vectors of each length."""
    lists = b["v"]
    size, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    for n in np.unique(size):
        row = np.flatnonzero(size == n)
        x = axes(flat[start[row][:, None] + np.arange(n)], limit, bands)
        yield np.repeat(row, bands), x.reshape(-1, x.shape[2]), np.tile(np.arange(bands, dtype=np.int64) + bands * int(n), len(row))


def parted_keys(reps: DataFrame, limit: float, bands: int, worth: float) -> list[np.ndarray]:
    """The keys of 2, 3 .. axes, up to all, that have more than `worth` vectors, sorted; at most ROOM of each."""
    parted = []
    for axis in range(1, 2 * AXES):

        def run(batches, last=axis + 1):
            for b in batches:
                for _, x, key in banded(b, limit, bands):
                    keys = [k for _, k, n in walked(x[:, :last], key, parted, False) if n == last]
                    own, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], ["key", "n"])

        counts = reps.select("v").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > worth)
        keys = np.array([r.key for r in counts.orderBy(F.desc("n"), "key").limit(ROOM).select("key").collect()], np.int64)
        if not len(keys):
            break
        parted.append(np.sort(keys))
    return parted


def indexed(reps: DataFrame, limit: float, bands: int, parted: list[np.ndarray]) -> DataFrame:
    """(rep, probe, key, dense, x, y) of each vector and key: x and y hold its rounded axes; keys with all axes that still have many vectors are dense."""
    rep = reps.schema["rep"].dataType.simpleString()
    full = parted[-1] if len(parted) == 2 * AXES - 1 else np.zeros(0, np.int64)

    def run(batches):
        for b in batches:
            for place, x, first in banded(b, limit, bands):
                q = np.ascontiguousarray(np.floor(x * STEPS).astype(np.int64).astype(np.uint8)).view(np.int64)
                for probe in (False, True):
                    for row, key, n in walked(x, first, parted, probe):
                        if len(row):
                            dense = within(key, full) if n == 2 * AXES else np.zeros(len(key), bool)
                            yield pa.RecordBatch.from_arrays([b["rep"].take(pa.array(place[row])), pa.array(np.full(len(row), probe)), pa.array(key), pa.array(dense), pa.array(q[row, 0]), pa.array(q[row, 1])], ["rep", "probe", "key", "dense", "x", "y"])

    return reps.select("rep", "v").mapInArrow(run, f"rep {rep}, probe boolean, key long, dense boolean, x long, y long")


def compared(left: DataFrame, right: DataFrame, apart: bool = False) -> DataFrame:
    """(a, b), a below b, of index and probe rows that share a key and whose axes all allow them to be near; `apart`: that differ in `label` too."""
    near, most = F.col("a") != F.col("b"), STEPS + 1
    for c in ("y", "x"):  # those of the whole vector are in no key at first
        for k in range(0, 64, 8):
            own, other = (F.shiftright(f"{c}{s}", k).bitwiseAND(F.lit(255)) for s in "ab")
            near &= (own - other + most).bitwiseAND(F.lit(255)) <= 2 * most
    more = ["label"] if apart else []
    left = left.select("key", F.col("rep").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), *(F.col(c).alias("la") for c in more))
    right = right.select("key", F.col("rep").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), *(F.col(c).alias("lb") for c in more))
    found = left.join(right, "key").where(near & (F.col("la") != F.col("lb")) if apart else near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, reps: DataFrame, limit: float) -> DataFrame:
    """(a, b, total): the pairs whose absolute differences sum to at most limit times their number of components."""
    v = reps.select("rep", "v", "size")
    both = pairs.join(v.selectExpr("rep as a", "v as va", "size as n"), "a").join(v.selectExpr("rep as b", "v as vb"), "b")
    total = F.expr("aggregate(zip_with(va, vb, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)")
    return both.select("a", "b", "n", total.alias("total")).where(F.col("total") <= limit * F.col("n")).select("a", "b", "total")


def candidates(reps: DataFrame, limit: float, bands: int, worth: float) -> DataFrame:
    """Entries (rep, probe, key, dense, x, y): near vectors share a key, one as index and the other as probe, either way round."""
    return written(indexed(reps, limit, bands, parted_keys(reps, limit, bands, worth)), "near-entries")


def near_pairs(rows: DataFrame, id: str, vector: str, limit: float, *, bands: int = 8, worth: float = WORTH) -> DataFrame:
    """(a, b, total): all pairs of different vectors whose absolute differences sum to `total`, at most `limit` a component.

    a and b are the smallest ids of their vectors, a the smaller one; equal vectors, and vectors of different lengths, make no
    pair. Rows that can't be used are those of `distinct_vectors`. A dense cluster has as many pairs as it has: for groups
    alone, `near_groups` doesn't list them. `limit` must be above 0.
    """
    reps, _ = distinct_vectors(rows, id, vector)
    entries = candidates(reps, limit, bands, worth)
    return verified(compared(entries.where(~F.col("probe")), entries.where("probe")), reps, limit)


def near_groups(rows: DataFrame, id: str, vector: str, limit: float, *, bands: int = 8, worth: float = WORTH) -> DataFrame:
    """(id, component, vectors, members) of each row whose vector is near a different one, directly or through others.

    `component` is the smallest id of the group, `vectors` counts its distinct vectors and `members` its rows. Vectors that
    only have equal copies are in no group. Terms are those of `near_pairs`.
    """
    reps, members = distinct_vectors(rows, id, vector)
    entries = candidates(reps, limit, bands, worth)
    cold, hot = entries.where(~F.col("dense")), entries.where("dense")
    links = verified(compared(cold.where(~F.col("probe")), cold.where("probe")), reps, limit).select("a", "b")
    if not hot.isEmpty():
        index, probe = hot.where(~F.col("probe")), hot.where("probe")
        pivot = index.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("_r") <= PIVOTS).drop("_r")
        links = written(links.unionByName(verified(compared(pivot, probe), reps, limit).select("a", "b")), "near-links")
        label = components(links).withColumnsRenamed({"node": "rep", "component": "label"})
        named = hot.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        sizes = written(named.where("probe").groupBy("key", "label").count(), "near-labels")
        main = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
        named = written(named.join(main, "key"), "near-apart")  # keys that are one group have no pair left
        other = F.col("label") != F.col("main")
        index, probe = named.where(~F.col("probe")), named.where("probe")
        rest = compared(index.where(other), probe, True).unionByName(compared(index.where(~other), probe.where(other), True))
        links = links.unionByName(verified(rest.distinct(), reps, limit).select("a", "b"))
    group = components(links).withColumnRenamed("node", "rep")
    rows_in = written(members.join(group, "rep").select("id", "rep", "component"), "near-groups")
    sizes = rows_in.groupBy("component").agg(F.countDistinct("rep").alias("vectors"), F.count(F.lit(1)).alias("members"))
    return rows_in.join(sizes, "component").select("id", "component", "vectors", "members")
