"""Hard negatives by blocked dense products: anchors go out in slabs of bounded size, candidates stream past them.

Vectors are whole numbers and products run in float64, so that a score is exact as long as it stays below 2**53; blocks
that could pass that bound are multiplied as Python integers. A first pass over the candidates keeps each anchor's best
positives, a second one the best negatives in the window of each positive. Both keep, for each block of anchors, a
running best of a fixed size in a task, and those are merged through a tree of tasks.

A pass over the candidates for each slab is the work that is asked for, as all anchors meet all rows: a pass of 2**16
anchors of 64 components spends 8 million multiplications on a candidate of some 300 bytes.
"""

from __future__ import annotations

import pickle
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import materialize, shared_dir

#: Anchors of a block, bytes of anchors that go out at a time, candidates of a product.
BLOCK, SLAB_BYTES, TILE = 512, 32 << 20, 2048
#: Scores are cut to this in size; whole numbers below EXACT are exact in float64.
MOST, EXACT = 1 << 62, 1 << 53
#: The score and id of a place that no row has taken.
NONE, NOBODY = -MOST - 1, np.iinfo(np.int64).max
PARTS = "part int, task int, data binary"


def eligible(rows: DataFrame, *, flip: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, embedding of rows with an id, a label and a vector; where `flip` divides vec_id, label is (label + 1) % classes."""
    label = F.when(F.col("vec_id") % flip == 0, F.pmod(F.col("label") + 1, F.lit(classes))).otherwise(F.col("label"))
    named = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return named.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")


def tiles(batches, scale: int, most: int = TILE):
    """(ids, labels, whole vectors as doubles) of at most `most` rows with vectors of one length, by id; rows with a null or non-finite component are left out."""
    for batch in batches:
        lists = batch["embedding"]
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        x = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        ids, labels = batch["vec_id"].to_numpy(), batch["label"].to_numpy()
        for n in np.unique(size):
            row = np.flatnonzero(size == n)
            row = row[np.argsort(ids[row], kind="stable")]
            for at in range(0, len(row), most):
                some = row[at : at + most]
                v = x[start[some][:, None] + np.arange(n)]
                good = np.isfinite(v).all(axis=1)
                yield ids[some][good], labels[some][good], v[good]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact; the shorter vectors have zeros behind. float64 where that is exact, else int64 cut to MOST."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, n) < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def blank(s: np.ndarray):
    return -np.inf if s.dtype == np.float64 else NONE


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row and their ids, of equal scores the first column; `s` is used up."""
    none, row = blank(s), np.arange(len(s))
    score, who = np.full((len(s), k), NONE, np.int64), np.full((len(s), k), NOBODY, np.int64)
    for j in range(k if s.shape[1] else 0):
        at = s.argmax(axis=1)
        top = s[row, at]
        there = top != none
        score[there, j], who[there, j] = top[there], ids[at[there]]
        s[row, at] = none
    return score, who


def merged(score: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best along the last axis: higher scores first, then smaller ids."""
    order = np.lexsort((who, -score), axis=-1)[..., :k]
    return np.take_along_axis(score, order, -1), np.take_along_axis(who, order, -1)


class Running:
    """The best of each anchor (and window) of a block of anchors so far."""

    def __init__(self, shape: tuple[int, ...]):
        self.score, self.who = np.full(shape, NONE, np.int64), np.full(shape, NOBODY, np.int64)

    def take(self, at, s: np.ndarray, ids: np.ndarray) -> None:
        """Rows of scores for the places `at`; a row that can't better its place costs one look."""
        k = self.score.shape[-1]
        top = s.max(axis=1, initial=blank(s))
        better = (top != blank(s)) & (top >= self.score[at][:, -1])
        if better.any():
            at = tuple(x[better] for x in at) if isinstance(at, tuple) else at[better]
            score, who = best(s[better], ids, k)
            both = np.concatenate([self.score[at], score], -1), np.concatenate([self.who[at], who], -1)
            self.score[at], self.who[at] = merged(*both, k)

    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps((self.score, self.who), protocol=5), 1)


def unpacked(data) -> tuple[np.ndarray, np.ndarray]:
    return pickle.loads(zlib.decompress(data.as_py() if hasattr(data, "as_py") else bytes(data)))


def tree_merge(parts: DataFrame, fan: int = 48) -> DataFrame:
    """(part, data) with one row a part: the best of all its rows, through levels of at most `fan` rows each."""
    n, level = parts.rdd.getNumPartitions(), parts

    def add(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for part, task, data in zip(b["part"].to_pylist(), b["task"].to_pylist(), b["data"], strict=True):
                got, was = unpacked(data), held.get((part, task))
                held[part, task] = got if was is None else merged(np.concatenate([was[0], got[0]], -1), np.concatenate([was[1], got[1]], -1), got[0].shape[-1])
        for (part, task), (score, who) in held.items():
            yield sent(part, task, zlib.compress(pickle.dumps((score, who), protocol=5), 1))

    while True:
        n = -(-n // fan)
        level = level.select("part", F.expr(f"cast(floor(task / {fan}) as int)").alias("task"), "data").repartition("part", "task").mapInArrow(add, PARTS)
        if n <= 1:
            return level.select("part", "data")


def sent(part: int, task: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([data], pa.binary())], ["part", "task", "data"])


def blocks(slab: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of at most BLOCK anchors with vectors of one length, those of a label together."""
    out, of = [], {}
    for r in slab:
        of.setdefault(len(r["v"]) // 8, []).append(r)
    for _, rows in sorted(of.items()):
        rows.sort(key=lambda r: (r["label"], r["vec_id"], bytes(r["v"])))
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            out.append((np.array([r["vec_id"] for r in some]), np.array([r["label"] for r in some]), np.stack([np.frombuffer(r["v"], np.float64) for r in some])))
    return out


def positives(candidates: DataFrame, anchors, scale: int, k: int) -> DataFrame:
    """(part, data): of each block of anchors, the k best other rows of each anchor's label."""

    def run(batches):
        from pyspark import TaskContext

        held = [Running((len(ids), k)) for ids, _, _ in anchors.value]
        for ids, labels, v in tiles(batches, scale):
            for (a_ids, a_labels, a), run in zip(anchors.value, held, strict=True):
                for label in np.intersect1d(a_labels, labels):
                    mine, there = np.flatnonzero(a_labels == label), labels == label
                    s = scores(a[mine], v[there])
                    s[a_ids[mine][:, None] == ids[there]] = blank(s)
                    run.take(mine, s, ids[there])
        for part, run in enumerate(held):
            if (run.who != NOBODY).any():
                yield sent(part, TaskContext.get().partitionId(), run.packed())

    return tree_merge(candidates.mapInArrow(run, PARTS))


def negatives(candidates: DataFrame, anchors, windows, scale: int, k: int) -> DataFrame:
    """(part, data): of each block of anchors, the k best rows of other labels in each of the anchor's windows (low, high)."""

    def run(batches):
        from pyspark import TaskContext

        held = [Running((*low.shape, k)) for low, _ in windows.value]
        for ids, labels, v in tiles(batches, scale):
            for (_, a_labels, a), (low, high), run in zip(anchors.value, windows.value, held, strict=True):
                s = scores(a, v)
                s[a_labels[:, None] == labels] = blank(s)
                for p in range(low.shape[1]):
                    inside = np.where((s <= high[:, p, None]) & (s >= low[:, p, None]), s, blank(s))
                    run.take((np.arange(len(a)), np.full(len(a), p)), inside, ids)
        for part, run in enumerate(held):
            if (run.who != NOBODY).any():
                yield sent(part, TaskContext.get().partitionId(), run.packed())

    return tree_merge(candidates.mapInArrow(run, PARTS))


def window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest whole n with low * score <= 100 * n <= high * score, without overflow; empty for places not taken."""
    part = lambda x: (score // 100) * x + (score % 100 * x) // 100  # noqa: E731  floor of x hundredths
    up = -((-score) // 100 * low + (-score) % 100 * low // 100)
    gone = score == NONE
    return np.where(gone, MOST, up), np.where(gone, NONE, part(high))


def mine(rows: DataFrame, *, every: int = 50, scale: int = 256, flip: int = 7, classes: int = 10, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label) rows.

    Components count as floor(scale * x) in doubles, a score is the inner product. Anchors are the rows whose vec_id
    `every` divides, their positives the first `n_positives` rows of the same label and another vec_id, their negatives
    for a positive the first `n_negatives` rows of other labels with a score of `low` to `high` hundredths of the
    positive's. Higher scores come first, then smaller vec_ids. Labels are those of `eligible`.

    Rows with a null vec_id, label, vector or component, or with a component that is not finite before or after scaling,
    take no part. Vectors of different lengths are compared as if zeros stood behind the shorter. Equal anchor rows are
    one anchor, other repeated rows count each; anchors without positives, or positives without negatives in the window,
    give no rows. Scores beyond 2**62 count as that. An empty table gives no rows; other columns are not looked at.
    """
    spark, candidates = rows.sparkSession, eligible(rows, flip=flip, classes=classes)

    def pack(batches):
        for ids, labels, v in tiles(batches, scale):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "label", "v"])

    anchors = candidates.where(F.col("vec_id") % every == 0).mapInArrow(pack, "vec_id long, label long, v binary").distinct()
    anchors = materialize(anchors, "anchors")
    size = anchors.agg(F.coalesce(F.sum(F.octet_length("v") + 64), F.lit(0))).first()[0]
    slabs, sc = max(1, -(-size // slab_bytes)), spark.sparkContext
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    kept = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for slab in range(slabs):  # each of at most some `slab_bytes`, by hash
        mine_ = blocks(anchors.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(slabs)) == slab).collect())
        out = sc.broadcast(mine_)
        found = [(np.full((len(ids), n_positives), NONE, np.int64), np.full((len(ids), n_positives), NOBODY, np.int64)) for ids, _, _ in mine_]
        for r in positives(candidates, out, scale, n_positives).collect():
            found[r["part"]] = unpacked(r["data"])
        windows = sc.broadcast([window(score, low, high) for score, _ in found])
        known = sc.broadcast([(ids, *f) for (ids, _, _), f in zip(mine_, found, strict=True)])

        def spread(batches, known=known):
            for b in batches:
                for part, data in zip(b["part"].to_pylist(), b["data"], strict=True):
                    ids, p_score, p_who = known.value[part]
                    score, who = unpacked(data)
                    a, p, r = np.nonzero(who != NOBODY)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], p_who[a, p], (r + 1).astype(np.int32), who[a, p, r], p_score[a, p], score[a, p, r])], kept.replace(" long", "").replace(" int", "").split(", "))

        negatives(candidates, out, windows, scale, n_negatives).mapInArrow(spread, kept).write.mode("append").parquet(path)
        for x in (out, windows, known):
            x.unpersist()
    return spark.read.schema(kept).parquet(path)
