"""Exact Jaccard self-join of word shingles and its components, by partitioning the universe of shingles.

Shingles are hashed into segments, as many for every size band that two sets can share. Sets that link differ in few
shingles, so in few segments, and must agree in all others. Of its segments each set indexes only as many as a pair
could differ in, plus one; all sets choose in one order, rarest first by a corpus-wide count sketch, so two sets that
link have one in common (the pigeonhole argument on an ordered subset). Segments that a frequent passage fills are
therefore left out wherever rarer ones suffice. Where a cost model finds it cheaper for a band, fewer segments are
indexed together with all neighbours one deletion away, each then standing for two differences.

What shares a key is then compared: equal sets are one class from the start, and parity sketches give an exact lower
bound of two sets' difference. Of the pairs of a key that it allows, first a spanning forest of the closest is verified
and joined; then every pair of a key that is still in different components. All sets compared are whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm import words as W
from chronoweave.llm.common import buffers, gathered, key_filter, materialize, packed_rows, pieces, slot, tree_sum, trimmed, whole_rows
from chronoweave.llm.components import components

WIDTH = 5
#: Similarity 80 %, as integers: links have 100 * intersection >= 80 * union.
NUM, DEN = 80, 100
SKETCH_BITS = 21
PARTS = 8
PARITY = 1024
#: Members of a key that are compared in one cell, pairs of a set that are verified in one go.
CELL, GO = 1024, 512
EXACT, DELETE = 1, 2
#: Count of what is empty, above all others.
ABOVE = (1 << 20) - 1
#: Members of a cell up to which all its pairs are listed at once.
SMALL = 64
U = np.uint64


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each begins (rows + 1)."""
    data, offsets = buffers(column)
    data = W.lower(data)
    starts, ends, first = W.spans(data, offsets, W.SPACE == 0)
    h = W.hashes(data, starts, ends)
    g = W.grams(h, WIDTH)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(g[a : b - WIDTH + 1]))
        elif b > a:
            out.append(W.grams(h[a:b] + U(b - a), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the rows' values."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, whatever the order of its members."""
    return W.mix(sums(W.mix(h ^ U(0x243F6A8885A308D3)), at) + np.diff(at).astype(np.uint64)).view(np.int64)


def differences(n):
    """The most shingles in which a set of n and one that it links with, of its size or larger, can differ."""
    return (n + n * DEN // NUM) * (DEN - NUM) // (DEN + NUM)


def band(n: int) -> int:
    """log2 of the number of segments of sets of n shingles: at least twice what they may differ in."""
    return int(2 * differences(n) + 1).bit_length()


def allocation(docs_by_size: dict[int, int], clash: float) -> dict[int, int]:
    """For each band the cheaper of plain segments and one-deletion neighbourhoods.

    A key costs a row, and a comparison with each document of its band that has it by chance: `clash` is the chance
    that one of a set's rarer shingles is in another set at all, and a key of k shingles needs k of them.
    """
    out = {}
    for log in {band(n) for n in docs_by_size} | {band(n * DEN // NUM) for n in docs_by_size}:
        sizes = {n: c for n, c in docs_by_size.items() if log in (band(n), band(n * DEN // NUM))}
        docs = sum(sizes.values())
        n = max(1, sum(k * c for k, c in sizes.items()) // max(1, docs))
        m, h = 1 << log, differences(n)
        half = max(1, (m // 2 + 1) // 2)
        plain = (h + 1) * (1 + docs * min(1.0, clash) ** max(1.0, n / m))
        near = (n + half) * (1 + docs * min(1.0, clash) ** max(1.0, n / half - 1))
        out[log] = EXACT if plain <= near else DELETE
    return out


def keys_of(h: np.ndarray, log: int, mode: int, rarity: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set in a band, and how frequent the rarest shingle of each is."""
    m = 1 << log
    count = rarity[(h >> U(64 - SKETCH_BITS)).astype(np.int64)]
    salt = U(log * 2 + mode)
    if mode == DELETE:
        half = max(1, (m // 2 + 1) // 2)
        seg = ((h >> U(8)) % U(half)).astype(np.int64)
        part, count = W.mix(h ^ salt), np.minimum(count, ABOVE - 1)
        total, rare = by_segment(seg, half, part, count)
        number = np.arange(half, dtype=np.uint64) * U(64) + salt
        key = np.concatenate([W.mix(total ^ W.mix(number)), W.mix((total[seg] - part) ^ W.mix(number[seg]))])
        # without its rarest shingle, a segment is as rare as the next one
        order = np.lexsort((count, seg))
        head = np.append(True, seg[order][1:] != seg[order][:-1])
        second = np.full(half, ABOVE)
        next_ = np.flatnonzero(~head & np.append(False, head[:-1]))
        second[seg[order[next_]]] = count[order[next_]]
        left = rare[seg]
        left[order[head]] = second[seg[order[head]]]
        return key, np.concatenate([rare, left])
    seg = ((h >> U(8)) & U(m - 1)).astype(np.int64)
    total, rare = by_segment(seg, m, W.mix(h ^ salt), np.minimum(count, ABOVE - 1))
    key = W.mix(total ^ W.mix(np.arange(m, dtype=np.uint64) * U(64) + salt))
    if most >= m:
        return key, rare
    order = (rare.astype(np.uint64) << U(44)) | (key >> U(20))
    pick = np.argpartition(order, most - 1)[:most]
    return key[pick], rare[pick]


def by_segment(seg: np.ndarray, m: int, values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Sum of the values and least count of each segment; an empty one has 0 and a count above all."""
    order = np.argsort(seg.astype(np.uint16) if m <= 1 << 16 else seg, kind="stable")
    ordered = seg[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.zeros(m, np.uint64)
    total[ordered[first]] = np.add.reduceat(values[order], first)
    if counts is None:
        return total, None
    rare = np.full(m, ABOVE, np.int64)
    rare[ordered[first]] = np.minimum.reduceat(counts[order], first)
    return total, rare


def members(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """A row per document (doc_id, n, cid, parity, carried columns) and the sketch of shingle counts, in one pass.

    cid is a hash of the set; parity has the parities of the numbers of shingles in each of 1024 classes.
    """
    names = ["doc_id", "n", "cid", "parity", *carry]
    kept = [docs.schema[c] for c in carry]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("parity", T.BinaryType()), *[T.StructField(f.name, f.dataType) for f in kept], T.StructField("part", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        counts, blank = np.zeros(1 << SKETCH_BITS, np.int64), {}
        for piece in pieces(batches, most=2 << 20):
            h, at = shingle_sets(piece["text"])
            n = piece.num_rows
            counts += np.bincount((h >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            row = np.repeat(np.arange(n), np.diff(at))
            odd = (np.bincount(row * PARITY + ((h >> U(20)) % U(PARITY)).astype(np.int64), minlength=n * PARITY) & 1).astype(bool).reshape(n, PARITY)
            columns = [piece["doc_id"], pa.array(np.diff(at)), pa.array(set_keys(h, at)), pa.array([x.tobytes() for x in np.packbits(odd, axis=1)], pa.binary()), *(piece[c] for c in carry)]
            blank = {c: x.type for c, x in zip(names, columns, strict=True)}
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], [*names, "part", "task", "data"])
        if blank:
            for part, x in enumerate(np.split(counts, PARTS)):
                p = packed_rows([(part, TaskContext.get().partitionId(), x)])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in blank.values()), *p.columns], [*names, "part", "task", "data"])

    made = materialize(docs.select("doc_id", "text", *carry).mapInArrow(trimmed(run), schema), "shingles")
    parts = made.where("part is not null").select("part", "task", "data")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    sketch = gathered(tree_sum(parts, "int64", tasks=tasks), "int64")
    return made.where("part is null").select(*names), sketch if len(sketch) else np.zeros(1 << SKETCH_BITS, np.int64)


def index(docs: DataFrame, sketch: np.ndarray, modes: dict[int, int]) -> DataFrame:
    """(key, cid, hot) of every set, once a task for equal sets; hot keys have a shingle count far above what hashing alone gives."""
    mean = sketch.mean()
    shared = docs.sparkSession.sparkContext.broadcast((sketch, modes, mean + 6 * mean**0.5 + 4096))

    def run(batches):
        rarity, chosen, hot = shared.value
        seen: set[int] = set()
        for piece in pieces(batches, most=2 << 20):
            h, at = shingle_sets(piece["text"])
            cids = set_keys(h, at).tolist()
            key, cid, often, size = [], [], [], []
            for i, c in enumerate(cids):
                n = int(at[i + 1] - at[i])
                if c in seen or differences(n) == 0:
                    continue
                seen.add(c)
                for log in {band(n), band(n * DEN // NUM)}:
                    k, r = keys_of(h[at[i] : at[i + 1]], log, chosen[log], rarity, differences(n) + 1)
                    key.append(k)
                    often.append(r)
                    cid.append(c)
                    size.append(len(k))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.repeat(np.array(cid, np.int64), size)), pa.array(np.concatenate(often) > hot)], ["key", "cid", "hot"])

    return docs.select("text").mapInArrow(trimmed(run), "key long, cid long, hot boolean")


def crowded(keys: DataFrame) -> DataFrame:
    """(key, cid, hot) of keys with two different sets or more; streams sorted rows, whatever a key's size.

    Hot keys are known to be crowded, so their rows are spread over tasks and all kept.
    """

    def run(batches):
        key, cid, hot, before = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), False  # the last row, and whether its key came before it
        for b in batches:
            if not b.num_rows:
                continue
            key, cid, hot = (np.concatenate([x, b[c].to_numpy(zero_copy_only=False)]) for x, c in ((key, "key"), (cid, "cid"), (hot, "hot")))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
            key, cid, hot = key[new], cid[new], hot[new]
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[0] = before
            out = same[:-1] | same[1:] | hot[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][out]), pa.array(cid[:-1][out]), pa.array(hot[:-1][out])], ["key", "cid", "hot"])
            key, cid, hot, before = key[-1:], cid[-1:], hot[-1:], bool(same[-1])
        if len(key) and (before or hot[0]):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cid), pa.array(hot)], ["key", "cid", "hot"])

    spread = F.when(F.col("hot"), F.pmod("cid", F.lit(64))).otherwise(F.lit(0)).cast("int")
    return keys.repartition("key", spread).sortWithinPartitions("key", "cid").mapInArrow(trimmed(run), "key long, cid long, hot boolean")


def words64(column: pa.Array) -> np.ndarray:
    return np.frombuffer(buffers(column)[0].tobytes(), np.uint64).reshape(-1, PARITY // 64)


def may_link(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distance of the parity sketches of pairs of rows where sizes and sketches allow a link, -1 elsewhere."""
    x, y = n[i], n[j]
    out = np.full(len(i), -1, np.int64)
    near = np.flatnonzero(np.minimum(x, y) * DEN >= NUM * np.maximum(x, y))
    for at in range(0, len(near), 1 << 16):
        k = near[at : at + (1 << 16)]
        d = np.bitwise_count(bits[i[k]] ^ bits[j[k]]).sum(1).astype(np.int64)
        out[k] = np.where(d <= (x[k] + y[k]) * (DEN - NUM) // (DEN + NUM), d, -1)
    return out


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """For each row, the first row of its run of equal values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def cells(rows: DataFrame, keys: DataFrame, info: DataFrame) -> DataFrame:
    """Rows (key, cid, comp) of the `keys` (key, rows) dealt to cells of bounded size, every two of a key's rows to one cell, with their sets' sizes and parities."""
    rows = rows.join(keys.select("key", F.ceil(F.col("rows") / CELL).cast("int").alias("ways")), "key").join(info, "cid")
    rows = rows.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("ways")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    rows = rows.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    return rows.select("key", "low", "high", "side", "cid", "comp", "n", "parity").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "cid")


def forest(n: np.ndarray, bits: np.ndarray, apart) -> list[tuple[int, int]]:
    """Pairs of rows of one cell that join what its allowed pairs join, the closest first: Prim's algorithm, a row of distances at a time.

    `apart(i)` says which rows i may be paired with.
    """
    far = np.iinfo(np.int64).max
    best, link, out = np.full(len(n), far), np.full(len(n), -1), []
    todo = np.ones(len(n), bool)
    for _ in range(len(n)):
        i = int(np.argmin(np.where(todo, best, far)))
        if not todo[i]:
            i = int(np.argmax(todo))  # what is left can't be reached: another tree begins
        todo[i] = False
        if link[i] >= 0:
            out.append((int(link[i]), i))
        rows = np.flatnonzero(todo & apart(i))
        d = may_link(n, bits, np.full(len(rows), i), rows)
        ok = (d >= 0) & (d < best[rows])
        best[rows[ok]], link[rows[ok]] = d[ok], i
    return out


def cell_pairs(rows: DataFrame, spanning: bool) -> DataFrame:
    """(a, b) of members of a cell that are in different components and may link, or enough of them to join the same groups, the closest first; rows come sorted by cell.

    All pairs of small cells are found side by side. In a large one the tree takes memory by its rows, and all pairs are
    given out as they are found.
    """

    def batch(a, b):
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    def compare(group):
        key, low, high, side, cid, comp, n, bits = group
        start = starts_of(key, low, high)
        size = np.bincount(start, minlength=len(start))[start]
        large = size > SMALL if spanning else np.zeros(len(key), bool)
        for first in np.unique(start[large]).tolist():
            cell = slice(first, first + int(size[first]))
            c, s, own = comp[cell], side[cell], low[first] == high[first]
            pairs = np.array(forest(n[cell], bits[cell], lambda i, c=c, s=s, own=own: (c != c[i]) & (own | (s != s[i]))), np.int64).reshape(-1, 2) + first
            yield batch(cid[pairs[:, 0]], cid[pairs[:, 1]])
        rows, step, found = np.flatnonzero(~large), 1, []
        while len(rows):
            rows = rows[rows + step < (start + size)[rows]]
            i, j = rows, rows + step
            ok = (comp[i] != comp[j]) & ((low[i] == high[i]) | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            if len(i):
                d = may_link(n, bits, i, j)
                ok = d >= 0
                if spanning:
                    found.append(np.stack([i[ok], j[ok], d[ok], start[i[ok]]], 1))
                elif ok.any():
                    yield batch(cid[i[ok]], cid[j[ok]])
            step += 1
        if found:
            pairs = np.concatenate(found)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], pairs[:, 2], pairs[:, 3]))]
            pairs = pairs[joining(pairs[:, :2], len(key))]
            yield batch(cid[pairs[:, 0]], cid[pairs[:, 1]])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b[c].to_numpy() for c in ("key", "low", "high", "side", "cid", "comp", "n")] + [words64(b["parity"])]
            now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            cut = starts_of(*now[:3])[-1]  # the last cell may go on; cells are bounded
            if cut:
                yield from compare([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held:
            yield from compare(held)

    return rows.mapInArrow(trimmed(run), "a long, b long")


def joining(pairs: np.ndarray, rows: int) -> np.ndarray:
    """Of pairs of rows in order, those that join two groups that no pair before has joined."""
    up = list(range(rows))
    keep = np.zeros(len(pairs), bool)
    for k, (i, j) in enumerate(pairs.tolist()):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[i] = j
            keep[k] = True
    return keep


def whole_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, members) of the sets in the pairs (a, b), from the texts again.

    Every task gets a filter of fixed size, which lets through the wanted sets and few others; a join drops the others.
    """
    wanted = materialize(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct(), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(key_filter(wanted, "cid")))

    def run(batches):
        may, seen = np.unpackbits(shared.value).astype(bool), set()
        for piece in pieces(batches, most=1 << 20):
            h, at = shingle_sets(piece["text"])
            ids = set_keys(h, at)
            ok = (np.diff(at) > 0) & may[slot(ids)]
            rows = [i for i in np.flatnonzero(ok).tolist() if ids[i] not in seen and not seen.add(ids[i])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array([h[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())], ["cid", "members"])

    sets = docs.select("text").mapInArrow(trimmed(run), "cid long, members binary")
    return materialize(sets.join(wanted, "cid", "left_semi"), "whole-sets").dropDuplicates(["cid"])  # equal sets can come from several tasks


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. A set that many are compared with goes to several tasks."""
    load = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GO).cast("int").alias("ways"))
    left = pairs.join(load, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("ways")).cast("int")).select("b", "salt", "a")
    hubs = load.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).select("b", "salt", F.col("b").alias("a"))
    rows = hubs.withColumn("kind", F.lit(0)).unionByName(left.withColumn("kind", F.lit(1))).join(sets.select(F.col("cid").alias("a"), "members"), "a")

    def run(batches):
        group, hub = None, None
        for batch in batches:
            a, b = [], []
            for x, y, salt, kind, raw in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["salt"].to_pylist(), batch["kind"].to_pylist(), batch["members"], strict=True):
                s = np.frombuffer(raw.as_py(), np.uint64)
                if kind == 0:
                    group, hub = (y, salt), s
                elif group == (y, salt):
                    at = np.minimum(np.searchsorted(hub, s), len(hub) - 1)
                    common = int(np.count_nonzero(hub[at] == s))
                    if DEN * common >= NUM * (len(hub) + len(s) - common):
                        a.append(x)
                        b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "kind", "a")
    return rows.mapInArrow(trimmed(run), "a long, b long").distinct()


def links(docs: DataFrame, classes: DataFrame, sketch: np.ndarray, modes: dict[int, int] | None = None) -> DataFrame:
    """Components (node, comp) of the `classes` (cid, n, parity, copies) of equal sets that have a link."""
    if modes is None:
        sizes = {r["n"]: r["docs"] for r in classes.groupBy("n").agg(F.sum("copies").alias("docs")).collect()}  # as many as sizes
        modes = allocation(sizes, clash(sketch, sum(sizes.values())))
    crowd = materialize(crowded(index(docs, sketch, modes)), "crowded")
    info = materialize(classes.select("cid", "n", "parity").join(crowd.select("cid").distinct(), "cid", "left_semi"), "crowded-sets")

    sizes = crowd.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    near = cells(crowd.select("key", "cid", F.col("cid").alias("comp")), sizes, info)
    tried = materialize(cell_pairs(near, True).distinct(), "near-pairs")
    first = materialize(verified(tried, whole_sets(docs, tried)), "near-links")
    comp = components(first)

    # what is still apart in some key: all its pairs that may link
    now = crowd.select("key", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    now = materialize(now, "crowded-now")
    open_ = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("rows")).where("x < y")
    pairs = cell_pairs(cells(now, open_, info), False).distinct()
    pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "open-pairs")
    if not pairs.limit(1).count():
        return comp
    second = materialize(verified(pairs, whole_sets(docs, pairs)), "open-links")
    return components(first.unionByName(second)) if second.limit(1).count() else comp


def clash(sketch: np.ndarray, docs: int) -> float:
    """The chance that a shingle of the rarer half is in another set, beyond what the sketch's hashing gives."""
    counts = np.sort(sketch)
    total = float(counts.sum())
    if not total or not docs:
        return 0.0
    half = counts[: int(np.searchsorted(np.cumsum(counts), total / 2)) + 1] / total
    return max(0.0, float(np.square(half).sum()) - float(half.sum()) / len(counts)) * total / docs


def join(docs: DataFrame, *, modes: dict[int, int] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every document and the columns in `carry`.

    A set is the distinct shingles of 5 words of the text with A-Z in lower case; fewer words are one shingle, no words
    (null and empty texts) an empty set that links with nothing. component_id is the smallest doc_id that links lead to;
    null ids are never it unless there is no other, and repeated rows are documents of one class. An empty table gives
    no rows. Links are exact but for hash collisions: shingles and sets are told apart by 64 bits.
    """
    sets_of, sketch = members(docs, carry)
    classes = sets_of.where("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")  # one row for all copies, before anything else is dealt by class
    comp = links(docs, classes, sketch, modes)
    comp = classes.select("cid", "least").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    groups = comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = materialize(comp.join(groups, "comp").select("cid", "comp", "component_id"), "named")
    rows = sets_of.where("n > 0").select("doc_id", "n", "cid", *carry).join(named, "cid")
    alone = sets_of.where("n = 0").select("doc_id", "n", *carry, F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    return rows.select("doc_id", "n", *carry, "component_id", "comp").unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("comp").alias("class_id"), *carry)


#: Buckets of row names that a broadcast may list.
BUCKETS = 1 << 20


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One document of each component, that with the smallest id, in the columns of `docs`; texts without words all stay.

    Rows that go are named by 128 bits of all their columns. Most rows are in no bucket of such names (at most BUCKETS,
    which every task gets) and stay where they are; only the others' texts are shuffled, to a join on the whole names.
    Of rows that are equal in every column one stays.
    """
    rows = whole_rows(docs, "doc_id", "text")
    joined = materialize(join(rows, carry=("row_id",), **params).where("class_id is not null").select("class_id", "row_id", "doc_id"), "joined")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id"))
    best = joined.groupBy("class_id").agg(F.min_by(F.col("row_id"), order).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("class_id", "best")
    names = joined.join(best, "class_id").select("row_id", (F.col("row_id") == F.col("best")).cast("int").alias("stays"))
    names = materialize(names, "named-rows").groupBy("row_id").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    names = materialize(names.where("stays = 0 or times > 1").select("row_id", "stays"), "rows-to-drop")
    bucket = F.pmod(F.col("row_id.a"), F.lit(BUCKETS)).alias("bucket")
    listed = F.broadcast(names.select(bucket).distinct().withColumn("listed", F.lit(True)))
    rows = rows.select("row", "row_id", bucket).join(listed, "bucket", "left")
    asked = rows.where("listed").select("row", "row_id").join(names, "row_id", "left")
    out = rows.where("listed is null").select("row").unionByName(asked.where("stays is null").select("row"))
    out = out.unionByName(asked.where("stays = 1").dropDuplicates(["row_id"]).select("row"))
    return out.select("row.*")
