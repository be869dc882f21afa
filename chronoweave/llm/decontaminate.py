"""Benchmark decontamination with suffix arrays over the training texts.

The benchmark is the stated query set: it is cut into blocks of bounded size, and each block goes to every task. A
task takes the words of a MB of documents as a shard and sorts the shard's suffixes, but for those whose first
three words begin no test suffix. Every test suffix is binary-searched in this suffix array; neighbouring finds join to
the longest verbatim matches with their places, and these say which words are hit, by which items, and which documents
go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm import words as W
from chronoweave.llm.common import buffers, fresh, materialize, pieces, trimmed

#: Bits of the table that says quickly that no test suffix begins so, and the words that it looks at.
FILTER_BITS, PREFIX = 22, 3
#: Bytes of text whose suffixes are sorted at a time.
SLICE = 1 << 20
#: Matches of a window that are joined to longest ones at a time, or those of one document.
JOINED = 1 << 20
LEAK = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
LEAK_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64())])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the number of the first word of each row (rows + 1)."""
    data, offsets = buffers(column)
    data = W.lower(data)
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    return W.hashes(data, starts, ends), first


def keys(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n words from each place as fixed-width byte strings, which sort as suffixes do up to n words."""
    rows = h[at[:, None] + np.arange(n)].astype(">u8")
    return np.ascontiguousarray(rows).view(f"V{8 * n}").reshape(-1).view(f"S{8 * n}")


class Block:
    """Test suffixes of some items, by window length: the sorted distinct ones, which items have each and where, and how they begin."""

    def __init__(self, items: list[str], texts: list[bytes], window: int):
        h, first = word_hashes(pa.array(texts, pa.binary()))
        self.items, self.by_length = items, {}
        counts = np.diff(first)
        for n in sorted({min(window, int(c)) for c in counts if c}):
            use = np.flatnonzero(counts >= window) if n == window else np.flatnonzero(counts == n)
            at = np.concatenate([np.arange(first[i], first[i + 1] - n + 1) for i in use])
            item = np.repeat(use, counts[use] - n + 1)
            unique, which = np.unique(keys(h, at, n), return_inverse=True)
            order = np.argsort(which, kind="stable")
            begin = np.unique(W.grams(h, min(n, PREFIX))[at])
            may = np.zeros(1 << FILTER_BITS, bool)
            may[(begin >> W.U(64 - FILTER_BITS)).astype(np.int64)] = True
            self.by_length[n] = {"keys": unique, "starts": np.searchsorted(which[order], np.arange(len(unique) + 1)), "item": item[order], "place": (at - first[item])[order], "filter": np.packbits(may), "begin": begin}

    def matches(self, h: np.ndarray, first: np.ndarray):
        """(window length, places in h where a test suffix is found, in order, number of the suffix) for each length."""
        ends = np.repeat(first[1:], np.diff(first))
        for n, t in self.by_length.items():
            g = W.grams(h, min(n, PREFIX))
            may = np.flatnonzero(np.unpackbits(t["filter"])[(g >> W.U(64 - FILTER_BITS)).astype(np.int64)])
            may = may[may + n <= ends[may]]
            near = np.minimum(np.searchsorted(t["begin"], g[may]), len(t["begin"]) - 1)
            may = may[t["begin"][near] == g[may]]
            if not len(may):
                continue
            k = keys(h, may, n)
            suffixes = np.argsort(k, kind="stable")  # the suffix array of this shard
            ordered = k[suffixes]
            low, high = np.searchsorted(ordered, t["keys"], "left"), np.searchsorted(ordered, t["keys"], "right")
            found = np.repeat(np.arange(len(low)), high - low)
            at = may[suffixes[np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(len(found))]]
            order = np.argsort(at, kind="stable")
            yield n, at[order], found[order]

    def longest(self, h: np.ndarray, first: np.ndarray):
        """Arrays (document, item, word of the document, word of the item, words) of longest verbatim matches."""
        doc = W.doc_of(first)
        for n, at, found in self.matches(h, first):
            t = self.by_length[n]
            count = t["starts"][found + 1] - t["starts"][found]
            owner = doc[at]
            edge = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(at))  # where documents begin
            rows = np.concatenate([[0], np.cumsum(count)])[edge]
            a = 0
            while a < len(edge) - 1:
                b = max(a + 1, int(np.searchsorted(rows, rows[a] + JOINED, "right")) - 1)
                some = slice(edge[a], edge[b])
                row = np.repeat(np.arange(edge[a], edge[b]), count[some])
                place = np.arange(len(row)) - np.repeat(np.cumsum(count[some]) - count[some], count[some]) + t["starts"][found[row]]
                d, item, p, q = owner[row], t["item"][place], at[row] - first[owner[row]], t["place"][place]
                order = np.lexsort((p, q - p, item, d))
                d, item, p, q = d[order], item[order], p[order], q[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (q[1:] - p[1:] != q[:-1] - p[:-1]) | (p[1:] != p[:-1] + 1)
                start = np.flatnonzero(new)
                yield d[start], item[start], p[start], q[start], np.diff(np.append(start, len(d))) + n - 1
                a = b


def blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """The benchmark in blocks of at most `block_bytes` of text, or one longer item; a null item_id is an empty one."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    for r in rows.toLocalIterator():
        text = bytes(r["text"])
        if ids and size + len(text) > block_bytes:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(text)
        size += len(text)
    yield Block(ids, texts, window)


def mark(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 2 << 20, column: str = "leak") -> DataFrame:
    """`docs` with a struct `column`: n_words, n_hit, n_items, items_sha256, contaminated, longest.

    A window is `window` consecutive words of an item, or all words of a shorter one; items without words have none.
    n_hit counts the words inside an occurrence of any window, n_items the items with one, longest the words of the
    longest verbatim match. Null texts have no words; repeated rows are marked each; empty tables on either side find
    nothing; other columns pass through untouched, but for one named as `column` in any case, which is replaced.
    The blocks are scanned one after another, with what earlier ones found kept in the rows.
    """
    spark, docs = docs.sparkSession, docs.drop(*(c for c in docs.columns if c.lower() == column.lower() and c not in ("doc_id", "text")))
    columns, carried = docs.columns, fresh(docs, f"_{column}_found")
    before = T._parse_datatype_string("spans binary, items array<string>, longest long")
    plain = T.StructType([*docs.schema.fields, T.StructField(carried, before)])
    out = T.StructType([*docs.schema.fields, T.StructField(column, T._parse_datatype_string(LEAK))])

    def scan(shared, last):
        def run(batches):
            block = shared.value
            for piece in pieces(batches, most=SLICE):
                h, first = word_hashes(piece["text"])
                edge = np.zeros(len(h) + 1, np.int32)
                owned, longest = [set() for _ in range(piece.num_rows)], np.zeros(piece.num_rows, np.int64)
                for i, had in enumerate(piece[carried].to_pylist()):
                    if had:
                        pairs = np.frombuffer(had["spans"], np.int64).reshape(-1, 2) + first[i]
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs[:, 1], -1)
                        owned[i].update(had["items"])
                        longest[i] = had["longest"]
                for d, item, p, _, size in block.longest(h, first):
                    np.add.at(edge, first[d] + p, 1)
                    np.add.at(edge, first[d] + p + size, -1)
                    np.maximum.at(longest, d, size)
                    for i, k in np.unique(np.stack([d, item], 1), axis=0).tolist():
                        owned[i].add(block.items[k])
                hit = np.cumsum(edge[:-1]) > 0
                if last:
                    yield pa.RecordBatch.from_arrays([*(piece[c] for c in columns), digests(hit, first, owned, longest)], [*columns, column])
                else:
                    found = pa.StructArray.from_arrays([packed_spans(hit, first), pa.array([sorted(x) for x in owned], pa.list_(pa.string())), pa.array(longest)], ["spans", "items", "longest"])
                    yield pa.RecordBatch.from_arrays([*(piece[c] for c in columns), found], [*columns, carried])

        return trimmed(run)

    rows = docs.withColumn(carried, F.lit(None).cast(before))
    held, done = None, 0
    for block in blocks(benchmark, window, block_bytes):
        if held is not None:
            rows, done = rows.mapInArrow(scan(held, False), plain), done + 1
            if done % 4 == 0:  # each scan is a Python worker of the same task
                rows = materialize(rows, "leaks")
        held = spark.sparkContext.broadcast(block)
    return rows.mapInArrow(scan(held, True), out)


def packed_spans(hit: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of hit words of each row, as pairs of int64."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8))).astype(np.int64).tobytes())
    return pa.array(out, pa.binary())


def digests(hit: np.ndarray, first: np.ndarray, owned: list[set], longest: np.ndarray) -> pa.Array:
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in owned]
    return pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in owned], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0, pa.bool_()), pa.array(longest)], fields=list(LEAK_TYPE))


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words of each longest verbatim match of at least a window: where it starts on either side and its length."""
    spark, fields = docs.sparkSession, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string, doc_word long, item_word long, n_words long"

    def scan(shared):
        def run(batches):
            block = shared.value
            for piece in pieces(batches, most=SLICE):
                for d, item, p, q, size in block.longest(*word_hashes(piece["text"])):
                    yield pa.RecordBatch.from_arrays([piece["doc_id"].take(pa.array(d)), pa.array([block.items[i] for i in item], pa.string()), pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        return trimmed(run)

    found = None
    for block in blocks(benchmark, window, block_bytes):
        part = docs.select("doc_id", "text").mapInArrow(scan(spark.sparkContext.broadcast(block)), fields)
        found = part if found is None else found.unionByName(part)
    return found


def report(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    return mark(docs.select("doc_id", "text"), benchmark, **params).select("doc_id", "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that no benchmark window occurs in, in the columns of `docs`."""
    name = fresh(docs, "_leak")
    return mark(docs, benchmark, column=name, **params).where(~F.col(name)["contaminated"]).select(*docs.columns)
