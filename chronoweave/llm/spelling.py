"""Spelling variants: words of a corpus that are one edit apart, and the frequent form that each rare one belongs to.

Counting: runs of letters are found and digested with numpy in each task and counted by Arrow, exactly, so that a task
sends one row a distinct word. Joining: an edit leaves one of a word's two even segments intact. Words index their
segments by length, and probe the segments of words as long and of words one shorter, whose second segment then stands
one place further on. Where a segment is shared by so many words that comparing them all would cost more, what is left
of those words is parted again by the same rule, as often as it takes, so that no key compares all pairs of a large
group. Candidates are verified on the whole words and deduplicated.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import buffers, materialize, pieces
from chronoweave.llm.words import lower, spans

#: Runs of more bytes are digested one at a time.
LONG = 64
#: Distinct words that a task gathers before it sends them on.
GATHERED = 1 << 19
#: A key is parted further when its comparisons are so many times its rows.
WORTH = 24
#: First byte of U+00C0 to U+00FF in UTF-8; it stands nowhere else.
LATIN = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[LATIN] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span as if it stood behind bytes whose crc32 is `before`."""
    state, size = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), ends - starts
    order = np.argsort(-size, kind="stable")
    falling, at, out = size[order], starts[order], state[order]
    first = int(np.searchsorted(-falling, -LONG, "left"))  # spans of more than LONG bytes
    raw = data.tobytes() if first else b""
    for i in range(first):
        out[i] = zlib.crc32(raw[at[i] : at[i] + falling[i]], int(out[i] ^ np.uint32(0xFFFFFFFF))) ^ 0xFFFFFFFF
    for j in range(int(falling[first]) if first < len(order) else 0):
        n = int(np.searchsorted(-falling, -j, "left"))  # spans of more than j bytes
        x = out[first:n]
        out[first:n] = _CRC[(x ^ data[at[first:n] + j]) & np.uint32(255)] ^ (x >> np.uint32(8))
    state[order] = out ^ np.uint32(0xFFFFFFFF)
    return state


def runs(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, and start, end and row of each run of at least `least` letters."""
    data, offsets = buffers(batch["text"])
    data = lower(data)
    marked = data.copy()
    marked[1:][(data[:-1] == LATIN)] = 97  # the second byte of a letter
    starts, ends, first = spans(marked, offsets, _LETTER)
    two = np.concatenate([[0], np.cumsum(data == LATIN)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = (ends - starts) - (two[ends] - two[starts]) >= least
    return data, starts[keep], ends[keep], row[keep]


def counts(batch: pa.RecordBatch, noise: int, least: int) -> pa.StructArray:
    """Distinct words of a batch and how often each occurs, after the letter that each noisy run loses is gone."""
    data, starts, ends, row = runs(batch, least)
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch["doc_id"].to_pylist()], np.uint32)
    h = digests(data, starts, ends, before[row])
    hit = h % np.uint32(noise) == 0 if noise else np.zeros(len(h), bool)
    raw, changed = data.tobytes() if hit.any() else b"", []
    for a, b, x in zip(starts[hit].tolist(), ends[hit].tolist(), h[hit].tolist(), strict=True):
        word = raw[a:b].decode()
        at = x % len(word)
        if len(word) > least:
            changed.append((word[:at] + word[at + 1 :]).encode())
    starts, ends = starts[~hit], ends[~hit]
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    kept = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    plain = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(kept.tobytes())])
    return pc.value_counts(pa.concat_arrays([plain, pa.array(changed, pa.large_binary())]))


def vocabulary(docs: DataFrame, *, noise: int = 199, least: int = 6, often: int = 5) -> DataFrame:
    """(word, n) of the words of at least `least` letters that occur at least `often` times in all texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where `noise` divides the crc32 of
    `<doc_id>:<word>`, the word loses the letter at that number modulo its length (`noise` 0: none does). Null texts have
    no words, a null doc_id counts as an empty one.
    """

    def run(batches):
        held, n = [], 0

        def summed():
            both = pa.table({"word": pa.concat_arrays([x.field(0) for x in held]), "n": pa.concat_arrays([x.field(1) for x in held])})
            return both.group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks()

        def sent(t):
            return [pa.RecordBatch.from_arrays([b["word"].cast(pa.binary()).cast(pa.string()), b["n"]], ["word", "n"]) for b in t.to_batches(max_chunksize=1 << 16)]

        for batch in pieces(batches):
            found = counts(batch, noise, least)
            held.append(found)
            n += len(found)
            if n >= 2 * GATHERED:
                t = summed()
                held, n = [pa.StructArray.from_arrays([t["word"].combine_chunks(), t["n"].combine_chunks()], ["values", "counts"])] if len(t) < GATHERED else [], len(t)
                if not held:
                    yield from sent(t)
                    n = 0
        if held:
            yield from sent(summed())

    words = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


INDEX, EQUAL, LONGER = 0, 1, 2


def parted(entries: DataFrame) -> DataFrame:
    """The two entries of each: one whose first half of the rest is intact, one whose second half is.

    An entry is a word with `a` to `b`, the part of it that may hold the edit; everything outside is in `key`. Halves are
    those of the shorter word of a pair: a LONGER word's second half stands one place further on.
    """
    m = F.col("b") - F.col("a") - (F.col("side") == LONGER).cast("int")
    half = F.floor(m / 2).cast("int")
    part = lambda no, at, size: F.xxhash64("key", F.lit(no), F.substring("word", at + 1, size))
    tail = F.col("b") - (m - half)
    first = F.struct(part(0, F.col("a"), half).alias("key"), (F.col("a") + half).alias("a"), F.col("b").alias("b"))
    second = F.struct(part(1, tail, m - half).alias("key"), F.col("a").alias("a"), tail.alias("b"))
    return entries.select("side", "word", "n", F.explode(F.array(first, second)).alias("to")).select("side", "word", "n", "to.*")


def near_pairs(words: DataFrame, *, worth: int = WORTH) -> DataFrame:
    """(r, r_n, s, s_n): all pairs of words (word, n) that one inserted, deleted or replaced letter turns into each other, once each.

    `s` is the longer word or, of two as long, the larger. Words are distinct; empty ones have no partner here.
    """
    size = F.length("word")
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.xxhash64((size - int(k == LONGER)).cast("int")).alias("key")) for k in (INDEX, EQUAL, LONGER))))
    entries = words.where(size > 0).select("word", "n", F.lit(0).alias("a"), size.alias("b"), sides.alias("x")).select("x.side", "word", "n", "x.key", "a", "b")
    found = []
    while True:
        entries = materialize(parted(entries), "spelling-entries")
        rows = lambda k: F.count_if(F.col("side") == k)
        keys = entries.groupBy("key").agg(rows(INDEX).alias("i"), F.count(F.lit(1)).alias("all"), F.max(F.when(F.col("side") == INDEX, F.col("b") - F.col("a"))).alias("rest"))
        # a key of one word and itself has no pair; one letter is all that may differ where one is left
        keys = keys.where((F.col("i") > 0) & (F.col("all") > 2)).withColumn("hot", (F.col("rest") > 1) & (F.col("i") * (F.col("all") - F.col("i")) > worth * F.col("all")))
        keys = materialize(keys.select("key", "hot"), "spelling-keys")
        index, probe = (entries.where(x) for x in (F.col("side") == INDEX, F.col("side") != INDEX))
        cold = keys.where(~F.col("hot")).select("key")
        r = index.join(cold, "key", "left_semi").select("key", F.col("word").alias("r"), F.col("n").alias("r_n"))
        s = probe.select("key", "side", F.col("word").alias("s"), F.col("n").alias("s_n"))
        close = ((F.col("side") == LONGER) | (F.col("r") < F.col("s"))) & (F.levenshtein("r", "s", 1) == 1)
        found.append(materialize(r.join(s, "key").where(close).select("r", "r_n", "s", "s_n").distinct(), "spelling-pairs"))
        if keys.where("hot").isEmpty():
            break
        entries = entries.join(keys.where("hot").select("key"), "key", "left_semi")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def forms(words: DataFrame, *, times: int = 5, worth: int = WORTH) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    A word's form is its near word of the largest n, the first in code-point order among several, if that n is `times`
    the word's own or more (`times` above 1). Its root is what forms lead to.
    """
    pairs = near_pairs(words, worth=worth)
    sides = pairs.selectExpr("r as word", "s as other", "s_n as m").unionByName(pairs.selectExpr("s as word", "r as other", "r_n as m"))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    met = F.col("best.less") * -1 >= times * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(met, F.col("best.other")).alias("form"), F.when(met, -F.col("best.less")).alias("form_n"))
    out = materialize(out, "spelling-forms")
    # n grows along forms, so that jumping from root to root ends after a few rounds
    jump = materialize(out.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = materialize(jump.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if jump.where("moved").isEmpty():
            break
        jump = jump.select("word", "root")
    return out.join(jump.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, *, noise: int = 199, least: int = 6, often: int = 5, times: int = 5) -> DataFrame:
    """`forms` of the `vocabulary` of documents.

    Null, empty and very long texts, null ids, repeated rows (each counts) and other columns are all taken as they come; an
    empty table gives no rows.
    """
    return forms(materialize(vocabulary(docs, noise=noise, least=least, often=often), "spelling-words"), times=times)
