"""Language-model scores: online logistic mixing of hashed-context bit predictors.

A text is its words (A-Z in lower case, split at ASCII white space), each with a space behind, and an end mark. Where
the corpus has seen words behind the last two (in a training text twice or more, as once may be the text itself), the
first decision is whether one of those follows again; if so, their counts name it. Any other word is spelt: its bytes by Huffman codes of the corpus, one after each byte, so
likely bytes take few binary decisions. For each decision every predictor looks up a context (the last three or five
bytes, or all, of the word so far) in a table of bit counts; the log-odds it finds are mixed with weights that a gate
picks by how sure the predictors are, and a table refines the mixed odds. Weights are learnt by online gradient steps;
within each text its own steps go on, from the same start for every text, at first every few words: they move the
weight of each predictor, a bias before the refinement and the odds of the first decision. The sum of the decisions'
log-probabilities is the text's; over the bytes it gives bits per byte.

Tables hold the counts of all training documents but one of 28; those left out, which the tables have not seen, set
the weights and the refinement. Tables are Spark groups by ranges of keys, with an entry for each context and decision
that the corpus has, so they grow with it; each block asks the ranges for what its words and contexts have. As a
spelling depends on the word alone, a block looks up each distinct word once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import words as W
from chronoweave.llm.common import buffers, fold, gathered, give_back, materialize, packed_rows, pieces, tree_sum

HELD_OUT, FOLDS = 2, 7
#: Mark of the training documents that set weights: a part of a fold, one document of 28.
WEIGHTS_FOLD, WEIGHTS_PART, WEIGHTS = 5, 4, 100
#: Bits of a context's hash beyond those that pick its range; a key is the hash and, in 16 bits more, what follows.
CONTEXT_BITS = 28
#: Bytes of text for which a kind of question gets a range of its own, and the fewest ranges.
RANGE, LEAST_RANGES = 16 << 20, 64
#: Predictors of spelling see the last 3 or 5 bytes of the word so far, or all of it.
REACH = (3, 5, None)
K = len(REACH)
#: Kinds of questions beside the predictors': words' counts, and followers of pairs of words.
VOCABULARY, LONG = K, K + 1
#: A follower counts as seen from this many times on: in a training text, where once may be the text itself, and in others.
TWICE, ONCE = 2, 1
#: Kinds of blocks, the last two bits of a block's number: of training texts, of those that set weights, and of held-out ones.
TRAINING, WEIGHING, HELD = 0, 1, 2
#: Parts of a unit in the weights' sums, which are of whole numbers, so that no order of adding changes them.
FIXED = 1 << 20
#: Bits of the hashes of a pair of words, beyond those that pick its range, and of the word behind it.
PAIR_BITS, TAIL_BITS = 25, 16
#: Gates of the predictors; of the first decision by how often a pair was seen, and by that and how the last two such decisions of the text went.
GATES, SEEN_GATES, PAST = 27, 5, 9
LONG_GATES = SEEN_GATES * PAST
PRIOR = 0.1
#: Steps of a unit in a table's log-odds; steps of mixed log-odds, from -12 to 12, in the refinement.
SCALE, REFINE = 16, 256
#: Words that the even shares of the two ways to a word count for at a text's start.
SHARE = 16
#: Words between two online steps of a text: the first, and the most.
STEP, MOST_STEP = 16, 128
#: Bytes of text in a block, and of a group of texts that are scored side by side.
BLOCK, SCORED = 8 << 20, 1 << 19
END, SPACE = 10, 32
U = np.uint64


# ---------------------------------------------------------------- arrays


def distinct(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of well mixed 64-bit numbers: the distinct ones in order, a place of each, and for every place which it is."""
    n = len(z)
    if not n:
        return z, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = U(max(1, (n - 1).bit_length()))
    y = z >> bits << bits
    y |= np.arange(n, dtype=np.uint64)
    y.sort()
    order = (y & U((1 << int(bits)) - 1)).astype(np.int64)
    ordered = z[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    keys = ordered[new]
    if np.any(keys[1:] <= keys[:-1]):  # two that differ in the low bits alone may have been mixed up
        return np.unique(z, return_index=True, return_inverse=True)
    which = np.empty(n, np.int64)
    which[order] = np.cumsum(new) - 1
    return keys, order[new], which


def by_high_bits(z: np.ndarray) -> np.ndarray:
    """Order of 64-bit numbers by all bits but as many low ones as it takes to number them."""
    bits = max(1, (max(len(z), 2) - 1).bit_length())
    y = z >> U(bits) << U(bits)
    y |= np.arange(len(z), dtype=np.uint64)
    y.sort()
    return (y & U((1 << bits) - 1)).astype(np.int64)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, n of them, one row after another."""
    out = np.repeat(start - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


def stretches(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row n values from its start on, a part of the rows at a time."""
    out, at = np.empty(int(n.sum()), values.dtype), 0
    for i in range(0, len(n), 1 << 18):
        part = values.take(spread(start[i : i + (1 << 18)], n[i : i + (1 << 18)]))
        out[at : at + len(part)] = part
        at += len(part)
    return out


def shrunk(x: np.ndarray) -> bytes:
    """Numbers, packed by their first bytes, their second bytes and so on."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def grown(raw: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def slabs(ends: np.ndarray, most: int):
    """Ranges of documents of at most `most` bytes, or of one longer document."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


# ---------------------------------------------------------------- blocks


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and stop of each text's words and of its end (hash 0, no bytes), and the number of each text's first (texts + 1)."""
    out, first, base = [], [np.zeros(1, np.int64)], 0
    for a, b in slabs(ends, 1 << 20):
        part, at = data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        starts, stops, f = W.spans(part, at, W.SPACE == 0)
        h = W.hashes(part, starts, stops)
        out.append((np.insert(h, f[1:], U(0)), np.insert(starts, f[1:], 0) + ends[a], np.insert(stops, f[1:], 0) + ends[a]))
        first.append(base + f[1:] + np.arange(1, len(f)))
        base = int(first[-1][-1])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return *(np.concatenate(x) for x in zip(*out, strict=True)), np.concatenate(first)


def spelt(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spellings of words, a space behind each, or an end mark where there are no bytes; and their ends (words + 1)."""
    size = stops - starts
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(ends[-1], SPACE, np.uint8)
    out[spread(ends[:-1], size)] = data[spread(starts, size)]
    out[ends[1:][size == 0] - 1] = END
    return out, ends


class Block:
    """Texts as numbers of distinct words."""

    def __init__(self, row: dict):
        self.no, self.ids = row["block"], row["ids"]
        self.folds, self.first = np.frombuffer(row["folds"], np.uint8), np.frombuffer(row["first"], np.int64)
        self.word = grown(row["word"], np.uint32).astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(grown(row["lengths"], np.uint64).astype(np.int64))])
        self.spelling = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["spelling"]), np.uint8)
        self.hash = np.where(np.diff(self.ends) == 1, U(0), W.hashes(self.spelling, self.ends[:-1], self.ends[1:] - 1))

    def counts(self, *left_out: int) -> np.ndarray:
        """How often each word is in the documents of other folds."""
        use = ~np.isin(self.folds, left_out)
        return np.bincount(self.word[np.repeat(use, np.diff(self.first))], minlength=len(self.hash))


FIELDS = "block long, ids array<string>, folds binary, first binary, word binary, lengths binary, spelling binary, size long, hist array<long>"
COLUMNS = [f.split()[0] for f in FIELDS.split(", ")]


def packed(docs: DataFrame) -> DataFrame:
    """Blocks of documents of one kind: ids (as text), folds, where texts begin, which words they have, the distinct words, and the training texts' counts of byte pairs.

    What weights are learnt from is dealt out and sorted by a hash of id and text, as learning goes in order: files and
    tasks have no part in it.
    """

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        filling = {kind: ([], [], []) for kind in (TRAINING, WEIGHING, HELD)}
        size = dict.fromkeys(filling, 0)

        def done(no, ids, folds, texts):
            data, ends = W.lower(np.frombuffer(b"".join(texts), np.uint8)), np.cumsum([0, *map(len, texts)])
            h, start, stop, first = tokens(data, ends)
            known, at, word = distinct(h)
            often = np.argsort(-np.bincount(word, minlength=len(known)), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(known), np.int64)
            rank[often] = np.arange(len(known))
            at, word = at[often], rank[word]
            spelling, edge = spelt(data, start[at], stop[at])
            length = np.diff(edge)
            count = np.bincount(word[np.repeat(np.array(folds) != HELD_OUT, np.diff(first))], minlength=len(known))
            hist = np.bincount(pairs(spelling, edge), np.repeat(count, length), 1 << 16).astype(np.int64)
            pack = zstandard.ZstdCompressor(level=1).compress(spelling.tobytes())
            values = [no, ids, bytes(folds), first.astype(np.int64).tobytes(), shrunk(word.astype(np.uint32)), shrunk(length.astype(np.uint64)), pack, int(length[word].sum()), hist]
            kinds = [pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 5, pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], COLUMNS)

        for piece in pieces(batches):
            data, ends = buffers(piece["text"])
            raw = data.tobytes()
            for i, (name, kind) in enumerate(zip(piece["id"].to_pylist(), piece["fold"].to_pylist(), strict=True)):
                text, of = raw[ends[i] : ends[i + 1]], {WEIGHTS: WEIGHING, HELD_OUT: HELD}.get(kind, TRAINING)
                if filling[of][0] and size[of] + len(text) > BLOCK:
                    yield done(4 * block + of, *filling[of])
                    block += 1
                    filling[of], size[of] = ([], [], []), 0
                for to, x in zip(filling[of], (name, kind, text), strict=True):
                    to.append(x)
                size[of] += len(text)
        for of in filling:
            if filling[of][0]:
                yield done(4 * block + of, *filling[of])
        filling.clear()
        give_back()

    mark = F.when((fold("doc_id", FOLDS) == WEIGHTS_FOLD) & (F.floor(fold("doc_id", FOLDS * WEIGHTS_PART) / FOLDS) == 0), WEIGHTS).otherwise(fold("doc_id", FOLDS))
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), mark.cast("int").alias("fold"), "text")
    weigh = rows.where(F.col("fold") == WEIGHTS).select("*", F.xxhash64("id", "text").alias("a"), F.xxhash64("text", "id").alias("b"))
    parts = max(1, -(-weigh.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // BLOCK))
    weigh = weigh.repartitionById(parts, F.pmod("a", F.lit(parts)).cast("int")).sortWithinPartitions("a", "b").select("id", "fold", "text")
    return rows.where(F.col("fold") != WEIGHTS).unionByName(weigh).mapInArrow(run, FIELDS)


# ---------------------------------------------------------------- code and contexts


def huffman(weights: np.ndarray) -> list[tuple]:
    """The path (inner node, bit) to each symbol in the cheapest binary tree."""
    heap = [(int(w), i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    tree, inner = {}, len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        tree[inner] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], inner, inner))
        inner += 1
    paths, stack = [()] * len(weights), [(heap[0][2], ())]
    while stack:
        at, path = stack.pop()
        if at < len(weights):
            paths[at] = path
        else:
            stack += [(tree[at][0], (*path, (at - len(weights), 0))), (tree[at][1], (*path, (at - len(weights), 1)))]
    return paths


def code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman code of the bytes after each byte, from counts of pairs (256 * byte before + byte).

    For each pair: the number of decisions and where they begin in the lists of all decisions' nodes (16 bits) and bits.
    """
    length, node, bit = np.zeros(1 << 16, np.int64), [], []
    for before in range(256):
        n = counts[before * 256 : before * 256 + 256]
        for byte, path in enumerate(huffman(np.maximum(n + 1, n.sum() >> 13))):
            length[before * 256 + byte] = len(path)
            node += [before * 256 + k + 1 for k, _ in path]
            bit += [b for _, b in path]
    return length, np.array(node, np.uint64), np.array(bit, np.int8), np.cumsum(length) - length


def pairs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """256 * the byte before + the byte, at each byte; before a word stands a space."""
    out = data.astype(np.int64)
    out[1:] += data[:-1].astype(np.int64) << 8
    heads = ends[:-1][np.diff(ends) > 0]
    out[heads] = data[heads].astype(np.int64) + (SPACE << 8)
    return out


def contexts(data: np.ndarray, ends: np.ndarray, ranges: int):
    """Hashes of each predictor's contexts at each byte, in the high bits, one predictor after another; nothing before a word's start is seen."""
    low = U(64 - CONTEXT_BITS - (ranges.bit_length() - 1))
    n, size = len(data), np.diff(ends)
    heads = ends[:-1][size > 0]
    # the eight bytes before each place, the nearest highest; those before its word's start are zero
    padded = np.concatenate([np.zeros(8, np.uint8), data])
    window = np.ndarray((n,), "<u8", padded, strides=(1,)).copy()
    for j in range(8):
        at = heads[size[size > 0] > j] + j
        window[at] &= U(((1 << 64) - 1) ^ ((1 << 8 * (8 - j)) - 1))
    del padded
    for k in REACH:
        if k:
            x = window >> U(8 * (8 - k))
            x += U(k)
            x *= U(W.BASE)
            x ^= x >> U(29)
            x *= U(0xBF58476D1CE4E5B9)
        else:
            s = W.prefix_sums(data)
            x = s[:-1] - np.repeat(s[ends[:-1]], size)
            del s
            x *= np.repeat(W.powers(W.INVERSE, n + 1)[ends[:-1]], size)
            x ^= x >> U(31)
            x *= U(0x94D049BB133111EB)
        x >>= low
        x <<= low
        yield x


def decisions(symbols: np.ndarray, book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of pairs, all decisions: the byte each belongs to, its node and its bit."""
    length, node, bit, start = book
    n = length[symbols]
    flat = spread(start[symbols], n)
    return np.repeat(np.arange(len(symbols)), n), node.take(flat), bit.take(flat)


class Cases:
    """The distinct contexts with the byte that follows, for one predictor and the words of a block: in order, and which each byte has."""

    def __init__(self, context: np.ndarray, symbols: np.ndarray):
        key = context | symbols.astype(np.uint64)
        _, place, which = distinct(W.mix(key))
        key = key[place]
        del place
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        self.key, self.which = key[order], rank[which]


class Followers:
    """Each word with the two before it in its text: the distinct ones by ranges of the two words' hashes, and which each word has."""

    def __init__(self, block: Block, ranges: int):
        h = block.hash[block.word]
        before = np.empty_like(h)
        before[1:], before[block.first[:-1]] = h[:-1], U(1)
        pair = np.empty_like(h)
        pair[1:], pair[block.first[:-1]] = before[:-1], U(2)
        pair = W.mix(pair)
        before *= U(W.BASE)
        pair += before
        del before
        pair = W.mix(pair)
        h *= U(0xD6E8FEB86659FD93)
        h += pair
        key, place, which = distinct(W.mix(h))
        del h
        pair, bits = pair[place], U(ranges.bit_length() - 1)
        order = by_high_bits(pair)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        self.which = rank[which]
        self.range = (pair[order] >> U(64) - bits).astype(np.int64)
        self.key = (pair[order] << bits) >> U(64 - PAIR_BITS) << U(TAIL_BITS) | key[order] >> U(64 - TAIL_BITS)


# ---------------------------------------------------------------- tables

#: A state is how often a slot was seen, in 8 steps, and which odds it had, in 32.
SEEN = np.array([1, 2, 3, 5, 9, 17, 65])


def states(n: np.ndarray) -> np.ndarray:
    """The states of slots with counts (zeros, ones)."""
    often = np.searchsorted(SEEN, n.sum(1), "right")
    odds = np.clip(np.rint(2 * np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR))), -16, 15) + 16
    return (often * 32 + odds).astype(np.uint8)


def state_odds(hits: np.ndarray) -> np.ndarray:
    """Log-odds that each predictor's states stand for, by what followed them (K, 256, 2), drawn to the odds they name."""
    name = 1 / (1 + np.exp(-(np.arange(256) % 32 - 16) / 2))
    p = (hits[:, :, 1] + 4 * name) / (hits.sum(2) + 4)
    return np.log(p / (1 - p)).astype(np.float32)


#: Steps of a unit in the log-odds that a pair's followers go on, from -8 to 8, and of a bit in what it costs to name one.
LISTED, NAMED = 2.4, 8


def listing(listed: np.ndarray, every: np.ndarray) -> np.ndarray:
    """How a pair of words stands, from the counts of followers seen TWICE or more and of all: 0 if there are none of the first, else gate and log-odds."""
    odds = np.clip(np.log((listed + 0.1) / (np.maximum(0, every - listed) + 0.4)), -8, 8)
    gate = np.minimum(SEEN_GATES - 1, np.log2(np.maximum(1, every)).astype(np.int64) // 2)
    return np.where(listed > 0, 1 + gate * 40 + np.rint((odds + 8) * LISTED), 0).astype(np.uint8)


def naming(again: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """What it costs to name a follower, in eighths of a bit and rounded up, so that the followers' shares add up to one at most; 0 for those that are not listed."""
    bits = np.log2(np.maximum(1, listed) / np.maximum(1, again))
    return np.where(again > 0, 1 + np.minimum(254, np.ceil(bits * NAMED - 1e-9)), 0).astype(np.uint8)


def followers(pair: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
    """`listing` of each key's pair and `naming` of its follower (2, keys), where one counts as seen from `least` times on; a part of the keys at a time."""
    again = np.where(count >= least, count, 0)
    listed, out = np.bincount(pair, again), np.empty((2, len(pair)), np.uint8)
    state = listing(listed, np.bincount(pair, count))
    for i in range(0, len(pair), 1 << 17):
        part = slice(i, i + (1 << 17))
        out[0, part], out[1, part] = state[pair[part]], naming(again[part], listed[pair[part]])
    return out


def ranges_for(total: int) -> int:
    """Ranges of keys of each kind of question, a power of two that grows with the corpus."""
    return max(LEAST_RANGES, 1 << max(0, -(-total // RANGE) - 1).bit_length())


def asked(blocks: DataFrame, ranges: int) -> DataFrame:
    """A block's questions by kind and range of keys, with its own counts of each key."""
    edges = np.arange(1, ranges, dtype=np.uint64) << U(64 - (ranges.bit_length() - 1))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                symbols, times = pairs(block.spelling, block.ends), np.repeat(block.counts(HELD_OUT, WEIGHTS), np.diff(block.ends))
                hashes = contexts(block.spelling, block.ends, ranges)
                for kind in (*range(K), VOCABULARY, LONG):
                    if kind < K:
                        cases = Cases(next(hashes), symbols)
                        key, count = cases.key, np.bincount(cases.which, times, len(cases.key))
                        cut = np.searchsorted(key, edges)
                    elif kind == VOCABULARY:
                        order = np.argsort(block.hash)
                        key, count = block.hash[order], block.counts(HELD_OUT)[order]
                        cut = np.searchsorted(key, edges)
                    else:
                        after = Followers(block, ranges)
                        use = np.repeat(~np.isin(block.folds, (HELD_OUT, WEIGHTS)), np.diff(block.first))
                        key, count = after.key, np.bincount(after.which[use], minlength=len(after.key))
                        cut = np.searchsorted(after.range, np.arange(1, ranges))
                    cut, count = [0, *cut.tolist(), len(key)], count.astype(np.uint64)
                    full = [r for r in range(ranges) if cut[r] < cut[r + 1]]
                    parts = [[shrunk(np.diff(key[cut[r] : cut[r + 1]], prepend=U(0))) for r in full], [shrunk(count[cut[r] : cut[r + 1]]) for r in full]]
                    yield pa.RecordBatch.from_arrays([pa.array([kind * ranges + r for r in full], pa.int32()), pa.array([block.no] * len(full), pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], ["part", "block", "keys", "counts"])
                del block, symbols, times, hashes, cases, after, use, order, key, count, parts
                give_back()

    return blocks.drop("hist").mapInArrow(run, "part int, block long, keys binary, counts binary")


def tables(blocks: DataFrame, book, ranges: int) -> DataFrame:
    """block, part, data: what the counts of all blocks answer to each block's questions, key by key.

    Predictors answer the state of every decision that spells the byte; the vocabulary answers counts, and -1 as the
    block has its number of tokens and of distinct ones; pairs of words answer how they stand (`listing`) and what the
    word behind them costs to name (`naming`).
    """
    shared = blocks.sparkSession.sparkContext.broadcast(book)

    def run(group: pa.Table) -> pa.Table:
        give_back()  # what the group before left
        kind = group["part"][0].as_py() // ranges
        keys = [np.cumsum(grown(x.as_py(), np.uint64), dtype=np.uint64) for x in group["keys"]]
        at = np.cumsum([0, *map(len, keys)])
        keys = np.concatenate(keys)
        _, place, which = distinct(W.mix(keys))
        key, blocks, extra = keys[place], group["block"].to_pylist(), []
        del keys
        count = np.bincount(which, np.concatenate([grown(x.as_py(), np.uint64).astype(np.float64) for x in group["counts"]]), len(place))
        if kind < K:
            symbols = (key & U(0xFFFF)).astype(np.int64)
            owner, node, bit = decisions(symbols, shared.value)
            slot, _, of = distinct(W.mix(key[owner] >> U(16) << U(16) | node))
            ones, every = np.bincount(of, count[owner] * bit, len(slot)), np.bincount(of, count[owner], len(slot))
            state, size = states(np.stack([every - ones, ones], 1))[of], shared.value[0][symbols]
            start = np.cumsum(size) - size
            data = [shrunk(state.take(spread(start[w], size[w]))) for w in np.split(which, at[1:-1])]
        elif kind == VOCABULARY:
            data = [shrunk(count.astype(np.uint64)[w]) for w in np.split(which, at[1:-1])]
            blocks, extra = [*blocks, -1], [shrunk(np.array([count.sum(), np.count_nonzero(count)]).astype(np.uint64))]
        else:
            del place
            pair = distinct(W.mix(key >> U(TAIL_BITS)))[2]
            del key
            answer = {least: followers(pair, count, least) for least in {TWICE if block % 4 == TRAINING else ONCE for block in blocks}}
            data = [shrunk(answer[TWICE if block % 4 == TRAINING else ONCE][:, w].ravel()) for block, w in zip(blocks, np.split(which, at[1:-1]), strict=True)]
        return pa.table([pa.array(blocks, pa.int64()), pa.array([group["part"][0].as_py()] * len(blocks), pa.int32()), pa.array([*data, *extra], pa.binary())], names=["block", "part", "data"])

    return asked(blocks, ranges).groupBy("part").applyInArrow(run, "block long, part int, data binary")


def answers(rows: pa.Table, ranges: int) -> list[list[bytes]]:
    """A block's answers by kind, in the order of ranges."""
    got = sorted(zip(rows["part"].to_pylist(), rows["data"].to_pylist(), strict=True))
    return [[x for part, x in got if part // ranges == kind] for kind in range(K + 2)]


def with_found(blocks: DataFrame, found: DataFrame, run, fields: str) -> DataFrame:
    """run(block, found) of each block and the answers to it."""
    return blocks.drop("hist").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, fields)


class Texts:
    """A block with what the tables answer: for each decision in the spelling of a word every predictor's state and the bit, and what is known of each word's place."""

    def __init__(self, row: dict, found: list[list[bytes]], book, ranges: int):
        self.block = block = Block(row)
        symbols = pairs(block.spelling, block.ends)
        n = book[0][symbols]
        self.bit = stretches(book[2], book[3][symbols], n)
        self.start = np.concatenate([[0], np.cumsum(n)])[block.ends]  # of each word's decisions
        self.state = np.empty((K, len(self.bit)), np.uint8)
        for k, context in enumerate(contexts(block.spelling, block.ends, ranges)):
            cases = Cases(context, symbols)
            size = book[0][(cases.key & U(0xFFFF)).astype(np.int64)]
            state = np.concatenate([np.zeros(0, np.uint8), *(grown(x, np.uint8) for x in found[k])])
            self.state[k] = stretches(state, (np.cumsum(size) - size)[cases.which], n)
            del cases, size, state
        self.count = np.zeros(len(block.hash), np.int64)
        self.count[np.argsort(block.hash)] = np.concatenate([np.zeros(0, np.uint64), *(grown(x, np.uint64) for x in found[VOCABULARY])])
        which, rows = Followers(block, ranges).which, [grown(x, np.uint8).reshape(2, -1) for x in found[LONG]]
        self.listing, self.naming = (np.concatenate([np.zeros(0, np.uint8), *(r[i] for r in rows)])[which] for i in range(2))

    def groups(self):
        """Ranges of texts to score side by side."""
        size = np.concatenate([[0], np.cumsum(np.diff(self.block.ends)[self.block.word])])[self.block.first]
        return slabs(size, SCORED)


# ---------------------------------------------------------------- mixing


def start_weights() -> np.ndarray:
    """Weights of the predictors by gate, and weight and bias of the first decision by gate."""
    followed = np.tile(np.array([-1.0, 1.0, 0.0])[np.arange(PAST) % 3] + np.array([-0.5, 0.5, 0.0])[np.arange(PAST) // 3], SEEN_GATES)
    return np.concatenate([np.full(K * GATES, 1.2 / K), np.ones(LONG_GATES), followed]).astype(np.float32)


def past(listing: np.ndarray, naming: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each place with a first decision, how the two before it in its text went: 3 * the earlier + the later one, each 0 (not followed), 1 or 2 (there was none)."""
    at = np.flatnonzero(listing)
    went, text = (naming[at] > 0).astype(np.uint8), np.searchsorted(first, at, "right")
    out = np.full(len(listing), 8, np.uint8)
    last, earlier = np.full(len(at), 2, np.uint8), np.full(len(at), 2, np.uint8)
    last[1:] = np.where(text[1:] == text[:-1], went[:-1], 2)
    earlier[2:] = np.where(text[2:] == text[:-2], went[:-2], 2)
    out[at] = 3 * earlier + last
    return out


def lanes(first: np.ndarray):
    """All texts side by side, a run of words of each at a time: the texts, how many words of each, and their places."""
    size, at, step = np.diff(first), 0, STEP
    while at < size.max(initial=0):
        live = np.flatnonzero(size > at)
        take = np.minimum(step, size[live] - at)
        yield live, take, spread(first[:-1][live] + at, take)
        at, step = at + step, min(2 * step, MOST_STEP)


#: Which of three levels a log-odds' size is at, for every int8.
LEVEL = np.array([(abs(i) > 0.7 * SCALE) + (abs(i) > 2.5 * SCALE) for i in [*range(128), *range(-128, 0)]], np.int16)


KNOWN = np.dtype([("mixed", np.float32), *((f"s{k}", np.int8) for k in range(K)), ("which", np.uint8)])


class Mixer:
    """Mixes and learns over the texts of a block.

    Without `refine` the weights follow all texts. With it, every text starts from the weights given and takes its own
    steps, and the probability of a decision is what the refinement says of the gate and mixed log-odds. With `plainly` too, the
    bits of each distinct word by its count alone, a word that is spelt has a share of that probability and a share of the
    mixed one; shares are the text's own, by which of the two has done better in it so far.
    """

    def __init__(self, texts: Texts, odds: np.ndarray, weights: np.ndarray, refine: np.ndarray | None, rate: float, plainly: np.ndarray | None = None):
        self.plainly = plainly
        self.texts, self.refine, self.rate = texts, refine, rate
        self.weights = weights.astype(np.float64).copy()
        self.odds = odds
        self.seen, self.used, self.used_long = np.zeros((GATES * REFINE, 2)), np.zeros(GATES), np.zeros(LONG_GATES)
        t = texts
        if refine is not None:
            p = np.clip(refine, 1e-7, 1 - 1e-7)
            # what a decision costs and by how much it was missed, at each gate, step and bit
            self.price = (-np.log2(np.stack([1 - p, p], 1)) + 1j * np.stack([-p, 1 - p], 1)).ravel().astype(np.complex64)
            # all that is known of a decision, in eight bytes
            self.known = np.zeros(len(texts.bit), KNOWN)
            for i in range(0, len(texts.bit), 1 << 20):
                part = slice(i, i + (1 << 20))
                s, gate = self.found(part)
                self.known["mixed"][part], self.known["which"][part] = self.plain(s, gate), gate * 2 + texts.bit[part]
                for k in range(K):
                    self.known[f"s{k}"][part] = s[k]

    def found(self, at) -> tuple[list[np.ndarray], np.ndarray]:
        """What each predictor says of decisions, and their gates."""
        s = [self.odds[k].take(self.texts.state[k][at]) for k in range(K)]
        return s, sum(LEVEL.take(s[k].view(np.uint8)) * np.int16(3 ** (K - 1 - k)) for k in range(K))

    def plain(self, s: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Log-odds by the weights alone."""
        return sum((self.weights[k * GATES : (k + 1) * GATES] / SCALE).astype(np.float32).take(gate) * s[k] for k in range(K))

    def bits(self) -> np.ndarray:
        """Bits of each text."""
        first, total = self.texts.block.first, np.zeros(len(self.texts.block.folds))
        for a, b in self.texts.groups():
            self.group(first[a : b + 1], total[a:b])
        return total

    def group(self, first: np.ndarray, total: np.ndarray) -> None:
        t, n = self.texts, len(total)
        before = past(t.listing[first[0] : first[-1]], t.naming[first[0] : first[-1]], first - first[0])
        own, bias, bias0 = np.zeros((K, n), np.float32), np.zeros(n, np.float32), np.zeros(n)
        better, tried = np.full(n, SHARE / 2.0), np.full(n, float(SHARE))
        for live, take, place in lanes(first):
            lane = np.repeat(np.arange(len(live)), take)
            spell = np.ones(len(place), bool)
            at = np.flatnonzero(t.listing[place])
            if len(at):
                i, who = place[at], lane[at]
                state, hit = t.listing[i].astype(np.int64) - 1, t.naming[i] > 0
                x, gate = state % 40 / LISTED - 8, state // 40 * PAST + before[i - first[0]]
                w, b = self.weights[K * GATES : K * GATES + LONG_GATES], self.weights[K * GATES + LONG_GATES :]
                p = 1 / (1 + np.exp(-np.clip(w[gate] * x + b[gate] + bias0[live[who]], -14, 14)))
                cost = -np.log2(np.where(hit, p, 1 - p))
                cost[hit] += (t.naming[i][hit] - 1.0) / NAMED
                total[live] += np.bincount(who, cost, len(live))
                spell[at[hit]] = False
                if self.refine is None:
                    c = np.bincount(gate, minlength=LONG_GATES)
                    step = 10 * self.rate / np.sqrt(np.maximum(1, c))
                    w += step * np.bincount(gate, (hit - p) * x, LONG_GATES) / 8
                    b += step * np.bincount(gate, hit - p, LONG_GATES)
                    self.used_long += c
                else:
                    bias0[live] += 0.5 * np.bincount(who, hit - p, len(live)) / np.sqrt(np.maximum(1, np.bincount(who, minlength=len(live))))
            word, lane = t.block.word[place[spell]], lane[spell]
            if not len(word):
                continue
            size = t.start[word + 1] - t.start[word]
            edge = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))  # where texts begin; they come in order
            who, flat = live[lane[edge]], spread(t.start[word], size)
            begin = (np.cumsum(size) - size)[edge]
            n = np.diff(np.append(begin, len(flat)))
            if self.refine is None:
                self.learn(flat, begin, who, total)
                continue
            known = self.known.view(np.uint64).take(flat).view(KNOWN)
            x, s = known["mixed"].copy(), [known[f"s{k}"].astype(np.float32) for k in range(K)]
            for k in range(K):
                x += np.repeat(own[k, who], n) * s[k]
            x += np.repeat(bias[who], n)
            np.clip(x, -11.9, 11.9, out=x)
            x *= np.float32(REFINE / 24)
            x += REFINE // 2
            cell = x.astype(np.int32)
            cell <<= 1
            which = known["which"]
            cell += (which >> 1).astype(np.int32) * (2 * REFINE) + (which & 1)
            price = self.price.take(cell)
            if self.plainly is None:
                total[who] += np.add.reduceat(price.real, begin, dtype=np.float64)
            else:
                of = live[lane]
                share = (better / tried)[of]
                plain = np.log2(share) - self.plainly[word]
                bits = -np.logaddexp2(plain, np.log2(1 - share) - np.add.reduceat(price.real, np.cumsum(size) - size, dtype=np.float64))
                total += np.bincount(of, bits, len(total))
                better += np.bincount(of, np.exp2(plain + bits), len(total))
                tried += np.bincount(of, minlength=len(total))
            error = price.imag.copy()
            step = (self.rate / np.sqrt(n)).astype(np.float32)
            for k in range(K):
                own[k, who] += step / SCALE * np.add.reduceat(error * s[k], begin) / SCALE
            bias[who] += step * np.add.reduceat(error, begin)

    def learn(self, flat: np.ndarray, begin: np.ndarray, who: np.ndarray, total: np.ndarray) -> None:
        bit = self.texts.bit.take(flat)
        s, gate = self.found(flat)
        gate, x = gate.astype(np.int64), np.clip(self.plain(s, gate), -11.9, 11.9)
        p = 1 / (1 + np.exp(-x))
        error, cell = bit - p, ((x + 12) * np.float32(REFINE / 24)).astype(np.int64) + gate * REFINE
        self.seen += np.bincount(cell * 2 + bit, minlength=2 * len(self.seen)).reshape(-1, 2)
        n = np.bincount(gate, minlength=GATES)
        step = self.rate / np.sqrt(np.maximum(1, n))
        for k in range(K):
            self.weights[k * GATES : (k + 1) * GATES] += step * np.bincount(gate, error * (s[k] * np.float32(1 / SCALE)), GATES)
        self.used += n
        total[who] -= np.add.reduceat(np.log2(np.where(bit, p, 1 - p)), begin, dtype=np.float64)


def summed(blocks: DataFrame, found: DataFrame, book, ranges: int, one, dtype: str, more) -> np.ndarray:
    """Sum of one(texts, book, more), an array of fixed size, over all blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((book, more))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        give_back()
        book, more = shared.value
        out = [one(Texts(row, answers(right, ranges), book, ranges), more) for row in left.to_pylist()]
        return pa.Table.from_batches([packed_rows([(0, TaskContext.get().partitionId(), x)]) for x in out], pa.schema([("part", pa.int32()), ("task", pa.int32()), ("data", pa.binary())]))

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return gathered(tree_sum(with_found(blocks, found, run, "part int, task int, data binary"), dtype, tasks=tasks), dtype)


def follow(texts: Texts, _) -> np.ndarray:
    """What follows each predictor's states in the texts."""
    times = np.repeat(np.bincount(texts.block.word, minlength=len(texts.block.hash)), np.diff(texts.start))
    return np.stack([np.bincount(texts.state[k].astype(np.int64) * 2 + texts.bit, times, 512) for k in range(K)]).astype(np.int64).ravel()


def learnt(texts: Texts, more) -> np.ndarray:
    """Weights after the texts, times how often they were used, and what followed the mixed odds."""
    odds, first, rate = more
    mixer = Mixer(texts, odds, first, None, rate)
    mixer.bits()
    used = np.concatenate([np.tile(mixer.used, K), np.tile(mixer.used_long, 2)])
    return np.concatenate([np.rint(mixer.weights * used * FIXED), used, mixer.seen.ravel()]).astype(np.int64)


def fit(blocks: DataFrame, found: DataFrame, book, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds (int8) of all states, weights, and the refinement, from blocks that the tables haven't seen.

    Weights are learnt online through each block's texts and averaged by use; then what follows the odds that they mix
    makes the refinement.
    """
    hits = summed(blocks, found, book, ranges, follow, "int64", None)
    odds = np.clip(np.rint(state_odds(hits.reshape(K, 256, 2) if len(hits) else np.zeros((K, 256, 2))) * SCALE), -127, 127).astype(np.int8)
    weights, refine = start_weights(), refinement(np.zeros((GATES * REFINE, 2)))
    for rate in (0.02, 0.001):
        got = summed(blocks, found, book, ranges, learnt, "int64", (odds, weights, rate))
        if not len(got):
            break
        total, used, seen = np.split(got.astype(np.float64), [len(weights), 2 * len(weights)])
        total /= FIXED
        prior = np.repeat([2000.0, 20.0], [K * GATES, 2 * LONG_GATES])  # decisions that the first weights count for
        weights = ((total + prior * weights) / (used + prior)).astype(np.float32)
        refine = refinement(seen.reshape(-1, 2))
    return odds, weights, refine


def refinement(seen: np.ndarray, reach: int = 2) -> np.ndarray:
    """Probability of a 1 at each gate and step of mixed log-odds, counted over steps nearby and drawn to what the step says."""
    near = seen.reshape(GATES, REFINE, 2)
    wide = np.pad(near, ((0, 0), (reach, reach), (0, 0)))
    near = sum(wide[:, i : i + REFINE] for i in range(2 * reach + 1)).reshape(-1, 2)
    base = np.tile(1 / (1 + np.exp(-((np.arange(REFINE) + 0.5) * (24 / REFINE) - 12))), GATES)
    return ((near[:, 1] + 30 * base) / (near.sum(1) + 30)).astype(np.float32)


# ---------------------------------------------------------------- scores


def score(docs: DataFrame, *, rate: float = 0.02) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every document.

    Learns from the documents whose fold is not 2. base_score is the add-one unigram model of the training tokens, over
    the vocabulary and one unknown token; score is the mixed model's, both log10 probabilities of the same spelling.
    Null and empty texts are their end alone; repeated rows are scored each; with no training documents every decision
    is even. An empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    blocks = materialize(packed(docs), "lm-blocks")
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    seen = {r["i"]: r["n"] for r in blocks.select(F.posexplode("hist").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("n")).where("n > 0").collect()}  # 65536 rows at most
    book = code(np.array([seen.get(i, 0) for i in range(1 << 16)], np.int64))
    ranges = ranges_for(total)
    found = materialize(tables(blocks, book, ranges), "lm-tables")
    odds, weights, refine = fit(blocks.where(f"block % 4 = {WEIGHING}"), found.where(f"block % 4 = {WEIGHING}"), book, ranges)
    sizes = found.where("block = -1").select("data").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([int(x) for x in col], pa.int64()) for col in zip(*(grown(d.as_py(), np.uint64) for d in b["data"]), strict=True)], ["n", "v"]) for b in batches if b.num_rows), "n long, v long")
    n_train, v_train = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast((book, odds, weights, refine))
    fields = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
    names = [f.split()[0] for f in fields.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        book, odds, weights, refine = shared.value
        out = []
        for row in left.to_pylist():
            texts = Texts(row, answers(right, ranges), book, ranges)
            block, n = texts.block, len(texts.block.folds)
            doc = W.doc_of(block.first)
            base = np.bincount(doc, np.log10((texts.count + 1) / (n_train + v_train + 1))[block.word], n)
            known = np.bincount(doc, (texts.count > 0)[block.word], n).astype(np.int64)
            size = np.bincount(doc, np.diff(block.ends)[block.word], n).astype(np.int64)
            # a training text's words have one use less, its own
            uses = np.maximum(0, texts.count - (block.no % 4 == TRAINING))
            with np.errstate(divide="ignore"):
                plainly = -np.log2(uses / max(1, n_train))
            bits = Mixer(texts, odds, weights, refine, rate, plainly).bits()
            out.append(pa.table([pa.array(x, t) for x, t in zip((block.ids, block.folds == HELD_OUT, np.diff(block.first), known, np.full(n, n_train), base, -bits * np.log10(2), size), kinds, strict=True)], names=names))
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, kinds, strict=True))).empty_table()

    done = with_found(blocks, found.where("block >= 0"), run, fields)
    return done.select(F.col("id").cast(id_type).alias("doc_id"), *names[1:], (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
