"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated odds.

Every word has a sparse ternary index vector, given by its hash. A word's vector is the sum of the index vectors of
itself and its neighbours over the whole corpus: each task sums its own documents and a tree adds the tasks' sums.
Words are hashed into a fixed number of rows, so the table's size is a parameter. A document is the mean of its
words' unit vectors. A small numpy network learns the label from a bounded sample, and a temperature fitted on
documents that the network didn't see turns its output into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm import words as W
from chronoweave.llm.common import buffers, gathered, packed_rows, pieces, tree_sum
from chronoweave.llm.labelled import held_out, sample

BITS, DIM, NONZERO, REACH = 15, 64, 4, 2
#: Parts of the table, which a tree of tasks adds up side by side.
PARTS = 8
_KIND = np.zeros(256, np.uint8)
_KIND[W.ALNUM] = 1
_KIND[65:91] = 1
_KIND[33:127][_KIND[33:127] == 0] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int32)
_LETTER[65:91] = _LETTER[97:123] = 1
#: Rows of the table for words in capitals and for a token that the one before it equals.
SHOUT, AGAIN = 0, 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the tokens of all texts and the number of each text's first one.

    A token is a run of letters and digits, in lower case, or a run of other printable characters; words of two and
    more capitals alone share one token, which says how they are written, and so do tokens that repeat the last one.
    """
    kind = _KIND[data]
    starts, ends, first = W.spans(kind, offsets, np.array([False] + [True] * 255))
    if not len(starts):
        return np.zeros(0, np.int64), first
    # cut runs further where letters meet other characters
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[[0, -1]] = True
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    on = kind[starts] > 0
    starts, ends = starts[on], ends[on]
    h = W.hashes(W.lower(data), starts, ends)
    upper, letter = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_LETTER[data])])
    capitals = upper[ends] - upper[starts]
    row = (h >> np.uint64(64 - BITS)).astype(np.int64)
    row[(capitals >= 2) & (capitals == letter[ends] - letter[starts])] = SHOUT
    first = np.searchsorted(starts, offsets)
    again = np.zeros(len(row), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(row)]] = False
    row[again] = AGAIN
    return row, first


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each table row's index vector."""
    rng = np.random.default_rng(seed)
    place = rng.random((1 << BITS, DIM)).argsort(1)[:, :NONZERO].astype(np.int64)
    return place, rng.choice([-1, 1], (1 << BITS, NONZERO)).astype(np.int8)


def context_sums(docs: DataFrame) -> np.ndarray:
    """The table: for each row, the sum of index vectors around its occurrences in all documents."""
    size = (1 << BITS) * DIM

    def run(batches):
        from pyspark import TaskContext

        place, sign = index_vectors()
        total = np.zeros(size, np.int64)
        for piece in pieces(batches):
            row, first = tokens(*buffers(piece["text"]))
            doc = W.doc_of(first)
            for step in range(REACH + 1):
                a, b = (row, row) if step == 0 else (row[:-step][doc[:-step] == doc[step:]], row[step:][doc[:-step] == doc[step:]])
                for k in range(NONZERO):
                    for x, y in [(a, b), (b, a)][: 1 + (step > 0)]:
                        total += np.bincount(x * DIM + place[y, k], sign[y, k], size).astype(np.int64)
        task = TaskContext.get().partitionId()
        for part, x in enumerate(np.split(total, PARTS)):
            yield packed_rows([(part, task, x)])

    parts = docs.select("text").mapInArrow(run, "part int, task int, data binary")
    got = gathered(tree_sum(parts, "int64"), "int64")
    return got.reshape(1 << BITS, DIM) if len(got) else np.zeros((1 << BITS, DIM), np.int64)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors, without what all words have in common; rows without words are zero."""
    v = sums.astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    used = norm[:, 0] > 0
    if used.any():
        v[used] -= v[used].mean(0)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    return v.astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text's words and, last, its number of words on a log scale; zero without words."""
    row, first = tokens(*buffers(column))
    count = np.diff(first)
    out = np.zeros((len(count), DIM + 1), np.float32)
    full = np.flatnonzero(count)
    step = 1 << 16  # documents in groups of about so many words, to bound the gathered vectors
    start = 0
    while start < len(full):
        stop = max(start + 1, int(np.searchsorted(first[full + 1] if len(full) else first, first[full[start]] + step, "right")))
        some = full[start:stop]
        out[some, :DIM] = np.add.reduceat(vectors[row[first[some[0]] : first[some[-1] + 1]]], first[some] - first[some[0]], axis=0) / count[some, None]
        start = stop
    out[:, DIM] = np.log1p(count) / 10
    return out


def forward(net: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of class 1."""
    x = (x - net["mean"]) / net["scale"]
    return np.tanh(x @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, batch: int = 64, seed: int = 3) -> dict:
    """Two layers fitted with Adam on the log-loss."""
    rng = np.random.default_rng(seed)
    net = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    x = (x - net["mean"]) / net["scale"]
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(())}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            i = order[start : start + batch]
            h = np.tanh(x[i] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[i]) / len(i)
            back = np.outer(d, p["w2"]) * (1 - h * h)
            grad = {"w1": x[i].T @ back + decay * p["w1"], "b1": back.sum(0), "w2": h.T @ d + decay * p["w2"], "b2": d.sum()}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                p[k] = p[k] - rate * (1 - epoch / epochs) * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net | p


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the log-odds with the least log-loss, of a fixed grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    return float(min(grid, key=lambda t: np.logaddexp(0, -(2 * y - 1) * logit / t).mean()))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, *, label: str = "quality", per_class: int = 6000) -> dict | float:
    """A network and its temperature from at most `per_class` documents of each class; the log-odds of the labels if they have one class only.

    The sample may not have the classes in the shares that all labels have; the difference is added to the log-odds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for piece in pieces(batches):
            x = pooled(piece["text"], shared.value)
            yield pa.RecordBatch.from_arrays([piece["label"], piece["calibrate"], pa.array([r.tobytes() for r in x], pa.binary())], ["label", "calibrate", "x"])

    picked = sample(docs, labels, label, per_class).withColumn("calibrate", F.xxhash64(F.lit("calibrate"), "doc_id") % 4 == 0)
    rows = picked.select("text", "label", "calibrate").mapInArrow(run, "label int, calibrate boolean, x binary").collect()
    counts = {r["y"]: r["count"] for r in labels.where(~held_out()).select(F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy("y").count().collect()}
    all_odds = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    rows.sort(key=lambda r: (r["calibrate"], r["label"], bytes(r["x"])))
    y, side = np.array([r["label"] for r in rows], float), np.array([r["calibrate"] for r in rows], bool)
    if len(set(y[~side])) < 2:
        return all_odds
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64)
    net = train(x[~side], y[~side])
    net["temperature"] = temperature(forward(net, x[side]), y[side])
    net["shift"] = all_odds - float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return net


def score(docs: DataFrame, vectors: np.ndarray, model: dict | float) -> DataFrame:
    """`docs` with `score`, the probability of class 1 of each whole text; null and empty texts have a vector of zeros."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))
    names = docs.columns

    def run(batches):
        known, net = shared.value
        for piece in pieces(batches):
            logit = np.full(piece.num_rows, net) if isinstance(net, float) else forward(net, pooled(piece["text"], known)) / net["temperature"] + net["shift"]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -60, 60))), pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; repeated rows are scored each, an empty table gives no rows."""
    docs = docs.select("doc_id", "text")
    vectors = word_vectors(context_sums(docs))
    scored = score(docs, vectors, fit(docs, labels, vectors, **params))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
