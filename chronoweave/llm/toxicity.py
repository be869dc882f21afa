"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its byte n-grams, with a mark on either end; n-grams are hashed into buckets with an embedding
each, and a document is the mean of its n-grams' embeddings. Misspelt words keep most of their n-grams and so most
of their vectors. As everything after the embeddings is linear, a trained model folds into one number per bucket,
and a document's score is a mean of table entries: whole texts are scored at tens of MB a second and core.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm import words as W
from chronoweave.llm.common import buffers, gathered, packed_rows, pieces, tree_sum, trimmed
from chronoweave.llm.labelled import held_out, prior, sample, seen_labels

GRAMS = (3, 4, 5, 6)
BITS = 16
_V32 = (W._VALUE >> np.uint64(17)).astype(np.uint32) | np.uint32(1)
#: What stands between a word and the space at its end must not matter: punctuation counts as space.
_FOLD = W._LOWER.copy()
_FOLD[[b for b in range(128) if not W.ALNUM[b]]] = 32


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all rows, and the row of each; a row's n-grams are those within its words and their end marks."""
    n = len(offsets) - 1
    b = np.full(len(data) + 2 * n, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    b[np.arange(len(data)) + 2 * row + 1] = _FOLD[data]
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    space, value = b == 32, _V32[b]
    h = value.copy()
    at = np.uint32(1)
    inner = np.zeros(len(b), bool)
    found, rows = [], []
    for k in range(1, max(GRAMS)):
        at = np.uint32(int(at) * 0x01000193 * 2 + 1 & 0xFFFFFFFF)
        h[:-k] += value[k:] * at
        if k > 1:
            inner[: len(b) - k + 1] |= space[k - 1 :]
        if k + 1 in GRAMS and len(b) > k:
            good = np.flatnonzero(~inner[: len(b) - k])
            g = h[good] * np.uint32(0x9E3779B1)
            g ^= g >> np.uint32(15)
            found.append((g * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS))
            rows.append(owner[good])
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def distinct_buckets(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the buckets that each row has, in order, and each row's number of n-grams."""
    bucket, row = gram_buckets(*buffers(piece["text"]))
    code, count = np.unique(row * (1 << BITS) + bucket.astype(np.int64), return_counts=True)
    return code >> BITS, code & ((1 << BITS) - 1), count, np.bincount(row, minlength=piece.num_rows)


def frequencies(docs: DataFrame, labels: DataFrame, label: str) -> np.ndarray:
    """For the classes 0 and 1, how many of all labelled documents have each bucket, and their number (2, buckets + 1)."""
    known = seen_labels(labels, label).where("label in (0, 1)").hint("merge")  # labels grow with the documents: never broadcast
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("label", "text")

    def run(batches):
        from pyspark import TaskContext

        seen = np.zeros((2, (1 << BITS) + 1), np.int64)
        for piece in pieces(batches, most=1 << 20):
            row, bucket, _, _ = distinct_buckets(piece)
            y = piece["label"].to_numpy()
            seen[:, -1] += np.bincount(y, minlength=2)
            for k in (0, 1):
                seen[k, :-1] += np.bincount(bucket[y[row] == k], minlength=1 << BITS)
        yield packed_rows([(0, TaskContext.get().partitionId(), seen.ravel())])

    tasks = max(48**2, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # asking for their number would run the join once more
    got = gathered(tree_sum(rows.mapInArrow(trimmed(run), "part int, task int, data binary"), "int64", tasks=tasks), "int64")
    # a join that Spark splits into more tasks than that leaves some sums, a part of the tasks each
    return got.reshape(-1, 2, (1 << BITS) + 1).sum(0)


def sparse_rows(docs: DataFrame, use: np.ndarray) -> DataFrame:
    """Label, number of n-grams, and those n-gram buckets of each document that are in `use` with their counts (packed as uint16 and uint32)."""
    shared = docs.sparkSession.sparkContext.broadcast(use)

    def run(batches):
        for piece in pieces(batches, most=1 << 20):
            row, bucket, count, total = distinct_buckets(piece)
            kept = shared.value[bucket]
            ends = np.searchsorted(row[kept], np.arange(piece.num_rows + 1))
            total = np.maximum(1, total)
            ids = bucket[kept].astype(np.uint16)
            count = count[kept].astype(np.uint32)
            cut = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece["label"], pa.array(total), pa.array([ids[c].tobytes() for c in cut], pa.binary()), pa.array([count[c].tobytes() for c in cut], pa.binary())], ["label", "total", "ids", "counts"])

    return docs.mapInArrow(trimmed(run), "label int, total long, ids binary, counts binary")


def informative(seen: np.ndarray, least: float) -> np.ndarray:
    """Buckets whose share of documents with them differs between the classes by `least` standard errors, of `frequencies`.

    The others can only be learnt by heart: their embeddings stay zero.
    """
    n, seen = np.maximum(1, seen[:, -1]).astype(float), seen[:, :-1]
    p = seen.sum(0) / n.sum()
    z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
    return (np.abs(z) >= least) & (seen.sum(0) >= 3)


def log_odds(seen: np.ndarray) -> np.ndarray:
    """How much likelier a document of class 1 has each bucket, as a logarithm."""
    share = (seen[:, :-1] + 0.5) / (seen[:, -1:] + 1)
    return np.log(share[1] / share[0])


def fill(table: np.ndarray, use: np.ndarray, trained: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The table in which buckets of `use` that the sample has not trained get what trained ones with their log-odds have on average."""
    slope = float(table[trained] @ odds[trained]) / max(1e-9, float(odds[trained] @ odds[trained]))
    return np.where(use & ~trained, slope * odds, table).astype(np.float32)


def train(rows: list, seen: np.ndarray, use: np.ndarray, *, dim: int = 8, steps: int = 1200, rate: float = 0.05, decay: float = 1e-3, batch: int = 64, seed: int = 5) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias, of embeddings and softmax trained together with Adam; the classes weigh the same."""
    rng = np.random.default_rng(seed)
    ids = [np.frombuffer(r["ids"], np.uint16) for r in rows]
    y = np.array([r["label"] for r in rows], np.int64)
    share = [(np.frombuffer(r["counts"], np.uint32) / r["total"]).astype(np.float32) for r in rows]
    ids = [i.astype(np.int64) for i in ids]
    weight = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))[y]
    emb, out, bias = (rng.normal(0, 0.1, (1 << BITS, dim)) * use[:, None]).astype(np.float32), rng.normal(0, 1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, out, bias)]
    step = 0
    for _ in range(-(-steps * batch // max(1, len(y)))):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            pick = order[start : start + batch]
            i, s = np.concatenate([ids[k] for k in pick]), np.concatenate([share[k] for k in pick])
            row = np.repeat(np.arange(len(pick)), [len(ids[k]) for k in pick])
            used, place = np.unique(i, return_inverse=True)
            bag = np.zeros((len(pick), len(used)), np.float32)
            bag[row, place] = s * 100  # shares are small; the factor keeps the steps in range
            hidden = bag @ emb[used]
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= (weight[pick] / len(pick))[:, None].astype(np.float32)
            grads = (bag.T @ (p @ out.T) + decay * emb[used], hidden.T @ p + decay * out, p.sum(0))
            step += 1
            for k, (param, grad, (m, v)) in enumerate(zip((emb, out, bias), grads, moments, strict=True)):
                at = used if k == 0 else slice(None)
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.99 * v[at] + 0.01 * grad * grad
                param[at] -= rate * m[at] / (1 - 0.9**step) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-6)
    trained = np.bincount(np.concatenate(ids), minlength=1 << BITS) > 0
    return fill((emb @ (out[:, 1] - out[:, 0])) * 100, use, trained, log_odds(seen)), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 2000, least: float = 4.0) -> tuple[np.ndarray, float]:
    """A model whose n-grams are chosen by all labelled documents and trained on at most `per_class` of each class; with fewer than two classes, the same score for all."""
    share = prior(labels, label)
    seen = frequencies(docs, labels, label)
    use = informative(seen, least)
    rows = [r.asDict() for r in sparse_rows(sample(docs, labels, label, per_class), use).repartition(8).toLocalIterator()]  # an eighth at a time
    base = float(np.log(share / (1 - share)))
    if len({r["label"] for r in rows}) < 2:
        return np.zeros(1 << BITS, np.float32), base
    rows.sort(key=lambda r: (r["label"], bytes(r["ids"]), bytes(r["counts"])))
    table, bias = train(rows, seen, use)
    return table, bias + base


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """`docs` and the probability of class 1 for each whole text. Null and empty texts get the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        table, bias = shared.value
        for piece in pieces(batches, most=1 << 20):
            bucket, row = gram_buckets(*buffers(piece["text"]))
            n = piece.num_rows
            mean = np.bincount(row, table[bucket], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(1 / (1 + np.exp(-np.clip(mean + bias, -60, 60))), pa.float64())], [*names, column])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; repeated rows are scored each, an empty table gives no rows."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **params))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **params) -> DataFrame:
    """The documents below the threshold, in the columns of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **params))

    def run(batches):
        table, bias = shared.value
        cut = np.log(threshold / (1 - threshold))
        for piece in pieces(batches, most=1 << 20):
            bucket, row = gram_buckets(*buffers(piece["text"]))
            n = piece.num_rows
            mean = np.bincount(row, table[bucket], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
            yield piece.filter(pa.array(mean + bias < cut))

    return docs.mapInArrow(trimmed(run), docs.schema)
