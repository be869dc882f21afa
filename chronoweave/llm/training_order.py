"""Token-id output in training order: a keyed Feistel permutation gives every sequence its global slot.

Documents become sequences of a fixed number of token ids. The sequences are numbered without gaps in the order of a
hash of their document's id and text, whatever files these came in. A balanced Feistel network keyed by a seed permutes
the numbers (walking its cycles until a number is in range), and shard s holds the slots from s * shard_slots on, each of
the same number of bytes. Range partitions of several shards are written stripe by stripe; a reader finds any slot by
arithmetic and can go on from any slot, and a writer goes on from the shards that are there. Only numbers, not tokens, are
needed to know the whole order, so that tokens are dealt out once.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import materialize, pieces, shared_dir, trimmed
from chronoweave.llm.words import mix

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this public vocabulary splits text with before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Shards that a range partition holds at most, and files that tokens wait in at most.
SHARDS_A_PARTITION, MOST_BUCKETS = 32, 50_000
U = np.uint64


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1 given by the key, applied to any of its numbers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, keys = U((1 << half) - 1), mix(np.arange(1, rounds + 1, dtype=np.uint64) + U(key & (1 << 63) - 1) * U(64))
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> U(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << U(half) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def unfeistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The inverse of `feistel`."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, keys = U((1 << half) - 1), mix(np.arange(1, rounds + 1, dtype=np.uint64) + U(key & (1 << 63) - 1) * U(64))
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> U(half), out[todo] & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
        out[todo] = left << U(half) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_encodings: dict[int, object] = {}


def encoding(ranks: dict[bytes, int]):
    """One encoder a process."""
    if len(ranks) not in _encodings:
        import tiktoken

        _encodings[len(ranks)] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[len(ranks)]


def id_kind(ranks: dict[bytes, int]) -> str:
    """Ids and the end-of-text id behind them: 16-bit little-endian where the vocabulary allows, 32-bit otherwise."""
    return "<u2" if len(ranks) < 1 << 16 else "<u4"


def sequences(docs: DataFrame, *, tokenizer: str = TOKENIZER, seq_len: int = 512) -> DataFrame:
    """origin, place, a, b, doc_id, piece, n_tokens, ids of the sequences of all documents.

    A document's ids and one end-of-text id (the vocabulary's size) are cut every `seq_len`. Null and empty texts are
    the end-of-text id alone. a and b are hashes of id and text; origin and place are the task and the row in it.
    """
    ranks = read_ranks(tokenizer)
    end, kind, shared = len(ranks), id_kind(ranks), docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        from pyspark import TaskContext

        tool, origin, place = encoding(shared.value), TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            row, piece, size, ids = [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                x = np.array([*tool.encode_ordinary(text or ""), end], kind)
                for k, at in enumerate(range(0, len(x), seq_len)):
                    part = x[at : at + seq_len]
                    row.append(i)
                    piece.append(k)
                    size.append(len(part))
                    ids.append(part.tobytes())
            at = pa.array(row, pa.int32())
            named = [batch[c].take(at) for c in ("a", "b", "doc_id")]
            yield pa.RecordBatch.from_arrays([pa.array([origin] * len(row), pa.int32()), pa.array(np.arange(place, place + len(row))), *named, pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())], ["origin", "place", "a", "b", "doc_id", "piece", "n_tokens", "ids"])
            place += len(row)

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"origin int, place long, a long, b long, doc_id {doc_id}, piece int, n_tokens int, ids binary")


def kept_by_origin(made: DataFrame) -> tuple[DataFrame, str]:
    """Rows written to the shared folder in buckets by `origin`, so that a join by it moves none of them; and the table's name."""
    spark, name = made.sparkSession, f"sequences_{uuid.uuid4().hex}"
    buckets = max(1, min(MOST_BUCKETS, made.rdd.getNumPartitions()))
    made.write.bucketBy(buckets, "origin").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def dropped(spark: SparkSession, name: str) -> None:
    """Forget a table of `kept_by_origin` and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def slots(made: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """(origin, slots): the slots of an origin's rows by place; and how many there are.

    Numbers are ranks by (a, b, piece), found by ranges and running counts, so that no task has more than a range of these few
    numbers. Rows that are equal in all three are copies, which may change places.
    """
    order = ["a", "b", "piece", "origin", "place"]

    def count(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["origin"], b["place"], pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(n, n + b.num_rows))], ["origin", "place", "part", "number"])
            n += b.num_rows

    ranked = made.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, "origin int, place long, part int, number long")
    ranked = materialize(ranked, "sequence-numbers")
    counts = materialize(ranked.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "sequence-counts")
    n = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    starts = counts.select("part", (F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("start"))

    def permuted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["origin"], b["place"], pa.array(feistel(b["number"].to_numpy(), n, seed))], ["origin", "place", "slot"])

    placed = ranked.join(starts, "part").select("origin", "place", (F.col("start") + F.col("number")).alias("number")).mapInArrow(permuted, "origin int, place long, slot long")
    by = placed.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("place", "slot"))).alias("s"))
    return materialize(by.select("origin", F.col("s.slot").alias("slots")), "sequence-slots"), n


class Order:
    """The training order of documents: their sequences, kept where they were made, and a slot for each."""

    def __init__(self, docs: DataFrame, *, seed: int = 29, tokenizer: str = TOKENIZER, seq_len: int = 512, shard_slots: int = 4096):
        self.spark, self.seq_len, self.shard_slots = docs.sparkSession, seq_len, shard_slots
        ranks = read_ranks(tokenizer)
        self.end, self.kind = len(ranks), id_kind(ranks)
        self.stride = seq_len * np.dtype(self.kind).itemsize
        self.doc_id = docs.schema["doc_id"].dataType.simpleString()
        self.made, self.table = kept_by_origin(sequences(docs, tokenizer=tokenizer, seq_len=seq_len))
        self.slots, self.n = slots(self.made, seed)
        self.shards = -(-self.n // shard_slots)

    def rows(self, first: int = 0, last: int | None = None) -> DataFrame:
        """doc_id, piece, n_tokens, shard, slot, at, tokens of the sequences of shards from `first` to before `last`, shards in range partitions and slots in order.

        `at` is the byte in the shard and `tokens` the fixed-stride record, filled up with the end-of-text id.
        """
        last = self.shards if last is None else last
        shard = F.floor(F.col("slot") / self.shard_slots).cast("int")
        met = self.made.join(self.slots.hint("shuffle_hash"), "origin").withColumn("slot", F.expr("slots[cast(place as int)]"))
        met = met.where((F.col("slot") >= first * self.shard_slots) & (F.col("slot") < last * self.shard_slots)).select("doc_id", "piece", "n_tokens", shard.alias("shard"), "slot", "ids")

        def squeezed(batches):
            pack = zstandard.ZstdCompressor(level=1)
            for b in batches:
                yield b.set_column(5, "ids", pa.array([pack.compress(x.as_buffer()) for x in b["ids"]], pa.binary()))

        fields = f"doc_id {self.doc_id}, piece int, n_tokens int, shard int, slot long, ids binary"
        wide = max(1, min(SHARDS_A_PARTITION, (last - first) // int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        partitions = max(1, -(-(last - first) // wide))
        placed = met.mapInArrow(trimmed(squeezed), fields).repartitionById(partitions, F.floor((F.col("shard") - first) / wide).cast("int")).sortWithinPartitions("slot")
        end, kind, seq_len, stride, shard_slots = self.end, self.kind, self.seq_len, self.stride, self.shard_slots

        def fill(batches):
            open_ = zstandard.ZstdDecompressor()
            blank = np.full(seq_len, end, kind).tobytes()
            for b in batches:
                out = []
                for x in b["ids"]:
                    raw = open_.decompress(x.as_buffer(), max_output_size=stride)
                    out.append(raw + blank[len(raw) :])
                slot = b["slot"].to_numpy()
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["piece"], b["n_tokens"], b["shard"], b["slot"], pa.array(slot % shard_slots * stride), pa.array(out, pa.binary())], ["doc_id", "piece", "n_tokens", "shard", "slot", "at", "tokens"])

        return placed.mapInArrow(trimmed(fill), f"doc_id {self.doc_id}, piece int, n_tokens int, shard int, slot long, at long, tokens binary")

    def write(self, path: str, stripes: int = 1) -> None:
        """Write the shards under `path`, a stripe of range partitions after another; each stripe is there whole or not at all.

        Shards that are there already are not written again, so that a call goes on where an earlier one of the same order
        broke off.
        """
        wide = max(1, -(-self.shards // stripes))
        for first in range(0, self.shards, wide):
            last = min(first + wide, self.shards)
            there = shards_there(self.spark, path, first, last)
            if there < last - first:
                (write_shards if there else append_shards)(self.rows(first, last), path)

    def drop(self) -> None:
        dropped(self.spark, self.table)


def shards_there(spark: SparkSession, path: str, first: int, last: int) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return 0
    return spark.read.parquet(path).where((F.col("shard") >= first) & (F.col("shard") < last)).select("shard").distinct().count()


def training_order(docs: DataFrame, *, seed: int = 29, tokenizer: str = TOKENIZER, seq_len: int = 512, shard_slots: int = 4096) -> DataFrame:
    """doc_id, piece, n_tokens, shard, slot, at, tokens of every sequence of documents, in training order.

    Repeated rows are documents each, a null doc_id stays null, null and empty texts are an end of text alone, an empty table
    gives no rows, other columns are not looked at. The order hangs on ids and texts alone, not on files or tasks. The sequences
    wait in the shared folder.
    """
    return Order(docs, seed=seed, tokenizer=tokenizer, seq_len=seq_len, shard_slots=shard_slots).rows()


def written_order(docs: DataFrame, *, path: str | None = None, stripes: int = 1, **how) -> DataFrame:
    """`training_order` written as shards under `path` (one in the shared folder, if none is given) and read back from them."""
    order = Order(docs, **how)
    path = path or f"{shared_dir(order.spark)}/shards-{uuid.uuid4().hex}"
    order.write(path, stripes)
    order.drop()
    return read_records(order.spark, path, order.doc_id)


def write_shards(ordered: DataFrame, path: str) -> None:
    """Write `training_order` rows as one row a shard (shard, first_slot, n_slots, stride, crc32, payload, records) under `path`.

    A shard's records stand one after another in `payload`; `records` has the document, piece and number of tokens of each.
    Shards that are there already are left out, so writing goes on from what earlier calls have committed (a call that breaks
    commits nothing); a shard (shard_slots records) is what a task holds at a time.
    """
    spark = ordered.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs_path):
        ordered = ordered.join(spark.read.parquet(path).select("shard"), "shard", "left_anti").repartition("shard").sortWithinPartitions("shard", "slot")
    append_shards(ordered, path)


def append_shards(ordered: DataFrame, path: str) -> None:
    """`write_shards` where none of the shards is there; rows of a shard must stand together and in order."""
    doc_id = ordered.schema["doc_id"].dataType.simpleString()
    fields = f"shard int, first_slot long, n_slots long, stride long, crc32 long, payload binary, doc_ids array<{doc_id}>, pieces array<int>, sizes array<int>"

    def run(batches):
        held, now = [], None

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            payload = b"".join(x.as_py() for x in rows["tokens"])
            n = len(rows)
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows[c].combine_chunks())
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), rows["slot"].combine_chunks()[:1], pa.array([n]), pa.array([len(payload) // n]), pa.array([zlib.crc32(payload)], pa.int64()), pa.array([payload], pa.binary()), one("doc_id"), one("piece"), one("n_tokens")],
                ["shard", "first_slot", "n_slots", "stride", "crc32", "payload", "doc_ids", "pieces", "sizes"],
            )

        for b in batches:
            shard = b["shard"].to_numpy()
            edge = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                if j > i:
                    if held and shard[i] != now:
                        yield done()
                        held = []
                    now = int(shard[i])
                    held.append(b.slice(i, j - i))
        if held:
            yield done()

    ordered.select("shard", "slot", "tokens", "doc_id", "piece", "n_tokens").mapInArrow(trimmed(run), fields).write.mode("append").option("compression", "zstd").parquet(path)


def cut_records(batches, start: int = 0):
    """(batch of one shard, first record wanted, records, their bytes) of each shard, its digest checked."""
    for b in batches:
        for i, (first, n, stride, crc, payload) in enumerate(zip(*(b[c].to_pylist() for c in ("first_slot", "n_slots", "stride", "crc32", "payload")), strict=True)):
            if zlib.crc32(payload) != crc:
                raise ValueError(f"the shard from slot {first} on is damaged")
            at = range(max(0, start - first), n)
            yield b.slice(i, 1), first, at, [payload[k * stride : (k + 1) * stride] for k in at]


def read_shards(spark: SparkSession, path: str, *, start: int = 0) -> DataFrame:
    """(slot, tokens) from slot `start` on; whole shards before it are not read, as the filter is on a column that Parquet has statistics of."""
    shards = spark.read.parquet(path)
    most = shards.agg(F.coalesce(F.max("n_slots"), F.lit(0))).first()[0]

    def cut(batches):
        for _, first, at, tokens in cut_records(batches, start):
            yield pa.RecordBatch.from_arrays([pa.array([first + k for k in at], pa.int64()), pa.array(tokens, pa.binary())], ["slot", "tokens"])

    return shards.where(F.col("first_slot") > start - most).select("first_slot", "n_slots", "stride", "crc32", "payload").mapInArrow(trimmed(cut), "slot long, tokens binary")


def read_records(spark: SparkSession, path: str, doc_id: str = "bigint") -> DataFrame:
    """doc_id, piece, n_tokens, shard, slot, at, tokens of all shards under `path`; no rows where none was written."""
    fields = f"doc_id {doc_id}, piece int, n_tokens int, shard int, slot long, at long, tokens binary"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], fields)

    def cut(batches):
        for one, first, at, tokens in cut_records(batches):
            n = len(tokens)
            place = np.arange(n)
            stride = one["stride"][0].as_py()
            inner = [one[c].values.slice(one[c].offsets[0].as_py(), n) for c in ("doc_ids", "pieces", "sizes")]
            yield pa.RecordBatch.from_arrays([*inner, pa.array([one["shard"][0].as_py()] * n, pa.int32()), pa.array(first + place), pa.array(place * stride), pa.array(tokens, pa.binary())], ["doc_id", "piece", "n_tokens", "shard", "slot", "at", "tokens"])

    return spark.read.parquet(path).mapInArrow(trimmed(cut), fields)
