"""Packing documents into training sequences: first-fit decreasing in randomised groups of bounded size.

Documents become token ids, documents longer than a sequence are cut at every full one, and the pieces are dealt to
groups by a hash of their content. In each group the longest piece goes first, each into the first sequence that it
fits; a tournament tree over the room that each sequence has left finds it in logarithmic time. What first-fit leaves
open is closed at the end by cutting the pieces of the emptiest sequences.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import pieces
from chronoweave.llm.training_order import PATTERN
from chronoweave.llm.words import mix

#: Pieces of a group and bytes of text behind it, on average; what a task holds.
GROUP_PIECES, GROUP_BYTES = 8192, 32 << 20
U = np.uint64


class Room:
    """The room left in each of `n` sequences, as a tournament tree: a node holds the larger of its children's."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.node = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """The first sequence with room for `size` (there is one), and the room it had."""
        node, at = self.node, 1
        while at < self.leaves:
            at *= 2
            if node[at] < size:
                at += 1
        had, found = node[at], at - self.leaves
        node[at] = had - size
        at >>= 1
        while at:
            larger = max(node[2 * at], node[2 * at + 1])
            if node[at] == larger:
                break
            node[at] = larger
            at >>= 1
        return found, had


def first_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; `sizes` fall, and none is above `capacity`."""
    room = Room(len(sizes), capacity)
    took = [room.take(s) for s in sizes.tolist()]
    found, had = np.array(took, np.int64).reshape(-1, 2).T
    return found, capacity - had


def close_gaps(sizes: np.ndarray, found: np.ndarray, offset: np.ndarray, capacity: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, first id, ids, sequence, offset) of all pieces, after the emptiest sequences went into the others' gaps.

    A sequence is given up as long as gaps of at least `least` ids in the fuller ones take all of it; its pieces are cut
    where a gap ends. Sequences keep their numbers, so those given up leave holes in the numbering.
    """
    fill = np.bincount(found, sizes, found.max(initial=-1) + 1).astype(np.int64)
    order = np.argsort(-fill, kind="stable")
    gap = np.where(capacity - fill[order] >= least, capacity - fill[order], 0)
    open_to = np.concatenate([[0], np.cumsum(gap)])[:-1]  # gaps in fuller sequences than this one
    given = np.cumsum(fill[order][::-1])[::-1]  # what this one and all emptier ones hold
    keep = int(np.argmax(given <= open_to)) if (given <= open_to).any() else len(order)
    up = np.zeros(len(fill), bool)
    up[order[keep:]] = True
    out = [(i, 0, int(sizes[i]), int(found[i]), int(offset[i])) for i in np.flatnonzero(~up[found])]
    holes = [(int(s), int(fill[s]), int(g)) for s, g in zip(order[:keep], gap[:keep], strict=True) if g]
    holes.sort(key=lambda h: (h[2], h[0]))  # taken from the end: the largest first
    for i in np.flatnonzero(up[found]):
        at, left = 0, int(sizes[i])
        while left:
            s, start, room = holes.pop()
            n = min(room, left)
            out.append((int(i), at, n, s, start))
            at, left = at + n, left - n
            if room > n:
                holes.append((s, start + n, room - n))
    return out


_encoders: dict[str, object] = {}


def encoder(path: str):
    """An encoder of a byte-level BPE vocabulary file, one a process.

    The file's own merges are ranks in the order of its ids, which is what the faster of the two libraries needs; tests
    hold its ids against those of the library that the file was written for.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            kept = json.load(f)
        # the printable stand-ins of bytes that byte-level vocabularies are written in
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in kept["added_tokens"]}
        ranks = {bytes(shown[c] for c in word): i for word, i in kept["model"]["vocab"].items() if word not in special}
        _encoders[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def tokenised(docs: DataFrame, tokenizer: str, end: int, length: int, groups: int) -> DataFrame:
    """group, key, doc_id, start, doc_tokens, ids of the pieces of all documents, cut at every `length` ids."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tool, seen = encoder(tokenizer), {}
        for batch in pieces(batches):
            row, start, total, ids, key = [], [], [], [], []
            for i, (text, k) in enumerate(zip(batch["text"].to_pylist(), batch["key"].to_pylist(), strict=True)):
                x = np.append(tool.encode_to_numpy(text or "", allowed_special="all"), end).astype("<u4")
                again = seen[k] = seen.get(k, -1) + 1  # repeated rows go to groups of their own
                for at in range(0, len(x), length):
                    row.append(i)
                    start.append(at)
                    total.append(len(x))
                    ids.append(x[at : at + length].tobytes())
                    key.append((k ^ again * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
            key = mix(np.array(key, np.uint64) + np.array(start, np.uint64) * U(0xBF58476D1CE4E5B9))
            yield pa.RecordBatch.from_arrays(
                [pa.array((key % U(groups)).astype(np.int64)), pa.array(key.view(np.int64)), batch["doc_id"].take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                ["group", "key", "doc_id", "start", "doc_tokens", "ids"],
            )

    # the number of a repeated row is counted in each task, so a counter of all its keys is bounded by the task's rows
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(run, f"group long, key long, doc_id {doc_id}, start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, *, tokenizer: str | None = None, end: int = 1, length: int = 2048, least_cut: int = 32, group_pieces: int = GROUP_PIECES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids of every piece.

    A document is its ids of the vocabulary file `tokenizer` (special tokens in a text are read as such, none are added)
    and `end`; null and empty texts are `end` alone. `start` counts the document's ids before the piece, `offset` the
    ids before it in its sequence of at most `length`. `ids` are little-endian unsigned 32-bit numbers. Sequences are
    gapless from 0 and padded behind their last piece, which is the reader's work. Documents are cut at full sequences
    and where that closes a gap of at least `least_cut` ids.

    Repeated rows are documents each, a null doc_id stays null, an empty table gives no rows, other columns are not
    looked at. Groups hang on content alone, so that a table without repeated rows gives the same result however its
    files are split; a repeated row goes to other groups by its number within a task. A group has `group_pieces` pieces
    and `group_bytes` of text on average, whatever the size of the table.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-rows // group_pieces), -(-size // group_bytes))
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = np.array([len(x) // 4 for x in table["ids"].to_pylist()], np.int64)
        table = table.take(pa.array(np.lexsort([table["start"].to_numpy(), table["key"].to_numpy(), -sizes])))
        ids = [np.frombuffer(x, "<u4") for x in table["ids"].to_pylist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        placed = close_gaps(sizes, *first_fit(sizes, length), length, least_cut)
        piece, first, n, sequence, offset = np.array(placed, np.int64).T
        cut = [ids[i][a : a + k].tobytes() for i, a, k in zip(piece.tolist(), first.tolist(), n.tolist(), strict=True)]
        table = table.take(pa.array(piece))
        return pa.table(
            {
                "doc_id": table["doc_id"], "start": pa.array(table["start"].to_numpy() + first), "length": pa.array(n), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                "doc_tokens": table["doc_tokens"], "sequence_id": pa.array((table["group"].to_numpy() << 32) + sequence), "offset": pa.array(offset), "ids": pa.array(cut, pa.binary()),
            }
        )

    made = tokenised(docs, tokenizer, end, length, groups)
    return made.groupBy("group").applyInArrow(run, f"doc_id {doc_id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame, *, pad: int = 1, length: int = 2048) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces, tokens) of `pack` rows: the ids of a sequence in order, padded to `length` unless they are a power of two in number."""
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    some = F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))")
    blank = F.expr(f"unhex(repeat('{pad.to_bytes(4, 'little').hex()}', cast(case when bit_count(n_tokens) = 1 then 0 else {length} - n_tokens end as int)))")
    return whole.select("sequence_id", "n_tokens", "n_pieces", F.concat(some, blank).alias("tokens"))
