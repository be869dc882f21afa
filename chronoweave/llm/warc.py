"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Spark has no writer of raw files, so an archive is a row (archive_id, n_records, content); the reader takes such
rows or those of spark.read.format("binaryFile"), decodes record by record and validates headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import materialize

# Frame magics of the Zstandard format and of the archive's dictionary frame.
DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "archive_id string, record_no int, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers only; digest and length are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x-page:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", clean(uri or "")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; ValueError if a header, the digest or a length is wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:40]}")
        fields[k.strip().lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise ValueError(f"no {k}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes, not {size}")
    http, mark, payload = rest[:size].partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no end of the HTTP headers")
    want, kind = fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"]
    length = int(fields.get("x-payload-length", len(payload)))
    if kind == "response" and (length != len(payload) or want and digest(payload) != want):
        raise ValueError("payload of another length or digest")
    return {"record_type": kind, "record_id": fields["warc-record-id"].strip("<>").removeprefix("urn:x-page:"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields["warc-refers-to"].strip("<>").removeprefix("urn:x-page:") if "warc-refers-to" in fields else None, "payload_digest": want, "payload_bytes": length, "payload": payload if kind == "response" else None}


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples, or their start as they are where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def pack(records: list[bytes], dict_bytes: int, level: int) -> bytes:
    known = dictionary([r[:2048] for r in records[:256]], dict_bytes)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known), write_content_size=True)
    stored = zstandard.ZstdCompressor(level=level).compress(known)
    return struct.pack("<II", DICT_MAGIC, len(stored)) + stored + b"".join(squeeze.compress(r) for r in records)


def unpack(content: bytes, limit: int = 1 << 30):
    """The raw records of an archive, one frame after the other."""
    at, known = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut off")
        known, at = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw, max_output_size=limit) if raw[:4] == ZSTD_MAGIC else raw), 8 + size
    open_ = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        frame = open_.decompressobj()
        out = [frame.decompress(view[at : at + (1 << 16)])]
        at += min(1 << 16, len(content) - at)
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the last frame is cut off")
            out.append(frame.decompress(view[at : at + (1 << 16)]))
            at += min(1 << 16, len(content) - at)
        at -= len(frame.unused_data)
        yield b"".join(out)


def write_archives(pages: DataFrame, *, min_revisit_bytes: int = 0, archive_bytes: int = 16 << 20, dict_bytes: int = 16384, level: int = 3) -> DataFrame:
    """Archives (archive_id, n_records, content) with one record per page of (page_id, url, html).

    Of the pages with one payload (null html: empty) of at least `min_revisit_bytes`, those with the largest page_id are
    responses and the others revisits of it; smaller ones are all responses. A null page_id counts as the smallest and,
    as it can't be referred to, a group that has no other is all responses. Repeated rows of the largest page_id are
    responses each. The largest id of each payload is found from digests alone, pre-aggregated, and only payloads with
    more than one page are joined back, so a payload that a third of the pages share is one row of a join that Spark splits.
    Each archive holds up to `archive_bytes` of records (or one longer record) and its own dictionary.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("_payload")).withColumn("_sha", F.sha1("_payload"))
    again = rows.where(F.length("_payload") >= min_revisit_bytes).groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _last is not null").drop("_n")
    rows = rows.join(again, "_sha", "left").drop("_sha")

    def write(batches):
        held, size = [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(b"".join(r[:256] for r in held)).hexdigest()[:24]], pa.string()), pa.array([len(held)], pa.int32()), pa.array([pack(held, dict_bytes, level)], pa.binary())], ["archive_id", "n_records", "content"])

        for b in batches:
            for page, url, payload, last in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["_payload"], b["_last"].to_pylist(), strict=True):
                revisit = last is not None and page != last
                r = record("revisit" if revisit else "response", "" if page is None else str(page), url, payload.as_py(), str(last) if revisit else None)
                if held and size + len(r) > archive_bytes:
                    yield done()
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield done()

    return rows.mapInArrow(write, "archive_id string, n_records int, content binary")


def read_archives(archives: DataFrame, *, content: str = "content", name: str = "archive_id", payloads: bool = True) -> DataFrame:
    """One row per record; `error` says what is wrong with a record or, in the last row of an archive, with its frames.

    Null content is an archive without records. `payloads` false leaves the payload column null once it is validated.
    """

    def read(batches):
        names = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        for b in batches:
            for archive, raw in zip(b["_name"].to_pylist(), b["_content"], strict=True):
                rows, size, no = [], 0, 0

                def batch(rows=rows, archive=archive):
                    return pa.RecordBatch.from_arrays([pa.array([archive] * len(rows), pa.string()), pa.array([r["no"] for r in rows], pa.int32()), *(pa.array([r.get(k) for r in rows], t) for k, t in zip(names, types, strict=True)), pa.array([r.get("error") for r in rows], pa.string())], ["archive_id", "record_no", *names, "error"])

                try:
                    for r in unpack(raw.as_py() or b""):
                        try:
                            row = parse(r)
                        except ValueError as e:
                            row = {"error": str(e)}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row | {"no": no})
                        no, size = no + 1, size + len(r)
                        if size > 8 << 20:
                            yield batch()
                            rows.clear()
                            size = 0
                except (ValueError, zstandard.ZstdError) as e:
                    rows.append({"no": no, "error": str(e)})
                if rows:
                    yield batch()

    return archives.select(F.col(name).cast("string").alias("_name"), F.col(content).alias("_content")).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, **params) -> DataFrame:
    """Write the pages as archives into the shared folder, read them back and return what the records say of each page.

    page_id, payload_bytes, payload_digest, record_type and refers_to in the type of page_id; a record that fails
    validation keeps its row, with `error` set. Empty tables give no rows.
    """
    kind = pages.schema["page_id"].dataType
    archives = materialize(write_archives(pages, **params), f"warc-{uuid.uuid4().hex[:6]}")
    back = read_archives(archives, payloads=False)
    page = F.when(F.col("record_id") == "", None).otherwise(F.col("record_id")).cast(kind)
    return back.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "error")
