"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE containers, decoded and resampled with numpy.

Mu-law and A-law bytes go through 256-entry tables built from their defining rule. ADPCM is decoded step by step
along the samples of a block, all blocks of a batch side by side. A document's bytes can be stored as such samples
(the bytes are the samples) and come back unchanged.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.common import buffers, materialize, pieces, utf8

# WAVE format tags and the IMA ADPCM index steps, as the formats define them.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# The 89 IMA ADPCM step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
#: Bytes of an ADPCM block: 4 of header (predictor, step index, 0) and 64 of samples, two to a byte.
BLOCK_HEAD, BLOCK_DATA = 4, 64
RATE = 8000
CODECS = (MULAW, ALAW, IMA)
NAMES = {MULAW: "mulaw", ALAW: "alaw", IMA: "ima"}


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law byte: inverted bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    x = ~np.arange(256, dtype=np.uint8)
    size = (((x & 15).astype(np.int32) << 3) + 132 << ((x >> 4) & 7).astype(np.int32)) - 132
    return np.where(x & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law byte: even bits inverted, set sign bit is positive, exponent 0 is linear."""
    x = np.arange(256, dtype=np.uint8) ^ 0x55
    e, size = ((x >> 4) & 7).astype(np.int32), ((x & 15).astype(np.int32) << 4) + 8
    size = np.where(e == 0, size, (size + 256) << np.maximum(e - 1, 0))
    return np.where(x & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(blocks, 68) bytes to (blocks, 129) samples: the predictor, then two for each byte, low nibble first."""
    n = len(blocks)
    out = np.empty((blocks.shape[1] - BLOCK_HEAD) * 2 * n + n, np.int16).reshape(-1, n)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, BLOCK_HEAD:].T)
    for k in range(data.shape[0] * 2):
        code = (data[k >> 1] >> (4 * (k & 1))) & 15
        step, low = STEPS[index], code & 7
        move = ((2 * low.astype(np.int32) + 1) * step) >> 3
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_STEP[low], 0, 88)
        out[k + 1] = value
    return out.T


def container(tag: int, payload: bytes) -> bytes:
    """A RIFF/WAVE file with the payload as mono 8 kHz samples of the format `tag`."""
    if tag == IMA:
        body = np.zeros((len(payload) // BLOCK_DATA, BLOCK_HEAD + BLOCK_DATA), np.uint8)
        body[:, BLOCK_HEAD:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK_DATA)
        samples, body = len(body) * (2 * BLOCK_DATA + 1), body.tobytes()
        fmt = struct.pack("<HHIIHHHH", IMA, 1, RATE, RATE * (BLOCK_HEAD + BLOCK_DATA) // (2 * BLOCK_DATA + 1), BLOCK_HEAD + BLOCK_DATA, 4, 2, 2 * BLOCK_DATA + 1)
    else:
        samples, body = len(payload), payload
        fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def parse(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, block size and sample bytes of a WAVE file; ValueError if its structure or lengths are wrong."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] + 8 != len(media):
        raise ValueError("not a WAVE file, or cut off")
    at, tag, block, body = 12, None, 1, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk passes the end")
        if name == b"fmt ":
            tag, block = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            body = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if tag is None or body is None:
        raise ValueError("no format or no samples")
    return tag, block, body


def stored_bytes(media: bytes) -> bytes:
    """The bytes that `container` was given."""
    tag, block, body = parse(media)
    if tag == IMA:
        return np.frombuffer(body, np.uint8).reshape(-1, block)[:, BLOCK_HEAD:].tobytes()
    return body


def decode(media: bytes) -> np.ndarray:
    """16-bit PCM of a WAVE file in any of the formats here."""
    tag, block, body = parse(media)
    if tag == PCM:
        return np.frombuffer(body, "<i2")
    if tag in TABLES:
        return TABLES[tag][np.frombuffer(body, np.uint8)]
    if tag == IMA:
        return decode_ima(np.frombuffer(body, np.uint8).reshape(-1, block)).reshape(-1)
    raise ValueError(f"unknown format {tag}")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate; empty stays empty. Doubling, the usual case, goes in whole numbers, halves to the even one."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        both = pcm[:-1].astype(np.int32) + pcm[1:]
        out[1:-1:2] = (both >> 1) + ((both & 1) & (both >> 1 & 1))
        out[-1] = pcm[-1]
        return out
    at = np.arange(max(1, len(pcm) * to // rate)) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def resampled_wave(media: bytes, to: int) -> bytes:
    """The media as 16-bit PCM at another rate, in a WAVE file."""
    return wave(decode(media), RATE, to)


def wave(pcm: np.ndarray, rate: int, to: int) -> bytes:
    body = resample(pcm, rate, to).astype("<i2").tobytes()
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, PCM, 1, to, to * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def features(pcm: list[np.ndarray]) -> list[str]:
    """Integer features of each signal, so equal samples give equal text: samples, mean square, crossings of zero, peak, mean step."""
    out = []
    for x in pcm:
        wide = x.astype(np.int64)
        n = max(1, len(x))
        crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        out.append(f"n={len(x)};ms={int(np.dot(wide, wide)) // n};zc={crossings};peak={int(np.abs(wide).max(initial=0))};step={int(np.abs(np.diff(wide)).sum()) // n}")
    return out


def decode_all(tags: list[int], bodies: list[bytes]) -> list[np.ndarray]:
    """Decode many signals; the ADPCM blocks of all of them at once."""
    ima = [i for i, t in enumerate(tags) if t == IMA]
    out = [TABLES[t][np.frombuffer(b, np.uint8)] if t != IMA else None for t, b in zip(tags, bodies, strict=True)]
    if ima:
        blocks = np.frombuffer(b"".join(bodies[i] for i in ima), np.uint8).reshape(-1, BLOCK_HEAD + BLOCK_DATA)
        samples, at = decode_ima(blocks), 0
        for i in ima:
            n = len(bodies[i]) // (BLOCK_HEAD + BLOCK_DATA)
            out[i] = samples[at : at + n].reshape(-1)
            at += n
    return out


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, codec, media of every text: its UTF-8 as telephony audio in a WAVE file, written to the shared folder and read from there.

    The text's UTF-8 (null: empty) is filled with zero bytes up to a positive multiple of 64. Its crc32 picks mu-law,
    A-law or ADPCM, so equal texts get equal files; in ADPCM every 64 bytes are one block behind a block header, so the
    bytes stay as they are.
    """
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, codec string, media binary"

    def store(batches):
        for piece in pieces(batches, most=2 << 20):
            data, ends = buffers(piece["text"])
            raw, tags, media = data.tobytes(), [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                text = raw[a:b]
                payload = text + b"\0" * (-len(text) % 64 if text else 64)
                tags.append(CODECS[zlib.crc32(payload) % len(CODECS)])
                media.append(container(tags[-1], payload))
            yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(np.diff(ends)), pa.array([NAMES[t] for t in tags], pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "codec", "media"])

    return materialize(docs.select("doc_id", utf8("text").alias("text")).mapInArrow(store, fields), "media")


def text_media(docs: DataFrame, keep_media: bool = False, rate: int = 16000) -> DataFrame:
    """Store each whole text as telephony audio, read it back and compute features.

    `payload_*` come from the bytes read back out of the stored files (`stored_media`), `feature` from their samples,
    `pcm_bytes` and `pcm_sha256` from the same as 16-bit PCM at `rate` Hz (a WAVE file). `keep_media` adds the files
    themselves as `media` and `pcm`. Repeated rows and null ids give rows of their own; an empty table gives none.
    Python holds about 1 MB of media at a time, or one longer document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm_bytes long, pcm_sha256 string" + ", media binary, pcm binary" * keep_media
    names = [f.split()[0] for f in fields.split(", ")]

    def read(batches):
        for piece in pieces(batches, "media", most=1 << 20):
            media = [m.as_py() for m in piece["media"]]
            parsed = [parse(m) for m in media]
            back = [stored_bytes(m) for m in media]
            signals = decode_all([t for t, _, _ in parsed], [b for _, _, b in parsed])
            pcm = [wave(x, RATE, rate) for x in signals]
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            size = lambda xs: pa.array([len(x) for x in xs], pa.int64())
            columns = [piece["doc_id"], piece["n_bytes"], size(back), sha(back), pa.array([zlib.crc32(x[-64:]) for x in back], pa.int64()), size(media), sha(media), pa.array(features(signals), pa.string()), piece["codec"], size(pcm), sha(pcm)]
            yield pa.RecordBatch.from_arrays([*columns, *([piece["media"], pa.array(pcm, pa.binary())] if keep_media else [])], names)

    return stored_media(docs).mapInArrow(read, fields)


def decode_media(rows: DataFrame, media: str = "media", rate: int = 16000) -> DataFrame:
    """Add `pcm` (16-bit WAVE at `rate` Hz) and `error` for a column of WAVE files; null media gives null pcm, a broken file a message."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("pcm", "error")) + ", pcm binary, error string"

    def read(batches):
        for batch in batches:
            pcm, error = [], []
            for m in batch[media].to_pylist():
                try:
                    pcm.append(None if m is None else resampled_wave(m, rate))
                    error.append(None)
                except (ValueError, struct.error) as e:
                    pcm.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pcm, pa.binary()), pa.array(error, pa.string())], [*batch.schema.names, "pcm", "error"])

    return rows.drop("pcm", "error").mapInArrow(read, schema)
