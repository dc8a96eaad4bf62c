"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

The stored form of a payload is a WAV file of 8-bit mu-law samples (mono, 8 kHz): each byte is one sample's code, so
the payload comes back as it was. Beside it stands its PCM, expanded and resampled, as a WAV file of its own; both are
columns of the result, and what is told of a document is read back from them.

Defined cases: a null or empty payload is stored as one block of zero bytes; payloads are padded with zero bytes to a
positive multiple of BLOCK; equal payloads have equal files and features whatever the batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, RATE, RESAMPLED, CHUNK_BLOCKS, CHUNK_BYTES = 64, 8000, 16000, 4096, 2 << 20
MULAW, ALAW, PCM = 7, 6, 1

# The step sizes and index changes of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code."""
    code = np.arange(256) ^ 0x55
    part, base = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, base + 8, (base + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def wav(samples: bytes, form: int, rate: int = RATE, bits: int = 8) -> bytes:
    fmt = struct.pack("<HHIIHHH", form, 1, rate, rate * bits // 8, bits // 8, bits, 0)
    fact = struct.pack("<I", len(samples) * 8 // bits)
    body = b"".join(name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2) for name, data in ((b"fmt ", fmt), (b"fact", fact), (b"data", samples)))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """Format, rate and samples of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data":
            return form, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples, one row a block; blocks: uint8, one row each, of a 4-byte head (first sample, step index) and nibbles.

    All blocks take one step at a time together, since a block's samples depend on each other but blocks do not.
    """
    steps, moves = np.array(STEPS, np.int32), np.array(MOVES * 2, np.int32)
    value = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), np.int16)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(out.shape[0] - 1):
        nibble = columns[i >> 1] >> 4 if i & 1 else columns[i >> 1] & 15
        step = steps[index]
        size = (step * (2 * (nibble & 7).astype(np.int32) + 1)) >> 3
        value = np.clip(np.where(nibble & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + moves[nibble], 0, len(STEPS) - 1)
        out[i + 1] = value
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate, by the mean of neighbours; the last sample stands twice."""
    out = np.empty(2 * len(pcm), np.int16)
    wide = pcm.astype(np.int32)
    out[::2] = pcm
    out[1::2] = (wide + np.concatenate((wide[1:], wide[-1:]))) >> 1
    return out


def store(payload: bytes) -> bytes:
    """The stored form: padded, then as mu-law samples."""
    return wav(payload + b"\0" * (-len(payload) % BLOCK if payload else BLOCK), MULAW)


def pcm_wav(media: bytes) -> bytes:
    """Expanded and resampled, as 16-bit PCM at RESAMPLED."""
    form, _, samples = unwav(media)
    pcm = {MULAW: mulaw_table, ALAW: alaw_table}[form]()[np.frombuffer(samples, np.uint8)]
    return wav(resample(pcm).astype("<i2").tobytes(), PCM, RESAMPLED, 16)


def features(payloads: list[bytes], pcms: list[bytes] | None = None) -> list[str]:
    """Per payload, all in whole numbers: mean size and sign changes of its mu-law PCM, mean size of its A-law PCM, mean
    size of its resampled PCM, and peak and mean size of its blocks read as ADPCM. pcms: the samples of the stored PCM,
    made from the payloads where they are not given."""
    if pcms is None:
        pcms = [unwav(pcm_wav(wav(p, MULAW)))[2] for p in payloads]
    mu, a = mulaw_table(), alaw_table()
    out: list[str] = []
    at = 0
    while at < len(payloads):
        to, blocks = at, 0
        while to < len(payloads) and (to == at or blocks < CHUNK_BLOCKS):
            blocks, to = blocks + len(payloads[to]) // BLOCK, to + 1
        data = np.frombuffer(b"".join(payloads[at:to]), np.uint8)
        n = np.array([len(p) for p in payloads[at:to]])
        first = np.cumsum(n) - n
        pcm = mu[data]
        sizes = np.add.reduceat(np.abs(pcm.astype(np.int64)), first) // n
        change = np.concatenate((np.signbit(pcm[1:]) != np.signbit(pcm[:-1]), [False])).astype(np.int64)
        change[np.cumsum(n) - 1] = 0
        changes = np.add.reduceat(change, first)
        laws = np.add.reduceat(np.abs(a[data].astype(np.int64)), first) // n
        wide = np.frombuffer(b"".join(pcms[at:to]), "<i2").astype(np.int64)
        n_wide = np.array([len(p) // 2 for p in pcms[at:to]])
        twice = np.add.reduceat(np.abs(wide), np.cumsum(n_wide) - n_wide) // n_wide
        rows = data.reshape(-1, BLOCK)
        peak, total = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for i in range(0, len(rows), CHUNK_BLOCKS):
            wide = np.abs(adpcm(rows[i : i + CHUNK_BLOCKS]).astype(np.int32))
            peak[i : i + CHUNK_BLOCKS], total[i : i + CHUNK_BLOCKS] = wide.max(axis=1), wide.sum(axis=1)
        peaks = np.maximum.reduceat(peak, first // BLOCK)
        means = np.add.reduceat(total, first // BLOCK) // (n // BLOCK * (2 * (BLOCK - 4) + 1))
        out += [f"mulaw={s};changes={c};alaw={w};pcm16k={t};adpcm_peak={p};adpcm={m}" for s, c, w, t, p, m in zip(sizes, changes, laws, twice, peaks, means, strict=True)]
        at = to
    return out


@F.pandas_udf(T.BinaryType())
def stored(payloads: pd.Series) -> pd.Series:
    return pd.Series([store(p or b"") for p in payloads], dtype=object)


@F.pandas_udf(T.BinaryType())
def resampled(media: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else pcm_wav(m) for m in media], dtype=object)


def _probe(media: list[bytes], pcm: list[bytes]) -> dict[str, list]:
    """What is read back from stored forms and stored PCM: sizes, digests and the feature string."""
    read = [unwav(m)[2] for m in media]
    return {
        "payload_bytes": [len(p) for p in read], "payload_sha256": [hashlib.sha256(p).hexdigest() for p in read], "tail_crc32": [zlib.crc32(p[-64:]) for p in read],
        "media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "feature": features(read, [unwav(m)[2] for m in pcm]),
    }


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its files and what they tell, CHUNK_BYTES of payloads (or one row) at once."""
    for batch in batches:
        payloads, at = batch.column("payload").to_pylist(), 0
        while at < len(payloads):
            to, size = at, 0
            while to < len(payloads) and (to == at or size < CHUNK_BYTES):
                size, to = size + len(payloads[to]), to + 1
            media = [store(p) for p in payloads[at:to]]
            pcm = [pcm_wav(m) for m in media]
            ids = batch.slice(at, to - at)
            made = {"doc_id": ids.column("doc_id"), "n_bytes": ids.column("n_bytes"), "media": pa.array(media, pa.binary()), "pcm": pa.array(pcm, pa.binary())}
            yield pa.RecordBatch.from_pydict(made | {k: pa.array(v) for k, v in _probe(media, pcm).items()})
            at = to


def telephony(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the stored form), pcm (its resampled PCM) and what was read back from the two."""
    payload = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.octet_length(payload).cast("long").alias("n_bytes"), F.encode(payload, "UTF-8").alias("payload"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, pcm binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(_files, schema)
