"""Telephony audio: mu-law, A-law and IMA ADPCM in WAVE files, decoded with numpy, and resampled linear PCM.

Companded samples are expanded by lookup tables of 256 entries. ADPCM is decoded across blocks: every block starts from its own
header, so the blocks of a batch of files form the rows of one array, and the loop runs over the nibbles of a
block, never over blocks. Resampling is a windowed-sinc filter bank (polyphase), applied by numpy.

Defined results: a null payload is an empty one; payloads are padded with zero bytes to a positive multiple of 64 by ``pad``; a file
that isn't a known WAVE raises ValueError; ``read`` returns the data chunk bit for bit; a file longer than ``BATCH_BYTES`` (a very long text) is decoded as a whole by itself; equal
texts and repeated rows get equal results, a row each; an empty table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
from pyspark.sql import functions as F

from .common import arrow_function, field, nested, slices, struct_rows

MULAW, ALAW, IMA = 7, 6, 0x11
NAMES = {MULAW: "mulaw", ALAW: "alaw", IMA: "ima"}
#: Bytes of an ADPCM block: 4 of header, then two samples a byte.
BLOCK = 64
#: Samples of a block: one in the header, two in each other byte.
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)
#: Files decoded at a time are cut at this many payload bytes, one file at least.
BATCH_BYTES = 1 << 20

# Fixed values of the IMA ADPCM format.
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 mu-law codes (ITU-T G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 A-law codes (ITU-T G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment = code >> 4 & 7
    size = ((code & 15) << 4) + 8
    size = np.where(segment > 0, (size + 256) << np.maximum(segment - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks: uint8 (n, bytes) to int16 (n, 1 + 2 * (bytes - 4))."""
    n, width = blocks.shape
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(head[:, 2], 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    out[0] = value
    for k in range(width - 4):
        for half in (0, 1):
            nibble = (body[k] >> (4 * half) & 15).astype(np.int32)
            step = IMA_STEPS[index]
            move = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
            value = np.clip(value + np.where(nibble & 8, -move, move), -32768, 32767)
            index = np.clip(index + IMA_MOVES[nibble & 7], 0, 88)
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


def encode_ima(samples: np.ndarray) -> np.ndarray:
    """Blocks of 64 bytes for linear samples, padded with the last sample; the loop again runs inside the blocks only."""
    samples = np.asarray(samples, dtype=np.int16)
    n = max(1, -(-len(samples) // BLOCK_SAMPLES))
    last = samples[-1] if len(samples) else 0
    grid = np.concatenate([samples, np.full(n * BLOCK_SAMPLES - len(samples), last, dtype=np.int16)]).reshape(n, -1).astype(np.int32)
    out = np.zeros((n, BLOCK), dtype=np.uint8)
    value, index = grid[:, 0].copy(), np.zeros(n, dtype=np.int32)
    out[:, 0], out[:, 1] = value & 255, value >> 8 & 255
    for k in range(1, BLOCK_SAMPLES):
        step = IMA_STEPS[index]
        gap = grid[:, k] - value
        rest, nibble, move = np.abs(gap), np.where(gap < 0, 8, 0), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = rest >= part
            nibble, move, rest = nibble | np.where(take, bit, 0), move + np.where(take, part, 0), rest - np.where(take, part, 0)
        value = np.clip(value + np.where(nibble & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[nibble & 7], 0, 88)
        out[:, 4 + (k - 1) // 2] |= (nibble << 4 * ((k - 1) % 2)).astype(np.uint8)
    return out


def wave(payload: bytes, codec: int, rate: int = 8000) -> bytes:
    """A mono WAVE file that holds the payload as its data chunk, byte for byte."""
    if codec == IMA:
        fmt = struct.pack("<HHIIHHHH", IMA, 1, rate, rate * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
        samples = len(payload) // BLOCK * BLOCK_SAMPLES
    else:
        fmt, samples = struct.pack("<HHIIHHH", codec, 1, rate, rate, 1, 8, 0), len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body) + len(payload) % 2) + body + b"\0" * (len(payload) % 2)


def read(media: bytes) -> tuple[int, int, bytes]:
    """Codec, rate and data of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data":
            if codec not in NAMES:
                raise ValueError(f"unknown codec {codec}")
            return codec, rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def filters(up: int, down: int, half: int = 4) -> np.ndarray:
    """Polyphase filters of a windowed sinc: row p holds the taps for outputs that lie p / up after an input."""
    scale = min(1.0, up / down)
    reach = int(np.ceil(half / scale))
    at = np.arange(-reach + 1, reach + 1)[None, :] - np.arange(up)[:, None] / up
    taps = scale * np.sinc(scale * at) * np.cos(np.pi * at / (2 * reach + 2)) ** 2
    return taps / taps.sum(axis=1, keepdims=True)


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate."""
    if rate == to or not len(samples):
        return np.asarray(samples, dtype=np.int16)
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    taps = filters(up, down)
    reach = taps.shape[1] // 2
    padded = np.concatenate([np.zeros(reach - 1), samples, np.zeros(reach + 1)])
    total = -(-len(samples) * up // down)
    out = np.empty(total)
    # outputs k, k + up, ... share a phase; their inputs lie ``down`` apart
    for first in range(min(up, total)):
        start, phase = divmod(first * down, up)
        count = -(-(total - first) // up)
        acc = np.zeros(count)
        for t in range(taps.shape[1]):
            acc += taps[phase, t] * padded[start + t : start + t + (count - 1) * down + 1 : down]
        out[first::up] = acc
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def decode_many(files: list[bytes]) -> list[tuple[int, int, bytes, np.ndarray]]:
    """Codec, rate, data and linear samples of each file; ADPCM blocks of all files are decoded together."""
    found = [read(f) for f in files]
    blocks = [np.frombuffer(d, dtype=np.uint8)[: len(d) // BLOCK * BLOCK].reshape(-1, BLOCK) if c == IMA else None for c, _, d in found]
    ima = [b for b in blocks if b is not None]
    decoded = decode_ima(np.concatenate(ima)) if ima else None
    out, at = [], 0
    for (codec, rate, data), own in zip(found, blocks):
        if own is None:
            samples = TABLES[codec][np.frombuffer(data, dtype=np.uint8)]
        else:
            samples = decoded[at : at + len(own)].reshape(-1)
            at += len(own)
        out.append((codec, rate, data, samples))
    return out


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + b"\0" * (max(64, -(-len(payload) // 64) * 64) - len(payload))


def codec_of(payload: bytes) -> int:
    """The codec that a payload is stored in: any of the three carries it losslessly; equal payloads, equal codecs."""
    return (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]


def feature(codec: int, rate: int, samples: np.ndarray, to: int) -> tuple[str, bytes]:
    """A line of features of the decoded audio, and its PCM at another rate (little-endian)."""
    pcm = resample(samples, rate, to)
    wide = samples.astype(np.int64)
    energy = int((wide * wide).sum())
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    raw = pcm.astype("<i2").tobytes()
    return f"{NAMES[codec]};rate={rate};samples={len(samples)};sum={int(wide.sum())};energy={energy};peak={int(np.abs(wide).max(initial=0))};crossings={crossings};pcm_rate={to};pcm_samples={len(pcm)};pcm_crc32={zlib.crc32(raw)}", raw


def stored(docs, text_col: str = "text", to: int = 16000, keep: bool = False):
    """The columns of docs, then __media: a struct of the stored file's digests and features, its resampled PCM (16-bit samples, little-endian) and, if ``keep``, the file."""
    import pyarrow as pa

    fields = [("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("pcm", "binary", pa.binary())]
    fields += [("media", "binary", pa.binary())] if keep else []

    def chunk(texts: list[bytes]) -> pa.StructArray:
        files = [wave(p := pad(t), codec_of(p)) for t in texts]
        rows = []
        for t, f, (codec, rate, data, samples) in zip(texts, files, decode_many(files)):
            line, pcm = feature(codec, rate, samples, to)
            row = len(t), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(f), hashlib.sha256(f).hexdigest(), line, pcm
            rows.append((*row, f) if keep else row)
        return struct_rows(list(zip(*rows)) or [()] * len(fields), [(n, k) for n, _, k in fields])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:  # results leave in smaller batches than texts come: PCM takes several times a text's room
            for part in slices(batch, BATCH_BYTES):
                yield chunk([t.encode("utf-8") for t in part.to_pylist()])

    media = arrow_function(run, "struct<" + ",".join(f"{n}:{k}" for n, k, _ in fields) + ">")
    return nested(docs).withColumn("media", media(field(text_col))).select("row.*", F.col("media").alias("__media"))


def media_report(docs):
    """doc_id, the digests of each document's stored form, and its PCM at 16 kHz."""
    return stored(docs.select("doc_id", "text")).select("doc_id", "__media.*")
