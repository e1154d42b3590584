import hashlib
import zlib

import numpy as np
import pytest

from ridgeline.llm import audio as A


def test_companding_tables():
    # corner values of G.711
    assert A.TABLES[A.MULAW][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert A.TABLES[A.ALAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    for t in A.TABLES.values():
        assert np.array_equal(np.sort(t), np.sort(-t))


def slow_ima(block: bytes) -> list[int]:
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for b in block[4:]:
        for nibble in (b & 15, b >> 4):
            step = int(A.IMA_STEPS[index])
            move = step >> 3
            for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                move += part if nibble & bit else 0
            value = max(-32768, min(32767, value - move if nibble & 8 else value + move))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble & 7]))
            out.append(value)
    return out


def test_ima_blocks_equal_the_plain_loop():
    blocks = np.random.default_rng(1).integers(0, 256, (40, 64), dtype=np.uint8)
    got = A.decode_ima(blocks)
    assert got.shape == (40, A.BLOCK_SAMPLES)
    for b, g in zip(blocks, got):
        assert slow_ima(b.tobytes()) == g.tolist()


def test_ima_round_trip_is_close():
    tone = (8000 * np.sin(np.arange(3000) * 0.05)).astype(np.int16)
    back = A.decode_ima(A.encode_ima(tone)).reshape(-1)[:3000]
    assert np.abs(back[200:].astype(int) - tone[200:]).mean() < 400


@pytest.mark.parametrize("codec", [A.MULAW, A.ALAW, A.IMA])
def test_wave_round_trip(codec):
    for n in (64, 128, 6400):
        payload = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        assert A.read(A.wave(payload, codec)) == (codec, 8000, payload)
    with pytest.raises(ValueError):
        A.read(b"nothing")


@pytest.mark.parametrize("to", [16000, 11025, 4000, 8000])
def test_resampling_keeps_a_tone(to):
    tone = 9000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    got = A.resample(tone.astype(np.int16), 8000, to)
    assert len(got) == to
    want = 9000 * np.sin(2 * np.pi * 440 * np.arange(to) / to)
    assert np.abs(got[200:-200] - want[200:-200]).max() < 250


def test_table(spark):
    texts = {1: "abc", 2: None, 3: "", 4: "é" * 5000, 5: "abc", 6: "x" * 64, 7: "long " * 60000}
    docs = spark.createDataFrame([(i, t, "m") for i, t in texts.items()], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in A.media_report(docs).collect()}
    kept = {r.doc_id: r["__media"] for r in A.stored(docs, keep=True).collect()}
    assert len(got) == 7 and got[1][1:] == got[5][1:] and got[2][1:] == got[3][1:]
    for i, t in texts.items():
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        media = bytes(kept[i].media)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        codec, rate, data = A.read(media)
        assert data == padded and f"pcm_samples={len(kept[i].pcm) // 2}" in r.feature
    assert A.media_report(docs.limit(0)).count() == 0
