import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from ridgeline.llm.pieces import SPACE, encoded, load

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


FIXED = ["", " ", "  ", "a", "  a  b ", "a▁b", "▁", "▁▁ ", "\t\na", "é\xa0x", "\x00a", "ﬁ ① Ａ", "한국어 텍스트", "a\r\nb", "<s>x</s>", "<0x0A>", "﻿x", "é", "🎉🎉 ok", "a" * 500, "the" * 300, " " * 40 + "x" + " " * 17, "x\n" * 200, "日本語" * 400]


@pytest.mark.parametrize("text", FIXED)
def test_fixed_texts(both, text):
    ours, theirs = both
    ids = theirs.encode(text)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids)


def test_random_texts(both):
    ours, theirs = both
    rng = random.Random(5)
    chars = list("abcdefghijklmnopqrstuvwxyz" * 3 + "   \n\tÉéß▁.,!?0123456789<>|#日本🎉́ABC")
    words = ["".join(rng.choices(chars, k=rng.randint(1, 30))) for _ in range(4000)]
    pieces = [p for p in ours.pieces if p[:1] != "<"]
    words += ["".join(rng.choices(pieces, k=rng.randint(1, 8))).replace(SPACE, " ") for _ in range(4000)]
    for text in words:
        ids = theirs.encode(text)
        assert ours.encode(text) == ids, repr(text)
        assert ours.decode(ids) == theirs.decode(ids), repr(text)


def test_runs_of_spaces(both):
    ours, theirs = both
    for n in range(70):
        for text in (" " * n, " " * n + "the", "the" + " " * n, "a" + " " * n + "b"):
            assert ours.encode(text) == theirs.encode(text)


def test_decodes_invalid_bytes(both):
    ours, theirs = both
    for raw in (b"\xff", b"\xc3", b"\xe2\x81", b"\xe2\x81\x87", b"a\xc3\xa9\xff", b"\xf0\x9f\x8e", b"\xed\xa0\x80"):
        ids = [ours.bytes[b] for b in raw]
        assert ours.decode(ids) == theirs.decode(ids)


def test_table(spark, both):
    _, theirs = both
    rows = [(1, "ab cd", "x"), (2, None, None), (3, "", "x"), (3, "", "x"), (4, "word " * 5000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in encoded(docs, PATH, keep=True).collect()}
    assert encoded(docs, PATH).count() == 5
    for i, text, _ in rows:
        ids = theirs.encode(text or "") + [2]
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
    assert encoded(docs.limit(0), PATH).count() == 0
