import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ridgeline.llm import scoring as S


def plain_tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def rows(n=260):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgÉ日", k=rng.randint(1, 5))) for _ in range(250)]
    out = [(i, " ".join(rng.choices(words, weights=range(250, 0, -1), k=rng.randint(0, 90)))) for i in range(n)]
    return out + [(1000, None), (1001, ""), (1002, " \t"), (1003, "Aa aA\x0bAA\x1cx  aa"), (1004, "unknownword " * 20000), (5, out[5][1]), (5, out[5][1]), (6, "other text"), (None, "no id")]


def test_tokens_equal_plain_splitting():
    texts = [t or "" for _, t in rows()]
    hashes, counts = S.tokens(pa.array(texts))
    want = [[S.END_HASH if w is None else S.xxhash.xxh64_intdigest(w.encode()) for w in plain_tokens(t)] for t in texts]
    assert counts.tolist() == list(map(len, want))
    assert hashes.tolist() == [int(x) for w in want for x in w]


def test_filter_gives_levels_back():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 2**64, 20000, dtype=np.uint64))
    counts = rng.geometric(0.1, len(hashes))
    own = S.slice_of(hashes, 4)
    segments = [S.build_segment(hashes[own == p], counts[own == p], 1 << 22)[0] for p in range(4)]
    got = S.Filter(segments).levels(hashes)
    want = S.level_of(counts)
    assert (got >= want).all() and (got > want).mean() < 0.05
    other = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    assert (S.Filter(segments).levels(other) > 0).mean() < 0.05
    # too small a share: the rarest are left out, by power of two, and the rest is still found
    small, floor = S.build_segment(hashes, counts, 10 * 20000)
    assert floor > 1 and len(small) * 8 <= 10 * 20000 + 64
    kept = counts >= floor
    assert (S.Filter([small]).levels(hashes[kept]) >= want[kept]).all()


def check(spark, monkeypatch=None):
    all_ = rows()
    docs = spark.createDataFrame([(*r, "x") for r in all_], "doc_id long, text string, score string")
    counts = Counter()
    for i, t in all_:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update(plain_tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    got = S.score_report(docs).collect()
    assert len(got) == len(all_)
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    want = []
    for i, t in all_:
        own = plain_tokens(t)
        want.append((i, len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)))
    for r, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(want, key=key)):
        assert r[:3] == w[:3] and math.isclose(r[3], w[3], rel_tol=1e-9)
    assert {r.train_tokens for r in got} == {total}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2) for r in got)
    return {(r.doc_id, r.n_tokens): r.score for r in got}, all_, counts


def test_scores_equal_brute_force(spark):
    scores, all_, counts = check(spark)
    both = Counter()
    for i, t in all_:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            own = plain_tokens(t)
            both.update(zip([None, *own], own))
    norm = sum(counts.values()) + len(counts) + 1
    off = []
    for i, t in all_:
        own = plain_tokens(t)
        want = 0.0
        for v, w in zip([None, *own], own):
            level = int(math.log2(both[v, w])) + 1 if both[v, w] else 0
            joint = min(S.COUNTS[level], counts[v])
            want += math.log10((joint + S.MU * (counts[w] + 1) / norm) / (counts[v] + S.MU))
        off.append(abs(scores[i, len(own)] - want) / abs(want))
    assert np.mean(off) < 0.01  # only false positives of the filter differ


def test_rare_words_take_the_exchange(spark, monkeypatch):
    monkeypatch.setattr(S, "COMMON", 4)
    monkeypatch.setattr(S, "FLUSH_TOKENS", 500)
    check(spark)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.score_report(docs).count() == 0
    only = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")], docs.schema)
    (r,) = S.score_report(only).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and r.held_out and r.base_score == 0 and r.score <= 0


def test_pairs_beyond_the_broadcast_give_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(S, "COMMON", 8)
    monkeypatch.setattr(S, "FLUSH_PAIRS", 500, raising=False)
    scores = {}
    for room in (1 << 30, 4000):  # bits for all n-grams once, and for few of them
        for name in ("MAX_BITS", "PAIR_BITS"):
            monkeypatch.setattr(S, name, room, raising=False)
        scores[room], _, _ = check(spark)
    assert scores[4000].keys() == scores[1 << 30].keys()
    assert all(math.isclose(s, scores[1 << 30][k], rel_tol=1e-9) for k, s in scores[4000].items())
