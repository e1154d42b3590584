import hashlib
import random

import numpy as np
import pytest

from ridgeline.llm import suffixes as S


def plain(rows):
    """(id, n_bytes, n_removed, n_spans, sha256) of each row, window by window."""
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            least[w] = min(least.get(w, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        hit = np.zeros(len(raw) + 1, dtype=bool)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < (2**63 - 1 if i is None else i):
                hit[k : k + 50] = True
        rest = bytes(b for b, h in zip(raw, hit) if not h)
        runs = int((hit[1:] & ~hit[:-1]).sum() + hit[0])
        out.append((i, len(raw), int(hit.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeéß ", k=rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(6, 60))) for _ in range(25)]
    out = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(rng.choice([p, p[a:], p[:a], " ".join(word() for _ in range(rng.randint(1, 40)))]))
        out.append((i * 3 % 161, "\n".join(parts)))
    out += [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 50), (504, "a" * 700), (505, "ab" * 400), (506, "ab" * 400 + "x"), (507, out[3][1]), (507, out[3][1]), (508, out[4][1] * 30), (None, out[5][1]), (None, out[6][1]), (3, passages[0] + "!")]
    out += [(600 + i, "日本語" * 20 + str(i) + passages[i % 25] + passages[(i + 1) % 25]) for i in range(40)]
    return out


def test_pieces():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 400, dtype=np.uint8)
    for size in (1, 2, 3, 7, 16, 20, 21):
        h = S.gram_hashes(raw, size)
        assert len(h) == len(raw) - size + 1
        names = {}
        for k, x in enumerate(h.tolist()):
            assert names.setdefault(raw[k : k + size].tobytes(), x) == x
        assert len(set(names.values())) == len(names)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for width in (1, 2, 5, 31, 32):
        assert S.least_of(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


@pytest.mark.parametrize("least", [3, 10, 50])
def test_intervals_equal_common_prefixes(least):
    rng = np.random.default_rng(least)
    for letters in (2, 5):
        symbols = rng.integers(1, 1 + letters, 500).astype(np.uint16)
        symbols[200:320] = symbols[20:140]
        symbols[100:160] = 1
        symbols[-1] = 0
        order = S.suffix_array(symbols, least)
        short = S.expand_intervals(order, symbols, least)
        assert sorted(order.tolist()) == list(range(500))
        turn = lambda k: np.roll(symbols, -k)[:least].tolist()
        prefixes = [turn(int(k)) for k in order]
        assert prefixes == sorted(prefixes)
        assert short.tolist() == [True] + [a != b for a, b in zip(prefixes, prefixes[1:])]


def test_runs_cover_each_window_once():
    texts = [t.encode() for _, t in rows() if t]
    raw, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(list(map(len, texts)))
    names, text, starts, count = S.window_runs(raw, ends)
    got = sorted(s + k for s, c in zip(starts, count) for k in range(c))
    assert got == [e - len(t) + k for t, e in zip(texts, ends) for k in range(len(t) - 49)]
    of = {}
    for n, s, c in zip(names.tolist(), starts, count):
        for k in range(c):
            assert of.setdefault(raw[s + k : s + k + 50].tobytes(), n) == n


def test_report_equals_brute_force(spark):
    all_ = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in all_], "doc_id long, text string, n_spans string, n_chars int").repartition(5)
    key = lambda r: (2**63 if r[0] is None else r[0], *r[1:])
    assert sorted(map(tuple, S.dedup_report(docs).collect()), key=key) == sorted(plain(all_), key=key)
    kept = S.deduplicated_documents(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = kept.collect()
    assert len(got) == len(all_) and all(r.n_chars == len(r.text) for r in got)
    by = {r.doc_id: r.text for r in got}
    assert by[504] == "" and by[505] == "ab" * 400 and by[506].endswith("x")


def test_slices_in_parts_lose_nothing(monkeypatch, spark):
    docs = spark.createDataFrame([(k, i or 0, t) for k, (i, t) in enumerate(rows())], "h long, id long, text string").select("id", "h", "text")
    runs = S.candidate_runs(docs, S.repeated_names(docs, "text", 1), 1).toArrow()
    whole = sorted(map(str, zip(*(x.tolist() for x in S.removed_in_slice(runs)))))
    monkeypatch.setattr(S, "ARRAY_SYMBOLS", 3000)
    assert sorted(map(str, zip(*(x.tolist() for x in S.removed_in_slice(runs))))) == whole and whole


def test_small_batches_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "FLUSH_BYTES", 3000)
    monkeypatch.setattr(S, "SLICE_BYTES", 1000)
    monkeypatch.setattr(S, "RUN_WINDOWS", 7)
    all_ = rows()
    docs = spark.createDataFrame(all_, "doc_id long, text string").repartition(3)
    key = lambda r: (2**63 if r[0] is None else r[0], *r[1:])
    assert sorted(map(tuple, S.dedup_report(docs).collect()), key=key) == sorted(plain(all_), key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert S.dedup_report(docs).count() == 0 and S.deduplicated_documents(docs).count() == 0
    few = spark.createDataFrame([(1, "short", 5), (2, None, None)], docs.schema)
    assert sorted(r.n_removed for r in S.dedup_report(few).collect()) == [0, 0]


def test_equal_hashes_of_unequal_texts_change_nothing(spark, monkeypatch):
    real = S.mix
    # run texts get one of four hashes, whatever they hold; names keep theirs
    monkeypatch.setattr(S, "mix", lambda x, salt: real(x, salt) & np.uint64(3) if salt == 3 else real(x, salt))
    monkeypatch.setattr(S, "COMPARE_BYTES", 300)
    docs = spark.createDataFrame([(k, i or 0, t) for k, (i, t) in enumerate(rows())], "h long, id long, text string").select("id", "h", "text").toArrow()
    import pyarrow as pa

    class Local:  # what candidate_runs asks of a table, in this process
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return pa.Table.from_batches(run(iter(docs.combine_chunks().to_batches())))

        class sparkSession:
            pass

    segments = S.repeated_names(spark.createDataFrame([(t,) for _, t in rows()], "text string"), "text", 1)
    monkeypatch.setattr(S, "broadcast", lambda _, value: type("Held", (), {"value": value}))
    found = [x.tolist() for x in S.removed_in_slice(S.candidate_runs(Local(), segments, 1))]
    monkeypatch.setattr(S, "mix", real)
    want = [x.tolist() for x in S.removed_in_slice(S.candidate_runs(Local(), segments, 1))]
    assert set(map(str, zip(*found))) == set(map(str, zip(*want))) and want[0]


def test_columns_that_clash(spark):
    all_ = [(1, "x" * 60, 4, 60, "keep", 2), (2, "x" * 60 + "y", 5, 61, "keep", 3)]
    docs = spark.createDataFrame(all_, "doc_id long, text string, __kept int, n_chars int, `a.b` string, slice int")
    got = S.deduplicated_documents(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "x" * 60, 4, 60, "keep", 2), (2, "y", 5, 1, "keep", 3)]
    assert sorted(r.n_removed for r in S.dedup_report(docs).collect()) == [0, 60]
