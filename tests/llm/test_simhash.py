import random
import re

import numpy as np
import xxhash

from ridgeline.llm import simhash as S
from ridgeline.llm.components import components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Least reachable index for each fingerprint, by union-find over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgÉß", k=rng.randint(1, 6))) for _ in range(300)]
    out = [None, "", " \t", "one", "ONE two", "one\x0btwo three", "É é É é", "x " * 30000]
    for _ in range(60):
        own = rng.choices(words, k=rng.randint(3, 400))
        out.append(" ".join(own))
        for _ in range(rng.randint(0, 4)):
            copy = own[:]
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append("\n".join(copy))
    return out + out[10:14]


def test_fingerprints_equal_brute_force(monkeypatch):
    all_ = texts()
    want = [plain_print(t) for t in all_]
    assert S.fingerprints([t or "" for t in all_]).tolist() == want
    assert len(S.masks()) == 10 and all((m % (1 << 64)).bit_count() >= 38 for m in S.masks())


def test_report_equals_brute_force(spark):
    all_ = texts()
    docs = spark.createDataFrame([(100 - i if i < 40 else i + 100, t, "x", 1) for i, t in enumerate(all_)], "doc_id long, text string, fp string, n long")
    rows = sorted(((100 - i if i < 40 else i + 100), t) for i, t in enumerate(all_))
    prints = [plain_print(t) for _, t in rows]
    groups = plain_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_report(docs).collect()}
    assert got == {i: (f"{p:016x}", rows[g][0]) for (i, _), p, g in zip(rows, prints, groups)}
    stay = S.one_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({c for _, c in got.values()})
    assert S.simhash_report(docs.limit(0)).count() == 0 and S.one_of_each(docs.limit(0)).count() == 0
    twice = docs.unionAll(docs)
    assert S.simhash_report(twice).count() == 2 * len(all_) and S.one_of_each(twice).count() == stay.count()


def test_hot_blocks_lose_no_link(spark):
    rng = random.Random(6)
    prints = set()
    for base in (0, rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(150):
            p = base
            for _ in range(rng.randint(0, 6)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "id long, fp long")
    assert {r.id: r.component_id for r in S.grouped(df).collect()} == dict(enumerate(plain_groups(prints)))


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + rng.randrange(i)) for i in range(1, 80)] + [(5, 5), (2000, 2001), (2001, 2000), (-7, 2001)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(80)}, 2000: -7, 2001: -7, -7: -7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_columns_that_clash(spark):
    rows = [(1, "a b c d", 7, "x", 1), (2, "a b c d", 8, "y", 2), (3, "q r s", 9, "z", 3), (3, "q r s", 9, "z", 3), (None, "u v w", 1, "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __fp string, id_key int")
    got = S.one_of_each(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
