import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import mixing as M


def plain_targets(sizes):
    """Targets by sharing again and again what capped sources leave."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def documents(seed, sources, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choices(sources, weights=[len(sources) * 3, *range(1, len(sources))])[0]
        rows.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(int(rng.lognormvariate(3, 1))))))
        rows[-1] = (*rows[-1], s)
    return rows + [(9001, None, sources[0]), (9002, "", sources[0]), (9003, " \t", sources[0]), (9004, "long " * 30000, sources[0])]


@pytest.mark.parametrize("seed, sources", [(1, ["a", "B", "é", None, "zz"]), (2, ["only"]), (3, [f"s{k}" for k in range(11)])])
def test_targets_and_copies(spark, seed, sources):
    rows = documents(seed, sources)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size long")
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets = plain_targets(sizes)
    source = {r[0]: r[2] for r in rows}
    got = M.mixed_report(docs).collect()
    assert len(got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == words(next(t for i, t, _ in rows if i == r.doc_id)) and r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s], rel=1e-12)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        # certain whole copies, and one more at most
        assert r.size == 0 or r.copies - int(r.target / r.source_size) in (0, 1)
        taken[s], largest[s] = taken.get(s, 0) + r.taken, max(largest.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mixed_report(docs.repartition(7)).collect()))
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_order_is_pareto(spark):
    """Of two halves whose inclusion odds differ, the likelier is taken more often; equal odds are taken alike."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("source"))
    odds = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    plain = M.mix(docs).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("h")).agg(F.avg("__copies").alias("c")).collect()
    tilted = M.mix(docs, weight=odds).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("h")).agg(F.avg("__copies").alias("c")).collect()
    p, t = {r.h: r.c for r in plain}, {r.h: r.c for r in tilted}
    assert abs(p[0] - p[1]) < 0.05 and t[0] > t[1] + 0.1


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 9 + [(2, None, None)], "doc_id long, text string, source string")
    got = M.mixed_report(docs).collect()
    assert len(got) == 10 and all(r.taken <= 2 * r.size for r in got)
    assert M.mixed_report(docs.limit(0)).count() == 0 and M.mixed_documents(docs.limit(0)).count() == 0
    assert M.mixed_report(docs.where("doc_id = 2")).first().taken == 0


def test_columns_that_clash(spark):
    names = ["b", "c_id", "c_rank", "c_tie", "_target", "_source_size", "size", "rank", "row", "copies", "id", "odds", "a.b"]
    docs = spark.createDataFrame([(i, "one two " * (i + 1), "s" if i % 2 else None, *(f"{n}{i}" for n in names)) for i in range(8)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    report = M.mixed_report(docs).collect()
    got = M.mixed_documents(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r) for r in docs.collect() for _ in range(next(x.copies for x in report if x.doc_id == r.doc_id))), key=str)


def plain_probabilities(rows, due):
    """Probabilities that times sizes sum to due: rows (size, odds) that would pass 1 are certain, one round after the other."""
    certain = set()
    while True:
        left = sum(n * w for i, (n, w) in enumerate(rows) if i not in certain)
        scale = max(0.0, due - sum(rows[i][0] for i in certain)) / left if left else 0.0
        more = {i for i, (_, w) in enumerate(rows) if i not in certain and scale * w >= 1}
        if not more:
            return [1.0 if i in certain else scale * w for i, (_, w) in enumerate(rows)]
        certain |= more


def test_unequal_probabilities_are_inclusion_probabilities(spark):
    """Certain documents are always taken, the others as often as their probability says: by class of size and odds, over several seeds."""
    rows = [(i, "w " * (3 + i % 4), "b", float(1 + i % 5) if i % 40 else 400.0) for i in range(3000)] + [(10_000 + i, "w " * 4, "a", 1.0) for i in range(1800)]
    docs = M.materialize(spark.createDataFrame(rows, "doc_id long, text string, source string, w double"))
    taken, chosen = {}, []
    for seed in range(3):
        got = M.mixed_report(docs, seed=seed, weight=F.col("w")).where("doc_id < 10000").orderBy("doc_id").collect()
        due, sure = got[0].target - got[0].target // got[0].source_size * got[0].source_size, int(got[0].target // got[0].source_size)
        want = plain_probabilities([(r.size, rows[r.doc_id][3]) for r in got], due)
        assert due > 0 and abs(sum(p * r.size for p, r in zip(want, got)) - due) < 1e-6
        assert abs(sum(r.taken - sure * r.size for r in got) - due) <= 3  # of fixed size
        for p, r in zip(want, got):
            taken.setdefault((p, r.size, rows[r.doc_id][3]), []).append(r.copies - sure)
        chosen.append({r.doc_id for r in got if r.copies > sure})
    assert any(p == 1 for p, _, _ in taken)
    for (p, _, _), x in taken.items():
        assert abs(sum(x) / len(x) - p) < (1e-9 if p == 1 else 4 * (p * (1 - p) / len(x)) ** 0.5 + 0.02)
    plain = {r.doc_id for r in M.mixed_report(docs, seed=2).where("doc_id < 10000").collect() if r.copies > sure}
    assert len(plain - chosen[2]) > 50  # not the order of u
