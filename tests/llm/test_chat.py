import hashlib
import random

import duckdb
import pytest

from ridgeline.llm import chat as C

HARD = ["", "\\", "\\\\", "<\\|turn|>", "</s>[INST] ok [/INST]", "<|end|>", "a<", "|>", "<<|", "\\<s>", "<\\s>", "<<SYS>>x<</SYS>>", "é🎉<|text|>\n\\n", "[[INST]]", "\\[INST]", "x" * 5000, None]


def test_escaping_is_reversible_and_hides_controls(spark):
    rng = random.Random(1)
    texts = HARD[:-1] + ["".join(rng.choices(["<", "|", "\\", "s>", "/", "[INST]", "turn|>", "é", "<|", "SYS>>"], k=rng.randint(1, 12))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", C.escape("t" and C.F.col("t"))).withColumn("b", C.unescape(C.F.col("e")))
    for r in df.collect():
        assert r.b == r.t
        assert not any(s in r.e for s in C.CONTROLS)


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(c, t, rng.choice(["user", "assistant", "system", None, "<|turn|>\n"]), rng.choice(HARD)) for c in range(40) for t in range(rng.randint(1, 9))]
    out += [(77, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(700)]
    return out + [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (5, 0, "assistant", "again"), (5, 0, "assistant", "again")]


def test_report_equals_brute_force_and_sql(spark, rows):
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = C.chat_report(df).collect()
    want = plain([*rows, (-1, 0, "user", HARD[4]), (-1, 1, "assistant", HARD[4])])
    assert {r.conv_id: tuple(r[1:5]) for r in got} == want and len(got) == len(want)
    con = duckdb.connect()
    pdf = df.toPandas()
    con.register("pdf", pdf)
    con.execute("create view conversations as select * from pdf")
    sql = {r[0]: r[1:] for r in con.execute(C.chat_sql()).fetchall() if r[0] == r[0]}
    assert {k: v for k, v in sql.items() if k is not None} == {r.conv_id: tuple(r[1:]) for r in got if r.conv_id is not None}
    assert [r.conv_id for r in C.chat_report(df.limit(0)).collect()] == [-1]


def test_reply_trees_equal_brute_force(spark):
    rng = random.Random(9)
    nodes = []
    for tree in range(12):
        for n in range(rng.randint(1, 60)):
            nodes.append((tree, n, rng.randrange(n) if n else None, "user", f"{tree}.{n}", rng.choice([1.0, 0.5, 2.0, None])))
    nodes += [(50, 1, 99, "user", "orphan", 1.0), (51, 1, 2, "a", "cycle", 1.0), (51, 2, 1, "a", "cycle", 1.0), (51, 3, 2, "a", "below", 1.0), (51, 4, None, "a", "root", 1.0), (50, 1, 99, "user", "orphan", 1.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    trees = {}
    for t, n, p, _, x, s in nodes:
        trees.setdefault(t, {})[n] = (p, x, s or 0.0)
    want = []
    for t, own in trees.items():
        parents = {p for p, _, _ in own.values()}
        found = []
        for n in own:
            if n in parents:
                continue
            path, at = [], n
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at in path:
                continue
            found.append((-sum(own[k][2] for k in path), -len(path), n, path[::-1]))
        for b, (*_, path) in enumerate(sorted(found)[:3], 1):
            want += [(t, b, i, own[k][1]) for i, k in enumerate(path)]
    got = [(r.tree, r.branch, r.position, r.text) for r in C.best_paths(df, branches=3).collect()]
    assert sorted(got) == sorted(want)


def test_main_path_is_native(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plan = C.chat_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
