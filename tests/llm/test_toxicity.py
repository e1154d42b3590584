import random
import zlib

import numpy as np
import pyarrow as pa

from ridgeline.llm import toxicity as T


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(3, 60))
        toxic = int(rng.random() < 0.4)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zork", "Quuxface,", "quuxhead"]))
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), toxic))
    return rows


def plain_pooled(model, text):
    """Each filter's largest response, word by word."""
    words = [w.strip(T.PUNCTUATION) for w in text.lower().split()]
    rows = [sum((model.rows[model.slot[h]] for h in T.hashes(w) if model.slot[h]), np.zeros(T.DIM, dtype=np.float32)) for w in words]
    rows += [np.zeros(T.DIM, dtype=np.float32)] * 2
    best = np.zeros(T.FILTERS * len(T.WIDTHS))
    for k, f in enumerate(model.filters):
        for i in range(len(words) + 1):
            r = model.bias[k * T.FILTERS : (k + 1) * T.FILTERS].astype(float)
            for o in range(len(f)):
                if i + o < len(rows):
                    r = r + rows[i + o] @ f[o]
            own = slice(k * T.FILTERS, (k + 1) * T.FILTERS)
            best[own] = np.maximum(best[own], r)
    return best


def test_scores_equal_plain_loops_and_held_out_accuracy(monkeypatch):
    rows = corpus()
    model = T.train([r[1] for r in rows[:700]], [r[3] for r in rows[:700]])
    rest = rows[700:]
    scores = model.scores(pa.array([r[1] for r in rest]))
    assert ((scores >= 0.5) == (np.array([r[3] for r in rest]) == 1)).mean() > 0.97
    for r, s in list(zip(rest, scores))[:30]:
        z = plain_pooled(model, r[1]) @ model.out + model.offset
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-3
    monkeypatch.setattr(T, "CHUNK_WORDS", 16)  # texts longer than a chunk
    assert np.allclose(model.scores(pa.array([r[1] for r in rest])), scores, atol=1e-5)


def test_table(spark):
    rows = corpus()
    docs = spark.createDataFrame([(r[0], r[1], r[2], "x") for r in rows] + [(5000, None, None, None), (5001, "", "en", "y"), (5002, "word " * 40000 + "zork", "en", "y"), (0, rows[0][1], rows[0][2], "x")], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(9999, 1, 1), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = T.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by_id = {r.doc_id: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(by_id[r[0]].held_out for r in held) and sum(r.held_out for r in got) >= len(held)
    assert np.mean([by_id[r[0]].predicted == r[3] for r in held]) > 0.95
    assert by_id[5000].score == by_id[5001].score and 0 <= by_id[5000].score <= 1 and by_id[5002].predicted == 1
    again = {r.doc_id: r.score for r in T.toxicity_report(docs, labels).collect()}
    assert again == {i: r.score for i, r in by_id.items()}
    flags = {r.doc_id: r.flagged for r in got}
    clean = T.clean_documents(docs, labels)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in got if not flags[r.doc_id])


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.toxicity_report(docs, labels).collect()] == [0.0]
    assert T.toxicity_report(docs.limit(0), labels).count() == 0
    only = spark.createDataFrame([(1, 1, 0)], labels.schema)
    assert [r.predicted for r in T.toxicity_report(docs, only).collect()] == [0]


def test_a_cut_class_weighs_as_many_as_all_its_labels(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE", 60)
    rng = random.Random(5)  # words that don't tell: scores can only follow the labels' own rate, 1 in 10
    rows = [(i, " ".join(rng.choices(["red", "green", "blue", "grey"], k=12)), "en", int(i % 10 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    got = T.toxicity_report(docs, labels).collect()
    assert np.mean([r.predicted for r in got]) < 0.1


def test_calibration_counts_errors_by_class_weight():
    scores, toxic = np.array([0.2] * 40 + [0.8] * 30 + [0.9] * 20), np.array([0] * 50 + [1] * 40)
    assert T.thresholds(scores, toxic, ["en"] * 90) == {"en": 0.5}
    assert abs(T.thresholds(scores, toxic, ["en"] * 90, (5.0, 1.0))["en"] - 0.85) < 1e-9


def test_columns_that_clash(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(r[0], r[1], r[2], f"s{r[0]}", r[0], "k") for r in rows], "doc_id long, text string, lang string, __score string, __flagged long, score string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    got = T.clean_documents(docs, labels)
    own = {r.doc_id: tuple(r) for r in docs.collect()}
    assert got.columns == docs.columns and all(own[r.doc_id] == tuple(r) for r in got.collect()) and 0 < got.count() < len(rows)
    assert {c: k for c, k in T.toxicity_report(docs, labels).dtypes} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "flagged": "boolean"}


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = corpus(400)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    seen = []
    real = T.train
    monkeypatch.setattr(T, "train", lambda texts, toxic, **k: seen.append(sum(len(t) for t in texts.to_pylist())) or real(texts, toxic, **k))
    T._last.clear()
    T.fit(docs, labels)
    T.fit(docs, labels)  # the same rows: the model is there
    monkeypatch.setattr(T, "SAMPLE_BYTES", 9000)
    T.fit(docs, labels)
    assert len(seen) == 2 and 0 < seen[1] <= 9000 < seen[0]


def test_sums_of_rows():
    rng = np.random.default_rng(1)
    at, rows = rng.integers(0, 9, 200), rng.random((200, 3))
    out, want = np.ones((9, 3)), np.ones((9, 3))
    T.add_rows(out, at, rows)
    np.add.at(want, at, rows)
    assert np.allclose(out, want)


def test_rows_beyond_the_start_train_and_calibrate(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE", 20)  # of each class, where 288 rows of toxic words are labelled
    monkeypatch.setattr(T, "PART_ROWS", 300)
    rows = corpus(1500, seed=9)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(1, "zz " + rows[1][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    T._last.clear()
    model, by_lang = T.fit(docs, labels)
    T._last.clear()
    again, _ = T.fit(docs.repartition(3), labels)
    assert np.array_equal(model.rows, again.rows) and np.array_equal(model.out, again.out)
    crc = lambda r: zlib.crc32(str(r[0]).encode()) % 5
    training, calibration, held = ([r for r in rows if crc(r) in k] for k in ((2, 3, 4), (1,), (0,)))
    seen = T.texts_with(*T.coded_texts(pa.array([r[1] for r in training])))
    assert np.array_equal(model.slot > 0, seen >= T.MIN_DOCS)
    scores = model.scores(pa.array([r[1] for r in held]))
    assert ((scores >= 0.5) == (np.array([r[3] for r in held]) == 1)).mean() > 0.95
    scores = model.scores(pa.array([r[1] for r in calibration]))
    want = T.thresholds(scores, np.array([r[3] for r in calibration]), [r[2] for r in calibration])
    assert len(want) == 3 and {k: round(v, 5) for k, v in by_lang.items()} == {k: round(v, 5) for k, v in want.items()}
