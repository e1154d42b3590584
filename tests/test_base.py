import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgeline import plans, registry, sources
from ridgeline.functions import text as T
from ridgeline.functions import weblog
from ridgeline.operators import accesslog as A
from ridgeline.operators import basics as B
from ridgeline.operators import star
from ridgeline.operators import wordcount as W
from ridgeline.schemas import struct
from ridgeline.streaming import incremental as I

TINY = "/root/testdata/sf0.001"


def test_range(spark):
    assert B.range_sum(spark).first()[0] == 4999950000
    assert B.range_sum(spark, divisor=7).first()[0] == 714264285


@pytest.fixture(scope="module")
def toy(spark):
    return sources.in_memory(spark, [(w,) for w in ["cat", "elephant", "rat", "rat", "cat"]], "word string", partitions=4)


def test_toy_words(toy):
    assert {r.word: r.n for r in W.word_count(toy).collect()} == {"cat": 2, "elephant": 1, "rat": 2}
    assert W.unique_words(toy).first()[0] == 3
    assert W.mean_count(toy).first()[0] == 1.67
    assert W.total_words(toy).first()[0] == 5
    assert sorted(r.n_chars for r in W.word_lengths(toy).collect()) == [3, 3, 3, 3, 8]
    assert {r.word_upper for r in W.upper_words(toy).collect()} == {"CAT", "ELEPHANT", "RAT"}
    assert [tuple(r) for r in W.top_words(toy, 2).collect()] == [("cat", 2), ("rat", 2)]
    assert [r.word for r in W.last_words(toy, 3).collect()] == ["rat", "rat", "elephant"]
    none = toy.limit(0)
    assert W.unique_words(none).first()[0] == 0 and W.mean_count(none).first()[0] is None


def test_cleaning(spark):
    lines = [" The Elephant's 4 cats. ", "Hi, you!", " No under_score!", "a\tb", "", "   ", None, "É a", "\u212aelvin \u0130x A\u0307"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [tuple(r) for r in df.select(T.clean_line(F.col("line")), T.words(T.clean_line(F.col("line")))).collect()]
    assert [g[0] for g in got] == ["the elephants 4 cats", "hi you", "no underscore", "ab", "", "", None, "a", "kelvin ix a"]
    assert [g[1] for g in got] == [["the", "elephants", "4", "cats"], ["hi", "you"], ["no", "underscore"], ["ab"], [], [], None, ["a"], ["kelvin", "ix", "a"]]
    labels = spark.createDataFrame([(6.9,), (7.0,), (93.4,)], "v double").select(T.percent_label(F.col("v"))).collect()
    assert [r[0] for r in labels] == ["", "7%", "93%"]


LINES = [
    '127.0.0.1 - - [01/Aug/1995:00:00:01 -0400] "GET /images/launch-logo.gif HTTP/1.0" 200 1839',
    'h - - [01/Aug/1995:05:00:01 -0400] "GET /a b c HTTP/1.0" 404 -',
    'h - - [01/Aug/1995:05:00:01 -0400] "GET /a" 302 0',
    "garbage",
    'h - - [01/Aug/1995:05:00:01 -0400] "GET /a HTTP/1.0" 200 abc',
    'h - - [99/Aug/1995:05:00:01 -0400] "GET /a HTTP/1.0" 200 5',
    None,
]


def test_log_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    good, bad = A.parse(df, weblog.LENIENT)
    rows = sorted(good.collect(), key=lambda r: r.response_code)
    assert good.dtypes == [(f.name, f.dataType.simpleString()) for f in struct("access_log")]
    assert [(r.host, r.endpoint, r.protocol, r.response_code, r.content_size) for r in rows] == [("127.0.0.1", "/images/launch-logo.gif", "", 200, 1839), ("h", "/a", "", 302, 0), ("h", "/a", "", 404, 0)]
    assert rows[0].date_time == dt.datetime(1995, 8, 1, 0, 0, 1)
    assert bad.count() == 4
    strict, rest = A.parse(df, weblog.STRICT)
    assert sorted((r.endpoint, r.protocol) for r in strict.collect()) == [("/a", ""), ("/images/launch-logo.gif", "HTTP/1.0")]
    assert rest.count() == 5
    assert A.size_stats(good).first()[:] == (613, 0, 1839)
    assert [tuple(r) for r in A.top_endpoints(good, 1).collect()] == [("/a", 2)]
    assert {r.response_code: r.label for r in A.status_shares(good).collect()} == {200: "33%", 302: "33%", 404: "33%"}
    assert {tuple(r) for r in A.hourly_hosts(good).collect()} == {(0, 1), (5, 1)}
    assert {tuple(r) for r in A.hourly_requests_per_host(good).collect()} == {(0, 1), (5, 2)}


SALES = "order long, warehouse long, date_key date, address_key long, center_key long, ship_cost decimal(12,2), profit decimal(12,2)"


def star_rows(spark, orders):
    day = dt.date(1998, 3, 10)
    sales = spark.createDataFrame([(o, w, day, 1, 1, 1, 2) for o, w in orders], SALES.replace("decimal(12,2)", "int")).withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("ship_cost", "profit")})
    return {
        "sales": sales, "returns": spark.createDataFrame([(9,)], "order long"), "dates": spark.createDataFrame([(day, day)], "date_key date, day date"),
        "addresses": spark.createDataFrame([(1, "BUILDING")], "address_key long, state string"), "centers": spark.createDataFrame([(1, "NATION_3")], "center_key long, county string"),
    }


def test_several_warehouses(spark):
    t = star_rows(spark, [(1, 1), (1, 2), (1, None), (2, 5), (2, 5), (9, 1), (9, 2)])
    assert sorted((r.order, r.warehouse) for r in star.from_several(t["sales"]).where("order < 9").collect()) == [(1, 1), (1, 2)]
    assert star.from_several(t["sales"], "nunique").where("order < 9").count() == 3
    assert star.from_several_by_exists(t["sales"]).where("order < 9").count() == 2
    for form, want in (("exists", (1, 2.0, 4.0)), ("exists_join", (1, 2.0, 4.0)), ("nunique", (1, 3.0, 6.0))):
        assert star.multi_source_orders(**t, form=form).first()[:] == want
    nothing = star.MultiSource(state="nowhere")
    assert star.multi_source_orders(**t, p=nothing).first()[:] == (0, None, None)
    edge = star.MultiSource(start=dt.date(1998, 3, 10), end=dt.date(1998, 4, 1), inclusive=False)
    assert star.multi_source_orders(**t, p=edge).first()[0] == 0


def test_above_average(spark):
    totals = spark.createDataFrame([(1, 1, 100), (2, 1, 10), (3, 1, 10), (4, 2, 5), (1, 3, 90), (5, 3, 1)], "customer long, store long, total int")
    stores = spark.createDataFrame([(1, "TN"), (2, "TN"), (3, "GA")], "store long, state string")
    people = spark.createDataFrame([(i, f"c{i}") for i in range(1, 6)], "customer long, name string")
    for got in (star.above_group_average(totals, stores, people, "TN"), star.above_group_average(totals, stores, people, "TN", "join"), star.above_group_average_sql(spark, totals, stores, people, "TN")):
        assert [r.name for r in got.collect()] == ["c1"]
    assert [r.name for r in star.above_group_average(totals, stores, people, "TN", cross=True).collect()] == ["c1"] * 4
    assert star.above_group_average(totals, stores, people, "nowhere", cross=True).count() == 0


def test_numbering_and_rounds(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.col("id") % 13)
    got = B.numbered(df, "v", "id").collect()
    assert sorted((r.v, r.id) for r in got) == [(r.v, r.id) for r in sorted(got, key=lambda r: r["index"])]
    assert sorted(r["index"] for r in got) == list(range(1000))
    parts = B.rounds(df, 6)
    assert sum(p.count() for p in parts) == 1000 and B.concat(*parts).distinct().count() == 1000
    assert sources.repeated(df, 3).count() == 3000 and sources.repeated(df, 0).count() == 0


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1|NM|x|\n2|-|y|\n")
    (tmp_path / "b.csv").write_text("3||z|\n")
    (tmp_path / "note.txt").write_text("9|q|q|\n")
    got = sources.read_delimited(spark, str(tmp_path), schema="k int, a string, b string", null="-", suffix=".csv")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "NM", "x"), (2, None, "y"), (3, None, "z")]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "c.csv").write_text("k|v\n1|2.50|\n")
    assert [tuple(map(str, r)) for r in sources.read_delimited(spark, str(tmp_path / "h"), schema="k int, v decimal(7,2)", header=True).collect()] == [("1", "2.50")]
    with pytest.raises(ValueError):
        sources.read_delimited(spark, str(tmp_path))
    assert [len(struct(t)) for t in ("catalog_sales", "store_returns", "date_dim")] == [34, 20, 28]
    row = "1|" * 13
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "ca.dat").write_text(row + "\n")
    table = sources.create_table(spark, "customer_address", str(tmp_path / "t"))
    assert table.first()["ca_address_sk"] == 1 and table.count() == 1
    sources.write_csv(table, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    sources.write_metrics(spark, [{"q": 1}], str(tmp_path / "m"))
    assert sources.read_lines(spark, str(tmp_path / "m"), 2).first().value == '{"q": 1}'
    sources.register({"ca": table})
    assert spark.sql("select count(*) from ca").first()[0] == 1
    assert sources.read_parquet_tables(spark, TINY, "nation")["nation"].count() == 25
    spark.sql("drop table customer_address")


def test_streams_equal_batches(spark, tmp_path):
    docs = registry.table(spark, TINY, "documents")
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    stream = I.file_stream(spark, str(tmp_path), "documents", docs.schema, files=2)
    got = {r.word: r.n for r in I.run_to_end(W.word_count(W.words_of(W.lines_of(stream))), seen.append).collect()}
    assert got == {r.word: r.n for r in W.word_count(W.words_of(W.lines_of(docs))).collect()}
    assert len(seen) >= 4  # seven files, two a round, none left over
    assert registry.QUERIES["incremental_star"](spark, TINY).first() == registry.QUERIES["star_exists_not_exists"](spark, TINY).first()


def test_plans(spark):
    q = registry.QUERIES
    s = plans.plan_summary(q["star_exists_not_exists"](spark, TINY))
    assert "LeftAnti" in s["joins"] and "LeftSemi" in s["joins"] and "CartesianProduct" not in s["nodes"] and "BroadcastNestedLoopJoin" not in s["nodes"]
    assert any("l_orderkey" in r for r in s["read"]) and not any("l_shipdate" in r for r in s["read"])
    assert "TakeOrderedAndProject" in plans.plan_summary(q["word_top10"](spark, TINY))["nodes"]
    assert any("EqualTo" in p for p in plans.plan_summary(q["above_group_avg_window"](spark, TINY))["pushed"])
    m = plans.run_metrics(q["clf_status_counts"](spark, TINY))
    assert m["seconds"] > 0 and m["columns"] == ["response_code", "n"]
    assert plans.diff_plans(q["above_group_avg_window"](spark, TINY), q["above_group_avg_join"](spark, TINY))
    for name, f in q.items():
        if "above_group_avg_subquery" not in name:
            assert "CartesianProduct" not in plans.physical(f(spark, TINY)), name


def test_planned_start():
    got = plans.planned_start({"a": 10.0, "b": 4.0, "c": 3.0, "d": 20.0}, {"c": ["a", "b"], "d": ["c"]})
    assert got["a"] == (0.0, 10.0) and got["c"] == (7.0, 10.0) and got["d"] == (7.0, 27.0)
    with pytest.raises(ValueError):
        plans.planned_start({"a": 1.0}, {"a": ["a"]})


def test_rounds_report_as_they_come(spark, tmp_path):
    """More rounds than the engine keeps reports of: each is told once, in order; a result of rounds equals the batch's."""
    docs = registry.table(spark, TINY, "documents").select("doc_id", "text")
    docs.repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")
    try:
        seen = []
        got = I.word_count(I.file_stream(spark, str(tmp_path), "documents", docs.schema), seen.append)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert {r.word: r.n for r in got.collect()} == {r.word: r.n for r in W.word_count(W.words_of(W.lines_of(docs))).collect()}
    numbers = [r["batchId"] for r in seen]
    assert numbers == sorted(set(numbers)) and numbers[-1] >= 8 and numbers[0] == 0
    empty = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "documents.parquet")).where("doc_id < -5")
    assert I.word_count(empty).count() == 0


def test_metrics_of_a_run(spark):
    m = plans.run_metrics(registry.QUERIES["clf_status_counts"](spark, TINY))
    assert m["rows"] == registry.QUERIES["clf_status_counts"](spark, TINY).count() and m["plan"]["final"] and m["seconds"] > 0


def test_filters_come_before_the_order_joins(spark):
    s = plans.physical(registry.QUERIES["star_exists_not_exists"](spark, TINY))
    assert s.count("orders.parquet") == 2  # once for the sales, once for the orders still wanted
    assert "year(" not in plans.physical(registry.QUERIES["returns_by_customer_store"](spark, TINY))
