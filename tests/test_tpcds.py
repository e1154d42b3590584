import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from ridgeline.operators import basics as B
from ridgeline.operators import tpcds
from ridgeline.schemas import SCHEMAS, struct


def frame(spark, table, rows):
    """Rows that name a few columns of a declared table; the others are null."""
    kind = struct(table)
    df = spark.createDataFrame([tuple(str(r[f.name]) if r.get(f.name) is not None else None for f in kind) for r in rows], ", ".join(f"{f.name} string" for f in kind))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in kind])


def tables(spark):
    rng = random.Random(12)
    days = [dt.date(2001, 12, 1) + dt.timedelta(days=k) for k in range(200)]
    t = {
        "date_dim": [{"d_date_sk": k, "d_date": d, "d_year": d.year} for k, d in enumerate(days)],
        "customer_address": [{"ca_address_sk": k, "ca_state": rng.choice(["IA", "GA"])} for k in range(20)],
        "call_center": [{"cc_call_center_sk": k, "cc_county": rng.choice(["Williamson County", "Other"])} for k in range(6)],
        "store": [{"s_store_sk": k, "s_state": rng.choice(["TN", "TX"])} for k in range(8)],
        "customer": [{"c_customer_sk": k, "c_customer_id": f"AAAA{k:05d}"} for k in range(60)],
        "catalog_sales": [],
        "catalog_returns": [{"cr_order_number": rng.randrange(400)} for _ in range(60)],
        "store_returns": [{"sr_customer_sk": rng.randrange(60), "sr_store_sk": rng.randrange(8), "sr_returned_date_sk": rng.randrange(200), "sr_return_amt": f"{rng.uniform(1, 200):.2f}"} for _ in range(900)],
    }
    for order in range(400):
        for _ in range(rng.randint(1, 4)):
            t["catalog_sales"].append({"cs_order_number": order, "cs_warehouse_sk": rng.choice([1, 1, 2, 3, None]), "cs_ship_date_sk": rng.randrange(200), "cs_ship_addr_sk": rng.randrange(20), "cs_call_center_sk": rng.randrange(6), "cs_ext_ship_cost": f"{rng.uniform(0, 90):.2f}", "cs_net_profit": f"{rng.uniform(-90, 90):.2f}"})
    return {n: frame(spark, n, r) for n, r in t.items()}


Q16 = """
    SELECT count(DISTINCT cs_order_number), CAST(sum(cs_ext_ship_cost) AS DOUBLE), CAST(sum(cs_net_profit) AS DOUBLE)
    FROM catalog_sales a, date_dim, customer_address, call_center
    WHERE d_date {days} AND cs_ship_date_sk = d_date_sk AND cs_ship_addr_sk = ca_address_sk AND ca_state = '{state}'
        AND cs_call_center_sk = cc_call_center_sk AND cc_county IN ('Williamson County', 'Williamson County')
        AND {several} AND NOT EXISTS (SELECT 1 FROM catalog_returns WHERE cr_order_number = a.cs_order_number)"""
EXISTS = "EXISTS (SELECT 1 FROM catalog_sales b WHERE b.cs_order_number = a.cs_order_number AND b.cs_warehouse_sk <> a.cs_warehouse_sk)"
COUNTED = "(SELECT count(DISTINCT b.cs_warehouse_sk) FROM catalog_sales b WHERE b.cs_order_number = a.cs_order_number) > 1"
Q1 = """
    WITH t AS (SELECT sr_customer_sk c, sr_store_sk s, sum(sr_return_amt) v FROM store_returns, date_dim WHERE sr_returned_date_sk = d_date_sk AND d_year = {year} GROUP BY 1, 2)
    SELECT c_customer_id FROM t, store, customer WHERE CAST(v AS DOUBLE) > (SELECT avg(CAST(v AS DOUBLE)) * 1.2 FROM t u WHERE u.s = t.s) {store}
        AND c = c_customer_sk AND s_state = 'TN' ORDER BY 1 LIMIT 100"""


def test_questions_equal_sql(spark, tmp_path):
    t = tables(spark)
    con = duckdb.connect()
    for n, df in t.items():
        df.coalesce(1).write.parquet(str(tmp_path / n))
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}/*.parquet'")
    five = [t[n] for n in ("catalog_sales", "date_dim", "customer_address", "call_center", "catalog_returns")]
    inclusive, exclusive = "BETWEEN DATE '2002-03-01' AND DATE '2002-04-30'", "> DATE '2002-02-01' AND d_date < DATE '2002-04-01'"
    for p, form, days, state, several in (
        (tpcds.Q16, "exists", inclusive, "IA", EXISTS), (tpcds.Q16, "exists_join", inclusive, "IA", EXISTS),
        (tpcds.Q16, "nunique", inclusive, "IA", COUNTED), (tpcds.Q16_STAGED, "nunique", exclusive, "GA", COUNTED),
    ):
        want = con.execute(Q16.format(days=days, state=state, several=several)).fetchall()[0]
        got = tpcds.q16(*five, p=p, form=form).first()
        assert want[0] > 3 and got[0] == want[0] and abs(got[1] - want[1]) < 1e-6 and abs(got[2] - want[2]) < 1e-6
    four = [t[n] for n in ("store_returns", "date_dim", "store", "customer")]
    for form, cross, store in (("window", False, "AND s_store_sk = s"), ("join", False, "AND s_store_sk = s"), ("window", True, "")):
        want = [r[0] for r in con.execute(Q1.format(year=2002, store=store)).fetchall()]
        assert want and [r[0] for r in tpcds.q1(*four, year=2002, form=form, cross=cross).collect()] == want


def test_schemas_are_whole(spark):
    assert {n: len(struct(n)) for n in SCHEMAS} == {"store_returns": 20, "customer": 18, "date_dim": 28, "store": 29, "catalog_sales": 34, "customer_address": 13, "call_center": 31, "catalog_returns": 27, "access_log": 9}


def test_dealing_loses_nothing(spark):
    df = spark.range(500).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"))
    for d in (B.dealt(df, 5), B.dealt(df, 5, "k"), B.dealt(df, 5, "k", by_range=True)):
        assert d.count() == 500 and d.where("k is null").count() == df.where("k is null").count()
    assert B.dealt(df, 5, "k").select(F.spark_partition_id().alias("p"), "k").distinct().groupBy("k").count().where("count > 1").count() == 0
