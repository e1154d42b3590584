"""Queries by name over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .functions import weblog
from .operators import accesslog as A
from .operators import basics as B
from .operators import star, tpcds
from .operators import wordcount as W
from .schemas import SCHEMAS
from .session import scratch_dir, spread
from .streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- numbers


@query("range_sum", "SELECT CAST(sum(i) AS BIGINT) AS total FROM range(100000) t(i)")
def range_sum(spark, folder):
    return B.range_sum(spark)


@query("range_filter_sum", "SELECT CAST(sum(i) AS BIGINT) AS total FROM range(100000) t(i) WHERE i % 7 = 0")
def range_filter_sum(spark, folder):
    return B.range_sum(spark, divisor=7)


# ---- words

_LINES = "lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"
_CLEAN = "trim(regexp_replace(lower(line), '[^a-zA-Z0-9 ]', '', 'g'))"
_WORDS = f"WITH {_LINES}, words AS (SELECT word FROM (SELECT unnest(string_split_regex({_CLEAN}, ' +')) AS word FROM lines) WHERE word <> '')"


def lines(spark, folder):
    return W.lines_of(spread(table(spark, folder, "documents").select("doc_id", "text")))


def words(spark, folder):
    return W.words_of(lines(spark, folder))


@query("word_count", f"{_WORDS} SELECT word, count(*) AS n FROM words GROUP BY word")
def word_count(spark, folder):
    return W.word_count(words(spark, folder))


@query("word_top10", f"{_WORDS} SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY n DESC, word LIMIT 10")
def word_top10(spark, folder):
    return W.top_words(words(spark, folder))


@query("word_top_natural", f"{_WORDS} SELECT word FROM words ORDER BY word DESC LIMIT 5")
def word_top_natural(spark, folder):
    return W.last_words(words(spark, folder))


@query("word_unique", f"{_WORDS} SELECT count(DISTINCT word) AS n_unique FROM words")
def word_unique(spark, folder):
    return W.unique_words(words(spark, folder))


@query("word_mean", f"{_WORDS} SELECT round(count(*) / count(DISTINCT word), 2) AS mean_count FROM words")
def word_mean(spark, folder):
    return W.mean_count(words(spark, folder))


@query("word_total", f"{_WORDS} SELECT count(*) AS n_words FROM words")
def word_total(spark, folder):
    return W.total_words(words(spark, folder))


@query("word_lengths", f"{_WORDS} SELECT DISTINCT word, length(word) AS n_chars FROM words")
def word_lengths(spark, folder):
    return W.word_lengths(words(spark, folder).distinct())


@query("word_upper", f"{_WORDS} SELECT DISTINCT word, upper(word) AS word_upper FROM words")
def word_upper(spark, folder):
    return W.upper_words(words(spark, folder).distinct())


@query("line_clean", f"WITH {_LINES} SELECT doc_id, line_no, {_CLEAN} AS line FROM lines")
def line_clean(spark, folder):
    return W.cleaned(lines(spark, folder))


@query("line_index", f"WITH {_LINES} SELECT doc_id, line_no, line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS index FROM lines")
def line_index(spark, folder):
    return B.numbered(lines(spark, folder), "doc_id", "line_no")


@query("line_preview", f"WITH {_LINES} SELECT doc_id, line_no, {_CLEAN} AS line FROM lines ORDER BY doc_id, line_no LIMIT 15")
def line_preview(spark, folder):
    return B.top_k(W.cleaned(lines(spark, folder)), 15, "doc_id", "line_no")


# ---- access log: lines made from events, then parsed like any other

_CLF = """
    clf AS (
        SELECT 'u' || user_id || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' -0400] "GET /' || event_type || '/'
            || CASE WHEN user_id % 5 = 0 THEN 'a b' ELSE CAST(user_id % 7 AS VARCHAR) END || ' HTTP/1.0" '
            || CASE event_type WHEN 'error' THEN '404 -' WHEN 'signup' THEN '302 ' || CAST(floor(value * 100) AS BIGINT) ELSE '200 ' || CAST(floor(value * 100) AS BIGINT) END AS line
        FROM events
    )"""


def _log_sql(pattern: str, rest: str) -> str:
    def g(i: int) -> str:
        return f"regexp_extract(line, '{pattern}', {i})"

    return f"""WITH {_CLF}, log AS (
        SELECT {g(1)} AS host, {g(2)} AS client_identd, {g(3)} AS user_id, strptime({g(4)}[1:20], '%d/%b/%Y:%H:%M:%S') AS date_time,
            {g(5)} AS method, {g(6)} AS endpoint, {g(7)} AS protocol, CAST({g(8)} AS INTEGER) AS response_code,
            CASE WHEN {g(9)} = '-' THEN 0 ELSE CAST({g(9)} AS BIGINT) END AS content_size
        FROM clf WHERE regexp_matches(line, '{pattern}')
    ) {rest}"""


def clf_lines(spark, folder) -> DataFrame:
    """Column value: an access-log line for each event."""
    size = F.floor(F.col("value") * 100).cast("bigint").cast("string")
    code = F.when(F.col("event_type") == "error", F.lit("404 -")).when(F.col("event_type") == "signup", F.concat(F.lit("302 "), size)).otherwise(F.concat(F.lit("200 "), size))
    last = F.when(F.col("user_id") % 5 == 0, F.lit("a b")).otherwise((F.col("user_id") % 7).cast("string"))
    line = F.concat(F.lit("u"), F.col("user_id"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' -0400] "GET /'), F.col("event_type"), F.lit("/"), last, F.lit(' HTTP/1.0" '), code)
    return spread(table(spark, folder, "events").select("ts", "user_id", "event_type", "value")).select(line.alias("value"))


def log(spark, folder, pattern: str = weblog.LENIENT) -> DataFrame:
    return A.parse(clf_lines(spark, folder), pattern)[0]


def _log_query(name: str, rest: str, f: Callable[[DataFrame], DataFrame], pattern: str = weblog.LENIENT) -> None:
    query(name, _log_sql(pattern, rest))(lambda spark, folder: f(log(spark, folder, pattern)))


_log_query("clf_parse", "SELECT * FROM log", lambda d: d)
_log_query("clf_parse_strict", "SELECT * FROM log", lambda d: d, weblog.STRICT)
query("clf_failed", f"WITH {_CLF} SELECT line FROM clf WHERE NOT regexp_matches(line, '{weblog.STRICT}')")(lambda spark, folder: A.parse(clf_lines(spark, folder), weblog.STRICT)[1])
_log_query("clf_size_stats", "SELECT CAST(sum(content_size) // count(*) AS BIGINT) AS mean_size, min(content_size) AS min_size, max(content_size) AS max_size FROM log", A.size_stats)
_log_query("clf_status_counts", "SELECT response_code, count(*) AS n FROM log GROUP BY response_code", A.status_counts)
_log_query(
    "clf_status_fraction",
    ", c AS (SELECT response_code, count(*) AS n FROM log GROUP BY response_code), f AS (SELECT *, n / (SELECT sum(n) FROM c) AS fraction FROM c) SELECT *, CASE WHEN 100 * fraction < 7 THEN '' ELSE printf('%.0f%%', 100 * fraction) END AS label FROM f",
    A.status_shares,
)
_log_query("clf_hosts_over_10", "SELECT host, count(*) AS n FROM log GROUP BY host HAVING count(*) > 10", A.frequent_hosts)
_log_query("clf_endpoint_counts", "SELECT endpoint, count(*) AS n FROM log GROUP BY endpoint", A.endpoint_counts)
_log_query("clf_top_endpoints", "SELECT endpoint, count(*) AS n FROM log GROUP BY endpoint ORDER BY n DESC, endpoint LIMIT 10", A.top_endpoints)
_log_query("clf_top_error_endpoints", "SELECT endpoint, count(*) AS n FROM log WHERE response_code <> 200 GROUP BY endpoint ORDER BY n DESC, endpoint LIMIT 5", A.top_error_endpoints)
_log_query("clf_unique_hosts", "SELECT count(DISTINCT host) AS n_hosts FROM log", A.unique_hosts)
_log_query("clf_hourly_hosts", "SELECT CAST(hour(date_time) AS INTEGER) AS hour, count(DISTINCT host) AS n_hosts FROM log GROUP BY 1", A.hourly_hosts)
_log_query("clf_hourly_requests_per_host", "SELECT CAST(hour(date_time) AS INTEGER) AS hour, count(*) // count(DISTINCT host) AS requests_per_host FROM log GROUP BY 1", A.hourly_requests_per_host)
_log_query("clf_404_count", "SELECT count(*) AS n_not_found FROM log WHERE response_code = 404", A.not_found_count)
_log_query("clf_404_endpoints", "SELECT DISTINCT endpoint FROM log WHERE response_code = 404 ORDER BY endpoint LIMIT 30", A.not_found_endpoints)
_log_query("clf_404_top10", "SELECT endpoint, count(*) AS n FROM log WHERE response_code = 404 GROUP BY endpoint ORDER BY n DESC, endpoint LIMIT 10", A.top_not_found)
_log_query("clf_404_hourly", "SELECT CAST(hour(date_time) AS INTEGER) AS hour, count(*) AS n FROM log WHERE response_code = 404 GROUP BY 1", A.hourly_not_found)


# ---- star schema: lineitem, orders, customer, supplier and nation stand in for sales, dates, addresses and call centres

_NATIONS = ("NATION_3", "NATION_3", "NATION_7", "NATION_11", "NATION_15", "NATION_19")
_START, _END = star.date(1997, 3, 1), star.date(1999, 2, 28)
PARAMETERS = star.MultiSource(start=_START, end=_END, state="BUILDING", counties=_NATIONS)


def money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


def rate(c: Column) -> Column:
    return c.cast("decimal(4,2)")


def calendar(spark) -> DataFrame:
    """A dates dimension, 1970 to 2069: date_key, day."""
    day = F.date_add(F.lit(date(1970, 1, 1)), F.col("id").cast("int"))
    return spark.range(36_525).select(day.alias("date_key"), day.alias("day"))


def shipped(spark, folder) -> DataFrame:
    """Order and warehouse of all sales: lineitem alone tells."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("warehouse"))


def star_tables(spark, folder) -> dict[str, DataFrame]:
    """Sales with their keys, returned orders, and three dimensions."""
    item, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    order = orders.select(F.col("o_orderkey").alias("order"), F.col("o_orderdate").cast("date").alias("date_key"), F.col("o_custkey").alias("address_key"))
    sales = item.select(
        F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("warehouse"), F.col("l_suppkey").alias("center_key"),
        (money(F.col("l_extendedprice")) * rate(F.col("l_tax"))).alias("ship_cost"), (money(F.col("l_extendedprice")) * (1 - rate(F.col("l_discount")))).alias("profit"),
    ).join(order, "order")
    return {
        "sales": sales,
        "returns": item.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order")),
        "dates": calendar(spark),
        "addresses": table(spark, folder, "customer").select(F.col("c_custkey").alias("address_key"), F.col("c_mktsegment").alias("state")),
        "centers": table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("center_key"), F.col("n_name").alias("county")),
    }


def _star_sql(where: str, several: str = "EXISTS (SELECT 1 FROM sales b WHERE b.ord = a.ord AND b.warehouse <> a.warehouse)") -> str:
    return f"""WITH sales AS (
        SELECT l_orderkey AS ord, l_suppkey AS warehouse, CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS ship_cost, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS profit,
            CAST(o_orderdate AS DATE) AS day, c_mktsegment AS state, n_name AS county
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    )
    SELECT count(DISTINCT ord) AS order_count, CAST(sum(ship_cost) AS DOUBLE) AS total_shipping_cost, CAST(sum(profit) AS DOUBLE) AS total_net_profit
    FROM sales a WHERE {where} AND {several} AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = a.ord AND r.l_returnflag = 'R')"""


def _star_where(p: star.MultiSource) -> str:
    counties = ", ".join(f"'{c}'" for c in p.counties)
    days = f"day BETWEEN DATE '{p.start}' AND DATE '{p.end}'" if p.inclusive else f"day > DATE '{p.start}' AND day < DATE '{p.end}'"
    return f"{days} AND state = '{p.state}' AND county IN ({counties})"


_EMPTY = star.MultiSource(start=_START, end=_END, state="NO SUCH SEGMENT", counties=_NATIONS)
_OPEN = star.MultiSource(start=_START, end=_END, inclusive=False, state="MACHINERY", counties=_NATIONS)
_COUNTED = "(SELECT count(DISTINCT b.warehouse) FROM sales b WHERE b.ord = a.ord) > 1"

for _name, _p, _form, _sql in (
    ("star_exists_not_exists", PARAMETERS, "exists", _star_sql(_star_where(PARAMETERS))),
    ("star_exists_join", PARAMETERS, "exists_join", _star_sql(_star_where(PARAMETERS))),
    ("star_exists_empty", _EMPTY, "exists", _star_sql(_star_where(_EMPTY))),
    ("star_nunique_semi", PARAMETERS, "nunique", _star_sql(_star_where(PARAMETERS), _COUNTED)),
    ("star_dates_exclusive", _OPEN, "exists", _star_sql(_star_where(_OPEN))),
):
    query(_name, _sql)(lambda spark, folder, p=_p, form=_form: star.multi_source_orders(**star_tables(spark, folder), p=p, form=form, shipped=shipped(spark, folder)))


@query("incremental_star", _star_sql(_star_where(PARAMETERS)))
def incremental_star(spark, folder):
    t = star_tables(spark, folder)
    item = table(spark, folder, "lineitem")
    stream = I.file_stream(spark, folder, "lineitem", item.schema)
    order = table(spark, folder, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_orderdate").cast("date").alias("date_key"), F.col("o_custkey").alias("address_key"))
    sales = stream.select(
        F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("warehouse"), F.col("l_suppkey").alias("center_key"),
        (money(F.col("l_extendedprice")) * rate(F.col("l_tax"))).alias("ship_cost"), (money(F.col("l_extendedprice")) * (1 - rate(F.col("l_discount")))).alias("profit"),
    ).join(order, "order")
    del t["sales"]
    return I.multi_source_orders(sales, shipped(spark, folder), **t, p=PARAMETERS)


@query("incremental_word_count", f"{_WORDS} SELECT word, count(*) AS n FROM words GROUP BY word")
def incremental_word_count(spark, folder):
    docs = table(spark, folder, "documents")
    return I.word_count(I.file_stream(spark, folder, "documents", docs.schema))


_TOTALS = """WITH totals AS (
    SELECT o_custkey AS customer, l_suppkey AS store, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS total
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND year(o_orderdate) = 1998 GROUP BY 1, 2
)"""


def _totals(spark, folder) -> DataFrame:
    item, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    returns = item.where("l_returnflag = 'R'").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("store"), F.col("o_orderdate").cast("date").alias("date_key"), money(F.col("l_extendedprice")).alias("amount"),
    )
    return star.returns_by_customer_store(returns, calendar(spark), 1998)


def _stores(spark, folder) -> DataFrame:
    return table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("store"), F.col("r_name").alias("state"))


def _customers(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))


def _above_sql(store: str = "AND s_suppkey = t.store") -> str:
    return f"""{_TOTALS} SELECT c_name AS name FROM totals t, supplier, nation, region, customer
    WHERE CAST(t.total AS DOUBLE) > (SELECT avg(CAST(u.total AS DOUBLE)) * 1.2 FROM totals u WHERE u.store = t.store)
        {store} AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND c_custkey = t.customer ORDER BY name LIMIT 100"""


@query("returns_by_customer_store", f"{_TOTALS} SELECT customer, store, CAST(total AS DOUBLE) AS total FROM totals")
def returns_by_customer_store(spark, folder):
    return _totals(spark, folder).withColumn("total", F.col("total").cast("double"))


for _form in ("window", "join"):
    query(f"above_group_avg_{_form}", _above_sql())(lambda spark, folder, form=_form: star.above_group_average(_totals(spark, folder), _stores(spark, folder), _customers(spark, folder), "ASIA", form))

query("above_group_avg_cross", _above_sql(""))(lambda spark, folder: star.above_group_average(_totals(spark, folder), _stores(spark, folder), _customers(spark, folder), "ASIA", cross=True))


@query("above_group_avg_subquery", _above_sql())
def above_group_avg_subquery(spark, folder):
    return star.above_group_average_sql(spark, _totals(spark, folder), _stores(spark, folder), _customers(spark, folder), "ASIA")


# ---- files: test tables written as delimited text or lines, and read again


def _file(spark, df: DataFrame, sep: str = "|", header: bool = False, name: str = "") -> str:
    """Writes df as delimited text into a new folder of the shared scratch folder."""
    path = f"{scratch_dir(spark)}/{name or 'table'}"
    sources.write_csv(df, path, sep, header)
    return path


_NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"


@query("file_header", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def file_header(spark, folder):
    """A table with a line of names."""
    return sources.read_delimited(spark, _file(spark, table(spark, folder, "nation"), ",", True), schema=_NATION, sep=",", header=True)


@query("file_dash_null", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS n_name, n_regionkey FROM nation")
def file_dash_null(spark, folder):
    """Chunks without names and with a token for NULL; the folder's files of another suffix aren't read."""
    name = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).otherwise("-")
    path = _file(spark, table(spark, folder, "nation").withColumn("n_name", name).repartition(3))
    spark.range(9).selectExpr("concat(id, '|no nation|1') AS value").write.mode("append").text(path)
    return sources.read_delimited(spark, path, schema=_NATION, null="-", suffix=".csv")


@query("file_types", "SELECT o_orderkey AS key, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS day, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price, o_orderstatus AS status FROM orders")
def file_types(spark, folder):
    """Dates, decimals and whole numbers as text, read by a declared schema."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey"), F.col("o_orderdate").cast("date"), F.col("o_totalprice").cast("decimal(12,2)"), F.col("o_orderstatus"))
    got = sources.read_delimited(spark, _file(spark, orders), schema="key BIGINT, day STRING, price DECIMAL(12,2), status STRING")
    day = F.to_date("day")
    return got.select("key", (F.year(day) * 10000 + F.month(day) * 100 + F.day(day)).cast("bigint").alias("day"), F.col("price").cast("double").alias("price"), "status")


@query("file_lines", _log_sql(weblog.LENIENT, "SELECT * FROM log"))
def file_lines(spark, folder):
    """Log lines from text files, dealt to four partitions at least."""
    path = scratch_dir(spark)
    clf_lines(spark, folder).write.text(path)
    return A.parse(sources.read_lines(spark, path, 4))[0]


@query("file_lines_failed", f"WITH {_CLF} SELECT line FROM clf WHERE NOT regexp_matches(line, '{weblog.STRICT}')")
def file_lines_failed(spark, folder):
    path = scratch_dir(spark)
    clf_lines(spark, folder).write.text(path)
    return A.parse(sources.read_lines(spark, path), weblog.STRICT)[1]


@query("views", "SELECT r_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def views(spark, folder):
    """Tables as temporary views, asked in SQL."""
    found = sources.read_parquet_tables(spark, folder, "nation", "region")
    sources.register({f"{name}_view": df for name, df in found.items()})
    return spark.sql("SELECT r_name, count(*) AS n FROM nation_view JOIN region_view ON r_regionkey = n_regionkey GROUP BY r_name")


@query("repeated_rows", "SELECT n_name, 3 * count(*) AS n FROM nation GROUP BY n_name")
def repeated_rows(spark, folder):
    return B.count_by(sources.repeated(table(spark, folder, "nation"), 3), "n_name")


@query("rounds_together", "SELECT o_orderkey, o_custkey FROM orders")
def rounds_together(spark, folder):
    """A table dealt to six rounds by its key, put together again."""
    return B.concat(*B.rounds(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), 6, "o_orderkey"))


@query("dealt_by_range", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def dealt_by_range(spark, folder):
    """Counts by key over rows that lie in ranges of it: the exchange by range does for the aggregation, too."""
    rows = B.dealt(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), 8, "o_custkey", by_range=True)
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def tpcds_tables(spark, folder, names: tuple[str, ...], ddl: bool) -> dict[str, DataFrame]:
    """Declared tables filled from the test tables, written with a delimiter at each line's end or not, and read by declared schema or (``ddl``) from the catalog."""
    sk = F.datediff("day", F.lit(date(1970, 1, 1)))
    item, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    lines = item.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("day", F.col("o_orderdate").cast("date"))
    made = {
        "date_dim": calendar(spark).select(sk.alias("d_date_sk"), F.col("day").alias("d_date"), F.year("day").alias("d_year")),
        "catalog_sales": lines.select(
            sk.alias("cs_ship_date_sk"), F.col("o_custkey").alias("cs_ship_addr_sk"), F.col("l_suppkey").alias("cs_call_center_sk"), F.col("l_suppkey").alias("cs_warehouse_sk"), F.col("l_orderkey").alias("cs_order_number"),
            F.col("l_tax").cast("decimal(7,2)").alias("cs_ext_ship_cost"), F.col("l_quantity").cast("decimal(7,2)").alias("cs_net_profit"),
        ),
        "catalog_returns": item.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("cr_order_number")),
        "customer_address": table(spark, folder, "customer").select(F.col("c_custkey").alias("ca_address_sk"), F.col("c_mktsegment").alias("ca_state")),
        "call_center": table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cc_call_center_sk"), F.col("n_name").alias("cc_county")),
        "store_returns": lines.where("l_returnflag = 'R'").select(sk.alias("sr_returned_date_sk"), F.col("o_custkey").alias("sr_customer_sk"), F.col("l_suppkey").alias("sr_store_sk"), F.col("l_quantity").cast("decimal(7,2)").alias("sr_return_amt")),
        "store": table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("s_store_sk"), F.col("r_name").alias("s_state")),
        "customer": table(spark, folder, "customer").select(F.col("c_custkey").alias("c_customer_sk"), F.col("c_name").alias("c_customer_id")),
    }
    out = {}
    for name in names:
        df = tpcds.declared(made[name], name)
        path = _file(spark, df if ddl else df.withColumn("end", F.lit(None).cast("string")), name=name)
        if ddl:
            spark.sql("CREATE SCHEMA IF NOT EXISTS ridgeline_files")
            spark.sql(f"DROP TABLE IF EXISTS ridgeline_files.{name}")  # this entry's own, of an earlier run
            out[name] = sources.create_table(spark, f"ridgeline_files.{name}", path, name)
        else:
            out[name] = sources.read_delimited(spark, path, table=name)
    return out


_Q16 = star.MultiSource(start=_START, end=_END, state="BUILDING", counties=_NATIONS)


@query(
    "tpcds_q16",
    f"""WITH sales AS (
        SELECT l_orderkey AS ord, l_suppkey AS warehouse, CAST(l_tax AS DECIMAL(7,2)) AS ship_cost, CAST(l_quantity AS DECIMAL(7,2)) AS profit, CAST(o_orderdate AS DATE) AS day, c_mktsegment AS state, n_name AS county
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    )
    SELECT count(DISTINCT ord) AS order_count, CAST(sum(ship_cost) AS DOUBLE) AS total_shipping_cost, CAST(sum(profit) AS DOUBLE) AS total_net_profit
    FROM sales a WHERE {_star_where(_Q16)} AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.ord AND b.l_suppkey <> a.warehouse) AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = a.ord AND r.l_returnflag = 'R')""",
)
def tpcds_q16(spark, folder):
    """Question 16 over its own tables, from delimited text with a delimiter at each line's end."""
    names = ("catalog_sales", "date_dim", "customer_address", "call_center", "catalog_returns")
    return tpcds.q16(*tpcds_tables(spark, folder, names, False).values(), p=_Q16)


@query(
    "tpcds_q1",
    """WITH t AS (
        SELECT o_custkey AS customer, l_suppkey AS store, sum(CAST(l_quantity AS DECIMAL(7,2))) AS total
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND year(o_orderdate) = 1998 GROUP BY 1, 2
    )
    SELECT c_name AS c_customer_id FROM t, supplier, nation, region, customer
    WHERE CAST(t.total AS DOUBLE) > (SELECT avg(CAST(u.total AS DOUBLE)) * 1.2 FROM t u WHERE u.store = t.store)
        AND s_suppkey = t.store AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND c_custkey = t.customer ORDER BY 1 LIMIT 100""",
)
def tpcds_q1(spark, folder):
    """Question 1 over its own tables, made by DDL over delimited text."""
    return tpcds.q1(*tpcds_tables(spark, folder, ("store_returns", "date_dim", "store", "customer"), True).values(), year=1998, state="ASIA")


@query("declared_columns", " UNION ALL ".join(f"SELECT '{name}' AS name, CAST({ddl.count(' ') - ddl.count(', ')} AS BIGINT) AS n_columns" for name, ddl in SCHEMAS.items()))
def declared_columns(spark, folder):
    """The declared schemas: their names and numbers of columns."""
    return spark.createDataFrame([(name, len(tpcds.struct(name))) for name in SCHEMAS], "name string, n_columns bigint")
