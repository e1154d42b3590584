"""Star-schema questions: orders from several sources that were never returned, and groups above their average."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MultiSource:
    """Parameters of ``multi_source_orders``. inclusive: whether both ends of the range belong to it."""

    start: date = date(1998, 3, 1)
    end: date = date(1998, 3, 1) + timedelta(days=60)
    inclusive: bool = True
    state: str = "BUILDING"
    counties: tuple[str, ...] = field(default=("NATION_3",) * 5)

    def in_range(self, day: Column) -> Column:
        if self.inclusive:
            return day.between(F.lit(self.start), F.lit(self.end))
        return (day > F.lit(self.start)) & (day < F.lit(self.end))


def several(shipped: DataFrame) -> DataFrame:
    """The orders that ship from two warehouses or more: their least and largest warehouses differ."""
    return shipped.groupBy("order").agg(F.min("warehouse").alias("_lo"), F.max("warehouse").alias("_hi")).where("_lo != _hi").select("order")


def from_several(sales: DataFrame, form: str = "exists") -> DataFrame:
    """Sales rows (order, warehouse) whose order also comes from another warehouse.

    exists: a row stays if a row of its order has another warehouse; so its own is known. That is: the least and the largest of the order's warehouses differ,
    which one aggregation by order tells and no row meets all others of its order.
    nunique: all rows of orders with two warehouses or more stay, those of unknown warehouse too.
    """
    many = several(sales)
    rows = sales.where("warehouse is not null") if form == "exists" else sales
    return rows.join(many, "order", "left_semi")


def from_several_by_exists(sales: DataFrame) -> DataFrame:
    """The same as a semi join with an unequal residual, as SQL's EXISTS says it."""
    a, b = sales.alias("a"), sales.select("order", "warehouse").alias("b")
    return a.join(b, (F.col("a.order") == F.col("b.order")) & (F.col("a.warehouse") != F.col("b.warehouse")), "left_semi")


def summed(rows: DataFrame) -> DataFrame:
    """One row: distinct orders and the sums of two amounts (null without rows)."""
    by = rows.groupBy("order").agg(F.sum("ship_cost").alias("ship_cost"), F.sum("profit").alias("profit"))
    return by.agg(F.count("*").alias("order_count"), F.sum("ship_cost").cast("double").alias("total_shipping_cost"), F.sum("profit").cast("double").alias("total_net_profit"))


def _dimension(df: DataFrame) -> DataFrame:
    """A filtered dimension's keys; whether to broadcast them is left to their size at run time."""
    return df.distinct()


def multi_source_orders(sales: DataFrame, returns: DataFrame, dates: DataFrame, addresses: DataFrame, centers: DataFrame, p: MultiSource = MultiSource(), form: str = "exists", shipped: DataFrame | None = None) -> DataFrame:
    """Orders of a date range, state and counties that ship from several warehouses and were never returned: one row of totals.

    sales: order, warehouse, date_key, address_key, center_key, ship_cost, profit. returns: order. dates: date_key, day. addresses: address_key,
    state. centers: center_key, county. Dimensions filter the sales before the order-level joins shuffle what is left.
    shipped: order and warehouse of all sales, where these can be read more cheaply than from sales.
    """
    shipped = (sales if shipped is None else shipped).select("order", "warehouse")
    days = _dimension(dates.where(p.in_range(F.col("day"))).select("date_key"))
    here = _dimension(addresses.where(F.col("state") == p.state).select("address_key"))
    there = _dimension(centers.where(F.col("county").isin(*sorted(set(p.counties)))).select("center_key"))
    wanted = sales.join(days, "date_key", "left_semi").join(here, "address_key", "left_semi").join(there, "center_key", "left_semi")
    # the other warehouses may belong to rows that the filters drop: orders are looked up among all sales, but only those still wanted
    orders = wanted.select("order").distinct()
    if form == "exists_join":
        a, b = wanted.alias("a"), shipped.join(orders, "order", "left_semi").alias("b")
        rows = a.join(b, (F.col("a.order") == F.col("b.order")) & (F.col("a.warehouse") != F.col("b.warehouse")), "left_semi")
    else:
        many = several(shipped.join(orders, "order", "left_semi"))
        rows = (wanted.where("warehouse is not null") if form == "exists" else wanted).join(many, "order", "left_semi")
    return summed(rows.join(returns.select("order").distinct(), "order", "left_anti"))


def returns_by_customer_store(returns: DataFrame, dates: DataFrame, year: int = 1998) -> DataFrame:
    """customer, store, total: what each customer returned to each store in a year. returns: customer, store, date_key, amount; dates: date_key, day."""
    days = dates.where(F.col("day").between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31)))).select("date_key").distinct()
    return returns.join(days, "date_key", "left_semi").groupBy("customer", "store").agg(F.sum("amount").alias("total"))


def above_group_average(totals: DataFrame, stores: DataFrame, customers: DataFrame, state: str, form: str = "join", factor: float = 1.2, k: int = 100, cross: bool = False) -> DataFrame:
    """The first k names of customers whose total at a store of the state is over ``factor`` times the store's average.

    form: "join" joins each store's average, of which parts are summed before the shuffle; "window" takes it beside each row, for which all totals of a store meet in one task. cross: the accidental variant that pairs each such customer with
    every store of the state, wherever the total arose; it is off, and only multiplies rows by the number of those stores.
    stores: store, state; customers: customer, name.
    """
    total = F.col("total").cast("double")
    if form == "window":
        rows = totals.withColumn("_mean", F.avg(total).over(Window.partitionBy("store")))
    else:
        rows = totals.join(totals.groupBy("store").agg(F.avg(total).alias("_mean")), "store")
    rows = rows.where(total > factor * F.col("_mean"))
    here = stores.where(F.col("state") == state).select("store")
    if cross:
        copies = here.agg(F.count("*").cast("int")).scalar()
        rows = rows.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))))
    else:
        rows = rows.join(here.distinct(), "store", "left_semi")
    return rows.join(customers.select("customer", "name"), "customer").select("name").orderBy("name").limit(k)


def above_group_average_sql(spark, totals: DataFrame, stores: DataFrame, customers: DataFrame, state: str, factor: float = 1.2, k: int = 100) -> DataFrame:
    """The same in SQL, with a correlated scalar subquery."""
    return spark.sql(
        """
        SELECT name FROM {totals} t, {stores} s, {customers} c
        WHERE t.store = s.store AND s.state = :state AND t.customer = c.customer
          AND CAST(t.total AS DOUBLE) > (SELECT AVG(CAST(u.total AS DOUBLE)) * :factor FROM {totals} u WHERE u.store = t.store)
        ORDER BY name LIMIT :k
        """,
        args={"state": state, "factor": factor, "k": k}, totals=totals, stores=stores, customers=customers,
    )
