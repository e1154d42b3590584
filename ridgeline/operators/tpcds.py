"""Two TPC-DS questions over the tables that ``ridgeline.schemas`` declares, as compositions of the star operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import struct
from . import star

#: The published parameters of question 16.
Q16 = star.MultiSource(start=date(2002, 3, 1), end=date(2002, 4, 30), state="IA", counties=("Williamson County",))
#: Those of its staged variant: both ends excluded, another state.
Q16_STAGED = star.MultiSource(start=date(2002, 2, 1), end=date(2002, 4, 1), inclusive=False, state="GA", counties=("Williamson County",))


def declared(df: DataFrame, table: str) -> DataFrame:
    """df as a declared table: its columns in order and with their types, null where df has none."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(table)])


def q16(catalog_sales: DataFrame, date_dim: DataFrame, customer_address: DataFrame, call_center: DataFrame, catalog_returns: DataFrame, p: star.MultiSource = Q16, form: str = "exists") -> DataFrame:
    """Orders shipped from several warehouses and never returned: order_count, total_shipping_cost, total_net_profit in one row."""
    sales = catalog_sales.select(
        F.col("cs_order_number").alias("order"), F.col("cs_warehouse_sk").alias("warehouse"), F.col("cs_ship_date_sk").alias("date_key"), F.col("cs_ship_addr_sk").alias("address_key"),
        F.col("cs_call_center_sk").alias("center_key"), F.col("cs_ext_ship_cost").alias("ship_cost"), F.col("cs_net_profit").alias("profit"),
    )
    return star.multi_source_orders(
        sales,
        catalog_returns.select(F.col("cr_order_number").alias("order")),
        date_dim.select(F.col("d_date_sk").alias("date_key"), F.to_date("d_date").alias("day")),
        customer_address.select(F.col("ca_address_sk").alias("address_key"), F.col("ca_state").alias("state")),
        call_center.select(F.col("cc_call_center_sk").alias("center_key"), F.col("cc_county").alias("county")),
        p, form,
    )


def customer_store_returns(store_returns: DataFrame, date_dim: DataFrame, year: int = 2001) -> DataFrame:
    """Question 1's inner table: customer, store, total."""
    returns = store_returns.select(F.col("sr_customer_sk").alias("customer"), F.col("sr_store_sk").alias("store"), F.col("sr_returned_date_sk").alias("date_key"), F.col("sr_return_amt").alias("amount"))
    days = date_dim.where(F.col("d_year") == year).select(F.col("d_date_sk").alias("date_key")).distinct()
    return returns.join(days, "date_key", "left_semi").groupBy("customer", "store").agg(F.sum("amount").alias("total"))


def q1(store_returns: DataFrame, date_dim: DataFrame, store: DataFrame, customer: DataFrame, year: int = 2001, state: str = "TN", form: str = "join", cross: bool = False) -> DataFrame:
    """Customers who returned over 1.2 times their store's average: the first 100 ids (column c_customer_id).

    cross: the variant without the join between totals and stores, which repeats each customer for every store of the state.
    """
    stores = store.select(F.col("s_store_sk").alias("store"), F.col("s_state").alias("state"))
    people = customer.select(F.col("c_customer_sk").alias("customer"), F.col("c_customer_id").alias("name"))
    found = star.above_group_average(customer_store_returns(store_returns, date_dim, year), stores, people, state, form, cross=cross)
    return found.withColumnRenamed("name", "c_customer_id")
