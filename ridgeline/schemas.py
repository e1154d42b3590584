"""Declared schemas: eight decision-support tables, the access log, and the star schema of the test data."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Names and types of the public TPC-DS tables.
_DDL = {
    "store_returns": """
        sr_returned_date_sk INT, sr_return_time_sk INT, sr_item_sk INT, sr_customer_sk INT, sr_cdemo_sk INT, sr_hdemo_sk INT,
        sr_addr_sk INT, sr_store_sk INT, sr_reason_sk INT, sr_ticket_number INT, sr_return_quantity INT, sr_return_amt DECIMAL(7,2),
        sr_return_tax DECIMAL(7,2), sr_return_amt_inc_tax DECIMAL(7,2), sr_fee DECIMAL(7,2), sr_return_ship_cost DECIMAL(7,2),
        sr_refunded_cash DECIMAL(7,2), sr_reversed_charge DECIMAL(7,2), sr_store_credit DECIMAL(7,2), sr_net_loss DECIMAL(7,2)""",
    "customer": """
        c_customer_sk INT, c_customer_id STRING, c_current_cdemo_sk INT, c_current_hdemo_sk INT, c_current_addr_sk INT,
        c_first_shipto_date_sk INT, c_first_sales_date_sk INT, c_salutation STRING, c_first_name STRING, c_last_name STRING,
        c_preferred_cust_flag STRING, c_birth_day INT, c_birth_month INT, c_birth_year INT, c_birth_country STRING, c_login STRING,
        c_email_address STRING, c_last_review_date STRING""",
    "date_dim": """
        d_date_sk INT, d_date_id STRING, d_date DATE, d_month_seq INT, d_week_seq INT, d_quarter_seq INT, d_year INT, d_dow INT,
        d_moy INT, d_dom INT, d_qoy INT, d_fy_year INT, d_fy_quarter_seq INT, d_fy_week_seq INT, d_day_name STRING,
        d_quarter_name STRING, d_holiday STRING, d_weekend STRING, d_following_holiday STRING, d_first_dom INT, d_last_dom INT,
        d_same_day_ly INT, d_same_day_lq INT, d_current_day STRING, d_current_week STRING, d_current_month STRING,
        d_current_quarter STRING, d_current_year STRING""",
    "store": """
        s_store_sk INT, s_store_id STRING, s_rec_start_date DATE, s_rec_end_date DATE, s_closed_date_sk INT, s_store_name STRING,
        s_number_employees INT, s_floor_space INT, s_hours STRING, s_manager STRING, s_market_id INT, s_geography_class STRING,
        s_market_desc STRING, s_market_manager STRING, s_division_id INT, s_division_name STRING, s_company_id INT,
        s_company_name STRING, s_street_number STRING, s_street_name STRING, s_street_type STRING, s_suite_number STRING,
        s_city STRING, s_county STRING, s_state STRING, s_zip STRING, s_country STRING, s_gmt_offset DECIMAL(5,2),
        s_tax_precentage DECIMAL(5,2)""",
    "catalog_sales": """
        cs_sold_date_sk INT, cs_sold_time_sk INT, cs_ship_date_sk INT, cs_bill_customer_sk INT, cs_bill_cdemo_sk INT,
        cs_bill_hdemo_sk INT, cs_bill_addr_sk INT, cs_ship_customer_sk INT, cs_ship_cdemo_sk INT, cs_ship_hdemo_sk INT,
        cs_ship_addr_sk INT, cs_call_center_sk INT, cs_catalog_page_sk INT, cs_ship_mode_sk INT, cs_warehouse_sk INT,
        cs_item_sk INT, cs_promo_sk INT, cs_order_number INT, cs_quantity INT, cs_wholesale_cost DECIMAL(7,2),
        cs_list_price DECIMAL(7,2), cs_sales_price DECIMAL(7,2), cs_ext_discount_amt DECIMAL(7,2), cs_ext_sales_price DECIMAL(7,2),
        cs_ext_wholesale_cost DECIMAL(7,2), cs_ext_list_price DECIMAL(7,2), cs_ext_tax DECIMAL(7,2), cs_coupon_amt DECIMAL(7,2),
        cs_ext_ship_cost DECIMAL(7,2), cs_net_paid DECIMAL(7,2), cs_net_paid_inc_tax DECIMAL(7,2),
        cs_net_paid_inc_ship DECIMAL(7,2), cs_net_paid_inc_ship_tax DECIMAL(7,2), cs_net_profit DECIMAL(7,2)""",
    "customer_address": """
        ca_address_sk INT, ca_address_id STRING, ca_street_number STRING, ca_street_name STRING, ca_street_type STRING,
        ca_suite_number STRING, ca_city STRING, ca_county STRING, ca_state STRING, ca_zip STRING, ca_country STRING,
        ca_gmt_offset DECIMAL(5,2), ca_location_type STRING""",
    "call_center": """
        cc_call_center_sk INT, cc_call_center_id STRING, cc_rec_start_date DATE, cc_rec_end_date DATE, cc_closed_date_sk INT,
        cc_open_date_sk INT, cc_name STRING, cc_class STRING, cc_employees INT, cc_sq_ft INT, cc_hours STRING, cc_manager STRING,
        cc_mkt_id INT, cc_mkt_class STRING, cc_mkt_desc STRING, cc_market_manager STRING, cc_division INT,
        cc_division_name STRING, cc_company INT, cc_company_name STRING, cc_street_number STRING, cc_street_name STRING,
        cc_street_type STRING, cc_suite_number STRING, cc_city STRING, cc_county STRING, cc_state STRING, cc_zip STRING,
        cc_country STRING, cc_gmt_offset DECIMAL(5,2), cc_tax_percentage DECIMAL(5,2)""",
    "catalog_returns": """
        cr_returned_date_sk INT, cr_returned_time_sk INT, cr_item_sk INT, cr_refunded_customer_sk INT, cr_refunded_cdemo_sk INT,
        cr_refunded_hdemo_sk INT, cr_refunded_addr_sk INT, cr_returning_customer_sk INT, cr_returning_cdemo_sk INT,
        cr_returning_hdemo_sk INT, cr_returning_addr_sk INT, cr_call_center_sk INT, cr_catalog_page_sk INT, cr_ship_mode_sk INT,
        cr_warehouse_sk INT, cr_reason_sk INT, cr_order_number INT, cr_return_quantity INT, cr_return_amount DECIMAL(7,2),
        cr_return_tax DECIMAL(7,2), cr_return_amt_inc_tax DECIMAL(7,2), cr_fee DECIMAL(7,2), cr_return_ship_cost DECIMAL(7,2),
        cr_refunded_cash DECIMAL(7,2), cr_reversed_charge DECIMAL(7,2), cr_store_credit DECIMAL(7,2), cr_net_loss DECIMAL(7,2)""",
    "access_log": """
        host STRING, client_identd STRING, user_id STRING, date_time TIMESTAMP_NTZ, method STRING, endpoint STRING,
        protocol STRING, response_code INT, content_size BIGINT""",
}

#: Schemas by table, as DDL. Money is decimal and dates are dates, so that filters reach the scan and sums don't depend on order.
SCHEMAS: dict[str, str] = {name: " ".join(ddl.split()) for name, ddl in _DDL.items()}


def struct(name: str) -> StructType:
    """A declared schema as a type; needs a session."""
    return StructType.fromDDL(SCHEMAS[name])


#: Tables of the test data, one Parquet file or folder each.
TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "embeddings", "pages", "labels", "conversations")
