"""The retail tables as views over a sales star schema (``orders``, ``lineitem``, ``part``, ...).

Every view is a projection, so filters and column choices on a view reach the Parquet scan. Only
``branch_sales`` joins: a sale's branch is the nation of its customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.functions.dates import time_of_day
from shopmetrics.functions.money import MONEY, as_money, as_total
from shopmetrics.sources.readers import load_table

STAR = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

VOIDED_STATUS = "P"
DISCONTINUED_TYPE = "PROMO"
MOVEMENT_OF_EVENT = {
    "purchase": "stock_in", "view": "sale", "click": "adjustment", "error": "damaged", "signup": "return",
}


def mapped(column: str, values: dict) -> Column:
    """A column recoded by a short written-out mapping; NULL for other values."""
    result = None
    for key, value in values.items():
        result = F.when(F.col(column) == key, value) if result is None else result.when(F.col(column) == key, value)
    return result


class Shop:
    """Lazy retail views over one directory of star tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, self.directory, name, STAR[name])

    @property
    def branches(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("branch_name")
        )

    @property
    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
        )

    @property
    def cashiers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("cashier_id"), F.col("c_name").alias("cashier_name")
        )

    @property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lit("u"), F.col("c_custkey")).alias("code"),
            F.col("c_mktsegment").alias("role"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )

    @property
    def products(self) -> DataFrame:
        price = as_money("p_retailprice")
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_brand").alias("barcode"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            price.alias("selling_price"),
            (price * F.lit("0.7").cast("decimal(2,1)")).cast(MONEY).alias("cost_price"),
            F.col("p_size").alias("reorder_level"),
            (F.col("p_type") != DISCONTINUED_TYPE).alias("is_active"),
        )

    @property
    def inventory(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), (F.col("p_partkey") % 60).alias("quantity")
        )

    @property
    def branch_inventory(self) -> DataFrame:
        """What the suppliers of each nation have delivered of each product."""
        suppliers = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        lines = self.table("lineitem").select(
            "l_partkey", "l_suppkey", F.floor("l_quantity").cast("bigint").alias("quantity")
        )
        per_supplier = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("quantity").alias("quantity"))
        return (
            per_supplier.join(suppliers, "l_suppkey")
            .groupBy(F.col("l_partkey").alias("product_id"), F.col("s_nationkey").alias("branch_id"))
            .agg(F.sum("quantity").alias("quantity"))
        )

    @property
    def sales(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("sale_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_custkey").alias("cashier_id"),
            F.to_date("o_orderdate").alias("sale_date"),
            time_of_day("o_orderdate").alias("sale_time"),
            F.col("o_orderpriority").alias("payment_method"),
            as_money("o_totalprice").alias("total_amount"),
            (F.col("o_orderstatus") == VOIDED_STATUS).alias("is_voided"),
            F.lit(None).cast("bigint").alias("voided_by"),
            F.lit(None).cast("string").alias("void_reason"),
        )

    @property
    def branch_sales(self) -> DataFrame:
        home = self.table("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("branch_id")
        )
        return self.sales.join(home, "customer_id")

    @property
    def sale_items(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_linenumber").alias("item_id"),
            F.col("l_orderkey").alias("sale_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            as_money("l_extendedprice").alias("subtotal"),
        )

    @property
    def cart_lines(self) -> DataFrame:
        """Lines of carts to be posted; the line amount stands in for the unit price, so that lines differ.

        Line numbers of the source repeat: the amount in cents tells lines of one number apart.
        """
        cents = (as_money("l_extendedprice") * 100).cast("bigint")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("cart_id"),
            F.col("l_partkey").alias("product_id"),
            (F.col("l_linenumber") * F.lit(1_000_000_000_000) + cents).alias("line_no"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            as_money("l_extendedprice").alias("unit_price"),
        )

    @property
    def carts(self) -> DataFrame:
        """Urgent carts have 10 % off, high ones a fixed amount, the others no discount."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("cart_id"),
            F.col("o_custkey").alias("cashier_id"),
            F.col("o_orderpriority").alias("payment_method"),
            mapped("o_orderpriority", {"1-URGENT": "percent", "2-HIGH": "fixed"}).alias("discount_type"),
            mapped("o_orderpriority", {"1-URGENT": F.lit(10).cast(MONEY), "2-HIGH": as_money("o_totalprice")}).alias(
                "discount_value"
            ),
            F.col("o_orderdate").alias("sold_at"),
        )

    @property
    def expenses(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("expense_id"),
            F.to_date("ts").alias("expense_date"),
            F.col("event_type").alias("category"),
            F.col("props").alias("description"),
            as_money("value").alias("amount"),
            F.col("user_id").alias("recorded_by"),
        )

    @property
    def deliveries(self) -> DataFrame:
        """Expenses in the years of the orders."""
        return self.table("lineitem").select(
            F.to_date("l_shipdate").alias("expense_date"),
            F.col("l_returnflag").alias("category"),
            as_money("l_extendedprice").alias("amount"),
            F.col("l_suppkey").alias("recorded_by"),
        )

    @property
    def stock_movements(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("movement_id"),
            F.col("user_id").alias("product_id"),
            mapped("event_type", MOVEMENT_OF_EVENT).alias("movement_type"),
            F.floor("value").cast("int").alias("quantity"),
            F.col("props").alias("reason"),
            F.col("user_id").alias("recorded_by"),
            F.col("ts").alias("movement_date"),
        )

    @property
    def activity_log(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("log_id"),
            "user_id",
            F.col("event_type").alias("action"),
            F.col("props").alias("details"),
            F.col("ts").alias("logged_at"),
        )

    @property
    def visits(self) -> DataFrame:
        """Events as sales, for reports by hour of day."""
        return self.table("events").select(
            F.col("event_id").alias("sale_id"), time_of_day("ts").alias("sale_time")
        )

    @property
    def declarations(self) -> DataFrame:
        """One cash count per cashier and day: what was taken in sales that are not final."""
        counted = F.when(F.col("o_orderstatus") != "F", as_money("o_totalprice"))
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("cashier_id"), F.to_date("o_orderdate").alias("recon_date"))
            .agg(as_total(F.coalesce(F.sum(counted), F.lit(0))).alias("declared_cash"))
            .select(
                "cashier_id", "recon_date", "declared_cash",
                F.lit("").alias("notes"),
                F.col("cashier_id").alias("submitted_by"),
                F.col("recon_date").cast("timestamp_ntz").alias("created_at"),
            )
        )

    @property
    def returns(self) -> DataFrame:
        return self.table("lineitem").filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("sale_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            as_money("l_extendedprice").alias("refund_amount"),
            F.col("l_linestatus").alias("reason"),
            F.col("l_suppkey").alias("processed_by"),
            F.col("l_shipdate").alias("return_date"),
        )

    @property
    def return_requests(self) -> DataFrame:
        """Every line as a request to return it; those without a flag give no reason."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("sale_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            mapped("l_returnflag", {"R": "Damaged", "A": "Wrong item", "N": ""}).alias("reason"),
            F.col("l_suppkey").alias("processed_by"),
            F.col("l_shipdate").alias("returned_at"),
        )

    @property
    def void_requests(self) -> DataFrame:
        """Every event as a request to void the sale with the event's number, or with its user's number."""
        clicked = F.col("event_type").isin("click", "error")
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.when(clicked, F.col("user_id")).otherwise(F.col("event_id")).alias("sale_id"),
            F.col("user_id").alias("requested_by"),
            mapped("event_type", {"error": "Wrong item", "click": "Double entry", "view": "", "signup": "Test"}).alias(
                "reason"
            ),
            F.col("ts").alias("requested_at"),
        )

    @property
    def product_edits(self) -> DataFrame:
        spent = F.col("event_type") == "purchase"
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("product_id"),
            F.lit(None).cast(MONEY).alias("cost_price"),
            F.when(spent, as_money("value")).alias("selling_price"),
            F.when(F.col("event_type") == "click", F.floor("value").cast("int")).alias("reorder_level"),
            F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "signup", True).alias("is_active"),
            mapped(
                "event_type",
                {"view": "Add Stock", "click": "Add Stock", "purchase": "Remove Stock", "error": "Set Exact Quantity"},
            ).alias("adjustment"),
            F.floor("value").cast("int").alias("adjust_qty"),
            F.lit(None).cast("string").alias("reason"),
            F.col("user_id").alias("edited_by"),
            F.col("ts").alias("edited_at"),
        )

    @property
    def status_requests(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("product_id"),
            F.col("event_type").isin("purchase", "view", "signup").alias("is_active"),
            F.col("user_id").alias("requested_by"),
            F.col("ts").alias("requested_at"),
        )

    @property
    def new_products(self) -> DataFrame:
        """A request per part: economy parts ask for a name in use, in capitals, the others for brand and type."""
        name = F.when(F.col("p_type") == "ECONOMY", F.upper("p_name")).otherwise(
            F.concat_ws(" ", "p_brand", "p_type")
        )
        return self.table("part").select(
            F.col("p_partkey").alias("seq"),
            (F.col("p_partkey") + 1_000_000_000_000).alias("product_id"),
            F.lit("").alias("barcode"),
            name.alias("product_name"),
            F.col("p_type").alias("category"),
            (as_money("p_retailprice") - 902).cast(MONEY).alias("cost_price"),
            as_money("p_retailprice").alias("selling_price"),
            F.col("p_size").alias("reorder_level"),
            (F.col("p_partkey") % 60).alias("opening_stock"),
            F.col("p_partkey").alias("added_by"),
            F.lit(None).cast("timestamp_ntz").alias("added_at"),
        )

    @property
    def staff_requests(self) -> DataFrame:
        """Sign-ups are requests for new staff, other events change the staff member of that number."""
        joins = F.col("event_type") == "signup"
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            F.when(joins, F.col("user_id") + 1_000_000_000_000).otherwise(F.col("user_id")).alias("user_id"),
            F.when(joins, F.concat(F.lit("Staff "), F.col("user_id"))).alias("full_name"),
            F.when(F.col("value") >= 100, F.concat(F.lit("c"), F.col("event_id"))).otherwise("").alias("code"),
            F.col("event_type").alias("role"),
            mapped("event_type", {"error": False, "purchase": True}).alias("is_active"),
            F.col("user_id").alias("requested_by"),
            F.col("ts").alias("requested_at"),
        )
