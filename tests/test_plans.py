"""What the plans must and must not contain, and what happens when one key holds much of the data."""

import contextlib
import os
import re

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import ledger, rollup
from shopmetrics.plans import sales, stock
from shopmetrics.plans.catalog import QUERIES
from shopmetrics.sources.star import Shop

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def settings(spark, **values):
    named = {"spark.sql." + k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairing_of_all_rows_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, DIRECTORY))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Window"):
        assert node not in text


def test_only_the_bounded_side_is_hinted(spark):
    """Without size statistics in its favour nothing is broadcast but the list of target currencies."""
    bounded = {"fx_convert"}
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        for name in QUERIES:
            text = plan(QUERIES[name](spark, DIRECTORY))
            assert ("BroadcastHashJoin" in text) == (name in bounded), name


@pytest.mark.parametrize(
    "name, texts",
    [("movement_history", "props"), ("activity_view", "props"), ("returnable_sales", "o_orderpriority"), ("till_history", "notes"), ("returns_history", "reason")],
)
def test_newest_rows_fetch_their_texts_last(spark, name, texts):
    """No text goes through a shuffle below the cut."""
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        text = plan(QUERIES[name](spark, DIRECTORY))
    below = text[text.rindex("TakeOrderedAndProject") :]
    assert texts not in below


@pytest.mark.parametrize("name", ["sales_kpis_today", "sales_kpis_range", "period_transactions", "top5_products", "home_metrics"])
def test_period_reaches_the_scan(spark, name):
    text = plan(QUERIES[name](spark, DIRECTORY))
    pushed = re.search(r"orders\.parquet\], PartitionFilters: \[\], PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "Not(EqualTo(o_orderstatus,P))" in pushed


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["units_by_product"](spark, DIRECTORY))
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text
    assert "struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_newest_rows_are_kept_per_task(spark):
    for name in ("movement_history", "activity_view", "returnable_sales", "till_history", "returns_history"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, DIRECTORY))


def test_facts_are_summed_before_the_lookup(spark):
    """The partial aggregate sits below the shuffle, and the shuffle below the join."""
    text = plan(QUERIES["by_cashier"](spark, DIRECTORY))
    assert re.search(
        r"Join.*Exchange hashpartitioning\(cashier_id.*HashAggregate\(keys=\[cashier_id#\d+L\], functions=\[partial_sum",
        text, re.DOTALL,
    )


def ran(df):
    """Number of rows, with the plan as it was run left in ``df``."""
    return df._jdf.queryExecution().toRdd().count()


HOT = 0.4


@pytest.fixture(scope="module")
def lopsided(spark):
    """300,000 sales and lines; one cashier, one product and one sale hold two fifths of the rows."""
    n = 300_000
    hot = lambda c, other: F.when(F.rand(c) < HOT, F.lit(1)).otherwise(other).cast("int")
    base = spark.range(n).select(F.col("id").cast("int"), F.rand(9).alias("r"))
    sales_ = base.select(
        F.col("id").alias("sale_id"),
        hot(1, F.col("id") % 997).alias("cashier_id"),
        F.lit("2026-06-10").cast("date").alias("sale_date"),
        F.lit("10:00:00").alias("sale_time"),
        F.lit("cash").alias("payment_method"),
        F.lit(1).cast("decimal(18,2)").alias("total_amount"),
        F.lit(False).alias("is_voided"),
        F.lit(" " * 40).alias("pad"),
    )
    items = base.select(
        F.col("id").alias("item_id"), hot(2, F.col("id") % 9973).alias("sale_id"),
        hot(3, F.col("id") % 499).alias("product_id"), F.lit(2).alias("quantity"),
        F.lit(3).cast("decimal(10,2)").alias("unit_price"),
    )
    users = spark.range(997).select(
        F.col("id").cast("int").alias("user_id"), F.concat(F.lit("u"), F.col("id")).alias("full_name"),
    )
    products = spark.range(499).select(
        F.col("id").cast("int").alias("product_id"), F.concat(F.lit("p"), F.col("id") % 7).alias("product_name"),
        F.lit("c").alias("category"), F.lit(1).cast("decimal(18,2)").alias("cost_price"),
    )
    return {"n": n, "sales": sales_, "items": items, "users": users, "products": products}


SPLITTING = {
    "autoBroadcastJoinThreshold": "-1",
    "adaptive__autoBroadcastJoinThreshold": "-1",
    "adaptive__advisoryPartitionSizeInBytes": "64KB",
    "adaptive__skewJoin__skewedPartitionThresholdInBytes": "128KB",
    "adaptive__skewJoin__skewedPartitionFactor": "2",
    "adaptive__coalescePartitions__enabled": "false",
}


def test_a_hot_cashier_is_split_over_tasks(spark, lopsided):
    with settings(spark, **SPLITTING):
        joined = sales._with_cashier(lopsided["sales"], lopsided["users"])
        assert joined.agg(F.count("*"), F.countDistinct("cashier")).first()[:] == (lopsided["n"], 997)
        listed = joined.select("sale_id", "cashier")
        assert ran(listed) == lopsided["n"]
        assert "skew=true" in plan(listed)


def test_a_hot_sale_and_product_are_split_over_tasks(spark, lopsided):
    headers = lopsided["sales"].select("sale_id", "sale_date", "sale_time")
    with settings(spark, **SPLITTING):
        detail = sales.sale_detail(headers, lopsided["items"], lopsided["products"]).select("sale_id", "product_name")
        assert ran(detail) == lopsided["n"]
        assert "skew=true" in plan(detail)
        lines = sales._lines_of(headers, lopsided["items"]).select("product_id")
        assert ran(lines) == lopsided["n"]
        assert "skew=true" in plan(lines) and "LeftSemi" in plan(lines)


def test_a_hot_key_of_two_joins_in_a_row_is_split(spark, lopsided):
    """The second join would reuse the partitions of the first: the session lets it shuffle instead."""
    badges = lopsided["users"].selectExpr("user_id AS cashier_id", "user_id + 1 AS badge")
    with settings(spark, **SPLITTING):
        both = sales._with_cashier(lopsided["sales"], lopsided["users"]).join(badges, "cashier_id")
        both = both.select("sale_id", "cashier", "badge")
        assert ran(both) == lopsided["n"]
        assert "skew=true" in plan(both)


def test_a_hot_line_of_returns_is_split_though_the_lines_are_summed(spark, lopsided):
    lines = lopsided["items"].selectExpr(
        "sale_id AS cart_id", "product_id", "item_id AS line_no", "CAST(quantity AS BIGINT) AS quantity", "unit_price"
    )
    items = rollup.merge_cart_lines(lines).withColumnRenamed("cart_id", "sale_id")
    requests = lopsided["items"].selectExpr(
        "sale_id", "product_id", "quantity", "uuid() AS reason", "1 AS processed_by",
        "CAST('2026-06-10' AS TIMESTAMP_NTZ) AS returned_at",
    )
    stock_ = lopsided["products"].selectExpr("product_id", "0L AS quantity")
    with settings(spark, **SPLITTING):
        got = ledger.process_returns(requests, items, stock_, lopsided["products"])["returns"].select("reason", "refund_amount")
        assert ran(got) == lopsided["n"]
        assert "skew=true" in plan(got)


def test_hot_keys_do_not_change_sums(spark, lopsided):
    counted = sales.counted_sales(lopsided["sales"], "all", "2026-06-10")
    assert sales.sales_kpis(counted, lopsided["users"]).first()[:2] == (lopsided["n"], lopsided["n"])
    units = sales.units_by_product(lopsided["sales"], lopsided["items"], lopsided["products"])
    assert units.agg(F.sum("units")).first()[0] == 2 * lopsided["n"]


def test_sorted_lists_end_in_an_id(spark, lopsided):
    """All sales fall on one date and time; the range shuffle still cuts them into several partitions."""
    with settings(spark, adaptive__coalescePartitions__enabled="false"):
        listed = sales.sales_list(lopsided["sales"], lopsided["users"])
        sizes = [r[1] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < lopsided["n"] / 4


def test_inventory_sorts_on_the_id_too(spark):
    text = plan(stock.inventory_status(Shop(spark, DIRECTORY).products, Shop(spark, DIRECTORY).inventory))
    assert re.search(r"rangepartitioning\(quantity#\d+L? ASC NULLS FIRST, product_id", text)


def test_splittable_joins_meet_keys_of_other_types(spark):
    """An INT key finds the BIGINT key of the same value, also by the tag that keeps the join splittable."""
    many = spark.createDataFrame([(1, 2, "a"), (3, None, "b")], "k INT, j INT, text STRING")
    for kind in ("BIGINT", "SMALLINT", "DECIMAL(10,2)", "DOUBLE", "INT"):
        one = spark.createDataFrame([(1, 2, 10), (3, 4, 20)], "k BIGINT, j BIGINT, value INT").withColumn("k", F.col("k").cast(kind))
        assert {(r.text, r.value) for r in rollup.joined_in_splits(many, one, ["k"], "left").collect()} == {("a", 10), ("b", 20)}
        both = rollup.joined_in_splits(many, one, ["k", "j"], "left").collect()
        assert {(r.text, r.value) for r in both} == {("a", 10), ("b", None)}
