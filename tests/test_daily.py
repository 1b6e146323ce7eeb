"""Daily sums that batches keep up to date, and the lines of a day read without the other days."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import daily, ids, ledger
from shopmetrics.plans import sales
from shopmetrics.sources import batches, readers, sinks
from shopmetrics.sources.schemas import RETAIL
from shopmetrics.sources.star import Shop

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SALES = (
    "sale_id BIGINT, sale_date DATE, cashier_id BIGINT, payment_method STRING, total_amount DECIMAL(18,2), "
    "is_voided BOOLEAN, voided_by BIGINT, void_reason STRING"
)
REQUESTS = "seq BIGINT, sale_id BIGINT, requested_by BIGINT, reason STRING, requested_at TIMESTAMP_NTZ"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_sales(spark, rng, first, n):
    day = lambda: rng.choice([None, "2026-06-08", "2026-06-09", "2026-06-10"])
    data = [
        (first + i, day(), rng.choice([1, 2, None]), rng.choice(["cash", "card", None]), rng.choice([None, "0.00", "4.50", "-2.25"]),
         rng.random() < 0.2, None, None)
        for i in range(n)
    ]
    return spark.createDataFrame(data, SALES.replace("DATE,", "STRING,").replace("DECIMAL(18,2)", "STRING")).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in readers.T.StructType.fromDDL(SALES).fields]
    )


@pytest.mark.parametrize("seed", range(3))
def test_changes_come_to_a_recount(spark, seed):
    """Batches of sales with voids of old, new, voided, unknown and repeated sales, with and without reasons."""
    rng = random.Random(seed)
    table, state = random_sales(spark, rng, 0, 40), None
    state = daily.daily_sums(table)
    for first in (40, 60):
        new = random_sales(spark, rng, first, rng.choice([0, 15]) if first == 40 else 15)
        asked = [(i, rng.choice([None, *range(90)]), 1, rng.choice(["wrong", "", None]), None) for i in range(40)]
        requests = spark.createDataFrame(asked, REQUESTS)
        state = state.union(daily.change(new, table, requests))
        after = ledger.void_sales(table.union(new), requests)["sales"]
        table = spark.createDataFrame(after.collect(), after.schema)
        state = spark.createDataFrame(state.collect(), daily.DAILY_SUMS)
    kinds = lambda df: [(f.name, f.dataType) for f in df.schema.fields]
    assert kinds(daily.merged(state)) == kinds(daily.daily_sums(table)) == kinds(spark.createDataFrame([], daily.DAILY_SUMS))
    assert rows(daily.merged(state)) == rows(daily.daily_sums(table))
    assert rows(daily.merged(daily.merged(state))) == rows(daily.merged(state))  # compacting changes nothing


def test_empty_and_fully_voided(spark):
    table = random_sales(spark, random.Random(9), 0, 10)
    none = daily.change(table.limit(0), table, spark.createDataFrame([], REQUESTS))
    assert none.collect() == [] and daily.merged(none).collect() == []
    requests = spark.range(10).selectExpr("id AS seq", "id AS sale_id", "1L AS requested_by", "'all' AS reason", "now() AS requested_at")
    assert daily.merged(daily.daily_sums(table).union(daily.voided_sums(table, requests))).collect() == []


def test_dashboard_and_home_from_daily_sums(spark):
    s, day = Shop(spark, DIRECTORY), "2001-07-31"
    kept = daily.daily_sums(s.sales)
    for period in ("month", "all"):
        whole = sales.sales_dashboard(s.sales, s.users, s.products, s.inventory, period, day)
        for name, df in sales.kept_dashboard(kept, s.users, period, day).items():
            found = df.collect()
            assert found and found == whole[name].collect(), (period, name)
    home = lambda t: sales.home_metrics(t, s.expenses, s.products, s.inventory, day)
    assert home(kept).collect() == home(s.sales).collect()


def test_change_is_published_with_its_sales_once(spark, tmp_path):
    root, table = str(tmp_path / "shop"), ids.fitted(Shop(spark, DIRECTORY).sales.limit(50), RETAIL["sales"])
    for _ in range(2):  # the second run of the batch changes nothing
        batches.publish(spark, root, "b1", {"sales": table, "daily_sums": daily.daily_sums(table)})
    stored = batches.published(spark, root, "daily_sums", daily.DAILY_SUMS)
    assert rows(daily.merged(stored)) == rows(daily.daily_sums(batches.published(spark, root, "sales", RETAIL["sales"])))


def test_lines_of_a_day_are_pruned(spark, tmp_path):
    """By month, by the ids of the day's sales within it, and with the same result as on all lines."""
    s, path = Shop(spark, DIRECTORY), str(tmp_path / "lines")
    months = F.date_format("sale_date", "yyyy-MM") >= "2001-06"
    kept = s.sale_items.join(s.sales.filter(months), "sale_id", "left_semi")
    sinks.write_lines_by_month(kept, s.sales, path)
    assert rows(readers.load_by_month(spark, path, kept.schema)) == rows(kept)
    days = [r[0] for r in s.sales.filter(months & ~F.col("is_voided")).select("sale_date").distinct().limit(2).collect()]
    for day in days:
        lines = readers.load_by_month(spark, path, kept.schema, day, day)
        top = sales.top_products(s.sales, lines, s.products, day)
        assert top.collect() == sales.top_products(s.sales, s.sale_items, s.products, day).collect()
    text = top._jdf.queryExecution().toString()
    scan = next(line for line in text[text.index("== Physical Plan ==") :].split("\n") if "FileScan" in line and "month#" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= ", scan)
    assert "GreaterThanOrEqual(sale_id,ScalarSubquery" in scan and "LessThanOrEqual(sale_id,ScalarSubquery" in scan


def test_row_groups_of_other_days_stay_unread(spark, tmp_path):
    """Lines stored in the order of their sales: the scan gives the rows of few row groups."""
    day = F.date_add(F.lit("2026-06-01").cast("date"), F.floor(F.col("id") / 10_000).cast("int"))
    spark.range(100_000).select(
        F.col("id").alias("sale_id"), day.alias("sale_date"), F.lit(False).alias("is_voided")
    ).write.parquet(str(tmp_path / "sales"))
    spark.range(100_000).coalesce(1).selectExpr("id AS sale_id", "id % 7 AS product_id", "1 AS quantity").sortWithinPartitions(
        "sale_id"
    ).write.option("parquet.block.size", 8_192).option("parquet.page.row.count.limit", 500).option(
        "parquet.block.size.row.check.min", 100
    ).parquet(str(tmp_path / "lines"))
    products = spark.range(7).selectExpr("id AS product_id", "CONCAT('p', id) AS product_name")
    top = sales.top_products(
        spark.read.parquet(str(tmp_path / "sales")), spark.read.parquet(str(tmp_path / "lines")), products, "2026-06-03"
    )
    assert sum(r.units_sold for r in top.collect()) >= 10_000 * 5 // 7
    plan, scanned, todo = top._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan)
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec" and "product_id" in node.schema().simpleString():
            scanned.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert scanned and max(scanned) < 50_000
