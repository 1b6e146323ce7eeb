"""Ids of new rows, and ledger batches that are stored, read back with their schemas and published once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import ids, ledger
from shopmetrics.sources import batches
from shopmetrics.sources.schemas import RETAIL
from tests.fixtures import money, retail

NOW = dt.datetime(2026, 6, 10, 12, 30, 5)


def numbered(df, name):
    return sorted((tuple(r)[1:], r[name]) for r in df.collect())


def test_ids_are_dense_and_do_not_hang_on_the_layout(spark):
    stored = spark.createDataFrame([(41,), (7,), (None,)], "log_id long")
    rows = spark.range(500).select((F.col("id") % 90).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    one = numbered(ids.with_ids(rows.repartition(3), stored, "log_id", parts=4), "log_id")
    two = numbered(ids.with_ids(rows.orderBy(F.rand(1)).repartition(11).withColumn("log_id", F.lit(1)), stored, "log_id", parts=4), "log_id")
    assert sorted(i for _, i in one) == list(range(42, 542))
    distinct = lambda found: {r: {i for x, i in found if x == r} for r, _ in found}
    assert distinct(one) == distinct(two)  # rows that are equal share their ids in any order
    empty = ids.with_ids(rows.limit(0), stored.limit(0), "log_id")
    assert empty.collect() == [] and empty.columns == ["log_id", "a", "b"]
    first = ids.with_ids(rows.limit(1), stored.limit(0), "log_id", by=["a"], parts=1)
    assert [r["log_id"] for r in first.collect()] == [1]


def posted(spark, tables, cart):
    carts = spark.createDataFrame(
        [(cart, 2, "cash", None, None, NOW)],
        "cart_id BIGINT, cashier_id BIGINT, payment_method STRING, discount_type STRING, discount_value DECIMAL(10,2), sold_at TIMESTAMP_NTZ",
    )
    lines = spark.createDataFrame(
        [(cart, 1, 1, 2, money(45)), (cart, 5, 2, 1, money(6))],
        "cart_id BIGINT, product_id BIGINT, line_no INT, quantity INT, unit_price DECIMAL(10,2)",
    )
    return ledger.post_sales(carts, lines, tables["inventory"])


def state(spark, root):
    return {name: batches.published(spark, root, name, schema) for name, schema in RETAIL.items()}


def stored_as(out, tables, replaced=("inventory",)):
    schemas = {n: s for n, s in RETAIL.items() if n not in replaced}
    added = ids.added_rows({n: df for n, df in out.items() if n not in replaced}, tables, schemas, parts=3)
    return added, {n: ids.fitted(out[n], RETAIL[n]) for n in replaced if n in out}


def test_ledger_round_trip(spark, tmp_path):
    """Post, read with the schemas, post again, void, return, post: ids go on and every row fits."""
    root = str(tmp_path / "shop")
    assert batches.published(spark, root, "sales", RETAIL["sales"]).collect() == []
    assert batches.publish(spark, root, "opening", {}, {n: ids.fitted(df, RETAIL[n]) for n, df in retail(spark).items()})
    for cart in (1, 2):
        tables = state(spark, root)
        added, replaced = stored_as(posted(spark, tables, cart), tables)
        assert batches.publish(spark, root, f"cart {cart}", added, replaced)
    tables = state(spark, root)
    assert {n: df.schema for n, df in tables.items()} == RETAIL
    assert sorted(r.sale_item_id for r in tables["sale_items"].collect()) == [1, 2, 3, 4]
    assert sorted(r.movement_id for r in tables["stock_movements"].collect()) == [1, 2, 3, 4]

    asked = spark.createDataFrame(
        [(1, 1, 1, "Double entry", NOW)], "seq INT, sale_id BIGINT, requested_by BIGINT, reason STRING, requested_at TIMESTAMP_NTZ"
    )
    out = ledger.void_sales(tables["sales"], asked)
    added, replaced = stored_as(out, tables, replaced=("sales",))
    assert batches.publish(spark, root, "void 1", added, replaced)
    tables = state(spark, root)
    assert {r.sale_id: (r.is_voided, r.voided_by, r.void_reason) for r in tables["sales"].collect()} == {
        1: (True, 1, "Double entry"), 2: (False, None, None),
    }

    line = tables["sale_items"].filter("sale_id = 2 AND product_id = 1").first()
    back = spark.createDataFrame(
        [(2, 1, 2, "Damaged", 1, NOW, line.sale_item_id)],
        "sale_id BIGINT, product_id BIGINT, quantity INT, reason STRING, processed_by BIGINT, returned_at TIMESTAMP_NTZ, sale_item_id BIGINT",
    )
    out = ledger.process_returns(back, tables["sale_items"], tables["inventory"], tables["products"])
    added, replaced = stored_as(out, tables)
    assert batches.publish(spark, root, "return 1", added, replaced)
    tables = state(spark, root)
    added, replaced = stored_as(posted(spark, tables, 3), tables)
    assert batches.publish(spark, root, "cart 3", added, replaced)
    tables = state(spark, root)
    assert [float(r.refund_amount) for r in tables["returns"].collect()] == [90.0]
    assert sorted(r.movement_id for r in tables["stock_movements"].collect()) == list(range(1, 8))
    logged = [r.log_id for r in tables["activity_log"].collect()]
    assert sorted(logged) == list(range(1, len(logged) + 1))
    stock = {r.product_id: r.quantity for r in tables["inventory"].collect()}
    opening = {r.product_id: r.quantity for r in retail(spark)["inventory"].collect()}
    assert stock[1] == opening[1] - 4 and stock[5] == opening[5] - 3


def test_a_batch_is_published_once(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "log"), spark.range(3).toDF("n")
    read = lambda: sorted(r.n for r in batches.published(spark, root, "t", rows.schema).collect())
    assert batches.publish(spark, root, "a", {"t": rows}) and not batches.publish(spark, root, "a", {"t": rows})
    assert read() == [0, 1, 2]
    broken = rows.select(F.raise_error(F.lit("broken")).cast("long").alias("n"))
    with pytest.raises(Exception, match="broken"):
        batches.publish(spark, root, "b", {"u": rows, "t": broken})
    assert read() == [0, 1, 2] and batches.published(spark, root, "u", rows.schema).collect() == []
    # Another batch that comes first takes the number: this one is not published on top of a state it has not seen.
    known, was = batches._manifests(spark, root), batches._manifests
    assert batches.publish(spark, root, "c", {"t": rows})
    monkeypatch.setattr(batches, "_manifests", lambda *_: known)
    with pytest.raises(batches.AlreadyPublished):
        batches.publish(spark, root, "d", {"t": rows})
    monkeypatch.setattr(batches, "_manifests", was)
    assert read() == [0, 0, 1, 1, 2, 2]
    assert batches.publish(spark, root, "e", {}, {"t": rows.limit(1)}) and len(read()) == 1
    assert batches.publish(spark, root, "f", {"t": rows}) and len(read()) == 4
