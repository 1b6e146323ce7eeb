"""Every registered query against its SQL counterpart in a second engine."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from oracle_queries import ORACLE
from shopmetrics.plans.catalog import QUERIES
from shopmetrics.sources.star import STAR

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables")


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for table in STAR:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'").fetchall()
    return connection


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in data), key=repr)


def same(spark, other, name):
    df = QUERIES[name](spark, DIRECTORY)
    cursor = other.execute(ORACLE[name])
    columns, types = [c[0] for c in cursor.description], [str(c[1]) for c in cursor.description]
    expected = cursor.fetchall()
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(columns, types))
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got == canonical(columns, expected)
    return got


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    assert same(spark, other, name)


@pytest.mark.parametrize(
    "name",
    ["master_detail", "units_by_product", "revenue_by_category", "tx_by_cashier", "profit_and_loss", "sales_kpis_all",
     "post_sales", "process_returns", "edit_products_inventory", "void_sales", "movement_history", "top5_products"],
)
def test_query_without_any_broadcast(spark, other, name):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        same(spark, other, name)
    finally:
        for key in keys:
            spark.conf.unset(key)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["branch", "revenue", "txns"] and df.count() == 25


def test_registry():
    """The whole registry holds every query of this library, and SQL only for registered queries."""
    names, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(QUERIES) <= set(names) and set(sql) <= set(names)
    assert all(sql[name] == ORACLE[name] for name in QUERIES)


def test_registry_without_the_corpus_folder(tmp_path):
    """What is left still imports and registers its queries where the corpus operators are not there."""
    root = os.path.dirname(os.path.abspath(entry_points.__file__))
    for name in ("__spark_entry__.py", "oracle_queries.py"):
        shutil.copy(os.path.join(root, name), tmp_path)
    shutil.copytree(os.path.join(root, "shopmetrics"), tmp_path / "shopmetrics", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert found.stdout.split() == sorted(QUERIES)
