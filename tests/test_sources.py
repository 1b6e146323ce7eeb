"""Readers, typed imports and sinks."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.plans import catalog
from shopmetrics.session import shuffle_tasks
from shopmetrics.sources import imports, readers, schemas, sinks
from shopmetrics.sources.star import STAR
from tests.conftest import rows


def test_every_schema_round_trips_through_parquet(spark, tmp_path):
    for name, schema in schemas.SCHEMAS.items():
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(path)
        assert readers.load_table(spark, str(tmp_path), name, schema).schema == schema


def test_businesses_explode(spark):
    data = [({"One": (5000, 3200), "Two": (8000, 5500)},)]
    df = spark.createDataFrame(data, "b MAP<STRING, STRUCT<revenue: INT, expenses: INT>>")
    assert sorted(rows(readers.explode_businesses(df, "b"))) == [("One", 5000, 3200), ("Two", 8000, 5500)]


def test_rates_document(spark, tmp_path):
    path = tmp_path / "rates.json"
    path.write_text(json.dumps({"base": "USD", "rates": {"GHS": 12.5, "EUR": 0.92}}, indent=1))
    assert sorted(rows(readers.load_rates(spark, str(path)))) == [("USD", "EUR", 0.92), ("USD", "GHS", 12.5)]


def test_sheet_columns_go_by_position(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("Any,Header,At All\n1,x,2.5\n2,,3\n")
    schema = T.StructType.fromDDL("n INT, t STRING, d DECIMAL(10,2)")
    assert rows(readers.load_sheet(spark, str(path), schema)) == [
        (1, "x", Decimal("2.50")), (2, None, Decimal("3.00")),
    ]


def test_sheet_with_a_bad_number_fails(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("n\n1\nabc\n")
    with pytest.raises(Exception):
        readers.load_sheet(spark, str(path), T.StructType.fromDDL("n INT")).collect()


def test_records_must_match_their_header(spark, tmp_path):
    path = tmp_path / "records.csv"
    path.write_text("product,quantity,price\nSoap,3,2.50\n")
    assert rows(readers.load_records(spark, str(path), schemas.SALES_SHEET)) == [("Soap", 3, Decimal("2.50"))]
    path.write_text("price,quantity,product\n2.50,3,Soap\n")
    with pytest.raises(Exception):
        readers.load_records(spark, str(path), schemas.SALES_SHEET).collect()


def test_conform_dates_by_declared_type(spark):
    df = spark.createDataFrame(
        [(46174.5, "46174", dt.date(2026, 6, 1), dt.datetime(2026, 6, 1, 9, 30))],
        "a DOUBLE, b STRING, c DATE, d TIMESTAMP_NTZ",
    )
    schema = T.StructType.fromDDL("a DATE, b DATE, c DATE, d DATE")
    day = dt.date(2026, 6, 1)
    assert rows(imports.conform(df, schema)) == [(day, None, day, day)]


def test_conform_fails_on_a_bad_number(spark):
    df = spark.createDataFrame([("x",)], "a STRING")
    with pytest.raises(Exception):
        imports.conform(df, T.StructType.fromDDL("a INT")).collect()


def test_first_row_of_a_key_wins_in_any_layout(spark):
    data = [(k, f"v{o}", o) for o, k in enumerate(["a", "b", "a", "c", "b", "a"])]
    df = spark.createDataFrame(data, "k STRING, v STRING, o INT").repartition(5)
    got = imports.load_dedup(df, "k", "o")
    assert got.columns == ["k", "v"]
    assert sorted(rows(got)) == [("a", "v0"), ("b", "v1"), ("c", "v3")]


def test_hotel_load(spark, tmp_path):
    sheets = {
        "rooms": "_row,No,Type,Floor,Cap,Price,Status,Amenities\n"
        "1,101,Single,1,1,80.5,Free,TV\n2,101,Double,1,2,99,Free,\n3,102,Double,1,2,120,Taken,TV\n",
        "bookings": "r,a,b,c,d,e,f,g,h,i,j,k,l,m\n"
        "1,B1,Guest,GH,101,Single,46174,46176.5,2,80.5,161,Web,cash,Done\n",
        "restaurant_revenue": "r,a,b,c,d\n1,46174,Lunch,20,900\n2,46174,Lunch,20,900\n",
        "staff": "r,a,b,c,d,e,f\n2,S1,Second,Cook,Kitchen,1000,Active\n1,S1,First,Cook,Kitchen,1000,Active\n",
        "expenses": "r,a,b,c,d\n1,June,Rent,Office,500.25\n",
    }
    for name, text in sheets.items():
        (tmp_path / f"{name}.csv").write_text(text)
    hotel = imports.load_hotel(spark, str(tmp_path))
    assert {n: df.schema for n, df in hotel.items()} == dict(schemas.HOTEL)
    assert sorted(r[:4] for r in rows(hotel["rooms"])) == [("101", "Single", 1, 1), ("102", "Double", 1, 2)]
    (booking,) = hotel["bookings"].collect()
    assert (booking.check_in, booking.check_out, booking.nights) == (dt.date(2026, 6, 1), dt.date(2026, 6, 3), 2)
    assert booking.total_amount == Decimal("161.00")
    assert hotel["restaurant_revenue"].count() == 2
    assert rows(hotel["staff"])[0][:2] == ("S1", "First")
    assert rows(hotel["expenses"]) == [("June", "Rent", "Office", Decimal("500.25"))]


def test_reports_are_written_by_name(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "n")
    sinks.write_reports({"one": df, "two": df.filter("n > 0")}, str(tmp_path))
    sinks.write_reports({"one": df.filter("n = 0")}, str(tmp_path))  # replaces
    assert spark.read.parquet(str(tmp_path / "one")).count() == 1
    assert spark.read.parquet(str(tmp_path / "two")).count() == 2
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(rows(spark.read.option("header", True).csv(str(tmp_path / "csv")))) == [("0",), ("1",), ("2",)]


def test_log_rows_append(spark, tmp_path):
    log = spark.createDataFrame([(1, 2, "LOGIN", None, None)], schemas.RETAIL["activity_log"])
    new = spark.createDataFrame([(3, "VOID")], "user_id INT, action STRING")
    assert [r[:3] for r in rows(sinks.append_activity(log, new))] == [(1, 2, "LOGIN"), (None, 3, "VOID")]
    path = str(tmp_path / "log")
    sinks.append_rows(log, path)
    sinks.append_rows(log, path)
    assert spark.read.parquet(path).count() == 2


def test_monthly_table_reads_only_the_months_asked_for(spark, tmp_path):
    path = str(tmp_path / "sales")
    df = spark.range(200).select(
        F.col("id").cast("int").alias("sale_id"),
        F.date_add(F.lit(dt.date(2026, 1, 1)), F.col("id").cast("int")).alias("sale_date"),
    )
    sinks.write_by_month(df, "sale_date", path)
    part = readers.load_by_month(spark, path, df.schema, "2026-02-10", "2026-03-05")
    assert part.count() == 28 + 31 and part.columns == ["sale_id", "sale_date"]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert readers.load_by_month(spark, path, df.schema).count() == 200


def test_shuffles_begin_with_enough_tasks():
    assert shuffle_tasks(0) == 200
    assert shuffle_tasks(1 << 40) == 4096
    assert shuffle_tasks(100 << 40) == 409_600
    assert shuffle_tasks(0, least=8) == 8


def test_queries_read_small_parts_of_their_shuffles(spark, monkeypatch, tmp_path):
    """16 MB of a shuffle per task however much is read: tasks of 64 MB took 1.7 GB in the returns."""
    advisory, initial = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(initial, None)
    monkeypatch.setattr(catalog, "input_bytes", lambda df: 6 << 30)
    for name in ("lineitem", "part"):
        spark.createDataFrame([], STAR[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    try:
        catalog.QUERIES["process_returns"](spark, str(tmp_path))
        assert int(spark.conf.get(initial)) == 6 * 64
        size = int(spark._jsparkSession.sessionState().conf().getConfString(advisory).removesuffix("m"))
        assert size <= 16
        with sinks.file_sized(spark):
            assert spark.conf.get(advisory) == "64m"
        assert spark.conf.get(advisory) == f"{size}m"
    finally:
        spark.conf.unset(initial) if before is None else spark.conf.set(initial, before)


def test_staged_frames_are_worked_out_once(spark):
    stored = sinks.staged(spark.range(10).withColumn("x", F.rand()))
    assert rows(stored) == rows(stored)
    assert "Rand" not in stored._jdf.queryExecution().toString() and "rand(" not in stored._jdf.queryExecution().toString()


def test_rows_that_do_not_parse_are_kept_with_their_line(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("n,day,text\n1,2026-06-01,a\nx,2026-06-02,b\n3,yesterday,c\n4,,\n5,2026-06-05,e,extra\n")
    for by_name in (False, True):
        got = readers.load_checked(spark, str(path), T.StructType.fromDDL("n INT, day DATE, text STRING"), by_name)
        assert sorted(r.n for r in got["rows"].collect()) == [1, 4]
        assert {r.line: r.refused for r in got["rejected"].collect()} == dict.fromkeys(
            ["x,2026-06-02,b", "3,yesterday,c", "5,2026-06-05,e,extra"], "not as declared"
        )
        assert got["rows"].select("text").count() == 2 and got["rejected"].count() == 3
        assert got["rejected"].first().file.endswith("sheet.csv")


def test_first_row_wins_however_a_file_is_cut(spark, tmp_path):
    """The order of the rows comes from the files, whatever the splits."""
    for part in range(3):
        lines = [f"k{k % 40},{part * 1000 + k}" for k in range(400)]
        (tmp_path / f"part-{part}.csv").write_text("key,n\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "500b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = readers.in_file_order(readers.load_sheet(spark, str(tmp_path), T.StructType.fromDDL("key STRING, n INT")))
            assert size == "128m" or raw.rdd.getNumPartitions() > 6
            first = imports.load_dedup(raw, "key", "_row")
            assert first.columns == ["key", "n"]
            assert {r.key: r.n for r in first.collect()} == {f"k{k}": k for k in range(40)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hotel_sheets_without_row_numbers(spark, tmp_path):
    for name, ddl in imports.HOTEL_SHEETS.items():
        columns = [c.split()[0] for c in ddl.split(", ")][1:]
        (tmp_path / f"{name}.csv").write_text(",".join(columns) + "\n")
    (tmp_path / "staff.csv").write_text("staff_id,full_name,role,department,salary,status\ns1,First,,,10,\ns1,Second,,,11,\ns2,Other,,,12,\n")
    hotel = imports.load_hotel(spark, str(tmp_path), numbered=False)
    assert {r.staff_id: r.full_name for r in hotel["staff"].collect()} == {"s1": "First", "s2": "Other"}
    assert hotel["bookings"].collect() == [] and set(hotel) == set(imports.HOTEL_SHEETS)


def test_ordered_csv_reads_as_one_file(spark, tmp_path):
    path = tmp_path / "report"
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("n"), F.lit('say "a, b"').alias("text, quoted"))
    df = df.repartition(6).orderBy("n")
    with_parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = sinks.write_ordered_csv(df, str(path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_parts)
    assert len(order) > 3 and json.loads((path / "_order.json").read_text()) == order
    whole = "".join((path / name).read_text() for name in order)
    assert whole.startswith('n,"text, quoted"\n')
    (tmp_path / "one.csv").write_text(whole)
    back = spark.read.option("header", True).csv(str(tmp_path / "one.csv")).collect()
    assert [int(r[0]) for r in back] == list(range(5000)) and back[0][1] == 'say "a, b"'
