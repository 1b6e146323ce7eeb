"""Column expressions on the rows that are easy to get wrong."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopmetrics.functions import dates, labels, money, parsing, predicates
from tests.conftest import rows


def values(spark, ddl, data, *exprs):
    """Results of ``exprs`` over ``data``, one list per expression."""
    got = spark.createDataFrame(data, ddl).select(*exprs).collect()
    columns = [list(c) for c in zip(*got)]
    return columns[0] if len(exprs) == 1 else columns


def D(x):
    return Decimal(x)


def test_margin_of_nothing_is_null_or_the_given_value(spark):
    data = [(D("18.00"), D("50.00")), (D("5.00"), D("0.00")), (D("5.00"), D("-1.00")), (None, D("1.00"))]
    plain, guarded = values(
        spark, "p DECIMAL(18,2), w DECIMAL(18,2)", data,
        money.margin_pct("p", "w"), money.margin_pct("p", "w", scale=2, on_zero=0),
    )
    assert [float(x) if x is not None else None for x in plain] == [36.0, None, -500.0, None]
    assert [float(x) if x is not None else None for x in guarded] == [36.0, 0.0, 0.0, None]


def test_margin_rounds_half_to_even(spark):
    data = [(D("12.25"), D("100.00")), (D("12.35"), D("100.00")), (D("1.00"), D("3.00"))]
    got = values(spark, "p DECIMAL(18,2), w DECIMAL(18,2)", data, money.margin_pct("p", "w", scale=1))
    assert [float(x) for x in got] == [12.2, 12.4, 33.3]


def test_verdict_and_band(spark):
    got = values(spark, "p INT", [(1,), (0,), (-1,), (None,)], money.profit_verdict("p"))
    assert got == ["profit", "broke even", "loss", None]
    got = values(spark, "m DOUBLE", [(20.0,), (19.9,), (10.0,), (9.9,)], money.margin_band("m"))
    assert got == ["green", "orange", "orange", "red"]


def test_discounts_never_exceed_the_subtotal(spark):
    data = [
        (D("100.00"), None, D("5.00")), (D("100.00"), "fixed", D("5.00")), (D("100.00"), "fixed", D("500.00")),
        (D("100.00"), "percent", D("12.50")), (D("100.00"), "percent", D("150.00")), (D("100.00"), "other", D("5.00")),
        (D("10.01"), "percent", D("50.00")),
    ]
    off = money.discount_amount("s", "k", "v")
    got, total = values(
        spark, "s DECIMAL(18,2), k STRING, v DECIMAL(18,2)", data, off, money.discounted_total("s", off)
    )
    assert got == [D("0.00"), D("5.00"), D("100.00"), D("12.50"), D("100.00"), D("0.00"), D("5.01")]
    assert total == [D("100.00"), D("95.00"), D("0.00"), D("87.50"), D("0.00"), D("100.00"), D("5.00")]


def test_total_is_floored_at_zero(spark):
    got = values(spark, "s DECIMAL(18,2), d DECIMAL(18,2)", [(D("3.00"), D("5.00"))], money.discounted_total("s", "d"))
    assert got == [D("0.00")]


def test_change_above_and_till_verdict(spark):
    assert values(spark, "a INT, b INT", [(5, 3), (5, 0), (5, None)], money.change_from("a", "b")) == [2, None, None]
    assert values(spark, "a DOUBLE", [(3000.0,), (3000.01,), (None,)], money.above("a", 3000)) == [False, True, False]
    got = values(spark, "d DECIMAL(18,2)", [(D("0.00"),), (D("0.01"),), (D("-0.01"),)], money.till_verdict("d"))
    assert got == ["balanced", "overage", "shortage"]


def test_money_text_and_conversion(spark):
    got = values(spark, "a DECIMAL(18,3)", [(D("1234.125"),), (D("-5.000"),)], money.money_text("a", "GHS"))
    assert got == ["GHS 1,234.12", "GHS -5.00"]
    got = values(spark, "a DECIMAL(18,2), r DOUBLE", [(D("0.50"), 0.25), (D("10.00"), 12.5)], money.converted("a", "r"))
    assert got == [D("0.12"), D("125.00")]


def test_hour_labels(spark):
    data = [(h,) for h in (0, 8, 11, 12, 13, 23)]
    got = values(spark, "h INT", data, labels.hour_label("h"))
    assert got == ["00:00 AM", "08:00 AM", "11:00 AM", "12:00 PM", "01:00 PM", "11:00 PM"]


def test_times_of_day(spark):
    got = values(spark, "t STRING", [("08:30:15",), ("23:59:59",)], dates.hour_of("t"), dates.hhmm("t"))
    assert got == [[8, 23], ["08:30", "23:59"]]


def test_clock_time_does_not_depend_on_the_session_time_zone(spark):
    """02:30 did not exist in New York on that day; the shop's clock showed it all the same."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        data = [(dt.datetime(2026, 3, 8, 2, 30, 5, 999999),), (dt.datetime(2026, 3, 8, 0, 0),)]
        assert values(spark, "t TIMESTAMP_NTZ", data, dates.time_of_day("t")) == ["02:30:05", "00:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stock_status_and_labels(spark):
    got = values(spark, "q INT, r INT", [(5, 5), (6, 5), (None, 5)], labels.stock_status("q", "r"))
    assert got == ["Low Stock", "OK", "OK"]
    assert values(spark, "b BOOLEAN", [(True,), (False,), (None,)], labels.active_label("b")) == [
        "Active", "Inactive", "Inactive",
    ]
    got = values(
        spark, "n STRING, r STRING", [("Ann", "cashier")],
        labels.staff_label("n", labels.title_case("r")), labels.same_text("n", F.lit("ANN")),
    )
    assert got == [["Ann (Cashier)"], [True]]


def test_sale_label(spark):
    data = [(7, dt.date(2026, 6, 1), D("12.50"), "Ann")]
    got = values(
        spark, "i INT, d DATE, t DECIMAL(10,2), c STRING", data, labels.sale_label("i", "d", "t", "c", "GHS")
    )
    assert got == ["Sale #7 — 2026-06-01 — GHS 12.50 (Ann)"]


def test_random_values_stay_in_range_and_repeat(spark):
    df = spark.range(2000).select(labels.rand_int(1, 100, 7).alias("n"), labels.rand_choice(["a", "b", "c"], 3).alias("c"))
    first, again = rows(df), rows(df)
    assert first == again
    numbers = [n for n, _ in first]
    assert min(numbers) >= 1 and max(numbers) <= 100 and len(set(numbers)) > 80
    assert {c for _, c in first} == {"a", "b", "c"}


def test_random_values_by_key_do_not_hang_on_the_layout(spark):
    ids = spark.range(3000)
    drawn = lambda df: {r.id: (r.n, r.c) for r in df.select("id", labels.rand_int(-5, 4, 7, "id").alias("n"), labels.rand_choice(["a", "b"], 3, "id").alias("c")).collect()}
    one, two = drawn(ids), drawn(ids.repartition(7).orderBy(F.desc("id")))
    assert one == two and {n for n, _ in one.values()} == set(range(-5, 5))
    counts = [sum(n == k for n, _ in one.values()) for k in range(-5, 5)]
    assert min(counts) > 230 and max(counts) < 370
    other = ids.select(labels.rand_int(-5, 4, 8, "id").alias("n"))
    assert sum(r.n == one[k][0] for k, r in enumerate(other.collect())) < 450


@pytest.mark.parametrize(
    "serial, expected",
    [
        (1.0, dt.date(1899, 12, 31)), (59.0, dt.date(1900, 2, 27)), (61.0, dt.date(1900, 3, 1)),
        (46174.0, dt.date(2026, 6, 1)), (46174.99, dt.date(2026, 6, 1)), (-0.5, dt.date(1899, 12, 30)),
        (float("nan"), None), (None, None), (float("inf"), None), (1e12, None), (-1e12, None),
        (2958465.0, dt.date(9999, 12, 31)), (2958466.0, None), (-693593.0, dt.date(1, 1, 1)),
    ],
)
def test_serial_dates(spark, serial, expected):
    assert values(spark, "s DOUBLE", [(serial,)], dates.excel_date("s")) == [expected]


def test_whole_numbers(spark):
    data = [("12",), (" -3 ",), ("1_000",), ("12.5",), ("",), ("abc",), (None,), ("+7",), ("_1",)]
    got = values(spark, "t STRING", data, parsing.safe_int("t"))
    assert [int(x) if x is not None else None for x in got] == [12, -3, 1000, None, None, None, None, 7, None]


def test_ratio_reports_why_it_failed(spark):
    data = [("10", "5"), ("10", "10"), ("x", "5"), ("10", None), ("0", "4")]
    got = values(spark, "r STRING, e STRING", data, parsing.safe_ratio("r", "e"))
    assert [tuple(x) for x in got] == [
        (2.0, None), (None, parsing.EQUAL_OPERANDS), (None, parsing.INVALID_NUMBER), (None, parsing.INVALID_NUMBER),
        (0.0, None),
    ]


def test_periods():
    bounds = dates.period_bounds
    wednesday = "2026-06-10"
    assert bounds("today", wednesday) == (dt.date(2026, 6, 10), dt.date(2026, 6, 10))
    assert bounds("week", wednesday) == (dt.date(2026, 6, 8), dt.date(2026, 6, 10))
    assert bounds("week", "2026-06-08") == (dt.date(2026, 6, 8), dt.date(2026, 6, 8))
    assert bounds("month", wednesday) == (dt.date(2026, 6, 1), dt.date(2026, 6, 10))
    assert bounds("range", wednesday) == (dt.date(2026, 6, 1), dt.date(2026, 6, 10))
    assert bounds("range", wednesday, "2026-01-05", "2026-02-01") == (dt.date(2026, 1, 5), dt.date(2026, 2, 1))
    assert bounds("all", wednesday) is None
    with pytest.raises(ValueError):
        bounds("year", wednesday)


@pytest.mark.parametrize("day, last", [("2026-02-10", 28), ("2028-02-10", 29), ("2026-12-31", 31), ("2026-04-01", 30)])
def test_month_end(day, last):
    assert dates.month_end(day).day == last


def test_calendar_month_holds_later_days_and_period_does_not(spark):
    data = [(dt.date(2026, 6, 1),), (dt.date(2026, 6, 30),), (dt.date(2026, 7, 1),)]
    got = values(
        spark, "d DATE", data,
        dates.in_calendar_month("d", "2026-06-10"), dates.in_period("d", "month", "2026-06-10"),
    )
    assert got == [[True, True, False], [True, False, False]]


def test_long_date(spark):
    assert values(spark, "d DATE", [(dt.date(2026, 6, 1),)], dates.long_date("d")) == ["Monday, 01 June 2026"]


def test_predicates_treat_missing_values_as_no(spark):
    df = spark.createDataFrame(
        [("a", True, 1), ("", False, 0), (None, None, None)], "t STRING, b BOOLEAN, n INT"
    )
    got = rows(df.select(predicates.filled("t"), predicates.positive("n")))
    assert got == [(True, True), (False, False), (False, False)]
    assert df.filter(predicates.not_voided("b")).count() == 1
    assert df.filter(predicates.sellable("b", "n")).count() == 1
    assert df.filter(predicates.has_status("b", "Inactive")).count() == 2
    assert df.filter(predicates.has_status("b", "All")).count() == 3


def test_search_is_literal_and_ignores_case(spark):
    df = spark.createDataFrame([("Rice 5kg",), ("100% Juice",), ("Bread",)], "n STRING")
    search = lambda q: [r[0] for r in df.filter(predicates.name_contains("n", q)).collect()]
    assert search("rICE") == ["Rice 5kg"]
    assert search("%") == ["100% Juice"]
    assert len(search("")) == len(search(None)) == 3


def test_square_root_and_rounding_functions(spark):
    got = rows(spark.range(1).select(F.sqrt(F.lit(144.0)), F.pi(), F.ceil(F.lit(4.3)), F.floor(F.lit(4.9))))
    assert got[0][0] == 12.0 and abs(got[0][1] - 3.14159265) < 1e-8 and got[0][2:] == (5, 4)
