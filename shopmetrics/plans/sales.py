"""Sales reports (R1, R2, R4-R6, R14, R17; A1, A2, A4-A12, A18; O2-O4).

Sorted lists end in the id of the row: the order is the same on every run, and a range partition
can cut inside a date that holds much of the data.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.dates import (
    as_date, days_before, hour_of, in_calendar_month, in_period, month_end, month_start, on_day,
)
from shopmetrics.functions.labels import hour_label
from shopmetrics.functions.money import ColumnOrName, change_from, col, line_total
from shopmetrics.functions.predicates import not_voided
from shopmetrics.operators.daily import with_figures
from shopmetrics.operators.rollup import in_order, newest, side_by_side, sums_by_name, sums_per_key
from shopmetrics.plans.stock import low_stock_count, low_stock_items

DETAIL_COLUMNS = (
    "sale_id", "sale_date", "sale_time", "customer_name", "cashier_name", "branch_name",
    "product_name", "category", "quantity", "unit_price", "total",
)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A4. Row count per table."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# ---- supermarket chain ----------------------------------------------------------------------


def sale_headers(sales: DataFrame, customers: DataFrame, cashiers: DataFrame, branches: DataFrame) -> DataFrame:
    """J4 without the lines. Inner joins: a sale without customer, cashier or branch drops out.

    The branches come last: sales laid out by customer stay so for the lookups by person."""
    return (
        sales.join(customers.select("customer_id", "customer_name"), "customer_id")
        .join(cashiers.select("cashier_id", "cashier_name"), "cashier_id")
        .join(branches.select("branch_id", "branch_name"), "branch_id")
    )


def sale_detail(
    headers: DataFrame, items: DataFrame, products: DataFrame, unit_price: str = "unit_price"
) -> DataFrame:
    """J4. One row per sale line, unsorted. ``unit_price`` is a column of the lines or the products."""
    named = products.drop(*[c for c in items.columns if c != "product_id"])
    return (
        headers.join(items, "sale_id")
        .join(named, "product_id")
        .withColumn("unit_price", F.col(unit_price))
        .withColumn("total", line_total("quantity", "unit_price"))
    )


def master_detail(headers: DataFrame, items: DataFrame, products: DataFrame, unit_price: str = "unit_price") -> DataFrame:
    """R1. The detail list by date and time."""
    return (
        sale_detail(headers, items, products, unit_price)
        .orderBy("sale_date", "sale_time", "sale_id", "item_id", "product_name")
        .select(*DETAIL_COLUMNS)
    )


def revenue_by_branch(
    sales: DataFrame, items: DataFrame, branches: DataFrame, amount: ColumnOrName | None = None
) -> DataFrame:
    """A5. Revenue and distinct sales per branch, highest first.

    ``amount`` is the line amount; quantity times unit price if not given. Lines are summed per
    sale first, so that each sale meets its header as one row; rows of one sale stay together, so
    counting distinct sales needs no shuffle of its own.
    """
    line = line_total("quantity", "unit_price") if amount is None else col(amount)
    per_sale = items.groupBy("sale_id").agg(F.sum(line).alias("revenue"))
    per_branch = (
        sales.select("sale_id", "branch_id")
        .join(per_sale, "sale_id")
        .groupBy("sale_id", "branch_id")
        .agg(F.sum("revenue").alias("revenue"))
        .groupBy("branch_id")
        .agg(F.sum("revenue").alias("revenue"), F.count("*").alias("txns"))
    )
    return (
        per_branch.join(branches.select("branch_id", "branch_name"), "branch_id")
        .groupBy(F.col("branch_name").alias("branch"))
        .agg(F.sum("revenue").alias("revenue"), F.sum("txns").alias("txns"))
        .orderBy(F.desc("revenue"), "branch")
    )


def _lines_of(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Lines of the sales in ``headers``, without the header's own columns."""
    return items.join(headers.select("sale_id"), "sale_id", "left_semi")


def units_by_product(headers: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """A6. Units per product name, most sold first. Products that share a name merge."""
    return (
        sums_by_name(_lines_of(headers, items), "product_id", products, "product_id", ["product_name"], ["quantity"])
        .filter(F.col("product_name").isNotNull())
        .select("product_name", F.col("quantity").alias("units"))
        .orderBy(F.desc("units"), "product_name")
    )


def revenue_by_category(
    headers: DataFrame, items: DataFrame, products: DataFrame, amount: ColumnOrName | None = None
) -> DataFrame:
    """A7. Revenue per category, highest first."""
    line = line_total("quantity", "unit_price") if amount is None else col(amount)
    lines = _lines_of(headers, items).withColumn("revenue", line)
    return (
        sums_by_name(lines, "product_id", products, "product_id", ["category"], ["revenue"])
        .filter(F.col("category").isNotNull())
        .orderBy(F.desc("revenue"), "category")
    )


def sold_headers(headers: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Headers with at least one line of a known product: the sales that the detail list shows."""
    known = items.select("sale_id", "product_id").join(
        products.select("product_id"), "product_id", "left_semi"
    )
    return headers.join(known.select("sale_id").distinct(), "sale_id", "left_semi")


def tx_by_cashier(detail: DataFrame) -> DataFrame:
    """A8. Distinct sales per cashier name, most first. Takes the detail or ``sold_headers``."""
    return (
        detail.filter(F.col("cashier_name").isNotNull())
        .groupBy(F.col("cashier_name").alias("cashier"))
        .agg(F.countDistinct("sale_id").alias("txns"))
        .orderBy(F.desc("txns"), "cashier")
    )


def tx_by_hour(detail: DataFrame) -> DataFrame:
    """A9. Distinct sales per hour of ``sale_time``, busiest first, with the twelve-hour label."""
    return (
        detail.withColumn("hour", hour_of("sale_time"))
        .filter(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(F.countDistinct("sale_id").alias("txns"))
        .withColumn("label", hour_label("hour"))
        .orderBy(F.desc("txns"), "hour")
    )


#: The summaries of the report pack: what each groups by, and the figure it shows.
SUMMARIES = {
    "branch_revenue": ("branch_name", "total_revenue"), "product_sales": ("product_name", "total_quantity"),
    "category_revenue": ("category", "total_revenue"), "cashier_performance": ("cashier_name", "txns"),
    "hourly_traffic": ("hour", "txns"),
}


def summary_rows(detail: DataFrame) -> DataFrame:
    """R2. All summaries of the report pack as rows ``summary, key, total_revenue, total_quantity, txns``, from one pass
    over a detail list.

    Grouping sets sum in each task before the shuffle; sales are counted by grouping lines per sale first, and then the
    sales. Each summary fills the figure it shows and leaves the others NULL; keys are text. Lines without a key are
    left out of its summary, a NULL sale is not counted.
    """
    lines = detail.withColumn("hour", hour_of("sale_time").cast("string"))
    by = [key for key, _ in SUMMARIES.values()]
    per_sale = {key for key, figure in SUMMARIES.values() if figure == "txns"}
    columns = [*by, "sale_id"]
    sets = [[key, "sale_id"] if key in per_sale else [key] for key in by]
    # A column that is not in a row's set has its bit in the grouping id; the first column has the highest.
    bit = {c: 1 << (len(columns) - 1 - k) for k, c in enumerate(columns)}
    id_of = {name: sum(b for c, b in bit.items() if c not in group) for name, group in zip(SUMMARIES, sets)}
    grouped = lines.groupingSets([[F.col(c) for c in group] for group in sets], *[F.col(c) for c in columns]).agg(
        F.grouping_id().alias("_set"), F.sum("total").alias("total"), F.sum("quantity").alias("quantity")
    )
    summary = F.create_map(*[F.lit(x) for name, number in id_of.items() for x in (number, name)])[F.col("_set").cast("int")]
    keyed = grouped.select(
        summary.alias("summary"), F.coalesce(*by).alias("key"), "total", "quantity",
        F.when(F.col("sale_id").isNotNull(), 1).alias("sale"),
    ).filter(F.col("key").isNotNull())
    shows = lambda figure: F.col("summary").isin([n for n, (_, f) in SUMMARIES.items() if f == figure])
    return keyed.groupBy("summary", "key").agg(
        F.when(shows("total_revenue"), F.sum("total")).alias("total_revenue"),
        F.when(shows("total_quantity"), F.sum("quantity")).alias("total_quantity"),
        F.when(shows("txns"), F.count("sale")).alias("txns"),
    )


def one_summary(all_rows: DataFrame, name: str) -> DataFrame:
    """One summary out of ``summary_rows``, highest first; the hours with their labels."""
    key, figure = SUMMARIES[name]
    shown = all_rows.filter(F.col("summary") == name)
    if key == "hour":
        hours = shown.select(F.col("key").cast("int").alias("hour"), "txns").withColumn("label", hour_label("hour"))
        return hours.orderBy(F.desc("txns"), "hour")
    key = "cashier" if key == "cashier_name" else key
    return shown.select(F.col("key").alias(key), figure).orderBy(F.desc(figure), key)


def detail_summaries(detail: DataFrame) -> dict[str, DataFrame]:
    """R2. The summaries of the report pack, from a detail list."""

    def summary(key: str, value: Column, name: str) -> DataFrame:
        return (
            detail.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(value.alias(name))
            .orderBy(F.desc(name), key)
        )

    return {
        "branch_revenue": summary("branch_name", F.sum("total"), "total_revenue"),
        "product_sales": summary("product_name", F.sum("quantity"), "total_quantity"),
        "category_revenue": summary("category", F.sum("total"), "total_revenue"),
        "cashier_performance": tx_by_cashier(detail),
        "hourly_traffic": tx_by_hour(detail),
    }


# ---- back office ----------------------------------------------------------------------------


def _with_cashier(sales: DataFrame, users: DataFrame) -> DataFrame:
    """J3."""
    names = users.select(F.col("user_id").alias("cashier_id"), F.col("full_name").alias("cashier"))
    return sales.join(names, "cashier_id")


def sales_list(sales: DataFrame, users: DataFrame) -> DataFrame:
    """R4. Every sale, voided ones included, with its cashier; newest first."""
    return (
        _with_cashier(sales, users)
        .select("sale_id", "sale_date", "sale_time", "cashier", "payment_method", "total_amount", "is_voided")
        .orderBy(F.desc("sale_date"), F.desc("sale_time"), F.desc("sale_id"))
    )


def voidable_sales(sales: DataFrame, users: DataFrame) -> DataFrame:
    """R14. Sales that can still be voided, newest first."""
    return sales_list(sales.filter(not_voided()), users).drop("is_voided")


def returnable_sales(sales: DataFrame, users: DataFrame, k: int = 100) -> DataFrame:
    """R17. The newest sales that goods can come back from."""
    order = [("sale_date", True), ("sale_id", True)]
    return (
        newest(sales.filter(not_voided()), order, {"cashier_id": users.select("user_id")}, k)
        .join(users.select(F.col("user_id").alias("cashier_id"), F.col("full_name").alias("cashier")), "cashier_id")
        .orderBy(*in_order(order))
        .select("sale_id", "sale_date", "cashier", "payment_method", "total_amount")
    )


def sale_item_list(items: DataFrame, products: DataFrame, sale_id=None) -> DataFrame:
    """R17/J12. Lines of one sale, or of every sale, with product names."""
    kept = items if sale_id is None else items.filter(F.col("sale_id") == F.lit(sale_id))
    return kept.join(products.select("product_id", "product_name"), "product_id").select(
        "sale_id", "product_id", "product_name", "quantity", "unit_price", "subtotal"
    )


def counted_sales(sales: DataFrame, period: str, as_of, start=None, end=None) -> DataFrame:
    """sales that count in a period."""
    return sales.filter(not_voided() & in_period("sale_date", period, as_of, start, end))


def _sales_per_cashier(counted: DataFrame, users: DataFrame, *by: str) -> DataFrame:
    """Totals per cashier and ``by`` for cashiers who are users; what all dashboard figures sum up.

    ``counted`` holds sales, or daily sums of them.
    """
    marked = counted if "txns" in counted.columns else with_figures(counted)
    return sums_per_key(
        marked, "cashier_id", users, "user_id", ["full_name"], ["total", "txns", "priced"], by
    )


def sales_kpis(counted: DataFrame, users: DataFrame) -> DataFrame:
    """A1. Revenue, number of sales and average sale; zeros when there are none."""
    total = F.coalesce(F.sum("total"), F.lit(0))
    average = F.try_divide(F.sum("total").cast("double"), F.sum("priced").cast("double"))
    return _sales_per_cashier(counted, users).agg(
        total.alias("revenue"),
        F.coalesce(F.sum("txns"), F.lit(0)).alias("transactions"),
        F.coalesce(average, F.lit(0.0)).alias("avg_transaction"),
    )


def daily_sales(counted: DataFrame, users: DataFrame) -> DataFrame:
    """A10. Total and number of priced sales per day, newest first."""
    return (
        _sales_per_cashier(counted, users, "sale_date")
        .filter(F.col("sale_date").isNotNull())
        .groupBy("sale_date")
        .agg(
            F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
            F.coalesce(F.sum("priced"), F.lit(0)).alias("txns"),
        )
        .orderBy(F.desc("sale_date"))
    )


def sales_by_cashier(counted: DataFrame, users: DataFrame) -> DataFrame:
    """A11."""
    return (
        _sales_per_cashier(counted, users)
        .filter(F.col("full_name").isNotNull())
        .groupBy(F.col("full_name").alias("cashier"))
        .agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
        .orderBy("cashier")
    )


def sales_by_payment(counted: DataFrame, users: DataFrame) -> DataFrame:
    """A12."""
    return (
        _sales_per_cashier(counted, users, "payment_method")
        .filter(F.col("payment_method").isNotNull())
        .groupBy("payment_method")
        .agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
        .orderBy("payment_method")
    )


def sales_dashboard(
    sales: DataFrame, users: DataFrame, products: DataFrame, inventory: DataFrame, period: str, as_of,
    start=None, end=None,
) -> dict[str, DataFrame]:
    """R5. Low stock, figures, daily summary, by cashier, by payment method, and the sales themselves."""
    counted = counted_sales(sales, period, as_of, start, end)
    return {
        "low_stock": low_stock_items(products, inventory),
        "kpis": sales_kpis(counted, users),
        "daily": daily_sales(counted, users),
        "by_cashier": sales_by_cashier(counted, users),
        "by_payment": sales_by_payment(counted, users),
        "transactions": sales_list(counted, users),
    }


def kept_dashboard(
    daily: DataFrame, users: DataFrame, period: str, as_of, start=None, end=None
) -> dict[str, DataFrame]:
    """R5 from daily sums (``operators.daily``): figures, daily summary, by cashier and by payment method."""
    of_period = daily.filter(in_period("sale_date", period, as_of, start, end))
    return {
        "kpis": sales_kpis(of_period, users),
        "daily": daily_sales(of_period, users),
        "by_cashier": sales_by_cashier(of_period, users),
        "by_payment": sales_by_payment(of_period, users),
    }


def _sum_on(condition: Column, amount: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(amount))), F.lit(0))


def home_metrics(
    sales: DataFrame, expenses: DataFrame, products: DataFrame, inventory: DataFrame, as_of
) -> DataFrame:
    """R6/A2. Today against yesterday, the calendar month, and low stock, in one row.

    One pass over the days that matter, instead of a query per figure. ``sales`` may be daily sums (``operators.daily``).
    """
    day, before = as_date(as_of), days_before(as_of, 1)
    window = F.col("sale_date").between(
        F.lit(min(before, month_start(day))), F.lit(month_end(day))
    )
    today, yesterday = on_day("sale_date", day), on_day("sale_date", before)
    kept = "txns" in sales.columns
    counted = sales.filter(window) if kept else with_figures(sales.filter(not_voided() & window))
    takings = counted.agg(
        _sum_on(today, "total").alias("today_revenue"),
        _sum_on(today, "txns").alias("today_transactions"),
        _sum_on(yesterday, "total").alias("yesterday_revenue"),
        _sum_on(in_calendar_month("sale_date", day), "total").alias("month_revenue"),
    )
    spent = expenses.filter(in_calendar_month("expense_date", day)).agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("month_expenses")
    )
    row = side_by_side(takings, spent, low_stock_count(products, inventory))
    return row.withColumn("change", change_from("today_revenue", "yesterday_revenue"))


def top_products(sales: DataFrame, items: DataFrame, products: DataFrame, day, k: int = 5) -> DataFrame:
    """A18. Best sold product names of a day; ties by name.

    The day's smallest and largest sale ids are worked out first and reach the scan of the lines as bounds: ids that
    grow with time leave all but the day's row groups unread. Lines stored by ``sinks.write_lines_by_month`` and loaded
    by ``readers.load_by_month`` from the day to the day are read of its month only.
    """
    of_day = sales.filter(not_voided() & on_day("sale_date", day)).select("sale_id")
    # Two plain top-ones: Spark merges aggregates into one struct, whose fields it does not push into a scan.
    low, high = (of_day.filter("sale_id IS NOT NULL").orderBy(by).limit(1).scalar() for by in (F.asc("sale_id"), F.desc("sale_id")))
    near = items.filter((F.col("sale_id") >= low) & (F.col("sale_id") <= high))
    sold = near.select("sale_id", "product_id", "quantity").join(of_day, "sale_id")
    return (
        sums_by_name(sold, "product_id", products, "product_id", ["product_name"], ["quantity"])
        .select("product_name", F.col("quantity").alias("units_sold"))
        .orderBy(F.desc("units_sold"), "product_name")
        .limit(k)
    )


def home(
    sales: DataFrame, items: DataFrame, expenses: DataFrame, products: DataFrame, inventory: DataFrame, as_of
) -> dict[str, DataFrame]:
    """R6. The figures of the day, its best products, and a preview of what is low."""
    return {
        "metrics": home_metrics(sales, expenses, products, inventory, as_of),
        "top_products": top_products(sales, items, products, as_of),
        "low_stock": low_stock_items(products, inventory, 5),
    }
