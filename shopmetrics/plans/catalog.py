"""Every report and ledger job by name, on the star tables of one directory.

The registry behind ``__spark_entry__.queries`` and ``bench.py``. Decimal results become DOUBLE
here, in the last projection, and nowhere earlier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.functions import dates, labels, money, parsing
from shopmetrics.operators import daily, ledger, rollup, tills
from shopmetrics.plans import backoffice, finance, sales, stock
from shopmetrics.session import SHUFFLED_PER_READ, input_bytes, tuned
from shopmetrics.sources.imports import conform, load_dedup, load_hotel_table
from shopmetrics.sources.readers import explode_businesses
from shopmetrics.sources.sinks import append_activity
from shopmetrics.sources.star import STAR, Shop

AS_OF = "2001-07-31"
RANGE = ("1998-01-01", "1999-06-30")
# The sale, and the cashier, of the lists for one.
ONE_SALE, ONE_CASHIER = 7, 7
CASH = "1-URGENT"
CURRENCIES = ["NATION_1", "NATION_7", "NATION_20", "NOWHERE"]


def shown(df: DataFrame) -> DataFrame:
    """Exact decimals as DOUBLE, for display and comparison."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _headers(s: Shop) -> DataFrame:
    return sales.sale_headers(s.branch_sales, s.customers, s.cashiers, s.branches)


def _detail(s: Shop) -> DataFrame:
    return sales.master_detail(
        _headers(s), s.sale_items.drop("subtotal"), s.products.withColumnRenamed("selling_price", "price"), "price"
    )


def _counted(s: Shop, period: str) -> DataFrame:
    return sales.counted_sales(s.sales, period, AS_OF, *RANGE)


def _kpis(period: str) -> Callable[[Shop], DataFrame]:
    return lambda s: sales.sales_kpis(_counted(s, period), s.users)


def _returns(s: Shop) -> dict[str, DataFrame]:
    items = rollup.merge_cart_lines(s.cart_lines).withColumnRenamed("cart_id", "sale_id")
    return ledger.process_returns(s.return_requests, items, s.inventory, s.products)


def _lines_sold(s: Shop) -> DataFrame:
    """Lines as they were sold, a product at several prices included; line numbers of a sale repeat in the source."""
    return s.cart_lines.select(
        F.col("cart_id").alias("sale_id"), (F.col("line_no") / 1_000_000_000_000).cast("bigint").alias("sale_item_id"),
        "product_id", "quantity", "unit_price",
    )


def _returns_by_line(s: Shop) -> dict[str, DataFrame]:
    requests = s.return_requests.withColumn("sale_item_id", F.when(F.col("processed_by") % 2 == 0, F.col("quantity") % 7 + 1))
    return ledger.process_returns(requests, _lines_sold(s), s.inventory, s.products)


def _expenses(s: Shop) -> dict[str, DataFrame]:
    new = {
        "expense_id": F.col("expense_id") + 1_000_000_000_000,
        "amount": (F.col("amount") - 20).cast(money.MONEY),
        "recorded_at": F.col("expense_date").cast("timestamp_ntz"),
    }
    return ledger.record_expenses(s.expenses, s.expenses.withColumns(new))


def _posted(s: Shop) -> dict[str, DataFrame]:
    return ledger.post_sales(s.carts, s.cart_lines, s.inventory)


def _businesses(s: Shop) -> DataFrame:
    """A business per customer: what it ordered, and what its events cost."""
    revenue = s.sales.groupBy("customer_id").agg(F.sum("total_amount").alias("revenue"))
    spent = s.expenses.groupBy(F.col("recorded_by").alias("customer_id")).agg(F.sum("amount").alias("expenses"))
    rows = s.customers.join(revenue, "customer_id", "left").join(spent, "customer_id", "left")
    figures = F.struct(
        *[money.as_total(F.coalesce(c, F.lit(0))).alias(c) for c in ("revenue", "expenses")]
    )
    return explode_businesses(
        rows.select(F.create_map("customer_name", figures).alias("businesses")), "businesses"
    )


def _pnl_rows(s: Shop) -> DataFrame:
    units = s.sale_items.groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    return (
        s.products.join(units, "product_id")
        .select(
            F.col("product_id").alias("row_no"), F.col("product_name").alias("product"),
            "selling_price", "cost_price", "quantity",
        )
    )


def _records(s: Shop) -> DataFrame:
    priced = s.products.select("product_id", F.col("product_name").alias("product"), F.col("selling_price").alias("price"))
    return s.sale_items.join(priced, "product_id").select("product", "quantity", "price")


def _rates(s: Shop) -> DataFrame:
    return s.branches.select(
        F.col("branch_name").alias("currency"), ((F.col("branch_id") + 1) * 0.25).cast(money.RATE).alias("rate")
    )


def _serials(s: Shop) -> DataFrame:
    """Sale dates as spreadsheet serials with a time of day in the fraction."""
    serial = F.datediff("sale_date", F.lit(dates.SERIAL_DAY_ZERO)).cast("double") + F.lit(0.75)
    return s.sales.select("sale_id", serial.alias("sale_date"))


def _booking_sheet(s: Shop) -> DataFrame:
    """Orders as rows of a booking sheet: one booking number per customer, so that most rows come too late."""
    sale = s.sales.withColumn("check_in", F.datediff("sale_date", F.lit(dates.SERIAL_DAY_ZERO)).cast("double"))
    nights = (F.col("sale_id") % 14 + 1).cast("int")
    text = lambda c: F.col(c).cast("string")
    return sale.select(
        F.col("sale_id").alias("_row"),
        F.concat(F.lit("B"), text("customer_id")).alias("booking_id"),
        F.concat(F.lit("Guest "), text("customer_id")).alias("guest_name"),
        F.lit(None).cast("string").alias("nationality"),
        (F.col("customer_id") % 100).cast("string").alias("room_number"),
        F.lit("Double").alias("room_type"),
        "check_in",
        (F.col("check_in") + nights + F.lit(0.5)).alias("check_out"),
        nights.alias("nights"),
        F.col("total_amount").cast("double").alias("price_per_night"),
        F.col("total_amount").cast("double").alias("total_amount"),
        F.lit("Web").alias("booking_source"),
        "payment_method",
        F.when(F.col("is_voided"), "Cancelled").otherwise("Confirmed").alias("status"),
    )


def _takings_sheet(s: Shop) -> DataFrame:
    serial = F.datediff("expense_date", F.lit(dates.SERIAL_DAY_ZERO)).cast("double")
    return s.expenses.select(
        F.col("expense_id").alias("_row"), serial.alias("date"), F.col("category").alias("meal_type"),
        (F.col("expense_id") % 40).cast("double").alias("covers"), F.col("amount").cast("double").alias("revenue"),
    )


def _ratios(s: Shop) -> DataFrame:
    texts = s.sales.select(
        "sale_id",
        F.when(F.col("is_voided"), "n/a").otherwise(F.col("customer_id").cast("string")).alias("revenue"),
        (F.col("sale_id") % 1500).cast("string").alias("expenses"),
    )
    return texts.select("sale_id", parsing.safe_ratio("revenue", "expenses").alias("r")).select("sale_id", "r.*")


def _labels(s: Shop) -> DataFrame:
    """Text labels of every sale."""
    listed = s.sales.join(s.users.withColumnRenamed("user_id", "cashier_id"), "cashier_id")
    return listed.select(
        "sale_id",
        labels.sale_label("sale_id", "sale_date", "total_amount", "full_name", "GHS").alias("sale_label"),
        labels.staff_label("full_name", labels.title_case("role")).alias("staff_label"),
        money.money_text("total_amount", "GHS").alias("amount_text"),
        dates.long_date("sale_date").alias("long_date"),
        dates.hhmm("sale_time").alias("hhmm"),
        labels.same_text("role", F.lit("Machinery")).alias("is_machinery"),
    )


def _product_margins(s: Shop) -> DataFrame:
    """Margin of selling at cost plus the product's stock, and its band."""
    stocked = s.products.join(s.inventory, "product_id")
    marked_up = (F.col("cost_price") * (100 + F.col("quantity")) / 100).cast(money.MONEY)
    margin = money.margin_pct(marked_up - F.col("cost_price"), marked_up, scale=1, on_zero=0)
    return stocked.select("product_id", margin.alias("margin_pct")).withColumn("band", money.margin_band("margin_pct"))


def _kept_sums(s: Shop) -> DataFrame:
    """Daily sums of the sales before a day, and a batch that brings the other sales and voids of sales of any age."""
    stored = F.col("sale_date") < dates.as_date(RANGE[0])
    old, new = s.sales.filter(stored), s.sales.filter(~F.coalesce(stored, F.lit(False)))
    return daily.merged(daily.daily_sums(old).union(daily.change(new, old, s.void_requests)))


_VIEWS: dict[str, Callable[[Shop], DataFrame]] = {
    # counts and the supermarket pack
    "table_counts": lambda s: sales.table_counts({t: s.table(t) for t in STAR}),
    "revenue_by_branch": lambda s: sales.revenue_by_branch(s.branch_sales, s.sale_items, s.branches, "subtotal"),
    "master_detail": _detail,
    "detail_summaries": lambda s: sales.summary_rows(_detail(s)),
    "units_by_product": lambda s: sales.units_by_product(_headers(s), s.sale_items, s.products),
    "revenue_by_category": lambda s: sales.revenue_by_category(_headers(s), s.sale_items, s.products, "subtotal"),
    "tx_by_cashier": lambda s: sales.tx_by_cashier(sales.sold_headers(_headers(s), s.sale_items, s.products)),
    "tx_by_hour": lambda s: sales.tx_by_hour(s.visits),
    "reorder_alert": lambda s: stock.reorder_alert(s.branch_inventory, s.products, s.branches),
    # sales dashboard
    "sales_list": lambda s: sales.sales_list(s.sales, s.users),
    "sales_kpis_today": _kpis("today"),
    "sales_kpis_week": _kpis("week"),
    "sales_kpis_month": _kpis("month"),
    "sales_kpis_range": _kpis("range"),
    "sales_kpis_all": _kpis("all"),
    "daily_sales": lambda s: sales.daily_sales(_counted(s, "all"), s.users),
    "by_cashier": lambda s: sales.sales_by_cashier(_counted(s, "all"), s.users),
    "by_payment": lambda s: sales.sales_by_payment(_counted(s, "all"), s.users),
    "period_transactions": lambda s: sales.sales_list(_counted(s, "range"), s.users),
    "kept_daily_sums": _kept_sums,
    "kept_daily_sales": lambda s: sales.kept_dashboard(_kept_sums(s), s.users, "all", AS_OF)["daily"],
    "kept_by_cashier": lambda s: sales.kept_dashboard(_kept_sums(s), s.users, "all", AS_OF)["by_cashier"],
    # home
    "kept_home_metrics": lambda s: sales.home_metrics(_kept_sums(s), s.deliveries, s.products, s.inventory, AS_OF),
    "home_metrics": lambda s: sales.home_metrics(s.sales, s.deliveries, s.products, s.inventory, AS_OF),
    "top5_products": lambda s: sales.top_products(s.sales, s.sale_items, s.products, AS_OF),
    "low_stock_preview": lambda s: stock.low_stock_items(s.products, s.inventory, 5),
    # stock
    "inventory_status": lambda s: stock.inventory_status(s.products, s.inventory),
    "inventory_counts": lambda s: stock.inventory_counts(s.products, s.inventory),
    "low_stock_items": lambda s: stock.low_stock_items(s.products, s.inventory),
    "movement_history": lambda s: stock.movement_history(s.stock_movements, s.products, s.users),
    "catalogue": lambda s: stock.catalogue(s.products, s.inventory),
    "catalogue_search": lambda s: stock.catalogue(s.products, s.inventory, "RING", "SMALL", "Active"),
    "categories": lambda s: stock.categories(s.products),
    "available_products": lambda s: stock.available_products(s.products, s.inventory),
    # finance
    "expense_list": lambda s: finance.expense_list(s.expenses, s.users),
    "expenses_by_category": lambda s: finance.expenses_by_category(s.expenses, s.users),
    "total_expenses": lambda s: finance.total_expenses(s.expenses, s.users),
    "profit_and_loss": lambda s: finance.profit_and_loss(s.sales, s.users, s.sale_items, s.products, s.expenses),
    "business_report": lambda s: finance.business_report(_businesses(s)),
    "product_pnl": lambda s: finance.product_pnl(_pnl_rows(s)),
    "product_pnl_summary": lambda s: finance.pnl_summary(finance.product_pnl(_pnl_rows(s))),
    "best_row": lambda s: finance.best_row(_pnl_rows(s), "product", "quantity", "row_no"),
    "sheet_summary": lambda s: finance.sheet_summary(_records(s)),
    "period_stats": lambda s: finance.period_stats(s.sales, "customer_id", "total_amount", 250000),
    "fx_convert": lambda s: finance.fx_convert(
        s.sales.select("sale_id", "total_amount"), _rates(s), CURRENCIES, "total_amount"
    ),
    "product_margins": _product_margins,
    "safe_ratio": _ratios,
    "text_labels": _labels,
    "excel_dates": lambda s: conform(_serials(s), T.StructType.fromDDL("sale_id BIGINT, sale_date DATE")),
    # back office
    "staff_list": lambda s: backoffice.staff_list(s.users).drop("created_at"),
    "activity_view": lambda s: backoffice.activity_view(s.activity_log, s.users),
    "voidable_sales": lambda s: sales.voidable_sales(s.sales, s.users),
    "shift_breakdown": lambda s: tills.shift_breakdown(s.sales),
    "expected_cash": lambda s: tills.expected_cash(s.sales, CASH),
    "till_history": lambda s: backoffice.till_history(
        tills.reconcile_tills(s.sales, s.declarations, CASH)["till_reconciliations"], s.users
    ),
    "returnable_sales": lambda s: sales.returnable_sales(s.sales, s.users),
    "sale_item_list": lambda s: sales.sale_item_list(
        s.sale_items.withColumn("unit_price", F.col("subtotal")), s.products
    ),
    "one_sale": lambda s: sales.sale_item_list(
        s.sale_items.withColumn("unit_price", F.col("subtotal")), s.products, ONE_SALE
    ),
    "one_cashier": lambda s: tills.shift_breakdown(s.sales, ONE_CASHIER),
    "active_user": lambda s: backoffice.active_user(s.users, f"u{ONE_CASHIER}"),
    "returns_history": lambda s: backoffice.returns_history(s.returns, s.products, s.users),
    "sales_alerts": lambda s: backoffice.sales_alerts(s.sales, s.products, s.inventory, AS_OF),
    # ledger
    "cart_merge": lambda s: rollup.merge_cart_lines(s.cart_lines),
    "post_sales": lambda s: _posted(s)["sales"],
    "post_sales_items": lambda s: _posted(s)["sale_items"],
    "post_sales_movements": lambda s: _posted(s)["stock_movements"],
    "post_sales_inventory": lambda s: _posted(s)["inventory"],
    "post_sales_activity": lambda s: _posted(s)["activity"],
    "post_sales_rejected_lines": lambda s: ledger.post_sales(
        s.carts, s.cart_lines.withColumn("quantity", F.col("quantity") - 3), s.inventory
    )["rejected_lines"],
    "apply_movements": lambda s: ledger.apply_movements(s.inventory, s.stock_movements, s.products)["inventory"],
    "apply_movements_activity": lambda s: ledger.apply_movements(s.inventory, s.stock_movements, s.products)["activity"],
    "apply_movements_movements": lambda s: ledger.apply_movements(
        s.inventory, s.stock_movements, s.products
    )["stock_movements"],
    "apply_movements_rejected": lambda s: ledger.apply_movements(s.inventory, s.stock_movements, s.products)["rejected"],
    "receive_stock": lambda s: ledger.receive_stock(s.inventory, s.stock_movements, s.products)["inventory"],
    "receive_stock_activity": lambda s: ledger.receive_stock(s.inventory, s.stock_movements, s.products)["activity"],
    "void_sales": lambda s: ledger.void_sales(s.sales, s.void_requests)["sales"].drop("sale_time"),
    "void_sales_activity": lambda s: ledger.void_sales(s.sales, s.void_requests)["activity"],
    "process_returns": lambda s: _returns(s)["returns"],
    "process_returns_inventory": lambda s: _returns(s)["inventory"],
    "process_returns_activity": lambda s: _returns(s)["activity"],
    "process_returns_movements": lambda s: _returns(s)["stock_movements"],
    "process_returns_rejected": lambda s: _returns(s)["rejected"],
    "process_returns_by_line": lambda s: _returns_by_line(s)["returns"],
    "process_returns_by_line_rejected": lambda s: _returns_by_line(s)["rejected"],
    "add_products": lambda s: ledger.add_products(s.products, s.inventory, s.new_products)["products"],
    "add_products_inventory": lambda s: ledger.add_products(s.products, s.inventory, s.new_products)["inventory"],
    "add_products_activity": lambda s: ledger.add_products(s.products, s.inventory, s.new_products)["activity"],
    "add_products_rejected": lambda s: ledger.add_products(s.products, s.inventory, s.new_products)["rejected"],
    "edit_products": lambda s: ledger.edit_products(s.products, s.inventory, s.product_edits)["products"],
    "edit_products_inventory": lambda s: ledger.edit_products(s.products, s.inventory, s.product_edits)["inventory"],
    "edit_products_activity": lambda s: ledger.edit_products(s.products, s.inventory, s.product_edits)["activity"],
    "set_active": lambda s: ledger.set_active(s.products, s.status_requests)["products"],
    "set_active_activity": lambda s: ledger.set_active(s.products, s.status_requests)["activity"],
    "set_active_rejected": lambda s: ledger.set_active(
        s.products, s.status_requests.withColumn("is_active", F.when(F.col("seq") % 3 > 0, F.col("is_active")))
    )["rejected"],
    "upsert_staff": lambda s: ledger.upsert_staff(s.users, s.staff_requests)["users"],
    "upsert_staff_activity": lambda s: ledger.upsert_staff(s.users, s.staff_requests)["activity"],
    "upsert_staff_rejected": lambda s: ledger.upsert_staff(s.users, s.staff_requests)["rejected"],
    "record_expenses": lambda s: _expenses(s)["expenses"],
    "record_expenses_activity": lambda s: _expenses(s)["activity"],
    "record_expenses_rejected": lambda s: _expenses(s)["rejected"],
    "reconcile_tills": lambda s: tills.reconcile_tills(s.sales, s.declarations, CASH)["till_reconciliations"],
    "reconcile_tills_activity": lambda s: tills.reconcile_tills(s.sales, s.declarations, CASH)["activity"],
    "till_verdicts": lambda s: tills.reconcile_tills(s.sales, s.declarations, CASH)["verdicts"],
    "append_activity": lambda s: append_activity(
        s.activity_log, ledger.void_sales(s.sales, s.void_requests)["activity"]
    ),
    # imports
    "load_dedup": lambda s: load_dedup(s.table("events"), "user_id", "event_id"),
    "hotel_bookings": lambda s: load_hotel_table(_booking_sheet(s), "bookings"),
    "hotel_takings": lambda s: load_hotel_table(_takings_sheet(s), "restaurant_revenue"),
}


def _query(build: Callable[[Shop], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        result = shown(build(Shop(tuned(spark), directory)))
        tuned(spark, SHUFFLED_PER_READ * input_bytes(result))
        return result

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _query(build) for name, build in _VIEWS.items()
}
