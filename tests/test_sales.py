"""The supermarket pack and the sales dashboard."""

import datetime as dt
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

from shopmetrics.plans import packs, sales, stock
from tests.conftest import one, rows
from tests.fixtures import BRANCHES, INVENTORY, PRODUCTS, SALES, SALE_ITEMS, money, retail


@pytest.fixture(scope="module")
def headers(chain):
    return sales.sale_headers(chain["sales"], chain["customers"], chain["cashiers"], chain["branches"])


@pytest.fixture(scope="module")
def detail(chain, headers):
    return sales.master_detail(headers, chain["sale_items"], chain["products"])


def test_table_counts(chain):
    assert dict(rows(sales.table_counts(chain))) == {
        "branches": 3, "cashiers": 6, "customers": 10, "products": 15, "inventory": 45, "sales": 30, "sale_items": 90,
    }


def test_master_detail(detail):
    got = rows(detail)
    assert len(got) == 90 and tuple(detail.columns) == sales.DETAIL_COLUMNS
    assert got[0][:4] == (1, dt.date(2026, 6, 1), "08:30:00", "Customer 1")
    assert [r[1:3] for r in got] == sorted(r[1:3] for r in got)
    assert all(r[-1] == r[8] * r[9] for r in got)


def test_revenue_by_branch_matches_a_plain_loop(chain, detail):
    expected = defaultdict(Decimal)
    for sale, _, quantity, price in SALE_ITEMS:
        expected[BRANCHES[SALES[sale - 1][2] - 1][0]] += quantity * money(price)
    got = sales.revenue_by_branch(chain["sales"], chain["sale_items"], chain["branches"])
    assert {r.branch: r.revenue for r in got.collect()} == dict(expected)
    assert sum(r.txns for r in got.collect()) == 30
    summary = sales.detail_summaries(detail)["branch_revenue"]
    assert dict(rows(summary)) == dict(expected)
    assert [r[1] for r in rows(summary)] == sorted(expected.values(), reverse=True)


def test_units_and_revenue(chain, headers):
    units = dict(rows(sales.units_by_product(headers, chain["sale_items"], chain["products"])))
    expected = Counter()
    for _, product, quantity, _ in SALE_ITEMS:
        expected[PRODUCTS[product - 1][0]] += quantity
    assert units == dict(expected) and units["Bread"] == 15 and units["Chicken 1kg"] == 5
    revenue = dict(rows(sales.revenue_by_category(headers, chain["sale_items"], chain["products"])))
    assert revenue["Bakery"] == money(90) and revenue["Meat"] == money(275)
    assert sum(revenue.values()) == sum(q * money(p) for _, _, q, p in SALE_ITEMS)


def test_transactions_per_cashier_and_hour(chain, headers):
    sold = sales.sold_headers(headers, chain["sale_items"], chain["products"])
    assert dict(rows(sales.tx_by_cashier(sold))) == {
        "Cashier 1": 7, "Cashier 2": 5, "Cashier 3": 5, "Cashier 4": 4, "Cashier 5": 5, "Cashier 6": 4,
    }
    hours = sales.tx_by_hour(sold).collect()
    assert {r.hour: r.txns for r in hours} == {8: 4, 9: 5, 10: 6, 11: 5, 12: 2, 13: 4, 14: 3, 15: 1}
    assert (hours[0].hour, hours[0].label) == (10, "10:00 AM")


def test_walk_in_sales_drop_out_of_the_detail_but_not_of_branch_revenue(spark, chain):
    walk_in = chain["sales"].selectExpr(
        "sale_id", "IF(sale_id = 1, NULL, customer_id) AS customer_id", "cashier_id", "branch_id", "sale_date", "sale_time"
    )
    headers = sales.sale_headers(walk_in, chain["customers"], chain["cashiers"], chain["branches"])
    assert sales.master_detail(headers, chain["sale_items"], chain["products"]).count() == 87
    units = dict(rows(sales.units_by_product(headers, chain["sale_items"], chain["products"])))
    assert sum(units.values()) == sum(q for s, _, q, _ in SALE_ITEMS if s != 1)
    by_branch = sales.revenue_by_branch(walk_in, chain["sale_items"], chain["branches"])
    assert sum(r.txns for r in by_branch.collect()) == 30


def test_reorder_alert(chain):
    got = stock.reorder_alert(chain["inventory"], chain["products"], chain["branches"]).collect()
    assert Counter(r.branch_name for r in got) == {"Accra Central": 8, "Kumasi Main": 6, "Takoradi Branch": 8}
    assert [r.current_stock for r in got] == sorted(q for p, _, q, _ in INVENTORY if q <= PRODUCTS[p - 1][3])


def test_pack_is_written_and_its_summaries_agree(spark, chain, headers, tmp_path):
    reorder = stock.reorder_alert(chain["inventory"], chain["products"], chain["branches"])
    packs.write_sales_pack(headers, chain["sale_items"], chain["products"], reorder, str(tmp_path))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    master = read("master_data")
    assert master.count() == 90 and {len(r.sale_time) for r in master.collect()} == {5}
    total = sum(r.total for r in master.collect())
    assert sum(r.total_revenue for r in read("branch_revenue").collect()) == total
    assert sum(r.total_revenue for r in read("category_revenue").collect()) == total
    assert {r.hour: r.txns for r in read("hourly_traffic").collect()}[10] == 6
    assert sum(r.txns for r in read("cashier_performance").collect()) == 30
    assert read("product_sales").count() == 15 and read("reorder_alert").count() == 22


DAY = dt.date(2026, 6, 10)


def sale(n, cashier, day, method, total, voided=False, time="10:00:00"):
    return (n, cashier, day, time, method, None if total is None else money(total), money(0), voided, None, None)


@pytest.fixture(scope="module")
def back(spark):
    d = dt.timedelta
    return retail(
        spark,
        sales=[
            sale(1, 2, DAY, "cash", 100), sale(2, 3, DAY, "card", 50), sale(3, 2, DAY, "cash", 999, voided=True),
            sale(4, 2, DAY - d(1), "momo", 80), sale(5, 3, DAY - d(2), "cash", 200),
            sale(6, 2, DAY - d(9), "cash", 10), sale(7, 2, DAY - d(40), "cash", 7),
            sale(8, 99, DAY, "cash", 5000),  # no such user
            sale(9, 2, DAY + d(5), "cash", 3), sale(10, 2, DAY, "cash", 1, voided=None),
        ],
        sale_items=[
            (1, 1, 1, 2, money(45), money(90)), (2, 1, 5, 1, money(6), money(6)), (3, 2, 1, 1, money(45), money(45)),
            (4, 3, 2, 9, money(28), money(252)), (5, 5, 2, 1, money(28), money(28)),
        ],
        expenses=[
            (1, DAY, "Rent", "Shop", money(30), 1), (2, DAY - d(40), "Water", "", money(5), 1),
            (3, DAY, None, "", money(2), 1), (4, DAY + d(10), "Rent", "", money(4), 1), (5, DAY, "Rent", "", money(8), 99),
        ],
    )


def kpis(back, period, **kw):
    return one(sales.sales_kpis(sales.counted_sales(back["sales"], period, DAY, **kw), back["users"]))


def test_kpis_per_period(back):
    assert kpis(back, "today") == {"revenue": money(150), "transactions": 2, "avg_transaction": 75.0}
    assert kpis(back, "week")["revenue"] == money(430)
    assert kpis(back, "month")["revenue"] == money(440)
    assert kpis(back, "all") == {"revenue": money(450), "transactions": 7, "avg_transaction": 450 / 7}
    assert kpis(back, "range", start=DAY - dt.timedelta(40), end=DAY - dt.timedelta(9))["transactions"] == 2


def test_nothing_sold_gives_zeros(spark, back):
    got = one(sales.sales_kpis(back["sales"].limit(0), back["users"]))
    assert got == {"revenue": 0, "transactions": 0, "avg_transaction": 0.0}
    home = one(sales.home_metrics(*[back[t].limit(0) for t in ("sales", "expenses", "products", "inventory")], DAY))
    assert set(home.values()) == {0, None} and home["change"] is None


def test_dashboard(back):
    board = sales.sales_dashboard(
        back["sales"], back["users"], back["products"], back["inventory"], "week", DAY
    )
    assert [r.product_name for r in board["low_stock"].collect()] == ["Milk 500ml"]
    assert rows(board["daily"]) == [
        (DAY, money(150), 2), (DAY - dt.timedelta(1), money(80), 1), (DAY - dt.timedelta(2), money(200), 1),
    ]
    assert rows(board["by_cashier"]) == [("Cashier One", money(180)), ("Cashier Two", money(250))]
    assert rows(board["by_payment"]) == [("card", money(50)), ("cash", money(300)), ("momo", money(80))]
    assert [r.sale_id for r in board["transactions"].collect()] == [2, 1, 4, 5]
    total = one(board["kpis"])["revenue"]
    assert total == sum(r[1] for r in rows(board["daily"])) == sum(r[1] for r in rows(board["by_payment"]))


def test_same_named_cashiers_merge(spark, back):
    twins = back["users"].selectExpr("user_id", "'Same' AS full_name")
    counted = sales.counted_sales(back["sales"], "all", DAY)
    assert rows(sales.sales_by_cashier(counted, twins)) == [("Same", money(450))]


def test_unpriced_sales_count_but_do_not_average(spark):
    tables = retail(spark, sales=[sale(1, 2, DAY, "cash", 10), sale(2, 2, DAY, None, None)])
    counted = sales.counted_sales(tables["sales"], "all", DAY)
    assert one(sales.sales_kpis(counted, tables["users"])) == {
        "revenue": money(10), "transactions": 2, "avg_transaction": 10.0,
    }
    assert rows(sales.daily_sales(counted, tables["users"])) == [(DAY, money(10), 1)]
    assert rows(sales.sales_by_payment(counted, tables["users"])) == [("cash", money(10))]


def test_lists(back):
    assert [r.sale_id for r in sales.sales_list(back["sales"], back["users"]).collect()] == [9, 10, 3, 2, 1, 4, 5, 6, 7]
    assert [r.sale_id for r in sales.voidable_sales(back["sales"], back["users"]).collect()] == [9, 2, 1, 4, 5, 6, 7]
    assert [r.sale_id for r in sales.returnable_sales(back["sales"], back["users"], 2).collect()] == [9, 2]
    assert rows(sales.sale_item_list(back["sale_items"], back["products"], 1).select("product_name", "quantity")) == [
        ("Rice 5kg", 2), ("Bread", 1),
    ]


def test_home_metrics(back):
    got = one(sales.home_metrics(back["sales"], back["expenses"], back["products"], back["inventory"], DAY))
    assert got == {
        "today_revenue": money(5150), "today_transactions": 3, "yesterday_revenue": money(80),
        "month_revenue": money(5443), "month_expenses": money(44), "low_stock": 1, "change": money(5070),
    }


def test_top_products_leave_out_voided_sales(back):
    got = rows(sales.top_products(back["sales"], back["sale_items"], back["products"], DAY))
    assert got == [("Rice 5kg", 3), ("Bread", 1)]


def test_home(back):
    page = sales.home(*[back[t] for t in ("sales", "sale_items", "expenses", "products", "inventory")], DAY)
    assert one(page["metrics"])["today_transactions"] == 3
    assert rows(page["top_products"])[0] == ("Rice 5kg", 3) and page["low_stock"].count() == 1


def test_one_pass_gives_the_summaries(chain):
    headers = sales.sale_headers(chain["sales"], chain["customers"], chain["cashiers"], chain["branches"])
    detail = sales.master_detail(headers, chain["sale_items"], chain["products"].drop("price"))
    figures = sales.summary_rows(detail)
    for name, one_by_one in sales.detail_summaries(detail).items():
        got = sales.one_summary(figures, name)
        assert got.columns == one_by_one.columns
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in one_by_one.collect()], name
