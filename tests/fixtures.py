"""Small tables with known results.

People's names are invented; phone numbers are left out."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from shopmetrics.sources.readers import seed_frame
from shopmetrics.sources.schemas import RETAIL, SUPERMARKET

# Name, town.
BRANCHES = [
    ("Accra Central", "Accra"),
    ("Kumasi Main", "Kumasi"),
    ("Takoradi Branch", "Takoradi"),
]

# Name, category, price, reorder level.
PRODUCTS = [
    ("Rice 5kg", "Grains", 45.00, 20),
    ("Cooking Oil 1L", "Oils", 28.00, 15),
    ("Sugar 1kg", "Baking", 12.00, 25),
    ("Milk 500ml", "Dairy", 8.50, 30),
    ("Bread", "Bakery", 6.00, 20),
    ("Eggs 30pcs", "Dairy", 35.00, 15),
    ("Tomato Paste 400g", "Canned Goods", 9.00, 20),
    ("Sardines 155g", "Canned Goods", 7.50, 25),
    ("Milo 400g", "Beverages", 32.00, 15),
    ("Water 1.5L", "Beverages", 4.00, 50),
    ("Detergent 1kg", "Household", 22.00, 20),
    ("Toilet Roll 6pcs", "Household", 18.00, 25),
    ("Chicken 1kg", "Meat", 55.00, 10),
    ("Tuna Can 170g", "Canned Goods", 11.00, 20),
    ("Noodles 70g", "Grains", 3.50, 40),
]

# Product, branch, quantity, expiry date.
INVENTORY = [
    (1, 1, 50, "2027-01-01"),
    (2, 1, 30, "2026-12-01"),
    (3, 1, 45, "2027-03-01"),
    (4, 1, 8, "2026-07-15"),
    (5, 1, 25, "2026-06-20"),
    (6, 1, 18, "2026-07-01"),
    (7, 1, 12, "2026-12-01"),
    (8, 1, 5, "2026-11-01"),
    (9, 1, 22, "2027-01-01"),
    (10, 1, 60, "2026-09-01"),
    (11, 1, 15, "2027-06-01"),
    (12, 1, 20, "2027-04-01"),
    (13, 1, 8, "2026-06-25"),
    (14, 1, 10, "2026-10-01"),
    (15, 1, 35, "2026-08-01"),
    (1, 2, 40, "2027-01-01"),
    (2, 2, 12, "2026-12-01"),
    (3, 2, 30, "2027-03-01"),
    (4, 2, 25, "2026-07-15"),
    (5, 2, 10, "2026-06-22"),
    (6, 2, 20, "2026-07-01"),
    (7, 2, 8, "2026-12-01"),
    (8, 2, 40, "2026-11-01"),
    (9, 2, 18, "2027-01-01"),
    (10, 2, 75, "2026-09-01"),
    (11, 2, 6, "2027-06-01"),
    (12, 2, 30, "2027-04-01"),
    (13, 2, 15, "2026-06-25"),
    (14, 2, 22, "2026-10-01"),
    (15, 2, 28, "2026-08-01"),
    (1, 3, 35, "2027-01-01"),
    (2, 3, 20, "2026-12-01"),
    (3, 3, 18, "2027-03-01"),
    (4, 3, 40, "2026-07-15"),
    (5, 3, 15, "2026-06-21"),
    (6, 3, 12, "2026-07-01"),
    (7, 3, 25, "2026-12-01"),
    (8, 3, 18, "2026-11-01"),
    (9, 3, 30, "2027-01-01"),
    (10, 3, 90, "2026-09-01"),
    (11, 3, 10, "2027-06-01"),
    (12, 3, 15, "2027-04-01"),
    (13, 3, 20, "2026-06-25"),
    (14, 3, 8, "2026-10-01"),
    (15, 3, 22, "2026-08-01"),
]

# Customer, cashier, branch, date, time.
SALES = [
    (1, 1, 1, "2026-06-01", "08:30:00"),
    (2, 1, 1, "2026-06-01", "09:15:00"),
    (3, 3, 2, "2026-06-01", "10:00:00"),
    (4, 2, 1, "2026-06-01", "11:30:00"),
    (5, 4, 2, "2026-06-01", "13:00:00"),
    (6, 5, 3, "2026-06-01", "14:30:00"),
    (7, 2, 1, "2026-06-02", "09:00:00"),
    (8, 3, 2, "2026-06-02", "10:30:00"),
    (9, 6, 3, "2026-06-02", "12:00:00"),
    (10, 1, 1, "2026-06-02", "15:00:00"),
    (1, 4, 2, "2026-06-03", "08:45:00"),
    (2, 5, 3, "2026-06-03", "10:15:00"),
    (3, 1, 1, "2026-06-03", "11:00:00"),
    (4, 6, 3, "2026-06-03", "13:30:00"),
    (5, 2, 1, "2026-06-04", "09:30:00"),
    (6, 3, 2, "2026-06-04", "11:00:00"),
    (7, 5, 3, "2026-06-04", "14:00:00"),
    (8, 1, 1, "2026-06-05", "08:00:00"),
    (9, 4, 2, "2026-06-05", "10:00:00"),
    (10, 6, 3, "2026-06-05", "12:30:00"),
    (1, 2, 1, "2026-06-06", "09:00:00"),
    (2, 3, 2, "2026-06-06", "11:30:00"),
    (3, 5, 3, "2026-06-06", "13:00:00"),
    (4, 1, 1, "2026-06-07", "10:00:00"),
    (5, 6, 3, "2026-06-07", "14:00:00"),
    (6, 4, 2, "2026-06-08", "09:15:00"),
    (7, 1, 1, "2026-06-08", "11:00:00"),
    (8, 3, 2, "2026-06-08", "13:30:00"),
    (9, 5, 3, "2026-06-09", "08:30:00"),
    (10, 2, 1, "2026-06-09", "10:45:00"),
]

# Sale, product, quantity, unit price.
SALE_ITEMS = [
    (1, 1, 2, 45.00),
    (1, 3, 1, 12.00),
    (1, 10, 3, 4.00),
    (2, 2, 1, 28.00),
    (2, 5, 2, 6.00),
    (2, 9, 1, 32.00),
    (3, 4, 2, 8.50),
    (3, 6, 1, 35.00),
    (3, 15, 3, 3.50),
    (4, 7, 2, 9.00),
    (4, 8, 1, 7.50),
    (4, 11, 1, 22.00),
    (5, 1, 1, 45.00),
    (5, 13, 2, 55.00),
    (5, 10, 2, 4.00),
    (6, 2, 2, 28.00),
    (6, 3, 1, 12.00),
    (6, 12, 1, 18.00),
    (7, 5, 3, 6.00),
    (7, 9, 1, 32.00),
    (7, 14, 2, 11.00),
    (8, 1, 1, 45.00),
    (8, 4, 2, 8.50),
    (8, 6, 1, 35.00),
    (9, 2, 1, 28.00),
    (9, 7, 2, 9.00),
    (9, 10, 4, 4.00),
    (10, 3, 2, 12.00),
    (10, 8, 1, 7.50),
    (10, 15, 5, 3.50),
    (11, 1, 3, 45.00),
    (11, 2, 1, 28.00),
    (11, 5, 2, 6.00),
    (12, 4, 1, 8.50),
    (12, 9, 2, 32.00),
    (12, 13, 1, 55.00),
    (13, 6, 2, 35.00),
    (13, 11, 1, 22.00),
    (13, 14, 3, 11.00),
    (14, 7, 1, 9.00),
    (14, 8, 2, 7.50),
    (14, 10, 3, 4.00),
    (15, 1, 2, 45.00),
    (15, 3, 1, 12.00),
    (15, 12, 2, 18.00),
    (16, 2, 1, 28.00),
    (16, 5, 3, 6.00),
    (16, 9, 1, 32.00),
    (17, 4, 2, 8.50),
    (17, 6, 1, 35.00),
    (17, 15, 4, 3.50),
    (18, 7, 1, 9.00),
    (18, 8, 2, 7.50),
    (18, 11, 1, 22.00),
    (19, 1, 1, 45.00),
    (19, 13, 1, 55.00),
    (19, 10, 2, 4.00),
    (20, 2, 2, 28.00),
    (20, 3, 1, 12.00),
    (20, 14, 2, 11.00),
    (21, 5, 2, 6.00),
    (21, 9, 1, 32.00),
    (21, 12, 1, 18.00),
    (22, 1, 3, 45.00),
    (22, 4, 1, 8.50),
    (22, 6, 2, 35.00),
    (23, 2, 1, 28.00),
    (23, 7, 2, 9.00),
    (23, 10, 5, 4.00),
    (24, 3, 1, 12.00),
    (24, 8, 1, 7.50),
    (24, 15, 3, 3.50),
    (25, 1, 2, 45.00),
    (25, 5, 1, 6.00),
    (25, 11, 1, 22.00),
    (26, 2, 2, 28.00),
    (26, 9, 1, 32.00),
    (26, 13, 1, 55.00),
    (27, 4, 1, 8.50),
    (27, 6, 2, 35.00),
    (27, 14, 2, 11.00),
    (28, 7, 1, 9.00),
    (28, 8, 3, 7.50),
    (28, 10, 4, 4.00),
    (29, 1, 1, 45.00),
    (29, 3, 2, 12.00),
    (29, 12, 1, 18.00),
    (30, 2, 1, 28.00),
    (30, 5, 2, 6.00),
    (30, 9, 1, 32.00),
]

# Name, category, selling price, cost price, reorder level.
SHOP_PRODUCTS = [
    ("Rice 5kg", "Grains", 45.00, 32.00, 20),
    ("Cooking Oil 1L", "Oils", 28.00, 19.00, 15),
    ("Sugar 1kg", "Baking", 12.00, 8.00, 25),
    ("Milk 500ml", "Dairy", 8.50, 5.50, 30),
    ("Bread", "Bakery", 6.00, 3.50, 20),
    ("Eggs 30pcs", "Dairy", 35.00, 24.00, 15),
    ("Milo 400g", "Beverages", 32.00, 22.00, 15),
    ("Water 1.5L", "Beverages", 4.00, 1.50, 50),
    ("Detergent 1kg", "Household", 22.00, 14.00, 20),
    ("Noodles 70g", "Grains", 3.50, 1.80, 40),
]

# Product, quantity.
SHOP_INVENTORY = [
    (1, 50),
    (2, 30),
    (3, 45),
    (4, 25),
    (5, 40),
    (6, 20),
    (7, 35),
    (8, 100),
    (9, 28),
    (10, 60),
]

CASHIERS = [(f"Cashier {n}", branch) for n, branch in [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3)]]
CUSTOMERS = [f"Customer {n}" for n in range(1, 11)]


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def _numbered(rows):
    return [(n, *row) for n, row in enumerate(rows, start=1)]


def supermarket(spark) -> dict:
    day = dt.date.fromisoformat
    rows = {
        "branches": _numbered(BRANCHES),
        "cashiers": _numbered(CASHIERS),
        "customers": [(n, name, None, None) for n, name in enumerate(CUSTOMERS, start=1)],
        "products": [(n, name, cat, money(p), level) for n, name, cat, p, level in _numbered(PRODUCTS)],
        "inventory": [(n, p, b, q, day(d)) for n, p, b, q, d in _numbered(INVENTORY)],
        "sales": [(n, c, ca, b, day(d), t) for n, c, ca, b, d, t in _numbered(SALES)],
        "sale_items": [(n, s, p, q, money(u)) for n, s, p, q, u in _numbered(SALE_ITEMS)],
    }
    return {name: seed_frame(spark, r, SUPERMARKET[name]) for name, r in rows.items()}


OPENED = dt.datetime(2026, 6, 1, 8, 0)


def retail(spark, **rows) -> dict:
    """The single-shop tables; keyword arguments replace the rows of a table."""
    tables = {
        "users": [
            (1, "Manager One", "m1", "manager", OPENED, True),
            (2, "Cashier One", "c1", "cashier", OPENED, True),
            (3, "Cashier Two", "c2", "cashier", OPENED, True),
        ],
        "products": [
            (n, None, name, cat, money(s), money(c), level, True, OPENED)
            for n, name, cat, s, c, level in _numbered(SHOP_PRODUCTS)
        ],
        "inventory": [(n, p, q, OPENED) for n, p, q in _numbered(SHOP_INVENTORY)],
        "sales": [], "sale_items": [], "stock_movements": [], "activity_log": [], "expenses": [],
        "till_reconciliations": [], "returns": [],
        **rows,
    }
    return {name: seed_frame(spark, r, RETAIL[name]) for name, r in tables.items()}
