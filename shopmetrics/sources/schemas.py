"""S8. Declared schemas of every table, and the values that coded columns may hold.

Times of day are ``HH:mm:ss`` text. Keys are a contract with the caller; Spark does not enforce them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Codes that may appear in the data.
ROLES = ("cashier", "manager")
PAYMENT_METHODS = ("cash", "momo", "card")
MOVEMENT_TYPES = ("stock_in", "adjustment", "sale", "damaged", "return")
ADJUSTMENTS = ("Add Stock", "Remove Stock", "Set Exact Quantity")
EXPENSE_CATEGORIES = ("Rent", "Electricity", "Water", "Salaries", "Supplies", "Transport", "Other")


INT, TEXT, FLAG = T.IntegerType(), T.StringType(), T.BooleanType()
DAY, TIME, PRICE = T.DateType(), T.TimestampNTZType(), T.DecimalType(10, 2)
# Ids count on for ever; amounts are as wide as the ledger writes them.
ID, AMOUNT = T.LongType(), T.DecimalType(28, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# A chain of supermarkets: stock is held per branch, sale lines carry the price paid.
SUPERMARKET = {
    "branches": _table(branch_id=ID, branch_name=TEXT, location=TEXT),
    "cashiers": _table(cashier_id=ID, cashier_name=TEXT, branch_id=ID),
    "customers": _table(customer_id=ID, customer_name=TEXT, phone=TEXT, city=TEXT),
    "products": _table(
        product_id=ID, product_name=TEXT, category=TEXT, price=PRICE, reorder_level=INT,
    ),
    "inventory": _table(inventory_id=ID, product_id=ID, branch_id=ID, quantity=INT, expiry_date=DAY),
    "sales": _table(
        sale_id=ID, customer_id=ID, cashier_id=ID, branch_id=ID, sale_date=DAY, sale_time=TEXT,
    ),
    "sale_items": _table(item_id=ID, sale_id=ID, product_id=ID, quantity=INT, unit_price=PRICE),
}

# A single shop with a back office. The sign-in code of a user is kept out of every report.
RETAIL = {
    "users": _table(
        user_id=ID, full_name=TEXT, code=TEXT, role=TEXT, created_at=TIME, is_active=FLAG,
    ),
    "products": _table(
        product_id=ID, barcode=TEXT, product_name=TEXT, category=TEXT, selling_price=PRICE,
        cost_price=PRICE, reorder_level=INT, is_active=FLAG, created_at=TIME,
    ),
    "inventory": _table(inventory_id=ID, product_id=ID, quantity=INT, last_updated=TIME),
    "sales": _table(
        sale_id=ID, cashier_id=ID, sale_date=DAY, sale_time=TEXT, payment_method=TEXT,
        total_amount=AMOUNT, discount_amount=AMOUNT, is_voided=FLAG, voided_by=ID, void_reason=TEXT,
    ),
    "sale_items": _table(
        sale_item_id=ID, sale_id=ID, product_id=ID, quantity=INT, unit_price=PRICE, subtotal=AMOUNT,
    ),
    "stock_movements": _table(
        movement_id=ID, product_id=ID, movement_type=TEXT, quantity=INT, reason=TEXT, recorded_by=ID,
        movement_date=TIME,
    ),
    "activity_log": _table(log_id=ID, user_id=ID, action=TEXT, details=TEXT, logged_at=TIME),
    "expenses": _table(
        expense_id=ID, expense_date=DAY, category=TEXT, description=TEXT, amount=PRICE, recorded_by=ID,
    ),
    "till_reconciliations": _table(
        cashier_id=ID, recon_date=DAY, expected_cash=AMOUNT, declared_cash=AMOUNT, difference=AMOUNT,
        notes=TEXT, submitted_by=ID, created_at=TIME,
    ),
    "returns": _table(
        sale_id=ID, product_id=ID, quantity=INT, refund_amount=AMOUNT, reason=TEXT, processed_by=ID,
        return_date=TIME,
    ),
}

# A hotel. ``*_id`` of the two tables without a key in the sheets is supplied by the export.
HOTEL = {
    "rooms": _table(
        room_number=TEXT, room_type=TEXT, floor=INT, capacity=INT, price_per_night=PRICE, status=TEXT,
        amenities=TEXT,
    ),
    "bookings": _table(
        booking_id=TEXT, guest_name=TEXT, nationality=TEXT, room_number=TEXT, room_type=TEXT, check_in=DAY,
        check_out=DAY, nights=INT, price_per_night=PRICE, total_amount=PRICE, booking_source=TEXT,
        payment_method=TEXT, status=TEXT,
    ),
    "restaurant_revenue": _table(date=DAY, meal_type=TEXT, covers=INT, revenue=PRICE),
    "staff": _table(
        staff_id=TEXT, full_name=TEXT, role=TEXT, department=TEXT, salary=PRICE, status=TEXT,
    ),
    "expenses": _table(month=TEXT, category=TEXT, description=TEXT, amount=PRICE),
}

# Small frames.
BUSINESSES = _table(name=TEXT, revenue=PRICE, expenses=PRICE)
SALES_SHEET = _table(product=TEXT, quantity=INT, price=PRICE)
CONTACTS = _table(id=INT, name=TEXT, phone=TEXT, city=TEXT)
RATES = _table(base=TEXT, rates=T.MapType(T.StringType(), T.DoubleType()))

SCHEMAS = {
    **{f"supermarket.{name}": s for name, s in SUPERMARKET.items()},
    **{f"retail.{name}": s for name, s in RETAIL.items()},
    **{f"hotel.{name}": s for name, s in HOTEL.items()},
    "businesses": BUSINESSES,
    "sales_sheet": SALES_SHEET,
    "contacts": CONTACTS,
    "rates": RATES,
}
