"""Batch ledger jobs.

Each job takes a batch of requests and the current tables, and returns the next state of the
tables it changes plus the log rows it causes. Nothing is written and nothing is updated in
place: the caller stores the result. Ids, times and the order of requests (``seq``, unique
within a batch) come with the requests.

Tables with one row per key meet requests only after these are reduced to one row per key by a
plain aggregate, so a product or sale named by a third of all requests costs one row per task.

Jobs whose outputs share costly rows take ``stage``, a function that stores a frame and reads it
back (``sources.sinks.staged``). Without it nothing runs until an output is used, and each output
works the shared rows out for itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.money import (
    as_money, discount_amount, discounted_total, refund_amount,
)
from shopmetrics.functions.dates import time_of_day
from shopmetrics.functions.predicates import filled, not_voided, positive
from shopmetrics.operators.activity import (
    DETAILS, NO_REASON, RETURN_REASON, SALE_REASON, log_rows, worded,
)
from shopmetrics.operators.rollup import cart_totals, joined_in_splits, merge_cart_lines

Stage = Callable[[DataFrame], DataFrame]


def lazily(df: DataFrame) -> DataFrame:
    return df


# Movement types a person may record, of which only the first adds stock.
STOCK_IN = "stock_in"
RECORDABLE_MOVEMENTS = (STOCK_IN, "adjustment", "damaged")

# Why a request is refused.
INCOMPLETE, NAME_TAKEN, NAME_ASKED, UNKNOWN = "incomplete", "name in use", "name asked for before", "unknown product"

# Stock adjustments of a product edit.
ADD, REMOVE, SET_EXACT = "Add Stock", "Remove Stock", "Set Exact Quantity"


def _last(value: str, seq: str = "seq") -> Column:
    """Last value that is there, by request order."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq))).alias(value)


def with_stock_changes(inventory: DataFrame, changes: DataFrame) -> DataFrame:
    """Inventory after signed ``changes`` (``product_id, delta, changed_at``). Stock may go below zero.

    A change to a product without an inventory row has no effect.
    """
    per_product = changes.groupBy("product_id").agg(
        F.sum("delta").alias("_delta"), F.max("changed_at").alias("_at")
    )
    quantity = inventory.schema["quantity"].dataType
    columns = {
        "quantity": (F.col("quantity") + F.coalesce("_delta", F.lit(0))).cast(quantity),
        "last_updated": F.coalesce("_at", "last_updated"),
    }
    joined = inventory.join(per_product, "product_id", "left")
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in inventory.columns])


def post_sales(
    carts: DataFrame, lines: DataFrame, inventory: DataFrame, currency: str = "GHS", stage: Stage = lazily
) -> dict[str, DataFrame]:
    """W1. Turn carts into sales.

    ``carts``: ``cart_id, cashier_id, payment_method, discount_type, discount_value, sold_at``.
    ``lines``: as for ``merge_cart_lines``; lines of less than one unit are not sold and come back as
    ``rejected_lines``. The cart id becomes the sale id. A cart without lines is not a sale; lines
    without a cart are not sold. A discount below zero is none.
    """
    buyer = carts.select("cart_id", "cashier_id", "sold_at")
    wanted = F.coalesce(F.col("quantity") >= 1, F.lit(False))
    merged = stage(merge_cart_lines(lines.filter(wanted)))
    sold = merged.join(buyer, "cart_id")
    priced = carts.join(cart_totals(merged), "cart_id").withColumn(
        "discount_amount", discount_amount("subtotal", "discount_type", "discount_value")
    )
    sales = priced.select(
        F.col("cart_id").alias("sale_id"),
        "cashier_id",
        F.to_date("sold_at").alias("sale_date"),
        time_of_day("sold_at").alias("sale_time"),
        "payment_method",
        discounted_total("subtotal", "discount_amount").alias("total_amount"),
        "discount_amount",
        F.lit(False).alias("is_voided"),
        F.col("cashier_id").alias("_by"),
        F.col("sold_at").alias("_at"),
    )
    return {
        "sales": sales.drop("_by", "_at"),
        "sale_items": sold.select(
            F.col("cart_id").alias("sale_id"), "product_id", "quantity", "unit_price", "subtotal"
        ),
        "stock_movements": sold.select(
            "product_id",
            F.lit("sale").alias("movement_type"),
            "quantity",
            worded(SALE_REASON, "cart_id").alias("reason"),
            F.col("cashier_id").alias("recorded_by"),
            F.col("sold_at").alias("movement_date"),
        ),
        "inventory": with_stock_changes(
            inventory,
            sold.select("product_id", (-F.col("quantity")).alias("delta"), F.col("sold_at").alias("changed_at")),
        ),
        "activity": log_rows(sales, "SALE", "_by", "_at", "sale_id", F.lit(currency), "total_amount"),
        "rejected_lines": lines.filter(~wanted),
    }


def apply_movements(
    inventory: DataFrame, movements: DataFrame, products: DataFrame
) -> dict[str, DataFrame]:
    """W2. Record stock movements: ``stock_in`` adds, ``adjustment`` and ``damaged`` take away.

    ``movements``: ``product_id, movement_type, quantity, reason, recorded_by, movement_date``.
    Other movement types come from sales and returns and are not accepted here, nor are
    quantities below one, nor products that are unknown, inactive or without a stock row.
    ``rejected`` holds the movements that were not accepted.
    """
    sold = products.filter("is_active").select("product_id").distinct()
    stocked = sold.join(inventory.select("product_id").distinct(), "product_id").withColumn("_stocked", F.lit(True))
    right = F.col("movement_type").isin(*RECORDABLE_MOVEMENTS) & (F.col("quantity") >= 1)
    judged = joined_in_splits(movements, stocked, ["product_id"], "left").withColumn(
        "_right", F.coalesce(right & F.col("_stocked"), F.lit(False))
    )
    accepted = judged.filter("_right").select(*movements.columns)
    signed = F.when(F.col("movement_type") == STOCK_IN, F.col("quantity")).otherwise(-F.col("quantity"))
    changes = accepted.select("product_id", signed.alias("delta"), F.col("movement_date").alias("changed_at"))
    named = accepted.join(products.select("product_id", "product_name"), "product_id")
    return {
        "inventory": with_stock_changes(inventory, changes),
        "stock_movements": accepted,
        "rejected": judged.filter("NOT _right").select(*movements.columns),
        "activity": log_rows(
            named, "STOCK MOVEMENT", "recorded_by", "movement_date", "movement_type", "quantity", "product_name"
        ),
    }


def receive_stock(inventory: DataFrame, deliveries: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """W2 for deliveries alone: ``product_id, quantity, reason, recorded_by, movement_date``."""
    moved = deliveries.withColumn("movement_type", F.lit(STOCK_IN))
    result = apply_movements(inventory, moved, products)
    named = result["stock_movements"].join(products.select("product_id", "product_name"), "product_id")
    activity = log_rows(named, "STOCK IN", "recorded_by", "movement_date", "quantity", "product_name")
    return {**result, "activity": activity}


def void_sales(sales: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """W3. Flag sales as voided, with who and why. Stock stays as it is and no movement is written.

    ``requests``: ``seq, sale_id, requested_by, reason, requested_at``. A request needs a reason;
    the last one per sale wins. A sale that is voided already keeps its first void.
    """
    last = (
        requests.filter(filled("reason"))
        .groupBy("sale_id")
        .agg(F.max_by(F.struct("requested_by", "reason", "requested_at"), "seq").alias("_void"))
    )
    hit = F.coalesce(F.col("_void").isNotNull() & not_voided(), F.lit(False))
    changed = {
        "is_voided": F.col("is_voided") | hit,
        "voided_by": F.when(hit, F.col("_void.requested_by")).otherwise(F.col("voided_by")),
        "void_reason": F.when(hit, F.col("_void.reason")).otherwise(F.col("void_reason")),
    }
    joined = sales.join(last, "sale_id", "left")
    applied = (
        sales.filter(not_voided()).select("sale_id").join(last, "sale_id").select("sale_id", "_void.*")
    )
    return {
        "sales": joined.select(*[changed.get(c, F.col(c)).alias(c) for c in sales.columns]),
        "activity": log_rows(applied, "VOID", "requested_by", "requested_at", "sale_id", "reason"),
    }


def process_returns(
    requests: DataFrame, items: DataFrame, inventory: DataFrame, products: DataFrame, currency: str = "GHS",
    stage: Stage = lazily,
) -> dict[str, DataFrame]:
    """W4. Take goods back: a refund row, the stock, and a ``return`` movement. The sale is not changed.

    ``requests``: ``sale_id, product_id, quantity, reason, processed_by, returned_at``, and ``sale_item_id`` where they
    name a line of the sale. A request needs a reason and a quantity from one to what the line sold or, without a line,
    all the sale's lines of that product. Goods of a product that was sold at several prices come back from the cheapest
    on. Earlier returns are not counted. ``rejected`` holds the requests that were refused.
    """
    by_line = "sale_item_id" in requests.columns
    # A line stands for itself and, with the others, for its product; prices are few, whatever the number of lines.
    line = F.explode(F.array(F.lit(None).cast("long"), F.col("sale_item_id").cast("long"))) if by_line else F.lit(None).cast("long")
    keyed = items.withColumn("_line", line).withColumn("_whole", F.col("_line").isNull()).fillna({"_line": 0})
    key = ["sale_id", "product_id", "_line", "_whole"]
    sold = (
        keyed.groupBy(*key, "unit_price").agg(F.sum("quantity").alias("_n"))
        .groupBy(*key).agg(F.sum("_n").alias("_sold"), F.array_sort(F.collect_list(F.struct("unit_price", "_n"))).alias("_prices"))
    )
    asked = F.col("sale_item_id").cast("long") if by_line else F.lit(None).cast("long")
    asking = requests.withColumn("_line", asked).withColumn("_whole", F.col("_line").isNull()).fillna({"_line": 0})
    zero = F.struct(F.col("quantity").cast("long").alias("left"), as_money(F.lit(0)).alias("paid"))
    refund = F.aggregate(
        "_prices", zero,
        lambda done, price: F.struct(
            (done["left"] - F.least(done["left"], price["_n"])).alias("left"),
            as_money(done["paid"] + refund_amount(F.least(done["left"], price["_n"]), price["unit_price"])).alias("paid"),
        ),
        lambda done: done["paid"],
    )
    right = filled("reason") & (F.col("quantity") >= 1) & (F.col("quantity") <= F.col("_sold"))
    judged = stage(
        joined_in_splits(asking, sold, key, "left")
        .withColumn("_right", F.coalesce(right, F.lit(False)))
        .withColumn("refund_amount", F.when(F.col("_right"), refund))
        .drop("_prices", "_line", "_whole")
    )
    accepted = judged.filter("_right")
    named = accepted.join(products.select("product_id", "product_name"), "product_id")
    return {
        "returns": accepted.select(
            "sale_id", "product_id", "quantity", "refund_amount", "reason", "processed_by",
            F.col("returned_at").alias("return_date"),
        ),
        "inventory": with_stock_changes(
            inventory,
            accepted.select("product_id", F.col("quantity").alias("delta"), F.col("returned_at").alias("changed_at")),
        ),
        "stock_movements": accepted.select(
            "product_id",
            F.lit("return").alias("movement_type"),
            "quantity",
            worded(RETURN_REASON, "sale_id", "reason").alias("reason"),
            F.col("processed_by").alias("recorded_by"),
            F.col("returned_at").alias("movement_date"),
        ),
        "activity": log_rows(
            named, "RETURN", "processed_by", "returned_at",
            "sale_id", "product_name", "quantity", F.lit(currency), "refund_amount",
        ),
        "rejected": judged.filter("NOT _right").select(*requests.columns),
    }


def add_products(products: DataFrame, inventory: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """W5. Add products whose name is not in use, compared without regard to case.

    ``new``: ``seq, product_id, barcode, product_name, category, cost_price, selling_price,
    reorder_level, opening_stock, added_by, added_at``. Name and both prices are required; of two
    requests for one name the first wins. Opening stock writes an inventory row and no movement.
    ``rejected`` holds the other requests, with why in ``refused``.
    """
    complete = new.filter(filled("product_name") & positive("cost_price") & positive("selling_price"))
    rest = [c for c in new.columns if c != "seq"]
    first = (
        complete.groupBy(F.lower("product_name").alias("_name"))
        .agg(F.min_by(F.struct(*rest), "seq").alias("_first"))
        .join(products.select(F.lower("product_name").alias("_name")).distinct(), "_name", "left_anti")
    )
    added = first.select("_first.*").withColumns(
        {"barcode": F.nullif(F.col("barcode"), F.lit("")), "is_active": F.lit(True), "created_at": F.col("added_at")}
    )
    stocked = added.select(
        "product_id", F.col("opening_stock").alias("quantity"), F.col("added_at").alias("last_updated")
    )
    right = filled("product_name") & positive("cost_price") & positive("selling_price")
    judged = new.withColumns({"_right": F.coalesce(right, F.lit(False)), "_name": F.lower("product_name")})
    taken = products.select(F.lower("product_name").alias("_name")).distinct().withColumn("_taken", F.lit(True))
    winners = complete.groupBy(F.lower("product_name").alias("_name")).agg(F.min("seq").alias("_winner"))
    judged = joined_in_splits(joined_in_splits(judged, taken, ["_name"], "left"), winners, ["_name"], "left")
    refused = (
        F.when(~F.col("_right"), INCOMPLETE).when(F.col("_taken"), NAME_TAKEN).when(F.col("seq") > F.col("_winner"), NAME_ASKED)
    )
    return {
        "rejected": judged.withColumn("refused", refused).filter(F.col("refused").isNotNull()).select(*new.columns, "refused"),
        "products": products.unionByName(added.select(*products.columns)),
        "inventory": inventory.unionByName(
            stocked.select(*[c for c in inventory.columns if c in stocked.columns]), allowMissingColumns=True
        ),
        "activity": log_rows(added, "ADD PRODUCT", "added_by", "added_at", "product_name"),
    }


# Bits of the request number that one level of the fold covers: 4096 steps at most in one group. The levels
# cover 60 bits, so at most 16 chunks of a product are left for any 64-bit number.
_CHUNK_BITS = 12
_LEVELS = 5


def _composed(steps: Column) -> Column:
    """One step with the effect of many, applied in order."""
    nothing = F.lit(None).cast("struct<floor:bigint,shift:bigint>")
    return F.aggregate(
        F.array_sort(steps),
        nothing,
        lambda done, step: F.when(done.isNull(), F.struct(step["floor"], step["shift"])).otherwise(
            F.struct(
                F.greatest(step["floor"], done["floor"] + step["shift"]).alias("floor"),
                (done["shift"] + step["shift"]).alias("shift"),
            )
        ),
    )


def _adjusts() -> Column:
    return positive("adjust_qty") & F.col("adjustment").isin(ADD, REMOVE, SET_EXACT)


def folded_adjustments(edits: DataFrame) -> DataFrame:
    """Net effect of a batch of ordered stock adjustments, one row per product.

    Every adjustment maps a quantity q to ``greatest(floor, q + shift)``: Add shifts up, Remove
    shifts down with floor zero, Set Exact has the wanted quantity as floor and forgets q (a NULL
    shift; ``greatest`` passes over it). Such maps compose into maps of the same form, so a
    product's edits fold in chunks of consecutive request numbers, then chunks of chunks: no task
    ever holds more than one chunk, even when one product takes most of the batch.

    Gives ``product_id, floor, shift``; the new quantity is ``greatest(floor, quantity + shift)``.
    """
    kind, qty = F.col("adjustment"), F.col("adjust_qty").cast("bigint")
    floor = F.when(kind == REMOVE, F.lit(0).cast("bigint")).when(kind == SET_EXACT, qty)
    shift = F.when(kind == ADD, qty).when(kind == REMOVE, -qty)
    steps = edits.filter(_adjusts()).select(
        "product_id", F.col("seq").cast("bigint").alias("at"), floor.alias("floor"), shift.alias("shift")
    )
    every = F.collect_list(F.struct("at", "floor", "shift"))
    for _ in range(_LEVELS):
        chunk = F.shiftright("at", _CHUNK_BITS).alias("chunk")
        steps = (
            steps.groupBy("product_id", chunk)
            .agg(_composed(every).alias("step"))
            .select("product_id", F.col("chunk").alias("at"), "step.floor", "step.shift")
        )
    return steps.groupBy("product_id").agg(_composed(every).alias("step")).select("product_id", "step.*")


def edit_products(products: DataFrame, inventory: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """W6. Change prices, reorder level, status and stock; no movement is written.

    ``edits``: ``seq, product_id, cost_price, selling_price, reorder_level, is_active, adjustment,
    adjust_qty, reason, edited_by, edited_at``. A NULL field keeps what is there; for each field the
    last edit wins. Stock adjustments above zero apply in order, Remove stopping at zero.
    """
    fields = ["cost_price", "selling_price", "reorder_level", "is_active"]
    last = edits.groupBy("product_id").agg(*[_last(f) for f in fields])
    renamed = last.select("product_id", *[F.col(f).alias(f"_{f}") for f in fields])
    changed = {
        f: F.coalesce(F.col(f"_{f}").cast(products.schema[f].dataType), F.col(f)) for f in fields
    }
    stock = inventory.join(folded_adjustments(edits), "product_id", "left")
    quantity = F.coalesce(
        F.greatest(F.col("floor"), F.col("quantity") + F.col("shift")), F.col("quantity")
    ).cast(inventory.schema["quantity"].dataType)

    named = edits.join(products.select("product_id", "product_name"), "product_id")
    reason = F.when(filled("reason"), F.col("reason")).otherwise(NO_REASON)
    adjusted = log_rows(
        named.filter(_adjusts()), "STOCK ADJUSTMENT", "edited_by", "edited_at",
        "product_name", "adjustment", "adjust_qty", reason,
    )
    edited = log_rows(named, "EDIT PRODUCT", "edited_by", "edited_at", "product_name")
    return {
        "products": products.join(renamed, "product_id", "left").select(
            *[changed.get(c, F.col(c)).alias(c) for c in products.columns]
        ),
        "inventory": stock.select(
            *[quantity.alias(c) if c == "quantity" else F.col(c) for c in inventory.columns]
        ),
        "activity": adjusted.unionByName(edited),
    }


def set_active(products: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """W7. Deactivate or reactivate products; the last request per product wins.

    ``requests``: ``seq, product_id, is_active, requested_by, requested_at``. A request without a
    flag changes nothing and is not logged; one that sets what is set already is. ``rejected`` holds those without a flag
    or for an unknown product, with why in ``refused``.
    """
    known = products.select("product_id").distinct().withColumn("_known", F.lit(True))
    refused = F.when(F.col("is_active").isNull(), INCOMPLETE).when(F.col("_known").isNull(), UNKNOWN)
    judged = joined_in_splits(requests, known, ["product_id"], "left").withColumn("refused", refused)
    rejected = judged.filter(F.col("refused").isNotNull()).select(*requests.columns, "refused")
    requests = requests.filter(F.col("is_active").isNotNull())
    last = requests.groupBy("product_id").agg(_last("is_active")).withColumnRenamed("is_active", "_active")
    named = requests.join(products.select("product_id", "product_name"), "product_id")
    on, off = "REACTIVATE PRODUCT", "DEACTIVATE PRODUCT"
    activity = named.select(
        F.col("requested_by").alias("user_id"),
        F.when(F.col("is_active"), on).otherwise(off).alias("action"),
        F.when(F.col("is_active"), worded(DETAILS[on], "product_name"))
        .otherwise(worded(DETAILS[off], "product_name"))
        .alias("details"),
        F.col("requested_at").alias("logged_at"),
    )
    return {
        "products": products.join(last, "product_id", "left").select(
            *[
                F.coalesce("_active", "is_active").alias(c) if c == "is_active" else F.col(c)
                for c in products.columns
            ]
        ),
        "activity": activity,
        "rejected": rejected,
    }


def upsert_staff(users: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """W8. Add staff, or change the sign-in code and status of staff who are there, as if one request came after
    the other.

    ``requests``: ``seq, user_id, full_name, code, role, is_active, requested_by, requested_at``.
    The first request for an unknown user with both a name and a code adds that user, active; earlier
    ones without are refused. Any request for a user who is there by then is a change: a blank code
    keeps the old one, no status keeps the status, and name and role stay. Every add and change is logged.
    ``rejected`` holds the refused ones, with why in ``refused``.
    """
    given = requests.withColumn("code", F.when(filled("code"), F.col("code"))).withColumn(
        "full_name", F.when(filled("full_name"), F.col("full_name"))
    )
    add = F.struct("full_name", "code", "role", "seq", "requested_by", "requested_at")
    added = (
        given.filter(F.col("full_name").isNotNull() & F.col("code").isNotNull())
        .groupBy("user_id")
        .agg(F.min_by(add, "seq").alias("_add"))
        .join(users.select("user_id"), "user_id", "left_anti")
        .select("user_id", "_add.*")
    )
    people = users.select("user_id", F.col("full_name").alias("_name"), F.lit(None).cast("bigint").alias("_since"))
    people = people.union(added.select("user_id", "full_name", F.col("seq").cast("bigint")))
    changes = joined_in_splits(given, people, ["user_id"]).filter(F.col("_since").isNull() | (F.col("seq") > F.col("_since")))
    judged = joined_in_splits(requests, people.withColumn("_there", F.lit(True)), ["user_id"], "left")
    rejected = judged.filter(F.col("_there").isNull() | (F.col("seq") < F.col("_since"))).select(*requests.columns)
    last = changes.groupBy("user_id").agg(_last("code").alias("_code"), _last("is_active").alias("_active"))
    new = added.withColumns({"is_active": F.lit(True), "created_at": F.col("requested_at")})
    after = users.unionByName(
        new.select(*[c for c in users.columns if c in new.columns]), allowMissingColumns=True
    ).join(last, "user_id", "left")
    changed = {"code": F.coalesce("_code", "code"), "is_active": F.coalesce("_active", "is_active")}
    return {
        "users": after.select(*[changed.get(c, F.col(c)).alias(c) for c in users.columns]),
        "activity": log_rows(changes, "UPDATE STAFF", "requested_by", "requested_at", "_name").unionByName(
            log_rows(added, "ADD STAFF", "requested_by", "requested_at", "full_name", "role")
        ),
        "rejected": rejected.withColumn("refused", F.lit(INCOMPLETE)),
    }


def record_expenses(expenses: DataFrame, new: DataFrame, currency: str = "GHS") -> dict[str, DataFrame]:
    """W9. Append expenses whose amount is above zero.

    ``new``: the columns of ``expenses``, and ``recorded_at`` for the log. ``rejected`` holds the others, with why in
    ``refused``.
    """
    accepted = new.filter(positive("amount"))
    return {
        "expenses": expenses.unionByName(accepted.select(*expenses.columns)),
        "activity": log_rows(
            accepted, "EXPENSE", "recorded_by", "recorded_at", "category", F.lit(currency), as_money("amount")
        ),
        "rejected": new.filter(~F.coalesce(positive("amount"), F.lit(False))).withColumn("refused", F.lit(INCOMPLETE)),
    }
