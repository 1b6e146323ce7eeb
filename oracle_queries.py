"""The registered queries as plain SQL over the same tables, for a second engine to check results against.

Written from the meaning of each report, not from the DataFrame plans: where the library rounds
half to even or folds ordered edits, the SQL works in whole cents or with running sums.
"""

from __future__ import annotations

AS_OF = "DATE '2001-07-31'"
COUNTS = "NOT is_voided"

# Stock movements as events give them, and those of kinds that people record, on active products.
_MOVEMENT = """event_id AS movement_id, user_id AS product_id, CASE event_type WHEN 'purchase' THEN 'stock_in'
    WHEN 'view' THEN 'sale' WHEN 'click' THEN 'adjustment' WHEN 'error' THEN 'damaged' WHEN 'signup' THEN 'return' END
    AS movement_type, CAST(floor(value) AS INTEGER) AS quantity, props AS reason, user_id AS recorded_by,
    ts AS movement_date"""
_MOVED = """event_type IN ('purchase', 'click', 'error') AND floor(value) >= 1
    AND user_id IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')"""

# The retail tables; each query lists the ones it reads.
TABLES = {
    "users": """SELECT c_custkey AS user_id, c_name AS full_name, 'u' || c_custkey AS code,
        c_mktsegment AS role, c_acctbal >= 0 AS is_active FROM customer""",
    "branches": "SELECT n_nationkey AS branch_id, n_name AS branch_name FROM nation",
    "products": """SELECT p_partkey AS product_id, p_brand AS barcode, p_name AS product_name,
        p_type AS category, CAST(p_retailprice AS DECIMAL(18,2)) AS selling_price,
        CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.7 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS cost_price,
        p_size AS reorder_level, p_type <> 'PROMO' AS is_active FROM part""",
    "inventory": "SELECT p_partkey AS product_id, p_partkey % 60 AS quantity FROM part",
    "sales": """SELECT o_orderkey AS sale_id, o_custkey AS customer_id, o_custkey AS cashier_id,
        CAST(o_orderdate AS DATE) AS sale_date, strftime(o_orderdate, '%H:%M:%S') AS sale_time,
        o_orderpriority AS payment_method, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
        o_orderstatus = 'P' AS is_voided, o_orderdate AS sold_at FROM orders""",
    "items": """SELECT l_orderkey AS sale_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS subtotal, l_linenumber AS line_no FROM lineitem""",
    "expenses": """SELECT event_id AS expense_id, CAST(ts AS DATE) AS expense_date, event_type AS category,
        props AS description, CAST(value AS DECIMAL(18,2)) AS amount, user_id AS recorded_by, ts FROM events""",
    "counted": """SELECT s.*, u.full_name AS cashier FROM sales s JOIN users u ON s.cashier_id = u.user_id
        WHERE NOT s.is_voided""",
    "stock": """SELECT p.*, i.quantity, CASE WHEN i.quantity <= p.reorder_level THEN 'Low Stock' ELSE 'OK' END
        AS status FROM products p JOIN inventory i USING (product_id) WHERE p.is_active""",
    # carts and returns
    "merged": """SELECT sale_id AS cart_id, product_id, CAST(SUM(quantity) AS BIGINT) AS quantity,
        CAST(FIRST(subtotal ORDER BY line_no, subtotal) AS DECIMAL(18,2)) AS unit_price
        FROM items GROUP BY sale_id, product_id""",
    "posted": """SELECT m.*, CAST(m.quantity * m.unit_price AS DECIMAL(18,2)) AS subtotal, s.cashier_id, s.sold_at,
        s.payment_method, s.total_amount AS order_amount FROM merged m JOIN sales s ON m.cart_id = s.sale_id""",
    "cents": """SELECT cart_id, CAST(SUM(subtotal) * 100 AS BIGINT) AS sub, MIN(CAST(order_amount * 100 AS BIGINT))
        AS wanted, MIN(payment_method) AS payment_method, MIN(cashier_id) AS cashier_id, MIN(sold_at) AS sold_at
        FROM posted GROUP BY cart_id""",
    "headers": """SELECT *, CASE payment_method WHEN '1-URGENT' THEN (sub + 5) // 10
        WHEN '2-HIGH' THEN LEAST(wanted, sub) ELSE 0 END AS off FROM cents""",
    "accepted": """SELECT m.cart_id AS sale_id, m.product_id, CAST(l.l_quantity AS INTEGER) AS quantity,
        CAST(l.l_quantity AS INTEGER) * m.unit_price AS refund,
        CASE l.l_returnflag WHEN 'R' THEN 'Damaged' ELSE 'Wrong item' END AS reason,
        l.l_suppkey AS processed_by, l.l_shipdate AS returned_at
        FROM lineitem l JOIN merged m ON l.l_orderkey = m.cart_id AND l.l_partkey = m.product_id
        WHERE l.l_returnflag IN ('R', 'A') AND l.l_quantity >= 1 AND l.l_quantity <= m.quantity""",
    # returns of lines and of products: goods come back from the cheapest price on
    "by_line": """SELECT l_orderkey AS sale_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
        CASE l_returnflag WHEN 'R' THEN 'Damaged' WHEN 'A' THEN 'Wrong item' WHEN 'N' THEN '' END AS reason,
        l_suppkey AS processed_by, l_shipdate AS returned_at,
        CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity AS INTEGER) % 7 + 1 END AS sale_item_id,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS request FROM lineitem""",
    "units_back": """SELECT r.request, l.subtotal AS price, SUM(l.quantity) AS n FROM by_line r JOIN items l
        ON r.sale_id = l.sale_id AND r.product_id = l.product_id
        AND (r.sale_item_id IS NULL OR r.sale_item_id = l.line_no) GROUP BY 1, 2""",
    "refunds": """SELECT r.request, MAX(u.upto) AS sold,
        SUM(GREATEST(LEAST(r.quantity, u.upto) - (u.upto - u.n), 0) * u.price) AS refund
        FROM by_line r JOIN (SELECT *, SUM(n) OVER (PARTITION BY request ORDER BY price) AS upto FROM units_back) u
        ON r.request = u.request GROUP BY 1""",
    # void requests: the last one with a reason per sale, on sales that still count
    "void_requests": """SELECT event_id AS seq,
        CASE WHEN event_type IN ('click', 'error') THEN user_id ELSE event_id END AS sale_id,
        user_id AS requested_by, ts AS requested_at,
        CASE event_type WHEN 'error' THEN 'Wrong item' WHEN 'click' THEN 'Double entry'
        WHEN 'signup' THEN 'Test' END AS reason FROM events""",
    "last_void": """SELECT r.* FROM void_requests r JOIN (SELECT sale_id, MAX(seq) AS seq FROM void_requests
        WHERE reason IS NOT NULL GROUP BY sale_id) m ON r.sale_id = m.sale_id AND r.seq = m.seq""",
    "voids": """SELECT v.* FROM last_void v JOIN sales s ON v.sale_id = s.sale_id WHERE NOT s.is_voided""",
    "standing": "SELECT * FROM sales WHERE NOT is_voided AND sale_id NOT IN (SELECT sale_id FROM voids)",
    # ordered stock adjustments: only what follows the last exact count matters
    "edits": """SELECT event_id AS seq, user_id AS product_id, event_type,
        CAST(floor(value) AS INTEGER) AS qty, CAST(value AS DECIMAL(18,2)) AS amount, user_id, ts,
        CASE event_type WHEN 'view' THEN 'Add Stock' WHEN 'click' THEN 'Add Stock'
        WHEN 'purchase' THEN 'Remove Stock' WHEN 'error' THEN 'Set Exact Quantity' END AS kind FROM events""",
    "exact": """SELECT product_id, MAX(seq) AS seq, MAX_BY(qty, seq) AS qty FROM edits
        WHERE kind = 'Set Exact Quantity' AND qty > 0 GROUP BY product_id""",
    "later": """SELECT e.product_id, e.kind, CASE e.kind WHEN 'Add Stock' THEN e.qty ELSE -e.qty END AS shift,
        SUM(CASE e.kind WHEN 'Add Stock' THEN e.qty ELSE -e.qty END) OVER (PARTITION BY e.product_id
        ORDER BY e.seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after
        FROM edits e LEFT JOIN exact x ON e.product_id = x.product_id
        WHERE e.qty > 0 AND e.kind IS NOT NULL AND (x.seq IS NULL OR e.seq > x.seq)""",
    "net": """SELECT product_id, SUM(shift) AS shift,
        MAX(CASE WHEN kind = 'Remove Stock' THEN COALESCE(after, 0) END) AS floor FROM later GROUP BY product_id""",
    # new products: the first request per name that is not in use
    "requested": """SELECT p_partkey AS seq, p_partkey + 1000000000000 AS product_id, p_type AS category,
        CASE WHEN p_type = 'ECONOMY' THEN upper(p_name) ELSE p_brand || ' ' || p_type END AS product_name,
        CAST(CAST(p_retailprice AS DECIMAL(18,2)) - 902 AS DECIMAL(18,2)) AS cost_price,
        CAST(p_retailprice AS DECIMAL(18,2)) AS selling_price, p_size AS reorder_level,
        p_partkey % 60 AS opening_stock FROM part""",
    "added": """SELECT r.* FROM requested r JOIN (SELECT lower(product_name) AS name, MIN(seq) AS seq
        FROM requested WHERE cost_price > 0 AND selling_price > 0 GROUP BY 1) f ON r.seq = f.seq
        WHERE NOT EXISTS (SELECT 1 FROM part p WHERE lower(p.p_name) = f.name)""",
    # staff requests
    "staff": """SELECT event_id AS seq, user_id AS asked_by, ts,
        CASE WHEN event_type = 'signup' THEN user_id + 1000000000000 ELSE user_id END AS user_id,
        CASE WHEN event_type = 'signup' THEN 'Staff ' || user_id END AS full_name,
        CASE WHEN value >= 100 THEN 'c' || event_id END AS code, event_type AS role,
        CASE event_type WHEN 'error' THEN FALSE WHEN 'purchase' THEN TRUE END AS is_active FROM events""",
    # one request after the other: the first with name and code adds an unknown user, all later ones change one
    "staff_first": """SELECT * FROM staff s WHERE full_name IS NOT NULL AND code IS NOT NULL
        AND user_id NOT IN (SELECT user_id FROM users) AND NOT EXISTS (SELECT 1 FROM staff e WHERE e.user_id = s.user_id
        AND e.full_name IS NOT NULL AND e.code IS NOT NULL AND e.seq < s.seq)""",
    "staff_changes": """SELECT s.*, u.full_name AS person FROM staff s JOIN users u ON s.user_id = u.user_id
        UNION ALL SELECT s.*, f.full_name FROM staff s JOIN staff_first f ON s.user_id = f.user_id WHERE s.seq > f.seq""",
    "staff_last": """SELECT user_id, MAX_BY(code, CASE WHEN code IS NOT NULL THEN seq END) AS code,
        MAX_BY(is_active, CASE WHEN is_active IS NOT NULL THEN seq END) AS is_active
        FROM staff_changes GROUP BY user_id""",
    # tills
    "declared": """SELECT o_custkey AS cashier_id, CAST(o_orderdate AS DATE) AS recon_date,
        CAST(COALESCE(SUM(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0)
        AS DECIMAL(18,2)) AS declared_cash FROM orders GROUP BY 1, 2""",
    "expected": """SELECT cashier_id, sale_date AS recon_date, SUM(total_amount) AS cash FROM sales
        WHERE NOT is_voided AND payment_method = '1-URGENT' GROUP BY 1, 2""",
    "recon": """SELECT d.cashier_id, d.recon_date, CAST(COALESCE(e.cash, 0) AS DECIMAL(18,2)) AS expected_cash,
        d.declared_cash, CAST(d.declared_cash - COALESCE(e.cash, 0) AS DECIMAL(18,2)) AS difference, '' AS notes,
        d.cashier_id AS submitted_by, CAST(d.recon_date AS TIMESTAMP) AS created_at
        FROM declared d LEFT JOIN expected e ON d.cashier_id = e.cashier_id AND d.recon_date = e.recon_date""",
    # profit and loss rows
    "pnl": """SELECT p.product_id AS row_no, p.product_name AS product, p.selling_price, p.cost_price, q.quantity
        FROM products p JOIN (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS quantity FROM items GROUP BY 1) q
        USING (product_id)""",
}


def _sql(tables: str, body: str) -> str:
    """``body`` with the named tables in front, in the order given."""
    listed = ", ".join(f"{t} AS ({TABLES[t]})" for t in tables.split())
    return f"WITH {listed} {body}" if listed else body


def _half_even(num: str, den: str) -> str:
    """Non-negative ``num / den`` rounded to a whole number, halves to even, in whole numbers."""
    n, d = f"({num})", f"({den})"
    return (
        f"(CASE WHEN 2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) "
        f"THEN {n} // {d} + 1 ELSE {n} // {d} END)"
    )


def _signed_half_even(num: str, den: str) -> str:
    return f"(CASE WHEN ({num}) < 0 THEN -{_half_even(f'-({num})', den)} ELSE {_half_even(num, den)} END)"


def _kpis(where: str) -> str:
    return _sql(
        "users sales counted",
        f"""SELECT CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS revenue, COUNT(*) AS transactions,
        COALESCE(CAST(SUM(total_amount) AS DOUBLE) / NULLIF(COUNT(total_amount), 0), 0) AS avg_transaction
        FROM counted WHERE {where}""",
    )


_STATUS_COLUMNS = """product_name, category, CAST(selling_price AS DOUBLE) AS selling_price,
    CAST(cost_price AS DOUBLE) AS cost_price, quantity, reorder_level, status"""

_PRODUCT_COLUMNS = """product_id, barcode, product_name, category, CAST(selling_price AS DOUBLE) AS selling_price,
    CAST(cost_price AS DOUBLE) AS cost_price, reorder_level, is_active"""

_MARGIN = _signed_half_even(
    "CAST((selling_price - cost_price) * 100 AS BIGINT) * 1000", "CAST(selling_price * 100 AS BIGINT)"
)

_CATALOGUE = f"""SELECT product_name, category, barcode, CAST(cost_price AS DOUBLE) AS cost_price,
    CAST(selling_price AS DOUBLE) AS selling_price, {_MARGIN} / 10 AS margin_pct,
    COALESCE(quantity, 0) AS quantity, reorder_level, CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS status
    FROM products LEFT JOIN inventory USING (product_id)"""

ORACLE: dict[str, str] = {
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    ),
    "revenue_by_branch": """SELECT n.n_name AS branch,
        CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
        COUNT(DISTINCT o.o_orderkey) AS txns
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        GROUP BY n.n_name""",
    "master_detail": _sql(
        "users products sales items branches",
        """SELECT s.sale_id, s.sale_date, s.sale_time, c.c_name AS customer_name, u.full_name AS cashier_name,
        b.branch_name, p.product_name, p.category, i.quantity, CAST(p.selling_price AS DOUBLE) AS unit_price,
        CAST(i.quantity * p.selling_price AS DOUBLE) AS total
        FROM sales s JOIN customer c ON s.customer_id = c.c_custkey JOIN users u ON s.cashier_id = u.user_id
        JOIN branches b ON c.c_nationkey = b.branch_id JOIN items i ON s.sale_id = i.sale_id
        JOIN products p ON i.product_id = p.product_id""",
    ),
    "detail_summaries": _sql(
        "users products sales items branches",
        """, detail AS (SELECT s.sale_id, date_part('hour', s.sold_at) AS hour, u.full_name, b.branch_name, p.product_name,
        p.category, i.quantity, i.quantity * p.selling_price AS total
        FROM sales s JOIN customer c ON s.customer_id = c.c_custkey JOIN users u ON s.cashier_id = u.user_id
        JOIN branches b ON c.c_nationkey = b.branch_id JOIN items i ON s.sale_id = i.sale_id
        JOIN products p ON i.product_id = p.product_id)
        SELECT 'branch_revenue' AS summary, branch_name AS key, CAST(SUM(total) AS DOUBLE) AS total_revenue,
        CAST(NULL AS BIGINT) AS total_quantity, CAST(NULL AS BIGINT) AS txns FROM detail WHERE branch_name IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'product_sales', product_name, NULL, CAST(SUM(quantity) AS BIGINT), NULL FROM detail
        WHERE product_name IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'category_revenue', category, CAST(SUM(total) AS DOUBLE), NULL, NULL FROM detail
        WHERE category IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'cashier_performance', full_name, NULL, NULL, COUNT(DISTINCT sale_id) FROM detail
        WHERE full_name IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'hourly_traffic', CAST(CAST(hour AS INTEGER) AS VARCHAR), NULL, NULL, COUNT(DISTINCT sale_id)
        FROM detail WHERE hour IS NOT NULL GROUP BY 2""",
    ),
    "units_by_product": """SELECT p.p_name AS product_name, CAST(SUM(CAST(l.l_quantity AS INTEGER)) AS BIGINT) AS units
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey
        WHERE p.p_name IS NOT NULL GROUP BY 1""",
    "revenue_by_category": """SELECT p.p_type AS category,
        CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey
        WHERE p.p_type IS NOT NULL GROUP BY 1""",
    "tx_by_cashier": """SELECT c.c_name AS cashier, COUNT(DISTINCT o.o_orderkey) AS txns
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey
        WHERE c.c_name IS NOT NULL GROUP BY 1""",
    "tx_by_hour": """SELECT CAST(date_part('hour', ts) AS INTEGER) AS hour, COUNT(DISTINCT event_id) AS txns,
        CASE WHEN date_part('hour', ts) < 12 THEN lpad(CAST(date_part('hour', ts) AS VARCHAR), 2, '0') || ':00 AM'
        WHEN date_part('hour', ts) = 12 THEN '12:00 PM'
        ELSE lpad(CAST(date_part('hour', ts) - 12 AS VARCHAR), 2, '0') || ':00 PM' END AS label
        FROM events GROUP BY 1, 3""",
    "reorder_alert": """SELECT p.p_name AS product_name, p.p_type AS category, s.quantity AS current_stock,
        p.p_size AS reorder_level, n.n_name AS branch_name
        FROM (SELECT l_partkey, s_nationkey, CAST(SUM(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS quantity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) s
        JOIN part p ON s.l_partkey = p.p_partkey JOIN nation n ON s.s_nationkey = n.n_nationkey
        WHERE s.quantity <= p.p_size""",
    "sales_list": _sql(
        "users sales",
        """SELECT s.sale_id, s.sale_date, s.sale_time, u.full_name AS cashier, s.payment_method,
        CAST(s.total_amount AS DOUBLE) AS total_amount, s.is_voided
        FROM sales s JOIN users u ON s.cashier_id = u.user_id""",
    ),
    "sales_kpis_today": _kpis(f"sale_date = {AS_OF}"),
    "sales_kpis_week": _kpis(f"sale_date BETWEEN CAST(date_trunc('week', {AS_OF}) AS DATE) AND {AS_OF}"),
    "sales_kpis_month": _kpis(f"sale_date BETWEEN CAST(date_trunc('month', {AS_OF}) AS DATE) AND {AS_OF}"),
    "sales_kpis_range": _kpis("sale_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'"),
    "sales_kpis_all": _kpis("TRUE"),
    "daily_sales": _sql(
        "users sales counted",
        """SELECT sale_date, CAST(SUM(total_amount) AS DOUBLE) AS total, COUNT(total_amount) AS txns
        FROM counted GROUP BY sale_date""",
    ),
    "by_cashier": _sql(
        "users sales counted",
        "SELECT cashier, CAST(SUM(total_amount) AS DOUBLE) AS total FROM counted GROUP BY cashier",
    ),
    "by_payment": _sql(
        "users sales counted",
        "SELECT payment_method, CAST(SUM(total_amount) AS DOUBLE) AS total FROM counted GROUP BY payment_method",
    ),
    "period_transactions": _sql(
        "users sales counted",
        """SELECT sale_id, sale_date, sale_time, cashier, payment_method,
        CAST(total_amount AS DOUBLE) AS total_amount, is_voided
        FROM counted WHERE sale_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'""",
    ),
    "home_metrics": _sql(
        "products inventory stock sales",
        f"""SELECT t.today_revenue, t.today_transactions, t.yesterday_revenue, t.month_revenue, x.month_expenses,
        l.low_stock, CASE WHEN t.yesterday_revenue <> 0
        THEN CAST(t.today_exact - t.yesterday_exact AS DOUBLE) END AS change FROM
        (SELECT COALESCE(SUM(CASE WHEN sale_date = {AS_OF} THEN total_amount END), 0) AS today_exact,
          COALESCE(SUM(CASE WHEN sale_date = {AS_OF} - 1 THEN total_amount END), 0) AS yesterday_exact,
          CAST(COALESCE(SUM(CASE WHEN sale_date = {AS_OF} THEN total_amount END), 0) AS DOUBLE) AS today_revenue,
          COUNT(CASE WHEN sale_date = {AS_OF} THEN 1 END) AS today_transactions,
          CAST(COALESCE(SUM(CASE WHEN sale_date = {AS_OF} - 1 THEN total_amount END), 0) AS DOUBLE) AS yesterday_revenue,
          CAST(COALESCE(SUM(CASE WHEN year(sale_date) = 2001 AND month(sale_date) = 7 THEN total_amount END), 0)
          AS DOUBLE) AS month_revenue FROM sales WHERE NOT is_voided) t,
        (SELECT CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS month_expenses
          FROM lineitem WHERE year(l_shipdate) = 2001 AND month(l_shipdate) = 7) x,
        (SELECT COUNT(*) AS low_stock FROM stock WHERE status = 'Low Stock') l""",
    ),
    "kept_daily_sums": _sql(
        "sales void_requests last_void voids standing",
        """SELECT sale_date, cashier_id, payment_method, CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS total,
        COUNT(*) AS txns, COUNT(total_amount) AS priced FROM standing GROUP BY sale_date, cashier_id, payment_method""",
    ),
    "kept_daily_sales": _sql(
        "users sales void_requests last_void voids standing",
        """SELECT sale_date, CAST(SUM(total_amount) AS DOUBLE) AS total, COUNT(total_amount) AS txns
        FROM standing WHERE cashier_id IN (SELECT user_id FROM users) GROUP BY sale_date""",
    ),
    "kept_by_cashier": _sql(
        "users sales void_requests last_void voids standing",
        """SELECT u.full_name AS cashier, CAST(SUM(total_amount) AS DOUBLE) AS total FROM standing s
        JOIN users u ON s.cashier_id = u.user_id GROUP BY u.full_name""",
    ),
    "kept_home_metrics": _sql(
        "products inventory stock sales void_requests last_void voids standing",
        f"""SELECT t.today_revenue, t.today_transactions, t.yesterday_revenue, t.month_revenue, x.month_expenses,
        l.low_stock, CASE WHEN t.yesterday_revenue <> 0
        THEN CAST(t.today_exact - t.yesterday_exact AS DOUBLE) END AS change FROM
        (SELECT COALESCE(SUM(CASE WHEN sale_date = {AS_OF} THEN total_amount END), 0) AS today_exact,
          COALESCE(SUM(CASE WHEN sale_date = {AS_OF} - 1 THEN total_amount END), 0) AS yesterday_exact,
          CAST(COALESCE(SUM(CASE WHEN sale_date = {AS_OF} THEN total_amount END), 0) AS DOUBLE) AS today_revenue,
          COUNT(CASE WHEN sale_date = {AS_OF} THEN 1 END) AS today_transactions,
          CAST(COALESCE(SUM(CASE WHEN sale_date = {AS_OF} - 1 THEN total_amount END), 0) AS DOUBLE) AS yesterday_revenue,
          CAST(COALESCE(SUM(CASE WHEN year(sale_date) = 2001 AND month(sale_date) = 7 THEN total_amount END), 0)
          AS DOUBLE) AS month_revenue FROM standing) t,
        (SELECT CAST(COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS month_expenses
          FROM lineitem WHERE year(l_shipdate) = 2001 AND month(l_shipdate) = 7) x,
        (SELECT COUNT(*) AS low_stock FROM stock WHERE status = 'Low Stock') l""",
    ),
    "top5_products": _sql(
        "products sales items",
        f"""SELECT p.product_name, CAST(SUM(i.quantity) AS BIGINT) AS units_sold FROM items i
        JOIN products p ON i.product_id = p.product_id JOIN sales s ON i.sale_id = s.sale_id
        WHERE s.sale_date = {AS_OF} AND NOT s.is_voided GROUP BY p.product_name
        ORDER BY units_sold DESC, p.product_name LIMIT 5""",
    ),
    "low_stock_preview": _sql(
        "products inventory stock",
        """SELECT product_name, category, quantity, reorder_level FROM stock WHERE status = 'Low Stock'
        ORDER BY quantity, product_id LIMIT 5""",
    ),
    "inventory_status": _sql("products inventory stock", f"SELECT {_STATUS_COLUMNS} FROM stock"),
    "inventory_counts": _sql(
        "products inventory stock",
        "SELECT COUNT(*) AS total_products, COUNT(CASE WHEN status = 'Low Stock' THEN 1 END) AS low_stock FROM stock",
    ),
    "low_stock_items": _sql(
        "products inventory stock",
        "SELECT product_name, category, quantity, reorder_level FROM stock WHERE status = 'Low Stock'",
    ),
    "movement_history": _sql(
        "users products",
        """SELECT e.ts AS movement_date, p.product_name, CASE e.event_type WHEN 'purchase' THEN 'stock_in'
        WHEN 'view' THEN 'sale' WHEN 'click' THEN 'adjustment' WHEN 'error' THEN 'damaged'
        WHEN 'signup' THEN 'return' END AS movement_type, CAST(floor(e.value) AS INTEGER) AS quantity,
        e.props AS reason, u.full_name FROM events e JOIN products p ON e.user_id = p.product_id
        JOIN users u ON e.user_id = u.user_id ORDER BY e.ts DESC, e.event_id DESC LIMIT 50""",
    ),
    "catalogue": _sql("products inventory", _CATALOGUE),
    "catalogue_search": _sql(
        "products inventory",
        f"{_CATALOGUE} WHERE contains(lower(product_name), 'ring') AND category = 'SMALL' AND is_active",
    ),
    "categories": "SELECT DISTINCT p_type AS category FROM part WHERE p_type <> ''",
    "available_products": _sql(
        "products inventory",
        """SELECT product_id, product_name, CAST(selling_price AS DOUBLE) AS selling_price, quantity
        FROM products JOIN inventory USING (product_id) WHERE is_active AND quantity > 0""",
    ),
    "expense_list": _sql(
        "users expenses",
        """SELECT e.expense_id, e.expense_date, e.category, e.description, CAST(e.amount AS DOUBLE) AS amount,
        u.full_name AS recorded_by FROM expenses e JOIN users u ON e.recorded_by = u.user_id""",
    ),
    "expenses_by_category": _sql(
        "users expenses",
        """SELECT e.category, CAST(SUM(e.amount) AS DOUBLE) AS amount FROM expenses e
        JOIN users u ON e.recorded_by = u.user_id WHERE e.category IS NOT NULL GROUP BY e.category""",
    ),
    "total_expenses": _sql(
        "users expenses",
        """SELECT CAST(COALESCE(SUM(e.amount), 0) AS DOUBLE) AS expenses FROM expenses e
        JOIN users u ON e.recorded_by = u.user_id""",
    ),
    "profit_and_loss": _sql(
        "users products sales items expenses counted",
        """SELECT CAST(r.v AS DOUBLE) AS revenue, CAST(c.v AS DOUBLE) AS cogs,
        CAST(r.v - c.v AS DOUBLE) AS gross_profit, CAST(x.v AS DOUBLE) AS expenses,
        CAST(r.v - c.v - x.v AS DOUBLE) AS net_profit FROM
        (SELECT COALESCE(SUM(total_amount), 0) AS v FROM counted) r,
        (SELECT COALESCE(SUM(i.quantity * p.cost_price), 0) AS v FROM items i
          JOIN products p ON i.product_id = p.product_id JOIN sales s ON i.sale_id = s.sale_id
          WHERE NOT s.is_voided) c,
        (SELECT COALESCE(SUM(e.amount), 0) AS v FROM expenses e JOIN users u ON e.recorded_by = u.user_id) x""",
    ),
    "business_report": _sql(
        "users sales expenses",
        f"""SELECT business, CAST(revenue AS DOUBLE) AS revenue, CAST(expenses AS DOUBLE) AS expenses,
        CAST(revenue - expenses AS DOUBLE) AS profit,
        CASE WHEN revenue <> 0 THEN {_signed_half_even(
            "CAST((revenue - expenses) * 100 AS HUGEINT) * 10000", "CAST(revenue * 100 AS HUGEINT)"
        )} / 100 END AS margin_pct,
        CASE WHEN revenue > expenses THEN 'profit' WHEN revenue = expenses THEN 'broke even' ELSE 'loss' END AS verdict
        FROM (SELECT u.full_name AS business, COALESCE(r.v, 0) AS revenue, COALESCE(x.v, 0) AS expenses FROM users u
        LEFT JOIN (SELECT customer_id, SUM(total_amount) AS v FROM sales GROUP BY 1) r ON u.user_id = r.customer_id
        LEFT JOIN (SELECT recorded_by, SUM(amount) AS v FROM expenses GROUP BY 1) x ON u.user_id = x.recorded_by) b""",
    ),
    "product_pnl": _sql(
        "products items pnl",
        f"""SELECT row_no, product, CAST(selling_price AS DOUBLE) AS selling_price,
        CAST(cost_price AS DOUBLE) AS cost_price, quantity, CAST(selling_price * quantity AS DOUBLE) AS revenue,
        CAST(cost_price * quantity AS DOUBLE) AS cost, CAST((selling_price - cost_price) * quantity AS DOUBLE) AS profit,
        CASE WHEN selling_price > 0 THEN {_signed_half_even(
            "CAST((selling_price - cost_price) * 100 AS BIGINT) * 10000", "CAST(selling_price * 100 AS BIGINT)"
        )} / 100 ELSE 0 END AS margin_pct FROM pnl WHERE product <> ''""",
    ),
    "product_pnl_summary": _sql(
        "products items pnl",
        """SELECT CAST(SUM(selling_price * quantity) AS DOUBLE) AS revenue,
        CAST(SUM(cost_price * quantity) AS DOUBLE) AS cost,
        CAST(SUM((selling_price - cost_price) * quantity) AS DOUBLE) AS profit,
        (SELECT product FROM pnl ORDER BY (selling_price - cost_price) * quantity DESC, row_no LIMIT 1)
        AS best_performer FROM pnl""",
    ),
    "best_row": _sql(
        "products items pnl", "SELECT product AS best_product FROM pnl ORDER BY quantity DESC, row_no LIMIT 1"
    ),
    "sheet_summary": _sql(
        "products items",
        """, lines AS (SELECT p.product_name AS product, i.quantity, p.selling_price AS price
        FROM items i JOIN products p ON i.product_id = p.product_id)
        SELECT 'Total Revenue' AS metric, CAST(SUM(quantity * price) AS VARCHAR) AS value FROM lines
        UNION ALL SELECT 'Best Selling Product', (SELECT product FROM lines WHERE product IS NOT NULL
        GROUP BY product ORDER BY SUM(quantity) DESC, product LIMIT 1)
        UNION ALL SELECT 'Total Transactions', CAST(COUNT(*) AS VARCHAR) FROM lines""",
    ),
    "period_stats": _sql(
        "sales",
        f"""SELECT customer_id, CAST(total / 100 AS DOUBLE) AS total, CAST(highest AS DOUBLE) AS highest,
        CAST(lowest AS DOUBLE) AS lowest, {_half_even('total', 'n')} / 100 AS average,
        {_half_even('total', 'n')} > 25000000 AS above_threshold FROM
        (SELECT customer_id, CAST(SUM(total_amount) * 100 AS BIGINT) AS total, COUNT(*) AS n,
        MAX(total_amount) AS highest, MIN(total_amount) AS lowest FROM sales GROUP BY customer_id) t""",
    ),
    "fx_convert": f"""SELECT t.currency, o.o_orderkey AS sale_id, o.o_totalprice AS total_amount,
        CASE WHEN n.n_nationkey IS NOT NULL THEN {_half_even(
            "CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) * (n.n_nationkey + 1)", "4"
        )} / 100 END AS converted
        FROM orders o, (SELECT unnest(['NATION_1', 'NATION_7', 'NATION_20', 'NOWHERE']) AS currency) t
        LEFT JOIN nation n ON n.n_name = t.currency""",
    "product_margins": f"""SELECT product_id, m / 10 AS margin_pct,
        CASE WHEN m >= 200 THEN 'green' WHEN m >= 100 THEN 'orange' ELSE 'red' END AS band FROM
        (SELECT product_id, CASE WHEN up > 0 THEN {_half_even('(up - cost) * 1000', 'up')} ELSE 0 END AS m FROM
        (SELECT p_partkey AS product_id, CAST(p_retailprice * 70 AS BIGINT) AS cost,
        (CAST(p_retailprice * 70 AS BIGINT) * (100 + p_partkey % 60) + 50) // 100 AS up FROM part) c) t""",
    "safe_ratio": """SELECT o_orderkey AS sale_id,
        CASE WHEN o_orderstatus <> 'P' AND o_custkey <> o_orderkey % 1500
        THEN CAST(o_custkey AS DOUBLE) / (o_custkey - o_orderkey % 1500) END AS value,
        CASE WHEN o_orderstatus = 'P' THEN 'invalid number'
        WHEN o_custkey = o_orderkey % 1500 THEN 'revenue and expenses are equal' END AS error FROM orders""",
    "text_labels": """SELECT o.o_orderkey AS sale_id,
        'Sale #' || o.o_orderkey || ' — ' || CAST(o.o_orderdate AS DATE) || ' — GHS '
        || CAST(o.o_totalprice AS DECIMAL(18,2)) || ' (' || c.c_name || ')' AS sale_label,
        c.c_name || ' (' || upper(left(c.c_mktsegment, 1)) || lower(substr(c.c_mktsegment, 2)) || ')' AS staff_label,
        'GHS ' || format('{:,.2f}', o.o_totalprice) AS amount_text,
        strftime(o.o_orderdate, '%A, %d %B %Y') AS long_date, strftime(o.o_orderdate, '%H:%M') AS hhmm,
        c.c_mktsegment = 'MACHINERY' AS is_machinery
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "excel_dates": "SELECT o_orderkey AS sale_id, CAST(o_orderdate AS DATE) AS sale_date FROM orders",
    "staff_list": _sql("users", "SELECT user_id, full_name, role, is_active FROM users"),
    "activity_view": _sql(
        "users",
        """SELECT e.ts AS logged_at, u.full_name, u.role, e.event_type AS action, e.props AS details
        FROM events e JOIN users u ON e.user_id = u.user_id ORDER BY e.ts DESC, e.event_id DESC LIMIT 100""",
    ),
    "voidable_sales": _sql(
        "users sales counted",
        """SELECT sale_id, sale_date, sale_time, cashier, payment_method, CAST(total_amount AS DOUBLE) AS total_amount
        FROM counted""",
    ),
    "shift_breakdown": _sql(
        "sales",
        """SELECT cashier_id, sale_date, payment_method, CAST(COALESCE(SUM(total_amount), 0) AS DOUBLE) AS total,
        COUNT(*) AS txns FROM sales WHERE NOT is_voided GROUP BY 1, 2, 3""",
    ),
    "expected_cash": _sql(
        "sales expected",
        "SELECT cashier_id, recon_date AS sale_date, CAST(cash AS DOUBLE) AS expected_cash FROM expected",
    ),
    "till_history": _sql(
        "users sales declared expected recon",
        """SELECT r.recon_date, u.full_name AS cashier, CAST(r.expected_cash AS DOUBLE) AS expected_cash,
        CAST(r.declared_cash AS DOUBLE) AS declared_cash, CAST(r.difference AS DOUBLE) AS difference, r.notes,
        b.full_name AS submitted_by, r.created_at FROM recon r JOIN users u ON r.cashier_id = u.user_id
        JOIN users b ON r.submitted_by = b.user_id
        ORDER BY r.recon_date DESC, r.created_at DESC, r.cashier_id LIMIT 50""",
    ),
    "returnable_sales": _sql(
        "users sales counted",
        """SELECT sale_id, sale_date, cashier, payment_method, CAST(total_amount AS DOUBLE) AS total_amount
        FROM counted ORDER BY sale_date DESC, sale_id DESC LIMIT 100""",
    ),
    "sale_item_list": _sql(
        "products items",
        """SELECT i.sale_id, i.product_id, p.product_name, i.quantity, CAST(i.subtotal AS DOUBLE) AS unit_price,
        CAST(i.subtotal AS DOUBLE) AS subtotal FROM items i JOIN products p ON i.product_id = p.product_id""",
    ),
    "returns_history": _sql(
        "users products",
        """SELECT l.l_shipdate AS return_date, l.l_orderkey AS sale_id, p.product_name,
        CAST(l.l_quantity AS INTEGER) AS quantity, l.l_extendedprice AS refund_amount, l.l_linestatus AS reason,
        u.full_name AS processed_by FROM lineitem l JOIN products p ON l.l_partkey = p.product_id
        JOIN users u ON l.l_suppkey = u.user_id WHERE l.l_returnflag = 'R'
        ORDER BY l.l_shipdate DESC, l.l_orderkey DESC, l.l_partkey, l.l_quantity, l.l_extendedprice,
        l.l_linestatus, u.full_name LIMIT 50""",
    ),
    "sales_alerts": _sql(
        "products inventory stock sales",
        f""", low AS (SELECT COUNT(*) AS n FROM stock WHERE status = 'Low Stock'),
        cents AS (SELECT
          CAST(COALESCE(SUM(CASE WHEN sale_date = {AS_OF} - 1 THEN total_amount END), 0) * 100 AS BIGINT) AS last,
          CAST(COALESCE(SUM(CASE WHEN sale_date = {AS_OF} - 2 THEN total_amount END), 0) * 100 AS BIGINT) AS prev
          FROM sales WHERE NOT is_voided),
        pct AS (SELECT *, {_half_even('abs(last - prev) * 100', 'NULLIF(prev, 0)')} AS pct FROM cents)
        SELECT 'warning' AS level, 'low_stock' AS alert, n AS value, n || ' product(s) are low on stock' AS message
        FROM low WHERE n > 0
        UNION ALL SELECT 'error', 'sales_drop', pct, 'Yesterday''s sales were ' || pct
        || '% lower than the previous day' FROM pct WHERE prev > 0 AND last * 10 < prev * 8
        UNION ALL SELECT 'success', 'sales_gain', pct, 'Yesterday''s sales were ' || pct
        || '% higher than the previous day' FROM pct WHERE prev > 0 AND last * 10 > prev * 12""",
    ),
    "cart_merge": _sql(
        "items merged",
        """SELECT cart_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
        CAST(quantity * unit_price AS DOUBLE) AS subtotal FROM merged""",
    ),
    "post_sales": _sql(
        "sales items merged posted cents headers",
        """SELECT cart_id AS sale_id, cashier_id, CAST(sold_at AS DATE) AS sale_date,
        strftime(sold_at, '%H:%M:%S') AS sale_time, payment_method,
        CAST(GREATEST(sub - off, 0) AS DOUBLE) / 100 AS total_amount, CAST(off AS DOUBLE) / 100 AS discount_amount,
        FALSE AS is_voided FROM headers""",
    ),
    "post_sales_items": _sql(
        "sales items merged posted",
        """SELECT cart_id AS sale_id, product_id, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
        CAST(subtotal AS DOUBLE) AS subtotal FROM posted""",
    ),
    "post_sales_movements": _sql(
        "sales items merged posted",
        """SELECT product_id, 'sale' AS movement_type, quantity, 'Sale ID ' || cart_id AS reason,
        cashier_id AS recorded_by, sold_at AS movement_date FROM posted""",
    ),
    "post_sales_inventory": _sql(
        "inventory sales items merged posted",
        """SELECT i.product_id, CAST(i.quantity - COALESCE(s.q, 0) AS BIGINT) AS quantity FROM inventory i
        LEFT JOIN (SELECT product_id, SUM(quantity) AS q FROM posted GROUP BY 1) s ON i.product_id = s.product_id""",
    ),
    "post_sales_activity": _sql(
        "sales items merged posted cents headers",
        """SELECT cashier_id AS user_id, 'SALE' AS action, 'Sale ID ' || cart_id || ' - GHS '
        || CAST(GREATEST(sub - off, 0) // 100 AS VARCHAR) || '.'
        || lpad(CAST(GREATEST(sub - off, 0) % 100 AS VARCHAR), 2, '0') AS details, sold_at AS logged_at FROM headers""",
    ),
    "apply_movements": _sql(
        "inventory",
        """SELECT i.product_id, CAST(i.quantity + COALESCE(m.d, 0) AS BIGINT) AS quantity FROM inventory i
        LEFT JOIN (SELECT user_id, SUM(CASE WHEN event_type = 'purchase' THEN floor(value)
        WHEN event_type IN ('click', 'error') THEN -floor(value) ELSE 0 END) AS d FROM events WHERE value >= 1
        AND user_id IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') GROUP BY 1) m ON i.product_id = m.user_id""",
    ),
    "apply_movements_activity": _sql(
        "products",
        """SELECT e.user_id, 'STOCK MOVEMENT' AS action, CASE e.event_type WHEN 'purchase' THEN 'stock_in'
        WHEN 'click' THEN 'adjustment' ELSE 'damaged' END || ' - ' || CAST(floor(e.value) AS INTEGER)
        || ' units of ' || p.product_name AS details, e.ts AS logged_at
        FROM events e JOIN products p ON e.user_id = p.product_id
        WHERE e.value >= 1 AND e.event_type IN ('purchase', 'click', 'error')
        AND e.user_id IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')""",
    ),
    "apply_movements_movements": f"""SELECT {_MOVEMENT} FROM events WHERE {_MOVED}""",
    "apply_movements_rejected": f"""SELECT {_MOVEMENT} FROM events WHERE NOT ({_MOVED})""",
    "void_sales": _sql(
        "sales void_requests last_void voids",
        """SELECT s.sale_id, s.customer_id, s.cashier_id, s.sale_date, s.payment_method,
        CAST(s.total_amount AS DOUBLE) AS total_amount, s.is_voided OR v.sale_id IS NOT NULL AS is_voided,
        v.requested_by AS voided_by, v.reason AS void_reason
        FROM sales s LEFT JOIN voids v ON s.sale_id = v.sale_id""",
    ),
    "void_sales_activity": _sql(
        "sales void_requests last_void voids",
        """SELECT requested_by AS user_id, 'VOID' AS action, 'Sale ID ' || sale_id || ' voided. Reason: ' || reason
        AS details, requested_at AS logged_at FROM voids""",
    ),
    "process_returns": _sql(
        "items merged accepted",
        """SELECT sale_id, product_id, quantity, CAST(refund AS DOUBLE) AS refund_amount, reason, processed_by,
        returned_at AS return_date FROM accepted""",
    ),
    "process_returns_inventory": _sql(
        "inventory items merged accepted",
        """SELECT i.product_id, CAST(i.quantity + COALESCE(r.q, 0) AS BIGINT) AS quantity FROM inventory i
        LEFT JOIN (SELECT product_id, SUM(quantity) AS q FROM accepted GROUP BY 1) r ON i.product_id = r.product_id""",
    ),
    "process_returns_activity": _sql(
        "products items merged accepted",
        """SELECT a.processed_by AS user_id, 'RETURN' AS action, 'Sale #' || a.sale_id || ' — ' || p.product_name
        || ' x' || a.quantity || ' — GHS ' || CAST(a.refund AS DECIMAL(18,2)) AS details, a.returned_at AS logged_at
        FROM accepted a JOIN products p ON a.product_id = p.product_id""",
    ),
    "process_returns_movements": _sql(
        "items merged accepted",
        """SELECT product_id, 'return' AS movement_type, quantity, 'Return from Sale #' || sale_id || ': ' || reason
        AS reason, processed_by AS recorded_by, returned_at AS movement_date FROM accepted""",
    ),
    "process_returns_rejected": _sql(
        "items merged",
        """SELECT l.l_orderkey AS sale_id, l.l_partkey AS product_id, CAST(l.l_quantity AS INTEGER) AS quantity,
        CASE l.l_returnflag WHEN 'R' THEN 'Damaged' WHEN 'A' THEN 'Wrong item' WHEN 'N' THEN '' END AS reason,
        l.l_suppkey AS processed_by, l.l_shipdate AS returned_at FROM lineitem l
        WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE l.l_orderkey = m.cart_id AND l.l_partkey = m.product_id
        AND l.l_returnflag IN ('R', 'A') AND l.l_quantity >= 1 AND l.l_quantity <= m.quantity)""",
    ),
    "process_returns_by_line": _sql(
        "items by_line units_back refunds",
        """SELECT r.sale_id, r.product_id, r.quantity, CAST(f.refund AS DOUBLE) AS refund_amount, r.reason, r.processed_by,
        r.returned_at AS return_date FROM by_line r JOIN refunds f ON r.request = f.request
        WHERE r.reason <> '' AND r.quantity >= 1 AND r.quantity <= f.sold""",
    ),
    "process_returns_by_line_rejected": _sql(
        "items by_line units_back refunds",
        """SELECT r.sale_id, r.product_id, r.quantity, r.reason, r.processed_by, r.returned_at, r.sale_item_id
        FROM by_line r LEFT JOIN refunds f ON r.request = f.request
        WHERE NOT COALESCE(r.reason <> '' AND r.quantity >= 1 AND r.quantity <= f.sold, FALSE)""",
    ),
    "post_sales_rejected_lines": """SELECT l_orderkey AS cart_id, l_partkey AS product_id,
        l_linenumber * 1000000000000 + CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS line_no,
        CAST(l_quantity AS BIGINT) - 3 AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS unit_price
        FROM lineitem WHERE CAST(l_quantity AS BIGINT) < 4""",
    "add_products_rejected": _sql(
        "requested added",
        """SELECT r.seq, r.product_id, '' AS barcode, r.product_name, r.category, CAST(r.cost_price AS DOUBLE) AS cost_price,
        CAST(r.selling_price AS DOUBLE) AS selling_price, r.reorder_level, r.opening_stock, r.seq AS added_by,
        CAST(NULL AS TIMESTAMP) AS added_at, CASE WHEN NOT (r.cost_price > 0 AND r.selling_price > 0) THEN 'incomplete'
        WHEN lower(r.product_name) IN (SELECT lower(p_name) FROM part) THEN 'name in use'
        ELSE 'name asked for before' END AS refused FROM requested r WHERE r.seq NOT IN (SELECT seq FROM added)""",
    ),
    "set_active_rejected": """SELECT * FROM (SELECT event_id AS seq, user_id AS product_id,
        CASE WHEN event_id % 3 > 0 THEN event_type IN ('purchase', 'view', 'signup') END AS is_active,
        user_id AS requested_by, ts AS requested_at, CASE WHEN event_id % 3 = 0 THEN 'incomplete'
        WHEN user_id NOT IN (SELECT p_partkey FROM part) THEN 'unknown product' END AS refused FROM events)
        WHERE refused IS NOT NULL""",
    "upsert_staff_rejected": _sql(
        "users staff staff_first staff_changes",
        """SELECT seq, user_id, full_name, COALESCE(code, '') AS code, role, is_active, asked_by AS requested_by,
        ts AS requested_at, 'incomplete' AS refused FROM staff
        WHERE seq NOT IN (SELECT seq FROM staff_first UNION ALL SELECT seq FROM staff_changes)""",
    ),
    "record_expenses_activity": _sql(
        "expenses",
        """SELECT recorded_by AS user_id, 'EXPENSE' AS action, category || ' - GHS '
        || CAST(CAST(amount - 20 AS DECIMAL(18,2)) AS VARCHAR) AS details, CAST(expense_date AS TIMESTAMP) AS logged_at
        FROM expenses WHERE amount > 20""",
    ),
    "record_expenses_rejected": _sql(
        "expenses",
        """SELECT expense_id + 1000000000000 AS expense_id, expense_date, category, description,
        CAST(amount - 20 AS DOUBLE) AS amount, recorded_by, CAST(expense_date AS TIMESTAMP) AS recorded_at,
        'incomplete' AS refused FROM expenses WHERE NOT COALESCE(amount > 20, FALSE)""",
    ),
    "add_products_activity": _sql(
        "requested added",
        """SELECT seq AS user_id, 'ADD PRODUCT' AS action, 'Added ' || product_name AS details,
        CAST(NULL AS TIMESTAMP) AS logged_at FROM added""",
    ),
    "set_active_activity": """SELECT e.user_id, CASE WHEN e.event_type IN ('purchase', 'view', 'signup')
        THEN 'REACTIVATE PRODUCT' ELSE 'DEACTIVATE PRODUCT' END AS action,
        CASE WHEN e.event_type IN ('purchase', 'view', 'signup') THEN 'Reactivated ' ELSE 'Deactivated ' END
        || p.p_name AS details, e.ts AS logged_at FROM events e JOIN part p ON e.user_id = p.p_partkey""",
    "reconcile_tills_activity": _sql(
        "sales declared expected recon",
        """SELECT submitted_by AS user_id, 'TILL RECONCILIATION' AS action, 'Date: ' || recon_date || ' | Expected: '
        || expected_cash || ' | Declared: ' || declared_cash || ' | Diff: ' || difference AS details,
        created_at AS logged_at FROM recon""",
    ),
    "one_sale": _sql(
        "products items",
        """SELECT i.sale_id, i.product_id, p.product_name, i.quantity, CAST(i.subtotal AS DOUBLE) AS unit_price,
        CAST(i.subtotal AS DOUBLE) AS subtotal FROM items i JOIN products p ON i.product_id = p.product_id
        WHERE i.sale_id = (SELECT CAST(7 AS BIGINT))""",
    ),
    "one_cashier": _sql(
        "sales",
        """SELECT cashier_id, sale_date, payment_method, CAST(SUM(total_amount) AS DOUBLE) AS total, COUNT(*) AS txns
        FROM sales WHERE NOT is_voided AND cashier_id = 7 GROUP BY 1, 2, 3""",
    ),
    "active_user": _sql(
        "users",
        "SELECT user_id, full_name, role, is_active, CAST(NULL AS TIMESTAMP) AS created_at FROM users WHERE code = 'u7' AND is_active",
    ),
    "add_products": _sql(
        "products requested added",
        f"""SELECT {_PRODUCT_COLUMNS} FROM products UNION ALL
        SELECT product_id, NULL, product_name, category, CAST(selling_price AS DOUBLE), CAST(cost_price AS DOUBLE),
        reorder_level, TRUE FROM added""",
    ),
    "add_products_inventory": _sql(
        "inventory requested added",
        "SELECT product_id, quantity FROM inventory UNION ALL SELECT product_id, opening_stock FROM added",
    ),
    "edit_products": _sql(
        "products edits",
        """SELECT p.product_id, p.barcode, p.product_name, p.category,
        CAST(COALESCE(e.selling_price, p.selling_price) AS DOUBLE) AS selling_price,
        CAST(p.cost_price AS DOUBLE) AS cost_price, COALESCE(e.reorder_level, p.reorder_level) AS reorder_level,
        COALESCE(e.is_active, p.is_active) AS is_active FROM products p LEFT JOIN
        (SELECT product_id, MAX_BY(amount, CASE WHEN event_type = 'purchase' THEN seq END) AS selling_price,
        MAX_BY(qty, CASE WHEN event_type = 'click' THEN seq END) AS reorder_level,
        MAX_BY(event_type = 'signup', CASE WHEN event_type IN ('error', 'signup') THEN seq END) AS is_active
        FROM edits GROUP BY product_id) e ON p.product_id = e.product_id""",
    ),
    "edit_products_inventory": _sql(
        "inventory edits exact later net",
        """SELECT i.product_id, CAST(GREATEST(COALESCE(x.qty, i.quantity) + COALESCE(n.shift, 0),
        COALESCE(n.floor, -1000000000)) AS BIGINT) AS quantity FROM inventory i
        LEFT JOIN exact x ON i.product_id = x.product_id LEFT JOIN net n ON i.product_id = n.product_id""",
    ),
    "edit_products_activity": _sql(
        "products edits",
        """SELECT e.user_id, 'STOCK ADJUSTMENT' AS action, p.product_name || ': ' || e.kind || ' ' || e.qty
        || ' | Reason: N/A' AS details, e.ts AS logged_at FROM edits e JOIN products p ON e.product_id = p.product_id
        WHERE e.qty > 0 AND e.kind IS NOT NULL
        UNION ALL SELECT e.user_id, 'EDIT PRODUCT', 'Updated ' || p.product_name, e.ts
        FROM edits e JOIN products p ON e.product_id = p.product_id""",
    ),
    "set_active": _sql(
        "products",
        """SELECT p.product_id, p.barcode, p.product_name, p.category, CAST(p.selling_price AS DOUBLE) AS selling_price,
        CAST(p.cost_price AS DOUBLE) AS cost_price, p.reorder_level, COALESCE(e.is_active, p.is_active) AS is_active
        FROM products p LEFT JOIN (SELECT user_id, MAX_BY(event_type IN ('purchase', 'view', 'signup'), event_id)
        AS is_active FROM events GROUP BY user_id) e ON p.product_id = e.user_id""",
    ),
    "upsert_staff": _sql(
        "users staff staff_first staff_changes staff_last",
        """SELECT p.user_id, p.full_name, COALESCE(l.code, p.code) AS code, p.role,
        COALESCE(l.is_active, p.is_active) AS is_active, p.created_at FROM (
        SELECT user_id, full_name, code, role, is_active, CAST(NULL AS TIMESTAMP) AS created_at FROM users
        UNION ALL SELECT user_id, full_name, code, role, TRUE, ts FROM staff_first) p
        LEFT JOIN staff_last l ON p.user_id = l.user_id""",
    ),
    "upsert_staff_activity": _sql(
        "users staff staff_first staff_changes",
        """SELECT asked_by AS user_id, 'UPDATE STAFF' AS action, 'Updated ' || person AS details, ts AS logged_at
        FROM staff_changes
        UNION ALL SELECT asked_by, 'ADD STAFF', 'Added ' || full_name || ' as ' || role, ts FROM staff_first""",
    ),
    "record_expenses": _sql(
        "expenses",
        """SELECT expense_id, expense_date, category, description, CAST(amount AS DOUBLE) AS amount, recorded_by
        FROM expenses UNION ALL SELECT expense_id + 1000000000000, expense_date, category, description,
        CAST(amount - 20 AS DOUBLE), recorded_by FROM expenses WHERE amount > 20""",
    ),
    "reconcile_tills": _sql(
        "sales declared expected recon",
        """SELECT cashier_id, recon_date, CAST(expected_cash AS DOUBLE) AS expected_cash,
        CAST(declared_cash AS DOUBLE) AS declared_cash, CAST(difference AS DOUBLE) AS difference, notes,
        submitted_by, created_at FROM recon""",
    ),
    "till_verdicts": _sql(
        "sales declared expected recon",
        """SELECT cashier_id, recon_date, CASE WHEN difference = 0 THEN 'balanced' WHEN difference > 0 THEN 'overage'
        ELSE 'shortage' END AS verdict, CAST(abs(difference) AS DOUBLE) AS amount FROM recon""",
    ),
    "append_activity": _sql(
        "sales void_requests last_void voids",
        """SELECT event_id AS log_id, user_id, event_type AS action, props AS details, ts AS logged_at FROM events
        UNION ALL SELECT NULL, requested_by, 'VOID', 'Sale ID ' || sale_id || ' voided. Reason: ' || reason,
        requested_at FROM voids""",
    ),
    "load_dedup": """SELECT e.ts, e.user_id, e.event_type, e.value, e.props FROM events e
        JOIN (SELECT user_id, MIN(event_id) AS event_id FROM events GROUP BY 1) f ON e.event_id = f.event_id""",
    "hotel_bookings": """SELECT 'B' || o.o_custkey AS booking_id, 'Guest ' || o.o_custkey AS guest_name,
        CAST(NULL AS VARCHAR) AS nationality, CAST(o.o_custkey % 100 AS VARCHAR) AS room_number,
        'Double' AS room_type, CAST(o.o_orderdate AS DATE) AS check_in,
        CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 14 + 1 AS INTEGER) AS check_out,
        CAST(o.o_orderkey % 14 + 1 AS INTEGER) AS nights, o.o_totalprice AS price_per_night,
        o.o_totalprice AS total_amount, 'Web' AS booking_source, o.o_orderpriority AS payment_method,
        CASE o.o_orderstatus WHEN 'P' THEN 'Cancelled' ELSE 'Confirmed' END AS status
        FROM orders o JOIN (SELECT MIN(o_orderkey) AS k FROM orders GROUP BY o_custkey) f ON o.o_orderkey = f.k""",
    "hotel_takings": """SELECT CAST(ts AS DATE) AS date, event_type AS meal_type,
        CAST(event_id % 40 AS INTEGER) AS covers, value AS revenue FROM events""",
    "receive_stock": _sql(
        "inventory",
        """SELECT i.product_id, CAST(i.quantity + COALESCE(m.d, 0) AS BIGINT) AS quantity FROM inventory i
        LEFT JOIN (SELECT user_id, SUM(floor(value)) AS d FROM events
        WHERE user_id IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO') GROUP BY 1) m ON i.product_id = m.user_id""",
    ),
    "receive_stock_activity": _sql(
        "products",
        """SELECT e.user_id, 'STOCK IN' AS action, CAST(floor(e.value) AS INTEGER) || ' units of ' || p.product_name
        || ' recorded' AS details, e.ts AS logged_at FROM events e JOIN products p ON e.user_id = p.product_id
        WHERE e.value >= 1 AND e.user_id IN (SELECT p_partkey FROM part WHERE p_type <> 'PROMO')""",
    ),
}
