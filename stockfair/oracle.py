"""DuckDB SQL for the driver-table views and for every registered query.

Each query's oracle is a plain SQL statement over the driver's raw tables
(``part``, ``orders``, ``events`` ...), with the application views
(``products``, ``inventory`` ...) spelled out as CTEs.  They mirror
``stockfair.sources.driver`` column for column.
"""

from __future__ import annotations


def sql_check_digit(body: str, n: int) -> str:
    """Check digit of a fixed-length digit string expression (weights 3,1,..
    from the right end of the body)."""
    terms = " + ".join(
        f"CAST(substr({body}, {i}, 1) AS INTEGER) * {3 if (n - i) % 2 == 0 else 1}"
        for i in range(1, n + 1)
    )
    return f"((10 - ({terms}) % 10) % 10)"


def sql_padded(k: str, n: int) -> str:
    """Key as text, padded with zeros to ``n`` places and never cut."""
    t = f"CAST({k} AS VARCHAR)"
    return f"lpad({t}, CAST(greatest(length({t}), {n}) AS INTEGER), '0')"


def sql_ean_for_part(k: str) -> str:
    body = f"('80' || lpad(CAST({k} AS VARCHAR), 10, '0'))"
    digit = f"(({sql_check_digit(body, 12)} + CASE WHEN ({k}) % 7 = 0 THEN 1 ELSE 0 END) % 10)"
    return f"({body} || CAST({digit} AS VARCHAR))"


def sql_money(x: str, factor: str) -> str:
    return (f"CAST(round(CAST({x} AS DECIMAL(18,2)) * CAST({factor} AS DECIMAL(2,1)), 2) "
            f"AS DOUBLE)")


def sql_valid_barcode(c: str) -> str:
    """Validity of a cleaned code column, as SQL."""
    checks = []
    for n in (8, 12, 13):
        body = f"substr({c}, 1, {n - 1})"
        checks.append(f"WHEN length({c}) = {n} THEN "
                      f"CAST(substr({c}, {n}, 1) AS INTEGER) = {sql_check_digit(body, n - 1)}")
    return (f"(CASE WHEN {c} IS NULL OR NOT regexp_full_match({c}, '[0-9]+') THEN FALSE "
            f"{' '.join(checks)} WHEN length({c}) = 14 THEN TRUE ELSE FALSE END)")


_ORDER_LINES = """
    SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate,
           o_orderdate, c_nationkey,
           CAST(year(o_orderdate) * 100 + c_nationkey AS BIGINT) AS event_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

_MOVEMENTS = """
    SELECT event_id AS seq, user_id AS product_id,
           CASE WHEN event_type IN ('view', 'signup') THEN 'in' ELSE 'out' END AS transaction_type,
           CAST(floor(value) AS BIGINT) AS quantity, event_type AS reference, props AS notes,
           CAST(user_id AS VARCHAR) AS "user", ts
    FROM events
"""

_LINES = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag,
           l_shipdate, CAST(year(o_orderdate) * 100 + c_nationkey AS BIGINT) AS event_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

_REQUEST_LINES = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, event_id, sum(l_quantity) AS l_quantity,
           sum(l_extendedprice) AS l_extendedprice,
           (l_orderkey * 100 + l_linenumber) * 10000000 + l_partkey AS seq
    FROM ({_LINES}) j GROUP BY l_orderkey, l_linenumber, l_partkey, event_id
"""

VIEWS: dict[str, str] = {
    "suppliers": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "products": f"""
        SELECT p_partkey AS id,
               CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE p_partkey % 10 END AS supplier_id,
               'SKU' || {sql_padded('p_partkey', 6)} AS sku,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE {sql_ean_for_part('p_partkey')} END
                   AS ean_upc,
               p_name AS name,
               p_brand || ' ' || p_type AS description,
               CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_type END AS category,
               CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE {sql_money('p_retailprice', '0.6')} END
                   AS purchase_price,
               p_retailprice AS selling_price
        FROM part""",
    "inventory": """
        SELECT p_partkey AS id, p_partkey AS product_id,
               CAST((p_partkey * 7) % 60 AS BIGINT) AS quantity,
               CAST(((p_partkey * 7) % 60) // 10 AS BIGINT) AS reserved,
               'warehouse' AS location, TIMESTAMP '2024-12-31 00:00:00' AS last_updated
        FROM part WHERE p_partkey % 29 <> 0""",
    "movements": _MOVEMENTS,
    "inventory_transactions": f"""
        SELECT seq AS id, product_id, transaction_type, quantity, reference, notes,
               ts AS transaction_date, "user"
        FROM ({_MOVEMENTS}) m""",
    "stock_log": f"""
        SELECT seq AS id,
               CASE WHEN transaction_type = 'in' THEN 'stock_in' ELSE 'stock_out' END AS event_type,
               CASE WHEN transaction_type = 'in' THEN 'Added ' || quantity || ' units to stock'
                    ELSE 'Removed ' || quantity || ' units from stock' END AS description,
               seq AS related_id, ts AS event_date, "user"
        FROM ({_MOVEMENTS}) m""",
    "scans": f"""
        SELECT event_type AS scanner_id, ts,
               CASE WHEN event_id % 13 = 0 THEN substr(code, 1, 2) || '-' || substr(code, 3, 20)
                    ELSE code END AS barcode,
               event_id AS scan_id
        FROM (SELECT *, {sql_ean_for_part('CASE WHEN user_id % 5 = 0 THEN 29 ELSE user_id % 4 + 4 END')}
                  AS code FROM events) e""",
    "annual_events": f"""
        SELECT o_orderkey AS id, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS periodo,
               CAST(NULL AS VARCHAR) AS accordo, CAST(1 AS BIGINT) AS num_eventi,
               CASE WHEN o_orderkey % 89 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS data,
               CAST(NULL AS VARCHAR) AS expo_periodo,
               'EV' || CAST(o_orderkey AS VARCHAR) AS nome,
               CAST(NULL AS VARCHAR) AS mezzo_trasporto, CAST(NULL AS VARCHAR) AS disciplina,
               n_name AS localita,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE r_name END AS regione,
               CAST(NULL AS VARCHAR) AS expo_brand, CAST(NULL AS VARCHAR) AS addetto,
               CAST(NULL AS DOUBLE) AS pernotto, CAST(NULL AS DOUBLE) AS vitto_alloggio,
               CAST(NULL AS DOUBLE) AS treno, CAST(NULL AS DOUBLE) AS spazio_varie,
               CAST(NULL AS DOUBLE) AS incassi_2024,
               caschi, occhiali, pneumatici,
               CAST(NULL AS DOUBLE) AS bdg_incassi, CAST(NULL AS DOUBLE) AS bdg_costi,
               CAST(NULL AS DOUBLE) AS km, CAST(NULL AS DOUBLE) AS gasolio,
               CAST(NULL AS DOUBLE) AS autostrada,
               {sql_money('o_totalprice', '0.3')} AS costi_reali,
               o_totalprice AS incassi,
               CAST(NULL AS DOUBLE) AS pos, CAST(NULL AS DOUBLE) AS cash,
               CAST(NULL AS DOUBLE) AS extra, CAST(NULL AS DOUBLE) AS vendita_privati_agenti,
               CAST(NULL AS VARCHAR) AS ffwd
        FROM orders
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT l_orderkey,
                          sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS caschi,
                          sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS occhiali,
                          sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS pneumatici
                   FROM lineitem GROUP BY l_orderkey) li ON o_orderkey = li.l_orderkey""",
    "event_sales": f"""
        SELECT event_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
               CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END
                   AS sale_price,
               CAST(l_shipdate AS DATE) AS sale_date
        FROM ({_ORDER_LINES}) j WHERE l_returnflag <> 'R'""",
    "event_products": f"""
        SELECT event_id * 10000000000 + product_id AS id, event_id, product_id,
               quantity_assigned,
               CASE WHEN product_id % 2 = 1 THEN {sql_money('p_retailprice', '0.9')} END
                   AS event_sale_price
        FROM (SELECT event_id, l_partkey AS product_id,
                     CAST(sum(l_quantity) AS BIGINT) AS quantity_assigned
              FROM ({_ORDER_LINES}) j GROUP BY event_id, l_partkey) a
        LEFT JOIN part ON product_id = p_partkey
        WHERE (event_id + product_id) % 17 <> 0""",
    "fairs": """
        SELECT CAST(yr * 100 + c_nationkey AS BIGINT) AS id,
               n_name || ' ' || CAST(yr AS VARCHAR) AS name,
               CAST(min(o_orderdate) AS DATE) AS start_date,
               CAST(max(o_orderdate) AS DATE) AS end_date,
               n_name AS location, 'Fair in ' || n_name AS description
        FROM (SELECT o_orderdate, c_nationkey, n_name, year(o_orderdate) AS yr
              FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey) j
        GROUP BY yr, c_nationkey, n_name""",
}


VIEWS["allocation_requests"] = f"""
    SELECT l_orderkey AS batch_id, seq, event_id, l_partkey AS product_id,
           CAST(ceil(l_quantity / 10) AS BIGINT) AS quantity,
           CASE WHEN l_linenumber = 1 THEN
                CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END
           END AS sale_price
    FROM ({_REQUEST_LINES}) j"""


def allocation_sheet_sql(event_id: int | None = None) -> str:
    where = "" if event_id is None else f"WHERE event_id = {event_id}"
    return f"""
    SELECT event_id, seq,
           CASE WHEN l_linenumber = 5 THEN 'SKU-X' || CAST(l_partkey AS VARCHAR)
                ELSE 'SKU' || {sql_padded('l_partkey', 6)} END AS "SKU",
           CASE WHEN l_linenumber = 3 THEN 'abc' WHEN l_linenumber = 6 THEN '2.7'
                ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS "Quantity",
           CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR) AS "Sale Price"
    FROM ({_REQUEST_LINES}) j {where}"""


VIEWS["quantity_true_up"] = f"""
    SELECT event_id * 10000000000 + product_id AS seq, event_id, product_id,
           CAST(sum(quantity) AS BIGINT) AS new_quantity
    FROM ({VIEWS['event_sales']}) s GROUP BY event_id, product_id"""

VIEWS["returned_sales"] = f"""
    SELECT event_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
           CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS sale_price,
           CAST(l_shipdate AS DATE) AS sale_date
    FROM ({_LINES}) j WHERE l_returnflag = 'R'"""


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named views."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------------------
# Oracles of the registered queries
# ---------------------------------------------------------------------------

from stockfair.plans.driver_queries import PARAMS as P  # noqa: E402

_ASCII_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_YEAR_LO = f"DATE '{P['year']}-01-01'"
_YEAR_HI = f"DATE '{P['year'] + 1}-01-01'"

_FIRST_INV = """(SELECT product_id, arg_min(quantity, id) AS quantity,
                        arg_min(last_updated, id) AS last_updated
                 FROM inventory GROUP BY product_id)"""
_STOCKED = f"""(SELECT p.*, fi.quantity FROM products p
               JOIN {_FIRST_INV} fi ON p.id = fi.product_id)"""

_STOCK_SELECT = """p.id, p.sku, p.ean_upc, p.name, p.description, p.purchase_price,
       p.selling_price, i.quantity, i.last_updated, s.name AS supplier_name
FROM products p JOIN inventory i ON p.id = i.product_id
LEFT JOIN suppliers s ON p.supplier_id = s.id"""

_PERF = """
assigned AS (
  SELECT ep.event_id, p.id, p.sku, p.name, p.description, p.category, s.name AS supplier,
         p.purchase_price, COALESCE(ep.event_sale_price, p.selling_price) AS sale_price,
         ep.quantity_assigned
  FROM event_products ep JOIN products p ON ep.product_id = p.id
  JOIN suppliers s ON p.supplier_id = s.id),
sold AS (
  SELECT es.event_id, es.product_id, p.sku, CAST(sum(es.quantity) AS BIGINT) AS quantity_sold,
         sum(es.quantity * es.sale_price) AS total_revenue
  FROM event_sales es JOIN products p ON es.product_id = p.id
  GROUP BY es.event_id, es.product_id, p.sku),
exact AS (
  SELECT a.*, COALESCE(s.quantity_sold, 0) AS quantity_sold,
         COALESCE(s.total_revenue, CAST(0 AS DOUBLE)) AS total_revenue,
         a.quantity_assigned - COALESCE(s.quantity_sold, 0) AS remaining,
         COALESCE(s.total_revenue, CAST(0 AS DOUBLE))
               - COALESCE(s.quantity_sold, 0) * a.purchase_price AS profit
  FROM assigned a LEFT JOIN sold s ON a.event_id = s.event_id AND a.id = s.product_id),
perf AS (SELECT * REPLACE (round(total_revenue, 2) AS total_revenue, round(profit, 2) AS profit)
         FROM exact)"""

_PERF_VIEWS = ("products", "suppliers", "event_products", "event_sales")


def sql(body: str, views=(), extra: str = "", recursive: bool = False) -> str:
    """``WITH [RECURSIVE] <views>, <extra ctes> <body>``."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in views]
    if extra:
        parts.append(extra.strip())
    head = "WITH RECURSIVE" if recursive else "WITH"
    return (f"{head} {', '.join(parts)}\n{body}") if parts else body


def _pct(num: str, den: str) -> str:
    return (f"round(CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * 100.0 "
            f"ELSE CAST(0 AS DOUBLE) END, 2)")


def _ratio(num: str, den: str) -> str:
    return (f"round(CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) "
            f"ELSE CAST(0 AS DOUBLE) END, 2)")


def _breakdown(key: str) -> str:
    aggs = f"""count(*) AS products, CAST(sum(quantity_assigned) AS BIGINT) AS assigned,
       CAST(sum(quantity_sold) AS BIGINT) AS sold, round(sum(total_revenue), 2) AS revenue,
       round(COALESCE(sum(profit), 0), 2) AS profit,
       {_pct('sum(quantity_sold)', 'sum(quantity_assigned)')} AS sell_through_pct"""
    body = f"""
SELECT event_id, {key}, FALSE AS is_total, {aggs}
FROM exact WHERE {key} IS NOT NULL GROUP BY event_id, {key}
UNION ALL
SELECT event_id, 'TOTAL' AS {key}, TRUE AS is_total, {aggs}
FROM exact WHERE {key} IS NOT NULL GROUP BY event_id"""
    return sql(body, _PERF_VIEWS, _PERF)


def _top_products(by: str) -> str:
    body = f"""
SELECT event_id, rank, sku, name, category, supplier, quantity_sold, total_revenue, profit
FROM (SELECT *, row_number() OVER (PARTITION BY event_id
                                   ORDER BY {by} DESC NULLS LAST, id) AS rank
      FROM perf
      WHERE event_id IN (SELECT event_id FROM perf GROUP BY event_id
                         HAVING sum(quantity_sold) > 0)) t
WHERE rank <= {P['top_k']}"""
    return sql(body, _PERF_VIEWS, _PERF)


_FAIRS_Y = f"(SELECT * FROM fairs WHERE start_date >= {_YEAR_LO} AND start_date < {_YEAR_HI})"
_YEAR_PRODUCTS = f"""
year_products AS (
  SELECT p.id, p.sku, p.name, p.description, p.category, s.name AS supplier
  FROM products p JOIN suppliers s ON p.supplier_id = s.id
  WHERE p.id IN (SELECT ep.product_id FROM event_products ep
                 WHERE ep.event_id IN (SELECT id FROM {_FAIRS_Y} fy)))"""
_YEAR_SALES = f"""
year_sales AS (
  SELECT es.event_id, f.name AS event_name, es.product_id, p.sku,
         CAST(sum(es.quantity) AS BIGINT) AS quantity_sold,
         round(sum(es.quantity * es.sale_price), 2) AS total_revenue
  FROM event_sales es JOIN {_FAIRS_Y} f ON es.event_id = f.id
  JOIN products p ON es.product_id = p.id
  GROUP BY es.event_id, f.name, es.product_id, p.sku)"""

_YEAR_OF = "substr(data, 1, 4)"
# the year's fairs: one per nation of the driver's tables (keys 0 to 24)
_FAIR_COLUMNS = [(P["year"] * 100 + k, f"{P['year'] * 100 + k}_NATION_{k} {P['year']}")
                 for k in range(25)]

ORACLE: dict[str, str] = {
    # catalogue reads
    "product_by_barcode": sql(f"""
SELECT k.barcode, sp.* FROM
  (SELECT DISTINCT regexp_replace(barcode, '[^0-9]', '', 'g') AS barcode FROM scans) k
JOIN {_STOCKED} sp ON k.barcode = sp.ean_upc""", ("products", "inventory", "scans")),
    "product_by_sku": sql(f"""
SELECT sp.* FROM
  (SELECT DISTINCT 'SKU' || {sql_padded('product_id', 6)} AS sku FROM movements) k
JOIN {_STOCKED} sp ON k.sku = sp.sku""", ("products", "inventory", "movements")),
    "search_products": sql(f"""
SELECT p.*, i.quantity FROM products p JOIN inventory i ON p.id = i.product_id
WHERE translate(p.name, {_ASCII_FOLD}) LIKE '%{P['search_term'].lower()}%'
   OR translate(p.description, {_ASCII_FOLD}) LIKE '%{P['search_term'].lower()}%'
   OR translate(p.sku, {_ASCII_FOLD}) LIKE '%{P['search_term'].lower()}%'
   OR translate(p.ean_upc, {_ASCII_FOLD}) LIKE '%{P['search_term'].lower()}%'""",
                          ("products", "inventory")),
    "inventory_status": sql(f"""
SELECT {_STOCK_SELECT}
ORDER BY p.name NULLS FIRST, p.id, i.id LIMIT {P['page_limit']} OFFSET {P['page_offset']}""",
                            ("products", "inventory", "suppliers")),
    "low_stock_items": sql(f"""
SELECT {_STOCK_SELECT}
WHERE i.quantity <= {P['low_stock']}""", ("products", "inventory", "suppliers")),
    "transaction_history": sql(f"""
SELECT t.*, p.name AS product_name, p.sku, p.ean_upc
FROM inventory_transactions t JOIN products p ON t.product_id = p.id
WHERE t.product_id = {P['history_product']}
  AND t.transaction_date >= TIMESTAMP '{P['history_start']} 00:00:00'
  AND t.transaction_date <= TIMESTAMP '{P['history_end']} 00:00:00'
ORDER BY t.transaction_date DESC, t.id DESC LIMIT 100""", ("products", "inventory_transactions")),
    "stock_log_query": sql(f"""
SELECT * FROM stock_log
WHERE event_type = '{P['log_type']}' AND event_date >= TIMESTAMP '{P['log_start']} 00:00:00'
ORDER BY event_date DESC, id DESC LIMIT 100""", ("stock_log",)),
    "available_products": sql(f"""
SELECT p.id, p.sku, p.name, p.description, p.category, s.name AS supplier, p.purchase_price,
       p.selling_price, i.quantity
FROM products p JOIN inventory i ON p.id = i.product_id JOIN suppliers s ON p.supplier_id = s.id
WHERE i.quantity >= {P['min_stock']}""", ("products", "inventory", "suppliers")),
    "event_products": sql("""
SELECT ep.event_id, p.id, p.sku, p.name, p.description, p.category, s.name AS supplier,
       p.purchase_price, COALESCE(ep.event_sale_price, p.selling_price) AS sale_price,
       ep.quantity_assigned, i.quantity AS available_stock
FROM event_products ep JOIN products p ON ep.product_id = p.id
JOIN suppliers s ON p.supplier_id = s.id JOIN inventory i ON p.id = i.product_id""",
                          ("products", "suppliers", "inventory", "event_products")),
    "event_by_name": sql("""
SELECT a.* FROM annual_events a
WHERE a.id = (SELECT min(b.id) FROM annual_events b WHERE b.nome IS NOT DISTINCT FROM a.nome)""",
                         ("annual_events",)),
    "event_details": sql(f"""
SELECT id, name, start_date, end_date, location, description FROM fairs
WHERE id = {P['event_id']}""", ("fairs",)),
    "events_in_year": sql(f"""
SELECT id, name, start_date, end_date, location, description FROM {_FAIRS_Y} f""", ("fairs",)),
    "products_in_year": sql("SELECT * FROM year_products",
                            ("products", "suppliers", "event_products", "fairs"), _YEAR_PRODUCTS),
    # yearly statistics
    "event_totals": sql("""
SELECT round(sum(incassi), 2) AS total_incassi, round(sum(costi_reali), 2) AS total_costi
FROM annual_events""", ("annual_events",)),
    "events_per_region": sql("""
SELECT regione, count(*) AS n_events FROM annual_events GROUP BY regione""", ("annual_events",)),
    "income_by_year": sql(f"""
SELECT COALESCE(round(sum(incassi), 2), CAST(0 AS DOUBLE)) AS total_incassi FROM annual_events
WHERE {_YEAR_OF} = '{P['year']}'""", ("annual_events",)),
    "cost_by_year": sql(f"""
SELECT COALESCE(round(sum(costi_reali), 2), CAST(0 AS DOUBLE)) AS total_costi FROM annual_events
WHERE {_YEAR_OF} = '{P['year']}'""", ("annual_events",)),
    "region_counts_year": sql(f"""
SELECT regione, count(*) AS n_events FROM annual_events WHERE {_YEAR_OF} = '{P['year']}'
GROUP BY regione""", ("annual_events",)),
    "top_events": sql(f"""
SELECT id, nome, incassi FROM annual_events WHERE {_YEAR_OF} = '{P['year']}'
ORDER BY incassi DESC NULLS LAST, id LIMIT {P['top_n']}""", ("annual_events",)),
    "top_events_per_year": sql(f"""
SELECT year, rank, id, nome, incassi FROM (
  SELECT {_YEAR_OF} AS year, id, nome, incassi,
         row_number() OVER (PARTITION BY {_YEAR_OF} ORDER BY incassi DESC NULLS LAST, id) AS rank
  FROM annual_events) t
WHERE rank <= {P['top_n']}""", ("annual_events",)),
    "product_line_sales": sql(f"""
SELECT COALESCE(sum(caschi), CAST(0 AS DOUBLE)) AS caschi,
       COALESCE(sum(occhiali), CAST(0 AS DOUBLE)) AS occhiali,
       COALESCE(sum(pneumatici), CAST(0 AS DOUBLE)) AS pneumatici
FROM annual_events WHERE {_YEAR_OF} = '{P['year']}'""", ("annual_events",)),
    "annual_summary": sql(f"""
SELECT year, round(inc, 2) AS total_incassi, round(cost, 2) AS total_costi,
       round(inc - cost, 2) AS net_profit, caschi, occhiali, pneumatici, n_events
FROM (SELECT {_YEAR_OF} AS year,
             COALESCE(sum(incassi), CAST(0 AS DOUBLE)) AS inc,
             COALESCE(sum(costi_reali), CAST(0 AS DOUBLE)) AS cost,
             COALESCE(sum(caschi), CAST(0 AS DOUBLE)) AS caschi,
             COALESCE(sum(occhiali), CAST(0 AS DOUBLE)) AS occhiali,
             COALESCE(sum(pneumatici), CAST(0 AS DOUBLE)) AS pneumatici,
             count(*) AS n_events
      FROM annual_events GROUP BY 1) t""", ("annual_events",)),
    # fair reports
    "event_product_sales": sql("""
SELECT es.event_id, es.product_id, p.sku, CAST(sum(es.quantity) AS BIGINT) AS quantity_sold,
       round(sum(es.quantity * es.sale_price), 2) AS total_revenue
FROM event_sales es JOIN products p ON es.product_id = p.id
GROUP BY es.event_id, es.product_id, p.sku""", ("products", "event_sales")),
    "event_performance": sql("""
SELECT event_id, id, sku, name, description, category, supplier, purchase_price, sale_price,
       quantity_assigned, quantity_sold, total_revenue, remaining, profit FROM perf""",
                             _PERF_VIEWS, _PERF),
    "event_summary": sql(f"""
SELECT g.event_id, total_products, total_assigned, total_sold,
       {_pct('total_sold', 'total_assigned')} AS sell_through_pct,
       round(rev, 2) AS total_revenue, round(profit, 2) AS total_profit,
       {_ratio('rev', 'total_sold')} AS average_price,
       {_pct('profit', 'rev')} AS profit_margin_pct,
       f.name AS event_name, f.start_date AS event_date, f.location, f.description
FROM (SELECT event_id, count(*) AS total_products,
             CAST(sum(quantity_assigned) AS BIGINT) AS total_assigned,
             CAST(sum(quantity_sold) AS BIGINT) AS total_sold,
             sum(total_revenue) AS rev, COALESCE(sum(profit), 0) AS profit
      FROM exact GROUP BY event_id) g
LEFT JOIN fairs f ON g.event_id = f.id""", _PERF_VIEWS + ("fairs",), _PERF),
    "category_breakdown": _breakdown("category"),
    "supplier_breakdown": _breakdown("supplier"),
    "top_products_qty": _top_products("quantity_sold"),
    "top_products_revenue": _top_products("total_revenue"),
    "year_event_product_sales": sql("SELECT * FROM year_sales",
                                    ("products", "event_sales", "fairs"), _YEAR_SALES),
    "programme_pivot": sql(f"""
SELECT yp.*, {", ".join(f'CAST(COALESCE(c{i}, 0) AS BIGINT) AS "{n}"' for i, n in _FAIR_COLUMNS)},
       CAST(COALESCE(totali, 0) AS BIGINT) AS TOTALI
FROM year_products yp
LEFT JOIN (SELECT product_id, sum(quantity_sold) AS totali,
                  {", ".join(f"sum(quantity_sold) FILTER (event_id = {i}) AS c{i}"
                             for i, _ in _FAIR_COLUMNS)}
           FROM year_sales GROUP BY product_id) pv ON yp.id = pv.product_id""",
                           ("products", "suppliers", "event_products", "fairs", "event_sales"),
                           _YEAR_PRODUCTS + "," + _YEAR_SALES),
    "programme_no_sales": sql(f"""
SELECT yp.*, {", ".join(f'CAST(0 AS BIGINT) AS "{n}"' for _, n in _FAIR_COLUMNS)},
       CAST(0 AS BIGINT) AS TOTALI
FROM year_products yp""", ("products", "suppliers", "event_products", "fairs"), _YEAR_PRODUCTS),
    "programme_cells": sql("""
SELECT yp.id, ys.event_id, ys.event_name, COALESCE(ys.quantity_sold, 0) AS quantity_sold,
       CAST(COALESCE(sum(ys.quantity_sold) OVER (PARTITION BY yp.id), 0) AS BIGINT) AS totali
FROM year_products yp LEFT JOIN year_sales ys ON yp.id = ys.product_id""",
                           ("products", "suppliers", "event_products", "fairs", "event_sales"),
                           _YEAR_PRODUCTS + "," + _YEAR_SALES),
    "event_list": sql(f"""
SELECT monthname(start_date) AS periodo, start_date AS data_inizio, end_date AS data_fine,
       name AS nome, location AS localita, description AS descrizione, id
FROM {_FAIRS_Y} f""", ("fairs",)),
    "offer_counts": sql(f"""
SELECT CAST(count_if(category = '{P['offer_helmets']}') AS BIGINT) AS caschi,
       CAST(count_if(category = '{P['offer_sunglasses']}') AS BIGINT) AS occhiali
FROM year_products""",
                        ("products", "suppliers", "event_products", "fairs"), _YEAR_PRODUCTS),
    "prize_template": sql(f"""
SELECT name AS nome, CAST(NULL AS VARCHAR) AS modello, CAST(NULL AS VARCHAR) AS modello_1,
       CAST(NULL AS VARCHAR) AS prezzo, CAST(NULL AS VARCHAR) AS totale FROM {_FAIRS_Y} f""",
                          ("fairs",)),
    "safe_report_name": sql(r"""
SELECT id, regexp_replace(name, '[^\p{L}\p{N}]', '_', 'g') || '_' || CAST(id AS VARCHAR) || '.xlsx'
       AS report_name FROM fairs""", ("fairs",)),
}


def _ledger_ctes(opening_sql: str | None, source: str = "movements",
                 carry: tuple[str, ...] = ("reference", "notes", '"user"', "ts")) -> str:
    """Recursive fold of stock movements per product (``source`` has seq,
    product_id, transaction_type, quantity), one row per step, ending in a
    ``decisions`` CTE."""
    if opening_sql is None:
        op = f"(SELECT DISTINCT product_id, CAST(0 AS BIGINT) AS opening FROM {source})"
    else:
        op = opening_sql
    carried = "".join(f", m.{c}" for c in carry)
    ties = "".join(f", mv.{c} NULLS FIRST" for c in carry)
    return f"""
op AS {op},
m AS (
  SELECT mv.*, op.opening, op.opening IS NOT NULL AS known,
         row_number() OVER (PARTITION BY mv.product_id ORDER BY mv.seq NULLS FIRST,
             mv.transaction_type NULLS FIRST, mv.quantity NULLS FIRST{ties}) AS rn,
         CASE WHEN mv.transaction_type IS NULL OR mv.transaction_type NOT IN ('in', 'out')
                   THEN 'invalid_type'
              WHEN mv.quantity IS NULL OR mv.quantity <= 0 THEN 'invalid_quantity'
              WHEN op.opening IS NULL AND mv.transaction_type = 'out' THEN 'unknown_product'
         END AS static_reason
  FROM {source} mv LEFT JOIN op ON mv.product_id = op.product_id),
r AS (
  SELECT product_id, rn,
         CASE WHEN static_reason IS NOT NULL THEN static_reason
              WHEN transaction_type = 'out' AND opening < quantity THEN 'insufficient_stock'
         END AS reason,
         CASE WHEN NOT known THEN NULL
              WHEN static_reason IS NOT NULL THEN opening
              WHEN transaction_type = 'in' THEN opening + quantity
              WHEN opening >= quantity THEN opening - quantity ELSE opening END AS balance
  FROM m WHERE rn = 1
  UNION ALL
  SELECT m.product_id, m.rn,
         CASE WHEN m.static_reason IS NOT NULL THEN m.static_reason
              WHEN m.transaction_type = 'out' AND r.balance < m.quantity
                   THEN 'insufficient_stock' END,
         CASE WHEN NOT m.known THEN NULL
              WHEN m.static_reason IS NOT NULL THEN r.balance
              WHEN m.transaction_type = 'in' THEN r.balance + m.quantity
              WHEN r.balance >= m.quantity THEN r.balance - m.quantity ELSE r.balance END
  FROM r JOIN m ON m.product_id = r.product_id AND m.rn = r.rn + 1),
decisions AS (
  SELECT m.seq, m.product_id, m.transaction_type, m.quantity{carried},
         r.reason IS NULL AS accepted, r.reason, r.balance AS balance_after
  FROM r JOIN m ON m.product_id = r.product_id AND m.rn = r.rn)"""


_INV_OPENING = """(SELECT product_id, CAST(sum(quantity) AS BIGINT) AS opening
                    FROM inventory GROUP BY product_id)"""

ORACLE.update({
    "apply_ledger": sql("SELECT * FROM decisions", ("movements", "inventory"),
                        _ledger_ctes(_INV_OPENING), recursive=True),
    "ledger_by_day": sql("SELECT * FROM decisions", ("movements", "inventory"), """
daily AS (SELECT * REPLACE (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS seq) FROM movements),
""" + _ledger_ctes(_INV_OPENING, source="daily").strip(), recursive=True),
    "stock_on_hand": sql("""
SELECT op.product_id, CAST(op.opening + COALESCE(d.net, 0) AS BIGINT) AS quantity
FROM op LEFT JOIN (SELECT product_id,
                          sum(CASE WHEN transaction_type = 'in' THEN quantity ELSE -quantity END)
                              AS net
                   FROM decisions WHERE accepted GROUP BY product_id) d
       ON op.product_id = d.product_id""", ("movements", "inventory"),
                         _ledger_ctes(_INV_OPENING), recursive=True),
    "stock_log_rows": sql("""
SELECT seq AS id, CASE WHEN transaction_type = 'in' THEN 'stock_in' ELSE 'stock_out' END
           AS event_type,
       CASE WHEN transaction_type = 'in' THEN 'Added ' || quantity || ' units to stock'
            ELSE 'Removed ' || quantity || ' units from stock' END AS description,
       seq AS related_id, ts AS event_date, "user"
FROM decisions WHERE accepted""", ("movements", "inventory"), _ledger_ctes(_INV_OPENING),
                          recursive=True),
    "ledger_from_zero": sql("""
SELECT transaction_type, accepted, reason, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units
FROM decisions GROUP BY transaction_type, accepted, reason""", ("movements",),
                            _ledger_ctes(None), recursive=True),
})


_T_US = 1_800_000_000
_CLEAN = "regexp_replace({c}, '[^0-9]', '', 'g')"
_SCAN_CTES = f"""
sc AS (SELECT scan_id, scanner_id, ts, barcode,
              {_CLEAN.format(c='barcode')} AS code FROM scans),
v AS (SELECT *, {sql_valid_barcode('code')} AS valid FROM sc),
vv AS (SELECT *, row_number() OVER (PARTITION BY scanner_id ORDER BY ts, scan_id) AS rn
       FROM v WHERE valid),
r AS (
  SELECT scanner_id, rn, FALSE AS duplicate, code AS a_code, epoch_us(ts) AS a_us
  FROM vv WHERE rn = 1
  UNION ALL
  SELECT vv.scanner_id, vv.rn,
         (vv.code = r.a_code AND epoch_us(vv.ts) - r.a_us < {_T_US}),
         CASE WHEN vv.code = r.a_code AND epoch_us(vv.ts) - r.a_us < {_T_US}
              THEN r.a_code ELSE vv.code END,
         CASE WHEN vv.code = r.a_code AND epoch_us(vv.ts) - r.a_us < {_T_US}
              THEN r.a_us ELSE epoch_us(vv.ts) END
  FROM r JOIN vv ON vv.scanner_id = r.scanner_id AND vv.rn = r.rn + 1),
dedupe AS (
  SELECT vv.scanner_id, vv.ts, vv.barcode, vv.scan_id, vv.code, vv.valid, r.duplicate
  FROM vv JOIN r ON vv.scanner_id = r.scanner_id AND vv.rn = r.rn
  UNION ALL
  SELECT scanner_id, ts, barcode, scan_id, code, valid, CAST(NULL AS BOOLEAN) FROM v
  WHERE NOT valid)"""

_VARIANTS = """
variants AS (
  SELECT id, 'ean13' AS variant, ean_upc AS raw FROM products WHERE ean_upc IS NOT NULL
  UNION ALL SELECT id, 'upc12', substr(ean_upc, 2, 12) FROM products WHERE ean_upc IS NOT NULL
  UNION ALL SELECT id, 'ean8', substr(ean_upc, 6, 8) FROM products WHERE ean_upc IS NOT NULL
  UNION ALL SELECT id, 'gtin14', '1' || ean_upc FROM products WHERE ean_upc IS NOT NULL
  UNION ALL SELECT id, 'short', substr(ean_upc, 8, 6) FROM products WHERE ean_upc IS NOT NULL)"""

_BATCH = f"""
sc AS (SELECT scanner_id, ts, barcode, scan_id, {_CLEAN.format(c='barcode')} AS code FROM scans),
v AS (SELECT *, {sql_valid_barcode('code')} AS valid FROM sc),
b AS (SELECT v.*, sp.id AS product_id, sp.sku, sp.name, sp.quantity
      FROM v LEFT JOIN {_STOCKED} sp ON v.valid AND v.code = sp.ean_upc)"""

ORACLE.update({
    "barcode_clean": sql(f"SELECT scan_id, barcode, {_CLEAN.format(c='barcode')} AS code "
                         "FROM scans", ("scans",)),
    "barcode_valid": sql(f"""
SELECT id, variant, raw, {sql_valid_barcode(_CLEAN.format(c='raw'))} AS valid FROM variants""",
                         ("products",), _VARIANTS),
    "barcode_check_digit": sql(f"""
SELECT id, {sql_check_digit('substr(ean_upc, 1, 12)', 12)} AS cd_body12,
       {sql_check_digit('substr(ean_upc, 2, 11)', 11)} AS cd_body11,
       {sql_check_digit('substr(ean_upc, 6, 7)', 7)} AS cd_body7
FROM products WHERE ean_upc IS NOT NULL""", ("products",)),
    "scan_dedupe": sql("SELECT * FROM dedupe", ("scans",), _SCAN_CTES, recursive=True),
    "scan_lookup": sql(f"""
SELECT d.scanner_id, d.ts, d.barcode, d.scan_id, d.code,
       CASE WHEN NOT d.valid THEN 'invalid' WHEN d.duplicate THEN 'duplicate'
            WHEN sp.id IS NOT NULL THEN 'found' ELSE 'not_found' END AS status,
       CASE WHEN d.valid THEN sp.id END AS product_id,
       CASE WHEN d.valid THEN sp.sku END AS sku,
       CASE WHEN d.valid THEN sp.name END AS name,
       CASE WHEN d.valid THEN sp.quantity END AS quantity
FROM dedupe d LEFT JOIN {_STOCKED} sp ON d.code = sp.ean_upc""",
                       ("scans", "products", "inventory"), _SCAN_CTES, recursive=True),
    "batch_scan_summary": sql("""
SELECT scanner_id, count(*) AS total,
       CAST(count_if(valid AND product_id IS NOT NULL) AS BIGINT) AS found,
       CAST(count_if(valid AND product_id IS NULL) AS BIGINT) AS not_found,
       CAST(count_if(NOT valid) AS BIGINT) AS invalid
FROM b GROUP BY scanner_id""", ("scans", "products", "inventory"), _BATCH),
    "batch_scan_products": sql("SELECT * FROM b WHERE product_id IS NOT NULL",
                               ("scans", "products", "inventory"), _BATCH),
})


_AVAIL = """avail AS (SELECT product_id,
                          CAST(sum(quantity) - sum(COALESCE(reserved, 0)) AS BIGINT) AS available
                   FROM inventory GROUP BY product_id)"""

_BATCH_DECISIONS = _AVAIL + """,
bd AS (
  SELECT r.*, a.available,
         CAST(sum(r.quantity) OVER (PARTITION BY r.batch_id, r.product_id ORDER BY r.seq
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
             AS cum_quantity
  FROM allocation_requests r LEFT JOIN avail a ON r.product_id = a.product_id),
bd2 AS (
  SELECT *, CASE WHEN quantity IS NULL OR quantity <= 0 THEN 'invalid_quantity'
                 WHEN available IS NULL THEN 'unknown_product'
                 WHEN cum_quantity > available THEN 'insufficient_stock' END AS reason
  FROM bd),
batch_decisions AS (
  SELECT *, bool_and(reason IS NULL) OVER (PARTITION BY batch_id) AS batch_accepted FROM bd2)"""

#: Batches one after the other, in rounds: an open batch is taken (1) when it fits even
#: if all open ones before it are, and refused (2) when one total fails counting taken ones.
_IN_TURN = _AVAIL + """,
q AS (SELECT r.*, a.available, CASE WHEN r.quantity IS NULL OR r.quantity <= 0 THEN 'invalid_quantity'
                                    WHEN a.available IS NULL THEN 'unknown_product' END AS static
      FROM allocation_requests r LEFT JOIN avail a ON r.product_id = a.product_id),
b AS (SELECT batch_id, row_number() OVER (ORDER BY min(seq), batch_id) AS i,
             bool_or(static IS NOT NULL) AS bad FROM q GROUP BY batch_id),
tot AS (SELECT b.i, q.product_id AS p, any_value(q.available) AS have, CAST(sum(q.quantity) AS BIGINT) AS total
        FROM q JOIN b ON q.batch_id = b.batch_id WHERE NOT b.bad GROUP BY b.i, q.product_id),
turns AS (
  SELECT 0 AS k, i, p, have, total, 0 AS st FROM tot
  UNION ALL
  SELECT k + 1, i, p, have, total,
         CASE WHEN st = 0 AND bool_or(fails) OVER (PARTITION BY i) THEN 2
              WHEN st = 0 AND bool_and(fits) OVER (PARTITION BY i) THEN 1 ELSE st END
  FROM (SELECT *, min(st) OVER () AS least,
               sum(CASE WHEN st < 2 THEN total ELSE 0 END) OVER (PARTITION BY p ORDER BY i) <= have AS fits,
               sum(CASE WHEN st = 1 THEN total ELSE 0 END) OVER (PARTITION BY p ORDER BY i)
                   + CASE WHEN st = 1 THEN 0 ELSE total END > have AS fails
        FROM turns) WHERE least = 0),
verdict AS (SELECT i, p, st = 1 AS ok,
                   have - sum(CASE WHEN st = 1 THEN total ELSE 0 END) OVER (PARTITION BY p ORDER BY i)
                        + CASE WHEN st = 1 THEN total ELSE 0 END AS lft
            FROM turns WHERE k = (SELECT max(k) FROM turns)),
in_turn AS (
  SELECT q.* EXCLUDE (static),
         CASE WHEN b.bad THEN q.static
              WHEN sum(q.quantity) OVER (PARTITION BY q.batch_id, q.product_id ORDER BY q.seq
                                         ROWS UNBOUNDED PRECEDING) > v.lft
              THEN 'insufficient_stock' END AS reason, COALESCE(v.ok, FALSE) AS batch_accepted
  FROM q JOIN b ON q.batch_id = b.batch_id LEFT JOIN verdict v ON v.i = b.i AND v.p = q.product_id)"""

_PARSE_Q = r"""CASE WHEN regexp_full_match(trim(raw_quantity), '[+-]?[0-9]+')
                   THEN TRY_CAST(trim(raw_quantity) AS BIGINT)
              WHEN regexp_full_match(trim(raw_quantity),
                                     '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
                   THEN CAST(trunc(CAST(trim(raw_quantity) AS DOUBLE)) AS BIGINT) END"""

_Q = "'"  # a quote inside SQL text literals
_ROWS = _AVAIL + f""",
sheet AS ({allocation_sheet_sql()}),
by_sku AS (SELECT sku, min(id) AS product_id FROM products WHERE sku IS NOT NULL GROUP BY sku),
s0 AS (SELECT sh.event_id, sh.seq, sh."SKU" AS sku, sh."Quantity" AS raw_quantity,
              TRY_CAST(sh."Sale Price" AS DOUBLE) AS sale_price, b.product_id
       FROM sheet sh LEFT JOIN by_sku b ON sh."SKU" = b.sku),
s1 AS (SELECT *, {_PARSE_Q} AS quantity,
              row_number() OVER (ORDER BY event_id NULLS FIRST, seq NULLS FIRST, sku NULLS FIRST,
                                 raw_quantity NULLS FIRST, sale_price NULLS FIRST) AS n FROM s0),
s2 AS (SELECT *, CASE WHEN quantity IS NULL THEN 'invalid_quantity'
                      WHEN product_id IS NULL THEN 'unknown_sku'
                      WHEN quantity <= 0 THEN 'not_positive' END AS static FROM s1),
moves AS (SELECT n AS seq, product_id, 'out' AS transaction_type, quantity FROM s2
          WHERE static IS NULL),
""" + _ledger_ctes("""(SELECT p.id AS product_id, CAST(COALESCE(a.available, 0) AS BIGINT) AS opening
                       FROM products p LEFT JOIN avail a ON p.id = a.product_id)""",
                   source="moves", carry=()) + f""",
rows_out AS (
  SELECT s2.event_id, s2.seq, sku, raw_quantity,
         s2.quantity, sale_price, s2.product_id,
         COALESCE(d.accepted, FALSE) AS accepted,
         CASE WHEN static IS NOT NULL THEN static WHEN NOT d.accepted THEN 'insufficient_stock'
         END AS reason,
         CASE WHEN static = 'invalid_quantity'
                   THEN 'Error importing SKU {_Q}{_Q}' || COALESCE(sku, 'nan')
                        || '{_Q}{_Q}: invalid literal for int() with base 10: {_Q}{_Q}'
                        || COALESCE(raw_quantity, 'nan') || '{_Q}{_Q}'
              WHEN static = 'unknown_sku'
                   THEN 'Product with SKU {_Q}{_Q}' || COALESCE(sku, 'nan') || '{_Q}{_Q} not found'
              WHEN static = 'not_positive'
                   THEN 'Error importing SKU {_Q}{_Q}' || COALESCE(sku, 'nan')
                        || '{_Q}{_Q}: quantity must be positive'
              WHEN NOT d.accepted
                   THEN 'Error importing SKU {_Q}{_Q}' || COALESCE(sku, 'nan')
                        || '{_Q}{_Q}: Not enough stock for product ID ' || s2.product_id
                        || '. Available: ' || d.balance_after || ', Requested: ' || s2.quantity
         END AS error
  FROM s2 LEFT JOIN decisions d ON s2.n = d.seq)"""

_REASSIGN = _AVAIL + """,
req AS (SELECT q.seq, q.event_id, q.product_id, ep.quantity_assigned AS current_quantity,
               q.new_quantity, q.new_quantity - ep.quantity_assigned AS delta
        FROM quantity_true_up q LEFT JOIN event_products ep
          ON q.event_id = ep.event_id AND q.product_id = ep.product_id),
moves AS (SELECT seq, product_id, CASE WHEN delta > 0 THEN 'out' ELSE 'in' END AS transaction_type,
                 abs(delta) AS quantity
          FROM req WHERE current_quantity IS NOT NULL AND delta <> 0),
""" + _ledger_ctes("(SELECT product_id, available AS opening FROM avail)", source="moves",
                   carry=())

_UNASSIGN = """
ureq AS (SELECT DISTINCT event_id, product_id FROM event_sales)"""

ORACLE.update({
    "allocate_batch": sql("SELECT * FROM batch_decisions", ("inventory", "allocation_requests"),
                          _BATCH_DECISIONS),
    "allocate_batches": sql("SELECT * FROM in_turn", ("inventory", "allocation_requests"), _IN_TURN,
                            recursive=True),
    "allocation_snapshot": sql("""
SELECT COALESCE(a.id, (SELECT COALESCE(max(id), 0) FROM event_products)::BIGINT
                      + sum(CASE WHEN a.id IS NULL THEN 1 END) OVER (
                            ORDER BY d.event_id, d.product_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT) AS id,
       COALESCE(a.event_id, d.event_id) AS event_id,
       COALESCE(a.product_id, d.product_id) AS product_id,
       CAST(COALESCE(a.quantity_assigned, 0) + COALESCE(d.add_q, 0) AS BIGINT) AS quantity_assigned,
       COALESCE(d.price, a.event_sale_price) AS event_sale_price
FROM event_products a FULL OUTER JOIN
     (SELECT event_id, product_id, sum(quantity) AS add_q,
             arg_max(sale_price, seq) FILTER (WHERE sale_price IS NOT NULL) AS price
      FROM batch_decisions WHERE batch_accepted GROUP BY event_id, product_id) d
  ON a.event_id = d.event_id AND a.product_id = d.product_id""",
                               ("inventory", "allocation_requests", "event_products"),
                               _BATCH_DECISIONS),
    "allocate_rows": sql("SELECT * FROM rows_out", ("products", "inventory"), _ROWS,
                         recursive=True),
    "allocate_sheets": sql("SELECT * FROM rows_out", ("products", "inventory"), _ROWS.replace(
        "sheet AS (", "sheet AS (SELECT * REPLACE (seq // 10000000 % 100 AS seq) FROM (", 1).replace(
        "),\nby_sku", ")),\nby_sku", 1), recursive=True),
    "allocate_rows_summary": sql("""
SELECT CAST(count_if(accepted) AS BIGINT) AS imported,
       CAST(count_if(error IS NOT NULL) AS BIGINT) AS errors FROM rows_out""",
                                 ("products", "inventory"), _ROWS, recursive=True),
    "allocate_rows_assignments": sql("""
SELECT COALESCE(a.id, (SELECT COALESCE(max(id), 0) FROM event_products)::BIGINT
                      + sum(CASE WHEN a.id IS NULL THEN 1 END) OVER (
                            ORDER BY d.event_id, d.product_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT) AS id,
       COALESCE(a.event_id, d.event_id) AS event_id,
       COALESCE(a.product_id, d.product_id) AS product_id,
       CAST(COALESCE(a.quantity_assigned, 0) + COALESCE(d.add_q, 0) AS BIGINT) AS quantity_assigned,
       COALESCE(d.price, a.event_sale_price) AS event_sale_price
FROM event_products a FULL OUTER JOIN
     (SELECT event_id, product_id, sum(quantity) AS add_q,
             arg_max(sale_price, seq) FILTER (WHERE sale_price IS NOT NULL) AS price
      FROM rows_out WHERE accepted GROUP BY event_id, product_id) d
  ON a.event_id = d.event_id AND a.product_id = d.product_id""",
                                     ("products", "inventory", "event_products"), _ROWS, recursive=True),
    "reassigned_assignments": sql("""
SELECT ep.* REPLACE (CASE WHEN d.accepted OR req.delta = 0 THEN req.new_quantity
                          ELSE ep.quantity_assigned END AS quantity_assigned)
FROM event_products ep
LEFT JOIN req ON req.event_id = ep.event_id AND req.product_id = ep.product_id
LEFT JOIN decisions d ON req.seq = d.seq""",
                                  ("inventory", "event_sales", "event_products", "quantity_true_up"),
                                  _REASSIGN, recursive=True),
    "unassign_assignments": sql("""
SELECT ep.* FROM event_products ep
WHERE NOT EXISTS (SELECT 1 FROM ureq r WHERE r.event_id = ep.event_id AND r.product_id = ep.product_id)""",
                                ("event_sales", "event_products"), _UNASSIGN),
    "create_fairs": sql("""
SELECT * FROM fairs
UNION ALL
SELECT (SELECT COALESCE(max(id), 0) FROM fairs) + row_number() OVER (ORDER BY start_date, name) AS id, *
FROM (SELECT name || ' again' AS name, CAST(start_date + INTERVAL 12 MONTH AS DATE) AS start_date,
             CAST(end_date + INTERVAL 12 MONTH AS DATE) AS end_date, location, description FROM fairs) f""",
                        ("fairs",)),
    "assign_products": sql("""
SELECT id, event_id, product_id, quantity_assigned, event_sale_price FROM event_products
UNION ALL
SELECT (SELECT COALESCE(max(id), 0) FROM event_products) + row_number() OVER (ORDER BY event_id, product_id),
       event_id, product_id, CAST(q AS BIGINT), CAST(NULL AS DOUBLE)
FROM (SELECT event_id, product_id, sum(quantity) AS q FROM event_sales GROUP BY event_id, product_id) s
WHERE NOT EXISTS (SELECT 1 FROM event_products ep
                  WHERE ep.event_id = s.event_id AND ep.product_id = s.product_id)""",
                           ("event_sales", "event_products")),
    "append_sales": sql("""
SELECT event_id, product_id, quantity, sale_price, sale_date FROM event_sales
UNION ALL
SELECT event_id, product_id, quantity, sale_price, sale_date FROM returned_sales r
WHERE quantity > 0 AND EXISTS (SELECT 1 FROM event_products k
                               WHERE k.event_id = r.event_id AND k.product_id = r.product_id)""",
                        ("event_sales", "returned_sales", "event_products")),
    "reassign_quantity": sql("""
SELECT req.seq, req.event_id, req.product_id, current_quantity, new_quantity, delta,
       CASE WHEN current_quantity IS NULL THEN FALSE WHEN delta = 0 THEN TRUE
            ELSE d.accepted END AS accepted,
       CASE WHEN current_quantity IS NULL THEN 'not_assigned' WHEN delta = 0 THEN NULL
            ELSE d.reason END AS reason,
       d.balance_after AS available_after
FROM req LEFT JOIN decisions d ON req.seq = d.seq""",
                             ("inventory", "event_sales", "event_products", "quantity_true_up"),
                             _REASSIGN, recursive=True),
    "unassign_product": sql("""
SELECT r.event_id, r.product_id, ep.quantity_assigned AS released,
       ep.quantity_assigned IS NOT NULL AS accepted,
       CASE WHEN ep.quantity_assigned IS NULL THEN 'not_assigned' END AS reason
FROM ureq r LEFT JOIN event_products ep
  ON r.event_id = ep.event_id AND r.product_id = ep.product_id""",
                            ("event_sales", "event_products"), _UNASSIGN),
    "unassign_available": sql("""
SELECT a.product_id, CAST(a.available + COALESCE(b.back, 0) AS BIGINT) AS available
FROM avail a LEFT JOIN (SELECT ep.product_id, sum(ep.quantity_assigned) AS back
                        FROM event_products ep JOIN ureq r
                          ON r.event_id = ep.event_id AND r.product_id = ep.product_id
                        GROUP BY ep.product_id) b ON a.product_id = b.product_id""",
                              ("inventory", "event_sales", "event_products"),
                              _AVAIL + "," + _UNASSIGN),
    "update_event": sql(f"""
SELECT * REPLACE (CASE WHEN id = {P['edit_event_id']} THEN '{P['edit_value']}'
                       ELSE {P['edit_column']} END AS {P['edit_column']})
FROM annual_events""", ("annual_events",)),
    "delete_event": sql(f"SELECT * FROM annual_events WHERE id IS DISTINCT FROM "
                        f"{P['edit_event_id']}",
                        ("annual_events",)),
    "create_events": sql("""
SELECT * FROM annual_events
UNION ALL BY NAME
SELECT (SELECT COALESCE(max(id), 0) FROM annual_events) + row_number() OVER (ORDER BY f.id) AS id,
       f.name AS nome, strftime(f.start_date, '%Y-%m-%d') AS data, f.location AS localita
FROM fairs f""", ("annual_events", "fairs")),
    "record_sales": sql("""
SELECT r.*, reason IS NULL AS accepted FROM (
  SELECT r.*, CASE WHEN r.quantity IS NULL OR r.quantity <= 0 THEN 'invalid_quantity'
                   WHEN k.event_id IS NULL THEN 'not_assigned' END AS reason
  FROM returned_sales r LEFT JOIN (SELECT DISTINCT event_id, product_id FROM event_products) k
    ON r.event_id = k.event_id AND r.product_id = k.product_id) r""",
                        ("returned_sales", "event_products")),
})


# -- price-list import ---------------------------------------------------------

from stockfair.operators import ingest as _ing  # noqa: E402
from stockfair.sources.driver import PRICE_LIST_FILES as _FILES  # noqa: E402


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _price_list_lines_sql() -> str:
    k, v = "p_partkey", "p_partkey % 10"
    fid = "CAST(floor(p_partkey / 25) % 4 AS INTEGER)"
    file = f"({_sql_list(_FILES)})[{fid} + 1]"
    ks = f"CAST({k} AS VARCHAR)"
    article = (f"CASE WHEN {v} IN (0, 8) THEN 'NEW' || {ks} "
               f"WHEN {v} = 5 THEN 'NEW' || CAST({k} - 5 AS VARCHAR) WHEN {v} = 6 THEN '' "
               f"ELSE 'SKU' || {sql_padded('p_partkey', 6)} END")
    ean = (f"CASE WHEN {v} IN (0, 8) THEN '81' || lpad({ks}, 11, '0') "
           f"WHEN {v} IN (1, 3, 4, 7) AND {k} % 11 <> 0 THEN {sql_ean_for_part(k)} ELSE '' END")
    price = "CAST(p_retailprice AS DECIMAL(18,2))"
    dealer = (f"CASE WHEN {v} = 4 THEN 'n/a' ELSE CAST(CAST(round({price} * CAST(0.5 AS DECIMAL(2,1)), 2) "
              f"AS DECIMAL(18,2)) AS VARCHAR) END")
    status = f"CASE WHEN {k} % 3 = 0 THEN 'discontinued' ELSE 'active' END"
    brand = f"CASE WHEN {fid} = 1 THEN 'BIS Srl' ELSE p_brand END"
    descr = f"CASE WHEN {v} = 7 THEN '' ELSE p_brand || ' ' || p_type END"

    def line(model, retail):
        return (f"{article} || ',' || {ean} || ',' || {model} || "
                f"CASE WHEN {fid} <> 3 THEN ',' || {descr} ELSE '' END || ',' || {dealer} "
                f"|| ',' || {retail} || ',' || {status} || ',' || p_type || ',' || {brand} || "
                f"CASE WHEN {fid} = 0 THEN ',' ELSE '' END")

    model = f"CASE WHEN {v} = 3 THEN '' ELSE p_name END"
    retail = f"CAST({price} AS VARCHAR)"
    header = ("'Article #,EAN Code,Model Name' || CASE WHEN fid <> 3 THEN ',Description' ELSE '' END "
              "|| ',Dealer Price,Suggested Retail,Status,Product Line,Brand' || "
              "CASE WHEN fid = 0 THEN ',Notes' ELSE '' END")
    return f"""
    SELECT {file} AS file, CAST({k} * 2 + 10 AS BIGINT) AS line_no, {line(model, retail)} AS line
    FROM part
    UNION ALL
    SELECT {file}, CAST({k} * 2 + 11 AS BIGINT), {line("p_name || ' v2'",
                                                       f"CAST(CAST({price} + 1 AS DECIMAL(18,2)) AS VARCHAR)")}
    FROM part WHERE {v} = 0
    UNION ALL
    SELECT file, CAST(x.line_no AS BIGINT), x.line FROM (
      SELECT file, fid, unnest([{{'line_no': 0, 'line': 'Listino prezzi 2025'}},
                                {{'line_no': 1, 'line': ''}},
                                {{'line_no': 2, 'line': {header}}}]) AS x
      FROM (SELECT DISTINCT {fid} AS fid, {file} AS file FROM part) f) h"""


VIEWS["price_list_lines"] = _price_list_lines_sql()
VIEWS["recoded_lines"] = f"""
    {_price_list_lines_sql()}
    UNION ALL SELECT DISTINCT 'zz_recoded.csv', CAST(0 AS BIGINT), 'SKU,EAN Code,Name' FROM part
    UNION ALL SELECT 'zz_recoded.csv', CAST(p_partkey * 2 + 10 AS BIGINT),
                     'SKU' || {sql_padded('p_partkey', 6)} || ',82' || {sql_padded('p_partkey', 11)} || ',' || p_name
              FROM part WHERE p_partkey % 10 = 1
    UNION ALL SELECT 'zz_recoded.csv', CAST(p_partkey * 2 + 11 AS BIGINT),
                     'MOVED' || CAST(p_partkey AS VARCHAR) || ',' || {sql_ean_for_part('p_partkey')} || ',' || p_name || ' moved'
              FROM part WHERE p_partkey % 10 = 1"""

_KW = "|".join(_ing.HEADER_KEYWORDS)


def _first_supplier(text: str) -> str:
    whens = " ".join(f"WHEN contains({text}, '{p}') THEN '{n}'" for p, n in _ing.SUPPLIER_PATTERNS)
    return f"CASE {whens} END"


def _field_rank(field_patterns) -> str:
    whens = " ".join(f"WHEN contains(lower(\"column\"), '{p}') THEN {i}"
                     for i, p in enumerate(field_patterns))
    return f"CASE {whens} END"


_MAPPING_UNION = "\n  UNION ALL\n".join(
    f"""  SELECT file, '{f}' AS field, arg_min("column", rk) AS "column", arg_min(col, rk) AS col
  FROM (SELECT *, {_field_rank(ps)} * 1000000 + col AS rk FROM dcols) x
  WHERE rk IS NOT NULL GROUP BY file""" for f, ps in _ing.FIELD_PATTERNS)

#: ``landed`` (n, own, top) from ``own_rows`` and ``own_products``: what rows and products
#: are tied by codes is walked row by row, a list of (product, codes) being the state.
OWNERSHIP = """
holds AS (SELECT 'r' || n AS node, unnest(['e' || ean_upc, 's' || sku]) AS code FROM own_rows
          UNION ALL SELECT 'p' || id, unnest(['e' || ean_upc, 's' || sku]) FROM own_products
          WHERE ean_upc IN (SELECT ean_upc FROM own_rows) OR sku IN (SELECT sku FROM own_rows)),
tied AS (SELECT node, code FROM holds WHERE code IS NOT NULL
         UNION
         SELECT t.node, b.code FROM tied t JOIN holds a ON t.code = a.code JOIN holds b ON a.node = b.node
         WHERE b.code IS NOT NULL),
tie AS (SELECT node, min(code) AS tie FROM tied GROUP BY node),
at_top AS (SELECT COALESCE(max(id), 0) AS top FROM own_products),
turn AS (SELECT r.*, COALESCE(t.tie, 'r' || r.n) AS tie,
                row_number() OVER (PARTITION BY COALESCE(t.tie, 'r' || r.n) ORDER BY r.n) AS k
         FROM own_rows r LEFT JOIN tie t ON t.node = 'r' || r.n),
state AS (
  SELECT c.tie, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS own,
         list({'own': CAST(p.id AS BIGINT), 'ean': p.ean_upc, 'sku': p.sku} ORDER BY p.id)
             FILTER (p.id IS NOT NULL) AS st
  FROM (SELECT DISTINCT tie FROM turn) c LEFT JOIN tie t ON t.tie = c.tie AND t.node LIKE 'p%'
  LEFT JOIN own_products p ON t.node = 'p' || p.id GROUP BY c.tie
  UNION ALL
  SELECT tie, k, n, own,
         CASE WHEN hit IS NULL
              THEN list_append(COALESCE(st, []), {'own': own, 'ean': ean_upc, 'sku': sku})
              ELSE list_transform(st, lambda x: CASE WHEN x.own = own THEN
                  {'own': own, 'ean': CASE WHEN writes_ean THEN ean_upc ELSE x.ean END,
                   'sku': CASE WHEN writes_sku THEN sku ELSE x.sku END} ELSE x END) END
  FROM (SELECT *, CAST(COALESCE(hit, (SELECT top FROM at_top) + n) AS BIGINT) AS own FROM (
          SELECT s.tie, t.k, t.n, t.ean_upc, t.sku, t.writes_ean, t.writes_sku, s.st,
                 COALESCE(list_filter(s.st, lambda x: x.ean = t.ean_upc)[1].own,
                          list_filter(s.st, lambda x: x.sku = t.sku)[1].own) AS hit
          FROM state s JOIN turn t ON t.tie = s.tie AND t.k = s.k + 1))),
landed AS (SELECT n, own, (SELECT top FROM at_top) AS top FROM state WHERE n IS NOT NULL)"""

_IMPORT = f"""
cells AS (
  SELECT file, line_no, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS col,
         NULLIF(unnest(arr), '') AS cell
  FROM (SELECT *, string_split(line, ',') AS arr FROM price_list_lines) l),
ranked AS (SELECT file, line_no,
                  row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS row
           FROM price_list_lines),
hits AS (
  SELECT c.file, c.line_no, r.row,
         count_if(regexp_matches(lower(COALESCE(c.cell, 'nan')), '{_KW}')) AS hits
  FROM cells c JOIN ranked r ON c.file = r.file AND c.line_no = r.line_no
  WHERE r.row < {_ing.HEADER_WINDOW} GROUP BY c.file, c.line_no, r.row),
header AS (
  SELECT d.file, CAST(COALESCE(h.hrow, 0) AS BIGINT) AS header_row,
         COALESCE(h.hline, d.line_no) AS header_line
  FROM (SELECT file, line_no FROM ranked WHERE row = 0) d
  LEFT JOIN (SELECT file, min(row) AS hrow, arg_min(line_no, row) AS hline FROM hits
             WHERE hits >= {_ing.HEADER_MIN_HITS} GROUP BY file) h ON d.file = h.file),
head AS (SELECT c.file, c.col, c.cell FROM cells c JOIN header h
         ON c.file = h.file AND c.line_no = h.header_line),
data AS (SELECT c.* FROM cells c JOIN header h ON c.file = h.file AND c.line_no > h.header_line),
filled AS (SELECT DISTINCT file, col FROM data WHERE cell IS NOT NULL),
labels AS (SELECT file, col, COALESCE(cell, 'Unnamed: ' || CAST(col AS VARCHAR)) AS label
           FROM head),
dcols AS (
  SELECT l.file, l.col, CASE WHEN rn = 0 THEN label ELSE label || '.' || CAST(rn AS VARCHAR) END
             AS "column"
  FROM (SELECT *, row_number() OVER (PARTITION BY file, label ORDER BY col) - 1 AS rn
        FROM labels) l
  WHERE EXISTS (SELECT 1 FROM filled f WHERE f.file = l.file AND f.col = l.col)),
mapping AS (
{_MAPPING_UNION}),
content AS (
  SELECT c.file, arg_min(s.sup, r.row * 1000000 + c.col) AS content
  FROM cells c JOIN ranked r ON c.file = r.file AND c.line_no = r.line_no,
       LATERAL (SELECT {_first_supplier("lower(COALESCE(c.cell, 'nan'))")} AS sup) s
  WHERE r.row BETWEEN 1 AND {_ing.SUPPLIER_WINDOW} AND s.sup IS NOT NULL
  GROUP BY c.file),
guess AS (
  SELECT f.file, COALESCE({_first_supplier("lower(f.file)")}, c.content,
                          regexp_replace(lower(f.file), '^(.+)\\.[^.]*$', '\\1')) AS supplier
  FROM (SELECT DISTINCT file FROM price_list_lines) f LEFT JOIN content c ON f.file = c.file),
mapped AS (SELECT file, list_sort(list(field)) AS mapped FROM mapping GROUP BY file),
dcells AS (SELECT d.file, d.line_no, m.field, d.cell FROM data d
           JOIN mapping m ON d.file = m.file AND d.col = m.col),
wide AS (
  SELECT file, line_no,
         {", ".join(f"max(CASE WHEN field = '{f}' THEN cell END) AS {f}" for f in _ing.FIELDS)}
  FROM dcells GROUP BY file, line_no),
clean AS (
  SELECT w.file, w.line_no,
         {", ".join(("CASE WHEN isnan(TRY_CAST(w.{0} AS DOUBLE)) THEN NULL "
                     "ELSE TRY_CAST(w.{0} AS DOUBLE) END AS {0}").format(f)
                    if f in _ing.PRICE_FIELDS else f"w.{f}" for f in _ing.FIELDS)},
         m.mapped
  FROM wide w JOIN mapped m ON w.file = m.file WHERE w.name IS NOT NULL),
new_sup AS (SELECT DISTINCT supplier AS name FROM guess
            WHERE supplier IS NOT NULL AND supplier NOT IN (SELECT name FROM suppliers)),
all_suppliers AS (
  SELECT id, name FROM suppliers
  UNION ALL
  SELECT (SELECT COALESCE(max(id), 0) FROM suppliers) + row_number() OVER (ORDER BY name), name
  FROM new_sup),
file_sup AS (SELECT g.file, min(s.id) AS supplier_id FROM guess g JOIN all_suppliers s
             ON g.supplier = s.name GROUP BY g.file),
matched AS (
  SELECT c.*, COALESCE(e.pid_e, s.pid_s) AS pid,
         dense_rank() OVER (ORDER BY c.file, c.line_no) AS pos
  FROM (SELECT * REPLACE (CASE WHEN trim(ean_upc) = '' THEN NULL ELSE ean_upc END AS ean_upc,
                          CASE WHEN trim(sku) = '' THEN NULL ELSE sku END AS sku) FROM clean) c
  LEFT JOIN (SELECT ean_upc, min(id) AS pid_e FROM products WHERE ean_upc IS NOT NULL
             GROUP BY ean_upc) e ON c.ean_upc = e.ean_upc
  LEFT JOIN (SELECT sku, min(id) AS pid_s FROM products WHERE sku IS NOT NULL GROUP BY sku) s
         ON c.sku = s.sku),
own_rows AS (SELECT pos AS n, ean_upc, sku, list_contains(mapped, 'ean_upc') AS writes_ean,
                    list_contains(mapped, 'sku') AS writes_sku FROM matched),
own_products AS (SELECT id, ean_upc, sku FROM products),
{OWNERSHIP},
resolved AS (
  SELECT m.* REPLACE (CASE WHEN l.own <= l.top THEN l.own END AS pid),
         CASE WHEN l.own > l.top THEN l.own - l.top END AS root
  FROM matched m JOIN landed l ON m.pos = l.n),
resolved_s AS (SELECT r.*, fs.supplier_id FROM resolved r LEFT JOIN file_sup fs
               ON r.file = fs.file)"""

_IMPORT_VIEWS = ("price_list_lines", "suppliers", "products")


def _agg_last(f: str) -> str:
    return (f"arg_max({{'v': {f}}}, pos) FILTER (WHERE list_contains(mapped, '{f}')) AS _{f}")


_UPSERT = _IMPORT + f""",
upd AS (
  SELECT pid, {", ".join(_agg_last(f) for f in _ing.PRODUCT_FIELDS)},
         arg_max(supplier_id, pos) FILTER (WHERE supplier_id IS NOT NULL) AS _supplier_id
  FROM resolved_s WHERE pid IS NOT NULL GROUP BY pid),
ins AS (
  SELECT root, {", ".join(_agg_last(f) for f in _ing.PRODUCT_FIELDS)},
         arg_max(supplier_id, pos) FILTER (WHERE supplier_id IS NOT NULL) AS _supplier_id
  FROM resolved_s WHERE pid IS NULL GROUP BY root),
base AS (SELECT *, CAST(NULL AS VARCHAR) AS status FROM products),
new_products AS (
  SELECT b.* FROM base b WHERE b.id NOT IN (SELECT pid FROM upd)
  UNION ALL BY NAME
  SELECT b.id, COALESCE(u._supplier_id, b.supplier_id) AS supplier_id,
         {", ".join(f"CASE WHEN u._{f} IS NOT NULL THEN u._{f}.v ELSE b.{f} END AS {f}"
                    for f in _ing.PRODUCT_FIELDS)}
  FROM base b JOIN upd u ON b.id = u.pid
  UNION ALL BY NAME
  SELECT (SELECT COALESCE(max(id), 0) FROM products) + row_number() OVER (ORDER BY root) AS id,
         _supplier_id AS supplier_id,
         {", ".join(f"_{f}.v AS {f}" for f in _ing.PRODUCT_FIELDS)}
  FROM ins)"""

ORACLE.update({
    "detect_header_row": sql("SELECT * FROM header", _IMPORT_VIEWS, _IMPORT, recursive=True),
    "guess_supplier": sql("SELECT * FROM guess", _IMPORT_VIEWS, _IMPORT, recursive=True),
    "detect_columns": sql("SELECT * FROM mapping", _IMPORT_VIEWS, _IMPORT, recursive=True),
    "drop_empty": sql("""
SELECT d.file, d.line_no, d.col, c."column", d.cell FROM data d
JOIN dcols c ON d.file = c.file AND d.col = c.col
WHERE EXISTS (SELECT 1 FROM data x WHERE x.file = d.file AND x.line_no = d.line_no
              AND x.cell IS NOT NULL)""", _IMPORT_VIEWS, _IMPORT, recursive=True),
    "clean_products": sql("SELECT * REPLACE (array_to_string(mapped, ',') AS mapped) FROM clean",
                          _IMPORT_VIEWS, _IMPORT, recursive=True),
    "get_or_create_supplier": sql("SELECT * FROM all_suppliers", _IMPORT_VIEWS, _IMPORT, recursive=True),
    "match_products": sql("SELECT file, line_no, ean_upc, sku, name, pid FROM matched",
                          _IMPORT_VIEWS, _IMPORT, recursive=True),
    "upsert_products": sql("SELECT * FROM new_products", _IMPORT_VIEWS, _UPSERT, recursive=True),
    "import_stats": sql("""
SELECT file, CAST(count_if(pid IS NULL AND root = pos) AS BIGINT) AS products_added,
       CAST(count_if(NOT (pid IS NULL AND root = pos)) AS BIGINT) AS products_updated
FROM resolved GROUP BY file""", _IMPORT_VIEWS, _IMPORT, recursive=True),
    "upsert_recoded": sql("SELECT * FROM new_products", ("recoded_lines", "suppliers", "products"),
                          _UPSERT.replace("price_list_lines", "recoded_lines"), recursive=True),
    "import_stats_recoded": sql("""
SELECT file, CAST(count_if(pid IS NULL AND root = pos) AS BIGINT) AS products_added,
       CAST(count_if(NOT (pid IS NULL AND root = pos)) AS BIGINT) AS products_updated
FROM resolved GROUP BY file""", ("recoded_lines", "suppliers", "products"),
                                _IMPORT.replace("price_list_lines", "recoded_lines"), recursive=True),
    "init_inventory": sql("""
SELECT id AS product_id, CAST(0 AS BIGINT) AS quantity FROM new_products
WHERE id NOT IN (SELECT id FROM products)""", _IMPORT_VIEWS, _UPSERT, recursive=True),
})


# -- event sheet import, profile, constraints -------------------------------------------

def _event_sheet_sql() -> str:
    k = "o_orderkey"
    total = "CAST(o_totalprice AS DECIMAL(18,2))"
    return f"""
    SELECT {k} AS _row, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS "Periodo",
           CASE WHEN {k} % 97 = 0 THEN 'uno' ELSE '1' END AS "N° Eventi",
           CASE WHEN {k} % 83 = 0 THEN NULL
                WHEN {k} % 89 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
                ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS "Data",
           'EV' || CAST({k} AS VARCHAR) AS "Nome",
           CASE WHEN {k} % 2 = 0 THEN 'FFWD' END AS "EXPO.1",
           o_orderpriority AS "Località",
           CAST({total} AS VARCHAR) AS "Incassi",
           CASE WHEN {k} % 71 = 0 THEN 'n/d'
                ELSE CAST(CAST(round({total} * CAST(0.3 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2))
                          AS VARCHAR) END AS "Costi Reali",
           CASE WHEN {k} % 5 = 0 THEN '12.5' END AS "Vitto & Alloggio",
           'x' AS "Colonna Extra"
    FROM orders"""


VIEWS["event_sheet"] = _event_sheet_sql()

# Which raw header feeds which column, as the Spark job decides it.
_EVENT_TYPED = """
typed AS (
  SELECT CAST(_row AS BIGINT) AS id,
         "Periodo" AS periodo,
         TRY_CAST(trim("N° Eventi") AS BIGINT) AS num_eventi,
         COALESCE(strftime(TRY_CAST("Data" AS TIMESTAMP), '%Y-%m-%d'), "Data") AS data,
         "Nome" AS nome, "EXPO.1" AS expo_brand, "Località" AS localita,
         TRY_CAST(trim("Incassi") AS DOUBLE) AS incassi,
         TRY_CAST(trim("Costi Reali") AS DOUBLE) AS costi_reali,
         TRY_CAST(trim("Vitto & Alloggio") AS DOUBLE) AS vitto_alloggio,
         list_filter([CASE WHEN "N° Eventi" IS NOT NULL
                            AND TRY_CAST(trim("N° Eventi") AS BIGINT) IS NULL THEN 'num_eventi' END,
                      CASE WHEN "Vitto & Alloggio" IS NOT NULL
                            AND TRY_CAST(trim("Vitto & Alloggio") AS DOUBLE) IS NULL
                           THEN 'vitto_alloggio' END,
                      CASE WHEN "Costi Reali" IS NOT NULL
                            AND TRY_CAST(trim("Costi Reali") AS DOUBLE) IS NULL
                           THEN 'costi_reali' END,
                      CASE WHEN "Incassi" IS NOT NULL AND TRY_CAST(trim("Incassi") AS DOUBLE) IS NULL
                           THEN 'incassi' END], lambda x: x IS NOT NULL) AS bad_columns
  FROM event_sheet)"""

_AE_TEXT = {"periodo", "accordo", "data", "expo_periodo", "nome", "mezzo_trasporto", "disciplina",
            "localita", "regione", "expo_brand", "addetto", "ffwd"}
_AE_COLS = ["periodo", "accordo", "num_eventi", "data", "expo_periodo", "nome", "mezzo_trasporto",
            "disciplina", "localita", "regione", "expo_brand", "addetto", "pernotto",
            "vitto_alloggio", "treno", "spazio_varie", "incassi_2024", "caschi", "occhiali",
            "pneumatici", "bdg_incassi", "bdg_costi", "km", "gasolio", "autostrada", "costi_reali",
            "incassi", "pos", "cash", "extra", "vendita_privati_agenti", "ffwd"]
_TYPED_HAS = {"periodo", "num_eventi", "data", "nome", "expo_brand", "localita", "incassi",
              "costi_reali", "vitto_alloggio"}


def _ae_col(c: str) -> str:
    if c in _TYPED_HAS:
        return c
    t = "VARCHAR" if c in _AE_TEXT else ("BIGINT" if c == "num_eventi" else "DOUBLE")
    return f"CAST(NULL AS {t}) AS {c}"


ORACLE.update({
    "ingest_annual_events": sql(f"""
SELECT id, {", ".join(_ae_col(c) for c in _AE_COLS)} FROM typed WHERE len(bad_columns) = 0""",
                                ("event_sheet",), _EVENT_TYPED),
    "ingest_rejects": sql("""
SELECT id, 'bad value in: ' || array_to_string(bad_columns, ', ') AS reason FROM typed
WHERE len(bad_columns) > 0""", ("event_sheet",), _EVENT_TYPED),
    "normalise_event_date": sql("""
SELECT _row AS id, "Data" AS raw,
       COALESCE(strftime(TRY_CAST(regexp_extract("Data", '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AS DATE),
                         '%Y-%m-%d'),
                CASE WHEN trim("Data") = '' THEN NULL ELSE "Data" END) AS data
FROM event_sheet""", ("event_sheet",)),
    "sample_rows": sql("""
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY "Periodo" ORDER BY _row) AS n
                           FROM event_sheet) s WHERE n <= 3""", ("event_sheet",)),
    "profile_columns": sql("\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'string' AS type, CAST(count_if("{c}" IS NULL) AS BIGINT) AS nulls
FROM event_sheet""" for c in ("Periodo", "N° Eventi", "Data", "Nome", "EXPO.1", "Località", "Incassi",
                              "Costi Reali", "Vitto & Alloggio", "Colonna Extra")), ("event_sheet",)),
    "profile_table": sql("""
SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns,
       CAST(count_if("Periodo" IS NULL) + count_if("N° Eventi" IS NULL) + count_if("Data" IS NULL)
            + count_if("Nome" IS NULL) + count_if("EXPO.1" IS NULL) + count_if("Località" IS NULL)
            + count_if("Incassi" IS NULL) + count_if("Costi Reali" IS NULL)
            + count_if("Vitto & Alloggio" IS NULL) + count_if("Colonna Extra" IS NULL) AS BIGINT)
           AS n_nulls
FROM event_sheet""", ("event_sheet",)),
    "scan_annual_events": sql("SELECT * FROM annual_events", ("annual_events",)),
    "constraint_report": sql("""
SELECT 'not_null' AS "check", 'suppliers' AS "table", 'name' AS "column",
       CAST(count_if(name IS NULL) AS BIGINT) AS violations FROM suppliers
UNION ALL SELECT 'not_null', 'products', 'name', CAST(count_if(name IS NULL) AS BIGINT) FROM products
UNION ALL SELECT 'not_null', 'inventory', 'product_id',
                 CAST(count_if(product_id IS NULL) AS BIGINT) FROM inventory
UNION ALL SELECT 'not_null', 'inventory_transactions', 'product_id',
                 CAST(count_if(product_id IS NULL) AS BIGINT) FROM inventory_transactions
UNION ALL SELECT 'not_null', 'inventory_transactions', 'transaction_type',
                 CAST(count_if(transaction_type IS NULL) AS BIGINT) FROM inventory_transactions
UNION ALL SELECT 'not_null', 'inventory_transactions', 'quantity',
                 CAST(count_if(quantity IS NULL) AS BIGINT) FROM inventory_transactions
UNION ALL SELECT 'unique', 'products', 'ean_upc', count(*) FROM
  (SELECT ean_upc FROM products WHERE ean_upc IS NOT NULL GROUP BY ean_upc HAVING count(*) > 1) d
UNION ALL SELECT 'foreign_key', 'products', 'supplier_id', count(*) FROM products
  WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT id FROM suppliers)
UNION ALL SELECT 'foreign_key', 'inventory', 'product_id', count(*) FROM inventory
  WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM products)
UNION ALL SELECT 'foreign_key', 'inventory_transactions', 'product_id', count(*)
  FROM inventory_transactions
  WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM products)
UNION ALL SELECT 'not_null', 'stock_log', 'event_type',
                 CAST(count_if(event_type IS NULL) AS BIGINT) FROM stock_log""",
                             ("suppliers", "products", "inventory", "inventory_transactions",
                              "stock_log")),
})

# The streams equal the batch jobs for in-order input, so they share their oracles.
ORACLE["scan_stream"] = ORACLE["scan_lookup"]
ORACLE["ledger_stream"] = ORACLE["apply_ledger"]
ORACLE["scan_upkeep"] = ORACLE["scan_lookup"]
ORACLE["ledger_upkeep"] = ORACLE["stock_on_hand"]
ORACLE["src_event_sheet"] = ORACLE["ingest_annual_events"]
ORACLE["src_allocation_sheet"] = ORACLE["allocate_rows"]
ORACLE["written_report"] = ORACLE["category_breakdown"]
ORACLE["written_transactions"] = sql("SELECT * FROM inventory_transactions", ("inventory_transactions",))
ORACLE["src_price_list"] = f"""
WITH r AS (SELECT 'bell_' || CAST(p_partkey % 10 AS VARCHAR) || '.csv' AS file,
                  row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) AS line_no,
                  ['SKU' || {sql_padded('p_partkey', 6)}, p_name || chr(10) || p_brand,
                   'say "' || p_type || '", ok', CAST(p_partkey AS VARCHAR)] AS c FROM part
           UNION ALL SELECT DISTINCT 'bell_' || CAST(p_partkey % 10 AS VARCHAR) || '.csv', 0,
                            ['SKU', 'Name', 'Type', 'Key'] FROM part)
SELECT file, CAST(line_no AS BIGINT) AS line_no, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS col,
       unnest(c) AS cell FROM r"""


def _types_sql(source: str, keys: str) -> str:
    """Types of text cells by ``keys`` from ``source`` (keys, cell)."""
    return f"""
k AS (SELECT {keys}, CASE WHEN x IS NULL OR x = '' THEN NULL
             WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN 'integer'
             WHEN regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'float'
             WHEN regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?)?')
                  AND TRY_CAST(x[1:10] AS DATE) IS NOT NULL THEN 'date' ELSE 'text' END AS t
      FROM (SELECT *, trim(cell) AS x FROM {source})),
n AS (SELECT {keys}, count(*) AS c, count_if(t = 'integer') AS i, count_if(t = 'float') AS f, count_if(t = 'date') AS d,
             count_if(t = 'text') AS s FROM k GROUP BY {keys})
SELECT {keys}, CASE WHEN s > 0 OR d > 0 AND i + f > 0 THEN 'text' WHEN d > 0 THEN 'date' WHEN f > 0 THEN 'float'
                    WHEN i > 0 THEN 'integer' ELSE 'empty' END AS type,
       CAST(i AS BIGINT) AS n_integer, CAST(f AS BIGINT) AS n_float, CAST(d AS BIGINT) AS n_date, CAST(s AS BIGINT) AS n_text,
       CAST(c - i - f - d - s AS BIGINT) AS nulls FROM n"""


_SHEET_COLUMNS = ("Periodo", "N° Eventi", "Data", "Nome", "EXPO.1", "Località", "Incassi", "Costi Reali",
                  "Vitto & Alloggio", "Colonna Extra")
ORACLE["profile_types"] = f"WITH event_sheet AS ({VIEWS['event_sheet']}), cells AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS cell FROM event_sheet""" for c in _SHEET_COLUMNS) \
    + ")," + _types_sql("cells", '"column"')
ORACLE["profile_sheet_types"] = sql("SELECT * FROM typed", _IMPORT_VIEWS, _IMPORT + """,
kept AS (SELECT d.file, d.line_no, d.col, c."column", d.cell FROM data d
         JOIN dcols c ON d.file = c.file AND d.col = c.col
         WHERE EXISTS (SELECT 1 FROM data x WHERE x.file = d.file AND x.line_no = d.line_no AND x.cell IS NOT NULL)),
typed AS (WITH """ + _types_sql("kept", 'file, col, "column"').strip() + ")", recursive=True)

#: Calls of a product one after the other: the state is what is left of it and a list of
#: its assignments (event, quantity).
_CALLS = _AVAIL + f""",
log AS (SELECT seq, CASE l_linenumber % 3 WHEN 0 THEN 'remove' WHEN 2 THEN 'change' ELSE 'allocate' END AS action,
               event_id, l_partkey AS product_id,
               CAST(CASE l_linenumber % 3 WHEN 1 THEN ceil(l_quantity / 10) WHEN 2 THEN l_quantity END AS BIGINT) AS quantity
        FROM ({_REQUEST_LINES}) j),
c AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq, event_id, action, quantity) AS k FROM log),
ev AS (SELECT product_id, list({{'e': event_id, 'q': quantity_assigned}}) AS h FROM event_products GROUP BY product_id),
st AS (
  SELECT p.product_id, CAST(0 AS BIGINT) AS k, a.available AS lft, COALESCE(ev.h, []) AS h,
         CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS held, CAST(NULL AS BIGINT) AS delta
  FROM (SELECT DISTINCT product_id FROM log) p LEFT JOIN avail a ON p.product_id = a.product_id
  LEFT JOIN ev ON p.product_id = ev.product_id
  UNION ALL
  SELECT product_id, k, CASE WHEN reason IS NULL THEN lft - want ELSE lft END,
         CASE WHEN reason IS NOT NULL THEN h
              ELSE list_concat(list_filter(h, lambda x: x.e <> event_id),
                               CASE WHEN action = 'remove' THEN [] ELSE [{{'e': event_id, 'q': COALESCE(held, 0) + want}}] END) END,
         reason, held, CASE WHEN reason IS NULL THEN want END
  FROM (SELECT *, CASE WHEN action = 'allocate' AND (quantity IS NULL OR quantity <= 0) THEN 'invalid_quantity'
                       WHEN action = 'allocate' AND lft IS NULL THEN 'unknown_product'
                       WHEN action <> 'allocate' AND held IS NULL THEN 'not_assigned'
                       WHEN action = 'change' AND (quantity IS NULL OR quantity < 0) THEN 'invalid_quantity'
                       WHEN want > 0 AND lft IS NULL THEN 'unknown_product'
                       WHEN want > 0 AND want > lft THEN 'insufficient_stock' END AS reason
        FROM (SELECT *, CASE action WHEN 'allocate' THEN quantity WHEN 'change' THEN quantity - held ELSE -held END AS want
              FROM (SELECT c.product_id, c.k, c.action, c.event_id, c.quantity, st.lft, st.h,
                           list_filter(st.h, lambda x: x.e = c.event_id)[1].q AS held
                    FROM st JOIN c ON st.product_id = c.product_id AND c.k = st.k + 1)))),
called AS (SELECT c.seq, c.action, c.event_id, c.product_id, c.quantity, s.reason IS NULL AS accepted, s.reason,
                  s.held, s.delta, s.lft AS available_after
           FROM c JOIN st s ON s.product_id = c.product_id AND s.k = c.k)"""
ORACLE["request_log"] = sql("SELECT * FROM called", ("inventory", "event_products"), _CALLS, recursive=True)
ORACLE["request_log_assignments"] = sql("""
SELECT x.e AS event_id, product_id, CAST(x.q AS BIGINT) AS quantity_assigned
FROM (SELECT product_id, unnest(h) AS x FROM st JOIN (SELECT product_id, max(k) AS k FROM st GROUP BY product_id) m
      USING (product_id, k))
UNION ALL SELECT event_id, product_id, quantity_assigned FROM event_products
WHERE product_id NOT IN (SELECT product_id FROM log)""", ("inventory", "event_products"), _CALLS, recursive=True)
