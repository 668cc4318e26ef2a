"""DuckDB SQL for every catalog query, written independently of the Spark code.

Each statement runs against views named after the driver's tables (region, nation,
customer, supplier, orders, lineitem, ...). ``MODEL`` re-states the mapping of
``fiscalflow.sources.tpch`` as CTEs; the statements then query the model tables.
Conventions shared with the Spark side: money is summed as DECIMAL(24,6) and
returned as DOUBLE; counts are BIGINT; purchase orders are sorted.
"""

from __future__ import annotations

# The code tables and the allowed pairs, stated here once more.
MODEL = """
WITH states AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region
), cities AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
         CAST(n_regionkey AS BIGINT) AS state_id
  FROM nation
), task_definitions AS (
  SELECT * FROM (VALUES
    (10::BIGINT, 'Verificação de Nota Duplicada'), (11, 'Verificação de Divergências na Nota'),
    (12, 'Escrituração da Nota'), (13, 'Pagamento da Nota')) AS v(id, name)
), status AS (
  SELECT * FROM (VALUES
    (100::BIGINT, 'Nota Duplicada'), (101, 'Nota não é Duplicada'),
    (110, 'Nota com Divergência'), (111, 'Nota sem Divergência'),
    (120, 'Nota Escriturada com Sucesso'), (121, 'Nota não Escriturada'),
    (130, 'Nota Paga'), (131, 'Nota não Paga')) AS v(id, name)
), process_instances AS (
  SELECT o_orderkey AS id, 'Inbound' AS type FROM orders WHERE o_orderkey % 101 <> 0
), order_supplier AS (
  SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey
), doc_base AS (
  SELECT o.*, CASE WHEN o.o_orderkey % 40 = 0 THEN NULL ELSE os.supp END AS supp
  FROM orders o LEFT JOIN order_supplier os ON os.l_orderkey = o.o_orderkey
), tax_documents AS (
  SELECT d.o_orderkey AS id,
         d.o_orderkey + 10000 AS number,
         CASE WHEN d.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'MaterialInvoice'
              WHEN d.o_orderpriority = '3-MEDIUM' THEN 'ServiceInvoice'
              ELSE 'TransportationInvoice' END AS type,
         d.o_totalprice AS total_value,
         CAST(d.supp AS VARCHAR) AS supplier_identification_number,
         CAST(d.o_custkey AS VARCHAR) AS customer_identification_number,
         CASE d.o_orderkey % 83 WHEN 0 THEN 99::BIGINT END AS supplier_state_id,
         CASE d.o_orderkey % 83 WHEN 1 THEN 99::BIGINT END AS customer_state_id,
         CAST(s.s_nationkey AS BIGINT) AS supplier_city_id,
         CAST(c.c_nationkey AS BIGINT) AS customer_city_id,
         d.o_orderkey AS process_instance_id
  FROM doc_base d
  LEFT JOIN supplier s ON s.s_suppkey = d.supp
  LEFT JOIN customer c ON c.c_custkey = d.o_custkey
), task_base AS (
  SELECT l_orderkey, l_linenumber,
         CAST(max(l_quantity) AS INTEGER) AS h,
         max(l_shipdate) AS shipped,
         max(l_linestatus) AS ls
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), tasks AS (
  SELECT l_orderkey * 10 + l_linenumber AS id,
         shipped - h * INTERVAL 1 HOUR AS created_at,
         CASE WHEN l_linenumber = 7 AND h % 10 = 0 THEN NULL ELSE shipped END AS completed_at,
         CAST(10 + l_linenumber % 4 AS BIGINT) AS task_definition_id,
         CAST(100
              + 10 * ((l_linenumber + CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) % 4)
              + CASE WHEN ls = 'O' THEN 0 ELSE 1 END AS BIGINT) AS status_id,
         CASE l_orderkey % 79 WHEN 0 THEN 99::BIGINT END AS assing_to_id,
         CASE l_orderkey % 79 WHEN 1 THEN 99::BIGINT END AS completed_by_id,
         l_orderkey AS process_instance_id
  FROM task_base
), items AS (
  SELECT l_orderkey * 10 + l_linenumber AS id,
         CAST(NULL AS VARCHAR) AS description,
         l_extendedprice / l_quantity AS unit_price,
         l_extendedprice AS total_value,
         'PO-' || CAST(l_partkey % 50 AS VARCHAR) AS purchase_order,
         CASE WHEN l_orderkey % 89 = 0 AND l_linenumber = 3 THEN -l_orderkey ELSE l_orderkey END
           AS tax_document_id
  FROM lineitem WHERE l_linenumber <> 6
), users AS (
  SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS name,
         CAST(NULL AS VARCHAR) AS email
  WHERE false
), billing_reports AS (
  SELECT CAST(NULL AS BIGINT) AS id WHERE false
), place AS (
  -- each nation with its region
  SELECT n_nationkey AS city_id, n_name AS city, r_name AS state
  FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
), named_tasks AS (
  -- a task counts where both of its codes have a name
  SELECT process_instance_id AS pid, created_at, completed_at,
         (SELECT name FROM task_definitions WHERE id = task_definition_id) AS task_name,
         (SELECT name FROM status WHERE id = status_id) AS task_status
  FROM tasks
), padded AS (
  SELECT *, repeat('0', greatest(0, 14 - length(supplier_identification_number)))
            || supplier_identification_number AS digits
  FROM tax_documents
), fact AS (
  SELECT padded.id, total_value, padded.type AS document_type, task_name, task_status,
         supplier_identification_number AS supplier_cnpj, city AS supplier_city,
         state AS supplier_state, created_at, completed_at,
         CAST(epoch_us(completed_at) - epoch_us(created_at) AS DOUBLE)
           / 1000000.0::DOUBLE / 3600.0::DOUBLE AS lead_time_hours,
         CAST(completed_at AS DATE) AS posted_on,
         coalesce(digits[1:2] || '.' || digits[3:5] || '.' || digits[6:8] || '/' || digits[9:12]
                  || '-' || digits[13:], '') AS supplier_cnpj_masked
  FROM named_tasks
  JOIN padded ON padded.process_instance_id = pid
  LEFT JOIN place ON place.city_id = padded.supplier_city_id
  WHERE task_name IS NOT NULL AND task_status IS NOT NULL
)
"""


def q(body: str) -> str:
    return MODEL + body


# The rule in words: take the successful postings of February 2000; each belongs to the
# material documents of its process; both cities of the document must be known; name its
# orders once each. One row per document and posting time.
POSTED = """
, february AS (
  SELECT process_instance_id AS pid, completed_at AS posted_at FROM tasks
  WHERE (task_definition_id, status_id) = (12, 120)
    AND strftime(completed_at, '%Y-%m') = '2000-02'
), material AS (
  SELECT m.*, s.city AS supplier_city, c.city AS customer_city
  FROM (SELECT * FROM tax_documents WHERE type = 'MaterialInvoice') m
  JOIN place s ON s.city_id = m.supplier_city_id
  JOIN place c ON c.city_id = m.customer_city_id
), orders_of AS (
  SELECT doc, array_to_string(list_sort(list(po)), ', ') AS purchase_orders
  FROM (SELECT DISTINCT tax_document_id AS doc, purchase_order AS po FROM items
        WHERE purchase_order IS NOT NULL)
  GROUP BY doc
), posted AS (
  SELECT DISTINCT m.id, m.number, supplier_identification_number AS supplier_id, supplier_city,
         customer_identification_number AS customer_id, customer_city, posted_at
  FROM february JOIN material m ON m.process_instance_id = pid
)
"""
LISTED = """
SELECT p.id, number, purchase_orders, supplier_id, supplier_city, customer_id, customer_city,
       strftime(posted_at, '%d/%m/%Y') AS posted_on
FROM {rows} p LEFT JOIN orders_of o ON o.doc = p.id
ORDER BY posted_at DESC, p.id
"""
REPORT = q(POSTED + LISTED.format(rows="posted"))


def mask_sql(col: str) -> str:
    """CNPJ mask of a VARCHAR column: zero-fill to 14 (never truncate), then
    AA.AAA.AAA/AAAA-AA with the tail from position 13; '' for null."""
    z = f"(CASE WHEN length({col}) >= 14 THEN {col} ELSE lpad({col}, 14, '0') END)"
    return (
        f"(CASE WHEN {col} IS NULL THEN '' ELSE "
        f"substr({z}, 1, 2) || '.' || substr({z}, 3, 3) || '.' || substr({z}, 6, 3) || '/' || "
        f"substr({z}, 9, 4) || '-' || substr({z}, 13) END)"
    )


MONEY_SUM = "CAST(COALESCE(SUM(CAST({c} AS DECIMAL(24,6))), 0) AS DOUBLE)"

# The dashboard selection: days 2000-02-01..2000-05-31, material or service
# invoices, every task and status, every known state.
DASH = """
, dash AS (
  SELECT * FROM fact
  WHERE posted_on IS NOT NULL
    AND posted_on BETWEEN DATE '2000-02-01' AND DATE '2000-05-31'
    AND document_type IN ('MaterialInvoice', 'ServiceInvoice')
    AND supplier_state IS NOT NULL
)
"""

# The dashboard's default selection: every day, type, task and status there is, and
# every known state.
PANELS = """
, dash AS (SELECT * FROM fact WHERE posted_on IS NOT NULL AND supplier_state IS NOT NULL)
"""

REPORT_ONE = q(POSTED + """
, latest AS (
  SELECT * FROM posted QUALIFY row_number() OVER (PARTITION BY id ORDER BY posted_at DESC) = 1
)
""" + LISTED.format(rows="latest"))

# The twelve foreign keys: child, column, parent.
RULES = [
    ("cities", "state_id", "states"),
    ("tax_documents", "supplier_state_id", "states"),
    ("tax_documents", "customer_state_id", "states"),
    ("tax_documents", "supplier_city_id", "cities"),
    ("tax_documents", "customer_city_id", "cities"),
    ("tax_documents", "process_instance_id", "process_instances"),
    ("items", "tax_document_id", "tax_documents"),
    ("tasks", "task_definition_id", "task_definitions"),
    ("tasks", "status_id", "status"),
    ("tasks", "assing_to_id", "users"),
    ("tasks", "completed_by_id", "users"),
    ("tasks", "process_instance_id", "process_instances"),
]

ORACLE: dict[str, str] = {
    "report_last_month": REPORT,
    "report_one_per_document": REPORT_ONE,
    "export_report": REPORT,
    "report_sql": REPORT,
    "success_postings": q("""
SELECT td.id, t.id AS task_id, td.process_instance_id, t.completed_at
FROM tax_documents td JOIN tasks t ON td.process_instance_id = t.process_instance_id
WHERE td.type = 'MaterialInvoice' AND t.task_definition_id = 12 AND t.status_id = 120
"""),
    "last_month_window": q("""
SELECT id, process_instance_id, completed_at FROM tasks
WHERE completed_at >= date_trunc('month', DATE '2000-03-31' - INTERVAL 1 MONTH)
  AND completed_at < date_trunc('month', DATE '2000-03-31')
"""),
    "docs_tasks_join": q("""
SELECT td.id, t.id AS task_id
FROM tax_documents td JOIN tasks t ON td.process_instance_id = t.process_instance_id
"""),
    "po_rollup": q("""
SELECT tax_document_id,
       string_agg(DISTINCT purchase_order, ', ' ORDER BY purchase_order) AS purchase_orders
FROM items GROUP BY tax_document_id
"""),
    "fact": q("SELECT * FROM fact"),
    "fact_display": q("""
SELECT id, completed_at, task_name FROM fact ORDER BY completed_at NULLS LAST, id
"""),
    "filter_period": q("""
SELECT * FROM fact
WHERE posted_on BETWEEN DATE '2000-02-01' AND DATE '2000-05-31'
"""),
    "filter_members": q("""
SELECT * FROM fact
WHERE (document_type = 'MaterialInvoice' OR document_type IS NULL)
  AND task_name IN ('Escrituração da Nota', 'Pagamento da Nota')
  AND task_status IN ('Nota Escriturada com Sucesso', 'Nota não Escriturada', 'Nota Paga')
  AND (supplier_state IN ('AMERICA', 'EUROPE') OR supplier_state IS NULL)
"""),
    "filtered_fact": q(DASH + "SELECT * FROM dash"),
    "facet_state": q("""
SELECT DISTINCT supplier_state FROM fact WHERE supplier_state IS NOT NULL
"""),
    "facets": q("""
SELECT DISTINCT 'document_type' AS facet, document_type AS value FROM fact
UNION SELECT DISTINCT 'task_name', task_name FROM fact
UNION SELECT DISTINCT 'task_status', task_status FROM fact
UNION SELECT DISTINCT 'supplier_state', supplier_state FROM fact WHERE supplier_state IS NOT NULL
"""),
    "period_bounds": q("""
SELECT min(posted_on) AS first_day, max(posted_on) AS last_day FROM fact
"""),
    "kpis": q(PANELS + f"""
SELECT {MONEY_SUM.format(c="total_value")} AS spend,
       count(id) AS documents,
       avg(lead_time_hours) AS mean_lead_time_hours,
       count(DISTINCT supplier_cnpj) AS suppliers
FROM dash
"""),
    "distinct_documents": q(PANELS + "SELECT count(DISTINCT id) AS distinct_documents FROM dash"),
    "kpi_labels": q(PANELS + f"""
, k AS (
  SELECT {MONEY_SUM.format(c="total_value")} AS spend,
         avg(lead_time_hours) AS mean_lead_time_hours
  FROM dash
)
SELECT spend, mean_lead_time_hours,
       format('R$ {{:,.2f}}', spend) AS spend_label,
       printf('%.1f h', mean_lead_time_hours) AS lead_time_label
FROM k
"""),
    "spend_by_supplier": q(PANELS + f"""
SELECT supplier_cnpj_masked, {MONEY_SUM.format(c="total_value")} AS spend
FROM dash GROUP BY supplier_cnpj_masked
"""),
    "supplier_pareto_top10": q(PANELS + f"""
SELECT supplier_cnpj_masked, {MONEY_SUM.format(c="total_value")} AS spend
FROM dash GROUP BY supplier_cnpj_masked
ORDER BY spend DESC, supplier_cnpj_masked ASC
LIMIT 10
"""),
    "geo_volume": q(PANELS + """
SELECT supplier_state, supplier_city, count(*) AS volume
FROM dash WHERE supplier_state IS NOT NULL AND supplier_city IS NOT NULL
GROUP BY supplier_state, supplier_city
"""),
    "geo_rollup_share": q(PANELS + """
, g AS (
  SELECT supplier_state, supplier_city, count(*) AS volume,
         grouping(supplier_state, supplier_city) AS gid
  FROM dash WHERE supplier_state IS NOT NULL AND supplier_city IS NOT NULL
  GROUP BY ROLLUP (supplier_state, supplier_city)
)
SELECT CASE gid WHEN 0 THEN 'city' WHEN 1 THEN 'state' ELSE 'total' END AS level,
       supplier_state, supplier_city, volume,
       CAST(volume AS DOUBLE) / CAST((SELECT volume FROM g WHERE gid = 3) AS DOUBLE) AS share
FROM g
"""),
    "daily_volume": q(PANELS + """
SELECT posted_on, count(id) AS documents
FROM dash WHERE posted_on IS NOT NULL GROUP BY posted_on ORDER BY posted_on
"""),
    "panel_grouping_sets": q(PANELS + f"""
SELECT 'supplier' AS panel, supplier_cnpj_masked, CAST(NULL AS VARCHAR) AS supplier_state,
       CAST(NULL AS VARCHAR) AS supplier_city, CAST(NULL AS DATE) AS posted_on,
       {MONEY_SUM.format(c="total_value")} AS spend, count(*) AS volume, count(id) AS documents
FROM dash GROUP BY supplier_cnpj_masked
UNION ALL
SELECT 'geo', NULL, supplier_state, supplier_city, NULL,
       {MONEY_SUM.format(c="total_value")}, count(*), count(id)
FROM dash WHERE supplier_state IS NOT NULL AND supplier_city IS NOT NULL
GROUP BY supplier_state, supplier_city
UNION ALL
SELECT 'daily', NULL, NULL, NULL, posted_on,
       {MONEY_SUM.format(c="total_value")}, count(*), count(id)
FROM dash WHERE posted_on IS NOT NULL GROUP BY posted_on
"""),
    "lead_time_hist": q(PANELS + """
, st AS (
  SELECT min(lead_time_hours) AS lo, (max(lead_time_hours) - min(lead_time_hours)) / 20.0::DOUBLE AS w
  FROM dash
), b AS (
  SELECT CAST(CASE WHEN st.w > 0
                   THEN least(floor((d.lead_time_hours - st.lo) / st.w), 19)
                   ELSE 0 END AS BIGINT) AS bin
  FROM dash d, st WHERE d.lead_time_hours IS NOT NULL
)
SELECT b.bin, st.lo + CAST(b.bin AS DOUBLE) * st.w AS bin_lo,
       st.lo + (CAST(b.bin AS DOUBLE) + 1.0::DOUBLE) * st.w AS bin_hi,
       count(*) AS documents
FROM b, st GROUP BY b.bin, st.lo, st.w ORDER BY b.bin
"""),
    "lead_time_hist_mean": q(PANELS + """
SELECT min(lead_time_hours) AS lead_time_min, max(lead_time_hours) AS lead_time_max,
       avg(lead_time_hours) AS mean_lead_time_hours, count(lead_time_hours) AS measured,
       (max(lead_time_hours) - min(lead_time_hours)) / 20.0::DOUBLE AS bin_width
FROM dash
"""),
    "insert_if_absent": """
WITH target AS (
  SELECT o_orderkey AS id, o_orderkey + 10000 AS number, o_totalprice AS total_value
  FROM orders WHERE o_orderstatus = 'F'
), incoming AS (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS id,
         l_orderkey + 10000 AS number, l_extendedprice AS total_value,
         l_shipdate, l_linenumber, l_partkey, l_suppkey
  FROM lineitem
), ranked AS (
  SELECT *, row_number() OVER (
           PARTITION BY id
           ORDER BY l_shipdate NULLS FIRST, l_linenumber NULLS FIRST, l_partkey NULLS FIRST,
                    l_suppkey NULLS FIRST, number NULLS FIRST, total_value NULLS FIRST) AS rn
  FROM incoming WHERE id IS NOT NULL
)
SELECT id, number, total_value FROM target
UNION ALL
SELECT id, number, total_value FROM ranked
WHERE rn = 1 AND id NOT IN (SELECT id FROM target)
""",
    "insert_rejected": """
SELECT l_orderkey + 10000 AS number, l_extendedprice AS total_value,
       l_shipdate, l_linenumber, l_partkey, l_suppkey
FROM lineitem WHERE l_linenumber = 7
""",
    "bulk_load": q("""
SELECT 'process_instances' AS table_name, count(*) AS rows, CAST(sum(id) AS BIGINT) AS key_sum
FROM process_instances
UNION ALL SELECT 'tax_documents', count(*), CAST(sum(id) AS BIGINT) FROM tax_documents
UNION ALL SELECT 'items', count(*), CAST(sum(id) AS BIGINT) FROM items
UNION ALL SELECT 'tasks', count(*), CAST(sum(id) AS BIGINT) FROM tasks
"""),
    "audit_pk": q("""
, all_keys AS (
  SELECT 'states' AS table_name, id FROM states
  UNION ALL SELECT 'cities', id FROM cities
  UNION ALL SELECT 'users', id FROM users
  UNION ALL SELECT 'task_definitions', id FROM task_definitions
  UNION ALL SELECT 'status', id FROM status
  UNION ALL SELECT 'billing_reports', id FROM billing_reports
  UNION ALL SELECT 'process_instances', id FROM process_instances
  UNION ALL SELECT 'tax_documents', id FROM tax_documents
  UNION ALL SELECT 'items', id FROM items
  UNION ALL SELECT 'tasks', id FROM tasks
)
SELECT table_name, id AS key_value, count(*) AS rows
FROM all_keys GROUP BY table_name, id
HAVING count(*) > 1 OR id IS NULL
"""),
    "audit_fk": q("\nUNION ALL\n".join(f"""
SELECT '{child}.{column} -> {parent}' AS "constraint", id AS child_id, {column} AS fk_value
FROM {child} c WHERE {column} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{column})""" for child, column, parent in RULES)),
    "audit_status_pairs": q("""
SELECT id, task_definition_id, status_id FROM tasks
WHERE status_id // 10 <> task_definition_id AND task_definition_id BETWEEN 10 AND 13
"""),
    "filtered_export": q(DASH + """
SELECT *, strftime(posted_on, '%Y-%m') AS posted_month FROM dash
"""),
    "fmt_date": q("SELECT id, strftime(completed_at, '%d/%m/%Y') AS completed_on FROM tasks"),
    "month_offset": q("""
SELECT id, CAST(completed_at AS DATE) AS posted_on,
       CAST(CAST(completed_at AS DATE) - INTERVAL 1 MONTH AS DATE) AS one_month_before,
       CAST(CAST(completed_at AS DATE) - INTERVAL 3 MONTH AS DATE) AS three_months_before,
       CAST(date_trunc('month', CAST(completed_at AS DATE)) AS DATE) AS month_start
FROM tasks
"""),
    "month_bounds": q("""
SELECT id,
       CAST(date_trunc('month', CAST(completed_at AS DATE) - INTERVAL 1 MONTH) AS DATE)
         AS prev_month_first,
       CAST(last_day(CAST(completed_at AS DATE) - INTERVAL 1 MONTH) AS DATE) AS prev_month_last
FROM tasks
"""),
    "lead_time_hours": q("""
SELECT id, CAST(date_diff('microsecond', created_at, completed_at) AS DOUBLE)
             / 1000000.0::DOUBLE / 3600.0::DOUBLE AS lead_time_hours
FROM tasks
"""),
    "posting_day": q("SELECT id, CAST(completed_at AS DATE) AS posted_on FROM tasks"),
    "shift_time": q("""
SELECT id, created_at + INTERVAL 1 DAY AS created_plus_1d,
       completed_at - INTERVAL 2 HOUR AS completed_minus_2h
FROM tasks
"""),
    "cnpj_mask": q(f"""
SELECT id, {mask_sql("supplier_identification_number")} AS supplier_cnpj_masked,
       {mask_sql("customer_identification_number")} AS customer_cnpj_masked
FROM tax_documents
"""),
    "cnpj_unmask": q(f"""
SELECT id, {mask_sql("supplier_identification_number")} AS supplier_cnpj_masked,
       regexp_replace({mask_sql("supplier_identification_number")}, '[./-]', '', 'g')
         AS supplier_cnpj_digits
FROM tax_documents
"""),
    "round_money": """
SELECT l_orderkey, l_linenumber,
       CAST(round(CAST(l_extendedprice AS DECIMAL(18,2))
                  * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DOUBLE) AS net_value
FROM lineitem
""",
    "even_split": q("""
, counts AS (SELECT tax_document_id AS id, count(*) AS item_count FROM items GROUP BY 1)
SELECT d.id, c.item_count,
       CAST((CAST(CAST(d.total_value AS DECIMAL(18,2)) * 100 AS BIGINT) * 2 + c.item_count)
            // (2 * c.item_count) AS DOUBLE) / 100.0::DOUBLE AS item_share
FROM tax_documents d JOIN counts c ON c.id = d.id
"""),
    "city_state_lookup": q("""
SELECT d.id, d.supplier_city_id, COALESCE(c.state_id, 1) AS supplier_state_id
FROM tax_documents d LEFT JOIN cities c ON c.id = d.supplier_city_id
"""),
    "item_keys": q("SELECT id, tax_document_id, purchase_order FROM items"),
}

# The factorised forms answer the same questions.
ORACLE |= {
    "factorised_kpis": ORACLE["kpis"],
    "factorised_documents": ORACLE["distinct_documents"],
    "factorised_spend": ORACLE["spend_by_supplier"],
    "factorised_pareto": ORACLE["supplier_pareto_top10"],
    "factorised_geo_volume": ORACLE["geo_volume"],
    "factorised_geo_rollup": ORACLE["geo_rollup_share"],
    "factorised_daily_volume": ORACLE["daily_volume"],
    "factorised_lead_time_hist": ORACLE["lead_time_hist"],
    "factorised_lead_time_mean": ORACLE["lead_time_hist_mean"],
}

# Audits by batches end where audits of the whole tables do.
ORACLE |= {
    "audit_pk_batches": ORACLE["audit_pk"],
    "audit_fk_batches": ORACLE["audit_fk"],
}

# The stored cube answers as the fact does.
ORACLE |= {
    "cube_kpis": ORACLE["kpis"],
    "cube_suppliers": q(DASH + """
SELECT supplier_state, document_type, count(DISTINCT supplier_cnpj) AS suppliers
FROM dash GROUP BY supplier_state, document_type HAVING count(DISTINCT supplier_cnpj) > 0
"""),
}

# Stored in buckets or clustered, the tables give the same fact; streamed, the same lists.
ORACLE["fact_bucketed"] = ORACLE["fact"]
ORACLE["fact_clustered"] = ORACLE["filtered_fact"]
ORACLE["po_rollup_streamed"] = ORACLE["po_rollup"]
