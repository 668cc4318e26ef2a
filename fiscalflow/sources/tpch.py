"""Mapping of the driver's TPC-H-like tables onto the invoice model.

The test tables are orders / lineitem / customer / supplier / nation / region.
They are mapped, as Spark transformations (nothing is collected), onto:

=================  =====================================================================
model table        derived from
=================  =====================================================================
states             region: id = r_regionkey, name = r_name
cities             nation: id = n_nationkey, name = n_name, state_id = n_regionkey
task_definitions   fixed code table (4 rows)
status             fixed code table (8 rows)
process_instances  orders: id = o_orderkey, type 'Inbound'
tax_documents      orders, one per order; the supplier is the smallest l_suppkey of the
                   order (none for every 40th order key, or an order without lines);
                   supplier city = s_nationkey, customer city = c_nationkey
items              lineitem rows with l_linenumber <> 6; purchase order 'PO-' + l_partkey % 50
tasks              one per (l_orderkey, l_linenumber) group of lineitem (the pair is not
                   unique in the data): completed = latest ship date, created = that
                   minus max(l_quantity) hours; definition 10 + line % 4; status by line
                   status ('O' = first status of the pair); completed is unknown for
                   line 7 when the hours are a multiple of 10
(broken rows)      some orders, by remainder of their key, have a status of the wrong
                   definition, an item of no document, unknown states or users, or no
                   process row (constants below)
=================  =====================================================================

The same mapping is written as SQL CTEs in ``fiscalflow.plans.oracle`` for the
independent DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalflow import schemas
from fiscalflow.functions.keys import composite_key, prefixed_key
from fiscalflow.sources.model import Model, empty
from fiscalflow.sources.parquet import read_table

# Fixed values of the mapping (test-data conventions, not business rules).
NO_SUPPLIER_EVERY = 40          # orders with o_orderkey % 40 = 0 get no supplier
ITEMLESS_LINE_NUMBER = 6        # lineitem rows with this line number are not items
OPEN_TASK_LINE_NUMBER = 7       # ...and with hours % 10 = 0 have no completed_at
PO_BUCKETS = 50                 # purchase order = 'PO-' + l_partkey % 50
DOCUMENT_NUMBER_OFFSET = 10000  # number = o_orderkey + 10000
# Rows that break the integrity rules, so that the audits have something to find:
WRONG_STATUS_EVERY = 97         # tasks of these orders have a status of the next definition
ORPHAN_ITEM_EVERY = 89          # line 3 of these orders names the document -l_orderkey
ORPHAN_ITEM_LINE = 3
UNKNOWN_STATE_EVERY = 83        # remainder 0: unknown supplier state, 1: unknown customer state
UNKNOWN_USER_EVERY = 79         # remainder 0: unknown assignee, 1: unknown completer
NO_PROCESS_EVERY = 101          # these orders have no process row
UNKNOWN_ID = 99
MATERIAL_PRIORITIES = ["1-URGENT", "2-HIGH"]
SERVICE_PRIORITIES = ["3-MEDIUM"]


def _states(region: DataFrame) -> DataFrame:
    return region.select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")
    )


def _cities(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("long").alias("state_id"),
    )


def _unknown(when):
    """A key that no parent has, where ``when`` holds; else null."""
    return F.when(when, F.lit(UNKNOWN_ID)).cast("long")


def _document_type(priority):
    return (
        F.when(priority.isin(MATERIAL_PRIORITIES), F.lit("MaterialInvoice"))
        .when(priority.isin(SERVICE_PRIORITIES), F.lit("ServiceInvoice"))
        .otherwise(F.lit("TransportationInvoice"))
    )


def tasks_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One task per (l_orderkey, l_linenumber) group (one shuffle of lineitem).

    The status needs "max(l_linestatus) = 'O'". A string max would force a
    sort-based aggregate; it is computed instead from two boolean flags (some
    status equals 'O', none sorts after it), which keeps a hash aggregate with
    fixed-width buffers. All-null statuses give null, like the string max.
    """
    ls = F.col("l_linestatus")
    # A plain group-by keeps the map-side partial aggregate: a hot order line is
    # collapsed to one row per map task before the shuffle. (Repartitioning on the
    # order key first would co-locate tasks with documents but send a hot order,
    # whole, to one reducer.)
    per_line = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").cast("int").alias("hours"),
        F.max("l_shipdate").alias("shipped"),
        F.max(ls == "O").alias("any_open"),
        F.max(ls > "O").alias("any_after_open"),
    )
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    hours = F.col("hours")
    open_task = (line == OPEN_TASK_LINE_NUMBER) & (hours % 10 == 0)
    return per_line.select(
        composite_key("l_orderkey", line).alias("id"),
        (F.col("shipped") - F.make_dt_interval(hours=hours)).alias("created_at"),
        F.when(open_task, F.lit(None)).otherwise(F.col("shipped")).alias("completed_at"),
        (F.lit(10) + line % 4).cast("long").alias("task_definition_id"),
        (
            F.lit(100)
            + ((line + F.when(order % WRONG_STATUS_EVERY == 0, 1).otherwise(0)) % 4) * 10
            + F.when(F.col("any_open") & ~F.col("any_after_open"), F.lit(0)).otherwise(F.lit(1))
        )
        .cast("long")
        .alias("status_id"),
        _unknown(order % UNKNOWN_USER_EVERY == 0).alias("assing_to_id"),
        _unknown(order % UNKNOWN_USER_EVERY == 1).alias("completed_by_id"),
        F.col("l_orderkey").alias("process_instance_id"),
    )


def documents_from_orders(
    orders: DataFrame, lineitem: DataFrame, supplier: DataFrame, customer: DataFrame
) -> DataFrame:
    """One tax document per order.

    The order's supplier is an aggregate over its lines (partial aggregation at the
    map side). Join order for scale: the narrow per-order supplier rows meet the
    supplier table on the supplier key, the wide order rows meet the customer table
    on the customer key, and the two then meet on the order key - which is also the
    process id, so the documents come out hash-partitioned for the tasks join. The
    wide order rows are shuffled twice at most.
    """
    line_key = F.col("l_orderkey")
    order_supplier = (
        lineitem.groupBy("l_orderkey")
        .agg(F.min("l_suppkey").alias("supplier_key"))
        # orders without a supplier stay out of the join on the supplier (a null key held
        # by one order in 40 would land in one reducer); the order join brings them back
        .filter((line_key % NO_SUPPLIER_EVERY != 0) & F.col("supplier_key").isNotNull())
        .join(
            supplier.select("s_suppkey", "s_nationkey"),
            F.col("supplier_key") == F.col("s_suppkey"),
            "left",
        )
        .select("l_orderkey", "supplier_key", "s_nationkey")
    )
    key = F.col("o_orderkey")
    with_customer = orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    ).join(
        customer.select("c_custkey", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey"),
        "left",
    )
    return with_customer.join(order_supplier, key == line_key, "left").select(
        key.alias("id"),
        (key + DOCUMENT_NUMBER_OFFSET).alias("number"),
        _document_type(F.col("o_orderpriority")).alias("type"),
        F.col("o_totalprice").alias("total_value"),
        F.col("supplier_key").cast("string").alias("supplier_identification_number"),
        F.col("o_custkey").cast("string").alias("customer_identification_number"),
        _unknown(key % UNKNOWN_STATE_EVERY == 0).alias("supplier_state_id"),
        _unknown(key % UNKNOWN_STATE_EVERY == 1).alias("customer_state_id"),
        F.col("s_nationkey").cast("long").alias("supplier_city_id"),
        F.col("c_nationkey").cast("long").alias("customer_city_id"),
        key.alias("process_instance_id"),
    )


def items_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Invoice items: lineitem rows except line number 6 (a narrow projection)."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    return lineitem.filter(line != ITEMLESS_LINE_NUMBER).select(
        composite_key("l_orderkey", line).alias("id"),
        F.lit(None).cast("string").alias("description"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("total_value"),
        prefixed_key("PO-", F.col("l_partkey") % PO_BUCKETS).alias("purchase_order"),
        F.when((order % ORPHAN_ITEM_EVERY == 0) & (line == ORPHAN_ITEM_LINE), -order)
        .otherwise(order)
        .alias("tax_document_id"),
    )


# Columns of the driver's tables (fixed values). A given schema needs no job that reads
# file footers; the files are listed anew at each read all the same.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def read_source(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One of the driver's tables under ``base``, by its stated schema."""
    return read_table(spark, base, name, SOURCE_SCHEMAS[name])


def model_from_tpch(spark: SparkSession, base: str) -> Model:
    """Lazily map the driver's tables under ``base`` onto the invoice model.

    A table's sources are opened when the table is first used. Partitioning: documents
    come out hash-partitioned on the order key (their process id); tasks are aggregated
    per order line with map-side combining and then meet the documents in one shuffle of
    the aggregated rows. All scans read only the columns the query needs; filters on the
    mapped columns stay above the aggregates they depend on.
    """

    def read(name: str) -> DataFrame:
        return read_source(spark, base, name)

    def processes() -> DataFrame:
        kept = read("orders").filter(F.col("o_orderkey") % NO_PROCESS_EVERY != 0)
        return kept.select(F.col("o_orderkey").alias("id"), F.lit("Inbound").alias("type"))

    return Model(
        states=lambda: _states(read("region")),
        cities=lambda: _cities(read("nation")),
        users=lambda: empty(spark, "users"),
        task_definitions=lambda: schemas.task_definitions_df(spark),
        status=lambda: schemas.status_df(spark),
        billing_reports=lambda: empty(spark, "billing_reports"),
        process_instances=processes,
        tax_documents=lambda: documents_from_orders(read("orders"), read("lineitem"), read("supplier"), read("customer")),
        items=lambda: items_from_lineitem(read("lineitem")),
        tasks=lambda: tasks_from_lineitem(read("lineitem")),
    )
