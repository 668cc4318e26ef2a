"""KPIs and the four dashboard panels over a (filtered) fact.

Every function takes the fact at its native grain (document x task) and returns a
small DataFrame; none collects to the driver. Global statistics a row-level
expression needs (histogram bounds, the whole of a share) enter as scalar subqueries over
the same aggregate, whose exchange they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalflow.functions.money import money_sum

HIST_BINS = 20
PARETO_TOP = 10


def kpis(fact: DataFrame) -> DataFrame:
    """One row: spend (exact sum, 0.0 when nothing), documents (fact rows with an
    id - a document counts once per task), mean lead time in hours (nulls skipped), and
    distinct known supplier ids. One distinct only: a second would expand every row."""
    return fact.agg(
        money_sum("total_value").alias("spend"),
        F.count("id").alias("documents"),
        F.avg("lead_time_hours").alias("mean_lead_time_hours"),
        F.count_distinct("supplier_cnpj").alias("suppliers"),
    )


def distinct_documents(fact: DataFrame) -> DataFrame:
    """One row: the documents of the fact, each counted once."""
    return fact.agg(F.count_distinct("id").alias("distinct_documents"))


def spend_by_supplier(fact: DataFrame) -> DataFrame:
    """Spend per masked supplier id ('' groups the documents without supplier).
    Partial aggregation map-side: a dominant supplier costs one row per partition."""
    return fact.groupBy("supplier_cnpj_masked").agg(money_sum("total_value").alias("spend"))


def supplier_pareto(fact: DataFrame, top: int = PARETO_TOP) -> DataFrame:
    """Top ``top`` suppliers by spend, ties broken by id (TakeOrderedAndProject:
    each partition keeps its own top rows; no global sort)."""
    return (
        spend_by_supplier(fact)
        .orderBy(F.col("spend").desc(), F.col("supplier_cnpj_masked").asc())
        .limit(top)
    )


def geo_volume(fact: DataFrame) -> DataFrame:
    """Rows per (state, city) of the supplier; rows missing either are skipped."""
    return (
        fact.filter(F.col("supplier_state").isNotNull() & F.col("supplier_city").isNotNull())
        .groupBy("supplier_state", "supplier_city")
        .agg(F.count(F.lit(1)).alias("volume"))
    )


def geo_rollup_share(fact: DataFrame) -> DataFrame:
    """Two-level roll-up (state -> city) with each node's share of the whole; ``level``
    is 'total', 'state' or 'city'."""
    known = fact.filter(F.col("supplier_state").isNotNull() & F.col("supplier_city").isNotNull())
    return share_of_rollup(known, F.count(F.lit(1)))


def share_of_rollup(known: DataFrame, volume: Column) -> DataFrame:
    """The roll-up of ``known`` by state and city, its ``volume`` an aggregate.

    The share's denominator is the roll-up's own total row, read by a scalar subquery
    over the same roll-up: both read one exchange, so ``known`` runs once, and no window
    gathers the roll-up in one task.
    """
    rolled = known.rollup("supplier_state", "supplier_city").agg(volume.alias("volume"), F.grouping_id().alias("gid"))
    level = (
        F.when(F.col("gid") == 0, F.lit("city"))
        .when(F.col("gid") == 1, F.lit("state"))
        .otherwise(F.lit("total"))
    )
    total = rolled.agg(F.max(F.when(F.col("gid") == 3, F.col("volume"))).alias("rows")).scalar()
    return rolled.select(
        level.alias("level"),
        "supplier_state",
        "supplier_city",
        "volume",
        (F.col("volume").cast("double") / total.cast("double")).alias("share"),
    )


def daily_volume(fact: DataFrame) -> DataFrame:
    """Rows per posting day (days without rows are absent); ascending."""
    return (
        fact.filter(F.col("posted_on").isNotNull())
        .groupBy("posted_on")
        .agg(F.count("id").alias("documents"))
        .orderBy("posted_on")
    )


def lead_time_histogram(fact: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram of the lead time: ``bins`` bins over [min, max], the
    last one closed; a single bin when every value is equal. Nulls skipped.

    Rows are counted per distinct lead time, map-side first; the bins and their bounds
    are made from those counts, so that the fact runs once.
    """
    values = fact.filter(F.col("lead_time_hours").isNotNull())
    return histogram_of_counts(values.groupBy("lead_time_hours").agg(F.count(F.lit(1)).alias("documents")), bins)


def histogram_of_counts(counted: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """The histogram of ``(lead_time_hours, documents)``, one row per lead time.

    The bounds enter as one scalar subquery, a single aggregate row. It reads the counts
    as a whole, so that its plan below the counts' exchange is that of the bins and the
    exchange is shared."""
    rows = F.col("documents")
    return _binned(counted, counted.agg(_bounds(F.sum(rows))).scalar(), F.sum(rows), bins)


def stored_lead_time_histogram(stored: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """The same histogram over a stored fact: one column is scanned twice, for the bounds
    and for the bins, and a task sends at most ``bins`` rows, whatever the values are."""
    values = stored.filter(F.col("lead_time_hours").isNotNull())
    return _binned(values, values.agg(_bounds(F.count(F.lit(1)))).scalar(), F.count(F.lit(1)), bins)


def _bounds(rows: Column) -> Column:
    x = F.col("lead_time_hours")
    return F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), rows.alias("rows")).alias("s")


def _binned(values: DataFrame, bounds: Column, rows: Column, bins: int) -> DataFrame:
    x, lo, hi = F.col("lead_time_hours"), bounds.getField("lo"), bounds.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    bin_ = (
        F.when(width > 0, F.least(F.floor((x - lo) / width), F.lit(bins - 1)))
        .otherwise(F.lit(0))
        .cast("long")
    )
    b = F.col("bin").cast("double")
    return values.groupBy(bin_.alias("bin")).agg(rows.alias("documents")).select(
        "bin",
        (lo + b * width).alias("bin_lo"),
        (lo + (b + F.lit(1.0)) * width).alias("bin_hi"),
        "documents",
    ).orderBy("bin")


def lead_time_summary(fact: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """The histogram's companion row: bounds, bin width, mean (the chart's mean
    marker) and the number of measured rows."""
    return with_bin_width(
        fact.agg(
            F.min("lead_time_hours").alias("lead_time_min"),
            F.max("lead_time_hours").alias("lead_time_max"),
            F.avg("lead_time_hours").alias("mean_lead_time_hours"),
            F.count("lead_time_hours").alias("measured"),
        ),
        bins,
    )


def with_bin_width(summary: DataFrame, bins: int) -> DataFrame:
    return summary.withColumn(
        "bin_width", (F.col("lead_time_max") - F.col("lead_time_min")) / F.lit(float(bins))
    )


PANEL_SUPPLIER = "supplier"
PANEL_GEO = "geo"
PANEL_DAILY = "daily"


def panel_aggregates(fact: DataFrame) -> DataFrame:
    """Spend per supplier (A7), rows per state/city (A8) and rows per day (A10) in
    ONE pass: a GROUPING SETS aggregate, i.e. one scan of the selection and one
    shuffle (the rows are expanded three ways map-side and partially aggregated
    before the exchange) instead of three jobs over the same fact.

    Long format: ``panel`` names the grouping; the other panels' keys are null.
    Groups with an unknown key are dropped for the geography and daily panels, as
    in their separate forms.
    """
    grouped = fact.groupingSets(
        [["supplier_cnpj_masked"], ["supplier_state", "supplier_city"], ["posted_on"]],
        "supplier_cnpj_masked",
        "supplier_state",
        "supplier_city",
        "posted_on",
    ).agg(
        money_sum("total_value").alias("spend"),
        F.count(F.lit(1)).alias("volume"),
        F.count("id").alias("documents"),
        F.grouping_id().alias("gid"),
    )
    # grouping_id bits follow the column order above (supplier, state, city, day)
    panel = (
        F.when(F.col("gid") == 0b0111, F.lit(PANEL_SUPPLIER))
        .when(F.col("gid") == 0b1001, F.lit(PANEL_GEO))
        .otherwise(F.lit(PANEL_DAILY))
    )
    keep = (
        (panel == PANEL_SUPPLIER)
        | ((panel == PANEL_GEO) & F.col("supplier_state").isNotNull() & F.col("supplier_city").isNotNull())
        | ((panel == PANEL_DAILY) & F.col("posted_on").isNotNull())
    )
    return grouped.select(
        panel.alias("panel"),
        "supplier_cnpj_masked",
        "supplier_state",
        "supplier_city",
        "posted_on",
        "spend",
        "volume",
        "documents",
    ).filter(keep)
