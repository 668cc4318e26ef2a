"""The fact stored by its interleaved key: same rows, fewer row groups read."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fiscalflow.operators import clustered_fact
from fiscalflow.operators.clustered_fact import BITS, ClusteredFact, bounds_of, cluster_key, interleaved, place, rows_scanned
from fiscalflow.operators.fact import build_fact
from fiscalflow.operators.filters import FilterSpec, apply_filters
from test_factorised import SPECS, crowded, values  # noqa: F401  (the fixture)

STATES = [f"state {i:02d}" for i in range(8)]
TYPES = ["MaterialInvoice", "ServiceInvoice", "TransportationInvoice"]


def made_fact(spark, n, hot=0):
    """``n`` rows of independent filter columns, the first ``hot`` of one cell."""
    one = lambda values, seed: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(values))) + 1).cast("int"))
    cell = lambda hot_value, other: F.when(F.col("id") < hot, hot_value).otherwise(other)
    second = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(365 * 86400))
    rows = spark.range(0, n, 1, 4).withColumn(
        "completed_at", F.expr("timestamp_ntz'2023-01-01 00:00:00'") + F.make_dt_interval(secs=cell(F.lit(5), second).cast("decimal(18,6)"))
    )
    return rows.select(
        "id", F.lit(1.0).alias("total_value"), cell(F.lit(TYPES[0]), one(TYPES, 1)).alias("document_type"),
        cell(F.lit("t1"), one(["t1", "t2", "t3", "t4"], 2)).alias("task_name"), cell(F.lit("s1"), one(["s1", "s2"], 3)).alias("task_status"),
        cell(F.lit(STATES[0]), one(STATES, 4)).alias("supplier_state"), "completed_at", F.to_date("completed_at").alias("posted_on"),
    )


@pytest.mark.parametrize("spec", SPECS)
def test_equal_the_filtered_fact(crowded, spec):  # noqa: F811
    fact = build_fact(crowded)
    stored = ClusteredFact.store(fact, files=3, row_group_bytes=4096)
    assert stored.fact.columns == fact.columns and values(stored.fact) == values(fact)
    assert values(stored.select(spec)) == values(apply_filters(fact, spec))


def test_row_groups_are_skipped_for_any_column(spark):
    n = 200_000
    fact = made_fact(spark, n)
    stored = ClusteredFact.store(fact, files=16, row_group_bytes=16 * 1024)
    month = (dt.date(2023, 3, 1), dt.date(2023, 3, 31))
    share = {}
    for name, spec in {
        "day": FilterSpec(period=month),
        "type": FilterSpec(types=TYPES[1:2]),
        "task": FilterSpec(tasks=["t2"]),
        "state": FilterSpec(states=STATES[3:4]),
        "day and type": FilterSpec(period=month, types=TYPES[1:2]),
        "type, task and state": FilterSpec(types=TYPES[1:2], tasks=["t2"], states=STATES[3:4]),
    }.items():
        selection = stored.select(spec)
        assert selection.count() == apply_filters(fact, spec).count()
        share[name] = rows_scanned(selection) / n
    assert all(v < 0.7 for v in share.values()), share
    assert share["day and type"] < 0.3 and share["type, task and state"] < 0.2, share
    by_time = ClusteredFact(spark.read.parquet(stored.path), stored.path, {}).fact
    assert rows_scanned(by_time.filter("total_value = 1.0")) == n  # nothing to skip by


def test_a_cell_of_a_third_of_the_rows_is_split_over_files(spark):
    n = 60_000
    stored = ClusteredFact.store(made_fact(spark, n, hot=n // 3), files=12)
    sizes = [r["count"] for r in stored.fact.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < n // 6


def test_later_rows_by_the_first_bounds(spark, crowded):  # noqa: F811
    fact = build_fact(crowded)
    first = fact.filter("id % 2 = 0 or id is null")
    stored = ClusteredFact.store(first, files=2).append(fact.filter("id % 2 = 1"), files=2)
    assert values(stored.fact) == values(fact)
    assert values(stored.select(SPECS[1])) == values(apply_filters(fact, SPECS[1]))


def test_no_rows(spark, crowded):  # noqa: F811
    fact = build_fact(crowded).limit(0)
    assert bounds_of(fact) == {c: [] for c in ("posted_on", "document_type", "task_name", "task_status", "supplier_state")}
    assert ClusteredFact.store(fact).select(FilterSpec()).collect() == []


def test_more_values_than_ranks(spark):
    """Texts beyond the most frequent values share the ranks between them, in order."""
    rows = made_fact(spark, 3000).withColumn("supplier_state", F.format_string("é%04d", F.col("id")))
    bounds = bounds_of(rows, bits=3)
    assert 0 < len(bounds["supplier_state"]) <= 6 and len(bounds["posted_on"]) <= 6
    found = rows.select("supplier_state", place(F.col("supplier_state"), bounds["supplier_state"]).alias("p")).orderBy("supplier_state").collect()
    assert [r["p"] for r in found] == [sum(b <= r["supplier_state"] for b in bounds["supplier_state"]) for r in found]
    assert rows.select(F.max(cluster_key(bounds)).alias("k")).first()["k"] < 2 ** (5 * BITS)
    stored = ClusteredFact.store(rows, files=4, bits=3)
    assert stored.select(FilterSpec(states=["é0007", "é2999", "é9999"])).count() == 2


def test_interleaved_bits(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(8), rng.randrange(2), rng.randrange(16)) for _ in range(100)]
    frame = spark.createDataFrame(rows, "a int, b int, c int")
    keys = frame.select("a", "b", "c", interleaved([(F.col("a"), 3), (F.col("b"), 1), (F.col("c"), 4)]).alias("k")).collect()
    for a, b, c, k in keys:
        A, B, C = f"{a:03b}", f"{b:01b}", f"{c:04b}"
        assert k == int("".join(x[i] for i in range(4) for x in (A, B, C) if i < len(x)), 2)
    assert spark.range(1).select(interleaved([]).alias("k")).first()["k"] == 0


def test_no_task_sorts_more_than_a_bounded_file(spark, monkeypatch):
    gb = 1024**3
    assert clustered_fact.files_for(0) == 1
    assert all(size / clustered_fact.files_for(size) <= gb / 8 for size in (gb, 6 * gb, 60 * gb + 1))
    monkeypatch.setattr(clustered_fact, "FILE_BYTES", 256 * 1024)
    stored = ClusteredFact.store(made_fact(spark, 60_000))
    sizes = [r["count"] for r in stored.fact.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 2 and sum(sizes) == 60_000 and max(sizes) < 2 * 60_000 / len(sizes)
