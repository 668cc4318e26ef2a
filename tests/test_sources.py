"""Readers: JDBC option assembly, model conformance, parquet round trip."""

from __future__ import annotations

import os
import tempfile

import pytest

from fiscalflow import schemas
from fiscalflow.sources.jdbc import connection_from_env, jdbc_options, parse_key_range, read_jdbc_model
from fiscalflow.sources.model import conform, model_from_tables
from fiscalflow.sources.parquet import read_model, write_model


def test_jdbc_range_partitioning():
    opts = jdbc_options("jdbc:postgresql://db:5432/x", "tasks", lower_bound=1,
                        upper_bound=1_000_000, num_partitions=64)
    assert opts["partitionColumn"] == "id"
    assert (opts["lowerBound"], opts["upperBound"], opts["numPartitions"]) == ("1", "1000000", "64")
    assert opts["preferTimestampNTZ"] == "true"
    single = jdbc_options("jdbc:postgresql://db:5432/x", "status")
    assert "partitionColumn" not in single


def test_conform_casts_and_refuses_missing_columns(spark):
    df = spark.createDataFrame([(1, "x", 2)], "id int, name string, state_id int")
    assert conform(df, "cities").schema == schemas.CITIES
    with pytest.raises(ValueError, match="state_id"):
        conform(df.drop("state_id"), "cities")


def test_missing_tables_are_errors(spark, seed):
    tables = {n: seed.table(n) for n in ("states", "cities")}
    with pytest.raises(ValueError, match="users"):
        model_from_tables(spark, tables)
    with pytest.raises(ValueError, match="citys"):
        model_from_tables(spark, {**tables, "citys": seed.cities}, schemas.SCHEMAS)
    assert model_from_tables(spark, tables, schemas.SCHEMAS).tasks.count() == 0


def test_jdbc_model_refuses_unsplit_large_tables(spark):
    with pytest.raises(ValueError, match="tasks"):
        read_jdbc_model(spark, "jdbc:postgresql://db/x", key_ranges={"items": (1, 10, 2)})


def test_connection_from_environment():
    env = {"DB_HOST": "db", "DB_NAME": "notes", "DB_USER": "u", "DB_PASSWORD": "p"}
    assert connection_from_env(env) == {"url": "jdbc:postgresql://db:5432/notes", "user": "u", "password": "p"}
    with pytest.raises(ValueError, match="DB_NAME"):
        connection_from_env({"DB_USER": "u", "DB_PASSWORD": "p"})
    assert parse_key_range("tasks=1:900:4") == ("tasks", (1, 900, 4))
    for bad in ("task=1:9:1", "tasks=9:1:2", "tasks=1:9:0"):
        with pytest.raises(ValueError):
            parse_key_range(bad)


def test_model_parquet_round_trip(spark, seed):
    base = os.path.join(tempfile.mkdtemp(prefix="ff-model-"), "m")
    write_model(seed, base)
    back = read_model(spark, base)
    for name in ("tax_documents", "tasks", "items", "cities"):
        a = sorted(tuple(r) for r in seed.table(name).collect())
        b = sorted(tuple(r) for r in back.table(name).collect())
        assert a == b, name


def test_stored_model_pushes_report_window_to_tasks_scan(spark, seed):
    from conftest import AS_OF

    from fiscalflow.operators.report import report_last_month

    base = os.path.join(tempfile.mkdtemp(prefix="ff-model-"), "m")
    write_model(seed, base)
    df = report_last_month(read_model(spark, base), AS_OF)
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # untruncated PushedFilters
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    scan = [ln for ln in plan.splitlines() if "tasks.parquet" in ln][0]
    assert "GreaterThanOrEqual(completed_at" in scan and "LessThan(completed_at" in scan
    assert "GreaterThanOrEqual(completed_on,2024-02-01)" in scan
    assert len(df.collect()) == 2


def test_stored_tasks_skip_row_groups_by_their_day(spark, seed, tmp_path):
    """30 files of a day each; the window reads the files of its days. Bounds within a
    day keep the rows on either side of them apart."""
    from pyspark.sql import functions as F

    from fiscalflow.operators.clustered_fact import rows_scanned

    tasks = spark.range(0, 30 * 24, 1, 30).select(
        "id", F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.expr("timestamp_ntz'2024-02-01 00:30:00' + make_dt_interval(0, cast(id as int))").alias("completed_at"),
        *[F.lit(12).cast("long").alias(c) for c in ("task_definition_id", "status_id", "assing_to_id", "completed_by_id", "process_instance_id")],
    )
    write_model(seed.with_tables(tasks=tasks), f"{tmp_path}/m")
    back = read_model(spark, f"{tmp_path}/m")
    assert back.tasks.columns == seed.tasks.columns
    lo, hi = (F.expr(f"timestamp_ntz'2024-02-{x}'") for x in ("03 12:00:00", "05 06:00:00"))
    found = back.tasks_between(lo, hi)
    assert found.columns == seed.tasks.columns and found.count() == 42
    assert rows_scanned(found) == 3 * 24
    moved = back.with_tables(tasks=tasks.filter("id < 60"))
    assert moved.tasks_between(lo, hi).count() == 0  # other tasks, not the stored ones


def test_a_query_opens_only_what_it_reads(spark, monkeypatch):
    """No table is opened by making the model, and a given schema starts no job."""
    from fiscalflow.sources import tpch

    opened = []
    plain = tpch.read_table
    monkeypatch.setattr(tpch, "read_table", lambda s, base, name, schema=None: opened.append(name) or plain(s, base, name, schema))
    spark.sparkContext.setJobGroup("lazy-model", "")
    model = tpch.model_from_tpch(spark, "/root/testdata/sf0.001")
    assert opened == []
    cities = model.cities
    assert opened == ["nation"] and cities is model.cities
    assert model.items.columns and opened == ["nation", "lineitem"]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("lazy-model") == []
    spark.sparkContext.setJobGroup("", "")


def test_stated_schemas_are_those_of_the_files(spark):
    from fiscalflow.sources.tpch import SOURCE_SCHEMAS, read_source

    for name in SOURCE_SCHEMAS:
        found = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").schema
        assert [(f.name, f.dataType) for f in read_source(spark, "/root/testdata/sf0.001", name).schema] == [(f.name, f.dataType) for f in found]
