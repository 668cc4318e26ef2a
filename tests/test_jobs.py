"""The batch report job."""

from __future__ import annotations

import argparse
import os
import tempfile
from pathlib import Path

import pytest

from fiscalflow.jobs import run_report

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_report_job_writes_csv(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="ff-job-"), "out")
    args = argparse.Namespace(tpch=SF, model=None, out=out, as_of="2000-03-31", format="csv",
                              jdbc=False, key_range=[], shuffle_partitions=None)
    path = run_report(spark, args)
    assert path.endswith("relatorio_notas_2000-03-31")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 4


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_report_job_nothing_to_write(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="ff-job-"), "out")
    args = argparse.Namespace(tpch=SF, model=None, out=out, as_of="1990-01-15", format="csv",
                              jdbc=False, key_range=[], shuffle_partitions=None)
    assert run_report(spark, args) is None
    assert not os.path.exists(out)
