from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fiscalflow import schemas  # noqa: E402
from fiscalflow.session import build_session  # noqa: E402
from fiscalflow.sources.model import model_from_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="fiscalflow-tests-")
    s = build_session(
        "local[4]",
        app_name="fiscalflow-tests",
        shuffle_partitions=4,
        extra={"spark.local.dir": scratch},
    )
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(os.path.join(scratch, "checkpoints"))
    yield s
    s.stop()


def ts(y, m, d, hh=0, mm=0):
    return dt.datetime(y, m, d, hh, mm)


# Fixed evaluation date of the seed scenarios.
AS_OF = dt.date(2024, 3, 15)
M1 = ts(2024, 2, 15)  # as_of - 1 month (midnight)
M3 = ts(2023, 12, 15)  # as_of - 3 months


def build_model(spark, **rows):
    """A Model from python rows per table (missing tables: seed geography and the
    fixed code tables, other tables empty)."""
    rows.setdefault("states", [(1, "Serra"), (2, "Porto Novo")])
    rows.setdefault(
        "cities", [(1, "Lagoa Clara", 1), (2, "Vista Longa", 1), (3, "Porto Novo", 2)]
    )
    tables = {
        name: spark.createDataFrame(data, schemas.SCHEMAS[name]) for name, data in rows.items()
    }
    return model_from_tables(spark, tables, schemas.SCHEMAS)


def doc(id_, number=None, type_="MaterialInvoice", total=None, sup=None, cust=None,
        sup_city=None, cust_city=None, pid=None):
    return (id_, number, type_, total, sup, cust, None, None, sup_city, cust_city,
            pid if pid is not None else id_ + 500)


def item(id_, po, doc_id, total=None):
    return (id_, None, None, total, po, doc_id)


def task(id_, created, completed, definition, status, pid):
    return (id_, created, completed, definition, status, None, None, pid)


# (document, its type, purchase orders of its items, completion, status, reported)
SCENARIOS = [
    (41, "MaterialInvoice", ["W-30"], M1, 120, True),
    (42, "MaterialInvoice", ["W-8", "W-31", "W-8"], M1, 120, True),
    (43, "MaterialInvoice", ["W-1"], M3, 120, False),
    (44, "ServiceInvoice", ["W-2"], M1, 120, False),
    (45, "MaterialInvoice", ["W-3"], M1, 121, False),
]
PARTIES = {41: (7301, 640.0, "4070001", 1, 2), 42: (7302, 88.5, "815500090001", 3, 1)}


def seed_rows(unconfounded: bool = False):
    """The rows of ``SCENARIOS``. Only reported documents name parties and cities;
    ``unconfounded`` gives cities to the others too, so that each of them is left out
    by its own filter only."""
    documents, items, tasks = [], [], []
    for id_, type_, orders, completed, status, reported in SCENARIOS:
        number, total, supplier, city, customer_city = PARTIES.get(id_, (None, None, None, *((2, 3) if unconfounded else (None, None))))
        documents.append(doc(id_, number, type_, total, supplier, "63000000000017" if reported else None, city, customer_city, 10 * id_))
        items += [item(10 * id_ + i, order, id_) for i, order in enumerate(orders)]
        tasks.append(task(id_, completed if reported else None, completed, 12, status, 10 * id_))
    return {"tax_documents": documents, "items": items, "tasks": tasks}


@pytest.fixture()
def seed(spark):
    return build_model(spark, **seed_rows())


@pytest.fixture()
def seed_unconfounded(spark):
    return build_model(spark, **seed_rows(unconfounded=True))
