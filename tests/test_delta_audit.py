"""Audits by batches of changes against audits of the whole tables."""

from __future__ import annotations

import random
import time

import pytest

from fiscalflow import schemas
from fiscalflow.operators import audit, delta_audit
from fiscalflow.operators.delta_audit import DeltaAudit
from fiscalflow.sources.model import empty, model_from_tables

CHANGING = ["states", "cities", "process_instances", "tax_documents", "items", "tasks", "users", "status"]


def random_row(rng, name):
    """A row whose keys come from a few values, one of them far more often."""
    key = lambda: rng.choice([None, 1, 1, 1, 2, 3, 4, 5, 6])
    return tuple(
        key() if f.name == "id" or f.name.endswith("_id") else None
        for f in schemas.SCHEMAS[name].fields
    )


def frames(spark, rows):
    return {n: spark.createDataFrame(r, schemas.SCHEMAS[n]).coalesce(1) for n, r in rows.items() if r}


def whole(spark, rows):
    bare = {n: empty(spark, n).coalesce(1) for n in ("task_definitions", "status")}
    return model_from_tables(spark, bare | frames(spark, rows), schemas.SCHEMAS)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def agrees(spark, state, rows):
    model = whole(spark, rows)
    assert found(state.audit_pk()) == found(audit.audit_pk(model))
    assert found(state.audit_fk()) == found(audit.audit_fk(model))


def test_equal_the_full_audits_after_every_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = {n: [random_row(rng, n) for _ in range(rng.randrange(6))] for n in CHANGING}
    state = DeltaAudit.start(spark, str(tmp_path / "a"), frames(spark, rows), buckets=4)
    agrees(spark, state, rows)
    for batch in range(3):
        removed = {n: [r for r in rows[n] if rng.random() < 0.4] for n in rng.sample(CHANGING, 5)}
        added = {n: [random_row(rng, n) for _ in range(rng.randrange(4))] for n in rng.sample(CHANGING, 4)}
        for n, gone in removed.items():
            for r in gone:
                rows[n].remove(r)
        for n, new in added.items():
            rows[n] += new
        state = state.apply(frames(spark, added), frames(spark, removed))
        agrees(spark, state, rows)
    agrees(spark, DeltaAudit.open(spark, state.root), rows)
    agrees(spark, state.compact(str(tmp_path / "b")), rows)
    agrees(spark, DeltaAudit.open(spark, str(tmp_path / "b")), rows)


def test_parent_that_leaves_and_comes_back(spark, tmp_path):
    state_row, city = [(9, "Serra")], [(1, "Lagoa Clara", 9), (2, "Vista Longa", 9)]
    parents, children = frames(spark, {"states": state_row}), frames(spark, {"cities": city})
    state = DeltaAudit.start(spark, str(tmp_path / "a"), parents | children, buckets=2)
    assert found(state.audit_fk()) == []
    state = state.apply({}, parents)
    assert found(state.audit_fk()) == [("cities.state_id -> states", 1, 9), ("cities.state_id -> states", 2, 9)]
    state = state.apply({}, frames(spark, {"cities": city[:1]}))
    assert found(state.audit_fk()) == [("cities.state_id -> states", 2, 9)]
    state = state.apply(parents)
    assert found(state.audit_fk()) == []
    assert found(state.apply(parents).audit_pk()) == [("states", 9, 2)]


def test_batches_read_the_buckets_of_their_keys(spark, tmp_path):
    """A new child of a frequent parent reads no stored reference; a key reads one bucket."""
    cities = [(i, None, 1) for i in range(200)]
    state = DeltaAudit.start(spark, str(tmp_path / "a"), frames(spark, {"states": [(1, "Serra")], "cities": cities}), buckets=16)
    one = spark.createDataFrame([("states", 1)], "parent string, fk_value long")
    assert len({f.split("bucket=")[1].split("/")[0] for f in state._touched("keys", one).inputFiles()}) == 1
    assert state._touched("refs", one.limit(0)).inputFiles() == []
    assert found(state.apply(frames(spark, {"cities": [(900, None, 1)]})).audit_fk()) == []


def test_uncommitted_batches_are_not_read(spark, tmp_path):
    root = str(tmp_path / "a")
    state = DeltaAudit.start(spark, root, frames(spark, {"states": [(1, "Serra")]}), buckets=2)
    state._append("keys", spark.createDataFrame([("states", 1, 1)], "parent string, fk_value long, change long"), "failed")
    again = DeltaAudit.open(spark, root).apply(frames(spark, {"cities": [(3, None, 1), (4, None, 8)]}))
    assert found(again.audit_pk()) == []
    assert found(again.audit_fk()) == [("cities.state_id -> states", 4, 8)]
    with pytest.raises(ValueError, match="holds the state"):
        DeltaAudit.start(spark, root, {})
    with pytest.raises(ValueError, match="no state"):
        DeltaAudit.open(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no such tables"):
        again.apply({"tabel": spark.range(1)})


def test_tasks_of_a_batch_follow_its_bytes(spark, tmp_path, monkeypatch):
    """Stored rows and the logs set the partitions of a batch; the session's settings are
    as before afterwards, also when it fails."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    settings = lambda: [spark.conf.get(n, None) for n in names]
    before, seen = settings(), []
    applied = DeltaAudit._applied
    monkeypatch.setattr(DeltaAudit, "_applied", lambda *args: seen.append(settings()) or applied(*args))
    monkeypatch.setattr(delta_audit, "TASK_STORED_BYTES", 16)
    path = str(tmp_path / "states")
    spark.range(5000).selectExpr("id", "cast(id as string) as name").write.parquet(path)
    states = spark.read.schema("id long, name string").parquet(path)
    state = DeltaAudit.start(spark, str(tmp_path / "a"), {"states": states.limit(20)}, buckets=2)
    assert int(seen[0][0]) > int(spark.conf.get(names[0])) and int(seen[0][1]) == delta_audit.TASK_SHUFFLE_BYTES
    assert settings() == before
    monkeypatch.setattr(DeltaAudit, "_applied", lambda *args: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        state.apply({"states": states.limit(1)})
    assert settings() == before


@pytest.mark.parametrize("few, rounds", [(-1, 2), (10**6, 1)])
def test_batches_of_any_size_equal_the_full_audits(spark, tmp_path, monkeypatch, few, rounds):
    """Keys are looked up in the log or summed up with it, and missing ones met in one or
    more rounds; keys and references come and go within a batch, rows repeat, and
    constraints may name other parents."""
    monkeypatch.setattr(delta_audit, "FEW_ROWS", few)
    monkeypatch.setattr(delta_audit, "FEW_KEYS", min(few, 10_000))
    monkeypatch.setattr(delta_audit, "ROUND_BYTES", 1 if rounds > 1 else 2**40)
    monkeypatch.setattr(delta_audit, "MOST_ROUNDS", rounds)
    rows = {
        "states": [(1, "Serra"), (1, "Serra"), (None, "none")], "users": [(7, "U", "u"), (2**50, "V", "v")],
        "cities": [(1, "Lagoa Clara", 1), (1, "Lagoa Clara", 1), (2, "Vista Longa", 5), (2, "Vista Longa", 5), (3, "Porto Novo", None)],
    }
    state = DeltaAudit.start(spark, str(tmp_path / "a"), frames(spark, rows), buckets=4)
    agrees(spark, state, rows)
    come_and_go = {"states": [(5, "Porto")], "cities": [(9, "Rua", 6), (3, "Porto Novo", None)], "users": []}
    gone = {"states": [(5, "Porto"), (1, "Serra"), (1, "Serra")], "cities": [(9, "Rua", 6), (2, "Vista Longa", 5)]}
    state = state.apply(frames(spark, come_and_go), frames(spark, gone))
    rows["states"], rows["cities"] = [(None, "none")], [*rows["cities"][:2], rows["cities"][2], *[(3, "Porto Novo", None)] * 2]
    agrees(spark, state, rows)
    other = state.apply(frames(spark, {"cities": [(4, "Sul", 77)]}), None, [("cities", "state_id", "elsewhere")])
    assert set(found(other.audit_fk())) == {*found(state.audit_fk()), ("cities.state_id -> elsewhere", 4, 77)}
    assert set(found(other.apply(frames(spark, {"states": [(1, "Serra")]})).audit_fk())) == {
        ("cities.state_id -> elsewhere", 4, 77), ("cities.state_id -> states", 2, 5)
    }


def test_rows_of_a_batch_are_made_once(spark, tmp_path):
    """Keys, references and their state come of one pass over the rows."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    cities = spark.createDataFrame([(i, None, i % 3) for i in range(50)], schemas.SCHEMAS["cities"])
    state = DeltaAudit.start(spark, str(tmp_path / "a"), {"cities": cities.mapInArrow(counted, cities.schema)}, buckets=2)
    assert made.value == 50 and len(found(state.audit_fk())) == 50
    assert [p for p in (tmp_path / "a" / "staged").rglob("*") if p.is_file()] == []


def test_shuffle_files_of_a_batch_go_with_it(spark, tmp_path):
    """What a batch shuffled does not lie on the disks until the driver collects garbage."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = shuffled()
    DeltaAudit.start(spark, str(tmp_path / "a"), frames(spark, {"states": [(1, "Serra")] * 2, "cities": [(1, None, 4)]}), buckets=2)
    deadline = time.time() + 30  # they are deleted in the background
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
