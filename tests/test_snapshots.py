"""Compacted batches: bounded reads, crashes between merge and switch, repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.streaming import jobs
from docweave.streaming.files import stream_table
from docweave.streaming.snapshots import Snapshots, latest

SCHEMA = "k long, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def value(table):
    return sorted((r.k is None, r.k or 0, r.v) for r in table.read().collect())


def wanted(batches):
    last = {}
    for rows in batches:
        fresh = {}
        for k, v in rows:
            fresh.setdefault(k, []).append(v)
        last |= fresh
    return sorted((k is None, k or 0, v) for k, vs in last.items() for v in vs)


def some_batches(n, seed=1):
    r = random.Random(seed)
    return [[(r.choice([None, *range(6)]), r.randrange(100)) for _ in range(r.randrange(5))] for _ in range(n)]


def test_reads_are_bounded(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), frame(spark, []).schema, latest("k"), 3)
    assert value(table) == []
    batches = some_batches(11)
    for n, rows in enumerate(batches):
        table.append(frame(spark, rows).coalesce(1), n)
        assert value(table) == wanted(batches[: n + 1])
    assert table.manifest()[0] == 3 and table.manifest()[2] == 8
    files = {f.split("/t/")[1] for f in table._stored().inputFiles()}
    assert not any(f.startswith("tail") and "batch=8" in f for f in files) and {f.split("/")[0].split("-")[0] for f in files} == {"base", "tail"}
    assert len({f.split("/")[1] for f in files if f.startswith("tail")}) <= 3


@pytest.mark.parametrize("at", ["_switch", "_empty"])
def test_a_crash_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch, at):
    table = Snapshots(spark, str(tmp_path / "t"), frame(spark, []).schema, latest("k"), 2)
    batches = some_batches(6, 2)
    for n, rows in enumerate(batches[:3]):
        table.append(frame(spark, rows), n)
    calls = []

    def crash(*args):
        calls.append(args)
        raise OSError("executor lost")

    monkeypatch.setattr(table, at, crash)
    with pytest.raises(OSError):
        table.append(frame(spark, batches[3]), 3)
    monkeypatch.undo()
    assert calls and table.manifest()[2] == 1 and value(table) == wanted(batches[:4])
    table.append(frame(spark, batches[3]), 3)  # the batch comes again and is merged
    assert table.manifest()[2] == 3 and value(table) == wanted(batches[:4])
    table.append(frame(spark, [(0, -1)]), 3)   # and once more, when a merge holds it
    for n in (4, 5):
        table.append(frame(spark, batches[n]), n)
    assert value(table) == wanted(batches) and table.manifest()[:1] == (3,)


def test_an_old_reader_keeps_its_version(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), frame(spark, []).schema, latest("k"), 2)
    table.append(frame(spark, [(1, 1)]), 0)
    before = table.read()
    table.append(frame(spark, [(1, 2)]), 1)
    assert [r.v for r in before.collect()] == [1] and value(table) == [(False, 1, 2)]


@pytest.mark.parametrize("every", [1, 50])
def test_jobs_do_not_depend_on_merges(spark, tmp_path, every):
    r = random.Random(4)
    src = str(tmp_path / "turns")
    rows = [(r.randrange(5), n, r.choice(["a", "b", None])) for n in range(120)]
    for n in range(0, 120, 20):
        spark.createDataFrame(rows[n:n + 20], "k long, at long, v string").coalesce(1).write.mode("append").parquet(src)
    memory = jobs.session_memory(stream_table(spark, src, 1), "k", "at", F.col("v"), str(tmp_path / "memory"), every)
    want = {k: (sum(x[0] == k for x in rows), [x[2] for x in rows if x[0] == k and x[2]][-1]) for k in {x[0] for x in rows}}
    assert {r.k: (r.turns, r.remembered) for r in memory.collect()} == want
    rated = jobs.feedback(stream_table(spark, src, 1), ["k"], "v", "at", str(tmp_path / "rated"), every)
    assert {r.k: (r.created_at, r.updated_at) for r in rated.collect()} == {k: (min(x[1] for x in rows if x[0] == k), max(x[1] for x in rows if x[0] == k)) for k in want}
