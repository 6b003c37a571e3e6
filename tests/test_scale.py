"""The split and salted paths give the same rows as the plain ones."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window as W, functions as F

from docweave.operators import dedup, dialogue, ordering


def turns(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [(("hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"), rng.randrange(10_000), i, rng.choice([None, rng.randrange(50)])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, id long, v long")


def test_ordered_scan_equals_window(spark):
    df = turns(spark)
    w = W.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"),
                     F.last("v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("b"))
    got = ordering.ordered_scan(df, ["k"], ["t", "id"], {"s": F.coalesce("v", F.lit(0))}, {"b": F.col("v")}, target_rows=25).select("id", "s", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    pieces = ordering.cut_pieces(df, ["k"], ["t", "id"], 25).groupBy("k").agg(F.count_distinct("_piece").alias("n")).collect()
    assert dict(map(tuple, pieces))["hot"] > 10


EDGES = [None, -9 * 10**18, 9 * 10**18, 0]


@pytest.mark.parametrize("target", [2, 50])
def test_pieces_do_not_change_results(spark, target):
    """Null keys and order values, the ends of the number range, one outlier, one value shared by a whole key."""
    rng = random.Random(8)
    rows = [(None if rng.random() < 0.4 else "k", rng.choice(EDGES), i, i % 5) for i in range(120)]
    rows += [("outlier", i, 200 + i, 1) for i in range(99)] + [("outlier", 10**18, 299, 1)]
    rows += [("same", 7, 300 + i, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    w = W.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("b"))
    for size in (target, ordering.TARGET_ROWS):
        got = ordering.ordered_scan(df, ["k"], ["t", "id"], {"s": F.col("v")}, {"b": F.col("v")}, target_rows=size).select("id", "s", "b")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    largest = ordering.cut_pieces(df, ["k"], ["t", "id"], target).groupBy("k", "_piece").count().agg(F.max("count")).first()[0]
    assert largest <= 2 * target
    whole = W.orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    total = ordering.global_scan(df, ["t", "id"], {"s": F.col("v")}, target_rows=target).select("id", "s")
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, df.select("id", F.sum("v").over(whole)).collect()))


def test_trailing_rows_equal_window(spark):
    df = turns(spark).fillna(-1)
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(-6, -1)
    want = df.select("id", F.collect_list("v").over(w).alias("x"))
    got = ordering.trailing_rows(df, ["k"], ["t", "id"], F.col("v"), 6, "x", target_rows=25, block=10).select("id", "x")
    assert sorted((r[0], tuple(r[1])) for r in got.collect()) == sorted((r[0], tuple(r[1])) for r in want.collect())


def test_global_scan(spark):
    df = turns(spark)
    got = ordering.global_scan(df.select("id"), ["id"], {"n": F.lit(1)}, target_rows=50).select("id", "n").collect()
    assert all(r["n"] == r["id"] + 1 for r in got) and len(got) == 600


def test_sessions_split_equals_whole(spark):
    df = turns(spark).withColumn("ts", F.timestamp_seconds(F.col("t") * 7))
    a = dialogue.session_numbers(df, ["k"], ["ts", "id"], 300).select("id", "session_no")
    b = dialogue.session_numbers(df, ["k"], ["ts", "id"], 300, target_rows=20).select("id", "session_no")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_session_boundary_is_strict(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1800, 2), ("a", 3601, 3)], "k string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["session_no"] for r in dialogue.session_numbers(df, ["k"], ["ts", "id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_copies_of_null_are_copies(spark):
    rows = [(i, "same" if i % 3 else None if i % 2 else f"u{i % 50}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string")
    sizes = Counter(t for _, t in rows)
    groups = {r["group_key"]: r["members"] for r in dedup.duplicate_groups(df, F.col("text"), "id").collect()}
    assert groups == {t: n for t, n in sizes.items() if n > 1}
    assert dedup.duplicate_pairs(df, F.col("text"), "id").count() == len(rows) - len(sizes)
    kept = {r["id"] for r in dedup.keep_first(df, F.col("text"), "id").collect()}
    assert kept == {r["id"] for r in dedup.first_per_key(df, ["text"], ["id"]).collect()}
    first = {}
    for i, text in rows:
        first.setdefault(text, i)
    assert kept == set(first.values())


@pytest.mark.parametrize("target", [20, 2_000_000])
def test_answer_starts(spark, target):
    rng = random.Random(5)
    asked = [(rng.choice("ab"), rng.randrange(1_000_000)) for _ in range(300)]
    want = []
    for key in "ab":
        start = None
        for t in sorted(t for k, t in asked if k == key):
            if start is None or t >= start + 86_400:
                start = t
                want.append((key, t * 1_000_000))
    df = spark.createDataFrame(asked, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = dialogue.answer_starts(df, ["k"], "ts", target_rows=target)
    assert sorted(map(tuple, got.collect())) == sorted(want)
