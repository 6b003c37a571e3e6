"""Exact top-k against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm.topk_search import SortedLists, best_products, scaled

SCHEMA = "vec_id bigint, embedding array<double>, score double, block string"
LIMIT = (1 << 63) - 1


def whole(x):
    return [math.floor(v * 1024) if abs(v) < 2**52 else int(v) * 1024 for v in x]


def brute(rows, k, every):
    vectors = {i: whole(v) for i, v in rows}
    out = []
    for q in sorted(vectors):
        if q % every == 0:
            score = lambda v: max(-LIMIT - 1, min(LIMIT, sum(a * b for a, b in zip(vectors[q], v))))
            scores = sorted((-score(v), i) for i, v in vectors.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, "x") for i, v in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block, askers", [(50, 3), (500, 8192), (5000, 8192)])
def test_all_scores(spark, block, askers):
    r = np.random.default_rng(block)
    centres = r.normal(size=(3, 12))
    x = np.concatenate([r.normal(size=(300, 12)), centres[r.integers(0, 3, 300)] + 0.02 * r.normal(size=(300, 12)), np.tile(centres[:1], (200, 1)), np.zeros((3, 12))])
    x[::7, 3] = 0
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(len(x)), x)]
    assert got(best_products(table(spark, rows), F.col("vec_id") % 100 == 0, block=block, askers=askers)) == brute(rows, 10, 100)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    bad = [(3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [])]
    rows = [(0, [1.0, -0.5]), (100, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (7, [-0.0001, 0.3]), (200, [1e300, -1e300]), (10, [1e300, 1e300]), (11, [1e9, 2e9])]
    result = best_products(table(spark, bad + rows + [(1, [1.0, 0.0])]), F.col("vec_id") % 100 == 0, k=4)
    assert got(result) == brute(rows, 4, 100)
    assert best_products(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert best_products(table(spark, bad[:4]), F.col("vec_id") % 100 == 0).count() == 0
    assert got(best_products(table(spark, [(0, [1.0])]), F.col("vec_id") % 100 == 0)) == []


def test_lists_are_not_read_to_the_end(monkeypatch):
    r = np.random.default_rng(5)
    rows = scaled(np.concatenate([r.normal(size=(4000, 8)) * 0.1, r.normal(size=(20, 8)) * 0.02 + np.full(8, 2.0)]))
    lists, query, read = SortedLists(rows, np.arange(len(rows))), scaled(np.full(8, 1.0)), []
    add = np.add.at
    monkeypatch.setattr("docweave.llm.topk_search.np.add", type("Add", (), {"at": staticmethod(lambda a, i, b: (read.append(len(i)), add(a, i, b)))}))
    places, scores = lists.search(query, -1, 5, -(1 << 63))
    want = sorted(range(len(rows)), key=lambda i: (-int(rows[i] @ query), i))[:5]
    assert places.tolist() == want and scores.tolist() == [int(rows[i] @ query) for i in want]
    assert sum(read) < 0.05 * rows.size
    read.clear()
    assert not len(lists.search(query, -1, 5, 10**12)[0]) and not read  # a block that cannot reach the bar is not read


def test_random_lists():
    r = random.Random(1)
    for _ in range(60):
        n, d, k = r.randint(1, 90), r.randint(1, 5), r.randint(1, 6)
        rows = np.array([[r.randint(-4, 4) for _ in range(d)] for _ in range(n)], dtype=np.int64)
        query, ids = rows[r.randrange(n)], np.array(r.sample(range(1000), n))
        want = sorted((-int(v @ query), int(i)) for v, i in zip(rows, ids) if i != ids[0])
        least = -want[r.randrange(len(want))][0] if want and r.random() < 0.5 else -(1 << 63)
        places, scores = SortedLists(rows, ids).search(query, int(ids[0]), k, least)
        assert [(-int(s), int(ids[p])) for p, s in zip(places, scores)] == [w for w in want if -w[0] >= least][:k]
