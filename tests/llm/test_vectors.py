"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm.vector_search import nearest

SF = "/root/testdata/sf0.1"


def brute(ids, vectors, k):
    out = {}
    order = np.argsort(ids)
    ids, vectors = ids[order], vectors[order]
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[i]).sum(axis=1)
        kept = np.flatnonzero(ids != ids[i])
        best = kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in best]
    return out


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("block", [64, 100_000])
def test_recall(spark, block):
    r = np.random.default_rng(1)
    centres = r.normal(size=(4, 24))
    x = np.concatenate([r.normal(size=(900, 24)), centres[r.integers(0, 4, 900)] + r.normal(size=(900, 24)) * 0.05, np.tile(centres[:1], (200, 1))])
    x[:1800] *= r.uniform(0.5, 2, 1800)[:, None]
    ids = r.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), 0.0) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>, score double").repartition(3)
    got, want = grouped(nearest(df, F.col("vec_id") % 20 == 0, block=block)), brute(ids, x, 20)
    assert set(got) == set(want)
    if block > len(x):
        assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all(s == pytest.approx(float((x[ids == i][0] * x[ids == q][0]).sum()), rel=1e-12) for q in list(got)[:20] for i, s in got[q])


def test_recall_on_a_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    got = grouped(nearest(df, F.col("vec_id") % 20 == 0, block=128))
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64), 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (20, [-3.0, 1.0]), (40, [0.0, 0.0])]
    got = grouped(nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3))
    assert got == {0: [(1, 1.0), (2, 1.0), (20, -3.0)], 20: [(0, -3.0), (1, -3.0), (2, -3.0)]}
    assert nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0
