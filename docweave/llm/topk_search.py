"""Exact top-k by inner product of whole-number vectors: no-random-access aggregation over sorted lists.

Rows are dealt into blocks of neighbouring rows. A block holds one list per component, sorted by value; a query reads
all its lists in step, each from the end that its own component's sign makes the better one. A row's score lies
between what was read of it plus the worst values of the lists where it was not yet met, and the same plus these lists'
current values. A row that was never met scores at most the sum of all current values. Reading stops when no row
outside the contenders can reach the k-th lower bound, and the few contenders' scores are resolved. Every query first
searches its own block; the k-th score found there is the least it accepts from all other blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from docweave.llm.graph import sorted_groups
from docweave.streaming.files import stored

BEST = 10
SCALE = 1024
BLOCK = 4096       # rows of a block
BLOCKS = 24        # blocks of a small table, so that tasks can share it
ASKERS = 8192      # queries that meet a block in one task
PLANES = 16        # signs that bring neighbouring rows together
FIRST = 32         # entries of each list that are read first; each later reading doubles the depth
FEW = 4            # times k: contenders that are resolved rather than read on for
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite doubles, in int64 where all of it fits, else in Python's whole numbers."""
    with np.errstate(over="ignore"):
        moved = np.floor(values * SCALE)
    if (np.abs(moved) < 2.0**62).all():
        return moved.astype(np.int64)
    whole = [math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def _fits(rows: np.ndarray, query_peak: int) -> bool:
    """Whether every sum of products is an exact int64."""
    if rows.dtype == object:
        return False
    return rows.shape[1] * int(np.abs(rows).max(initial=0)) * query_peak < 1 << 62


class SortedLists:
    """The lists of one block: for each component the rows by value, smallest first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(rows.T, self.order, axis=1)

    def search(self, query: np.ndarray, own: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (by place) and exact scores of the k best rows but ``own`` with a score of at least ``least``, best first,
        equal scores by id."""
        n, used = len(self.ids), np.flatnonzero(query != 0)
        weights = query[used]
        forward = (weights > 0)[:, None]
        best_first = lambda a, lo, hi: np.where(forward, a[used, n - hi:n - lo][:, ::-1], a[used, lo:hi])
        worst = weights * np.where(forward[:, 0], self.values[used, 0], self.values[used, -1])
        met = np.zeros((n, len(used)), dtype=bool)
        known = np.zeros(n, dtype=self.rows.dtype)
        other = self.ids != own
        bar, depth, frontier = least, 0, weights * np.where(forward[:, 0], self.values[used, -1], self.values[used, 0])
        contenders = np.flatnonzero(other)
        while depth < n and len(used):
            unmet_fail = LEAST < bar > int(frontier.sum())  # rows that no list has shown yet cannot qualify
            if unmet_fail and not depth:
                return contenders[:0], known[:0]
            if unmet_fail and len(contenders) <= FEW * k:
                break
            deeper = min(n, max(FIRST, 2 * depth))
            places = best_first(self.order, depth, deeper)
            read = weights[:, None] * best_first(self.values, depth, deeper)
            columns = np.broadcast_to(np.arange(len(used))[:, None], places.shape)
            np.add.at(known, places.ravel(), read.ravel())
            met[places.ravel(), columns.ravel()] = True
            depth, frontier = deeper, read[:, -1]
            low = known + (~met) @ worst
            high = known + (~met) @ frontier
            if int(other.sum()) >= k:
                bar = min(max(bar, int(np.partition(low[other], -k)[-k])), MOST)
            contenders = np.flatnonzero(other & (high >= bar)) if bar > LEAST else contenders
        score = (self.rows[contenders] * query).sum(axis=1)
        if score.dtype == object:
            score = np.array([min(max(x, LEAST), MOST) for x in score.tolist()], dtype=np.int64)
        contenders, score = contenders[score >= least], score[score >= least]
        chosen = np.lexsort((self.ids[contenders], ~score))[:k]
        return contenders[chosen], score[chosen]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _searched(k: int):
    """query_id, vec_id and score of the best rows that the queries of a cell find in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, ["block", "ask"]):
            asking = cell["asks"].to_numpy()
            if asking.all() or not asking.any():
                continue
            ids, vectors, least = cell["vec_id"].to_numpy(), scaled(_matrix(cell["vector"])), cell["least"].to_pylist()
            asked = np.flatnonzero(asking)
            if not _fits(vectors, max(int(np.abs(vectors[asked]).max(initial=0)), 1)):
                vectors = vectors.astype(object)
            lists = SortedLists(vectors[~asking], ids[~asking])
            for at in range(0, len(asked), 256):
                found = [(int(ids[i]), *lists.search(vectors[i], int(ids[i]), k, LEAST if least[i] is None else least[i])) for i in asked[at:at + 256]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([q for q, _, _ in found], [len(p) for _, p, _ in found]).astype(np.int64)),
                     pa.array(np.concatenate([lists.ids[p] for _, p, _ in found])),
                     pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

    return run


def sound_vectors(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, one per id; see ``best_products``."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.select(F.col(id_).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    sound = sound.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    return sound.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _placed(dimension: int):
    """vec_id, vector as bytes, and the signs of fixed projections: rows of like signs become neighbours."""
    planes = np.random.default_rng(13).normal(size=(dimension, PLANES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimension)
            with np.errstate(over="ignore", invalid="ignore"):
                signs = (x @ planes > 0) @ (1 << np.arange(PLANES - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(signs.astype(np.int64))],
                                             ["vec_id", "vector", "signs"])

    return run


def best_products(rows: DataFrame, is_query: Column, id_: str = "vec_id", vector: str = "embedding", k: int = BEST, block: int = BLOCK,
                  askers: int = ASKERS) -> DataFrame:
    """The k rows with the largest inner product of floor(1024 * x) for every query: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on ``vec_id``. A query's own row is no candidate; equal scores go to the smaller vec_id;
    with fewer candidates all are returned. Null ids, null or empty vectors and vectors with null or non-finite
    components take no part, nor do those of another length than most have; zero vectors do. Of several rows of one id
    the smallest vector counts. Scores beyond a bigint count as its limit. Other columns are
    ignored. Empty tables give no rows.

    Blocks of ``block`` rows and groups of ``askers`` queries bound a task; the k-th score of a query's own block
    keeps the other blocks' answers few.
    """
    vectors = stored(sound_vectors(rows, id_, vector), "vectors")
    sizes = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dimension, n = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
    blocks = max(math.ceil(n / block), min(BLOCKS, math.ceil(n / 64)), 1)
    placed = vectors.where(F.size("vector") == dimension).mapInArrow(_placed(dimension), "vec_id bigint, vector binary, signs bigint")
    placed = placed.repartitionByRange(blocks, "signs", F.xxhash64("vec_id")).select("vec_id", "vector", F.spark_partition_id().cast("bigint").alias("block"))
    table = stored(placed.withColumn("query", is_query), "blocks")
    last = table.agg(F.max("block")).first()[0] or 0
    found_type = "query_id bigint, vec_id bigint, score bigint"

    def cells(rows: DataFrame, queries: DataFrame) -> DataFrame:
        both = rows.withColumns({"asks": F.lit(False), "least": F.lit(None).cast("bigint")}).unionByName(queries.withColumn("asks", F.lit(True)))
        both = both.select("vec_id", "vector", "block", "ask", "asks", "least")
        return both.repartition(4 * (last + 1), "block", "ask").sortWithinPartitions("block", "ask").mapInArrow(_searched(k), found_type)

    asked = table.where("query").withColumn("ask", F.lit(0).cast("bigint")).withColumn("least", F.lit(None).cast("bigint"))
    near = stored(cells(table.drop("query").withColumn("ask", F.lit(0).cast("bigint")), asked.drop("query")), "near")
    least = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    groups = max(1, math.ceil(table.where("query").count() / askers))
    ask = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    queries = table.where("query").select("vec_id", "vector", F.col("block").alias("home")).join(
        least.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
    queries = queries.withColumn("ask", ask).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last)))).where("block <> home").drop("home")
    met = table.drop("query").withColumn("ask", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    found = near.unionByName(cells(met, queries))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
