"""Nearest neighbours by inner product with a forest of hash prefixes.

Vectors are lifted so that the angle orders them by inner product (one more component brings all to the greatest
norm). Every tree gives each vector a string of ``BITS`` hyperplane signs. The rows of a tree with a common prefix
form a group; in it, sorted by their strings, a query descends to its longest match and ascends bit by bit for more
rows. All trees ascend together: a round searches all groups of one prefix length, and a query goes on to shorter
prefixes until a row as near as its last neighbour would have been missed by all trees with a probability of at
most ``MISS``. The shortest prefix is empty: there all rows are scanned, in blocks, so no query is given up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.graph import sorted_groups
from docweave.streaming.files import stored

NEAREST = 20
TREES = 12
BITS = 64
MISS = 0.05
BLOCK = 2048  # rows, and queries, that one task compares at a time
ASKED = 128  # queries of a block in one matrix product
SHORTEST = 6  # bits of the shortest prefix but the empty one: below it, all trees together hold about every row
ASCENT = (56, 48, 40, 32, 24, 20, 16, 12, 10, 8, 6, 4, 2)  # prefix lengths tried inside a group


def valid_vectors(rows: DataFrame, id_: str, vector: str) -> tuple[DataFrame, int]:
    """vec_id and vector (array<double>) of the rows that take part, one for each id, and their dimension.

    Null ids, null and zero vectors, and vectors with null or non-finite components take no part, nor do those of
    another length than most have. Of several rows of one id the smallest vector counts.
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    sound = rows.select(F.col(id_).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    sizes = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dimension = sizes[0]["n"] if sizes else 0
    return sound.where(F.size("vector") == dimension).groupBy("vec_id").agg(F.min("vector").alias("vector")), dimension


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def hashed(vectors: DataFrame, dimension: int, greatest: float, trees: int, is_query) -> DataFrame:
    """vec_id, query, vector (bytes of doubles) and one string a tree, as a bigint; queries have no lifted component."""
    planes = np.random.default_rng(3).normal(size=(dimension + 1, trees * BITS))
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                lift = np.sqrt(np.maximum(0, greatest**2 - (x * x).sum(axis=1)))
                flat = x @ planes[:-1]
                strings = [(((flat + extra) > 0).reshape(part.num_rows, trees, BITS) * weights).sum(axis=2, dtype=np.uint64).view(np.int64)
                           for extra in (lift[:, None] * planes[-1], 0)]
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["query"], raw, *[pa.array(s.tolist(), pa.list_(pa.int64())) for s in strings]],
                                                 ["vec_id", "query", "vector", "strings", "asked"])

    return vectors.withColumn("query", is_query).select("vec_id", "query", "vector").mapInArrow(
        run, "vec_id bigint, query boolean, vector binary, strings array<bigint>, asked array<bigint>")


def settled(cosine: np.ndarray | float, bits: int, trees: int, miss: float) -> np.ndarray | bool:
    """Whether all trees miss a row of this cosine at this prefix length with a probability of at most ``miss``."""
    agree = (1 - np.arccos(np.clip(cosine, -1, 1)) / math.pi) ** bits
    return (1 - agree) ** trees <= miss


def _best(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k nearest rows; ``rough`` products choose what is summed in a fixed order."""
    kept = np.flatnonzero(ids != own)
    if len(kept) > k:
        r = rough[kept]
        edge = np.partition(r, len(r) - k)[len(r) - k]
        kept = kept[r >= edge - 1e-9 * max(1e-300, np.abs(r).max())]
    exact = (rows[kept] * query).sum(axis=1)
    order = np.lexsort((ids[kept], -exact))[:k]
    return ids[kept][order], exact[order]


def _search(trees: int, bits: int, k: int, miss: float, greatest: float):
    """Each query of a cell (rows and queries of one group) with its nearest rows there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_groups(batches, ["tree", "prefix", "block", "ask"]):
            asking = cell["query"].to_numpy()
            if asking.all() or not asking.any():
                continue
            ids, strings, vectors = cell["vec_id"].to_numpy(), cell["string"].to_numpy().view(np.uint64), _matrix(cell["vector"])
            order = np.flatnonzero(~asking)
            order = order[np.argsort(strings[order], kind="stable")]
            rows, row_ids, row_strings = vectors[order], ids[order], strings[order]
            asked = np.flatnonzero(asking)
            for at in range(0, len(asked), ASKED):
                some = asked[at:at + ASKED]
                rough = vectors[some] @ rows.T
                found = [_one(rows, row_ids, row_strings, vectors[i], int(ids[i]), strings[i], r, trees, bits, k, miss, greatest)
                         for i, r in zip(some, rough)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())),
                                                  pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

    return run


def _one(rows, ids, strings, query, own, string, rough, trees, bits, k, miss, greatest):
    norm = math.sqrt((query * query).sum())
    for length in ASCENT:
        if length <= bits:
            break
        low = np.uint64((1 << (BITS - length)) - 1)
        a = int(np.searchsorted(strings, string & ~low, side="left"))
        b = int(np.searchsorted(strings, string | low, side="right"))
        if b - a <= k:
            continue
        if 2 * (b - a) > len(rows):
            break
        near = _best(rows[a:b], ids[a:b], query, own, k, rough[a:b])
        if len(near[1]) == k and settled(near[1][-1] / (norm * greatest), length, trees, miss):
            return near
    return _best(rows, ids, query, own, k, rough)


def _merged(k: int):
    """The k nearest of each query over all its cells, folded as they come; rows are sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best, out = None, {}, []

        def close() -> None:
            if current is not None:
                top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
                out.extend((current, rank, i, s) for rank, (i, s) in enumerate(top, 1))

        for batch in batches:
            for query, ids, scores in zip(*[batch[c].to_pylist() for c in ("query_id", "ids", "scores")]):
                if query != current:
                    close()
                    current, best = query, {}
                best.update(zip(ids, scores))
                if len(best) > 64 * k:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
            yield _ranked(out)
            out = []
        close()
        yield _ranked(out)

    return run


def _ranked(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))],
                                      ["query_id", "rank", "vec_id", "score"])


def _round(table: DataFrame, active: DataFrame, bits: int, trees: int, k: int, miss: float, greatest: float, block: int) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows that the active queries find in all groups of one prefix length."""
    trees = trees if bits else 1  # without a prefix all trees hold the same rows

    def strung(df: DataFrame, column: str) -> DataFrame:
        flat = df.select("vec_id", "query", "vector", F.posexplode(F.slice(column, 1, trees)).alias("tree", "string"))
        return flat.withColumn("prefix", F.shiftrightunsigned("string", BITS - bits) if bits else F.lit(0).cast("bigint"))

    rows = strung(table.withColumn("query", F.lit(False)), "strings")
    queries = strung(table.where("query").join(active, F.col("vec_id") == F.col("query_id"), "left_semi"), "asked")
    group = ["tree", "prefix"]
    asks = queries.groupBy(*group).agg(F.count("*").alias("asks"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("rows")).join(asks, group)
    blocks = sizes.select(*group, F.ceil(F.col("rows") / block).alias("blocks"), F.ceil(F.col("asks") / block).alias("askers"))
    mine, spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    columns = ["vec_id", "query", "vector", "string", *group, "block", "ask"]
    dealt = rows.join(blocks, group).withColumn("block", mine("blocks")).withColumn("ask", spread("askers")).select(*columns).union(
        queries.join(blocks, group).withColumn("ask", mine("askers")).withColumn("block", spread("blocks")).select(*columns))
    cell = [*group, "block", "ask"]
    found = dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(
        _search(trees, bits, k, miss, greatest), "query_id bigint, ids array<bigint>, scores array<double>")
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(
        _merged(k), "query_id bigint, rank int, vec_id bigint, score double")


def nearest(rows: DataFrame, is_query, id_: str = "vec_id", vector: str = "embedding", k: int = NEAREST, trees: int = TREES,
            miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """The k rows of the largest inner product for every query row: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on ``vec_id``. A query's own row is no candidate; equal scores go to the smaller
    vec_id; with fewer candidates than k all are returned. Which rows take part: see ``valid_vectors``. All rows
    are indexed. Empty tables give no rows.
    """
    vectors, dimension = valid_vectors(rows, id_, vector)
    vectors = stored(vectors, "vectors")
    n, greatest = vectors.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    greatest = math.sqrt(greatest or 0.0)
    table = stored(hashed(vectors, dimension, greatest, trees, is_query), "strings")
    active, found = table.where("query").select(F.col("vec_id").alias("query_id")), []
    bits = max(SHORTEST, math.ceil(math.log2(max(1, n / block))))
    while True:
        got = stored(_round(table, active, bits, trees, k, miss, greatest, block), "found")
        if not bits:
            found.append(got)
            break
        norms = table.where("query").select(F.col("vec_id").alias("query_id"), "vector").mapInArrow(_norms, "query_id bigint, norm double")
        last = got.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("n")).join(norms, "query_id")
        agree = F.pow(1 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("last") / (F.col("norm") * F.lit(greatest))))) / math.pi, bits)
        done = last.where((F.col("n") == k) & (F.pow(1 - agree, trees) <= miss)).select("query_id")
        done = stored(done, "settled")
        found.append(got.join(done, "query_id", "left_semi"))
        active = stored(active.join(done, "query_id", "left_anti"), "active")
        if active.isEmpty():
            break
        bits = bits // 2 if bits // 2 >= SHORTEST else 0
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("query_id", "rank", "vec_id", "score")


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch["vector"]) if batch.num_rows else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([batch["query_id"], pa.array(np.sqrt((x * x).sum(axis=1)))], ["query_id", "norm"])
