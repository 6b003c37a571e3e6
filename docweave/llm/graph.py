"""Connected components by randomised contraction, and the grouping of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.streaming.files import stored


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of ``edges`` (columns a and b, bigint): nodes with one root are connected.

    In each round every node points to the neighbour (or itself) with the smallest hash and the edges are drawn
    anew between what the nodes point to, so the number of edges falls by a factor in each round whatever the
    graph looks like. Every round is written to the shared folder. An empty edge table gives an empty result.
    """
    loops = F.col("a") != F.col("b")
    edges = stored(edges.where(loops).select("a", "b").distinct(), "edges")
    roots, turn = None, 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
        points = both.groupBy("node").agg(F.min(place("other")).alias("best"))
        points = points.select("node", F.least("best", place("node"))["id"].alias("to"))
        points = stored(points, "points")
        if roots is None:
            roots = points.withColumnRenamed("to", "root")
        else:
            moved = points.withColumnRenamed("node", "root")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        ends = [points.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab"]
        edges = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = stored(edges.where(loops).distinct(), "edges")
        turn += 1
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(roots, "roots")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal (non-null, whole-number) keys of batches that are sorted by them, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in keys])
        bounds = np.r_[0, np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            key = tuple(values[:, lo].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def in_pairs_of_blocks(rows: DataFrame, key: str, id_: str, blocks: str) -> DataFrame:
    """Each row of a group in every pair of blocks it belongs to, so that any two rows of a group meet in a pair.

    ``blocks`` holds the number of blocks of the row's group; a row's block is a hash of its ``id_``. A group of one
    block is one pair (0, 0). Adds first and second; partitioned and sorted by key, first and second.
    """
    own = F.pmod(F.xxhash64(id_), F.col(blocks))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1), lambda j: (j != own) | (F.col(blocks) == 1))
    spread = rows.withColumn("_other", F.explode(others))
    spread = spread.withColumns({"first": F.least(own, "_other"), "second": F.greatest(own, "_other")}).drop("_other", blocks)
    return spread.repartition(key, "first", "second").sortWithinPartitions(key, "first", "second")
