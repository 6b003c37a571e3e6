"""Vector classification and filtered top-k retrieval as blocked matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave import fixed

MAX_QUERIES = 4096        # query vectors held by every task; more go through the grid
MAX_CATEGORIES = 1024
GRID_CHUNKS = 50_000      # chunk vectors of one grid cell
QUERY_BLOCK = 256         # query vectors of one matrix product: 10,000 chunks of a batch make 20 MB of scores


def mean_vectors(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Component-wise mean per key: one aggregate over ``width`` columns, nothing exploded."""
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(width)]
    return df.groupBy(key).agg(F.array(*means).alias(vector))


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that is small by contract; one row over the limit is an error, never a cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return rows


def classify_vectors(df: DataFrame, vector: str, centroids: DataFrame, key: str, centroid: str,
                     thresholds: dict[str, float] | None = None) -> DataFrame:
    """Nearest centroid by dot product; ties go to the smallest category, flag by its threshold.

    A null vector, or one of another width than the centroids', has no category and is not confident.
    """
    rows = sorted(bounded_rows(centroids.select(key, centroid), MAX_CATEGORIES, "categories"), key=lambda r: r[0])
    names, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype="float64")

    @F.pandas_udf("best long, score double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"best": pd.array([None] * len(vectors), dtype="Int64"), "score": np.nan})
        usable = [v is not None and len(v) == matrix.shape[1] for v in vectors]
        if any(usable):
            scores = np.stack(vectors[usable].to_numpy()).astype("float64") @ matrix.T
            best = scores.argmax(axis=1)
            out.loc[usable, "best"], out.loc[usable, "score"] = best, scores[np.arange(len(best)), best]
        return out

    limit = F.lit(fixed.CONFIDENCE_THRESHOLD)
    for name, value in (thresholds or {}).items():
        limit = F.when(F.col("category") == name, F.lit(value)).otherwise(limit)
    listed = F.array(*[F.lit(n) for n in names])
    return (
        df.withColumn("_near", nearest(vector))
        .withColumn("category", F.get(listed, F.col("_near.best").cast("int")))
        .withColumn("score", F.when(F.col("_near.best").isNotNull(), F.col("_near.score")))
        .withColumn("confident", F.coalesce(F.col("score") >= limit, F.lit(False)))
        .drop("_near")
    )


_ASK = ["query_id", "turn", "query_vector", "query_state"]
_HITS = "query_id long, turn int, chunk_id long, scheme_id long, score double"


def _masked(batch: pd.DataFrame, asks: pd.DataFrame) -> np.ndarray:
    """Scores (2 cos - 1 on unit vectors) of all chunks for all asks; what an ask may not see is -inf."""
    matrix = np.stack(asks["query_vector"].to_numpy()).astype("float64")
    scores = 2.0 * (np.stack(batch["embedding"].to_numpy()).astype("float64") @ matrix.T) - 1.0
    filtered = asks["query_state"].notna().to_numpy()
    if filtered.any():
        same = batch["state"].to_numpy(dtype=object)[:, None] == asks["query_state"].to_numpy(dtype=object)[None, :]
        scores[filtered[None, :] & ~same] = -np.inf
    if "allowed" in batch.columns:
        flat = np.concatenate(batch["allowed"].to_numpy())
        rows = np.repeat(np.arange(len(batch)), [len(a) for a in batch["allowed"]])
        inside = np.zeros(scores.shape, dtype=bool)
        ids = asks["query_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        lo, hi = np.searchsorted(ids[order], flat, "left"), np.searchsorted(ids[order], flat, "right")
        for shift in range(int((hi - lo).max(initial=0))):  # one ask a query, or two with a fallback
            at = lo + shift < hi
            inside[rows[at], order[(lo + shift)[at]]] = True
        scores[~inside] = -np.inf
    return scores


def _keep_best(asks: pd.DataFrame, keep: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The ``keep`` best chunks of each ask over all batches, ties by id; asks are taken in blocks."""

    def best(batch: pd.DataFrame) -> pd.DataFrame:
        parts = []
        ids, schemes = batch["chunk_id"].to_numpy(), batch["scheme_id"].to_numpy()
        for at in range(0, len(asks), QUERY_BLOCK):
            block = asks.iloc[at:at + QUERY_BLOCK]
            scores = _masked(batch, block)
            for column, (query_id, turn) in enumerate(zip(block["query_id"], block["turn"])):
                values = scores[:, column]
                usable = np.flatnonzero(np.isfinite(values))
                if len(usable) > keep:
                    floor = np.partition(values[usable], len(usable) - keep)[len(usable) - keep]
                    usable = usable[values[usable] >= floor]
                order = usable[np.lexsort((ids[usable], -values[usable]))][:keep]
                parts.append(pd.DataFrame({"query_id": query_id, "turn": turn, "chunk_id": ids[order], "scheme_id": schemes[order], "score": values[order]}))
        return pd.concat(parts, ignore_index=True).astype({"turn": "int32"})

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            found = best(batch)
            both = found if held is None else pd.concat([held, found], ignore_index=True)
            both = both.sort_values(["query_id", "turn", "score", "chunk_id"], ascending=[True, True, False, True])
            held = both.groupby(["query_id", "turn"], sort=False).head(keep)
        if held is not None:
            yield held

    return run


def _every(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def top_chunks(chunks: DataFrame, queries: DataFrame, keep: int, scope: DataFrame | None = None, fallback: bool = False,
               max_queries: int = MAX_QUERIES, cell: int = GRID_CHUNKS) -> DataFrame:
    """Ranked hits per query (score = 2 cos - 1 on unit vectors), at most ``keep`` each.

    ``chunks``: chunk_id, scheme_id, state, embedding; chunks without an embedding, or one of another width than the
    queries', take no part. ``queries``: query_id, query_vector, query_state (null = no filter). ``scope``: allowed
    (query_id, scheme_id) pairs, applied before scoring. With ``fallback`` a filtered query that hits nothing gets
    its unfiltered hits; both are found in one pass over the chunks.

    Up to ``max_queries`` query vectors are sent to every task. More are cut into blocks, and each pair of a query
    block and a chunk block is a bounded task. The ids allowed to see a scheme are gathered per query block.
    """
    asks = queries.select("query_id", F.lit(0).alias("turn"), "query_vector", "query_state")
    if fallback:
        asks = asks.unionByName(asks.filter("query_state is not null").withColumns({"turn": F.lit(1), "query_state": F.lit(None).cast("string")}))
    rows = asks.take(max_queries + 1)
    if not rows:
        return chunks.sparkSession.createDataFrame([], f"{_HITS}, rank long").drop("turn")
    width = len(rows[0]["query_vector"])
    needed = chunks.select("chunk_id", "scheme_id", "state", "embedding").filter(F.size("embedding") == width)
    blocks = 1 if len(rows) <= max_queries else -(-asks.count() // max_queries)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks).cast("long")).alias("_q")
    if scope is not None:
        allowed = scope.groupBy("scheme_id", block).agg(F.collect_set("query_id").alias("allowed"))
        needed = needed.join(allowed, "scheme_id")
    if blocks == 1:
        hits = needed.drop("_q").mapInPandas(_keep_best(pd.DataFrame([tuple(r) for r in rows], columns=_ASK), keep), _HITS)
    else:
        parts = max(1, -(-chunks.count() // cell))
        left = needed if scope is not None else needed.withColumn("_q", F.explode(_every(blocks)))
        left = left.withColumn("_c", F.pmod(F.xxhash64("chunk_id"), F.lit(parts).cast("long")))
        right = asks.select(*_ASK, block).withColumn("_c", F.explode(_every(parts)))

        def cell_hits(chunk_rows: pd.DataFrame, ask_rows: pd.DataFrame) -> pd.DataFrame:
            if not len(chunk_rows) or not len(ask_rows):
                return pd.DataFrame(columns=[c.split()[0] for c in _HITS.split(", ")])
            return next(_keep_best(ask_rows, keep)(iter([chunk_rows])))

        hits = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInPandas(cell_hits, _HITS)
    ranked = W.partitionBy("query_id", "turn").orderBy(F.desc("score"), "chunk_id")
    best = hits.withColumn("rank", F.row_number().over(ranked).cast("long")).filter(F.col("rank") <= keep)
    if fallback:
        best = best.withColumn("_first", F.min("turn").over(W.partitionBy("query_id"))).filter(F.col("turn") == F.col("_first")).drop("_first")
    return best.drop("turn")


def retrieve(chunks: DataFrame, queries: DataFrame, top_k: int = 5, scope: DataFrame | None = None, within: DataFrame | None = None,
             documents: DataFrame | None = None, fallback: bool = True, **limits) -> DataFrame:
    """Best schemes per query: over-fetch chunks (2k, 6k in a scope), keep the best chunk of each scheme.

    ``scope`` restricts each query to its own schemes, ``within`` (scheme_id) all queries to the same ones. A
    state-filtered query without any hit is searched again without its filter, never in a scope. ``documents``
    (scheme_id and what is to be shown) is joined before the cut to k, so schemes without one leave no gap.
    """
    scoped = scope is not None or within is not None
    if within is not None:
        chunks = chunks.join(within.select("scheme_id"), "scheme_id", "left_semi")
    hits = top_chunks(chunks, queries, top_k * (6 if scoped else 2), scope, fallback and not scoped, **limits)
    best = hits.groupBy("query_id", "scheme_id").agg(F.min(F.struct("rank", "chunk_id", "score")).alias("b")).select("query_id", "scheme_id", "b.*")
    if documents is not None:
        best = best.join(documents, "scheme_id")
    place = W.partitionBy("query_id").orderBy("rank")
    return best.withColumn("place", F.row_number().over(place).cast("long")).filter(F.col("place") <= top_k)


def effective_filter(given: Column, extracted: Column) -> Column:
    """A filter sent with the request wins over the extracted one when it is not empty."""
    return F.coalesce(F.nullif(given, F.lit("")), extracted)
