"""Structured Streaming jobs: sessions, memory, arrivals, index upkeep, feedback, answers, slot dialogue.

Each job keeps only what is bounded per key: native aggregates where the state is a fold that can be
combined on the map side, batches over a compacted base (``docweave.streaming.snapshots``) where it is an upsert.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from docweave import fixed
from docweave.operators.chunks import build_chunks, upsert_latest
from docweave.streaming.files import run_append, run_batches, write_batch
from docweave.streaming.snapshots import EVERY, Snapshots, latest


def sessions(turns: DataFrame, key: str, at: str, folder: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed sessions per key. Rows later than the watermark are dropped; open sessions stay in state."""
    timed = turns.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    grouped = timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("turns"), F.min(at).alias("started"), F.max(at).alias("ended"))
    return run_append(grouped.select(key, "started", "ended", "turns"), folder)


def _kept(stream: DataFrame, folder: str, merge, schema=None, each=None, mode: str = "append", every: int = EVERY) -> DataFrame:
    """Run a stream into a table of appended batches with a compacted base, and read it."""
    table = Snapshots(stream.sparkSession, folder, schema or stream.schema, merge, every)
    run_batches(stream, folder, lambda batch, batch_id: table.append(each(batch) if each else batch, batch_id), mode)
    return table.read()


def session_memory(turns: DataFrame, key: str, order: str, remembered: Column, folder: str, every: int = EVERY) -> DataFrame:
    """Turns so far and the latest remembered value per key, as a native streaming aggregate."""
    seen = turns.withColumn("_r", remembered)
    state = seen.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"), F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col(order))).alias("remembered"))
    return _kept(state, folder, latest(key), mode="update", every=every).drop("batch")


def arrivals(documents: DataFrame, valid: Column, folder: str) -> tuple[DataFrame, DataFrame]:
    """New documents, each processed once: valid ones to one table, rejected ones to another."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.withColumn("valid", F.coalesce(valid, F.lit(False))), f"{folder}/documents", batch_id, "valid")

    run_batches(documents, folder, each)
    stored = documents.sparkSession.read.parquet(f"{folder}/documents")
    good = F.col("valid").cast("boolean")   # partition values come back as text
    return stored.filter(good).drop("valid", "batch"), stored.filter(~good).drop("valid", "batch")


def index_upkeep(schemes: DataFrame, folder: str, every: int = EVERY) -> DataFrame:
    """Chunks of changed documents, rebuilt per batch; readers see the last version of each document.

    A document keeps the chunks of its latest batch, also when it then has fewer chunks than before: a row without a
    chunk says that the batch held the document.
    """
    chunks = build_chunks(schemes)
    schema = StructType([StructField("source_file", StringType())] + [f for f in chunks.schema.fields if f.name != "source_file"])

    def each(batch: DataFrame) -> DataFrame:
        return build_chunks(batch).unionByName(batch.select("source_file").distinct(), allowMissingColumns=True)

    kept = _kept(schemes, folder, latest("source_file"), schema, each, every=every)
    return kept.filter("chunk_id is not null").select(*chunks.columns)


def feedback(ratings: DataFrame, keys: list[str], value: str, at: str, folder: str, every: int = EVERY) -> DataFrame:
    """Upserted ratings: every batch is pre-aggregated, and the merge is the same aggregate."""
    none = ratings.sparkSession.createDataFrame([], ratings.select(*keys, value, at).schema)
    shape = upsert_latest(None, none, keys, value, at)

    def merge(rows: DataFrame) -> DataFrame:
        return upsert_latest(rows.drop("batch"), none, keys, value, at).withColumn("batch", F.lit(0).cast("long"))

    kept = _kept(ratings, folder, merge, shape.schema, lambda batch: upsert_latest(None, batch, keys, value, at), every=every)
    return kept.drop("batch")


# --- slot dialogue --------------------------------------------------------------------------
SLOT_STATE = "first_value_turn long, value string, unread array<long>, skip boolean"
SLOT_ROWS = "session_id long, slot string, value string, failures long, skipped boolean"


def _fold_slot(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of one (session, slot); independent of row order and of constant size.

    A reply that cannot be read counts as a failure only while the slot has no value, and three of them
    skip the slot: the three earliest unread turns are all that has to be kept.
    """
    first, value, unread, skip = state.get if state.exists else (None, None, [], False)
    unread = list(unread)
    for batch in batches:
        skip = bool(skip or batch["is_skip"].any())
        said = batch[~batch["is_skip"]]
        read = said[said["value"].notna()]
        if len(read):
            best = read.loc[read["turn"].idxmin()]
            if first is None or best["turn"] < first:
                first, value = int(best["turn"]), str(best["value"])
        unread = sorted(unread + [int(x) for x in said.loc[said["value"].isna(), "turn"].nsmallest(fixed.MAX_SLOT_FAILURES)])
        unread = unread[: fixed.MAX_SLOT_FAILURES]
    state.update((first, value, unread, skip))
    failures = sum(1 for turn in unread if first is None or turn < first)
    yield pd.DataFrame({"session_id": [key[0]], "slot": [key[1]], "value": [value], "failures": [failures],
                        "skipped": [skip or failures >= fixed.MAX_SLOT_FAILURES]})


def slot_dialogue(replies: DataFrame, folder: str, every: int = EVERY) -> DataFrame:
    """Slots per session from replies (session_id, slot, turn, value, is_skip); value null = unreadable."""
    state = replies.groupBy("session_id", "slot").applyInPandasWithState(
        _fold_slot, SLOT_ROWS, SLOT_STATE, "update", GroupStateTimeout.NoTimeout)
    return _kept(state, folder, latest("session_id", "slot"), mode="update", every=every).drop("batch")
