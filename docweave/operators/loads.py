"""Loading documents and their chunks in two phases, safe to repeat: staged and cleaned, then embedded and marked done.

Both tables are compacted snapshots, which a batch enters as a whole. A crash between the phases leaves documents
pending; the next run finds the chunks that are stored already and goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, StringType

from docweave import fixed
from docweave.functions import text as tx
from docweave.operators.chunks import load_new
from docweave.streaming.files import stored
from docweave.streaming.snapshots import EVERY, Snapshots, latest

PENDING, DONE = "pending", "done"
OUTCOMES = ["inserted", "skipped", "failed"]


def document_table(spark, folder: str, record: StructType, every: int = EVERY) -> Snapshots:
    """Documents by source_file with embedding_status; of each the latest version counts."""
    extra = [StructField(n, StringType()) for n in ("embedding_status", "suspect")]
    return Snapshots(spark, folder, StructType([*record.fields, *extra]), latest("source_file"), every)


def chunk_table(spark, folder: str, chunk: StructType, every: int = EVERY) -> Snapshots:
    """Chunks by chunk_id."""
    return Snapshots(spark, folder, chunk, latest("chunk_id"), every)


def next_batch(table: Snapshots) -> int:
    """The number after the last batch that was stored."""
    last = table.read().agg(F.max("batch")).first()[0]
    return max(-1 if last is None else last, table.manifest()[2]) + 1


def cleaned(record: DataFrame) -> DataFrame:
    """Names without sign-out texts and descriptions without pop-ups, inside the nested record; ``suspect`` names the
    interface text that a scheme name still carried when it came."""
    name, description = F.col("metadata.scheme_name"), F.col("overview.description")
    markers = F.filter(F.array(*[F.lit(m) for m in fixed.CORRUPT_NAME_MARKERS]), lambda m: F.contains(F.lower(name), m))
    return record.withColumn("suspect", F.get(markers, F.lit(0))).withColumns({
        "metadata": F.when(name != "", F.col("metadata").withField("scheme_name", tx.clean_name(name))).otherwise(F.col("metadata")),
        "overview": F.when(description != "", F.col("overview").withField("description", tx.clean_description(description))).otherwise(F.col("overview"))})


def load_documents(table: Snapshots, incoming: DataFrame, order: str, valid: Column) -> DataFrame:
    """Insert what is new, as pending; one row with inserted, skipped, failed and total.

    ``incoming`` has source_file, the record's columns and ``order``, by which the first valid row of a file is taken.
    Loading the same rows again skips all of them.
    """
    judged = load_new(table.read().select("source_file"), incoming, "source_file", order, valid)
    kept = F.col("outcome") == "inserted"  # of the other rows only the outcome counts
    judged = stored(judged.select(*[F.when(kept, F.col(c)).alias(c) for c in incoming.columns], "outcome"), "staged")
    fresh = cleaned(judged.filter("outcome = 'inserted'").drop("outcome"))
    if not fresh.isEmpty():
        table.append(fresh.withColumn("embedding_status", F.lit(PENDING)), next_batch(table))
    counts = judged.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count(F.lit(1)).alias("total"))
    return counts


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def embed_documents(documents: Snapshots, chunks: Snapshots, build: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Embed the chunks of pending documents that are not stored yet, then mark the documents done whose chunks all are;
    one row with embedded, skipped (chunks stored before) and done (documents).

    ``build`` makes chunks (chunk_id, source_file, ...) of documents, ``embed`` adds what the chunk table keeps. Chunks
    are stored before any document is marked, so a repeated or interrupted run ends with the same tables.
    """
    pending = documents.read().filter(F.col("embedding_status") == PENDING)
    built = stored(build(pending), "built")
    new = built.join(chunks.read().select("chunk_id"), "chunk_id", "left_anti")
    embedded = stored(_count(new, "embedded"), "embedded")  # counted first: a table that has grown is another one
    if not new.isEmpty():
        chunks.append(embed(new), next_batch(chunks))
    missing = built.join(chunks.read().select("chunk_id"), "chunk_id", "left_anti").select("source_file")
    done = pending.join(missing, "source_file", "left_anti").drop("batch").withColumn("embedding_status", F.lit(DONE))
    marked = stored(_count(done, "done"), "marked")
    if not done.isEmpty():
        documents.append(done, next_batch(documents))
    every, embedded, marked = (c.scalar() for c in (_count(built, "built"), embedded, marked))
    one = documents.spark.range(1)
    return one.select(embedded.alias("embedded"), (every - embedded).alias("skipped"), marked.alias("done"))
