"""Section chunks of documents, and the tables kept in step with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave import fixed
from docweave.functions import text as tx
from docweave.operators.ordering import lookup_join


def build_chunks(schemes: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Up to four chunks per document: description, benefits, eligibility, application.

    ``schemes``: scheme_id, source_file, scheme_name, description, other_benefits, conditions, steps.
    A description without real content yields no chunk; the other sections always do. Only the
    eligibility chunk carries a state. One row becomes four rows in place: no shuffle.
    """
    states = fixed.STATES if states is None else states
    name = F.coalesce("scheme_name", F.lit(""))
    conditions = _joined("conditions")

    def chunk(section: str, content: Column, lead: str, state: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.concat(F.lit("passage: "), name, F.lit(lead), content).alias("text"), state.alias("state"))

    none = F.lit("")
    description = F.coalesce("description", F.lit(""))
    four = F.array_compact(F.array(
        F.when(tx.has_description(description), chunk("description", description, ". ", none)),
        chunk("benefits", _joined("other_benefits"), " benefits: ", none),
        chunk("eligibility", conditions, " eligibility: ", F.coalesce(tx.first_contained(conditions, states), none)),
        chunk("application", _joined("steps"), " application: ", none),
    ))
    return schemes.select("scheme_id", "source_file", F.col("scheme_name"), F.explode(four).alias("c")).select(
        F.concat_ws("_", "source_file", "c.section").alias("chunk_id"), "c.text", "scheme_id", "scheme_name", "source_file", "c.section", "c.state")


def _joined(column: str) -> Column:
    return F.array_join(F.coalesce(F.col(column), F.array().cast("array<string>")), " ")


def load_new(existing: DataFrame, incoming: DataFrame, key: str, order: str, valid: Column) -> DataFrame:
    """Outcome of every incoming row: inserted, skipped (key present or repeated) or failed (not valid, or no key).

    Idempotent: loading the inserted rows again skips all of them.
    """
    checked = incoming.withColumn("_valid", F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull())
    first = checked.groupBy(key).agg(F.min(F.when(F.col("_valid"), F.col(order))).alias("_first"))
    present = existing.select(key).distinct().withColumn("_present", F.lit(True))
    fate = first.join(present, key, "left")
    outcome = (
        F.when(~F.col("_valid"), "failed")
        .when(F.col("_present") | (F.col(order) != F.col("_first")), "skipped")
        .otherwise("inserted")
    )
    return lookup_join(checked, fate, [key]).withColumn("outcome", outcome).drop("_valid", "_first", "_present")


def append_new(existing_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose id is not stored yet."""
    return chunks.join(existing_ids.select("chunk_id"), "chunk_id", "left_anti")


def replace_by_key(stored: DataFrame, touched: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """The new snapshot: everything stored for a touched key is dropped, rebuilt rows take its place."""
    return stored.join(touched.select(key).distinct(), key, "left_anti").unionByName(rebuilt)


def maintenance_plan(descriptions: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """What a description clean-up would do: delete, embed or keep each description chunk."""
    planned = descriptions.withColumn("new", tx.clean_description(F.col("description"))).withColumn(
        "chunk_id", F.concat("source_file", F.lit("_description")))
    present = stored_ids.select("chunk_id").distinct().withColumn("_present", F.lit(True))
    changed = F.col("new") != F.coalesce("description", F.lit(""))
    content, stored = tx.has_description(F.col("new")), F.coalesce("_present", F.lit(False))
    outcome = (
        F.when(~content & stored, "delete")
        .when(content & (changed | ~stored), "embed")
        .otherwise("keep")
    )
    return planned.join(present, "chunk_id", "left").select("source_file", "chunk_id", changed.alias("changed"), outcome.alias("outcome"))


def upsert_latest(stored: DataFrame | None, batch: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Keyed upsert: created_at is set once, the value with the latest time wins, of equal times the greatest value."""
    fresh = batch.groupBy(*keys).agg(
        F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.max_by(value, F.struct(at, value)).alias(value))
    if stored is None:
        return fresh
    both = stored.unionByName(fresh)
    return both.groupBy(*keys).agg(
        F.min("created_at").alias("created_at"), F.max_by(value, F.struct("updated_at", value)).alias(value), F.max("updated_at").alias("updated_at"))
