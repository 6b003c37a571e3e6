"""Listing comparison, field-level merge, renames and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave.functions import text as tx
from docweave.operators.ordering import lookup_join


def compare_listing(listing: DataFrame, stored: DataFrame, order: str = "ingested_at") -> DataFrame:
    """Class of every listed row: new, updated or unchanged, matched on the squeezed, lower-cased name.

    ``listing``: scheme_name, last_updated. ``stored``: scheme_name, ingested_at, last_synced. Of several stored
    rows of a name the first by ``order`` counts (nulls first, then the earlier baseline). A null name is new.
    """
    baseline = F.struct(F.greatest("ingested_at", "last_synced").alias("at"))
    known = stored.groupBy(F.lower(tx.squeeze(F.col("scheme_name"))).alias("_name")).agg(
        F.min_by(baseline, F.struct(order, baseline))["at"].alias("_baseline"), F.lit(True).alias("_known"))
    changed = F.col("last_updated").isNotNull() & (F.col("_baseline").isNull() | (F.col("last_updated") > F.col("_baseline")))
    status = F.when(F.col("_known").isNull(), "new").when(changed, "updated").otherwise("unchanged")
    return listing.withColumn("_name", F.lower(tx.squeeze(F.col("scheme_name")))).join(known, "_name", "left").withColumn("status", status).drop(
        "_name", "_baseline", "_known")


def merge_fields(stored: DataFrame, incoming: DataFrame, key: str, file: str, fields: list[str]) -> DataFrame:
    """Insert new names, overwrite only non-empty fields of known names, never delete.

    A new name whose file already belongs to another name is reported as an error and not inserted; of several new
    names with one file the first by name is inserted. Names without a file never clash.
    """
    old = stored.select(key, F.col(file).alias("_old_file"), *[F.col(f).alias(f"_old_{f}") for f in fields], F.lit(True).alias("_stored"))
    both = incoming.withColumn("_listed", F.lit(True)).join(old, key, "full_outer")
    fresh = F.col("_stored").isNull()
    # only new names with a file ask who owns it; all others get a key of their own, so that nulls do not meet in one task
    asks = F.when(fresh & F.col(file).isNotNull(), F.struct(F.col(file).alias("f"), F.lit(0).cast("long").alias("n"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("f"), F.xxhash64(key).alias("n")))
    both = both.withColumn("_asks", asks)
    taken = stored.select(F.struct(F.col(file).alias("f"), F.lit(0).cast("long").alias("n")).alias("_asks"), F.lit(True).alias("_taken")).where(
        "_asks.f is not null").distinct()
    first = both.where("_asks.f is not null").groupBy("_asks").agg(F.min(key).alias("_first"))
    owners = first.join(taken, "_asks", "left")
    marked = both.join(owners, "_asks", "left")

    def merged(field: str) -> Column:
        value = F.col(field)
        given = F.nullif(value, F.lit("")) if dict(incoming.dtypes)[field] == "string" else value
        if dict(incoming.dtypes)[field].startswith("array"):
            given = F.when(F.size(value) > 0, value)
        return F.when(fresh, value).otherwise(F.coalesce(given, F.col(f"_old_{field}"))).alias(field)

    action = (
        F.when(fresh & (F.coalesce("_taken", F.lit(False)) | (F.col(key) != F.col("_first"))), "error")
        .when(fresh, "inserted").when(F.col("_listed"), "updated").otherwise("kept")
    )
    return marked.select(key, F.coalesce("_old_file", file).alias(file), *[merged(f) for f in fields], action.alias("action"))


def data_as_of(sources: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Attach last_synced and its display text to cited sources that have one."""
    dated = stored.filter(F.col("last_synced").isNotNull()).select(key, "last_synced")
    text = F.concat(F.lit("Data as of "), F.date_format("last_synced", "dd MMM yyyy"))
    return sources.join(dated, key, "left").withColumn("data_as_of", text)


def rename_plan(rows: DataFrame) -> DataFrame:
    """Fate of rows named after their file: rename, duplicate (name used elsewhere) or unrecoverable.

    ``rows``: source_file, scheme_name, recovered. Uses counts per name, never lists of files.
    """
    stem = F.regexp_replace("source_file", r"\.json$", "")
    named = rows.withColumn("_old", F.lower(F.coalesce("scheme_name", F.lit("")))).withColumn("_new", F.lower("recovered"))
    candidates = named.filter(F.col("_old") == F.lower(stem))
    used = named.groupBy(F.col("_old").alias("_new")).agg(F.count(F.lit(1)).alias("_used"))
    planned = candidates.filter(F.col("_new").isNotNull()).groupBy("_new").agg(F.count(F.lit(1)).alias("_planned"))
    lookup = planned.join(used, "_new", "left")
    known = lookup_join(candidates.filter(F.col("_new").isNotNull()), lookup, ["_new"])
    others = F.coalesce("_used", F.lit(0)) - F.when(F.col("_old") == F.col("_new"), 1).otherwise(0) + F.col("_planned") - 1
    done = known.withColumn("outcome", F.when(others > 0, "duplicate").otherwise("rename"))
    lost = candidates.filter(F.col("_new").isNull()).withColumn("outcome", F.lit("unrecoverable"))
    keep = ["source_file", "scheme_name", "recovered", "outcome"]
    return done.select(*keep).unionByName(lost.select(*keep))


def sync_report(compared: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Counters of one run and its status: success, partial (some failures) or failed (nothing listed)."""
    counts = compared.agg(
        F.count(F.lit(1)).alias("schemes_checked"), F.count_if(F.col("status") == "new").alias("new_schemes_added"),
        F.count_if(F.col("status") == "updated").alias("schemes_updated"), F.count_if(F.col("status") == "unchanged").alias("schemes_unchanged"))
    errors = F.lit(0).cast("long") if failed is None else failed.agg(F.count(F.lit(1)).alias("n")).scalar()
    state = F.when(F.col("schemes_checked") == 0, "failed").when(F.col("schemes_failed") > 0, "partial").otherwise("success")
    return counts.withColumn("schemes_failed", errors).withColumn("status", state)


def sync_status(reports: DataFrame) -> DataFrame:
    """Last successful run, what it changed, and whether the latest run failed; of equal times the greater value counts."""
    good = F.col("status") != "failed"
    changed = F.col("new_schemes_added") + F.col("schemes_updated")
    return reports.agg(
        F.max(F.when(good, F.col("sync_timestamp"))).alias("last_sync"),
        F.coalesce(F.max_by(F.when(good, changed), F.when(good, F.struct("sync_timestamp", changed.alias("n")))), F.lit(0)).alias("schemes_updated_last_sync"),
        F.coalesce(F.max_by(F.col("status"), F.struct("sync_timestamp", "status")) == "failed", F.lit(False)).alias("last_sync_failed"))


def state_scope(bridge: DataFrame, schemes: DataFrame, state: str) -> DataFrame:
    """Ids of the schemes of one state and of those naming no state."""
    own = bridge.filter(F.lower("state") == state.strip().lower()).select("scheme_id").distinct().withColumn("kind", F.lit("state"))
    central = schemes.select("scheme_id").join(bridge.select("scheme_id"), "scheme_id", "left_anti").withColumn("kind", F.lit("central"))
    return own.unionByName(central)


def counts_by_state(bridge: DataFrame, schemes: DataFrame) -> DataFrame:
    """Schemes per state; none and several are their own groups."""
    states = bridge.groupBy("scheme_id").agg(F.count_distinct("state").alias("n"), F.min("state").alias("state"))
    label = F.when(F.col("n").isNull(), "<none: central/unspecified>").when(F.col("n") > 1, "<several>").otherwise(F.col("state"))
    return schemes.select("scheme_id").join(states, "scheme_id", "left").groupBy(label.alias("state")).agg(F.count(F.lit(1)).alias("schemes"))


def pending(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: sources without an accepted output."""
    return sources.join(done.select(key), key, "left_anti")


def fetch_in_order(requests: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows for id lists, in list order; ids that do not exist are left out."""
    asked = requests.select("request_id", F.posexplode("ids").alias("pos", key))
    return asked.join(rows, key).withColumn("score", F.lit(1.0))


def first_source_with_rows(lists: list[DataFrame]) -> DataFrame:
    """The first list that has any row. The check is one aggregate per plan, not a window over all rows."""
    both = None
    for place, rows in enumerate(lists):
        rows = rows.withColumn("source_place", F.lit(place).cast("long"))
        both = rows if both is None else both.unionByName(rows)
    first = both.agg(F.min("source_place")).scalar()
    return both.filter(F.col("source_place") == first)


def source_reasons(sources: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """source, place, rows and reason of every source that was tried before and with the first that has rows.

    ``sources`` maps a name to its rows, the reason to give when it has none, and the error it failed with, if any (its
    rows do not count then). The used source has no reason; the ones behind it are not listed.
    """
    counts = None
    for place, (name, (rows, empty, error)) in enumerate(sources.items()):
        n = F.lit(0).cast("long") if error else F.count(F.lit(1))
        one = rows.agg(n.alias("rows")).select(F.lit(name).alias("source"), F.lit(place).cast("long").alias("place"), "rows", F.lit(f"{name} failed: {error}" if error else empty).alias("_why"))
        counts = one if counts is None else counts.unionByName(one)
    used = F.min(F.when(F.col("rows") > 0, F.col("place"))).over(W.partitionBy())
    tried = counts.withColumn("_used", used).filter(F.col("_used").isNull() | (F.col("place") <= F.col("_used")))
    return tried.select("source", "place", "rows", F.when(F.col("rows") == 0, F.col("_why")).alias("reason"))


def prefer_named(first: DataFrame, second: DataFrame, key: str, name: str) -> DataFrame:
    """Per key the first record when it has a name, else the second; keys of either side."""
    fields = [c for c in first.columns if c != key]
    a = first.select(key, F.struct(*fields).alias("_a"))
    b = second.select(key, F.struct(*fields).alias("_b"))
    usable = F.coalesce(F.col(f"_a.{name}"), F.lit("")) != ""
    return a.join(b, key, "full_outer").select(key, F.when(usable, F.col("_a")).otherwise(F.col("_b")).alias("_r")).select(key, "_r.*")
