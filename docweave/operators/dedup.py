"""Exact, content and name duplicates without ever gathering a group of copies in one place.

Null is a key like any other: rows with a null key are copies of one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions import text as tx
from docweave.operators.ordering import lookup_join
from docweave.streaming.files import stored


def duplicate_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """One row per key held by more than one row: the first id and the number of members.

    Count and minimum combine on the map side, so a key with a third of all rows costs one row per task.
    """
    return (
        df.select(key.alias("group_key"), F.col(id_col))
        .groupBy("group_key")
        .agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("members"))
        .filter("members > 1")
    )


def duplicate_pairs(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(copy, original) rows: every member of a group but its first.

    Keys and ids are written once, so the texts behind the keys are read and hashed once.
    """
    keyed = stored(df.select(key.alias("group_key"), F.col(id_col)), "keys")
    groups = duplicate_groups(keyed, F.col("group_key"), id_col)
    return lookup_join(keyed, groups, ["group_key"]).filter(F.col(id_col) != F.col("first_id")).select(
        F.col(id_col).alias("copy_id"), F.col("first_id").alias("original_id"), "group_key"
    )


def keep_first(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """The rows left after removing copies. Only ids and keys are shuffled to find them."""
    copies = duplicate_pairs(df, key, id_col).select(F.col("copy_id").alias(id_col))
    return df.join(copies, id_col, "left_anti")


def byte_key(col: Column) -> Column:
    return F.sha2(col, 256)


def content_key(col: Column) -> Column:
    return F.sha2(tx.content_form(col), 256)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First-wins per key as an aggregate (combines on the map side; no window over the key)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def prefer_sources(lists: list[DataFrame], key: str, rank: str) -> DataFrame:
    """Union of ranked lists; a key appearing twice keeps its place in the earlier list."""
    both = None
    for place, rows in enumerate(lists):
        rows = rows.withColumn("source_place", F.lit(place).cast("long"))
        both = rows if both is None else both.unionByName(rows)
    return first_per_key(both, [key], ["source_place", rank])
