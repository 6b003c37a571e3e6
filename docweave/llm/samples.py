"""Bounded samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LONGEST = 1 << 20  # characters of a text that may be in a sample


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> tuple[list[tuple[str, int, float]], float]:
    """(text, label, weight) of up to ``most`` labelled training rows of either class, and the share of label 1.

    Within a class the rows with the smallest hash of doc_id are taken; weights restore the classes' true sizes.
    Rows without a label, a doc_id or a text take no part. A doc_id labelled several times counts once, by its
    greatest label. The driver gets at most 2 * ``most`` texts of at most ``LONGEST`` characters.
    """
    known = labels.where(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rows = []
    for value in (0, 1):
        chosen = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        texts = docs.where(F.length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
        found = texts.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
        rows += [(r["text"], value, sizes[value] / max(1, len(found))) for r in found]
    total = sum(sizes.values())
    return rows, sizes.get(1, 0) / total if total else 0.5
