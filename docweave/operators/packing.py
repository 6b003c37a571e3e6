"""Context packing and prompt budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave import fixed
from docweave.functions.text import let


def pack_sections(sections: list[Column], shares: list[int] | None = None, cap: int = fixed.SCHEME_CHAR_CAP) -> Column:
    """Section texts of one scheme cut to their share plus what the others leave over, in order.

    The sections are columns of one row; the allocation is closed arithmetic over them.
    """
    shares = [share for _, share in fixed.SECTION_SHARES] if shares is None else shares
    texts = [F.coalesce(s, F.lit("")) for s in sections]
    base = [F.least(F.length(t), F.lit(share)) for t, share in zip(texts, shares)]
    left = F.lit(cap) - sum(base[1:], base[0])
    taken, parts = F.lit(0), []
    for text, own in zip(texts, base):
        extra = F.least(F.length(text) - own, F.greatest(left - taken, F.lit(0)))
        allowed = own + extra
        cut = F.concat(F.regexp_replace(F.left(text, F.greatest(allowed - 1, F.lit(0))), r"(?U)\s+$", ""), F.lit("…"))
        parts.append(F.when(text == "", None).when(F.length(text) > allowed, cut).otherwise(text))
        taken = taken + extra
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def fit_budget(ranked: DataFrame, query: str, rank: str, length: Column, fixed_chars: Column,
               budget: int = fixed.MAX_PROMPT_TOKENS) -> DataFrame:
    """Keep the best-ranked schemes whose joined prompt stays in the token budget, always at least one.

    Partitions of this window are the top-k hits of one query, bounded by k.
    """
    so_far = W.partitionBy(query).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    joined = F.sum(length).over(so_far) + 2 * (F.row_number().over(W.partitionBy(query).orderBy(rank)) - 1)
    tokens = F.floor((fixed_chars + joined) / fixed.CHARS_PER_TOKEN)
    measured = ranked.withColumn("tokens", tokens).withColumn("_p", F.row_number().over(W.partitionBy(query).orderBy(rank)))
    return measured.filter((F.col("_p") == 1) | (F.col("tokens") <= budget)).drop("_p")


def count_ladder(available: Column) -> Column:
    """Scheme counts to try, largest first: all, then three, then two."""
    return let(available, lambda n: F.concat(F.array(n), F.filter(F.array(F.lit(3), F.lit(2)), lambda x: x < n)))
