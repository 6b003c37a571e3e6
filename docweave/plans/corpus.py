"""The corpus build as one lazy plan: raw text to nested documents, valid and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave import fixed
from docweave.functions import sections as sec, text as tx


def recovered_text(raw: Column, terms: list[str], noise: list[str], buttons: list[str] | None = None) -> Column:
    """Footer and buttons go first, then boundaries are put back, then page noise goes."""
    quiet = tx.remove_phrases(tx.strip_footer(raw), fixed.BUTTON_PHRASES if buttons is None else buttons)
    return tx.remove_phrases(tx.mark_words(tx.mark_sections(quiet, terms)), noise)


def build_documents(documents: DataFrame, headings: DataFrame, terms: list[str], noise: list[str]) -> DataFrame:
    """Nested documents of (doc_id, text), with the reason when one cannot be used.

    ``headings``: heading, category, score, the classified vocabulary. Headings are vocabulary matches,
    so only those equal to a term (case and space aside) are taken, one for each, and travel as a literal map. Of
    several rows of a heading the one with the best score counts.
    """
    known = [t.strip().lower() for t in terms]
    listed = headings.select(F.lower(F.trim("heading")).alias("h"), "category", "score").filter(F.col("h").isin(known))
    best = listed.groupBy("h").agg(F.max(F.struct("score", "category")).alias("b")).select("h", "b.category", "b.score")
    rows = sorted(best.collect())
    category = F.create_map(*[F.lit(x) for r in rows for x in (r["h"], r["category"])])
    score = F.create_map(*[F.lit(x) for r in rows for x in (r["h"], float(r["score"]))])
    split = documents.select("doc_id", sec.split_sections(recovered_text(F.col("text"), terms, noise), terms).alias("d")).select("doc_id", "d.*")
    classified = sec.mark_chains(sec.inherit_repeats(sec.classify(F.col("sections"), category, score)))
    built = split.withColumn("sections", classified).select(
        "doc_id", sec.assemble(F.col("sections"), F.col("preamble"), F.col("doc_id").cast("string")).alias("doc"))
    empty = (F.col("doc.overview.description") == "") & (F.size("doc.benefits.other_benefits") == 0) & (F.size("doc.eligibility.conditions") == 0)
    reason = F.when(F.col("doc.metadata.scheme_name") == "", "scheme_name missing").when(empty, "no description, benefits or eligibility extracted")
    return built.withColumn("reject_reason", reason)
