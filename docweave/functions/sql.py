"""SQL access: text operators as temporary SQL functions, tables of sections and chunks as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docweave import fixed
from docweave.functions import sections as sec, text as tx
from docweave.operators.chunks import build_chunks


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in this session; they are inlined into the plan like built-in expressions."""
    squeeze = "trim(regexp_replace({0}, " + _quoted(r"(?U)\s+") + ", ' '))"
    masked = "x"
    for pattern, mark in fixed.ID_MASKS:
        masked = f"regexp_replace({masked}, {_quoted('(?U)' + pattern)}, {_quoted(mark)})"
    hyphens = fixed.HYPHENS + fixed.QUOTES
    plain = "-" * len(fixed.HYPHENS) + fixed.QUOTES_PLAIN
    unified = squeeze.format(f"lower(translate(x, {_quoted(hyphens)}, {_quoted(plain)}))")
    bodies = {
        "word_count(x STRING) RETURNS BIGINT": f"cast(regexp_count(x, {_quoted(r'(?U)' + chr(92) + 'S+')}) as bigint)",
        "content_key(x STRING) RETURNS STRING": f"sha2({squeeze.format('lower(x)')}, 256)",
        "match_form(x STRING) RETURNS STRING": f"regexp_replace({unified}, {_quoted(r'(?U)^[' + chr(92) + 'W_]+|[' + chr(92) + 'W_]+$')}, '')",
        "mask_ids(x STRING) RETURNS STRING": masked,
        "has_description(x STRING) RETURNS BOOLEAN": f"length(trim(coalesce(x, ''))) >= {fixed.MIN_DESCRIPTION_CHARS}",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dw_{head} RETURN {body}")
    return ["dw_" + head.split("(")[0] for head in bodies]


def register_views(documents: DataFrame, terms: list[str], schemes: DataFrame | None = None) -> None:
    """``sections`` (doc_id, pos, heading, content) of a document table, and ``chunks`` of schemes."""
    split = documents.select("doc_id", sec.split_sections(tx.mark_sections(F.col("text"), terms), terms).alias("d"))
    rows = split.select("doc_id", F.posexplode("d.sections").alias("pos", "s")).select("doc_id", "pos", "s.*")
    rows.createOrReplaceTempView("sections")
    if schemes is not None:
        build_chunks(schemes).createOrReplaceTempView("chunks")
