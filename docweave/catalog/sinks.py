"""Sinks: each query writes the given tables to the shared job folder and returns what a reader finds there."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.catalog.registry import ORACLES, QUERIES, query
from docweave.functions import text as tx
from docweave.sources import files
from docweave.streaming.files import work_folder


@query("snk1_validated_sink", """
    select doc_id, lang, length(trim(text)) >= 200 as valid from documents""")
def validated_sink(t):
    folder = work_folder(t.spark, "snk1")
    rows = t.documents.select("doc_id", "lang", F.length(F.trim("text")).alias("size"))
    files.write_valid(rows, F.col("size") >= 200, f"{folder}/valid", f"{folder}/rejected")
    read = [t.spark.read.schema("doc_id bigint, lang string").json(f"{folder}/{name}").withColumn("valid", F.lit(name == "valid"))
            for name in ("valid", "rejected")]
    return read[0].unionByName(read[1])


@query("snk2_profile_sink", ORACLES["prf1_profile"])
def profile_sink(t):
    folder = work_folder(t.spark, "snk2")
    profiled = QUERIES["prf1_profile"](t.spark, t.sf_dir)
    files.write_profile(profiled, profiled.agg(F.count(F.lit(1)).alias("documents")), folder)
    return t.spark.read.schema(profiled.schema).option("header", True).csv(f"{folder}/profile")


@query("snk7_error_log", """
    select 'd' || doc_id as source, 'only ' || length(trim(text)) || ' characters' as error, left(text, 80) as trace
    from documents where length(trim(text)) < 200""")
def error_log(t):
    folder = work_folder(t.spark, "snk7")
    size = F.length(F.trim("text"))
    error = F.when(size < 200, F.concat(F.lit("only "), size, F.lit(" characters")))
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("source"), error.alias("error"), F.left("text", F.lit(80)).alias("trace"))
    files.write_failures(rows, f"{folder}/errors")
    return t.spark.read.schema("source string, error string, trace string").json(f"{folder}/errors")


@query("snk8_usage_log", """
    select 'd' || doc_id as name, cast(ceil(n_chars / 3000.0) as bigint) as pages, cast(sum(ceil(n_chars / 3000.0)) over (order by doc_id) as bigint) as running_total from documents""")
def usage_log(t):
    folder = work_folder(t.spark, "snk8")
    rows = t.documents.select("doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("name"), F.ceil(F.col("n_chars") / 3000).alias("pages"))
    files.append_usage(rows, "doc_id", f"{folder}/usage")
    return files.read_usage(t.spark, f"{folder}/usage").select("name", "pages", "running_total")


@query("txt2_residual_marks", r"""
    select doc_id, '”' || regexp_extract(text, '[A-Za-z]+') || '” ' || left(regexp_extract(text, '[A-Za-z]+'), 3) as fixed from documents""")
def residual_marks(t):
    """A first word between marks that cannot be decoded, one with and one without the zero-width space."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    broken = F.concat(F.lit("â€​"), word, F.lit("â€ "), F.left(word, F.lit(3)))
    return t.documents.select("doc_id", tx.repair_mojibake(broken).alias("fixed"))
