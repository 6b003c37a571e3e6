"""Evaluation and monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docweave import fixed


def percent(part, whole, digits: int = 1):
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def is_declined(answer):
    lowered, hit = F.lower(answer), F.lit(False)
    for mark in fixed.DECLINE_MARKS:
        hit = hit | F.contains(lowered, F.lit(mark))
    return hit


def answer_metrics(results: DataFrame) -> DataFrame:
    """Decline rate of out-of-scope queries, citation rate of answers without error, mean latency."""
    outside = F.col("category") == "out_of_scope"
    fine = F.col("intent") != "error"
    counted = results.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(outside).alias("out_of_scope_total"),
        F.count_if(outside & is_declined(F.col("answer"))).alias("out_of_scope_declined"),
        F.count_if(fine).alias("_fine"), F.count_if(fine & (F.col("n_sources") > 0)).alias("_cited"),
        F.round(F.coalesce(F.avg("response_time_s"), F.lit(0.0)), 3).alias("avg_response_time_s"),
    )
    return counted.select(
        "total_queries", "out_of_scope_total", "out_of_scope_declined",
        percent(F.col("out_of_scope_declined"), F.col("out_of_scope_total")).alias("decline_rate_pct"),
        percent(F.col("_cited"), F.col("_fine")).alias("source_citation_rate_pct"), "avg_response_time_s",
    )


def hit_rate(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Queries whose expected name (before " / ") is part of a retrieved name, or the reverse."""
    want, got = F.lower("expected"), F.lower("name")
    short = F.get(F.split(want, " / ", -1), F.lit(0))
    match = (F.col("expected") != "") & (F.contains(got, short) | F.contains(want, got))
    per_query = expected.join(retrieved, "query_id", "left").groupBy("query_id").agg(
        F.coalesce(F.bool_or(match), F.lit(False)).alias("hit"))
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("hit").alias("hits"),
        F.round(F.avg(F.col("hit").cast("double") * 100), 1).alias("hit_pct"))


def verdict_accuracy(cases: DataFrame) -> DataFrame:
    """Share of cases whose verdict equals the expected one, and share with something unverifiable."""
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("expected") == F.col("actual")).alias("matches"),
        percent(F.count_if(F.col("expected") == F.col("actual")), F.count(F.lit(1))).alias("accuracy_pct"),
        percent(F.count_if(F.col("n_unverifiable") > 0), F.count(F.lit(1))).alias("unverifiable_pct"))
