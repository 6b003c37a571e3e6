"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.streaming.files import stored

BITS = 52  # of the hash that seeds a document's draw
STEPS = 4_000_000  # probabilities of all sources together, 32 MB, up to which they are broadcast


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same on every run and engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << BITS))


def mixing_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: float = 1.0) -> DataFrame:
    """source and rate: how often each document of the source is repeated in the mean.

    ``weights`` are target shares of the characters by source; sources without one get nothing. Without weights
    a source's share is its size to the power ``temperature``. ``total`` is the output's size as a multiple of
    the input's. A source of no characters has rate 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    if weights is None:
        target = F.when(F.col("size") > 0, F.pow("size", F.lit(float(temperature)))).otherwise(0.0)
    else:
        target = F.lit(0.0)
        for source, weight in weights.items():
            target = F.when(F.col("source") == source, float(weight)).otherwise(target)
    sizes = sizes.withColumn("target", target)
    whole = sizes.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("target"))).alias("all_target"))
    rate = F.col("target") / F.col("all_target") * F.col("all_size") * F.lit(float(total)) / F.col("size")
    return sizes.join(F.broadcast(whole)).select("source", F.when((F.col("size") > 0) & (F.col("all_target") > 0), rate).otherwise(0.0).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as doubles tell it from 1; [] for rate 0."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    terms = F.transform(F.sequence(F.lit(1), last), lambda k: F.log(rate) - F.log(k.cast("double")))
    # logarithms of the probabilities first: exp(-rate) alone is 0 for rates above 745
    logs = F.aggregate(terms, F.array(-rate), lambda done, t: F.concat(done, F.array(F.element_at(done, -1) + t)))
    steps = F.aggregate(logs, F.array(F.lit(0.0)), lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.exp(p))))
    return F.when(rate > 0, F.slice(steps, 2, last + 1)).otherwise(F.array().cast("array<double>"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: float = 1.0,
                seed: int = 17) -> DataFrame:
    """Every document as often as its draw says, globally shuffled: columns of ``docs`` and copy, from 1.
    A column copy that ``docs`` has already is left out.

    A document's count inverts the Poisson distribution of its source's rate at a number hashed from seed and
    doc_id, so rows that repeat a doc_id get the same count. Rates come from ``mixing_rates`` over all rows. A
    null source is a source of its own (weights cannot name it); null and empty texts weigh nothing but are drawn
    like the others of their source. A hash of seed, doc_id and copy deals the rows out and orders them within their partitions, so the
    same settings give the same order. Empty tables stay empty.

    The sources' probabilities are written once. Up to ``STEPS`` of them, counted first, are broadcast; more are
    joined by a shuffle, which the adaptive skew join splits for a hot source.
    """
    steps = stored(mixing_rates(docs, weights, temperature, total).select(
        F.col("source").alias("_source"), poisson_steps(F.col("rate")).alias("_steps")), "mixing")
    if (steps.agg(F.sum(F.size("_steps") + F.lit(8)).alias("n")).first()["n"] or 0) <= STEPS:
        steps = F.broadcast(steps)
    docs = docs.drop("copy")
    drawn = docs.withColumn("_u", uniform(F.lit(seed), F.col("doc_id")))
    joined = drawn.join(steps, F.col("source").eqNullSafe(F.col("_source")))
    count = F.size(F.filter("_steps", lambda p: p <= F.col("_u")))
    copies = joined.withColumn("_n", count).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = uniform(F.lit(seed), F.col("doc_id"), F.col("copy"))
    return copies.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key", "doc_id", "copy").select(*docs.columns, "copy")
