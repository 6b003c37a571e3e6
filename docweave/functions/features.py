"""Default text vectors without a model: hashed word counts, built and normalised in the JVM."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from docweave import fixed

WIDTH = 128
WORD = r"([\p{L}\p{N}_]+)"
PASSAGE, QUERY = "passage: ", "query: "


def word_buckets(text: Column, width: int = WIDTH) -> Column:
    """The bucket of every word, from the first 32 bits of its MD5."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))
    return F.transform(words, lambda w: (F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("bigint") % width).cast("string"))


def hashed_features(df: DataFrame, text: str, out: str = "vector", width: int = WIDTH, prefix: str = PASSAGE) -> DataFrame:
    """``df`` with the unit vector (array<double>) of its prefixed text; null texts are empty. No Python, no shuffle.

    Words are counted in buckets of a fixed hash by Spark ML's count vectoriser, whose vocabulary is the bucket numbers.
    A text without words, which only an empty prefix allows, has the zero vector.
    """
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(width)], inputCol="_buckets", outputCol="_counts")
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0)
    hashed = df.withColumn("_buckets", word_buckets(F.concat(F.lit(prefix), F.coalesce(text, F.lit(""))), width))
    return unit.transform(counter.transform(hashed)).withColumn(out, vector_to_array("_unit")).drop("_buckets", "_counts", "_unit")


def seed_centroids(spark, seeds: dict[str, list[str]] = fixed.SEED_PHRASES, width: int = WIDTH, prefix: str = QUERY) -> DataFrame:
    """category and centroid: the mean of the vectors of its seed phrases."""
    phrases = spark.createDataFrame([(c, p) for c, listed in seeds.items() for p in listed], "category string, phrase string")
    parts = hashed_features(phrases, "phrase", width=width, prefix=prefix).select("category", F.posexplode("vector").alias("at", "x"))
    means = parts.groupBy("category", "at").agg(F.avg("x").alias("x")).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("m"))
    return means.select("category", F.transform("m", lambda s: s["x"]).alias("centroid"))
