"""Files in, files out: document folders, nested JSON, vocabularies, logs, validated and rejected rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docweave import schemas


def scan_documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Every file of a folder with its name, size and whole text."""
    meta = F.col("_metadata")
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path)
    return raw.select(meta["file_name"].alias("file_name"), meta["file_size"].alias("file_size"), F.col("value").alias("text"))


def scan_binaries(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files as bytes, for a parser hook (:func:`docweave.functions.arrow.parse_files`)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content", "length")


def scan_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents, one per file, with the file name; absent leaves become "" or []."""
    name = F.col("_metadata.file_name").alias("source_file")
    schema = T.StructType([*schemas.SCHEME.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    filled = [schemas.filled(raw, f).alias(f.name) for f in schemas.SCHEME.fields]
    return raw.select(name, *filled, "_corrupt_record")


def scan_vocabulary(spark: SparkSession, path: str, fallback: list[str], headings: list[str]) -> DataFrame:
    """Terms of a file, else the fallback list, without terms that equal a heading."""
    listed = spark.read.text(path).select(F.trim("value").alias("term")).filter("term <> ''")
    built_in = spark.createDataFrame([(t,) for t in fallback], "term string")
    chosen = listed.unionAll(built_in.filter(listed.agg(F.count(F.lit(1))).scalar() == 0))
    return drop_headings(chosen, spark.createDataFrame([(h,) for h in headings], "term string"))


def drop_headings(terms: DataFrame, headings: DataFrame) -> DataFrame:
    keys = headings.select(F.lower("term").alias("_key")).distinct()
    return terms.withColumn("_key", F.lower("term")).join(keys, "_key", "left_anti").drop("_key")


def running_total(lines: DataFrame, line: str, order: str) -> DataFrame:
    """Last comma field of the last log line as a number, 0 when it is none."""
    last = F.max_by(F.element_at(F.split(line, ","), -1), order)
    return lines.agg(F.coalesce(last.try_cast("bigint"), F.lit(0)).alias("running_total"))


def write_valid(df: DataFrame, valid: Column, path: str, rejected: str, mode: str = "append") -> None:
    """Valid rows to ``path`` as JSON; the others, with the reason columns they carry, to ``rejected``."""
    marked = df.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    marked.filter("_valid").drop("_valid").write.mode(mode).json(path)
    marked.filter("not _valid").drop("_valid").withColumn("logged_at", F.current_timestamp()).write.mode(mode).json(rejected)


def write_failures(df: DataFrame, path: str) -> None:
    """Append the rows with an error (source, error, trace) and the time to a log of failures."""
    df.filter(F.col("error").isNotNull()).select("source", "error", "trace", F.current_timestamp().alias("logged_at")).write.mode("append").json(path)


USAGE = "position bigint, name string, pages bigint, running_total bigint, logged_at timestamp"


def append_usage(rows: DataFrame, order: str, path: str) -> None:
    """Append (name, pages) of a run to the usage log, in ``order``, with the total that goes on from the log's last."""
    from docweave.operators.ordering import global_scan

    spark = rows.sparkSession
    try:
        before = read_usage(spark, path).agg(F.coalesce(F.max("running_total"), F.lit(0)).alias("t"), F.coalesce(F.max("position"), F.lit(0)).alias("p")).first()
    except AnalysisException:  # no log yet
        before = {"t": 0, "p": 0}
    counted = global_scan(rows.select(order, "name", "pages"), [order], {"total": F.col("pages"), "place": F.lit(1)})
    counted.select((F.col("place") + before["p"]).alias("position"), "name", "pages", (F.col("total") + before["t"]).alias("running_total"),
                   F.current_timestamp().alias("logged_at")).write.mode("append").json(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE).json(path)


def write_profile(profiled: DataFrame, summary: DataFrame, path: str) -> None:
    """Profile rows as CSV and the summary as one JSON row."""
    profiled.write.mode("overwrite").option("header", True).csv(f"{path}/profile")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_report(report: DataFrame, path: str) -> None:
    report.withColumn("sync_timestamp", F.current_timestamp()).write.mode("append").json(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Report rows; unreadable lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
