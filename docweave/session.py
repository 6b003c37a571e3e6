"""Spark session settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "docweave", cores: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters pass their own session to the operators."""
    cores = cores or os.cpu_count() or 8
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    builder = builder.config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "12g")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str):
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
