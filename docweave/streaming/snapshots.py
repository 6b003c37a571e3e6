"""Appended batches with a compacted base: what a streaming job stores, in a folder that many can read meanwhile.

A version of the table is a base folder and the batches after it. A manifest row names the base and the last batch in
it; it is one file, which appears at once or not at all, so a version is complete when it can be seen. Every so many
batches base and tail are merged into a new base, and the next batches go to a new tail folder: a reader lists one
base and fewer than ``every`` batches, however old the job is. Folders of older versions are left for their readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

EVERY = 20
MANIFEST = "version long, base string, upto long"


class Snapshots:
    """A table of rows with their batch; ``merge`` reduces such rows to those that still count, and keeps their batch.

    ``merge`` must give the same rows for base and tail merged at once or one after the other. Batches come with growing
    ids; one that is repeated, whether or not a merge already holds it, changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, merge: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.spark, self.folder, self.merge, self.every = spark, folder.rstrip("/"), merge, every
        self.schema = StructType([f for f in schema.fields if f.name != "batch"]).add("batch", LongType())

    def manifest(self) -> tuple[int, str, int]:
        """Version, base folder (none: empty) and the last batch in it."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
            last = rows.orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            last = []
        return tuple(last[0]) if last else (0, "", -1)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Store a batch, and merge when ``every`` batches have gathered."""
        _, _, upto = self.manifest()
        if batch_id <= upto:
            return
        rows.select(*[c for c in self.schema.names if c != "batch"]).write.mode("overwrite").parquet(f"{self._tail(upto)}/batch={batch_id}")
        if batch_id - upto >= self.every:
            self.compact(batch_id)

    def compact(self, batch_id: int) -> None:
        """Merge everything up to a batch into a new base, then switch to it."""
        version, _, upto = self.manifest()
        if batch_id <= upto:
            return
        base = f"base-{batch_id}-{uuid.uuid4().hex}"
        self._stored().filter(F.col("batch") <= batch_id).transform(self.merge).select(*self.schema.names).write.parquet(f"{self.folder}/{base}")
        self._empty().drop("batch").write.mode("overwrite").parquet(f"{self._tail(batch_id)}/batch=-1")
        self._switch(version + 1, base, batch_id)

    def read(self) -> DataFrame:
        """The rows that count now, with their batch."""
        return self.merge(self._stored())

    def _tail(self, upto: int) -> str:
        return f"{self.folder}/tail-{upto + 1}"

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _switch(self, version: int, base: str, upto: int) -> None:
        self.spark.createDataFrame([(version, base, upto)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _stored(self) -> DataFrame:
        _, base, upto = self.manifest()
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/{base}")] if base else []
        try:
            parts.append(self.spark.read.schema(self.schema).parquet(self._tail(upto)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        whole = self._empty()
        for part in parts:
            whole = whole.unionByName(part)
        return whole


def latest(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge: of each key the rows of its latest batch."""

    def merge(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("batch").alias("_b"))
        same = F.col("batch") == F.col("_b")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return rows.join(last, same, "left_semi")

    return merge
