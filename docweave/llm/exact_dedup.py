"""Exact deduplication with an extendible-hash index on shared files.

Every task first folds the equal texts of its own batch into one index entry, so a text that fills a third of
the table reaches its owner once per batch. The entries are written to a shared table. A directory maps hash
prefixes to buckets: it starts with one bucket and doubles wherever a bucket holds more bytes than a task should
own, until each fits or consists of one hash value. Owner tasks read whole buckets in hash order, chain the
entries of one hash value and compare their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.streaming.files import stored

BUCKET_BYTES = 64 << 20  # bytes of text one owner task takes
STEP = 8  # bits by which overfull buckets are split at once
DEEPEST = 56  # bits of the hash the directory may use

WHITE = b" \t\n\x0b\x0c\r"

_ENTRY = "hash bigint, sha string, body binary, size bigint, ids array<bigint>, best_points bigint, best_id bigint"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
        found: dict[bytes, list] = {}
        for text, doc_id in zip(texts, ids):
            body = (text or "").encode().translate(None, WHITE)
            found.setdefault(body, []).append((len(text or ""), doc_id))
        rows = []
        for body, members in found.items():
            digest = hashlib.sha256(body)
            points, best = max(members, key=lambda m: (m[0], m[1] is not None, -(m[1] or 0)))
            first = int.from_bytes(digest.digest()[:8], "big", signed=True)
            rows.append((first, digest.hexdigest(), body, len(body), [m[1] for m in members], points, best))
        columns = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         ["hash", "sha", "body", "size", "ids", "best_points", "best_id"])


def directory(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> list[tuple[int, int]]:
    """Buckets as (first hash, bits) in hash order, from exact sizes.

    Each round splits only the overfull buckets, by ``STEP`` more bits of the hash. The driver sees sizes per
    prefix, at most 2**STEP for each overfull bucket, so about 256 times the bytes / ``bucket_bytes`` numbers.
    """
    # the order of signed numbers is kept by adding 2**63, done below on the driver with Python integers
    sized = entries.select(F.col("hash"), (F.col("size") + F.lit(64)).alias("size"))
    done: list[tuple[int, int]] = []
    open_, bits = None, 0
    while bits < DEEPEST:
        bits += STEP
        prefix = F.shiftright(F.col("hash"), 64 - bits)
        rows = sized.withColumn("prefix", prefix)
        if open_ is not None:
            parents = entries.sparkSession.createDataFrame([(p,) for p in open_], "parent bigint")
            rows = rows.join(parents, F.shiftright(F.col("hash"), 64 - bits + STEP) == F.col("parent"), "left_semi")
        sizes = {r["prefix"]: (r["size"], r["one"]) for r in rows.groupBy("prefix").agg(
            F.sum("size").alias("size"), (F.min("hash") == F.max("hash")).alias("one")).collect()}
        over = [p for p, (size, one) in sizes.items() if size > bucket_bytes and not one]
        children = [(p << STEP) + i for p in open_ for i in range(1 << STEP)] if open_ is not None else range(-(1 << STEP - 1), 1 << STEP - 1)
        done += _merged([(p, bits, sizes.get(p, (0, True))[0]) for p in children if p not in set(over)], bucket_bytes)
        if not over:
            break
        open_ = over
    else:
        done += [(p << (64 - bits), bits) for p in over]
    return sorted(done)


def _merged(parts: list[tuple[int, int, int]], bucket_bytes: int) -> list[tuple[int, int]]:
    """Buddies that fit into one bucket together share it: what is left are the splits that were needed."""
    level = {p: size for p, _, size in parts}
    bits = parts[0][1] if parts else 0
    done = []
    for _ in range(STEP):
        upper: dict[int, int] = {}
        for p in sorted(level):
            buddy = p ^ 1
            if buddy in level and level[p] + level[buddy] <= bucket_bytes:
                upper[p >> 1] = level[p] + level[buddy]
            else:
                done.append((p << (64 - bits), bits))
        level, bits = upper, bits - 1
    return done + [(p << (64 - bits) if bits else -(1 << 63), bits) for p in level]


def _bucket_of(buckets: list[tuple[int, int]]):
    firsts = np.array([first for first, _ in buckets], dtype=np.int64)

    @F.pandas_udf("int")
    def lookup(hashes):
        import pandas as pd

        return pd.Series((np.searchsorted(firsts, hashes.to_numpy(np.int64), side="right") - 1).astype(np.int32))

    return lookup


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name the text of each entry: ``hash``, and its place in the chain of different texts with that hash."""
    current, chain = None, []
    for batch in batches:
        places = []
        for h, body in zip(batch["hash"].to_pylist(), batch["body"].to_pylist()):
            if h != current:
                current, chain = h, []
            if body not in chain:
                chain.append(body)
            places.append(chain.index(body))
        yield pa.RecordBatch.from_arrays([batch["entry"], batch["hash"], pa.array(places, pa.int32())], ["entry", "hash", "place"])


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The group of equal texts of every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after deleting white space (space, tab to carriage return); null
    counts as empty. The row with the most code points in its original text stays, of those the smallest doc_id;
    a null doc_id comes after all others. Rows with the doc_id of the kept row and its text are all marked as
    kept: they are the same row repeated. An empty table gives an empty result; other columns are ignored.
    """
    found = docs.select("doc_id", "text").mapInArrow(_entries, _ENTRY)
    entries = stored(found.withColumn("entry", F.monotonically_increasing_id()), "dedup-index")
    buckets = directory(entries, bucket_bytes)
    bucket = _bucket_of(buckets)(F.col("hash"))
    owned = (entries.select("entry", "hash", "body").withColumn("bucket", bucket)
             .repartition(max(len(buckets), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket")
             .sortWithinPartitions("bucket", "hash", "body").drop("bucket")
             .mapInArrow(_chains, "entry bigint, hash bigint, place int"))
    named = stored(owned, "dedup-chains")
    whole = entries.select("entry", "sha", "ids", "best_points", "best_id").join(named, "entry")
    groups = whole.groupBy("hash", "place").agg(
        F.sum(F.size("ids")).cast("bigint").alias("group_size"),
        F.max(F.struct("best_points", F.col("best_id").isNotNull().alias("known"), (-F.col("best_id")).alias("minus"))).alias("best"))
    joined = whole.join(groups, ["hash", "place"]).select(
        F.explode("ids").alias("doc_id"), (-F.col("best.minus")).alias("keep_id"), "group_size", F.col("sha").alias("text_sha256"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text stays, all columns, one row for each text; a repeated row stays once."""
    stay = exact_groups(docs, bucket_bytes).where("kept").select(F.col("doc_id").alias("_stay"), F.col("text_sha256").alias("_sha")).distinct()
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t-\\r]", "")
    rows = docs.withColumn("_text_sha", F.sha2(body, 256))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay")) & (F.col("_text_sha") == F.col("_sha")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_sha"]).drop("_text_sha")
