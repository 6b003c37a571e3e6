"""The prefix trie of conversations and what sharing its nodes saves, by depth bands.

A node is a distinct sequence of first turns. Its key is the sum of 128-bit hashes of (position, turn) over the
prefix, so keys come from running sums, which cut a very long conversation into pieces like any hot key. Totals of
subtrees are rolled up in bands of ``HEIGHT`` depths: nodes explode only to their ancestors inside their band; the
band tops form a trie of their own, a ``HEIGHT``-th as deep, whose totals come the same way; these completed totals
are then handed to the ancestors inside the band above. A trie of depth d takes log(d) / log(HEIGHT) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from docweave.operators.ordering import TARGET_ROWS, cut_pieces, lookup_join, scan_pieces
from docweave.streaming.files import stored

HEIGHT = 16
GROUP = 100    # conversations c - c % GROUP ... share the first turns of the first of them
HEADS = 6      # a conversation takes fewer than this many turns over
ENDS = 16      # bits: conversation ids of one block of 2**ENDS are joined in one row
LIMBS = 4      # 32-bit parts of a hash
ORDER = ["turn", "role", "front", "hash"]
SUMS = [f"s{i}" for i in range(LIMBS)]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, front, hash and points of every turn; only the front of a text is kept, to order equal turns."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(64)).alias("front"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("hash"), F.length(text).cast("bigint").alias("points"))


def limbs(position: Column, digest: Column) -> list[Column]:
    """The hash of a turn at its position, as numbers below 2**32: sums of 2**31 of them fit a bigint."""
    placed = F.md5(F.concat(position.cast("string"), F.lit(":"), digest))
    return [F.conv(F.substring(placed, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(LIMBS)]


def node_key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])))


def rebuilt_visits(conversations: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """conv_id, depth, key, points and ends: the nodes that each rebuilt conversation passes, from the root on.

    Conversation c takes over the first h = crc32(c) % 6 turns of conversation c - c % 100 in place of its own first h.
    """
    rows = stored(turn_rows(conversations), "turns")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    firsts = cut_pieces(rows.where(base == F.col("conv_id")), ["conv_id"], ORDER, target_rows)
    firsts = scan_pieces(firsts, ["conv_id"], ORDER, {"rn": F.lit(1)}).where(F.col("rn") < HEADS)
    heads = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rn", "hash", "points"))).alias("heads"))
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns(
        {"base": base, "h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")})
    convs = convs.join(heads, "base", "left").withColumn("is_base", F.col("base") == F.col("conv_id"))
    taken = F.when(F.col("is_base"), F.slice("heads", 1, 0)).otherwise(F.slice(F.coalesce("heads", F.slice("heads", 1, 0)), F.lit(1), F.col("h")))
    start = F.array(F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("points"), *[F.lit(0).cast("bigint").alias(s) for s in SUMS]))

    def further(done: Column, turn: Column) -> Column:
        last, depth = F.element_at(done, -1), F.size(done)
        sums = [(last[s] + x).alias(s) for s, x in zip(SUMS, limbs(depth, turn["hash"]))]
        return F.concat(done, F.array(F.struct(depth.alias("depth"), turn["points"].alias("points"), *sums)))

    taken = F.coalesce(taken, F.array().cast("array<struct<rn:bigint,hash:string,points:bigint>>"))
    convs = convs.withColumn("passed", F.aggregate(taken, start, further)).withColumn("skip", F.when(F.col("is_base"), 0).otherwise(F.col("h")).cast("bigint"))
    shared = F.size("passed") - 1
    convs = stored(convs.select("conv_id", "passed", "skip", shared.alias("shared"),
                                (shared + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("total")), "conversations")

    before = convs.select("conv_id", "skip", "shared", "total", *[F.element_at("passed", -1)[s].alias(f"before_{s}") for s in SUMS])
    own = cut_pieces(lookup_join(rows, before, ["conv_id"]), ["conv_id"], ORDER, target_rows)
    own = scan_pieces(own, ["conv_id"], ORDER, {"rn": F.lit(1)}).where("rn > skip")
    own = own.withColumn("depth", F.col("rn") - F.col("skip") + F.col("shared"))
    added = limbs(F.col("depth"), F.col("hash"))
    own = scan_pieces(own, ["conv_id"], ["rn"], dict(zip(SUMS, added)))
    sums = [F.col(f"before_{s}") + F.col(s) for s in SUMS]
    own = own.select("conv_id", F.col("depth").cast("bigint").alias("depth"), node_key(F.col("depth"), sums).alias("key"), "points",
                     (F.col("depth") == F.col("total")).alias("ends"))
    passed = convs.select("conv_id", "total", F.inline("passed"))
    passed = passed.select("conv_id", F.col("depth").cast("bigint").alias("depth"), node_key(F.col("depth"), [F.col(s) for s in SUMS]).alias("key"),
                           "points", (F.col("depth") == F.col("total")).alias("ends"))
    return own.unionByName(passed)


def band_nodes(visits: DataFrame, height: int) -> DataFrame:
    """key, depth, above (keys from the band's top to the parent), conv_id, n_convs, points and leaf of each node but the root.

    The depths of a band are one row of at most height + 1 keys per conversation; a top is also the bottom of the band above.
    """
    band = F.floor(F.col("depth") / height)
    bands = F.when((F.col("depth") % height == 0) & (F.col("depth") > 0), F.array(band - 1, band)).otherwise(F.array(band))
    paths = visits.withColumn("band", F.explode(bands)).groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list(F.struct("depth", "key", "points", "ends"))).alias("path"))
    passed = paths.where(F.size("path") > 1).select("conv_id", "path", F.explode(F.sequence(F.lit(2), F.size("path"))).alias("at"))
    here = F.element_at("path", F.col("at"))
    above = F.transform(F.slice("path", F.lit(1), F.col("at") - 1), lambda x: x["key"])
    passed = passed.select("conv_id", here["key"].alias("key"), here["depth"].alias("depth"), here["points"].alias("points"), here["ends"].alias("ends"), above.alias("above"))
    return passed.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("points").alias("points"),
        F.min("ends").alias("leaf"), F.first("above").alias("above"))


def subtree_sums(nodes: DataFrame, visits: DataFrame, values: list[str], height: int) -> DataFrame:
    """key and the sums of ``values`` over each node's subtree, itself included.

    ``nodes`` has key, depth, above and the values of every node (the root with an empty ``above``), ``visits`` conv_id,
    depth and key of every conversation.
    """
    each = nodes.select(F.posexplode("above").alias("at", "key"), *values)
    below = each.groupBy("key", (F.col("at") == 0).alias("top")).agg(*[F.sum(v).alias(v) for v in values])
    own = nodes.select("key", *values)
    total = lambda parts: parts.groupBy("key").agg(*[F.sum(v).alias(v) for v in values])
    if (nodes.agg(F.max("depth")).first()[0] or 0) <= height:
        return total(own.unionByName(below.drop("top")))
    below = stored(below, "below")
    tops = stored(visits.where(F.col("depth") % height == 0).withColumn("depth", (F.col("depth") / height).cast("bigint")), "tops")
    held = below.where("top").drop("top")
    roots = tops.where("depth = 0").groupBy("key").agg(F.min("depth").alias("depth")).withColumn("above", F.array().cast("array<binary>"))
    band_tops = band_nodes(tops, height).select("key", "depth", "above").unionByName(roots)
    band_tops = band_tops.join(held, "key", "left").na.fill(0, values)
    complete = stored(subtree_sums(stored(band_tops, "band_tops"), tops, values, height), "complete")
    bottoms = complete.join(nodes.where((F.col("depth") > 0) & (F.col("depth") % height == 0)).select("key", "above"), "key")
    handed = bottoms.select(F.explode(F.slice("above", F.lit(2), F.size("above"))).alias("key"), *values)
    return total(own.unionByName(below.where("not top").drop("top")).unionByName(complete).unionByName(handed))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the blocks of each key, which come one after another."""
    last, digest = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
            if key != last:
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _pairs(done)
        done = []
    if last is not None:
        yield _pairs([(last, digest.hexdigest())])


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])


def end_digests(visits: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes where conversations end: ids join in blocks of their order, which are hashed in turn."""
    blocks = visits.where("ends").groupBy("key", F.shiftright("conv_id", ENDS).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_digests, "key binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, height: int = HEIGHT, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by turn, null first, then by role, the first 64 characters of the text and the hash of both.
    Null roles and texts are empty strings; a repeated row is one more turn. Rows without a conv_id belong to no
    conversation and take no part. A conversation without turns after the rebuilding is a member of the root alone.
    Remainders of negative ids are those of SQL (-5 % 100 = -5). Nodes are told apart by 128-bit hashes. Other columns are ignored. An empty table gives no rows.
    """
    visits = stored(rebuilt_visits(conversations, target_rows), "visits")
    root = visits.where("depth = 0").groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("points").alias("points"), F.min("ends").alias("leaf"))
    nodes = band_nodes(visits, height).unionByName(root.withColumn("above", F.array().cast("array<binary>")))
    nodes = nodes.withColumns({"n_leaves": F.col("leaf").cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("points"),
                               "parent": F.try_element_at("above", F.lit(-1))})
    nodes = stored(nodes.drop("leaf", "points"), "nodes")
    sums = subtree_sums(nodes, visits.select("conv_id", "depth", "key", F.lit(0).cast("bigint").alias("points"), "ends"), ["n_leaves", "saved_tokens"], height)
    parts = [nodes.select("key", "conv_id", "depth", "n_convs", "parent"), sums, end_digests(visits),
             nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    whole = whole.groupBy("key").agg(*[F.max(c).alias(c) for c in whole.columns if c != "key"])
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
