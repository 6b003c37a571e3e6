"""Near-duplicates of word shingles by an inverted join over signature coordinates.

A text's MinHash signature has ``COORDINATES`` values. Texts are posted under each pair of coordinate and value.
Two texts of the wanted similarity collide in at least a threshold of the coordinates. So lists of one text are
skipped, texts with too few shared values drop out, and of the others only the rarest values are posted: if two
texts share the threshold, they meet in one of these prefixes. Within a list, collisions are counted over whole
signatures. The links found are confirmed on full shingle sets.

Texts of one shingle set are one class from the start, lists and groups of any size are cut into pairs of blocks,
and a task returns a spanning forest of its links, so the number of rows stays in proportion to the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.graph import components, in_pairs_of_blocks, sorted_groups
from docweave.llm.token_counts import chunked
from docweave.streaming.files import stored

WORDS = 5
COORDINATES = 64
SIMILAR = 80  # per cent
DEVIATIONS = 4.5  # how far below its mean a pair's number of collisions may be: missed are 1 in 100,000 links at the limit
LIST_BLOCK = 1024  # texts of a block of a posting list
GROUP_BLOCK = 256  # texts of a block of a group to be confirmed
GROUP_SHINGLES = 1 << 20  # shingles of such a block

_SEEDS = np.random.default_rng(9)
_WORD = _SEEDS.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_TIMES = _SEEDS.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_PLUS = _SEEDS.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, behind one another, and offsets.

    Words are runs of anything but space, tab to carriage return, with A-Z lower-cased. A text of fewer than
    ``WORDS`` words is one shingle; one without words has none.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    flat = lists.flatten()
    at = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    at = np.r_[0, np.cumsum(filled)][at]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary], dtype=np.uint64)
    words = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, dtype=np.uint64)
    whole = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        whole += words[k:k + len(whole)] * _WORD[k]
    whole = mixed(whole)
    sets = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= WORDS:
            sets.append(np.unique(whole[lo:hi - WORDS + 1]))
        elif hi > lo:
            sets.append(mixed((words[lo:hi] * _WORD[:hi - lo]).sum(keepdims=True) + _WORD[WORDS] * np.uint64(hi - lo)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``COORDINATES`` 32-bit minima for each non-empty set."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((values * _TIMES[k] + _PLUS[k]) >> np.uint64(32)).astype(np.uint32), starts) if len(starts) else 0
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        texts = batch["text"]
        for a, b in chunked([range(n or 0) for n in pc.binary_length(texts).to_pylist()]):
            values, at = shingle_sets(texts.slice(a, b - a))
            sizes = np.diff(at)
            rows = iter(signatures(values, at).view(np.int32).tolist())
            names = [hashlib.blake2b(values[lo:hi].tobytes(), digest_size=16).digest() if hi > lo else None for lo, hi in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(a, b - a), batch["sum"].slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array([next(rows) if n else None for n in sizes], pa.list_(pa.int32()))],
                ["doc_id", "sum", "n_shingles", "name", "signature"])


def threshold(similar: int) -> int:
    """Collisions that a pair of the similarity (per cent) reaches but for ``DEVIATIONS``."""
    t = similar / 100
    return max(1, math.floor(COORDINATES * t - DEVIATIONS * math.sqrt(COORDINATES * t * (1 - t))))


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of equal coordinates of all rows of ``a`` with all rows of ``b`` (one byte a coordinate)."""
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Each row of a symmetric matrix of links with the first row of its component, but for that row itself."""
    out, free = [], near.any(axis=1)
    for i in range(len(near)):
        if not free[i]:
            continue
        seen = np.zeros(len(near), dtype=bool)
        seen[i], front = True, np.array([i])
        while len(front):
            reached = near[front].any(axis=0) & ~seen
            seen |= reached
            front = np.flatnonzero(reached)
        free &= ~seen
        out += [(i, j) for j in np.flatnonzero(seen).tolist() if j != i]
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def candidate_links(classes: DataFrame, least: int) -> DataFrame:
    """Links a, b between nodes that join all nodes with ``least`` or more collisions: a forest for each list and task."""
    posts = classes.select("node", F.posexplode("signature").alias("spot", "value"))
    posts = posts.select("node", F.shiftleft(F.col("spot").cast("bigint"), 32).bitwiseOR(F.col("value").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("key"))
    lists = posts.groupBy("key").count().where("count > 1")
    shared = posts.join(lists, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("posts"))
    # a text's unshared values are rarer than all others, so of the shared ones the first size - least + 1 are its prefix
    prefix = shared.where(F.size("posts") >= least).select("node", F.slice("posts", 1, F.size("posts") - least + 1)["key"].alias("keys"))
    low = F.transform("signature", lambda v: F.substring(F.lpad(F.hex(v.cast("bigint").bitwiseAND(0xFFFFFFFF)), 8, "0"), 7, 2))
    posted = stored(prefix.join(classes.select("node", F.unhex(F.array_join(low, "")).alias("low")), "node"), "prefixes")
    flat = posted.select("node", "low", F.explode("keys").alias("key"))
    blocks = flat.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / LIST_BLOCK).alias("blocks"))
    dealt = in_pairs_of_blocks(flat.join(blocks, "key"), "key", "node", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for group in sorted_groups(batches, ["key", "first", "second"]):
            if group.num_rows < 2:
                continue
            nodes, low = group["node"].to_numpy(), _bytes(group["low"])
            order = np.argsort(nodes)
            nodes, near = nodes[order], collisions(low[order], low[order]) >= least
            np.fill_diagonal(near, False)
            found.update((int(nodes[i]), int(nodes[j])) for i, j in _forest(near))
            if len(found) > 100_000:
                yield _edges(list(found))
                found = set()
        yield _edges(list(found))

    return dealt.select("key", "first", "second", "node", "low").mapInArrow(run, "a bigint, b bigint")


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, similar: int, least: int) -> DataFrame:
    """Links a, b of the similarity that join all nodes it joins: a forest for each pair of blocks of a group."""
    members = groups.join(classes.select("node", "first", "name"), "node")
    sizes = groups.join(classes.select("node", "n_shingles"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = sizes.select("root", F.greatest(F.ceil(F.col("n") / GROUP_BLOCK), F.ceil(F.col("shingles") / GROUP_SHINGLES)).alias("blocks"))
    members = members.join(blocks, "root").select("root", "node", "first.doc_id", "first.sum", "name", "blocks").toDF(
        "root", "node", "_id", "_sum", "name", "blocks")
    # a text is found by its id and checksum: null and repeated ids alone would pair all their rows
    texts = docs.select("doc_id", "text").join(members, F.col("doc_id").eqNullSafe(F.col("_id")) & (checksum() == F.col("_sum")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            texts = batch["text"]
            for a, b in chunked([range(n or 0) for n in pc.binary_length(texts).to_pylist()]):
                values, at = shingle_sets(texts.slice(a, b - a))
                part = batch.slice(a, b - a)
                names = part["name"].to_pylist()
                raw = [values[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])]
                own = np.array([hashlib.blake2b(r, digest_size=16).digest() == name for r, name in zip(raw, names)], dtype=bool)
                low = signatures(values, at).astype(np.uint8)
                rows = np.cumsum(np.diff(at) > 0) - 1
                kept = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [part[c].take(pa.array(kept)) for c in ("root", "node", "blocks")]
                    + [pa.array([low[rows[i]].tobytes() for i in kept], pa.binary()), pa.array([raw[i] for i in kept], pa.binary())],
                    ["root", "node", "blocks", "low", "shingles"])

    sets = texts.select("root", "node", "blocks", "name", "text").mapInArrow(
        read, "root bigint, node bigint, blocks bigint, low binary, shingles binary")
    dealt = in_pairs_of_blocks(sets, "root", "node", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["root", "first", "second"]):
            yield _edges(_confirm(group, similar, least))

    return dealt.select("root", "first", "second", "node", "low", "shingles").mapInArrow(run, "a bigint, b bigint")


def _confirm(group: pa.Table, similar: int, least: int) -> list[tuple[int, int]]:
    nodes, first = np.unique(group["node"].to_numpy(), return_index=True)
    low = _bytes(group["low"])[first]
    sets = [np.frombuffer(group["shingles"][i].as_buffer(), dtype=np.uint64) for i in first.tolist()]
    sizes = np.array([len(s) for s in sets])
    hits = collisions(low, low)
    a, b = np.nonzero(np.triu(hits >= least, 1))
    likely = 100 * np.minimum(sizes[a], sizes[b]) >= similar * np.maximum(sizes[a], sizes[b])
    a, b = a[likely], b[likely]
    order = np.argsort(-hits[a, b].astype(np.int16), kind="stable")
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = root(i), root(j)
        if x == y:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
            parent[y] = x
            links.append((int(nodes[i]), int(nodes[j])))
    return links


def checksum() -> Column:
    """128 bits of a row's text, null as empty: with the doc_id they say which row is meant."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _judged(docs: DataFrame, similar: int) -> DataFrame:
    """Per row: doc_id, sum, n_shingles, component_id, kept, and whether the row has words."""
    signed = stored(docs.select("doc_id", "text", checksum().alias("sum")).mapInArrow(
        _signed, "doc_id bigint, sum binary, n_shingles bigint, name binary, signature array<int>"), "signatures")
    least = threshold(similar)
    named = signed.where("name is not null")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "sum")
    classes = named.groupBy("name").agg(F.min(row).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = components(candidate_links(classes, least))
    linked = components(confirmed_links(docs, classes, groups, similar, least))
    smallest = linked.join(classes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("smallest"))
    found = linked.join(smallest, "root").select("node", "smallest")
    firsts = classes.select("node", "name", "first").join(found, "node", "left").select("name", F.coalesce("smallest", "first").alias("keep"))
    with_words = named.select("doc_id", "sum", "n_shingles", "name").join(firsts, "name").select(
        "doc_id", "sum", "n_shingles", F.col("keep.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("sum") == F.col("keep.sum"))).alias("kept"), F.lit(True).alias("words"))
    without = signed.where("name is null").select(
        "doc_id", "sum", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(False).alias("words"))
    return with_words.union(without)


def near_groups(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (it is its own).

    Two texts are linked when 100 * shared shingles >= ``similar`` * all their shingles, counted on full sets;
    equal sets always are. Null and empty texts and texts without words have no shingles, are linked with
    nothing and are kept. Rows that repeat a doc_id are texts of their own. A null doc_id counts as greater than any
    other; a component of null ids alone has a null component_id. Of the texts of a component under its smallest
    doc_id the one of the smallest checksum is kept; rows with that doc_id and text are all marked: they are the same
    row repeated. Empty tables stay empty.
    """
    return _judged(docs, similar).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one for each component, and all without words; others go.

    A repeated row stays once. Only the rows of repeated ones are moved once more for that.
    """
    kept = _judged(docs, similar).where("kept").groupBy("doc_id", "sum").agg((F.max("words") & (F.count(F.lit(1)) > 1)).alias("_again"))
    stay = stored(kept.withColumnsRenamed({"doc_id": "_stay", "sum": "_sum"}), "stays")
    rows = docs.withColumn("_own", checksum())
    found = F.col("doc_id").eqNullSafe(F.col("_stay")) & (F.col("_own") == F.col("_sum"))
    once = rows.join(stay.where("not _again"), found, "left_semi").drop("_own")
    if stay.where("_again").isEmpty():
        return once
    again = rows.join(stay.where("_again"), found, "left_semi").dropDuplicates(["doc_id", "_own"])
    return once.union(again.drop("_own"))
