"""The prefix trie against one built turn by turn in memory."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from docweave.llm.conversation_trie import conversation_trie
from tests import oracle

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, depth string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        children[node[:-1]] += bool(node)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("height, target", [(2, 3), (16, 40)])
def test_trie(spark, height, target):
    r = random.Random(height)
    rows = []
    for c in [*range(0, 230), 300, 305, 399, 501, 70_000, 70_001, 140_000]:
        if c == 100:
            continue  # an absent base
        n = r.choice([0, 1, 1, 2, 3, 5, 8])
        rows += [(c, t, r.choice(["user", None]), r.choice(["a", "bb", None, "", "ü" * 70 + r.choice("xy")])) for t in range(n)]
    rows += [(r_[0], None, "first", "of all") for r_ in rows[::9]]
    rows += rows[::7]  # repeated rows
    rows += [(7, t, "user", "long " * (t % 3)) for t in range(20, 60)] + [(8, t, "user", "long " * (t % 3)) for t in range(20, 61)]
    rows += [(c, t, "user", f"copy {t}") for c in range(600, 640) for t in range(12)]
    rows += [(None, 1, "user", "nobody's"), (-5, 0, "user", "below zero"), (-5, 1, "user", "x" * 100_000)]
    assert got(conversation_trie(table(spark, rows), height, target)) == brute(rows)


def test_long_conversation_in_levels(spark):
    rows = [(c, t, "u", str(t if t < 150 else t * c)) for c in (11, 12, 13) for t in range(200 + c)]
    assert got(conversation_trie(table(spark, rows), 4, 50)) == brute(rows)


def test_empty(spark):
    assert conversation_trie(table(spark, [])).count() == 0
    assert conversation_trie(table(spark, [(None, 1, "u", "x")])).count() == 0


def test_sql(spark):
    from docweave.llm.catalog import ORACLES, QUERIES

    sf = "/root/testdata/sf0.1"
    assert oracle.compare(spark, sf, QUERIES["op12_conversation_trie"], ORACLES["op12_conversation_trie"], oracle.connect(sf)) == []
