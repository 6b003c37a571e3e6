"""Near-duplicate groups against all pairs."""

import random
import re

import pytest

from docweave.llm import near_dedup
from docweave.llm.graph import components
from docweave.llm.near_dedup import drop_near, near_groups


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows, similar):
    """component of each row, for unique ids"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similar * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(n=240, seed=3):
    r = random.Random(seed)
    vocab = [a + b for a in "bcdfgmnprst" for b in ("a", "en", "or", "ist")]
    rows = []
    for base in range(12):
        words = [r.choice(vocab) for _ in range(r.choice([3, 8, 40, 90, 300]))]
        for _ in range(r.choice([1, 2, 40])):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append(" ".join(w.upper() if r.random() < 0.1 else w for w in copy))
    rows += ["", " \n", None, "solo", "Solo ", "a b c d", "a b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows[:n]))


@pytest.mark.parametrize("similar,list_block,group_block", [(80, 1024, 256), (85, 5, 4)])
def test_groups(spark, monkeypatch, similar, list_block, group_block):
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", list_block)
    monkeypatch.setattr(near_dedup, "GROUP_BLOCK", group_block)
    rows = corpus()
    want = brute(rows, similar)
    df = spark.createDataFrame([(i, t, t, i) for i, t in rows], "doc_id bigint, text string, name string, n_shingles bigint").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(df, similar).collect()}
    assert got == want
    assert {r.doc_id for r in drop_near(df, similar).collect()} == {i for i, x in want.items() if x[2]}


def test_odd_rows(spark):
    text = " ".join(map(str, range(30)))
    rows = [(None, text), (None, text), (4, text), (4, text), (5, text + " x"), (None, "alone"), (6, None)]
    got = sorted(map(tuple, near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(None, 26, 4, False)] * 2 + [(4, 26, 4, True)] * 2 + [(5, 27, 4, False), (None, 1, None, True), (6, 0, 6, True)], key=str)
    assert near_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def one_of_each(spark, rows, groups, alone=()):
    """``drop_near`` keeps one row of each group, the first it lists, and all rows alone; rows are (doc_id, text)."""
    for parts in (1, 3):
        df = spark.createDataFrame([(i, t, str(n)) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, place string").repartition(parts)
        got = sorted(((r.doc_id, r.text) for r in drop_near(df).collect()), key=str)
        assert len(got) == len(groups) + len(alone)
        for group in groups:
            smallest = min((i is None, i or 0) for i, _ in group)
            assert [g for g in got if g in group] and all((g[0] is None, g[0] or 0) == smallest for g in got if g in group)
            assert sum(g in group for g in got) == 1
        assert sorted((g for g in got if not any(g in x for x in groups)), key=str) == sorted(alone, key=str)


def test_one_row_of_a_component_stays(spark):
    """Repeated and null ids: near copies under one id, an id kept through another text, rows repeated, null ids alone."""
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(40)) for x in "abcd")
    same = [(7, a), (7, a + " x"), (9, a)]
    other = [(3, b), (7, b + " x"), (None, b + " y")]  # 7 stays through another text, but 3 is the smaller id here
    nulls = [(None, c), (None, c + " x"), (None, c.upper())]
    again = [(5, d), (5, d), (None, d + " x")]
    groups = [same, other, nulls, again]
    alone = [(None, "solo"), (None, None), (None, ""), (None, ""), (8, None), (8, None)]
    one_of_each(spark, [r for g in groups for r in g] + alone, groups, alone)
    one_of_each(spark, same + other, [same, other])
    df = spark.createDataFrame([r for g in groups for r in g], "doc_id bigint, text string")
    kept = sorted((r.doc_id for r in near_groups(df).where("kept").collect()), key=str)
    assert kept == [3, 5, 5, 7, None]  # both rows of the repeated one are marked


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7), (100, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[100], got[101], got[103]}) == 1 and got[0] != got[100]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
