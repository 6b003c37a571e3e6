"""Cutting around names against a regular expression of all names, longest first."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docweave import fixed
from docweave.operators.segments import changed_between, longest_spans, split_around_names


def expected(text, names):
    pattern = "|".join(re.escape(n) for n in sorted({n for n in names if n}, key=len, reverse=True)) + ("|" if any(names) else "") + r"\*\*"
    return [m.group() for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("most", [0, 20_000])
def test_names_and_texts(spark, most):
    r = random.Random(2)
    names = ["ab cd", "ab cd ef", "cd ef", "bcde", "ééé ü", "x.y*", None, ""]
    bits = ["ab cd", " ef", "cd ef", "ab", " ", "\n", "1. ", "- ", " 2.", "**", "x.y*", "ééé ü", "word", "–", "42", "_"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(25)))) for i in range(300)] + [(300, None), (301, ""), (302, "ab cd " * 20_000)]
    df = spark.createDataFrame(rows, "text_id long, text string").repartition(3)
    cut = split_around_names(df, spark.createDataFrame([(n,) for n in names], "name string"), most=most)
    got = {x.text_id: x for x in cut.select("text_id", "segments", changed_between(F.col("segments"), F.upper).alias("loud")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        if text is None:
            assert got[i].segments is None
            continue
        parts = [(s.kind, s.part) for s in got[i].segments]
        assert "".join(p for _, p in parts) == text and all(p for _, p in parts)
        assert [p for k, p in parts if k in ("name", "mark")] == expected(text, names)
        assert all(re.search(fixed.SEGMENT_LETTER, p) and p == p.strip() for k, p in parts if k == "text")
        assert got[i].loud == "".join(p.upper() if k == "text" else p for k, p in parts)


def test_list_markers_are_lifted_out(spark):
    df = spark.createDataFrame([(1, "3. First scheme ab cd is **good** 4.\n – 12\n- last")], "text_id long, text string")
    (row,) = split_around_names(df, spark.createDataFrame([("ab cd",)], "name string")).collect()
    assert [(s.kind, s.part) for s in row.segments] == [
        ("rest", "3. "), ("text", "First scheme"), ("rest", " "), ("name", "ab cd"), ("rest", " "), ("text", "is"), ("rest", " "), ("mark", "**"), ("text", "good"),
        ("mark", "**"), ("rest", " 4.\n – 12\n- "), ("text", "last")]


def test_longest_spans():
    assert longest_spans([(5, 9), (0, 3), (0, 6), (2, 8), (6, 7), (9, 9)]) == [(0, 6), (6, 7), (9, 9)]
