"""The filter audit against a document-by-document replay of every order."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from docweave.llm.filter_audit import filter_audit, order_audit

SCHEMA = "doc_id bigint, text string, lang string, part string, fails string, n bigint"
LABELS = "doc_id bigint, quality int, toxic int, text string"


def fails(text, i, low):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    got = "A" if len(words) < 200 else ""
    got += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    got += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    got += "D" if re.search("[#$%&*|]", text) else ""
    return got + ("E" if i is not None and low is not None and low < i else "")


def brute(rows, labels):
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = [(p or "", fails(t or "", i, low.get(t or "")), i in good, i in toxic) for i, t, p in rows]
    counts, shapley = defaultdict(Counter), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, mask, is_good, is_toxic in docs:
            there = True
            for k, letter in enumerate(order, 1):
                c, hit = counts[part, order, k], letter in mask
                c["unique_fails"] += mask == letter
                c["redundant"] += hit and not there
                c["removed"] += hit and there
                c["good_lost"] += hit and there and is_good
                c["toxic_lost"] += hit and there and is_toxic
                shapley[part, letter] += hit and there
                there = there and not hit
                c["kept"] += there
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return sorted((*key, *[c[n] for n in names], shapley[key[0], key[1][key[2] - 1]]) for key, c in counts.items())


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_all_orders(spark):
    r = random.Random(3)
    texts = ["", None, " \n", "AB" * 9, "a#b", "x " * 300, "\x1ca \x0b", "é" * 5, "Ünï " * 250, "w " * 100_000 + "|",
             " ".join(f"w{i}" for i in range(260)), " ".join(f"W{i}" for i in range(260)), " ".join(f"W{i}%" for i in range(199))]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice([None, "", "en", "de"])) for _ in range(300)]
    rows += [(5, "same", "en")] * 3 + [(None, "same", "en"), (6, "same", "de")]
    labels = [(i, r.choice([None, 0, 1]), r.choice([None, 0, 1])) for i in [*range(0, 40, 2), 4, 4, None]]
    docs = spark.createDataFrame([(i, t, p, "x", "y", 7) for i, t, p in rows], SCHEMA).repartition(5)
    marks = spark.createDataFrame([(*x, "z") for x in labels], LABELS)
    result = filter_audit(docs, marks)
    assert result.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got(result) == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit(docs, labels).count() == 0
    one = filter_audit(spark.createDataFrame([(None, None, None, "", "", 1)], SCHEMA), labels)
    assert got(one) == brute([(None, None, None)], []) and one.count() == 600


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", "", 5, 1, 0), ("p", "X", 3, 0, 1), ("p", "XY", 2, 2, 2)], "part string, fails string, n bigint, good bigint, toxic bigint")
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in order_audit(cells, "XY").collect()} == {
        ("XY", 1): (5, 5, 0, 3, 2, 3, 8), ("XY", 2): (5, 0, 2, 0, 0, 0, 2), ("YX", 1): (8, 2, 0, 0, 2, 2, 2), ("YX", 2): (5, 3, 2, 3, 0, 1, 8)}
