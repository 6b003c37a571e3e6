"""Classifiers: automata against edit distances, held-out accuracy, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import quality, toxicity
from docweave.llm.quality import fit_attention, passage_features, quality_scores
from docweave.llm.toxicity import Automaton, Toxicity, allowance, fit_rows, toxicity_scores

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_the_distance():
    r, entries = random.Random(4), ["idiot", "idol", "disgusting", "pathetic", "loweit*", "scu", "ünsinnig"]
    words = ["", "x"] + entries
    for _ in range(4000):
        w = list(r.choice(entries).rstrip("*"))
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(w) + 1)
            w[at:at + r.randint(0, 1)] = r.choice(["", "a", "t", "i", "ü"])
        words.append("".join(w))

    def want(word):
        best = [1] if word.startswith("loweit") else []
        best += [1 + d for e in entries if not e.endswith("*") and (d := distance(word, e)) <= allowance(e)]
        return min(best, default=0)

    assert Automaton(entries).values(words).tolist() == [want(w) for w in words]


def test_context():
    model, automaton = Toxicity(), Automaton(["idiot"])
    texts = ["you are an idiot", 'the word "idiot" was used', "an idiot", "an id1ott idiot", "fine", "", None]
    scores = model.scores(pa.array(texts), automaton)
    direct, quoted, bare, twice, *none = scores
    assert quoted < bare < direct and bare < twice and len(set(none)) == 1 and none[0] < quoted


def accuracy(rows):
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    return sum(r.predicted == r.y for r in held) / len(held)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out(spark, module, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = module.judged(docs, labels, most=500)
    assert got.count() == docs.count()
    assert accuracy(got.join(labels.selectExpr("doc_id", f"{label} as y"), "doc_id").where("y is not null").collect()) > 0.97


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    docs = spark.createDataFrame([(1, "a", 0.5), (None, None, None), (2, "", None), (2, "b\n\n" * 300, 1.0), (1, "a", 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (2, 0, None), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = module.judged(docs, labels).collect()
    assert sorted((str(r.doc_id) for r in rows)) == ["1", "1", "2", "2", "None"] and all(0 <= r.score <= 1 for r in rows)
    assert module.judged(docs.limit(0), labels.limit(0)).count() == 0


def test_passages_cover_the_text():
    texts = [b"", b" ", b"word " * 400, b"x" * 5000, b"a\nb"]
    features, counts = passage_features(texts)
    assert len(features) == counts.sum() and counts.tolist() == [1, 1, 4, 1, 1] and np.isfinite(features).all()


def test_attention_gradient():
    """A bag is what its one telling passage is, wherever it stands."""
    r = random.Random(1)
    clean = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(300))
    rows = []
    for i in range(60):
        parts = [clean() for _ in range(3)]
        if i % 2:
            parts[r.randrange(3)] = "### $$$ " * 70
        rows.append((" ".join(parts), i % 2, 1.0))
    model = fit_attention(rows, 0.5)
    scores = model.scores(*passage_features([t.encode() for t, _, _ in rows]))
    assert all((s > 0.5) == bool(y) for s, (_, y, _) in zip(scores, rows))


def test_models_travel(spark):
    docs = spark.createDataFrame([(1, "stupid idiot"), (2, "calm text")], "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in toxicity_scores(docs, fit_rows([])).collect()}
    assert scores[1] > scores[2]
    assert all(r.score == pytest.approx(0.25) for r in quality_scores(docs, fit_attention([], 0.25)).collect())
