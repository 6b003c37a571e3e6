import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave import fixed
from docweave.operators import mentions, packing, search


def vectors(n, seed, width=8):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")


def tables(spark, chunks=300, queries=12):
    c = [(i, i // 3, str(i % 4), v.tolist()) for i, v in enumerate(vectors(chunks, 1))]
    q = [(i, v.tolist(), None if i % 2 else str(i % 5)) for i, v in enumerate(vectors(queries, 2))]
    return (spark.createDataFrame(c, "chunk_id long, scheme_id long, state string, embedding array<float>").repartition(5),
            spark.createDataFrame(q, "query_id long, query_vector array<float>, query_state string"), c, q)


def brute(c, q, k, scope=None, fallback=True):
    out = []
    for qid, vec, state in q:
        def hits(state):
            rows = [(2 * float(np.dot(np.array(vec, "f8"), np.array(v, "f8"))) - 1, cid, sid) for cid, sid, st, v in c
                    if (state is None or st == state) and (scope is None or (qid, sid) in scope)]
            return sorted(rows, key=lambda r: (-r[0], r[1]))[: k * (6 if scope is not None else 2)]
        found = hits(state) or (hits(None) if fallback and scope is None else [])
        seen = []
        for _, cid, sid in found:
            if sid not in seen:
                seen.append(sid)
        out += [(qid, i + 1, sid) for i, sid in enumerate(seen[:k])]
    return sorted(out)


def test_retrieval_matches_brute_force(spark):
    chunks, queries, c, q = tables(spark)
    got = search.retrieve(chunks, queries, 5).select("query_id", "place", "scheme_id")
    assert sorted(map(tuple, got.collect())) == brute(c, q, 5)
    grid = search.retrieve(chunks, queries, 5, max_queries=5, cell=80).select("query_id", "place", "scheme_id")
    assert sorted(map(tuple, grid.collect())) == brute(c, q, 5)


def test_scope(spark):
    chunks, queries, c, q = tables(spark)
    pairs = [(qi, s) for qi in range(6) for s in range(100) if (s + qi) % 7 == 0]
    scope = spark.createDataFrame(pairs, "query_id long, scheme_id long")
    got = search.retrieve(chunks, queries, 3, scope).select("query_id", "place", "scheme_id")
    assert sorted(map(tuple, got.collect())) == brute(c, q, 3, set(pairs))


def test_scope_in_the_grid_and_for_all(spark):
    chunks, queries, c, q = tables(spark)
    pairs = [(qi, s) for qi in range(12) for s in range(100) if (s + qi) % 7 == 0]
    scope = spark.createDataFrame(pairs, "query_id long, scheme_id long")
    got = search.retrieve(chunks, queries, 3, scope, max_queries=5, cell=80).select("query_id", "place", "scheme_id")
    assert sorted(map(tuple, got.collect())) == brute(c, q, 3, set(pairs))
    within = spark.range(0, 100, 3).withColumnRenamed("id", "scheme_id")
    got = search.retrieve(chunks, queries, 3, within=within).select("query_id", "place", "scheme_id")
    assert sorted(map(tuple, got.collect())) == brute(c, q, 3, {(i, s) for i in range(12) for s in range(0, 100, 3)})


def test_missing_documents_and_vectors(spark):
    """Schemes without a document leave no gap; chunks not embedded yet, or wrongly, take no part."""
    chunks, queries, c, q = tables(spark)
    odd = spark.createDataFrame([(900, 900, "1", None), (901, 901, "1", [1.0])], chunks.schema)
    full = search.retrieve(chunks.union(odd), queries, 12, fallback=False).select("query_id", "place", "scheme_id")
    assert sorted(map(tuple, full.collect())) == brute(c, q, 12, fallback=False)
    ranked = {}
    for query, _, scheme in brute(c, q, 12):
        ranked.setdefault(query, []).append(scheme)
    gone = {s for schemes in ranked.values() for s in schemes[:2]}
    docs = spark.range(100).filter(~F.col("id").isin(*gone)).select(F.col("id").alias("scheme_id"), F.lit("x").alias("title"))
    got = {}
    for r in search.retrieve(chunks, queries, 12, documents=docs).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.scheme_id)
    want = {query: [s for s in schemes if s not in gone] for query, schemes in ranked.items()}
    assert all(got.get(query, [])[: len(left)] == left for query, left in want.items())
    centres = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "k string, c array<double>")
    vectors_ = spark.createDataFrame([(1, [0.9, 0.1]), (2, None), (3, [1.0])], "id long, v array<double>")
    near = {r.id: (r.category, r.confident) for r in search.classify_vectors(vectors_, "v", centres, "k", "c").collect()}
    assert near == {1: ("a", True), 2: (None, False), 3: (None, False)}


def test_category_limit_is_an_error(spark):
    import pytest

    df = spark.range(search.MAX_CATEGORIES + 1).select(F.col("id").alias("k"), F.array(F.lit(1.0)).alias("v"))
    with pytest.raises(ValueError):
        search.classify_vectors(df, "v", df, "k", "v")


WORDS = "amma two wheeler scheme for working women post matric scholarship pension plan of kerala new grant".split()


def test_automaton_and_grams_agree(spark):
    rng = random.Random(6)
    alphabet = ["two", "wheeler", "योजना", "पेंशन", "a_b", "x", "-", "é", "plan", "plans"]
    names = [(i, rng.choice([" ", "-"]).join(rng.choices(alphabet, k=rng.randint(1, 4)))) for i in range(80)]
    names = [(i, n) for i, n in names if len(n) >= 4] + [(900, None)]
    texts = [(i, rng.choice(["", " "]).join(rng.choices(alphabet + [" "], k=25))) for i in range(120)] + [(900, None), (901, "")]
    hay, needles = spark.createDataFrame(texts, "hay_id long, hay string"), spark.createDataFrame(names, "needle_id long, needle string")
    for whole in (True, False):
        one = mentions.contained_pairs(hay, needles, whole).select("hay_id", "needle_id", "needle")
        other = mentions.contained_pairs(hay, needles, whole, most=3).select("hay_id", "needle_id", "needle")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) != []


def test_edges_of_words_do_not_depend_on_the_number_of_names(spark):
    edges = ["", "²", "½", "Ⓐ", "_", "\u200c", "\u0301", "ⅷ", "٣", "-", "्", "‿", "中", "·", "\U0001d7ce", "℮", "ª"]
    texts = [(i, f"x {a}alpha beta{b} y") for i, (a, b) in enumerate([(a, b) for a in edges for b in edges])]
    hay, needles = spark.createDataFrame(texts, "hay_id long, hay string"), spark.createDataFrame([(1, "alpha beta")], "needle_id long, needle string")
    few, many = ({r.hay_id for r in mentions.contained_pairs(hay, needles, True, most).collect()} for most in (20_000, 0))
    outside = {"", "Ⓐ", "-", "·", "℮"}
    assert few == many == {i for i, (a, b) in enumerate([(a, b) for a in edges for b in edges]) if a in outside and b in outside}


def test_mentions_match_brute_force(spark):
    rng = random.Random(1)
    names = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 5)))) for i in range(60)]
    texts = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(80)]
    want = []
    for tid, text in texts:
        found = [(n, i) for i, n in names if len(n) >= 4 and set(n.split()) - set(fixed.GENERIC_NAME_WORDS) and re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text)]
        kept = []
        for n, i in sorted(found, key=lambda f: (-len(f[0]), f[1])):
            if not any(n in k for k, _ in kept):
                kept.append((n, i))
        want += [(tid, p, i) for p, (n, i) in enumerate(kept[:3])]
    got = mentions.mentioned_names(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(names, "name_id long, name string"))
    assert sorted(map(tuple, got.select("text_id", "place", "name_id").collect())) == sorted(want)


def test_lookup(spark):
    names = spark.createDataFrame([(1, "Amma Two Wheeler Scheme for Working Women"), (2, "Amma Two Wheeler Scheme"), (3, "Kisan"), (4, "Old Age Pension")], "name_id long, name string")
    asked = spark.createDataFrame([(1, "amma two wheeler scheme"), (2, "Two Wheeler S"), (3, "Kisan"), (4, "Kis"), (5, "The Old Age Pension Plan"), (6, "nothing here")], "target_id long, target string")
    got = mentions.lookup_names(asked, names).orderBy("target_id", "place").collect()
    assert [(r["target_id"], r["name_id"]) for r in got] == [(1, 2), (2, 2), (2, 1), (3, 3), (5, 4)]


def test_typos_match_difflib(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def noise(w):
        i = rng.randrange(1, len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w, w.upper(), w.title(), w + "s"])

    texts = [(i, " ".join(noise(rng.choice(fixed.TYPO_WORDS + fixed.TYPO_KEEP + ["banana"])) for _ in range(12)) + ("!" if i % 2 else " in tamilnadu")) for i in range(60)]
    texts.append((99, "पेंशन shcemes"))

    def word(m):
        w, low = m.group(0), m.group(0).lower()
        if low in fixed.TYPO_WORDS or low in fixed.TYPO_KEEP or w.isupper():
            return w
        close = difflib.get_close_matches(low, [v for v in fixed.TYPO_WORDS if v[0] == low[0] and abs(len(v) - len(low)) <= 2], n=1, cutoff=0.8)
        return close[0] if close else w

    want = {i: (t if i == 99 else re.sub("[A-Za-z]{4,}", word, re.sub(r"(?i)\btamil[\s-]?nadu\b", "Tamil Nadu", t))) for i, t in texts}
    got = mentions.fix_typos(spark.createDataFrame(texts, "text_id long, text string"), fixed.TYPO_WORDS, fixed.TYPO_KEEP)
    assert {r["text_id"]: r["fixed"] for r in got.collect()} == want


def test_typos_are_repaired_in_the_row(spark):
    df = spark.createDataFrame([(1, "the shcemes in tamilnadu")], "text_id long, text string")
    plan = mentions.fix_typos(df, fixed.TYPO_WORDS, fixed.TYPO_KEEP)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Join|Aggregate|Generate|Sort", plan)


@pytest.mark.parametrize("most", [100_000, 1])
def test_typos_need_no_ids_and_miss_no_word_of_the_rule(spark, monkeypatch, most):
    monkeypatch.setattr(mentions, "MAX_KNOWN_WORDS", most)
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def edited(w):
        for _ in range(rng.randint(1, 5)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]])
        return rng.choice([w, w, w, w.title(), w.upper()])

    texts = [" ".join(edited(rng.choice(fixed.TYPO_WORDS)) for _ in range(40)) for _ in range(100)] + ["", None, "shcemes पेंशन"]

    def word(m):
        low = m[0].lower()
        if low in fixed.TYPO_WORDS or low in fixed.TYPO_KEEP or m[0].isupper():
            return m[0]
        ratios = [(difflib.SequenceMatcher(None, v, low).ratio(), v) for v in fixed.TYPO_WORDS if v[0] == low[0] and abs(len(v) - len(low)) <= 2]
        return max((r for r in ratios if r[0] >= 0.8), default=(0, m[0]))[1]

    want = [t if not t or t.endswith("पेंशन") else re.sub("[A-Za-z]{4,}", word, t) for t in texts]
    rows = [((None, 1, 2)[i % 3], t) for i, t in enumerate(texts)]
    got = mentions.fix_typos(spark.createDataFrame(rows, "text_id long, text string"), fixed.TYPO_WORDS, fixed.TYPO_KEEP)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(i, t) for (i, _), t in zip(rows, want)], key=key)
    assert sum(a != b for a, b in zip(texts, want)) > 50


def test_packing_matches_sequential(spark):
    rng = random.Random(4)
    rows = [tuple(rng.choice("xyz") * rng.choice([0, 3, 200, 450, 900, 3000]) for _ in range(5)) for _ in range(60)]
    want = []
    for texts in rows:
        shares = [s for _, s in fixed.SECTION_SHARES]
        allowed = [min(len(t), s) for t, s in zip(texts, shares)]
        left = fixed.SCHEME_CHAR_CAP - sum(allowed)
        for i, t in enumerate(texts):
            extra = min(len(t) - allowed[i], max(left, 0))
            allowed[i] += extra
            left -= extra
        want.append("\n".join(t if len(t) <= a else t[: max(a - 1, 0)].rstrip() + "…" for t, a in zip(texts, allowed) if t))
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    got = df.select(packing.pack_sections([F.col(x) for x in "abcde"]).alias("p")).collect()
    assert [r["p"] for r in got] == want


def test_guard(spark):
    answers = spark.createDataFrame([(1, "The Atal Pension helps", "high"), (2, "Paris", "high")], "query_id long, answer string, confidence string")
    hits = spark.createDataFrame([(1, 10, "Atal Pension-"), (2, 10, "Atal Pension-")], "query_id long, scheme_id long, name string")
    rows = {r["query_id"]: r for r in mentions.guard_answers(answers, hits, "no").collect()}
    assert rows[1]["first_cited"] == 10 and (rows[2]["answer"], rows[2]["confidence"]) == ("no", "low")
