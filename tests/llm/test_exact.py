"""Exact groups, mixing, URL rules and the pipeline against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from docweave.llm.exact_dedup import _chains, directory, drop_exact, exact_groups
from docweave.llm.mixing import mixing_rates, poisson_mix
from docweave.llm.url_filter import build_cascade, judge_urls
from tests.llm.test_near import brute as near_brute

SCHEMA = "doc_id bigint, text string, hash string, ids bigint"


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def groups(rows):
    of = defaultdict(list)
    for i, t in rows:
        of[bare(t)].append((-len(t or ""), i))
    return sorted((i, min(m)[1], len(m), min(m)[1] == i, hashlib.sha256(b.encode()).hexdigest()) for b, m in of.items() for _, i in m)


def test_exact_groups(spark):
    r = random.Random(2)
    texts = ["", " \n", None, "a b", "ab", "ab ", "\x1ca b", "é\x0b"] + ["".join(r.choice("ab c\n") for _ in range(r.randint(0, 7))) for _ in range(300)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, exact_groups(df).collect())) == groups(rows)
    assert sorted(map(tuple, exact_groups(df, bucket_bytes=300).collect())) == groups(rows)
    assert sorted(r.doc_id for r in drop_exact(df).collect()) == sorted({g[1] for g in groups(rows)})


def test_exact_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a "), (3, "a "), (None, None), (None, "")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 2, True), (None, None, 2, True)], key=str)
    assert [(r.doc_id, bare(r.text)) for r in drop_exact(df).orderBy("doc_id").collect()] == [(None, ""), (3, "a")]
    assert exact_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_known_id_wins_over_null_of_equal_length(spark, parts):
    rows = [(None, "a"), (3, "a"), (None, "b"), (7, "b"), (-2, "b"), (None, "b"), (None, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    df = df.repartition(parts) if parts > 1 else df
    assert {(r.keep_id, r.group_size) for r in exact_groups(df).collect()} == {(3, 2), (-2, 4), (None, 2)}
    assert sorted((r.text, r.doc_id) for r in drop_exact(df).collect()) == [("a", 3), ("b", -2), ("c", None)]


def test_directory_splits_only_what_is_overfull(spark):
    hashes = [h << 55 for h in range(-256, 256)] + [5 << 20] * 400 + [(5 << 20) + (1 << 12)]
    entries = spark.createDataFrame([(h, 100) for h in hashes], "hash bigint, size bigint")
    buckets = directory(entries, 4000)
    assert [b for b, _ in buckets] == sorted({b for b, _ in buckets}) and buckets[0][0] == -(1 << 63)
    held = Counter(max(i for i, (first, _) in enumerate(buckets) if first <= h) for h in hashes)
    crowded = [i for i, n in held.items() if n * 164 > 4000]
    assert all(len({h for h in hashes if max(j for j, (f, _) in enumerate(buckets) if f <= h) == i}) == 1 for i in crowded)


def test_chained_collisions():
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["entry", "hash", "body"])
    out = _chains(iter([batch([(1, 7, b"x"), (2, 7, b"y")]), batch([(3, 7, b"x"), (4, 8, b"y")])]))
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(1, 7, 0), (2, 7, 1), (3, 7, 0), (4, 8, 0)]


def test_mixing(spark):
    rows = [(i, "x" * (5 + i % 7), "s" + str(i % 2 if i % 5 else 0), i) for i in range(6000)] + [(None, None, None, 0), (None, "abc", None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy bigint").repartition(3)
    rates = {r.source: r.rate for r in mixing_rates(df, {"s0": 1, "s1": 3}).collect()}
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(t or "")
    whole = sum(sizes.values())
    assert rates["s0"] == pytest.approx(0.25 * whole / sizes["s0"]) and rates[None] == 0
    got = Counter(r.doc_id for r in poisson_mix(df, {"s0": 1, "s1": 3}).collect())
    for source in ("s0", "s1"):
        ids = [i for i, _, s, _ in rows if s == source]
        counts = Counter(got[i] for i in ids)
        for k in range(3):
            want = math.exp(-rates[source]) * rates[source] ** k / math.factorial(k)
            assert counts[k] / len(ids) == pytest.approx(want, abs=0.04)
    big = poisson_mix(df.where("doc_id = 1"), total=2000.0).count()
    assert 1800 < big < 2200
    assert poisson_mix(df.limit(0)).count() == 0
    order = [r.doc_id for r in poisson_mix(df).collect()]
    assert order == [r.doc_id for r in poisson_mix(df.repartition(7)).collect()] and order != sorted(order, key=lambda i: i or 0)


def test_cascade_is_exact(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = keys.where("pmod(hash(key), 5) = 0")
    cascade = build_cascade(keys.union(spark.createDataFrame([(None,)], "key string")), listed)
    assert len(cascade.levels) > 1
    got = {r.key for r in cascade.columns(keys).where(cascade.holds(keys.key)).collect()}
    assert got == {r.key for r in listed.collect()}


def test_urls(spark):
    urls = {1: "http://A.Example.NET/en/x?q", 2: "https://net/", 3: "https://net", 4: "x://planet/", 5: None, 6: "no scheme", 7: "http:///en/", 8: "http://org/fr/#a/de/",
            9: "http://example.com/de/1", 10: "http://notexample.com/de/", 11: "u://example.net/en", 12: "u://a.b.net?x/", 13: "a://b.org/fr/\n/x"}
    df = spark.createDataFrame([(i, u, "r", "h") for i, u in urls.items()], "page_id bigint, url string, rule string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("net", "/", "net/", "block"), 3: ("net", "", None, "allow"), 4: ("planet", "/", None, "allow"),
                   5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "/en/", None, "allow"), 8: ("org", "/fr/", "org/fr/", "allow"),
                   9: ("example.com", "/de/1", "example.com/de/", "block"), 10: ("notexample.com", "/de/", None, "allow"), 11: ("example.net", "/en", "net/", "block"),
                   12: ("a.b.net", "", None, "allow"), 13: ("b.org", "/fr/\n/x", "org/fr/", "allow")}
    assert judge_urls(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from docweave.llm.packing import Encoder
    from docweave.llm.quality import fit_quality, passage_features

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = fit_quality(docs, labels)
    scores = dict(zip(rows, model.scores(*passage_features([(r.text or "").encode() for r in rows.values()]))))
    kept = [(i, r.text) for i, r in rows.items() if scores[i] >= 0.3]
    kept = [(i, rows[i].text) for i in sorted({g[1] for g in groups(kept)})]
    left = [i for i, x in near_brute(kept, 80).items() if x[2]]
    mixed = Counter(r.doc_id for r in poisson_mix(docs.where(docs.doc_id.isin(left))).collect())
    encoder = Encoder(open(corpus_pipeline.tokenizer("word_bpe_49k.json"), encoding="utf-8").read())
    import pyarrow as pa

    want = Counter()
    for i, n in mixed.items():
        want[i] += n * len(encoder.texts(pa.array([rows[i].text or ""]))[0])
    got = Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == want and len(want) > 50
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "packing"]
