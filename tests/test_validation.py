"""Nested validation against a recursive walk over parsed JSON."""

import json
import random

from pyspark.sql import types as T

from docweave import schemas
from docweave.operators.profile import json_errors

LEAVES = {"string": str, "bigint": int, "double": (int, float), "boolean": bool}


def walk(value, kind, path):
    name = ".".join(path) or "<root>"
    wrong = [(name, "wrong type", json.dumps(value, separators=(",", ":"), sort_keys=True))]
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return wrong
        out = []
        for f in kind.fields:
            if value.get(f.name) is None and f.nullable:
                continue
            out += walk(value[f.name], f.dataType, [*path, f.name]) if f.name in value else [(".".join([*path, f.name]), "field required", None)]
        return out
    if isinstance(kind, T.ArrayType):
        return [e for i, x in enumerate(value) for e in walk(x, kind.elementType, [*path, str(i)])] if isinstance(value, list) else wrong
    ok = isinstance(value, LEAVES[kind.simpleString()]) and (kind.simpleString() == "boolean" or not isinstance(value, bool))
    return [] if ok else wrong


def random_value(r, kind, depth=0):
    if r.random() < 0.12:
        return r.choice([None, 3, "x", [], {}, True, [1], {"a": None}])
    if isinstance(kind, T.StructType):
        return {f.name: random_value(r, f.dataType) for f in kind.fields if r.random() < 0.9}
    if isinstance(kind, T.ArrayType):
        return [random_value(r, kind.elementType) for _ in range(r.randrange(4))]
    return {"string": "text é \"q\"", "bigint": r.choice([0, 10**15]), "double": 1.5, "boolean": False}[kind.simpleString()]


DDL = ("a string not null, `odd.name` bigint not null, b struct<c: double not null, d: array<array<bigint>> not null, e: boolean> not null, "
                            "faq array<struct<question: string not null, answer: string not null, more: array<struct<x: string not null>>>>")


def test_any_depth(spark):
    r, kind = random.Random(1), T.StructType.fromDDL(DDL)
    values = [random_value(r, kind) for _ in range(400)] + [{"faq": [{}] * 3 + [{"question": "q", "answer": 5}]}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(1000, None), (1001, "{"), (1002, "")]
    got = [tuple(x) for x in json_errors(spark.createDataFrame(rows, "id long, raw string"), "id", "raw", kind).collect()]
    want = [(i, *e) for i, v in enumerate(values) for e in walk(v, kind, [])]
    want += [(1000, "<root>", "unreadable", None), (1001, "<root>", "not JSON", None), (1002, "<root>", "not JSON", None)]
    sort = lambda rows: sorted(rows, key=str)
    assert sort(got) == sort(want)
    assert (400, "faq.3.answer", "wrong type", "5") in got


def test_the_document_schema(spark):
    empty = {f.name: "" if isinstance(f.dataType, T.StringType) else [] if isinstance(f.dataType, T.ArrayType) else {} for f in schemas.SCHEME.fields}
    bad = {**empty, "faq": [{"question": "q", "answer": "a"}, {"question": 1}], "eligibility": {"conditions": ["a", 2]}}
    df = spark.createDataFrame([(1, json.dumps(empty)), (2, json.dumps(bad))], "id long, raw string")
    assert {(r.id, r.field) for r in json_errors(df, "id", "raw", schemas.SCHEME).collect()} == {(2, "faq.1.question"), (2, "eligibility.conditions.1")}
