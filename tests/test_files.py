import json

import pandas as pd
from pyspark.sql import functions as F

from docweave.functions import arrow, sections as sec, text as tx
from docweave.operators import chunks, sync
from docweave.sources import files
from docweave.streaming import jobs
from docweave.streaming.files import stream_table


def test_json_scan_fills_leaves(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"scheme_name": "A"}, "extra": 1}))
    (tmp_path / "b.json").write_text('{"metadata": ')
    rows = {r["source_file"]: r for r in files.scan_json_documents(spark, str(tmp_path)).collect()}
    a = rows["a.json"]
    assert a["metadata"]["scheme_name"] == "A" and a["overview"]["description"] == "" and a["benefits"]["other_benefits"] == [] and a["faq"] == []
    assert rows["b.json"]["_corrupt_record"] is not None


def test_valid_and_rejected_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok"), (2, ""), (3, None)], "id int, name string")
    files.write_valid(df, F.col("name") != "", f"{tmp_path}/good", f"{tmp_path}/bad")
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/good").collect()] == [1]
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/bad").collect()) == [2, 3]


def test_usage_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 3), (1, "a", 2)], "id long, name string, pages long")
    for _ in range(2):
        files.append_usage(rows, "id", f"{tmp_path}/usage")
    got = files.read_usage(spark, f"{tmp_path}/usage").orderBy("position").select("name", "running_total").collect()
    assert list(map(tuple, got)) == [("a", 2), ("b", 5), ("a", 7), ("b", 10)]


def test_dates(value):
    read = lambda x: str(value(tx.parse_date, x))
    assert read("20240203") == read("2024-02-03") == "2024-02-03 00:00:00" and read("1706918400") == "2024-02-03 00:00:00"


def test_first_stored_name_counts(spark):
    listing = spark.createDataFrame([("A  b", "2024-06-01"), (None, "2024-06-01")], "scheme_name string, last_updated string")
    stored = spark.createDataFrame([("a b", "2024-01-01", None), ("A B ", "2024-12-01", None)], "scheme_name string, ingested_at string, last_synced string")
    assert [r["status"] for r in sync.compare_listing(listing, stored).orderBy("scheme_name").collect()] == ["new", "updated"]


def test_one_owner_per_file(spark):
    old = spark.createDataFrame([("a", "fa", "x")], "k string, f string, v string")
    new = spark.createDataFrame([("c", "fc", "1"), ("d", "fc", "2"), ("e", None, "3"), ("g", None, "4")], "k string, f string, v string")
    assert {r["k"]: r["action"] for r in sync.merge_fields(old, new, "k", "f", ["v"]).collect()} == {
        "a": "kept", "c": "inserted", "d": "error", "e": "inserted", "g": "inserted"}


def test_vocabulary_fallback(spark, tmp_path):
    (tmp_path / "full.txt").write_text("Share\n\n Benefits \n")
    (tmp_path / "empty.txt").write_text("\n \n")
    term = lambda name: sorted(r["term"] for r in files.scan_vocabulary(spark, str(tmp_path / name), ["Back", "benefits"], ["Benefits"]).collect())
    assert term("full.txt") == ["Share"] and term("empty.txt") == ["Back"]


def test_documents_and_parsers(spark, tmp_path):
    (tmp_path / "x.txt").write_text("short")
    (tmp_path / "y.txt").write_text("long " * 40)
    scanned = {r["file_name"]: r["text"] for r in files.scan_documents(spark, str(tmp_path)).collect()}
    assert scanned["x.txt"] == "short"
    parsed = arrow.parse_files(files.scan_binaries(spark, str(tmp_path), "*.txt"), lambda b: (b.decode(), 1.0), lambda b: ("second " + b.decode(), 0.5))
    got = {r["path"].rsplit("/", 1)[1]: (r["method"], r["text"][:6]) for r in parsed.collect()}
    assert got == {"x.txt": ("second", "second"), "y.txt": ("first", "long l")}


def test_embedder_hook(spark):
    embed = arrow.embedder(lambda: (lambda texts: [[float(len(t)), 0.0] for t in texts]), "query: ")
    rows = spark.createDataFrame([("a",), (None,)], "t string").select(embed("t").alias("v")).collect()
    assert [list(r["v"]) for r in rows] == [[1.0, 0.0], [1.0, 0.0]]
    answer = arrow.answer_model(lambda: (lambda prompts: [p[::-1] for p in prompts]))
    assert spark.createDataFrame([("ab",)], "t string").select(answer("t").alias("v")).collect()[0]["v"] == "ba"


def test_reports(spark, tmp_path):
    rows = [("2024-01-01", "success", 2, 3), ("2024-01-02", "failed", 9, 9)]
    df = spark.createDataFrame(rows, "sync_timestamp string, status string, new_schemes_added int, schemes_updated int")
    got = sync.sync_status(df).collect()[0]
    assert (got["last_sync"], got["schemes_updated_last_sync"], got["last_sync_failed"]) == ("2024-01-01", 5, True)
    files.write_report(df.limit(1).drop("sync_timestamp"), str(tmp_path / "r"))
    assert files.read_reports(spark, str(tmp_path / "r"), "status string").count() == 1


def test_load_is_idempotent(spark):
    incoming = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False), (4, "c", True)], "id long, f string, ok boolean")
    empty = incoming.select("f").limit(0)
    first = chunks.load_new(empty, incoming, "f", "id", F.col("ok"))
    assert {r["id"]: r["outcome"] for r in first.collect()} == {1: "inserted", 2: "skipped", 3: "failed", 4: "inserted"}
    again = chunks.load_new(first.filter("outcome = 'inserted'").select("f"), incoming, "f", "id", F.col("ok"))
    assert "inserted" not in {r["outcome"] for r in again.collect()}


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", "fa", "x"), ("b", "fb", "y")], "k string, f string, v string")
    new = spark.createDataFrame([("a", "zz", ""), ("b", "zz", "Y"), ("c", "fc", "z"), ("d", "fa", "q")], "k string, f string, v string")
    once = sync.merge_fields(old, new, "k", "f", ["v"])
    rows = {r["k"]: (r["f"], r["v"], r["action"]) for r in once.collect()}
    assert rows == {"a": ("fa", "x", "updated"), "b": ("fb", "Y", "updated"), "c": ("fc", "z", "inserted"), "d": ("fa", "q", "error")}
    kept = once.filter("action <> 'error'").select("k", "f", "v")
    twice = sync.merge_fields(kept, new.filter("k <> 'd'"), "k", "f", ["v"]).select("k", "f", "v")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, kept.collect()))


def test_gap_chains_match_the_loop(spark):
    import random

    rng, docs = random.Random(7), []
    for d in range(60):
        docs.append((d, [("h", rng.choice(["", "x"])) for _ in range(rng.randint(0, 7))]))
    want = []
    for d, s in docs:
        flags, i = [(False, False)] * len(s), 0
        while i < len(s):
            start = i
            while i < len(s) - 1 and s[i][1] == "":
                i += 1
            if i > start:
                for j in range(start, i + 1):
                    flags[j] = (True, j == i)
            i += 1
        want.append((d, flags))
    df = spark.createDataFrame(docs, "d long, s array<struct<heading:string,content:string>>")
    got = df.select("d", sec.mark_chains(F.col("s")).alias("s")).orderBy("d").collect()
    assert [(r["d"], [(x["suppressed"], x["orphan"]) for x in r["s"]]) for r in got] == want


def scheme_rows(*rows):
    return pd.DataFrame([{"scheme_id": i, "source_file": f"f{i}", "scheme_name": "n", "description": d, "other_benefits": [], "conditions": [], "steps": []} for i, d in rows])


def test_index_upkeep_over_batches(spark, tmp_path):
    long = "a real description that is long enough to count as content"
    src = tmp_path / "schemes"
    src.mkdir()
    scheme_rows((1, long), (2, long)).to_parquet(src / "a.parquet")
    job = lambda: jobs.index_upkeep(stream_table(spark, str(src), 1), str(tmp_path / "job"))
    assert job().count() == 8
    scheme_rows((2, "short"), (3, long)).to_parquet(src / "b.parquet")
    ids = {r["chunk_id"] for r in job().collect()}
    assert len(ids) == 11 and "f2_description" not in ids and "f3_description" in ids


def test_slot_stream_over_batches(spark, tmp_path):
    from docweave.operators.dialogue import slot_outcomes

    rows = [(1, "age", 1, None, False), (1, "age", 2, None, False), (1, "age", 3, "30", False), (1, "age", 4, None, False), (2, "age", 1, None, False),
            (2, "age", 2, None, False), (2, "age", 3, None, False), (3, "state", 1, None, True)]
    frame = pd.DataFrame(rows, columns=["session_id", "slot", "turn", "value", "is_skip"])
    src = tmp_path / "replies"
    src.mkdir()
    schema = spark.createDataFrame(rows, "session_id long, slot string, turn long, value string, is_skip boolean").schema
    for n, part in enumerate([frame.iloc[::2], frame.iloc[1::2]]):
        spark.createDataFrame(part.astype(object).where(part.notna(), None).values.tolist(), schema).coalesce(1).write.mode("append").parquet(str(src))
    batch = spark.read.parquet(str(src))
    streamed = jobs.slot_dialogue(stream_table(spark, str(src), 1), str(tmp_path / "job"))
    want = {(1, "age", "30", 2, False), (2, "age", None, 3, True), (3, "state", None, 0, True)}
    assert {tuple(r) for r in slot_outcomes(batch).collect()} == want == {tuple(r) for r in streamed.collect()}


def test_page_detail_prefers_the_payload(value):
    from docweave.sources import listing

    plain = "<html><h1>My &amp; Plan</h1><h2>Benefits</h2><ul><li>- one</li><li>two</li></ul><h2>Else</h2><p>x</p><h3>Eligibility</h3><p>all</p>Last updated: 3 Feb 2024</html>"
    got = value(listing.page_detail, plain)
    assert (got["scheme_name"], got["benefits"], got["eligibility"][0]) == ("My & Plan", ["one", "two"], "all")
    payload = '{"props":{"pageProps":{"schemeData":{"en":{"basicDetails":{"schemeName":"Given"},"schemeContent":{"benefits":"a\\nb"}}}}}}'
    got = value(listing.page_detail, plain.replace("<h1>", f'<script id="__NEXT_DATA__" type="application/json">{payload}</script><h1>'))
    assert (got["scheme_name"], got["benefits"]) == ("Given", ["a", "b"])
