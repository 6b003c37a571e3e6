"""Sessions that expire: a stream in several batches, with late rows, against the batch form."""

import datetime as dt
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docweave.operators import turns as dialogue
from docweave.operators.dialogue import answer_reuse
from docweave.streaming.files import run_append, stream_table, work_folder
from docweave.streaming.ordered import fold_in_event_order
from docweave.streaming.sessions import dialogue_sessions, dialogue_stream, reuse_stream

SCHEMA = "key long, ts timestamp, turn long, message string, cited array<string>, intent string, question boolean"
SAID = ["Am I eligible for any scheme?", "34", "Kerala", "2 lakh", "obc", "a lady", "hmm", "skip", "crop loans", "Hello", "Tell me about pension"]
BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def coded(df):
    read = dialogue.read_turns(df, "message")
    return read.select("key", "ts", "turn", F.col("_code").alias("code"), "cited", F.col("message").alias("said"), "intent", "question")


def rows_of(df):
    return sorted(tuple(r) for r in df.select(F.coalesce("key", F.lit("~")), F.unix_micros(F.col("started").cast("timestamp")).alias("started"), "turn", "turn_no", "action",
                                              F.coalesce("slot", F.lit("")), F.coalesce("failures", F.lit(-1)), "remembered", "recent",
                                              F.coalesce("last_intent", F.lit("")), F.coalesce("was_question", F.lit(False))).collect())


def write(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder, gap):
    return dialogue_stream(coded(stream_table(spark, folder, 1)), work_folder(spark, "test"), gap)


def turn(r, key, minute, n):
    cited = r.choice([None, [], [f"S{i}" for i in range(r.randint(1, 8))]])
    return key, BASE + dt.timedelta(minutes=minute), n, r.choice(SAID), cited, r.choice(["a", None, "b"]), r.choice([True, False])


def test_batches_equal_the_whole(spark, tmp_path):
    r, n, batches = random.Random(8), 0, []
    for b in range(4):  # rows come up to 8 minutes late, less than the watermark's 10
        rows = []
        for _ in range(60):
            n += 1
            rows.append(turn(r, r.choice([1, 2, None]), b * 50 + r.choice([0, 20, 45]) + r.uniform(0, 4) - (8 if b and r.random() < 0.2 else 0), n))
        batches.append(rows)
    batches.append([turn(r, 3, 1000, n + 1)])
    late = [turn(r, 1, 3, n + 2), turn(r, 4, 5, n + 3)]  # far behind the watermark: dropped
    folder = write(spark, str(tmp_path / "turns"), [*batches, late, [turn(r, 3, 1001, n + 4)]])
    got = rows_of(stream(spark, folder, 15 * 60))
    every = spark.createDataFrame([x for b in batches for x in b], SCHEMA).repartition(3)
    assert got == rows_of(dialogue_sessions(coded(every), 15 * 60, 3).filter("key is null or key <> '3'"))
    assert len(got) == 240 and len({g[1] for g in got}) > 8  # sessions expired and began anew


def test_state_is_dropped_after_the_gap(spark, tmp_path):
    r = random.Random(9)
    said = [(1, BASE, 1, SAID[0], ["A"], "x", True), (1, BASE + dt.timedelta(minutes=5), 2, "34", None, "x", True),
            (1, BASE + dt.timedelta(minutes=50), 3, "34", ["B"], "y", False), turn(r, 2, 200, 4)]
    folder = write(spark, str(tmp_path / "turns"), [[x] for x in said])
    got = [(g[2], g[3], g[4], g[5], g[7]) for g in rows_of(stream(spark, folder, 30 * 60))]
    assert got == [(1, 1, "ask_slot", "age", ""), (2, 2, "ask_slot", "state", "A"), (3, 1, "other", "", "")]


@pytest.mark.parametrize("target", [2, 2_000_000])
def test_five_names_and_six_turns(spark, target):
    rows = [(1, BASE + dt.timedelta(minutes=i), i, f"t{i}", [f"S{j}" for j in range(7)] if i == 0 else [], None, False) for i in range(9)]
    last = rows_of(dialogue_sessions(coded(spark.createDataFrame(rows, SCHEMA)), 3600, target))[-1]
    assert last[7:9] == ("S0,S1,S2,S3,S4", "t2,t3,t4,t5,t6,t7")


def reuse(rows, ttl):
    out, start = [], {}
    for key, ts, n, grounded in sorted(rows, key=lambda x: (x[1], x[2])):
        hit = key in start and ts < start[key] + dt.timedelta(seconds=ttl)
        if not hit:
            start.pop(key, None)
            if grounded:
                start[key] = ts
        out.append((n, hit))
    return sorted(out)


@pytest.mark.parametrize("target", [4, 2_000_000])
def test_answers_are_reused_while_they_live(spark, target):
    r = random.Random(target)
    rows = [(r.choice(["a", "b", None]), BASE + dt.timedelta(hours=r.randrange(200)), n, r.choice([True, False, None])) for n in range(250)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, turn long, grounded boolean").repartition(3)
    got = answer_reuse(df, ["key"], "ts", F.col("grounded"), 24 * 3600, target)
    assert sorted((x.turn, x.reused) for x in got.collect()) == reuse(rows, 24 * 3600)
    assert answer_reuse(df.limit(0), ["key"], "ts", F.col("grounded")).count() == 0


def test_reuse_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [[(r.choice(["a", "b"]), BASE + dt.timedelta(hours=b * 30 + r.randrange(30), minutes=r.randrange(9)), b * 50 + i, r.random() < 0.5) for i in range(50)] for b in range(4)]
    folder = str(tmp_path / "asked")
    for batch in [*rows, [("c", BASE + dt.timedelta(hours=500), 999, True)], [("a", BASE, 1000, True)], [("c", BASE + dt.timedelta(hours=501), 1001, True)]]:
        spark.createDataFrame(batch, "key string, ts timestamp, turn long, grounded boolean").coalesce(1).write.mode("append").parquet(folder)
    got = reuse_stream(stream_table(spark, folder, 1), work_folder(spark, "test"), 24 * 3600)
    assert sorted((x.turn, x.reused) for x in got.filter("turn <> 999").collect()) == reuse([x for b in rows for x in b], 24 * 3600)


def test_many_keys_share_few_states(spark, tmp_path):
    r, big = random.Random(4), 2 ** 60
    at = lambda: BASE + dt.timedelta(hours=r.randrange(48), microseconds=r.randrange(5))
    rows = [(r.choice([*map(str, range(300)), None, ""]), at(), big + n, r.choice([n, None])) for n in range(1500)]
    odd = [("5", None, 1, 1), (None, None, None, None), ("one", BASE, None, big + 1), ("one", BASE, big, None), ("one", BASE, 7, 2)]
    folder = str(tmp_path / "rows")
    for batch in [rows[:700] + odd, rows[700:], [("open", BASE + dt.timedelta(hours=100), 0, 0)]]:
        spark.createDataFrame(batch, "key string, ts timestamp, turn long, said long").coalesce(1).write.mode("append").parquet(folder)

    def fold(state, row):  # the turn before
        return [row["at"], row["turn"]], (row["turn"], state[1], row["said"])

    work = work_folder(spark, "test")
    late = "49 hours"  # nothing is late
    told = fold_in_event_order(stream_table(spark, folder, 1), late, fold, [None, None], lambda s: None if s[0] is None else s[0] + 3_600_000_000,
                               "turn long, before long, said long", buckets=8)
    got = run_append(told, work).collect()
    expected, last = [], {}
    for key, _, n, said in sorted((x for x in rows + odd if x[1]), key=lambda x: (x[1], x[2] is not None, x[2] or 0)):
        expected.append((key, n, last.get(key), said))
        last[key] = n
    order = lambda x: [(v is not None, v if v is not None else 0) for v in x[1:]] + [str(x[0])]
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    states = [json.loads(zlib.decompress(x.keys)) for x in spark.read.format("statestore").load(f"{work}/checkpoint").select("value.groupState.keys").collect()]
    assert [[key for key, _, _ in s] for s in states] == [["open"]]  # expired keys are gone, also from buckets still in use
    first = spark.read.format("statestore").option("batchId", 0).load(f"{work}/checkpoint")
    assert first.count() <= 8
