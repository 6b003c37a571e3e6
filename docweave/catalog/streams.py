"""Streaming jobs over the tables, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.catalog.registry import query
from docweave.catalog.tables import CHUNKS, schemes
from docweave.operators import dialogue
from docweave.streaming import jobs
from docweave.streaming.files import stream_table, work_folder


class Streams:
    """The tables of a folder read as streams."""

    def __init__(self, tables):
        self.spark, self.sf_dir = tables.spark, tables.sf_dir

    def spread(self, table):
        return self.__getattr__(table)

    def __getattr__(self, table):
        return stream_table(self.spark, f"{self.sf_dir.rstrip('/')}/{table}.parquet")


@query("str1_session_stream", """
    with g as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
    s as (select *, sum(case when prev is null or ts - prev >= interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as n from g),
    a as (select user_id, n, min(ts) as started, max(ts) as ended, count(*) as turns from s group by 1, 2)
    select user_id, epoch_us(started) as started, epoch_us(ended) as ended, turns from a where ended + interval 30 minute <= (select max(ts) from events) - interval 10 minute""")
def session_stream(t):
    closed = jobs.sessions(Streams(t).events.select("user_id", "ts"), "user_id", "ts", work_folder(t.spark, "sessions"))
    return closed.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "turns")


@query("str2_memory_stream", """
    select conv_id, count(*) as turns, arg_max(length(text), turn) filter (role = 'assistant') as remembered from conversations group by 1""")
def memory_stream(t):
    remembered = F.when(F.col("role") == "assistant", F.length("text").cast("long"))
    return jobs.session_memory(Streams(t).conversations, "conv_id", "turn", remembered, work_folder(t.spark, "memory"))


SLOT_ROWS = """select event_id, user_id as session_id, case when event_type in ('view', 'click') then 'age' else 'income_annual' end as slot, event_id as turn,
    case when value > 10 and event_type <> 'error' then event_type end as value, event_type = 'signup' as is_skip from events"""


def slot_replies(events):
    return events.select(
        F.col("user_id").alias("session_id"), F.when(F.col("event_type").isin("view", "click"), "age").otherwise("income_annual").alias("slot"),
        F.col("event_id").alias("turn"), F.when((F.col("value") > 10) & (F.col("event_type") != "error"), F.col("event_type")).alias("value"),
        (F.col("event_type") == "signup").alias("is_skip"))


SLOT_SQL = f"""
    with r as ({SLOT_ROWS}), f as (select session_id, slot, min(turn) filter (value is not null and not is_skip) as ft, arg_min(value, turn) filter (value is not null and not is_skip) as value,
        bool_or(is_skip) as skip from r group by 1, 2),
    c as (select r.session_id, r.slot, least(count(*), 3) as failures from r join f using (session_id, slot) where not is_skip and r.value is null and (ft is null or turn < ft) group by 1, 2)
    select session_id, slot, value, coalesce(failures, 0) as failures, skip or coalesce(failures, 0) >= 3 as skipped from f left join c using (session_id, slot)"""


@query("str3_slot_dialogue", SLOT_SQL)
def slot_dialogue(t):
    return dialogue.slot_outcomes(slot_replies(t.events))


@query("str3_slot_dialogue_stream", SLOT_SQL)
def slot_dialogue_stream(t):
    return jobs.slot_dialogue(slot_replies(Streams(t).events), work_folder(t.spark, "slots"))


@query("str4_arrivals", """select case when n_chars >= 500 and lang <> 'de' then 'valid' else 'rejected' end as outcome, count(*) as documents, cast(sum(n_chars) as bigint) as chars from documents group by 1""")
def arrival_stream(t):
    good, bad = jobs.arrivals(Streams(t).documents, (F.col("n_chars") >= 500) & (F.col("lang") != "de"), work_folder(t.spark, "arrivals"))
    both = good.withColumn("outcome", F.lit("valid")).unionByName(bad.withColumn("outcome", F.lit("rejected")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query("str5_index_upkeep", f"with {CHUNKS} select chunk_id, sha256(text) as digest, section from ch")
def index_stream(t):
    kept = jobs.index_upkeep(schemes(Streams(t)), work_folder(t.spark, "index"))
    return kept.select("chunk_id", F.sha2("text", 256).alias("digest"), "section")


@query("str6_feedback_stream", """
    select user_id, hour(ts) as hour, epoch_us(min(ts)) as created_at, epoch_us(max(ts)) as updated_at, arg_max(event_type, ts) as rating from events group by 1, 2""")
def feedback_stream(t):
    rows = Streams(t).events.select("user_id", F.hour("ts").cast("long").alias("hour"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("rating"))
    return jobs.feedback(rows, ["user_id", "hour"], "rating", "at", work_folder(t.spark, "feedback"))


@query("str7_answer_reuse", """
    with recursive s(user_id, event_type, st) as (
      select user_id, event_type, min(ts) from events group by 1, 2
      union all
      select s.user_id, s.event_type, min(e.ts) from s join events e on e.user_id = s.user_id and e.event_type = s.event_type and e.ts >= s.st + interval 24 hour group by s.user_id, s.event_type, s.st)
    select user_id, event_type, epoch_us(st) as start from s""")
def answer_reuse(t):
    asked = t.events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return dialogue.answer_starts(asked, ["user_id", "event_type"], "ts")


REUSED = """
    g as (select *, event_id % 4 <> 0 as grounded from events),
    s(user_id, event_type, st) as (
      select user_id, event_type, min(ts) from g where grounded group by 1, 2
      union all
      select s.user_id, s.event_type, min(e.ts) from s join g e on e.grounded and e.user_id = s.user_id and e.event_type = s.event_type and e.ts >= s.st + interval 24 hour group by s.user_id, s.event_type, s.st),
    b as (select s.user_id, s.event_type, st, min(event_id) as first_id from s join g on grounded and g.ts = st and g.user_id = s.user_id and g.event_type = s.event_type group by 1, 2, 3),
    r as (select event_id as turn, exists(select 1 from b where b.user_id = g.user_id and b.event_type = g.event_type and (b.st < g.ts or (b.st = g.ts and b.first_id < g.event_id))
      and g.ts < b.st + interval 24 hour) as reused, ts from g)"""


def questions(events):
    """Questions of a user and kind; three of four answers are grounded."""
    return events.select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("turn"),
                         (F.col("event_id") % 4 != 0).alias("grounded"))


@query("str7_grounded_reuse", f"with recursive {REUSED} select turn, reused from r")
def grounded_reuse(t):
    return dialogue.answer_reuse(questions(t.events), ["key"], "ts", F.col("grounded")).select("turn", "reused")


@query("str7_grounded_reuse_stream", f"with recursive {REUSED} select turn, reused from r where epoch_ms(ts) < (select epoch_ms(max(ts)) from events) - 600000")
def grounded_reuse_stream(t):
    from docweave.streaming.sessions import reuse_stream

    return reuse_stream(questions(Streams(t).events), work_folder(t.spark, "reuse")).select("turn", "reused")
