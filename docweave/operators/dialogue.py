"""Session state over tables of turns: sessions, remembered values, cache state, turn routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docweave import fixed
from docweave.functions import rules, text as tx
from docweave.operators.ordering import TARGET_ROWS, as_number, cut_pieces, lookup_join, ordered_scan, scan_pieces
from docweave.streaming.files import stored


def session_numbers(turns: DataFrame, keys: list[str], order: list[str], gap_seconds: int = fixed.SESSION_GAP_SECONDS,
                    target_rows: int = TARGET_ROWS) -> DataFrame:
    """Number sessions per key; a pause of more than the gap starts a new one."""
    at = as_number(turns, order[0])
    timed = scan_pieces(cut_pieces(turns, keys, order, target_rows), keys, order, None, {"_prev": at})
    starts = F.when(F.col("_prev").isNull() | (at - F.col("_prev") > gap_seconds * 1_000_000), 1).otherwise(0)
    return scan_pieces(timed, keys, order, {"session_no": starts}).drop("_prev", "_piece", "_hot")


def carry_profile(turns: DataFrame, keys: list[str], order: list[str], fields: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Profile after each turn: stated values overwrite, missing ones keep what was known."""
    known = ordered_scan(turns, keys, order, None, {f"_{f}": F.col(f) for f in fields}, target_rows)
    for f in fields:
        known = known.withColumn(f, F.coalesce(F.col(f), F.col(f"_{f}"))).drop(f"_{f}")
    return known


def cache_state(entries: DataFrame, key: list[str], now: Column, ttl: int = fixed.CACHE_TTL_SECONDS, most: int = fixed.CACHE_ENTRIES) -> DataFrame:
    """Entries a bounded cache holds at ``now``: latest per key (of equal times the greatest value), younger than the
    TTL, newest first."""
    latest = entries.groupBy(*key).agg(F.max("t").alias("t"), F.max_by("v", F.struct("t", "v")).alias("v"))
    fresh = latest.filter(F.unix_micros("t") > F.unix_micros(now) - ttl * 1_000_000)
    return fresh.orderBy(F.desc("t"), *key).limit(most)


def turn_route(message: Column, session: Column, classified: Column | None = None, native: Column | None = None,
               named: Column | None = None, cached: Column | None = None, untranslated: Column | None = None) -> Column:
    """Where a turn goes: the first of the stops below that takes it.

    ``session``: struct of asked_slot, awaiting_topic, last_intent, was_question and remembered (number of schemes
    cited last). ``classified`` is the message as the English rules see it, ``native`` the intent record of the
    untranslated one, ``named`` whether a known scheme is named, ``cached`` whether a stored answer exists and
    ``untranslated`` whether the translation failed; all default to what an English first turn has.
    """
    no = F.lit(False)
    classified = message if classified is None else classified
    named, cached, untranslated = (no if c is None else F.coalesce(c, no) for c in (named, cached, untranslated))
    pending = session["asked_slot"].isNotNull()

    def after(understood: Column) -> Column:
        topic = pending & F.coalesce(understood["topic_only"], no)  # only an answer to the question, not a search
        kind = F.when(topic, F.lit("unknown")).otherwise(understood["intent"])
        going_on = (session["last_intent"] == "eligibility_check") & F.coalesce(session["was_question"], no)
        remembered = F.coalesce(session["remembered"], F.lit(0).cast("long"))
        asks = ~pending & kind.isin("scheme_search", "unknown")
        return (
            F.when(pending & rules.topic_change(classified).isNotNull(), F.lit("topic_change"))
            .when(kind == "eligibility_check", F.lit("eligibility_check"))
            .when(pending & kind.isin("unknown", "out_of_scope"), F.lit("slot_reply"))
            .when(going_on, F.lit("eligibility_continued"))
            .when(asks & rules.is_followup(classified, remembered, named), F.lit("followup"))
            .when(asks & (kind == "scheme_search") & named, F.lit("named_scheme"))
            .when(kind == "unknown", F.lit("understand"))
            .otherwise(kind))

    search = F.struct(F.lit("scheme_search").alias("intent"), F.lit(0.8).alias("confidence"), no.alias("topic_only"))
    understood = F.when(untranslated, search).otherwise(rules.intent(classified, named))
    if native is not None:
        understood = F.when(native["intent"].isin("out_of_scope", "unknown") | native.isNull(), understood).otherwise(native)
    return (
        F.when(F.length(message) > fixed.MAX_MESSAGE_CHARS, F.lit("too_long"))
        .when(tx.has_injection(message), F.lit("injection"))
        .when(F.coalesce(session["awaiting_topic"], no) & rules.topic_of_reply(message).isNotNull(), F.lit("topic_reply"))
        .when(~pending & rules.smalltalk(message).isNotNull(), F.lit("smalltalk"))
        .when(cached, F.lit("cached"))
        .otherwise(tx.let(understood, after)))


def slot_outcomes(replies: DataFrame) -> DataFrame:
    """Batch form of the slot dialogue: two aggregates and a lookup join, no per-session fold."""
    keys = ["session_id", "slot"]
    said = ~F.col("is_skip")
    read = said & F.col("value").isNotNull()
    first = replies.groupBy(*keys).agg(
        F.min(F.when(read, F.struct("turn", "value"))).alias("_first"), F.bool_or("is_skip").alias("_skip"))
    open_rows = lookup_join(replies, first, keys).filter(
        said & F.col("value").isNull() & (F.col("_first").isNull() | (F.col("turn") < F.col("_first.turn"))))
    failed = open_rows.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(fixed.MAX_SLOT_FAILURES)).alias("failures"))
    joined = lookup_join(first, failed, keys, "left").withColumn("failures", F.coalesce("failures", F.lit(0)).cast("long"))
    return joined.select(*keys, F.col("_first.value").alias("value"), "failures",
                         (F.col("_skip") | (F.col("failures") >= fixed.MAX_SLOT_FAILURES)).alias("skipped"))


def successors(times: DataFrame, keys: list[str], step: int, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``keys``, t and next: the first time of the key that is at least ``step`` later (null: none).

    ``times`` has distinct (keys, t). Times and the times asked for are one table, scanned backwards.
    """
    asked = times.select(*keys, (F.col("t") + step).alias("_at"), F.col("t").alias("_of"), F.lit(0).alias("_event"))
    both = times.select(*keys, F.col("t").alias("_at"), F.lit(None).cast("long").alias("_of"), F.lit(1).alias("_event")).unionByName(asked)
    both = both.withColumn("_back", -F.col("_at")).withColumn("_last", -F.col("_event"))
    seen = ordered_scan(both, keys, ["_back", "_last", "_of"], None, {"next": F.when(F.col("_event") == 1, F.col("_at"))}, target_rows)
    return seen.filter("_event = 0").select(*keys, F.col("_of").alias("t"), "next")


def answer_starts(asked: DataFrame, keys: list[str], at: str, ttl: int = fixed.CACHE_TTL_SECONDS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``keys`` and start (microseconds) of the questions whose answer was stored: later equal ones within the TTL reuse it.

    A hit does not renew an entry, so each start has one successor, the first question a TTL later. The chain of
    successors from a key's first question is marked by doubling: round r marks what lies 2**r starts after a marked
    one, and squares the pointers, so n starts of a key take log2(n) rounds however long the history is.
    """
    times = stored(asked.select(*keys, F.unix_micros(at).alias("t")).distinct(), "asked")
    marked = stored(times.groupBy(*keys).agg(F.min("t").alias("t")), "starts")
    pointers = stored(successors(times, keys, ttl * 1_000_000, target_rows).filter("next is not null"), "pointers")
    while not pointers.isEmpty():
        step = pointers.withColumnRenamed("next", "_to")
        found = lookup_join(marked, step, [*keys, "t"]).select(*keys, F.col("_to").alias("t"))
        if found.isEmpty():
            break
        marked = stored(marked.unionByName(found).distinct(), "starts")
        squared = lookup_join(pointers.withColumnsRenamed({"t": "_from", "next": "t"}), step, [*keys, "t"])
        pointers = stored(squared.select(*keys, F.col("_from").alias("t"), F.col("_to").alias("next")), "pointers")
    return marked.select(*keys, F.col("t").alias("start"))


def answer_reuse(asked: DataFrame, keys: list[str], at: str, grounded: Column, ttl: int = fixed.CACHE_TTL_SECONDS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``asked`` with reused: whether the answer stored for an earlier question of the key still lives.

    Only grounded answers are stored. Of several questions at the time of a start, the first by the other columns
    ``turn`` of ``asked`` is answered; the others reuse its answer if it was grounded.
    """
    starts = answer_starts(asked.filter(F.coalesce(grounded, F.lit(False))), keys, at, ttl, target_rows)
    rows = asked.withColumns({"_t": F.unix_micros(at), "_good": F.coalesce(grounded, F.lit(False))})
    first = lookup_join(rows.filter("_good"), starts.withColumnRenamed("start", "_t"), [*keys, "_t"]).groupBy(*keys, "_t").agg(F.min("turn").alias("turn"))
    entries = first.select(*keys, "_t", "turn", F.lit(False).alias("_asks"))
    both = rows.withColumn("_asks", F.lit(True)).unionByName(entries, allowMissingColumns=True)
    seen = ordered_scan(both, keys, ["_t", "turn", "_asks"], None, {"_start": F.when(~F.col("_asks"), F.struct(F.col("_t").alias("t"), F.col("turn").alias("turn")))}, target_rows)
    live = (F.col("_start.turn") != F.col("turn")) | (F.col("_start.t") != F.col("_t"))
    reused = F.coalesce(live & (F.col("_t") < F.col("_start.t") + ttl * 1_000_000), F.lit(False))
    return seen.filter("_asks").withColumn("reused", reused).select(*asked.columns, "reused")
