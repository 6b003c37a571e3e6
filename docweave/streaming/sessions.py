"""The dialogue as a stream: sessions that expire, remember what was cited and said last, and wait for fields; and the
reuse of stored answers, which live for a day and are stored only when they are grounded.

Rows are folded in the order of their event time (``docweave.streaming.ordered``). State per key is bounded: a place in
the state machine, five names, six turns or one stored answer, and the rows of the lateness window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docweave import fixed
from docweave.operators.ordering import TARGET_ROWS, cut_pieces, lookup_join, scan_pieces, trailing_rows
from docweave.operators.transitions import scan_transitions
from docweave.operators.turns import ACTIONS, SLOTS, START, STATES, turn_step
from docweave.streaming.files import run_append, stored
from docweave.streaming.ordered import fold_in_event_order

HISTORY = 6
TOLD = ("started long, turn long, turn_no long, action string, slot string, failures_n long, remembered string, recent string, "
        "last_intent string, was_question boolean")
NEW = [None, None, START, 0, [], [], None, None]
MICROS = 1_000_000


def _session(gap: int):
    def fold(state: list, row: dict) -> tuple[list, tuple]:
        """The session after one turn, and what is known at that turn; a turn beyond the gap opens a session."""
        started, last, place, turns, cited, said, intent, question = state
        if last is None or row["at"] - last > gap * MICROS:
            started, last, place, turns, cited, said, intent, question = row["at"], *NEW[1:]
        after, (action, asked, failures, _, _) = turn_step(row["code"], place)
        known = (started, row["turn"], turns + 1, ACTIONS[action], SLOTS[asked] if asked >= 0 else None, failures if asked >= 0 else None,
                 ",".join(cited), ",".join(said), intent, question)
        cited = row["cited"].split(",")[: fixed.MAX_REMEMBERED] if row["cited"] else cited
        return [started, row["at"], after, turns + 1, cited, [*said, row["said"]][-HISTORY:], row["intent"], row["question"]], known

    return fold


def dialogue_stream(turns: DataFrame, folder: str, gap_seconds: int = fixed.SESSION_GAP_SECONDS, late: str = "10 minutes") -> DataFrame:
    """What is known and done at each turn, as a table that only grows.

    ``turns``: key, ts, turn (orders equal times), code (``read_turns``), cited (names in the answer, or null), said,
    intent and question of the answer. Rows later than the watermark are dropped; turns that the watermark has not
    passed are still held back when the available data ends.
    """
    rows = turns.select(F.col("key").cast("string").alias("key"), "ts", "turn", "code", F.array_join("cited", ",").alias("cited"), "said", "intent", "question")
    told = fold_in_event_order(rows, late, _session(gap_seconds), NEW, lambda s: None if s[1] is None else s[1] + gap_seconds * MICROS, TOLD)
    return run_append(told, folder).withColumn("started", F.timestamp_micros("started")).withColumn("failures", F.col("failures_n").cast("int")).drop("failures_n")


def reuse_stream(asked: DataFrame, folder: str, ttl_seconds: int = fixed.CACHE_TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """turn and reused of every question (key, ts, turn, grounded), as in ``answer_reuse``, once the watermark has passed it."""

    def fold(state: list, row: dict) -> tuple[list, tuple]:
        start, = state
        if start is not None and row["at"] < start + ttl_seconds * MICROS:
            return state, (row["turn"], True)
        return [row["at"] if row["grounded"] else None], (row["turn"], False)

    rows = asked.select(F.col("key").cast("string").alias("key"), "ts", "turn", "grounded")
    told = fold_in_event_order(rows, late, fold, [None], lambda s: None if s[0] is None else s[0] + ttl_seconds * MICROS, "turn long, reused boolean")
    return run_append(told, folder)


def dialogue_sessions(turns: DataFrame, gap_seconds: int = fixed.SESSION_GAP_SECONDS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The batch form of ``dialogue_stream`` over all turns: ordered scans, cut for hot keys."""
    order, keys = ["ts", "turn"], ["key", "session"]
    rows = turns.withColumns({"key": F.col("key").cast("string"), "ts": F.col("ts").cast("timestamp")})
    timed = scan_pieces(cut_pieces(rows, ["key"], order, target_rows), ["key"], order, None, {"_before": F.unix_micros("ts")})
    opens = F.col("_before").isNull() | (F.unix_micros("ts") - F.col("_before") > gap_seconds * MICROS)
    numbered = scan_pieces(timed, ["key"], order, {"session": opens.cast("long")}).drop("_before", "_piece", "_hot")
    numbered = stored(numbered, "sessions")
    kept = F.when(F.size("cited") > 0, F.slice("cited", 1, fixed.MAX_REMEMBERED))
    recent = stored(trailing_rows(numbered, keys, order, F.col("said"), HISTORY, "recent", target_rows), "recent")
    cut = cut_pieces(recent, keys, order, target_rows)
    known = scan_pieces(cut, keys, order, {"turn_no": F.lit(1)}, {"remembered": kept, "last_intent": F.struct("intent"), "was_question": F.struct("question")})
    moved = scan_transitions(known, keys, order, F.col("code"), turn_step, len(STATES), START, ["action", "asked", "failures", "read_slot", "query"])
    moved = lookup_join(moved, numbered.groupBy(*keys).agg(F.min("ts").alias("started")), keys)
    asks = F.col("asked") >= 0
    return moved.select(
        "key", "started", "turn", F.col("turn_no").cast("long").alias("turn_no"), F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action") + 1).alias("action"),
        F.when(asks, F.element_at(F.array(*[F.lit(s) for s in SLOTS]), F.col("asked") + 1)).alias("slot"), F.when(asks, F.col("failures")).alias("failures"),
        F.coalesce(F.array_join("remembered", ","), F.lit("")).alias("remembered"), F.array_join("recent", ",").alias("recent"),
        F.col("last_intent.intent").alias("last_intent"), F.col("was_question.question").alias("was_question"))
