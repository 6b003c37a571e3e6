"""The eligibility dialogue: what the assistant does at each turn, given all turns of the session before it.

A turn is read once into a code of yes-or-no facts (what it asks, which fields it states, which slots it could answer),
which no state can change. The state of a session is small: the fields known, the fields skipped before the one that is
asked, how often that one was answered unreadably, whether the stored question names a topic, and whether the assistant
waits for a field, for a topic, or for nothing. ``docweave.operators.transitions`` moves the states over the codes.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from docweave import fixed
from docweave.functions import rules, text as tx
from docweave.operators.ordering import TARGET_ROWS, cut_pieces, scan_pieces
from docweave.operators.transitions import scan_transitions

SLOTS = fixed.SLOTS
ALL = (1 << len(SLOTS)) - 1
IDLE, TOPIC, SLOT = "idle", "topic", "slot"  # what the assistant waits for

KINDS = ["eligibility_check", "unknown", "out_of_scope", "other"]
FACTS = ["stopped", "names_topic", "smalltalk", "cached", "topic_only", "changes_topic", "skips", "topical", "change_topical", "hinted"]
ACTIONS = ["stopped", "other", "smalltalk", "cached", "ask_slot", "ask_topic", "answer_query", "answer_hint", "answer_topic"]
QUERIES = ["kept", "message", "change"]
EMITTED = ["action", "asked", "failures", "read_slot", "query"]


def _first_open(closed: int) -> int | None:
    return next((i for i in range(len(SLOTS)) if not closed >> i & 1), None)


def _all_states() -> list[tuple]:
    """(waits for, fields known, fields skipped, unreadable answers, stored question names a topic)."""
    quiet = [(mode, known, 0, 0, False) for mode in (IDLE, TOPIC) for known in range(ALL + 1)]
    asking = [(SLOT, known, skipped, failures, topical) for known, skipped in product(range(ALL + 1), repeat=2) for failures in range(fixed.MAX_SLOT_FAILURES)
              for topical in (False, True) if not known & skipped and (known | skipped) != ALL and skipped < 1 << _first_open(known | skipped)]
    return quiet + asking


STATES = _all_states()
PLACES = {s: i for i, s in enumerate(STATES)}
START = PLACES[IDLE, 0, 0, 0, False]


def turn_code(kind: Column, facts: dict[str, Column], states_field: dict[str, Column], answers: dict[str, Column]) -> Column:
    """The facts of a turn in one whole number: ``KINDS``, ``FACTS``, fields stated and slots that it could answer."""
    number = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind) - 1, F.lit(1)).cast("bigint")
    bits = [*[facts[f] for f in FACTS], *[states_field[s] for s in SLOTS], *[answers[s] for s in SLOTS]]
    for at, bit in enumerate(bits, 2):
        number = number + F.when(bit, F.lit(1 << at)).otherwise(F.lit(0)).cast("bigint")
    return number


def turn_step(code: int, place: int) -> tuple[int, tuple[int, ...]]:
    """The next state and (action, slot asked for, its unreadable answers, slot read from the reply, stored question)."""
    mode, known, skipped, failures, topical = STATES[place]
    kind = KINDS[code & 3]
    fact = {name: bool(code >> i & 1) for i, name in enumerate(FACTS, 2)}
    stated, answers = code >> 2 + len(FACTS) & ALL, code >> 2 + len(FACTS) + len(SLOTS) & ALL
    if mode == TOPIC:
        skipped = ALL & ~known
    asked = _first_open(known | skipped) if mode == SLOT else None

    def quiet(action: str, mode: str = IDLE, query: str = "kept", read: int = -1):
        return PLACES[mode, known, 0, 0, False], (ACTIONS.index(action), -1, 0, read, QUERIES.index(query))

    if fact["stopped"]:
        return place, (ACTIONS.index("stopped"), -1, 0, -1, 0)
    if mode == TOPIC and fact["names_topic"]:
        return quiet("answer_topic")
    if mode != SLOT and fact["smalltalk"]:
        return quiet("smalltalk")
    known |= stated
    if mode == IDLE and fact["cached"]:
        return quiet("cached")
    going_on = mode == TOPIC or mode == SLOT and failures == 0  # the last answer was a question of this dialogue
    query, read = "kept", -1
    kind = "unknown" if mode == SLOT and fact["topic_only"] else kind
    if mode == SLOT and fact["changes_topic"]:
        kind, topical, query = "eligibility_check", fact["change_topical"], "change"
    elif mode == SLOT and kind in ("unknown", "out_of_scope"):
        if fact["skips"]:
            skipped |= 1 << asked
        elif answers >> asked & 1:
            known, read = known | 1 << asked, asked
        elif not known >> asked & 1:
            failures += 1
            skipped |= (failures >= fixed.MAX_SLOT_FAILURES) << asked
        kind = "eligibility_check"
    elif kind == "eligibility_check":
        topical, query, failures, skipped = fact["topical"], "message", 0, skipped if mode == SLOT else 0
    elif going_on:
        kind = "eligibility_check"
        if mode == TOPIC:
            topical, query = fact["topical"], "message"
    if kind != "eligibility_check":
        return quiet("other", read=read)
    slot = _first_open(known | skipped)
    if slot is not None:
        failures = failures if slot == asked else 0
        state = SLOT, known, skipped & ~known, failures, topical
        return PLACES[state], (ACTIONS.index("ask_slot"), slot, failures, read, QUERIES.index(query))
    if topical:
        return quiet("answer_query", query=query, read=read)
    return quiet("answer_hint", query=query, read=read) if fact["hinted"] else quiet("ask_topic", TOPIC, query, read)


def read_turns(turns: DataFrame, message: str, hint: Column | None = None, cached: Column | None = None, named: Column | None = None) -> DataFrame:
    """``turns`` with _code, the fields they state, how they would answer each slot, and the topics they name.

    ``hint`` is the topic that the session's profile implies, ``cached`` whether an answer is stored for the message.
    """
    text, no = F.coalesce(F.col(message), F.lit("")), F.lit(False)
    hint, cached = F.lit(None).cast("string") if hint is None else hint, no if cached is None else F.coalesce(cached, no)
    long = F.length(text) > fixed.MAX_MESSAGE_CHARS
    heard = F.when(long, F.lit("")).otherwise(text)
    said = turns.withColumn("_heard", heard).withColumns({
        "_intent": rules.intent(F.col("_heard"), named), "_said": rules.entities(F.col("_heard")), "_change": rules.topic_change(F.col("_heard")),
        "_topic": rules.topic_of_reply(F.col("_heard")), "_hint": hint,
        **{f"_as_{s}": rules.slot_reply(F.lit(s), F.col("_heard")) for s in SLOTS}})
    stated = {"age": "_said.age", "state": "_said.state", "income_annual": "_said.income", "category": "_said.category", "gender": "_said.gender"}
    facts = {
        "stopped": long | tx.has_injection(text), "names_topic": F.col("_topic").isNotNull(), "smalltalk": rules.smalltalk(F.col("_heard")).isNotNull(),
        "cached": cached, "topic_only": F.col("_intent.topic_only"), "changes_topic": F.col("_change").isNotNull(), "skips": rules.is_skip(F.col("_heard")),
        "topical": rules.has_topic(F.col("_heard")), "change_topical": rules.has_topic(F.coalesce("_change", F.lit(""))), "hinted": F.col("_hint").isNotNull()}
    kind = F.when(F.col("_intent.intent").isin(*KINDS[:3]), F.col("_intent.intent")).otherwise(F.lit("other"))
    code = turn_code(kind, facts, {s: F.col(c).isNotNull() for s, c in stated.items()}, {s: F.col(f"_as_{s}").isNotNull() for s in SLOTS})
    return said.withColumn("_code", code).withColumns({f"_is_{s}": F.col(c).cast("string") for s, c in stated.items()}).drop("_intent", "_said")


def eligibility_turns(turns: DataFrame, keys: list[str], order: list[str], message: str, hint: Column | None = None, cached: Column | None = None,
                      named: Column | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``keys``, ``order`` and what happens at each turn: action (of ``ACTIONS``), slot asked for and failures (unreadable
    answers to it so far), query (the question that is being answered), topic, wants_not, and the profile's fields as text.

    Null messages are empty ones; turns of a null key are a session of their own. A field stated in a message is known
    before the reply is read, and stays known. A question stays stored until it is answered or another replaces it.
    """
    dealt = turns.repartition(*keys, *[c for c in order if c not in keys])  # reading a turn takes far longer than moving it
    rows = read_turns(dealt, message, hint, cached, named).select(*keys, *[c for c in order if c not in keys], "_code", "_heard", "_change", "_topic", "_hint", *[f"_is_{s}" for s in SLOTS], *[f"_as_{s}" for s in SLOTS])
    moved = scan_transitions(cut_pieces(rows, keys, order, target_rows), keys, order, F.col("_code"), turn_step, len(STATES), START, EMITTED)
    action = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action") + 1)
    heeded = ~action.isin("stopped", "smalltalk", "answer_topic")
    own = {s: F.coalesce(F.when(F.col("read_slot") == i, F.col(f"_as_{s}")), F.when(heeded, F.col(f"_is_{s}"))) for i, s in enumerate(SLOTS)}
    query = F.when(F.col("query") == 1, F.col("_heard")).when(F.col("query") == 2, F.col("_change"))
    moved = moved.withColumns({"_action": action, "_query": query, **{f"_own_{s}": v for s, v in own.items()}})
    carried = scan_pieces(moved, keys, order, None, {"_q": F.col("_query"), **{f"_p_{s}": F.col(f"_own_{s}") for s in SLOTS}})
    asks = F.col("_action").isin("ask_slot", "ask_topic", "answer_query", "answer_hint")
    stored = F.when(asks, F.coalesce("_query", "_q"))
    topic = F.when(F.col("_action") == "answer_topic", F.col("_topic")).when(F.col("_action") == "answer_hint", F.col("_hint"))
    slot = F.when(F.col("asked") >= 0, F.element_at(F.array(*[F.lit(s) for s in SLOTS]), F.col("asked") + 1))
    return carried.select(
        *keys, *[c for c in order if c not in keys], F.col("_action").alias("action"), slot.alias("slot"), F.when(slot.isNotNull(), F.col("failures")).alias("failures"),
        stored.alias("query"), topic.alias("topic"),
        (F.coalesce(rules.wants_not_eligible(stored), F.lit(False)) | rules.wants_not_eligible(F.col("_heard"))).alias("wants_not"),
        *[F.coalesce(f"_own_{s}", f"_p_{s}").alias(s) for s in SLOTS])


def turn_answers(turns: DataFrame, keys: list[str], candidates: DataFrame) -> DataFrame:
    """Candidates found, shown and confidence of each answered turn.

    ``candidates`` has ``keys``, scheme_id and the status of each candidate ("eligible", "may" or "not"). Without
    candidates the confidence is low; it is high when everything shown is eligible. Refused schemes are shown when they
    are asked for or nothing else was found.
    """
    counts = candidates.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(f"_{s}") for s in ("eligible", "may", "not")])
    answered = turns.filter(F.startswith("action", F.lit("answer_"))).join(counts, keys, "left").na.fill(0, ["_eligible", "_may", "_not"])
    good, every = F.col("_eligible") + F.col("_may"), F.col("_eligible") + F.col("_may") + F.col("_not")
    listed = F.when(F.col("wants_not") | (good == 0), every).otherwise(good)
    shown = F.least(listed, F.lit(fixed.MAX_SCHEMES_SHOWN)).cast("long")
    sure = F.when(every == 0, "low").when(F.col("_eligible") >= shown, "high").otherwise("medium")
    return answered.withColumns({"found": every, "shown": shown, "confidence": sure}).drop("_eligible", "_may", "_not")
