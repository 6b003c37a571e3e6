"""Routing rules as column expressions: filters, entities, intents, follow-ups, slot replies, topics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docweave import fixed
from docweave.functions import text as tx
from docweave.functions.text import any_of, first_contained, first_label, let, nocase


def matches(col: Column, patterns: list[str]) -> Column:
    """Any pattern of a group occurs: one alternation, one pass."""
    return F.rlike(col, F.lit(any_of(patterns)))


def _found(col: Column, pattern: str) -> Column:
    return F.rlike(col, F.lit(nocase(pattern)))


def search_filters(col: Column, states: list[str] | None = None) -> Column:
    return F.struct(
        first_contained(col, states or fixed.STATES).alias("state"),
        first_label(col, fixed.SEARCH_CATEGORIES).alias("category"),
        first_label(col, fixed.BENEFIT_TYPES).alias("benefit_type"))


def amount(number: Column, unit: Column, units: dict[str, int]) -> Column:
    """A number with thousands commas times its unit; null when nothing is left of the number."""
    factor = F.lit(1)
    for name, value in units.items():
        factor = F.when(F.lower(unit) == name, F.lit(value)).otherwise(factor)
    return F.nullif(F.trim(F.replace(number, F.lit(","), F.lit(""))), F.lit("")).try_cast("double") * factor


def entities(col: Column, states: list[str] | None = None) -> Column:
    """State, category, gender, age and income stated in a message."""
    ages = [F.nullif(F.regexp_extract(col, nocase(p), 1), F.lit("")).try_cast("int") for p in fixed.AGE_PHRASES]
    incomes = [amount(F.regexp_extract(col, nocase(p), 1), F.regexp_extract(col, nocase(p), 2), fixed.UNITS) for p in fixed.INCOME_PHRASES]
    return F.struct(
        first_contained(col, states or fixed.STATES).alias("state"), first_label(col, fixed.CATEGORIES).alias("category"),
        first_label(col, fixed.GENDERS).alias("gender"), F.coalesce(*ages).alias("age"), F.coalesce(*incomes).alias("income"))


def intent(col: Column, named: Column | None = None) -> Column:
    """Intent by the fixed rule order; ``named`` says whether a known scheme is mentioned."""
    named = F.lit(False) if named is None else named

    def outcome(label: str, confidence: float, topic: bool) -> Column:
        return F.struct(F.lit(label).alias("intent"), F.lit(confidence).alias("confidence"), F.lit(topic).alias("topic_only"))

    chosen = F.when(named, outcome("scheme_search", 0.8, False)).otherwise(outcome("unknown", 0.3, False))
    for patterns, label, confidence, topic in reversed(fixed.INTENT_ORDER):
        chosen = F.when(matches(col, patterns), outcome(label, confidence, topic)).otherwise(chosen)
    return chosen


def is_detail_request(col: Column) -> Column:
    return matches(col, fixed.DETAIL_PATTERNS) | matches(col, fixed.NATIVE_DETAIL_PATTERNS)


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def smalltalk(col: Column) -> Column:
    """{kind, language} when a message of at most five words is only greeting or thanks, else null."""

    def judge(words: Column) -> Column:
        def language(table: dict) -> Column:
            tagged = F.create_map(*[F.lit(x) for w, lang in table.items() if lang for x in (w, lang)])
            return F.get(F.filter(F.transform(words, lambda w: F.element_at(tagged, w)), lambda x: x.isNotNull()), F.lit(0))

        def all_in(table) -> Column:
            return F.forall(words, lambda w: F.array_contains(_texts(table), w))

        sized = (F.size(words) > 0) & (F.size(words) <= fixed.MAX_SMALLTALK_WORDS)
        thanks = F.exists(words, lambda w: F.array_contains(_texts(fixed.THANKS_CORE), w)) & all_in(fixed.THANKS)
        good = (F.size(words) == 2) & (F.get(words, F.lit(0)) == "good") & F.get(words, F.lit(1)).isin("morning", "afternoon", "evening")

        def result(kind: str, lang: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), lang.alias("language"))

        return F.when(sized, F.when(thanks, result("thanks", language(fixed.THANKS)))
                      .when(good, result("greeting", F.lit(None).cast("string")))
                      .when(all_in(fixed.GREETINGS), result("greeting", language(fixed.GREETINGS))))

    return let(F.transform(F.regexp_extract_all(col, F.lit(f"({fixed.SMALLTALK_WORD})"), F.lit(1)), lambda w: F.lower(w)), judge)


def ordinal_index(col: Column, count: Column) -> Column:
    """Zero-based place named by "the second one" or "the last scheme", if that many are remembered."""
    word = F.lower(F.regexp_extract(col, nocase(fixed.ORDINAL_PATTERN), 1))
    place = F.element_at(F.create_map(*[F.lit(x) for pair in fixed.ORDINALS.items() for x in pair]), word)
    return F.when(_found(col, fixed.LAST_PATTERN), F.when(count > 0, count - 1)).when(place < count, place).cast("long")


def is_followup(col: Column, remembered: Column, names_scheme: Column) -> Column:
    """The message asks about the schemes listed before rather than something new."""
    words = F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9]+)"), F.lit(1))
    only_filler = F.size(F.array_except(words, _texts(fixed.FILLER_WORDS))) == 0
    asks = _found(col, fixed.FOLLOWUP_PATTERN) & (_found(col, fixed.PRONOUN_PATTERN) | only_filler)
    return (remembered > 0) & ~names_scheme & (ordinal_index(col, remembered).isNotNull() | asks)


# --- slot dialogue --------------------------------------------------------------------------
def is_skip(col: Column) -> Column:
    return _found(col, fixed.SKIP_PATTERN)


def reply_age(col: Column) -> Column:
    value = F.nullif(F.regexp_extract(col, r"(?U)\b(\d{1,3})\b", 1), F.lit("")).try_cast("int")
    return F.when((value > 0) & (value <= 120), value)


def reply_state(col: Column) -> Column:
    names = fixed.STATES + [n for n, _ in fixed.STATE_ALIASES]
    aliases = [(n, "|".join(rf"(?<!\w){tx.literal(a)}(?!\w)" for a in listed)) for n, listed in fixed.STATE_ALIASES]
    return F.coalesce(first_contained(col, names), first_label(col, aliases))


def reply_income(col: Column) -> Column:
    pattern = nocase(fixed.SLOT_NUMBER)
    unit = F.regexp_extract(col, pattern, 2)
    value = amount(F.regexp_extract(col, pattern, 1), unit, fixed.SLOT_UNITS)
    return F.when((unit != "") | (value >= 1000), value)


def slot_reply(slot: Column, col: Column) -> Column:
    """The reply read as the asked slot, as text; null when it cannot be read."""
    return (
        F.when(slot == "age", reply_age(col).cast("string"))
        .when(slot == "state", reply_state(col))
        .when(slot == "income_annual", reply_income(col).cast("string"))
        .when(slot == "category", first_label(col, fixed.SLOT_CATEGORIES))
        .when(slot == "gender", first_label(col, fixed.SLOT_GENDERS)))


def next_slot(skipped: Column, **values: Column) -> Column:
    """The first empty profile field that was not skipped."""
    return F.coalesce(*[F.when(values[s].isNull() & ~F.array_contains(skipped, s), F.lit(s)) for s in fixed.SLOTS])


# --- topics ---------------------------------------------------------------------------------
def topic_hint(occupation: Column, is_student: Column) -> Column:
    hint = first_label(F.lower(F.coalesce(occupation, F.lit(""))), fixed.OCCUPATION_TOPICS)
    return F.coalesce(hint, F.when(is_student, F.lit("education")))


def topic_of_reply(col: Column) -> Column:
    return first_label(col, [(name, reply) for name, reply, _ in fixed.TOPICS])


def matches_topic(labels: Column, topic: Column) -> Column:
    hit = F.lit(False)
    for name, _, pattern in reversed(fixed.TOPICS):
        hit = F.when(topic == name, _found(labels, pattern)).otherwise(hit)
    return hit


def wants_not_eligible(col: Column) -> Column:
    return _found(col, fixed.NOT_ELIGIBLE_PATTERN) & _found(col, fixed.SHOW_PATTERN)


def topic_change(col: Column) -> Column:
    """The new topic query of "actually, for education", else null."""
    rest = F.regexp_replace(F.regexp_replace(col, nocase(fixed.LEADING_FILLER_PATTERN), ""), r"^[ ?.!]+|[ ?.!]+$", "")
    query = F.when(F.startswith(F.lower(rest), F.lit("for ")), F.concat(F.lit("schemes "), rest)).otherwise(rest)
    return F.when(_found(col, fixed.TOPIC_CHANGE_PATTERN), query)


def has_topic(col: Column) -> Column:
    words = F.regexp_extract_all(F.lower(col), F.lit("([a-z]+)"), F.lit(1))
    return tx.non_latin(col) | F.exists(words, lambda w: ~F.rlike(w, F.lit(f"^(?:{fixed.TOPICLESS_WORDS})$")))


def asks_to_qualify(col: Column) -> Column:
    return _found(col, fixed.QUALIFY_PATTERN)


def states_in(col: Column, states: list[str] | None = None) -> Column:
    """Distinct states named as whole words, in canonical spelling."""
    states = states or fixed.STATES
    hits = F.regexp_extract_all(col, F.lit(nocase(r"\b(" + "|".join(map(tx.literal, states)) + r")\b")), F.lit(1))
    names = F.create_map(*[F.lit(x) for s in states for x in (s.lower(), s)])
    return F.array_distinct(F.transform(hits, lambda h: F.element_at(names, F.lower(h))))


# --- model responses ------------------------------------------------------------------------
_SLOT_KEYS = ["age", "state", "category", "income", "gender"]
_KEYS = ["intent", "rewritten_query_en", "scheme_name", "profile_slots", "clarifying_question", "language"]


def understanding(raw: Column, states: list[str] | None = None) -> Column:
    """The strictly validated record of a model response, null when anything is out of contract.

    Unknown intent or language, extra keys, values out of range and over-long texts reject the record;
    an unknown state is only emptied.
    """
    ddl = ("intent string, rewritten_query_en string, scheme_name string, clarifying_question string, language string, "
           "profile_slots struct<age:double,state:string,category:string,income:double,gender:string>")

    def check(r: Column) -> Column:
        s = r["profile_slots"]
        keys = F.json_object_keys(raw)
        slot_keys = F.coalesce(F.json_object_keys(F.get_json_object(raw, "$.profile_slots")), F.array().cast("array<string>"))
        known = F.lit(None).cast("string")
        for name in reversed(states or fixed.STATES):
            known = F.when(F.lower(F.trim(s["state"])) == name.lower(), F.lit(name)).otherwise(known)
        raw_age = F.get_json_object(raw, "$.profile_slots.age")
        good = (
            (F.size(F.array_except(keys, _texts(_KEYS))) == 0) & (F.size(F.array_except(slot_keys, _texts(_SLOT_KEYS))) == 0)
            & r["intent"].isin(*[i for i in fixed.RESPONSE_INTENTS if i != "document_upload"]) & r["language"].isin(*fixed.LANGUAGES)
            & (F.length(r["rewritten_query_en"]) <= 2000) & (F.coalesce(F.length(r["scheme_name"]), F.lit(0)) <= 200)
            & (F.coalesce(F.length(r["clarifying_question"]), F.lit(0)) <= 500)
            & (raw_age.isNull() | (s["age"].between(0, 120) & (s["age"] == F.floor(s["age"]))))
            & F.coalesce(s["income"].between(0, 1e9), F.lit(True))
            & F.coalesce(s["category"].isin("sc", "st", "obc", "general"), F.lit(True))
            & F.coalesce(s["gender"].isin("male", "female", "other"), F.lit(True)))
        slots = F.struct(s["age"].cast("int").alias("age"), known.alias("state"), s["category"].alias("category"),
                         s["income"].alias("income"), s["gender"].alias("gender"))
        return F.when(good, F.struct(r["intent"].alias("intent"), r["rewritten_query_en"].alias("rewritten_query_en"),
                                     r["scheme_name"].alias("scheme_name"), r["clarifying_question"].alias("clarifying_question"),
                                     r["language"].alias("language"), slots.alias("slots")))

    return let(F.from_json(raw, ddl), check)


def route_response(record: Column, message: Column, name_matches: Column) -> Column:
    """What to do with a validated response: a direct reply, a refusal, the eligibility engine or a search."""
    query = tx.safe_text(record["rewritten_query_en"])
    slots = record["slots"]
    any_slot = F.coalesce(slots["age"].cast("string"), slots["state"], slots["category"], slots["income"].cast("string"), slots["gender"]).isNotNull()
    asks = asks_to_qualify(message) | asks_to_qualify(F.coalesce(query, F.lit("")))
    name = tx.safe_text(record["scheme_name"], 120)
    return (
        F.when(record.isNull(), F.lit("plain_search"))
        .when(record["intent"] == "smalltalk", F.when(_found(message, fixed.THANKS_PATTERN), F.lit("thanks")).otherwise(F.lit("greeting")))
        .when(record["intent"] == "clarify", F.lit("clarify"))
        .when(record["intent"] == "document_help", F.lit("document_upload"))
        .when((record["intent"] == "out_of_scope") | query.isNull(), F.lit("refuse"))
        .when((record["intent"] == "eligibility") | (any_slot & asks), F.lit("eligibility_check"))
        .when(name.isNotNull() & (name_matches == 0), F.lit("name_not_found"))
        .otherwise(F.lit("scheme_search")))
