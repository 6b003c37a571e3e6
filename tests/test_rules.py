import pytest
from pyspark.sql import functions as F

from docweave.functions import rules


@pytest.mark.parametrize("text, intent", [
    ("What is the weather today", "out_of_scope"), ("Am I eligible for PM-KISAN?", "eligibility_check"),
    ("I want to upload my income certificate", "document_upload"), ("Compare PM-KISAN vs PMAY", "comparison"),
    ("What is the Annal Scheme?", "scheme_search"), ("who can apply for this", "scheme_search"), ("कौन आवेदन कर सकता है", "scheme_search"),
    ("मैं पात्र हूँ", "eligibility_check"), ("पात्रता", "scheme_search"), ("kisan yojana ke baare mein batao", "scheme_search"),
    ("aaj mausam kya hai", "out_of_scope"), ("mujhe kuch batao", "unknown"), ("asdkjaslkdj random text", "unknown"),
    ("வானிலை", "out_of_scope"), ("விவசாயி", "scheme_search"),
])
def test_intents(value, text, intent):
    assert value(rules.intent, text)["intent"] == intent


@pytest.mark.parametrize("text, expected", [
    ("namaste", ("greeting", "hi")), ("vanakkam", ("greeting", "ta")), ("shukriya", ("thanks", "hi")), ("Thank you!", ("thanks", None)),
    ("Good morning", ("greeting", None)), ("hi what schemes are there for farmers", None), ("you", None),
])
def test_smalltalk(value, text, expected):
    got = value(rules.smalltalk, text)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("text, count, named, follow, place", [
    ("who can apply for it?", 2, False, True, None), ("documents needed", 2, False, True, None), ("second one", 2, False, True, 1),
    ("last one", 2, False, True, 1), ("who can apply for it?", 0, False, False, None), ("who can apply for it?", 2, True, False, None),
    ("documents required for farmers", 2, False, False, None), ("third scheme", 2, False, False, None),
])
def test_followups(value, text, count, named, follow, place):
    assert value(lambda c: rules.is_followup(c, F.lit(count), F.lit(named)), text) == follow
    assert value(lambda c: rules.ordinal_index(c, F.lit(count)), text) == place


@pytest.mark.parametrize("slot, text, expected", [
    ("category", "general", "general"), ("category", "GEN", "general"), ("category", "Scheduled Caste", "sc"), ("category", "other backward", "obc"),
    ("category", "banana", None), ("state", "Tamil Nadu", "Tamil Nadu"), ("state", "Orissa", "Odisha"), ("age", "30", "30"), ("age", "130", None),
    ("income_annual", "1.2 lakhs", "120000.0"), ("income_annual", "1,20,000", "120000.0"), ("income_annual", "120000", "120000.0"),
    ("income_annual", "30", None), ("gender", "female", "female"), ("state", "tn please", "Tamil Nadu"),
])
def test_slot_replies(value, slot, text, expected):
    assert value(lambda c: rules.slot_reply(F.lit(slot), c), text) == expected


def test_entities(value):
    got = value(rules.entities, "I am 30 years old, SC category, income of 1.5 lakhs, from Tamil Nadu")
    assert (got["age"], got["category"], got["income"], got["state"]) == (30, "sc", 150000.0, "Tamil Nadu")
    assert value(rules.entities, "income is , but earn 2 lakh")["income"] == 200000.0


def test_states_are_whole_words(value):
    assert value(rules.states_in, "Goal Oriented Scheme") == []
    assert value(rules.states_in, "TAMIL NADU and Kerala, tamil nadu") == ["Tamil Nadu", "Kerala"]
    assert value(rules.search_filters, "a goal")["state"] == "Goa"


@pytest.mark.parametrize("patch, good", [
    ("", True), ('"extra":1,', False), ('"language":"fr",', False),
])
def test_strict_response(value, patch, good):
    language = "" if "language" in patch else '"language":"en",'
    raw = '{' + patch + language + '"intent":"eligibility","rewritten_query_en":"q","profile_slots":{"age":30,"state":"mars"}}'
    got = value(rules.understanding, raw)
    assert (got is not None) == good
    if good:
        assert got["slots"]["age"] == 30 and got["slots"]["state"] is None


@pytest.mark.parametrize("slots", ['{"age":500}', '{"weight":1}', '{"age":1.5}', '{"age":"old"}', '{"category":"x"}'])
def test_bad_slots_reject(value, slots):
    assert value(rules.understanding, '{"intent":"clarify","rewritten_query_en":"q","language":"en","profile_slots":' + slots + "}") is None


def test_topics(value):
    assert value(rules.topic_of_reply, "खेती") == "agriculture"
    assert value(rules.topic_change, "actually, for education?") == "schemes for education"
    assert value(rules.has_topic, "Am I eligible for any scheme?") is False
    assert value(rules.wants_not_eligible, "which ones am I not eligible for") is True
