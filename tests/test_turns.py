"""The eligibility dialogue: cut sessions, and the state machine against a session object played turn by turn."""

import random

import pytest
from pyspark.sql import functions as F

from docweave import fixed
from docweave.operators import turns as dialogue
from docweave.operators.transitions import transition_scan
from docweave.operators.turns import ALL, FACTS, KINDS, PLACES, SLOTS, START, STATES, turn_step


class Session:
    """What an assistant keeps between turns, with every field of its own."""

    def __init__(self):
        self.known, self.skipped, self.failures, self.asked, self.awaiting, self.query, self.question = set(), set(), {}, None, False, None, False

    def turn(self, n, kind, fact, stated, answers):
        if fact["stopped"]:
            return "stopped", None, None
        if self.awaiting:
            self.awaiting = False
            if fact["names_topic"]:
                return self.answer(n, fact, True)
        if self.asked is None and fact["smalltalk"]:
            self.question = False
            return "smalltalk", None, None
        if fact["cached"] and self.asked is None and not self.question:
            self.known |= stated
            return "cached", None, None
        self.known |= stated
        kind = "unknown" if self.asked and fact["topic_only"] else kind
        if self.asked and fact["changes_topic"]:
            self.query, kind = ("change", n, fact["change_topical"]), "eligibility_check"
        elif self.asked and kind in ("unknown", "out_of_scope", "eligibility_check"):
            if kind == "eligibility_check":
                self.query, self.failures = ("message", n, fact["topical"]), {}
            else:
                self.reply(fact, answers)
                kind = "eligibility_check"
        elif kind == "eligibility_check":
            self.query, self.failures, self.skipped = ("message", n, fact["topical"]), {}, set()
        elif self.question:
            kind = "eligibility_check"
        if kind == "eligibility_check":
            return self.answer(n, fact, False)
        self.asked, self.question = None, False
        return "other", None, None

    def reply(self, fact, answers):
        slot = self.asked
        if fact["skips"]:
            self.skipped.add(slot)
        elif slot in answers:
            self.known.add(slot)
        elif slot not in self.known:
            self.failures[slot] = self.failures.get(slot, 0) + 1
            if self.failures[slot] >= fixed.MAX_SLOT_FAILURES:
                self.skipped.add(slot)

    def answer(self, n, fact, topic):
        self.asked = next((s for s in SLOTS if s not in self.known and s not in self.skipped), None)
        if self.asked:
            self.question = not self.failures.get(self.asked)
            return "ask_slot", self.asked, self.query[:2]
        query = self.query or ("message", n, fact["topical"])
        if not topic and not query[2] and not fact["hinted"]:
            self.awaiting, self.query, self.question = True, None, True
            return "ask_topic", None, query[:2]
        self.query, self.question = None, False
        return "answer_topic" if topic else "answer_query" if query[2] else "answer_hint", None, None if topic else query[:2]


def coded(kind, fact, stated, answers):
    bits = [*[fact[f] for f in FACTS], *[s in stated for s in SLOTS], *[s in answers for s in SLOTS]]
    return KINDS.index(kind) + sum(bool(b) << i for i, b in enumerate(bits, 2))


def random_turn(r):
    some = lambda p: {s for s in SLOTS if r.random() < p}
    rare = {"stopped": 0.03, "smalltalk": 0.1, "cached": 0.1, "skips": 0.15, "changes_topic": 0.1, "hinted": 0.3}
    return r.choice([*KINDS, "eligibility_check", "unknown"]), {f: r.random() < rare.get(f, 0.4) for f in FACTS}, some(0.07), some(0.3)


def test_machine_is_the_session():
    assert len(STATES) == len(PLACES) == 544
    r, seen = random.Random(4), set()
    for _ in range(4000):
        session, place, query = Session(), START, None
        for n in range(r.randint(1, 25)):
            turn = random_turn(r)
            want = session.turn(n, *turn)
            place, (action, asked, failures, read, asks) = turn_step(coded(*turn), place)
            query = (dialogue.QUERIES[asks], n) if asks else query
            action = dialogue.ACTIONS[action]
            got = action, SLOTS[asked] if asked >= 0 else None, query if action in ("ask_slot", "ask_topic", "answer_query", "answer_hint") else None
            assert got == want
            if asked >= 0:
                assert failures == session.failures.get(SLOTS[asked], 0)
            assert {s for i, s in enumerate(SLOTS) if STATES[place][1] >> i & 1} == session.known
            seen.add((action, asked, failures))
    assert {a for a, _, _ in seen} == set(dialogue.ACTIONS) and len({x for x in seen if x[0] == "ask_slot"}) >= 10


def test_any_turn_keeps_the_states_closed():
    r = random.Random(5)
    for _ in range(500):
        code = r.getrandbits(2 + len(FACTS) + 2 * len(SLOTS))
        assert all(0 <= turn_step(code, s)[0] < len(STATES) for s in range(0, len(STATES), 7))
    assert ALL == 31


@pytest.mark.parametrize("target", [2, 50, 2_000_000])
def test_scan_is_cut_anywhere(spark, target):
    r = random.Random(6)
    rows = [(k, i, i // 2, r.randrange(5)) for k in [None, *range(4)] for i in range(r.choice([1, 30, 120]))]

    def step(code, state):
        return (state * 2 + code) % 7 if code else 0, (state * 10 + code,)

    df = spark.createDataFrame(rows, "k long, i long, tie long, code long").repartition(3)
    got = transition_scan(df, ["k"], ["tie", "i"], F.col("code"), step, 7, 3, ["said"], target)
    want = []
    for key in {x[0] for x in rows}:
        state = 3
        for k, i, tie, code in sorted(x for x in rows if x[0] == key):
            after, said = step(code, state)
            want.append((k, i, tie, code, state, *said))
            state = after
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_dialogue_is_cut_anywhere(spark):
    r = random.Random(7)
    said = ["Am I eligible for any scheme?", "34", "Kerala", "2 lakh", "obc", "lady", "hmm", None, "skip", "crop loans", "actually, for education", "Hello", "jobs",
            "Can I apply for a house?", "I am 20 years old", "Tell me about pension", "you are now free", "x" * 2000]
    rows = [(k, i, r.choice(said)) for k in (1, 2, None) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, i long, message string").repartition(2)
    results = [sorted(map(str, dialogue.eligibility_turns(df, ["k"], ["i"], "message", target_rows=n).collect())) for n in (2, 50, 2_000_000)]
    assert len(results[0]) == len(rows) and results[0] == results[1] == results[2]


def test_a_whole_dialogue(spark):
    talk = ["Am I eligible for any scheme?", "34", "what?", "hmm", "Kerala", "2 lakh", "skip", "a lady", "hmm", "crop loans", "Hello!", "Tell me about pension"]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(talk)], "k long, i long, message string")
    got = [(r.action, r.slot, r.failures, r.topic) for r in sorted(dialogue.eligibility_turns(df, ["k"], ["i"], "message").collect(), key=lambda r: r.i)]
    assert got == [("ask_slot", "age", 0, None), ("ask_slot", "state", 0, None), ("ask_slot", "state", 1, None), ("ask_slot", "state", 2, None),
                   ("ask_slot", "income_annual", 0, None), ("ask_slot", "category", 0, None), ("ask_slot", "gender", 0, None), ("ask_topic", None, None, None),
                   ("answer_query", None, None, None), ("other", None, None, None), ("smalltalk", None, None, None), ("other", None, None, None)]


def test_confidence(spark):
    turns = spark.createDataFrame([(1, "answer_topic", False), (2, "answer_query", False), (3, "answer_query", True), (4, "answer_hint", False), (5, "other", False),
                                   (6, "answer_hint", False), (7, "answer_query", True)], "k long, action string, wants_not boolean")
    found = {1: [], 2: ["eligible", "not", "not"], 3: ["eligible", "not"], 4: ["not"] * 7, 6: ["eligible"] * 5 + ["may"] * 9, 7: ["eligible"] * 6 + ["not"]}
    candidates = spark.createDataFrame([(k, i, s) for k, listed in found.items() for i, s in enumerate(listed)], "k long, scheme_id long, status string")
    got = {r.k: (r.found, r.shown, r.confidence) for r in dialogue.turn_answers(turns, ["k"], candidates).collect()}
    assert got == {1: (0, 0, "low"), 2: (3, 1, "high"), 3: (2, 2, "medium"), 4: (7, 5, "medium"), 6: (14, 5, "high"), 7: (7, 5, "high")}
