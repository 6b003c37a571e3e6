"""Routing, name matching, answers and session context over the message tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docweave import fixed
from docweave.catalog.registry import query
from docweave.functions import rules, text as tx
from docweave.operators import mentions, ordering, packing

OPENING = """case (conv_id + turn) % 12 when 0 then 'What is the weather today' when 1 then 'Am I eligible for this' when 2 then 'I want to upload my paper'
    when 3 then 'Compare A vs B' when 4 then 'Tell me about pension' when 5 then 'A scholarship in Kerala' when 6 then 'Who can apply'
    when 7 then 'योजना क्या है' when 8 then 'मैं पात्र हूँ' when 9 then 'पेंशन' when 11 then 'पात्रता' else 'Hm' end"""
FIRST_SENTENCE = r"trim(string_split(replace(text, chr(10), ' '), '.')[1])"

NORM = r"regexp_replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')"


def messages(t):
    return t.conversations.withColumn("message", F.expr(f"{OPENING} || '. ' || text"))


def known_names(t):
    """Scheme names: the first sentence of every benchmark passage."""
    return t.benchmark.select(F.col("item_id").alias("name_id"), F.trim(F.get(F.split(F.translate("text", "\n", " "), r"\."), F.lit(0))).alias("name"))


@query("rul1_ordered_rules", r"""
    select conv_id, turn, case when regexp_matches(text, '(?i)antion|edes') then 'first' when regexp_matches(text, '(?i)ouan') then 'second'
      when regexp_matches(text, '(?i)keit|ung') then 'third' end as label from conversations""")
def ordered_rules(t):
    table = [("first", "antion|edes"), ("second", "ouan"), ("third", "keit|ung")]
    return t.conversations.select("conv_id", "turn", tx.first_label(F.col("text"), table).alias("label"))


STATES_SQL = "[" + ", ".join(f"'{s}'" for s in fixed.STATES) + "]"
ASKED = f"""'Help for ' || case c_custkey % 5 when 0 then 'SC farmers' when 1 then 'women and students' when 2 then 'OBC people' when 3 then 'nobody' else 'my farm' end
    || ' with ' || case c_custkey % 4 when 0 then 'Housing' when 1 then 'a scholarship' when 2 then 'agricultural tools' else 'nothing' end"""


@query("rul2_search_filters", f"""
    select c_custkey, case when c_mktsegment <> 'BUILDING' then ({STATES_SQL})[c_nationkey + 1] end as state,
      case c_custkey % 5 when 0 then 'sc' when 1 then 'women' when 2 then 'obc' end as category,
      case c_custkey % 4 when 0 then 'housing' when 1 then 'education' when 2 then 'agriculture' end as benefit_type from customer""")
def search_filters(t):
    state = F.when(F.col("c_mktsegment") != "BUILDING", F.element_at(F.array(*[F.lit(s) for s in fixed.STATES]), F.col("c_nationkey") + 1)).otherwise(F.lit("x"))
    asked = F.concat(F.expr(ASKED), F.lit(" in "), F.upper(state))
    return t.customer.select("c_custkey", rules.search_filters(asked).alias("f")).select("c_custkey", "f.*")


STATED = """case c_custkey % 4 when 0 then 'I am ' || (18 + c_custkey % 60) || ' years old, ' when 1 then 'age: ' || (18 + c_custkey % 60) || ', '
    when 2 then 'A person ' || (18 + c_custkey % 60) || ' year old ' else 'No age, ' end
    || case c_mktsegment when 'AUTOMOBILE' then 'SC ' when 'BUILDING' then 'of general category ' when 'FURNITURE' then 'OBC woman ' when 'MACHINERY' then 'a man ' else 'transgender ' end
    || case c_custkey % 5 when 0 then 'with income of Rs. 1,20,000' when 1 then 'earn 2.5 lakh' when 2 then 'income is ,' when 3 then '3 crores yearly' else 'and no money' end"""


@query("rul3_entities", """
    select c_custkey, cast(null as varchar) as state, case c_mktsegment when 'AUTOMOBILE' then 'sc' when 'BUILDING' then 'general' when 'FURNITURE' then 'obc' end as category,
      case c_mktsegment when 'FURNITURE' then 'female' when 'MACHINERY' then 'male' when 'AUTOMOBILE' then null when 'BUILDING' then null else 'other' end as gender,
      case when c_custkey % 4 < 3 then cast(18 + c_custkey % 60 as integer) end as age,
      case c_custkey % 5 when 0 then 120000.0 when 1 then 250000.0 when 3 then 30000000.0 end::double as income from customer""")
def entities(t):
    return t.customer.select("c_custkey", rules.entities(F.expr(STATED)).alias("e")).select("c_custkey", "e.*")


@query("rul4_intents", rf"""
    with c as (select count(*) as n from benchmark), n as (select item_id, {FIRST_SENTENCE} as name from benchmark),
    f as (select {NORM.format('name')} as f from n), m as (select conv_id, turn, (conv_id + turn) % 12 as k,
       {OPENING} || '. ' || text || coalesce('. ' || name, '') as msg from conversations left join n on role = 'user' and item_id = conv_id % (select n from c)),
    h as (select conv_id, turn, k, {NORM.format('msg')} as h from m),
    x as materialized (select conv_id, turn, h, f from h join f on length(f) >= 4 and contains(h, f)), y as (select distinct conv_id, turn from x where regexp_matches(h, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(f) || '($|[^\p{{L}}\p{{N}}_])')),
    z as (select h.conv_id, h.turn, k, y.turn is not null as named from h left join y using (conv_id, turn))
    select conv_id, turn, case when k = 0 then 'out_of_scope' when k in (1, 8) then 'eligibility_check' when k = 2 then 'document_upload' when k = 3 then 'comparison'
        when k = 10 and not named then 'unknown' else 'scheme_search' end as intent,
      cast(case when k in (7, 8, 11) then 0.85 when k in (5, 9, 10) and (k <> 10 or named) then 0.8 when k = 10 then 0.3 else 0.9 end as double) as confidence,
      k in (5, 9) as topic_only from z""")
def intents(t):
    """Messages of users also name a scheme: the sentence of one benchmark passage per conversation."""
    n = t.benchmark.agg(F.count(F.lit(1))).scalar()
    named = messages(t).withColumn("name_id", F.when(F.col("role") == "user", F.col("conv_id") % n))
    texts = named.join(known_names(t), "name_id", "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("text_id"), "conv_id", "turn", F.concat_ws(". ", "message", "name").alias("text"))
    found = mentions.mentioned_names(texts.select("text_id", "text"), known_names(t)).select("text_id").distinct().withColumn("named", F.lit(True))
    routed = texts.join(found, "text_id", "left").withColumn("r", rules.intent(F.col("text"), F.coalesce("named", F.lit(False))))
    return routed.select("conv_id", "turn", "r.*")


TALK = """case event_id % 7 when 0 then 'Hello!' when 1 then 'Thank you so much' when 2 then 'namaste' when 3 then 'Good morning' when 4 then 'hi what schemes are there'
    when 5 then 'शुक्रिया' else event_type || ' vanakkam' end"""


@query("rul5_smalltalk", """
    select event_id, case event_id % 7 when 0 then 'greeting' when 1 then 'thanks' when 2 then 'greeting' when 3 then 'greeting' when 5 then 'thanks' end as kind,
      case event_id % 7 when 2 then 'hi' when 5 then 'hi' end as language from events""")
def smalltalk(t):
    return t.events.select("event_id", rules.smalltalk(F.expr(TALK)).alias("s")).select("event_id", "s.*")


FOLLOW = """case event_id % 6 when 0 then 'the second one' when 1 then 'last scheme please' when 2 then 'who can apply for it?' when 3 then 'documents needed'
    when 4 then 'documents required for farmers' else 'weather ' || event_type end"""


@query("rul6_followups", """
    select event_id, case event_id % 6 when 0 then case when user_id % 4 > 1 then 1 end when 1 then case when user_id % 4 > 0 then user_id % 4 - 1 end end as ordinal,
      user_id % 4 > 0 and case event_id % 6 when 0 then user_id % 4 > 1 when 1 then true when 2 then true when 3 then true else false end as followup from events""")
def followups(t):
    remembered = F.col("user_id") % 4
    return t.events.select("event_id", rules.ordinal_index(F.expr(FOLLOW), remembered).alias("ordinal"),
                           rules.is_followup(F.expr(FOLLOW), remembered, F.lit(False)).alias("followup"))


SLOT = "case c_custkey % 5 when 0 then 'age' when 1 then 'state' when 2 then 'income_annual' when 3 then 'category' else 'gender' end"
REPLY = """case c_custkey % 5 when 0 then 'I am ' || c_nationkey * 9 when 1 then case when c_nationkey % 2 = 0 then 'orissa' else 'in kerala' end
    when 2 then case when c_nationkey % 2 = 0 then c_nationkey || ' lakhs' else c_nationkey * 100 || '' end when 3 then case when c_nationkey % 2 = 0 then 'GEN' else 'banana' end
    else case when c_nationkey % 3 = 0 then 'skip' else 'a lady' end end"""


@query("rul7_slot_replies", """
    select c_custkey, case c_custkey % 5 when 0 then case when c_nationkey between 1 and 13 then cast(c_nationkey * 9 as varchar) end
      when 1 then case when c_nationkey % 2 = 0 then 'Odisha' else 'Kerala' end
      when 2 then case when c_nationkey % 2 = 0 then cast(c_nationkey * 100000 as bigint) || '.0' when c_nationkey >= 10 then c_nationkey * 100 || '.0' end
      when 3 then case when c_nationkey % 2 = 0 then 'general' end else case when c_nationkey % 3 <> 0 then 'female' end end as value,
      c_custkey % 5 = 4 and c_nationkey % 3 = 0 as skipped from customer""")
def slot_replies(t):
    value = rules.slot_reply(F.expr(SLOT), F.expr(REPLY))
    value = F.when(F.expr(SLOT) == "income_annual", F.concat(value.cast("double").cast("decimal(20,1)").cast("string"))).otherwise(value)
    return t.customer.select("c_custkey", value.alias("value"), rules.is_skip(F.expr(REPLY)).alias("skipped"))


@query("rul8_next_slot", """
    select c_custkey, case when c_custkey % 3 = 0 then 'age' when c_nationkey > 12 then 'state' when c_acctbal < 0 then 'income_annual'
       when c_mktsegment = 'BUILDING' then 'category' end as slot from customer""")
def next_slot(t):
    c = t.customer
    return c.select("c_custkey", rules.next_slot(
        F.array(F.lit("gender")), age=F.when(F.col("c_custkey") % 3 != 0, F.lit(30)), state=F.when(F.col("c_nationkey") <= 12, F.lit("Goa")),
        income_annual=F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), category=F.when(F.col("c_mktsegment") != "BUILDING", F.lit("sc")),
        gender=F.lit(None)).alias("slot"))


TOPIC_TEXT = """case p_size % 7 when 0 then 'crop loans' when 1 then 'school fees' when 2 then 'a small house' when 3 then 'MSME startup' when 4 then 'hospital bills'
    when 5 then 'old age' else p_type end"""


@query("rul9_topics", """
    select p_partkey, case p_size % 7 when 0 then 'agriculture' when 1 then 'education' when 2 then 'housing' when 3 then 'business' when 4 then 'health' when 5 then 'pension' end as topic,
      p_size % 7 in (0, 1, 2, 3, 4, 5) as matched, case when p_size % 2 = 0 then 'education' else 'business' end as hint,
      case when p_size % 3 = 0 then 'schemes for ' || p_name end as changed, true as topical, p_size % 5 = 0 as show_not from part""")
def topics(t):
    text = F.expr(TOPIC_TEXT)
    topic = rules.topic_of_reply(text)
    hint = rules.topic_hint(F.when(F.col("p_size") % 2 == 0, "Pupil").otherwise("shop keeper"), F.lit(False))
    change = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("actually, for "), F.col("p_name"), F.lit("?"))).otherwise(F.col("p_name"))
    ask = F.when(F.col("p_size") % 5 == 0, "Show schemes I am not eligible for").otherwise("show schemes")
    return t.part.select("p_partkey", topic.alias("topic"), F.coalesce(rules.matches_topic(text, topic), F.lit(False)).alias("matched"), hint.alias("hint"),
                         rules.topic_change(change).alias("changed"), rules.has_topic(F.col("p_name")).alias("topical"),
                         rules.wants_not_eligible(ask).alias("show_not"))


def _state(expr):
    return F.element_at(F.array(*[F.lit(s) for s in fixed.STATES]), expr.cast("int"))


@query("rul10_states_in_text", f"""
    select o_orderkey, case when o_orderkey % 34 = o_custkey % 34 then ({STATES_SQL})[o_orderkey % 34 + 1] else ({STATES_SQL})[o_orderkey % 34 + 1] || '|' || ({STATES_SQL})[o_custkey % 34 + 1] end as states from orders""")
def states_in_text(t):
    text = F.concat(F.lit("Goal: "), F.upper(_state(F.col("o_orderkey") % 34 + 1)), F.lit(" and "), _state(F.col("o_custkey") % 34 + 1), F.lit(", not Goans. "))
    return t.orders.select("o_orderkey", F.array_join(rules.states_in(text), "|").alias("states"))


RESPONSE = """'{"intent":"' || case event_type when 'view' then 'eligibility' when 'click' then 'clarify' when 'error' then 'hack' else 'scheme_search' end
    || '","rewritten_query_en":"find ' || event_id || '","language":"' || case when user_id % 11 = 0 then 'fr' else 'en' end || '","profile_slots":{"age":' || (user_id % 150)
    || ',"state":"' || case when user_id % 2 = 0 then 'kerala' else 'Mars' end || '"}' || case when user_id % 13 = 0 then ',"extra":1' else '' end || '}'"""
GOOD = "event_type <> 'error' and user_id % 11 <> 0 and user_id % 150 <= 120 and user_id % 13 <> 0"


@query("rul11_strict_responses", f"""
    select event_id, {GOOD} as valid, case when {GOOD} then cast(user_id % 150 as integer) end as age, case when {GOOD} and user_id % 2 = 0 then 'Kerala' end as state from events""")
def strict_responses(t):
    r = t.events.select("event_id", rules.understanding(F.expr(RESPONSE)).alias("r"))
    return r.select("event_id", F.col("r").isNotNull().alias("valid"), F.col("r.slots.age").alias("age"), F.col("r.slots.state").alias("state"))


@query("rul12_response_routes", f"""
    select event_id, case when not ({GOOD}) then 'plain_search' when event_type = 'click' then 'clarify' when event_type = 'view' then 'eligibility_check' else 'scheme_search' end as route from events""")
def response_routes(t):
    r = t.events.withColumn("r", rules.understanding(F.expr(RESPONSE)))
    return r.select("event_id", rules.route_response(F.col("r"), F.lit("hello"), F.lit(0)).alias("route"))


NAMED_RESPONSE = """concat('{"intent":"', case event_type when 'view' then 'eligibility' when 'click' then 'clarify' else 'scheme_search' end, '","rewritten_query_en":"find ', event_id,
    '","language":"en","scheme_name":"Supplier#', lpad(string(event_id % 23 + 1), 9, '0'), case when event_id % 3 = 0 then '9' else '' end, '"}')"""


@query("rul12_named_routes", """
    with n as (select s_suppkey as name_id, lower(s_name) as n from supplier),
    e as (select event_id, event_type, 'supplier#' || lpad(cast(event_id % 23 + 1 as varchar), 9, '0') || case when event_id % 3 = 0 then '9' else '' end as f from events),
    x as (select event_id, name_id, n from e join n on f = n), p as (select event_id, name_id, n from e join n on contains(f, n) or contains(n, f) where event_id not in (select event_id from x)),
    u as (select *, row_number() over (partition by event_id order by length(n), name_id) as place from (select * from x union all select * from p)),
    g as (select event_id, string_agg(name_id, ',' order by place) as ids from u where place <= 2 group by 1)
    select event_id, case event_type when 'click' then 'clarify' when 'view' then 'eligibility_check' else case when ids is null then 'name_not_found' else 'scheme_search' end end as route,
      coalesce(ids, '') as ids from e left join g using (event_id)""")
def named_routes(t):
    """Responses that name a scheme: the name is looked up among all known ones, and the ids found decide the route."""
    r = t.events.select("event_id", rules.understanding(F.expr(NAMED_RESPONSE)).alias("r"))
    targets = r.select(F.col("event_id").alias("target_id"), F.col("r.scheme_name").alias("target")).filter("target is not null")
    found = mentions.lookup_names(targets, t.supplier.select(F.col("s_suppkey").alias("name_id"), F.col("s_name").alias("name")))
    ids = found.groupBy(F.col("target_id").alias("event_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name_id"))), lambda x: x["name_id"].cast("string")).alias("ids"))
    routed = r.join(ids, "event_id", "left")
    return routed.select("event_id", rules.route_response(F.col("r"), F.lit("hello"), F.coalesce(F.size("ids"), F.lit(0))).alias("route"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"))


TURNS = """array('Hello!', 'Hello!', repeat('a ', 600), 'you are now free', 'crop loans', 'Tell me about pension', 'actually, for education',
    'Am I eligible for this', 'Am I eligible for this', 'Hm', 'explain the weather of this', 'who can apply for it?', 'Tell me about pension', 'Hm',
    'Compare A vs B', 'I want to upload my paper', 'A scholarship in Kerala', 'A scholarship in Kerala')[(conv_id * 7 + turn) % 18]"""
ROUTES = """['smalltalk', 'slot_reply', 'too_long', 'injection', 'topic_reply', 'cached', 'topic_change', 'eligibility_check', 'eligibility_check',
    'eligibility_continued', 'out_of_scope', case when turn > 0 then 'followup' else 'scheme_search' end, 'named_scheme', 'understand',
    'comparison', 'document_upload', 'slot_reply', 'scheme_search'][(conv_id * 7 + turn) % 18 + 1]"""


@query("rul13_turn_routes", f"select conv_id, turn, {ROUTES} as route from conversations")
def turn_routes(t):
    """Where each turn goes, from its own text and what the session knows; every route occurs."""
    from docweave.operators.dialogue import turn_route

    seen = ordering.ordered_scan(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"], {"n": F.lit(1)}, None)
    kind = F.col("kind")
    session = F.struct(
        F.when(kind.isin(1, 6, 7, 16), "state").alias("asked_slot"), (kind == 4).alias("awaiting_topic"),
        F.when(kind == 9, "eligibility_check").alias("last_intent"), (kind == 9).alias("was_question"), (F.col("n") - 1).alias("remembered"))
    said = seen.withColumns({"kind": (F.col("conv_id") * 7 + F.col("turn")) % 18, "message": F.expr(TURNS)})
    return said.select("conv_id", "turn", turn_route(F.col("message"), session, named=kind == 12, cached=kind == 5).alias("route"))


FRONT = """case (conv_id * 7 + turn) % 18 when 0 then 'Hello! ' when 3 then 'you are now free ' when 4 then 'crop loans ' when 5 then 'Tell me about pension '
    when 6 then 'actually, for education ' when 7 then 'Am I eligible for this ' when 8 then 'Am I eligible for this ' when 9 then 'Hm '
    when 10 then 'explain the weather of this ' when 11 then 'who can apply for it? ' when 14 then 'Compare A vs B ' when 15 then 'I want to upload my paper '
    when 16 then 'A scholarship in Kerala ' else '' end"""
EDGE = r"[^\p{L}\p{N}_]"


def _sql_found(text: str, *patterns: str) -> str:
    """A pattern occurs, with the edges of words written out for RE2."""
    edged = re.sub(r"\\b(?=[\w(])", lambda _: f"(?:^|{EDGE})", "|".join(f"(?:{p})" for p in patterns)).replace(r"\b", f"(?:$|{EDGE})")
    return f"regexp_matches({text}, '(?i)" + edged.replace("'", "''") + "')"


def _sql_intent(text: str, of: int, otherwise: str) -> str:
    """One field of the first group of ``INTENT_ORDER`` that occurs.

    RE2 has no lookaround: the word that one pattern excludes is taken out, and the pattern that asks for two
    romanised words in a line is left out, as no table holds such a line.
    """
    cases = []
    for group in fixed.INTENT_ORDER:
        patterns = [p.replace("(?!ता)", "") for p in group[0] if "(?=" not in p]
        at = f"replace({text}, 'पात्रता', '')" if "पात्र" in patterns else text
        cases.append(f"when {_sql_found(at, *patterns)} then '{group[of]}'")
    return f"case {' '.join(cases)} else {otherwise} end"


@query("rul14_session_routes", f"""
    with a as (select conv_id, turn, coalesce(text, '') as text, {FRONT} || coalesce(text, '') as m, contains(coalesce(text, ''), 'tion ') as named from conversations),
    i as (select *, {_sql_intent('m', 1, "case when named then 'scheme_search' else 'unknown' end")} as intent, {_sql_intent('m', 3, "'False'")} = 'True' as topic_only from a),
    s as (select *, row_number() over w - 1 as remembered, lag(length(text) % 4) over w as asked, lag(intent) over w as last_intent,
          min(conv_id) over (partition by text) < conv_id as cached from i window w as (partition by conv_id order by turn)),
    k as (select *, coalesce(asked = 0, false) as pending, case when coalesce(asked = 0, false) and topic_only then 'unknown' else intent end as kind from s)
    select conv_id, turn, case when length(m) > {fixed.MAX_MESSAGE_CHARS} then 'too_long'
      when {' or '.join(f"contains(lower(m), '{p}')" for p in tx.INJECTIONS)} then 'injection'
      when asked = 1 and {_sql_found('m', *(reply for _, reply, _ in fixed.TOPICS))} then 'topic_reply'
      when not pending and regexp_full_match(m, '(?i)\\W*(hello\\W*)+') then 'smalltalk' when cached then 'cached'
      when pending and {_sql_found('m', fixed.TOPIC_CHANGE_PATTERN)} then 'topic_change' when kind = 'eligibility_check' then kind
      when pending and kind in ('unknown', 'out_of_scope') then 'slot_reply' when last_intent = 'eligibility_check' and asked = 2 then 'eligibility_continued'
      when not pending and kind in ('scheme_search', 'unknown') and remembered > 0 and not named and ({_sql_found('m', fixed.LAST_PATTERN)}
        or {_sql_found('m', fixed.FOLLOWUP_PATTERN)} and {_sql_found('m', fixed.PRONOUN_PATTERN)}) then 'followup'
      when not pending and kind = 'scheme_search' and named then 'named_scheme' when kind = 'unknown' then 'understand' else kind end as route from k""")
def session_routes(t):
    """Where the real text of each turn goes, most of them behind a phrase that leads to a route of its own.

    The session is what the turns before left: the length of the text before stands for what the last answer asked
    (a slot, a topic, a yes or no), the last intent is that of the message before, and each turn before cited a scheme.
    An answer is stored when an earlier conversation holds the text. A missing text is an empty message.
    """
    from docweave.operators.dialogue import turn_route

    text = F.coalesce("text", F.lit(""))
    said = t.conversations.select("conv_id", "turn", text.alias("text"), F.concat(F.expr(FRONT), text).alias("message"))
    said = said.withColumns({"digest": F.sha2("text", 256), "named": F.contains("text", F.lit("tion "))})
    own = said.withColumn("intent", rules.intent(F.col("message"), F.col("named"))["intent"])
    seen = ordering.ordered_scan(own, ["conv_id"], ["turn"], {"n": F.lit(1)}, {"asked": F.length("text") % 4, "last_intent": F.col("intent")})
    first = said.groupBy("digest").agg(F.min("conv_id").alias("first_conv"))
    stored = ordering.lookup_join(seen, first, ["digest"])
    session = F.struct(
        F.when(F.col("asked") == 0, "state").alias("asked_slot"), (F.col("asked") == 1).alias("awaiting_topic"), "last_intent",
        (F.col("asked") == 2).alias("was_question"), (F.col("n") - 1).alias("remembered"))
    return stored.select("conv_id", "turn", turn_route(
        F.col("message"), session, named=F.col("named"), cached=F.col("first_conv") < F.col("conv_id")).alias("route"))


# --- names in texts -------------------------------------------------------------------------
MENTIONS = rf"""n as (select item_id as name_id, {NORM.format(FIRST_SENTENCE)} as f from benchmark),
    h as (select doc_id as text_id, {NORM.format('text')} as h from documents),
    x as materialized (select text_id, name_id, f, h from h join n on length(f) >= 4 and contains(h, f)),
    m as (select text_id, name_id, f from x where regexp_matches(h, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(f) || '($|[^\p{{L}}\p{{N}}_])')),
    k as (select * from m a where not exists (select 1 from m b where b.text_id = a.text_id and b.name_id <> a.name_id and contains(b.f, a.f) and (length(b.f) > length(a.f) or b.name_id < a.name_id))),
    r as (select text_id, row_number() over (partition by text_id order by length(f) desc, name_id) - 1 as place, name_id, f from k qualify place < 3)"""


def found_names(t):
    texts = t.documents.select(F.col("doc_id").alias("text_id"), "text")
    return mentions.mentioned_names(texts, known_names(t))


@query("joi7_mentioned_names", f"with {MENTIONS} select text_id, cast(place as bigint) as place, name_id, f as name_form from r")
def mentioned(t):
    return found_names(t)


SENTENCES = rf"""sn as (select item_id, unnest(string_split(replace(text, chr(10), ' '), '.')) as name, generate_subscripts(string_split(replace(text, chr(10), ' '), '.'), 1) - 1 as i from benchmark),
    n as (select item_id * 10000 + i as name_id, {NORM.format('name')} as f from sn),"""


@query("joi7_sentences_in_texts", "with " + SENTENCES + MENTIONS[MENTIONS.index("    h as"):] + " select text_id, cast(place as bigint) as place, name_id, f as name_form from r")
def sentences_in_texts(t):
    """All sentences of all benchmark passages as names, looked for in whole documents: the name table grows with the passages."""
    pieces = F.posexplode(F.split(F.translate("text", "\n", " "), r"\.")).alias("i", "name")
    names = t.benchmark.select("item_id", pieces).select((F.col("item_id") * 10000 + F.col("i")).alias("name_id"), "name")
    return mentions.mentioned_names(t.documents.select(F.col("doc_id").alias("text_id"), "text"), names)


@query("joi8_name_lookup", r"""
    with t as (select c_custkey as target_id, lower(trim(replace(case when c_custkey % 3 = 0 then left(c_name, 17) when c_custkey % 3 = 1 then c_name else c_name || ' of town' end, 'Customer', 'Supplier'))) as f from customer),
    n as (select s_suppkey as name_id, lower(s_name) as n from supplier),
    e as (select target_id, name_id, n from t join n on f = n),
    p as (select target_id, name_id, n from t join n on contains(n, f) or contains(f, n) where target_id not in (select target_id from e) and length(f) >= 8),
    u as (select * from e union all select * from p)
    select target_id, row_number() over (partition by target_id order by length(n), name_id) as place, name_id from u qualify place <= 2""")
def name_lookup(t):
    target = F.expr("replace(case when c_custkey % 3 = 0 then left(c_name, 17) when c_custkey % 3 = 1 then c_name else c_name || ' of town' end, 'Customer', 'Supplier')")
    targets = t.customer.select(F.col("c_custkey").alias("target_id"), target.alias("target"))
    return mentions.lookup_names(targets, t.supplier.select(F.col("s_suppkey").alias("name_id"), F.col("s_name").alias("name")))


@query("joi9_citation_guard", rf"""
    with n as (select item_id, {NORM.format(FIRST_SENTENCE)} as f from benchmark), c as (select count(*) as n from benchmark),
    h as (select doc_id, unnest([doc_id % c.n, (doc_id + 1) % c.n, (doc_id * 7) % c.n]) as item_id from documents, c),
    g as (select d.doc_id, count(*) as n_cited, min(h.item_id) as first_cited from documents d join (select distinct * from h) h using (doc_id) join n using (item_id)
          where length(f) >= 4 and contains({NORM.format('d.text')}, f) group by d.doc_id)
    select doc_id as query_id, case when g.doc_id is null then 'declined' else 'kept' end as answer, case when g.doc_id is null then 'low' else 'high' end as confidence,
      coalesce(n_cited, 0) as n_cited, first_cited from documents left join g using (doc_id)""")
def citation_guard(t):
    answers = t.documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"), F.lit("high").alias("confidence"))
    guarded = mentions.guard_answers(answers, candidate_names(t), "declined")
    return guarded.withColumn("answer", F.when(F.col("answer") == "declined", "declined").otherwise("kept"))


def candidate_names(t):
    """Up to three retrieved scheme names per document."""
    n = t.benchmark.agg(F.count(F.lit(1))).scalar()
    three = F.array_distinct(F.array(F.col("doc_id") % n, (F.col("doc_id") + 1) % n, (F.col("doc_id") * 7) % n))
    ids = t.documents.select(F.col("doc_id").alias("query_id"), F.explode(three).alias("scheme_id"))
    return ids.join(known_names(t).withColumnRenamed("name_id", "scheme_id"), "scheme_id")


@query("txt20_protected_names", rf"""
    with c as (select count(*) as n from benchmark), n as (select {FIRST_SENTENCE} as name, item_id from benchmark),
    h as (select distinct doc_id, item_id from (select doc_id, unnest([doc_id % c.n, (doc_id + 1) % c.n, (doc_id * 7) % c.n]) as item_id from documents, c))
    select doc_id as text_id, count(*) as names, true as restored from documents join h using (doc_id) join n using (item_id) where contains(text, name) and name <> '' group by doc_id""")
def protected_names(t):
    texts = t.documents.select(F.col("doc_id").alias("text_id"), "text")
    named = candidate_names(t).join(texts, F.col("query_id") == F.col("text_id")).filter("name <> ''").filter(F.contains("text", F.col("name")))
    done = mentions.protect_names(texts, named.select("text_id", F.col("scheme_id").alias("place"), "name")).filter(F.size("names") > 0)
    return done.select("text_id", F.size("names").cast("long").alias("names"),
                       ((mentions.restore_names(F.col("protected"), F.col("names")) == F.col("text")) & F.contains("protected", F.lit("__SCHEME_0__"))).alias("restored"))


MARKED = """case when doc_id % 3 = 0 then '1. ' || text || chr(10) || '- **' || lang || '** 2.' else text end"""


@query("txt20_segments", rf"""
    with n as (select distinct trim(unnest(string_split(replace(text, chr(10), ' '), '.'))) as name from benchmark),
    p as (select string_agg(regexp_escape(name), '|' order by length(name) desc) || '|\*\*' as pattern from n where length(name) >= 4),
    d as (select doc_id, {MARKED} as text from documents),
    s as (select doc_id, text, regexp_extract_all(text, pattern) as names, regexp_split_to_array(text, pattern) as between from d, p),
    l as (select doc_id, i, j, line from (select doc_id, i, unnest(string_split(b, chr(10))) as line, generate_subscripts(string_split(b, chr(10)), 1) as j
          from (select doc_id, unnest(between) as b, generate_subscripts(between, 1) as i from s))),
    b as (select doc_id, i, j, regexp_replace(regexp_replace(line, '^[\s\-–—]*(?:\d+\.\s+)?[\s\-–—]*', ''), '(?:\s+\d+\.)?\s*$', '') as body from l),
    t as (select doc_id, string_agg(body, '|' order by i, j) as bodies, count(*) as texts from b where regexp_matches(body, '[\p{{L}}\p{{No}}\p{{Nl}}]') group by 1)
    select doc_id, len(names) as names, sha256(array_to_string(names, '|')) as names_digest, coalesce(texts, 0) as texts, sha256(coalesce(bodies, '')) as texts_digest,
      sha256(text) as digest from s left join t using (doc_id)""")
def name_segments(t):
    """Documents cut around all sentences of the benchmark, and put together again."""
    from docweave.operators import segments

    sentences = t.benchmark.select(F.explode(F.split(F.translate("text", "\n", " "), r"\.")).alias("name")).select(F.trim("name").alias("name")).filter(F.length("name") >= 4)
    cut = segments.split_around_names(t.documents.select("doc_id", F.expr(MARKED.replace("chr(10)", "'\\n'")).alias("text")), sentences, id_="doc_id")
    parts = lambda *kinds: F.transform(F.filter("segments", lambda s: s["kind"].isin(*kinds)), lambda s: s["part"])
    named, texts = parts("name", "mark"), parts("text")
    return cut.select("doc_id", F.size(named).cast("long").alias("names"), F.sha2(F.array_join(named, "|"), 256).alias("names_digest"), F.size(texts).cast("long").alias("texts"),
                      F.sha2(F.array_join(texts, "|"), 256).alias("texts_digest"), F.sha2(segments.changed_between(F.col("segments"), lambda x: x), 256).alias("digest"))


@query("txt24_typo_repair")
def typo_repair(t):
    """Exact ratio matching has no SQL form; a brute-force test covers it."""
    texts = t.spread("documents").select(F.col("doc_id").alias("text_id"), "text")
    vocabulary = ["that", "this", "from", "with", "pour", "dans", "elle", "antion", "einer", "worthless"]
    return mentions.fix_typos(texts, vocabulary, ["them", "than"]).select("text_id", F.sha2("fixed", 256).alias("digest"))


# --- context ---------------------------------------------------------------------------------
LINES5 = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def packed(t):
    from docweave.functions.sections import items

    lines = t.documents.select("doc_id", "lang", items(F.col("text")).alias("l"))
    parts = [F.coalesce(F.get("l", F.lit(i)), F.lit("")) for i in range(4)] + [F.array_join(F.slice("l", 5, F.greatest(F.size("l"), F.lit(1))), " ")]
    return lines.select("doc_id", "lang", packing.pack_sections(parts).alias("packed"))


PACKED = rf"""l as (select doc_id, lang, {LINES5} as l from documents),
    s as (select doc_id, lang, unnest([coalesce(l[1], ''), coalesce(l[2], ''), coalesce(l[3], ''), coalesce(l[4], ''), array_to_string(l[5:], ' ')]) as t, unnest([500, 400, 350, 250, 0]) as share, unnest([1, 2, 3, 4, 5]) as i from l),
    b as (select *, least(length(t), share) as base, 2500 - sum(least(length(t), share)) over (partition by doc_id) as lft from s),
    c as (select *, sum(length(t) - base) over (partition by doc_id order by i) as cum from b),
    a as (select *, base + least(lft, cum) - least(lft, cum - (length(t) - base)) as allowed from c),
    o as (select doc_id, lang, string_agg(case when length(t) > allowed then regexp_replace(left(t, greatest(allowed - 1, 0)::bigint), '\s+$', '') || '…' else t end, chr(10) order by i) filter (t <> '') as packed from a group by doc_id, lang)"""


@query("win2_context_packing", f"with {PACKED} select doc_id, length(packed) as n, sha256(packed) as digest from o")
def context_packing(t):
    return packed(t).select("doc_id", F.length("packed").cast("long").alias("n"), F.sha2("packed", 256).alias("digest"))


@query("win3_prompt_budget", f"""
    with {PACKED}, r as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rank from events qualify rank <= 10),
    j as (select user_id, rank, length(packed) as n from r join o on doc_id = (event_id % (select count(*) from documents))),
    w as (select *, (1200 + sum(n) over (partition by user_id order by rank) + 2 * (rank - 1)) // 3 as tokens from j)
    select user_id, rank, cast(tokens as bigint) as tokens from w where rank = 1 or tokens <= 5500""")
def prompt_budget(t):
    from pyspark.sql import Window as W

    total = t.documents.agg(F.count(F.lit(1))).scalar()
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long")
    hits = t.events.withColumn("rank", rank).filter("rank <= 10").select("user_id", "rank", (F.col("event_id") % total).alias("doc_id"))
    sized = hits.join(packed(t).select("doc_id", F.length("packed").alias("n")), "doc_id")
    return packing.fit_budget(sized, "user_id", "rank", F.col("n"), F.lit(1200)).select("user_id", "rank", "tokens")


@query("win6_last_known_profile", """
    with v as (select *, case when event_type = 'view' then value end as a, case when event_type = 'click' then event_type || event_id end as b from events)
    select event_id, last(a ignore nulls) over w as age, last(b ignore nulls) over w as state from v
    window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def last_known_profile(t):
    from docweave.operators.dialogue import carry_profile

    stated = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", F.col("value")).alias("age"),
                             F.when(F.col("event_type") == "click", F.concat("event_type", "event_id")).alias("state"))
    return carry_profile(stated, ["user_id"], ["ts", "event_id"], ["age", "state"]).select("event_id", "age", "state")


@query("win7_recent_turns", """
    select conv_id, turn, coalesce(string_agg(role || ':' || left(text, 300), '|') over (partition by conv_id order by turn rows between 6 preceding and 1 preceding), '') as context from conversations""")
def recent_turns(t):
    said = F.concat("role", F.lit(":"), F.left("text", F.lit(300)))
    rows = ordering.trailing_rows(t.conversations, ["conv_id"], ["turn"], said, 6, "context")
    return rows.select("conv_id", "turn", F.array_join("context", "|").alias("context"))


@query("win8_cache_state", """
    with e as (select user_id, event_type, max(ts) as t, arg_max(event_id, ts) as v from events group by 1, 2)
    select user_id, event_type, epoch_us(t) as at, v from e where t > (select max(ts) from events) - interval 24 hour order by t desc limit 500""")
def cache_state(t):
    from docweave.operators.dialogue import cache_state as state

    stored = t.events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("v"))
    kept = state(stored, ["user_id", "event_type"], stored.agg(F.max("t")).scalar())
    return kept.select("user_id", "event_type", F.unix_micros("t").alias("at"), "v")


@query("str1_sessions", """
    with g as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
    s as (select *, sum(case when prev is null or ts - prev > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id) as session_no from g)
    select user_id, cast(session_no as bigint) as session_no, epoch_us(min(ts)) as started, epoch_us(max(ts)) as ended, count(*) as turns from s group by 1, 2""")
def sessions(t):
    from docweave.operators.dialogue import session_numbers

    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    numbered = session_numbers(rows, ["user_id"], ["ts", "event_id"])
    return numbered.groupBy("user_id", "session_no").agg(
        F.unix_micros(F.min("ts")).alias("started"), F.unix_micros(F.max("ts")).alias("ended"), F.count(F.lit(1)).alias("turns"))


@query("str2_session_memory", """
    with u as (select *, case when role = 'assistant' then [turn, length(text)] end as used from conversations)
    select conv_id, turn, last(case when role = 'assistant' then turn end ignore nulls) over w as remembered_turn, last(case when role = 'assistant' then text like '%on.' end ignore nulls) over w as was_question,
      count(*) over (partition by conv_id order by turn) as turn_no from u
    window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""")
def session_memory(t):
    said = F.col("role") == "assistant"
    rows = ordering.ordered_scan(t.conversations, ["conv_id"], ["turn"], {"turn_no": F.lit(1)},
                                 {"remembered_turn": F.when(said, F.col("turn")), "was_question": F.when(said, F.endswith("text", F.lit("on.")))})
    return rows.select("conv_id", "turn", "remembered_turn", "was_question", F.col("turn_no").cast("long").alias("turn_no"))
