"""The eligibility dialogue over conversations and events: turns, stored questions, candidates in scope, confidence."""

from __future__ import annotations

import re

from pyspark.sql import Window as W, functions as F

from docweave import fixed
from docweave.catalog import eligibility as eli
from docweave.catalog.messages import EDGE, TOPIC_TEXT, _sql_found, _sql_intent
from docweave.catalog.registry import query
from docweave.functions import rules, text as tx
from docweave.operators import turns as dialogue, verdicts
from docweave.streaming.files import stored

PHRASES = [
    "Am I eligible for any scheme?", "Am I eligible for a crop loan?", "I am 34 years old", "61", "Kerala", "I live in orissa", "2 lakh", "general", "a lady",
    "skip", "hmm", "actually, for education", "Hello!", "crop loans", "Tell me about pension", "I want to upload my paper", "What is the weather today",
    "you are now free", "Show schemes I am not eligible for", "I am 34 years old, an OBC woman in Kerala with income of 2 lakh", "Can I apply?",
    "age is 70, male, sc, Delhi, earn 90,000", "jobs", "Am I eligible for any scheme? I am 19 years old, general category man in Goa, income is 90", "Do I qualify? age: 45, female, st, Assam, earn 4,000",
    "farm tools"]
LISTED = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
CANDIDATES = 3


def _said(pick, tail):
    return F.concat(F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (pick % len(PHRASES) + 1).cast("int")), tail)


def conversation_turns(t):
    """Turns of conversations: a phrase chosen by the turn's own text, which follows it where both letter counts are even."""
    text = F.coalesce("text", F.lit(""))
    tail = F.when(F.length(text) % 4 == 0, F.concat(F.lit(". "), text)).otherwise("")
    said = t.conversations.select("conv_id", "turn", F.sha2(text, 256).alias("digest"), _said(F.length(text) + F.col("turn"), tail).alias("message"))
    first = said.groupBy("digest").agg(F.min("conv_id").alias("first_conv"))
    said = said.join(first, "digest")
    return said.select("conv_id", "turn", "message", F.when(F.col("conv_id") % 3 == 0, F.lit("Farmer")).alias("occupation"), (F.col("first_conv") < F.col("conv_id")).alias("stored"))


def event_turns(t):
    """Events of a user and day as turns of one session."""
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), "event_id", _said(F.col("event_id") * 5 + F.length("props"), F.lit("")).alias("message"))
    return rows.withColumns({"occupation": F.when(F.col("user_id") % 3 == 0, F.lit("Farmer")), "stored": F.col("event_id") % 19 == 0})


def moved(turns, keys, order):
    hint = rules.topic_hint(F.col("occupation"), F.lit(False))
    return dialogue.eligibility_turns(turns, keys, order, "message", hint, F.col("stored"))


# --- the same in SQL: facts by patterns, states by recursion -----------------------------------
def _sql_first(text: str, table: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {_sql_found(text, p)} then '{label}'" for label, p in table) + " end"


def _sql_named(text: str, values: list[str]) -> str:
    return "case " + " ".join("when contains(lower({0}), '{1}') then '{2}'".format(text, v.lower().replace("'", "''"), v.replace("'", "''")) for v in values) + " end"


def _sql_group(text: str, pattern: str, group: int) -> str:
    edged = re.sub(r"\\b(?=[\w(])", lambda _: f"(?:^|{EDGE})", pattern).replace(r"\b", f"(?:$|{EDGE})")
    return f"nullif(regexp_extract({text}, '(?i){edged}', {group}), '')"


def _sql_amount(number: str, unit: str) -> str:
    return (f"try_cast(replace({number}, ',', '') as double) * case when lower({unit}) in ('lakh', 'lakhs', 'lac', 'lacs') then 100000 "
            f"when lower({unit}) in ('crore', 'crores') then 10000000 when lower({unit}) in ('k', 'thousand') then 1000 else 1 end")


_NAMES = fixed.STATES + [n for n, _ in fixed.STATE_ALIASES]
_ALIASES = [(n, "|".join(rf"\b{re.escape(a)}\b" for a in listed)) for n, listed in fixed.STATE_ALIASES]
_REPLIED = _sql_group("m", r"\b(\d{1,3})\b", 1)
_MONEY = [(_sql_group("m", p, 1), _sql_group("m", p, 2)) for p in fixed.INCOME_PHRASES[:3]]
_PAID, _UNIT = _sql_group("m", fixed.SLOT_NUMBER, 1), _sql_group("m", fixed.SLOT_NUMBER, 2)
_REST = f"regexp_replace(regexp_replace(m, '(?i){fixed.LEADING_FILLER_PATTERN}'".replace("\\b", f"(?:$|{EDGE})") + ", ''), '^[ ?.!]+|[ ?.!]+$', '', 'g')"
_TOPICAL = "(regexp_matches({0}, '[^\\x{{0}}-\\x{{2FF}}]') or len(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: not regexp_full_match(w, '" + fixed.TOPICLESS_WORDS + "'))) > 0)"
STATED = {
    "age": "cast(try_cast(coalesce(" + ", ".join(_sql_group("m", p, 1) for p in fixed.AGE_PHRASES) + ") as integer) as varchar)",
    "state": _sql_named("m", fixed.STATES), "income_annual": "cast(coalesce(" + ", ".join(_sql_amount(n, u) for n, u in _MONEY) + ") as varchar)",
    "category": _sql_first("m", fixed.CATEGORIES), "gender": _sql_first("m", fixed.GENDERS)}
ANSWERS = {
    "age": f"case when try_cast({_REPLIED} as integer) between 1 and 120 then cast(cast({_REPLIED} as integer) as varchar) end",
    "state": f"coalesce({_sql_named('m', _NAMES)}, {_sql_first('m', _ALIASES)})",
    "income_annual": f"case when {_UNIT} is not null or {_sql_amount(_PAID, _UNIT)} >= 1000 then cast({_sql_amount(_PAID, _UNIT)} as varchar) end",
    "category": _sql_first("m", fixed.SLOT_CATEGORIES), "gender": _sql_first("m", fixed.SLOT_GENDERS)}


def _mask(prefix: str) -> str:
    return " + ".join(f"case when {prefix}{s} is not null then {1 << i} else 0 end" for i, s in enumerate(fixed.SLOTS))


def _open(closed: str) -> str:
    return "case " + " ".join(f"when ({closed}) & {1 << i} = 0 then {i}" for i in range(len(fixed.SLOTS))) + " end"


def turns_sql(source: str, keys: str, order: str) -> str:
    """CTEs up to ``turns``: what happens at each turn. ``source`` gives keys, order, m, occupation and stored."""
    k = ", ".join(keys.split())
    return f"""with recursive src as materialized ({source}),
    f0 as materialized (select {k}, {order}, row_number() over (partition by {k} order by {order}) as n, m,
        length(m) > {fixed.MAX_MESSAGE_CHARS} or {' or '.join(f"contains(lower(m), '{p}')" for p in tx.INJECTIONS)} as stopped,
        {_sql_first('m', [(name, reply) for name, reply, _ in fixed.TOPICS])} as topic, regexp_full_match(m, '(?i)\\W*(hello\\W*)+') as small, stored,
        {_sql_intent('m', 1, "'unknown'")} as intent, {_sql_intent('m', 3, "'False'")} = 'True' as topic_only,
        case when {_sql_found('m', fixed.TOPIC_CHANGE_PATTERN)} then case when starts_with(lower({_REST}), 'for ') then 'schemes ' || {_REST} else {_REST} end end as change,
        {_sql_found('m', fixed.SKIP_PATTERN)} as skips, {_TOPICAL.format('m')} as topical,
        case when lower(occupation) = 'farmer' then 'agriculture' end as hint,
        {', '.join(f'{v} as is_{s}' for s, v in STATED.items())}, {', '.join(f'{v} as as_{s}' for s, v in ANSWERS.items())} from src),
    f as materialized (select *, {_mask('is_')} as st, {_mask('as_')} as an, coalesce({_TOPICAL.format("coalesce(change, '')")}, false) as change_topical from f0),
    mv({k}, n, mode, known, skipped, fails, topical, action, asked, read, asks) as (
      select distinct {k}, cast(0 as bigint), 'idle', 0, 0, 0, false, '', cast(null as integer), cast(null as integer), '' from f
      union all
      select {k}, n, case when action = 'ask_slot' then 'slot' when action = 'ask_topic' then 'topic' when action = 'stopped' then mode else 'idle' end,
        case when action in ('stopped', 'answer_topic', 'smalltalk') then known else k2 end,
        case when action = 'ask_slot' then sk & ~k2 when action = 'stopped' then skipped else 0 end,
        case when action = 'ask_slot' and slot = a0 then fl when action = 'stopped' then fails else 0 end, case when action = 'stopped' then topical else tp end,
        action, case when action = 'ask_slot' then slot end, case when action not in ('stopped', 'answer_topic', 'smalltalk', 'cached') then rd end,
        case when action in ('stopped', 'answer_topic', 'smalltalk', 'cached', 'other') then '' when branch = 'change' then 'change' when branch = 'fresh' or (branch = 'on' and mode = 'topic') then 'message' else '' end
      from (select *, case phase when 'go' then case when branch = 'other' then 'other' when slot is not null then 'ask_slot' when tp then 'answer_query' when hint is not null then 'answer_hint' else 'ask_topic' end else phase end as action
      from (select *, {_open('k2 | sk')} as slot
      from (select *, case when branch = 'reply' and (skips or fl >= {fixed.MAX_SLOT_FAILURES}) then sk0 | (1 << a0) when branch = 'fresh' and mode <> 'slot' then 0 else sk0 end as sk
      from (select *, case when branch = 'reply' and not skips and rd is null and (k1 >> a0) & 1 = 0 then fails + 1 when branch = 'fresh' then 0 else fails end as fl, k1 | case when rd is not null then 1 << rd else 0 end as k2,
        case branch when 'change' then change_topical when 'fresh' then topical_m when 'on' then case when mode = 'topic' then topical_m else topical end else topical end as tp
      from (select *, case when branch = 'reply' and not skips and (an >> a0) & 1 = 1 then a0 end as rd
      from (select *, case when mode = 'slot' and change is not null then 'change' when mode = 'slot' and kind in ('unknown', 'out_of_scope') then 'reply' when kind = 'eligibility_check' then 'fresh'
          when mode = 'topic' or (mode = 'slot' and fails = 0) then 'on' else 'other' end as branch
      from (select {', '.join(f'mv.{x}' for x in keys.split())}, mv.n + 1 as n, mode, known, mv.fails, mv.topical, mv.skipped, f.* exclude ({k}, n, topical), f.topical as topical_m, known | st as k1,
          case when mode = 'topic' then 31 & ~known else mv.skipped end as sk0, case when mode = 'slot' then {_open('known | mv.skipped')} end as a0,
          case when mode = 'slot' and topic_only then 'unknown' else intent end as kind,
          case when stopped then 'stopped' when mode = 'topic' and f.topic is not null then 'answer_topic' when mode <> 'slot' and small then 'smalltalk' when mode = 'idle' and stored then 'cached' else 'go' end as phase
        from mv join f on {' and '.join(f'mv.{x} = f.{x}' for x in keys.split())} and f.n = mv.n + 1)))))))),
    o as (select f.*, mv.action, mv.asked, mv.fails, mv.read, case mv.asks when 'message' then m when 'change' then change end as q,
          mv.action not in ('stopped', 'smalltalk', 'answer_topic') as heeded from mv join f using ({k}, n)),
    e as (select *, {', '.join(f"coalesce(case when read = {i} then as_{s} end, case when heeded then is_{s} end) as own_{s}" for i, s in enumerate(fixed.SLOTS))} from o),
    turns as (select {k}, {order}, action, case when asked is not null then ({str(fixed.SLOTS)})[asked + 1] end as slot, case when asked is not null then cast(fails as integer) end as failures,
          case when action in ('ask_slot', 'ask_topic', 'answer_query', 'answer_hint') then last(q ignore nulls) over w end as query,
          case action when 'answer_topic' then topic when 'answer_hint' then hint end as topic, m,
          {', '.join(f'last(own_{s} ignore nulls) over w as {s}' for s in fixed.SLOTS)} from e
          window w as (partition by {k} order by n rows between unbounded preceding and current row))"""


CONVERSATIONS = f"""select conv_id, turn, ({LISTED})[(length(coalesce(text, '')) + turn) % {len(PHRASES)} + 1] || case when length(coalesce(text, '')) % 4 = 0 then '. ' || coalesce(text, '') else '' end as m,
    case when conv_id % 3 = 0 then 'Farmer' end as occupation, min(conv_id) over (partition by coalesce(text, '')) < conv_id as stored from conversations"""
EVENTS = f"""select user_id, cast(ts as date) as day, event_id, ({LISTED})[(event_id * 5 + length(props)) % {len(PHRASES)} + 1] as m, case when user_id % 3 = 0 then 'Farmer' end as occupation, event_id % 19 = 0 as stored from events"""
COLUMNS = "action, slot, failures, sha256(query) as query_digest, topic, age, state, income_annual, category, gender"


def _turn_rows(df, *keys):
    return df.select(*keys, "action", "slot", F.col("failures").cast("int").alias("failures"), F.sha2("query", 256).alias("query_digest"), "topic", *fixed.SLOTS)


@query("eli13_session_turns", f"{turns_sql(CONVERSATIONS, 'conv_id', 'turn')} select conv_id, turn, {COLUMNS} from turns")
def session_turns(t):
    return _turn_rows(moved(conversation_turns(t), ["conv_id"], ["turn"]), "conv_id", "turn")


@query("eli13_event_turns", f"{turns_sql(EVENTS, 'user_id day', 'event_id')} select event_id, {COLUMNS} from turns")
def event_turn_rows(t):
    return _turn_rows(moved(event_turns(t), ["user_id", "day"], ["event_id"]), "event_id")


# --- candidates in the user's scope, their verdicts, and the confidence of the answer ---------------
def topic_schemes(t):
    """Up to ``CANDIDATES`` schemes of each topic (null: of any) in each state's scope, its own and the central ones, and over all."""
    label, state = F.expr(TOPIC_TEXT), _home()
    topics = F.array(F.lit("any"), *[F.when(rules.matches_topic(label, F.lit(n)), F.lit(n)) for n, _, _ in fixed.TOPICS])
    rows = t.part.select(F.col("p_partkey").alias("scheme_id"), state.alias("home"), F.explode(F.array_compact(topics)).alias("about"))

    def best(df, *scope):
        place = F.row_number().over(W.partitionBy("about", *scope).orderBy("scheme_id"))
        return df.withColumn("_r", place).filter(F.col("_r") <= CANDIDATES).drop("_r")

    states = F.explode(F.array(*[F.lit(s) for s in fixed.STATES]))
    central = best(rows.filter("home is null")).select("about", "scheme_id", states.alias("scope"))
    own = best(rows.filter("home is not null"), "home").select("about", "scheme_id", F.col("home").alias("scope"))
    everywhere = best(rows).select("about", "scheme_id", F.lit("").alias("scope"))
    return best(own.unionByName(central), "scope").unionByName(everywhere)


def _home():
    """The state of a part's scheme: most have that of their condition, a third and the last states' are central."""
    state = F.element_at(F.array(*[F.lit(s) for s in fixed.STATES]), (F.col("p_partkey") % 34 + 1).cast("int"))
    return F.when((F.col("p_partkey") % 3 != 0) & (F.col("p_partkey") % 34 < 30), state)


def answers(t, turns, keys):
    """Answered turns with what was found and shown, the confidence, and the state to note when it has no schemes of its own."""
    asked = stored(turns.filter(F.startswith("action", F.lit("answer_"))), "answered")  # used twice
    by_topic = F.col("topic").isNotNull()
    about = F.coalesce("topic", rules.topic_of_reply(F.coalesce("query", F.lit(""))), F.lit("any"))
    scope = F.coalesce("state", F.lit(""))
    scopes = F.when(by_topic, F.array(scope)).otherwise(F.array_distinct(F.array(F.lit(""), scope)))
    wanted = asked.withColumns({"about": about, "scope": F.explode(scopes)})
    pairs = wanted.join(topic_schemes(t), ["about", "scope"]).select(*keys, "scheme_id", *fixed.SLOTS).distinct()
    none = F.lit(None).cast("boolean")
    profile = F.struct(F.col("age").cast("int").alias("age"), "gender", "state", F.col("income_annual").cast("double").alias("income_annual"), "category",
                       none.alias("disability"), F.lit(False).alias("is_ex_serviceman"))
    compiled = verdicts.compile_schemes(eli.schemes(t)).select("scheme_id", "conditions", "exclusions")
    judged = verdicts.judge(pairs.join(compiled, "scheme_id").select(*keys, "conditions", "exclusions", profile.alias("profile"))).select(*keys, "status")
    homes = topic_homes(t)
    done = dialogue.turn_answers(asked, keys, judged).join(homes, F.col("state") == F.col("home"), "left")
    return done.select(*keys, "action", "topic", F.col("found").cast("long").alias("found"), "shown", "confidence",
                       F.when(by_topic & F.col("home").isNull(), F.col("state")).alias("stateless"))


def topic_homes(t):
    """States with schemes of their own."""
    return t.part.select(_home().alias("home")).filter("home is not null").distinct()


def answers_sql(source: str, keys: str, order: str) -> str:
    k = ", ".join([*keys.split(), order])
    hits = ", ".join(f"case when {_sql_found(f'({TOPIC_TEXT})', p)} then '{n}' end" for n, _, p in fixed.TOPICS)
    wants = f"({_sql_found('{0}', fixed.NOT_ELIGIBLE_PATTERN)} and {_sql_found('{0}', fixed.SHOW_PATTERN)})"
    mine = f"""w as (select *, row_number() over () as tid, coalesce({wants.replace('{0}', 'query')}, false) or {wants.replace('{0}', 'm')} as wants_not,
        coalesce(topic, {_sql_first("coalesce(query, '')", [(n, r) for n, r, _ in fixed.TOPICS])}, 'any') as about from turns where starts_with(action, 'answer_')),
    sch as (select p_partkey as scheme_id, case when p_partkey % 3 <> 0 and p_partkey % 34 < 30 then ({eli.STATES_SQL})[p_partkey % 34 + 1] end as home, unnest(['any', {hits}]) as about from part),
    sc as (select about, scheme_id, unnest(case when home is null then list_append({eli.STATES_SQL}, '') else [home, ''] end) as scope from sch where about is not null),
    best as (select * from sc qualify row_number() over (partition by about, scope order by scheme_id) <= {CANDIDATES}),
    p as (select tid as profile_id, try_cast(age as integer) as age, gender, state, cast(income_annual as double) as income, category, cast(null as boolean) as disability from w),
    s as (select p_partkey as scheme_id, p_size as z, p_partkey as k, ({eli.STATES_SQL})[p_partkey % 34 + 1] as st from part),
    cand as (select distinct tid as profile_id, best.scheme_id from w join best on best.about = w.about and (best.scope = coalesce(state, '') or (topic is null and best.scope = '')))"""
    judged = eli.ASSESSED.replace(eli.PROFILES, mine)
    assert mine in judged
    return f"""{turns_sql(source, keys, order)}, {judged},
    cnt as (select profile_id as tid, count(*) filter (status = 'eligible') as e, count(*) filter (status = 'may') as y, count(*) filter (status = 'not') as x from r group by 1),
    j as (select w.*, coalesce(e, 0) as e, coalesce(y, 0) as y, coalesce(x, 0) as x from w left join cnt using (tid)),
    g as (select *, least(case when wants_not or e + y = 0 then e + y + x else e + y end, {fixed.MAX_SCHEMES_SHOWN}) as shown from j)
    select {k}, action, topic, e + y + x as found, shown, case when e + y + x = 0 then 'low' when e >= shown then 'high' else 'medium' end as confidence,
      case when topic is not null and state not in (select home from sch where home is not null) then state end as stateless from g"""


@query("eli13_session_answers", answers_sql(CONVERSATIONS, "conv_id", "turn"))
def session_answers(t):
    return answers(t, moved(conversation_turns(t), ["conv_id"], ["turn"]), ["conv_id", "turn"])


@query("eli13_event_answers", answers_sql(EVENTS, "user_id day", "event_id").replace("select user_id, day, event_id, action, topic, e + y", "select event_id, action, topic, e + y"))
def event_answers(t):
    return answers(t, moved(event_turns(t), ["user_id", "day"], ["event_id"]), ["event_id"])


# --- sessions that expire --------------------------------------------------------------------------
def session_rows(events):
    """Events as turns with what their answers cite: up to seven names, of which five are remembered."""
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", _said(F.col("event_id") * 5 + F.length("props"), F.lit("")).alias("message"))
    hint = rules.topic_hint(F.when(F.col("user_id") % 3 == 0, F.lit("Farmer")), F.lit(False))
    said = dialogue.read_turns(rows, "message", hint, F.col("event_id") % 19 == 0)
    names = F.when(F.col("event_type") == "view", F.transform(F.sequence(F.lit(0), (F.col("event_id") % 8).cast("int")), lambda i: F.concat(F.lit("S"), i + F.col("event_id"))))
    return said.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("turn"), F.col("_code").alias("code"), F.slice(names, 2, 8).alias("cited"),
                       F.col("event_type").alias("said"), F.col("event_type").alias("intent"), (F.col("event_id") % 3 == 0).alias("question"))


GAP = 12 * 3600
STAMPED = f"""select *, sum(case when before is null or ts - before > interval {GAP} second then 1 else 0 end) over (partition by user_id order by ts, event_id) as session
    from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events)"""
NUMBERED = f"""select user_id, cast(session as bigint) as session, row_number() over (partition by user_id, session order by ts, event_id) as turn_no, event_id,
    ({LISTED})[(event_id * 5 + length(props)) % {len(PHRASES)} + 1] as m, case when user_id % 3 = 0 then 'Farmer' end as occupation, event_id % 19 = 0 as stored from ({STAMPED})"""
SESSIONS = f"""{turns_sql(NUMBERED.replace('turn_no, event_id,', 'turn_no,'), 'user_id session', 'turn_no')},
    x as (select *, row_number() over w as turn_no, case when event_type = 'view' and event_id % 8 > 0 then list_transform(range(1, event_id % 8 + 1), lambda i: 'S' || (event_id + i))[1:5] end as c from ({STAMPED})
        window w as (partition by user_id, session order by ts, event_id))
    select cast(user_id as varchar) as key, epoch_us(min(ts) over (partition by user_id, session)) as started, event_id as turn, turn_no, action, slot, failures,
      coalesce(array_to_string(last(c ignore nulls) over (w rows between unbounded preceding and 1 preceding), ','), '') as remembered,
      coalesce(string_agg(event_type, ',') over (w rows between 6 preceding and 1 preceding), '') as recent, lag(event_type) over w as last_intent,
      lag(event_id % 3 = 0) over w as was_question from x join turns using (user_id, session, turn_no) {{where}} window w as (partition by user_id, session order by ts, event_id)"""


def _stamped(df):
    return df.withColumn("started", F.unix_micros(F.col("started").cast("timestamp")))


@query("str2_expiring_sessions", SESSIONS.replace("{where}", ""))
def expiring_sessions(t):
    from docweave.streaming.sessions import dialogue_sessions

    return _stamped(dialogue_sessions(session_rows(t.events), GAP))


@query("str3_expiring_sessions_stream", f"select * exclude (seen, newest) from (select s.*, epoch_ms(e.ts) as seen, (select epoch_ms(max(ts)) from events) as newest from ({SESSIONS.replace('{where}', '')}) s join events e on e.event_id = s.turn) where seen < newest - 600000")
def expiring_sessions_stream(t):
    """The turns that the watermark has passed; a stream sees the same sessions as the whole table."""
    from docweave.catalog.streams import Streams
    from docweave.streaming.files import work_folder
    from docweave.streaming.sessions import dialogue_stream

    return _stamped(dialogue_stream(session_rows(Streams(t).events), work_folder(t.spark, "dialogue"), GAP))
