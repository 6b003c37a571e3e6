"""Eligibility rules over customers as profiles and parts as schemes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave import fixed
from docweave.catalog.registry import query
from docweave.functions import eligibility as el
from docweave.operators import verdicts

STATES_SQL = "[" + ", ".join(f"'{s}'" for s in fixed.STATES) + "]"
AGE = """case p_size % 6 when 0 then 'Age between ' || p_size || ' and ' || (p_size + 20) || ' years' when 1 then 'Applicant not exceeding ' || (p_size + 30) || ' years'
    when 2 then 'Minimum age of ' || p_size when 3 then 'Persons below ' || (p_size + 18) || ' years' when 4 then 'Persons above ' || p_size || ' years'
    else 'Age proof gets priority' end"""
INCOME = """case p_partkey % 5 when 0 then 'Family income not exceeding Rs. ' || (p_size * 100) when 1 then 'Income above Rs. 5,000' when 2 then 'BPL households only'
    when 3 then 'Income certificate is needed' else 'Earning less than 3.5 lakh' end"""
CATEGORY = """case p_size % 4 when 0 then 'Scheduled Caste applicants' when 1 then 'Women entrepreneurs' when 2 then 'Not eligible: OBC persons' else 'Persons with disability' end"""
PLACE = "case when p_partkey % 3 <> 0 then 'Resident of ' else 'Applicants from outside ' end"
EXCLUSION = "case p_size % 3 when 1 then 'Applicants with income up to Rs. 500' when 2 then 'General category applicants' end"


def schemes(t):
    """Four conditions and up to one exclusion per part, built as texts and read back by the rules."""
    state = F.element_at(F.array(*[F.lit(s) for s in fixed.STATES]), (F.col("p_partkey") % 34 + 1).cast("int"))
    conditions = F.array(F.expr(AGE), F.expr(INCOME), F.expr(CATEGORY), F.concat(F.expr(PLACE), state))
    return t.part.select(F.col("p_partkey").alias("scheme_id"), conditions.alias("conditions"), F.array_compact(F.array(F.expr(EXCLUSION))).alias("exclusions"))


def profiles(t):
    c = t.customer
    key = F.col("c_custkey")
    gender = F.when(key % 3 == 0, "Female").when(key % 3 == 1, "male")
    category = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "SC").when(F.col("c_mktsegment") == "BUILDING", "obc").when(F.col("c_mktsegment") == "FURNITURE", "general").when(
        F.col("c_mktsegment") == "MACHINERY", "st")
    state = F.element_at(F.array(*[F.lit(s) for s in fixed.STATES]), F.col("c_nationkey") + 1)
    return c.select(
        key.alias("profile_id"), F.when(key % 10 != 0, 18 + key % 60).cast("int").alias("age"), gender.alias("gender"),
        F.when(key % 4 != 0, state).alias("state"), F.when(key % 7 != 0, F.col("c_acctbal")).alias("income_annual"), category.alias("category"),
        F.when(gender.isNotNull(), F.col("c_acctbal") < 0).alias("disability"), F.lit(False).alias("is_ex_serviceman"))


def candidates(t):
    """Schemes a profile is compared with: the parts its customer ordered."""
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return bought.select(F.col("o_custkey").alias("profile_id"), F.col("l_partkey").alias("scheme_id")).distinct()


PROFILES = f"""p as (select c_custkey as profile_id, case when c_custkey % 10 <> 0 then 18 + c_custkey % 60 end as age, case c_custkey % 3 when 0 then 'female' when 1 then 'male' end as gender,
      case when c_custkey % 4 <> 0 then ({STATES_SQL})[c_nationkey + 1] end as state, case when c_custkey % 7 <> 0 then c_acctbal end as income,
      case c_mktsegment when 'AUTOMOBILE' then 'sc' when 'BUILDING' then 'obc' when 'FURNITURE' then 'general' when 'MACHINERY' then 'st' end as category,
      case when c_custkey % 3 < 2 then c_acctbal < 0 end as disability from customer),
    s as (select p_partkey as scheme_id, p_size as z, p_partkey as k, ({STATES_SQL})[p_partkey % 34 + 1] as st from part),
    cand as (select distinct o_custkey as profile_id, l_partkey as scheme_id from orders join lineitem on o_orderkey = l_orderkey)"""


def _judge(known: str, holds: str) -> str:
    return f"case when not ({known}) then 'unverifiable' when {holds} then 'pass' else 'fail' end"


VERDICTS = f"""{PROFILES},
    v as (select profile_id, scheme_id, p.*, s.*,
      case when age is null or z % 6 = 5 then 'unverifiable' when case z % 6 when 0 then age between z and z + 20 when 1 then age <= z + 30 when 2 then age >= z when 3 then age < z + 18 else age > z end
        then 'pass' else 'fail' end as v1,
      case when k % 5 in (2, 3) or income is null then 'unverifiable' when income <= case k % 5 when 0 then z * 100 when 1 then 5000 else 350000 end then 'pass' else 'fail' end as v2,
      case z % 4 when 0 then {_judge('category is not null', "category = 'sc'")} when 1 then {_judge('gender is not null', "gender = 'female'")}
        when 2 then {_judge('category is not null', "category <> 'obc'")} else {_judge('disability is not null', 'disability')} end as v3,
      {_judge('state is not null', '(state = st) = (k % 3 <> 0)')} as v4,
      case z % 3 when 1 then {_judge('income is not null', 'income <= 500')} when 2 then {_judge('category is not null', "category = 'general'")} end as x
    from cand join p using (profile_id) join s using (scheme_id))"""
ASSESSED = f"""{VERDICTS},
    a as (select *, not ('fail' in (v1, v2, v3, v4) or coalesce(x, '') = 'pass') as eligible, cast((v1 = 'pass')::int + (v2 = 'pass')::int + (v3 = 'pass')::int + (v4 = 'pass')::int as bigint) as reasons,
      cast((v1 = 'unverifiable')::int + (v2 = 'unverifiable')::int + (v3 = 'unverifiable')::int + (v4 = 'unverifiable')::int + (coalesce(x, '') = 'unverifiable')::int as bigint) as open_conditions,
      cast((v1 = 'fail')::int + (v2 = 'fail')::int + (v3 = 'fail')::int + (v4 = 'fail')::int + (coalesce(x, '') = 'pass')::int as bigint) as failed,
      concat_ws(',', case when age is null and v1 = 'unverifiable' then 'age' end, case when state is null and v4 = 'unverifiable' then 'state' end,
        case when income is null and ((v2 = 'unverifiable' and k % 5 <> 4) or (z % 3 = 1 and x = 'unverifiable')) then 'income_annual' end,
        case when category is null and ((v3 = 'unverifiable' and z % 4 in (0, 2)) or (z % 3 = 2 and x = 'unverifiable')) then 'category' end,
        case when gender is null and v3 = 'unverifiable' and z % 4 = 1 then 'gender' end) as missing from v),
    r as (select *, case when not eligible then 'not' when open_conditions > 0 or missing <> '' or reasons = 0 then 'may' else 'eligible' end as status from a)"""


def _pairs(t):
    pairs = candidates(t).join(profiles(t).select("profile_id", F.struct(*verdicts.PROFILE).alias("profile")), "profile_id")
    return pairs.join(verdicts.compile_schemes(schemes(t)), "scheme_id")


def _single(index: int, check):
    def build(t):
        rule = F.get("conditions", F.lit(index))["rule"]
        return _pairs(t).select("profile_id", "scheme_id", F.coalesce(check(rule, F.col("profile")), F.lit("none")).alias("verdict"))

    return build


query("eli1_age_check", f"with {VERDICTS} select profile_id, scheme_id, case when z % 6 = 5 or (z % 6 = 0 and age is null) then 'none' else v1 end as verdict from v")(_single(0, el.age_verdict))
query("eli2_income_check", f"with {VERDICTS} select profile_id, scheme_id, v2 as verdict from v")(_single(1, el.income_verdict))
query("eli3_category_check", f"with {VERDICTS} select profile_id, scheme_id, v3 as verdict from v")(_single(2, el.category_verdict))
query("eli4_state_check", f"with {VERDICTS} select profile_id, scheme_id, v4 as verdict from v")(_single(3, el.state_verdict))


@query("eli5_condition_verdicts", f"""
    with {VERDICTS} select profile_id, scheme_id, cast(unnest([0, 1, 2, 3]) as bigint) as pos, unnest([v1, v2, v3, v4]) as verdict from v""")
def condition_verdicts(t):
    rows = _pairs(t).select("profile_id", "scheme_id", F.posexplode(F.transform("conditions", lambda c: el.verdict(c["rule"], F.col("profile")))).alias("pos", "verdict"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def assessed(t):
    return verdicts.assess_candidates(candidates(t).withColumn("rank", F.col("scheme_id")), profiles(t), schemes(t))


@query("eli6_scheme_verdicts", f"with {ASSESSED} select profile_id, scheme_id, eligible, reasons, failed, open_conditions from r")
def scheme_verdicts(t):
    return assessed(t).select("profile_id", "scheme_id", "eligible", F.size("reasons").cast("long").alias("reasons"),
                              F.size("failed_conditions").cast("long").alias("failed"), F.size("unverifiable_conditions").cast("long").alias("open_conditions"))


@query("eli8_missing_fields", f"with {ASSESSED} select profile_id, scheme_id, missing from r")
def missing_fields(t):
    return assessed(t).select("profile_id", "scheme_id", F.array_join("missing", ",").alias("missing"))


@query("eli9_status", f"with {ASSESSED} select status, count(*) as pairs from r group by 1")
def statuses(t):
    return assessed(t).groupBy("status").agg(F.count(F.lit(1)).alias("pairs"))


SHOWN = f"""{ASSESSED},
    o as (select *, row_number() over (partition by profile_id order by case when status = 'not' then 1 else 0 end, case status when 'eligible' then 0 else 1 end,
        case when status = 'not' then 0 else open_conditions end, scheme_id) as place, count(*) filter (status <> 'not') over (partition by profile_id) as good,
        count(*) filter (status = 'not') over (partition by profile_id) as bad from r)"""


@query("eli10_shown_entries", f"""
    with {SHOWN} select profile_id, place, scheme_id, status, case when good > 0 then bad else 0 end as hidden from o where place <= 5 and (status <> 'not' or good = 0)""")
def shown_entries(t):
    return verdicts.select_shown(assessed(t), "rank").select("profile_id", "place", "scheme_id", "status", "hidden")


@query("eli10_shown_with_rejected", f"with {SHOWN} select profile_id, place, scheme_id, status, cast(0 as bigint) as hidden from o where place <= 5")
def shown_with_rejected(t):
    return verdicts.select_shown(assessed(t), "rank", show_not=True).select("profile_id", "place", "scheme_id", "status", "hidden")


@query("joi15_profile_scheme_conditions", f"""
    with {PROFILES} select profile_id, count(*) as conditions from cand group by 1""".replace("count(*) as conditions", "count(*) * 4 as conditions"))
def profile_conditions(t):
    rows = candidates(t).join(schemes(t), "scheme_id").select("profile_id", F.explode("conditions").alias("condition"))
    return rows.groupBy("profile_id").agg(F.count(F.lit(1)).alias("conditions"))


@query("joi15_profile_condition_rows", f"""
    with {PROFILES} select profile_id, scheme_id, age, state, unnest(['age', 'income', 'category', 'state']) as about,
      unnest([{AGE.replace('p_size', 'z').replace('p_partkey', 'k')}, {INCOME.replace('p_size', 'z').replace('p_partkey', 'k')}, {CATEGORY.replace('p_size', 'z')}, {PLACE.replace('p_partkey', 'k')} || st]) as condition
    from cand join p using (profile_id) join s using (scheme_id)""")
def profile_condition_rows(t):
    """Every candidate pair with its profile and each condition's text."""
    listed = schemes(t).select("scheme_id", "conditions")
    known = profiles(t).select("profile_id", F.col("age").cast("long").alias("age"), "state")
    rows = candidates(t).join(known, "profile_id").join(listed, "scheme_id").select("profile_id", "scheme_id", "age", "state", F.posexplode("conditions").alias("i", "condition"))
    about = F.element_at(F.array(*[F.lit(x) for x in ("age", "income", "category", "state")]), F.col("i") + 1)
    return rows.select("profile_id", "scheme_id", "age", "state", about.alias("about"), "condition")


@query("eli7_display_conditions", r"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
    t as (select doc_id, i, trim(regexp_replace(raw, '\s+', ' ', 'g')) as t from l),
    c as (select doc_id, i, case when length(t) > 160 then rtrim(left(t, 120)) || '...' else t end as c from t
      where length(t) >= 10 and not regexp_matches(t, '^[^\p{L}\p{N}]+$') and not regexp_matches(t, '\?$') and not contains(t, '...')
        and not regexp_matches(regexp_replace(t, '^[\s\-•*\d.)(:]+', ''), '(?i)^(?:note|step|obligation|what|how|whether|can)($|[^\p{L}\p{N}_])')),
    d as (select doc_id, c, i from c qualify row_number() over (partition by doc_id, lower(c) order by i) = 1)
    select doc_id, count(*) as shown, sha256(string_agg(c, '|' order by i)) as digest from d group by doc_id""")
def display_conditions(t):
    shown = F.filter(F.transform(F.split("text", "\n"), lambda x: el.display_form(x)), lambda x: x.isNotNull())
    rows = t.documents.select("doc_id", el.distinct_nocase(shown).alias("c")).filter(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("long").alias("shown"), F.sha2(F.array_join("c", "|"), 256).alias("digest"))


@query("eli11_benefit_line")
def benefit_lines(t):
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", el.benefit_line(F.concat(F.lit("Pattern of Assistance: "), F.get(lines, F.lit(0))), lines).alias("line"))


FOUND = """case c_mktsegment when 'AUTOMOBILE' then 'S.C' when 'BUILDING' then ' MBC ' when 'FURNITURE' then 'Gen' when 'MACHINERY' then 'Scheduled  Tribe' else 'none' end"""
TEXT = """'Certificate. ' || case c_custkey % 3 when 0 then 'Community: BC. ' when 1 then 'Caste: General. Scheduled Tribe. ' else 'nothing ' end || case c_custkey % 2 when 0 then 'S/O Ram. ' else 'Smt. Devi. ' end || 'works as weaver'"""


@query("eli14_grounded_fields", """
    select c_custkey, case when c_mktsegment = 'BUILDING' and c_custkey % 3 = 0 then 'obc' when c_mktsegment = 'FURNITURE' and c_custkey % 3 = 1 then 'general'
        when c_mktsegment = 'MACHINERY' and c_custkey % 3 = 1 then 'st' end as category,
      case when c_acctbal > 0 and c_custkey % 2 = 0 then 'male' when c_acctbal <= 0 and c_custkey % 2 = 1 then 'female' end as gender,
      case when c_nationkey > 5 then 'hand weaver' end as occupation from customer""")
def grounded(t):
    gender = F.when(F.col("c_acctbal") > 0, "M").otherwise("Woman")
    job = F.when(F.col("c_nationkey") > 5, "  Hand   Weaver ").otherwise("shop")
    return t.customer.select("c_custkey", el.grounded_fields(F.expr(TEXT), F.expr(FOUND), gender, job).alias("g")).select("c_custkey", "g.*")


@query("eli15_profile_autofill", """
    with s as (select *, (c_custkey % 100) / 100.0 as sc from customer)
    select c_custkey, case when c_custkey % 3 <> 0 and sc >= 0.5 then 40 else 20 end as age, case when sc >= 0.85 and c_custkey % 3 <> 0 then 'age,income_annual' when sc >= 0.85 then 'income_annual' else '' end as filled,
      case when sc >= 0.5 and sc < 0.85 then case when c_custkey % 3 <> 0 then 'age,income_annual' else 'income_annual' end else '' end as confirm,
      case when sc < 0.5 then 'age,income_annual,' when c_custkey % 3 = 0 then 'age,' else '' end || 'category,state,gender,occupation' as failed from s""")
def profile_autofill(t):
    score = (F.col("c_custkey") % 100) / 100.0
    none = F.lit(None).cast("string")
    found = {"age": F.when(F.col("c_custkey") % 3 != 0, F.lit(40)), "income_annual": F.col("c_acctbal"), "category": none, "state": none, "gender": none, "occupation": none}
    old = {"age": F.lit(20), "income_annual": F.lit(0.0), "category": none, "state": none, "gender": none, "occupation": none}
    merged = t.customer.select("c_custkey", el.autofill(found, {f: score for f in el.AUTOFILL_FIELDS}, old).alias("a"))
    return merged.select("c_custkey", "a.age", F.array_join("a.high_confidence_fills", ",").alias("filled"),
                         F.array_join("a.needs_confirmation", ",").alias("confirm"), F.array_join("a.failed_fields", ",").alias("failed"))


@query("eli13_turn_confidence", f"""
    with {SHOWN}, k as (select profile_id, bool_and(status = 'eligible') as all_good, count(*) as shown from o where place <= 5 and (status <> 'not' or good = 0) group by 1)
    select profile_id, shown, case when all_good then 'high' else 'medium' end as confidence from k""")
def turn_confidence(t):
    return verdicts.select_shown(assessed(t), "rank").groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("shown"), F.when(F.bool_and(F.col("status") == "eligible"), "high").otherwise("medium").alias("confidence"))


@query("set3_state_unions", f"""
    select p_partkey, case when p_size = 1 or p_partkey % 34 = p_size % 34 then ({STATES_SQL})[p_partkey % 34 + 1] else ({STATES_SQL})[p_size % 34 + 1] || '|' || ({STATES_SQL})[p_partkey % 34 + 1] end as states from part""")
def state_unions(t):
    from docweave.functions.rules import states_in

    listed = F.array(*[F.lit(s) for s in fixed.STATES])
    name = F.when(F.col("p_size") == 1, F.lit("Goal oriented")).otherwise(F.concat(F.lit("X - "), F.element_at(listed, F.col("p_size") % 34 + 1)))
    text = F.concat(F.lit("Resident of "), F.element_at(listed, (F.col("p_partkey") % 34 + 1).cast("int")))
    return t.part.select("p_partkey", F.array_join(F.array_union(states_in(name), states_in(text)), "|").alias("states"))
