"""Eligibility rules: condition texts are read once into typed rules, rules are applied to profiles.

Reading (regular expressions) happens on the scheme side, once per condition. Applying a rule to a
profile is arithmetic on the parsed fields, so the profile x scheme join carries no text matching.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docweave import fixed
from docweave.functions import text as tx
from docweave.functions.rules import _found, _texts, amount
from docweave.functions.text import first_contained, first_label, let, nocase


def _number(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col, nocase(pattern), group).try_cast("long")  # no match: an empty text, which is no number


def read_age(text: Column) -> Column:
    """{lo, hi, silent, bare}: inclusive bounds; ``silent`` rules say nothing about an unknown age.

    A pattern is tried only where letters occur that each of its matches has; of these letters no other case form exists.
    """
    none = F.lit(None).cast("long")

    def rule(lo: Column, hi: Column, silent: bool = False, bare: bool = False) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(silent).alias("silent"), F.lit(bare).alias("bare"))

    def read(t: Column) -> Column:
        def number(pattern: str, use, group: int = 1) -> Column:
            return let(_number(t, pattern, group), lambda n: F.when(n.isNotNull(), use(n)))

        def named(letters: str, pattern: str, use) -> Column:
            return F.when(F.contains(t, F.lit(letters)), number(pattern, use))

        between = r"between\s*(\d+)\s*(?:and|-)\s*(\d+)\s*years?"
        found = F.coalesce(
            named("between", between, lambda low: number(between, lambda high: rule(low, high, silent=True), 2)),
            named("exceed", r"not\s*exceeding\s*(\d+)\s*years?", lambda n: rule(none, n)),
            named("mum", r"minimum\s*age(?:\s*of)?\s*(\d+)", lambda n: rule(n, none)),
            named("below", r"below\s*(\d+)\s*years?", lambda n: rule(none, n - 1)),
            named("above", r"above\s*(\d+)\s*years?", lambda n: rule(n + 1, none)),
            F.when(_found(t, r"\bage\b"), rule(none, none, bare=True)))
        return F.when(~_found(t, fixed.NO_THRESHOLD_PATTERN), found)

    return let(F.lower(text), read)


def read_income(text: Column) -> Column:
    """{cap}: a null cap is a rule that cannot be checked. "Above x" counts as a cap too."""
    unknown = F.lit(None).cast("double")

    def read(t: Column) -> Column:
        def cap(words: str) -> tuple[Column, Column]:
            figure, unit = r"([\d,]+(?:\.\d+)?)", r"(lakh|lakhs|crore|crores)"
            pattern = rf"(?:{words})\s*(?:rs\.?|₹)\s*{figure}\s*{unit}?|(?:{words})\s*{figure}\s*{unit}"

            def either(first: int) -> Column:
                return let(F.regexp_extract(t, nocase(pattern), first), lambda x: F.when(x != "", x).otherwise(F.regexp_extract(t, nocase(pattern), first + 2)))

            value = let(F.struct(either(1).alias("n"), either(2).alias("u")), lambda x: amount(x["n"], x["u"], fixed.UNITS))
            return F.rlike(t, F.lit(r"(?U)[\d,]")) & _found(t, pattern), value  # every figure has a digit or a comma

        over, over_cap = cap(fixed.INCOME_OVER)
        under, under_cap = cap(fixed.INCOME_UNDER)
        return (
            F.when(_found(t, r"\bbpl\b|\bapl\b"), F.struct(unknown.alias("cap")))
            .when(over, F.struct(over_cap.alias("cap")))
            .when(under, F.struct(under_cap.alias("cap")))
            .when(_found(t, r"\bincome\b"), F.struct(unknown.alias("cap"))))

    return let(F.lower(text), read)


def read_rule(text: Column, states: list[str] | None = None) -> Column:
    """Everything the verdict needs from one condition text."""
    return F.struct(
        read_age(text).alias("age"), read_income(text).alias("income"),
        first_label(text, fixed.RULE_CATEGORIES).alias("category"),
        first_contained(text, states or fixed.STATES).alias("state"),
        _found(text, fixed.NEGATION_PATTERN).alias("negated"))


def _judge(known: Column, holds: Column) -> Column:
    return F.when(~known, F.lit("unverifiable")).when(holds, F.lit("pass")).otherwise(F.lit("fail"))


def age_verdict(rule: Column, p: Column) -> Column:
    r, age = rule["age"], p["age"]
    inside = (r["lo"].isNull() | (age >= r["lo"])) & (r["hi"].isNull() | (age <= r["hi"]))
    return (F.when(r.isNull(), None).when(r["bare"], F.lit("unverifiable"))
            .when(age.isNull() & r["silent"], None).otherwise(_judge(age.isNotNull(), inside)))


def income_verdict(rule: Column, p: Column) -> Column:
    r = rule["income"]
    return F.when(r.isNotNull(), _judge(r["cap"].isNotNull() & p["income_annual"].isNotNull(), p["income_annual"] <= r["cap"]))


def category_verdict(rule: Column, p: Column) -> Column:
    c, negated = rule["category"], rule["negated"]

    def side(value: Column, holds: Column) -> Column:
        return _judge(value.isNotNull(), holds != negated)

    return (
        F.when(c.isNull(), None)
        .when(c == "women", side(p["gender"], F.lower(p["gender"]) == "female"))
        .when(c == "differently abled", side(p["disability"], p["disability"]))
        .when(c == "ex-serviceman", side(p["is_ex_serviceman"], p["is_ex_serviceman"]))
        .otherwise(side(p["category"], F.lower(p["category"]) == c)))


def state_verdict(rule: Column, p: Column) -> Column:
    s = rule["state"]
    return F.when(s.isNotNull(), _judge(p["state"].isNotNull(), (F.lower(p["state"]) == F.lower(s)) != rule["negated"]))


def verdict(rule: Column, profile: Column) -> Column:
    """pass, fail or unverifiable; nothing recognised is unverifiable."""

    def combine(v: Column) -> Column:
        return (F.when(F.array_contains(v, "fail"), "fail").when(F.array_contains(v, "unverifiable"), "unverifiable")
                .when(F.array_contains(v, "pass"), "pass").otherwise("unverifiable"))

    checks = F.array(age_verdict(rule, profile), income_verdict(rule, profile), category_verdict(rule, profile), state_verdict(rule, profile))
    return let(checks, combine)


# --- displayable conditions -----------------------------------------------------------------
def display_form(col: Column) -> Column:
    """A condition worth showing, shortened when long; null for fragments, questions and boilerplate."""

    def form(text: Column) -> Column:
        own_cut = ((F.length(text) == fixed.REASON_LIMIT + 3) & F.endswith(text, F.lit("..."))
                   & ~F.contains(F.left(text, F.length(text) - 3), F.lit("...")))
        boilerplate = let(F.regexp_replace(text, fixed.LEADING_MARK_PATTERN, ""),
                          lambda body: _found(body, fixed.BOILERPLATE_PATTERN) | F.endswith(body, F.lit("?")))
        usable = (text != "") & ~tx.is_junk(text) & ~(F.contains(text, F.lit("...")) & ~own_cut) & ~boilerplate
        cut = F.concat(F.rtrim(F.left(text, F.lit(fixed.REASON_LIMIT))), F.lit("..."))
        return F.when(usable, F.when(F.length(text) > fixed.CONDITION_LIMIT, cut).otherwise(text))

    return let(tx.squeeze(F.coalesce(col, F.lit(""))), form)


def distinct_nocase(listed: Column) -> Column:
    """Distinct ignoring case, first spelling kept, in order."""
    return let(listed, lambda a: let(F.transform(a, lambda x: F.lower(x)), lambda keys: F.filter(
        a, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)))


def compile_conditions(texts: Column, states: list[str] | None = None) -> Column:
    """Conditions as rules plus every text form that a verdict may need to show."""
    mentions = {**fixed.MISSING_PATTERNS}
    mentions["state"] += "|" + "|".join(map(tx.literal, states or fixed.STATES))

    def shown(text: Column) -> Column:
        return let(tx.shorten(text), lambda t: F.when(~tx.is_junk(t), t))

    def one(text: Column) -> Column:
        def finish(open_text: Column, display: Column) -> Column:
            return F.struct(
                text.alias("text"), read_rule(text, states).alias("rule"),
                shown(F.concat(F.lit("Meets condition: "), text)).alias("met"), shown(F.concat(F.lit("Excluded: "), text)).alias("excluded"),
                shown(text).alias("failed"), open_text.alias("open"), display.alias("display"),
                F.array_compact(F.array(*[F.when(_found(display, mentions[f]), F.lit(f)) for f in fixed.SLOTS])).alias("mentions"))

        return let(F.when(~tx.is_junk(text), tx.shorten(text)), lambda open_text: let(display_form(open_text), lambda display: finish(open_text, display)))

    return F.transform(texts, one)


def judged(listed: Column, profile: Column) -> Column:
    """Compiled conditions as {c, v}: each with the verdict of a profile."""
    return F.transform(listed, lambda c: F.struct(c.alias("c"), verdict(c["rule"], profile).alias("v")))


def unverified(cond: Column, excl: Column) -> Column:
    return F.filter(F.concat(cond, excl), lambda r: r["v"] == "unverifiable")


def facts(cond: Column, excl: Column, open_rows: Column, profile: Column) -> dict[str, Column]:
    """What judged conditions and exclusions, and those of them that are ``unverified``, say of one profile on one scheme."""

    def pick(rows: Column, result: str, field: str) -> Column:
        return F.filter(F.transform(F.filter(rows, lambda r: r["v"] == result), lambda r: r["c"][field]), lambda x: x.isNotNull())

    def shown(field: str) -> Column:
        return F.filter(F.transform(open_rows, lambda r: r["c"][field]), lambda x: x.isNotNull())

    mentioned = F.flatten(F.transform(open_rows, lambda r: r["c"]["mentions"]))
    return {
        "eligible": ~F.exists(cond, lambda r: r["v"] == "fail") & ~F.exists(excl, lambda r: r["v"] == "pass"),
        "reasons": pick(cond, "pass", "met"),
        "failed_conditions": F.concat(pick(cond, "fail", "failed"), pick(excl, "pass", "excluded")),
        "unverifiable_conditions": shown("open"), "conditions": distinct_nocase(shown("display")),
        "missing": let(mentioned, lambda m: F.array_compact(F.array(*[F.when(profile[f].isNull() & F.array_contains(m, f), F.lit(f)) for f in fixed.SLOTS])))}


def status(eligible: Column, conditions: Column, missing: Column, reasons: Column) -> Column:
    open_points = (F.size(conditions) > 0) | (F.size(missing) > 0) | (F.size(reasons) == 0)
    return F.when(~eligible, "not").when(open_points, "may").otherwise("eligible")


def benefit_line(assistance: Column, others: Column) -> Column:
    """First sentence of the first benefit worth showing, without its label."""
    listed = F.concat(F.array(F.coalesce(assistance, F.lit(""))), F.coalesce(others, F.array().cast("array<string>")))
    shown = F.transform(listed, lambda x: display_form(F.regexp_replace(x, nocase(fixed.BENEFIT_LABEL), "")))
    first = F.get(F.split(F.get(F.filter(shown, lambda x: x.isNotNull()), F.lit(0)), fixed.SENTENCE_END, 2), F.lit(0))
    return F.when(F.length(first) <= fixed.REASON_LIMIT, first).otherwise(
        F.concat(F.rtrim(F.left(first, F.lit(fixed.REASON_LIMIT))), F.lit("...")))


# --- fields read from documents -------------------------------------------------------------
def normalise(value: Column, synonyms: list[tuple[str, str]]) -> Column:
    return first_label(F.trim(F.regexp_replace(F.lower(F.trim(value)), r"(?U)[.\s]+", " ")), synonyms)


def _evidence(value: Column, text: Column, table: dict[str, str]) -> Column:
    hit = F.lit(False)
    for name, pattern in table.items():
        hit = F.when(value == name, _found(text, pattern)).otherwise(hit)
    return hit


def grounded_fields(text: Column, category: Column, gender: Column, occupation: Column) -> Column:
    """Category, gender and occupation in profile spelling, kept only with evidence in the text."""
    cat, gen = normalise(category, fixed.CATEGORY_SYNONYMS), normalise(gender, fixed.GENDER_SYNONYMS)
    occ = F.nullif(F.left(tx.squeeze(F.lower(F.coalesce(occupation, F.lit("")))), F.lit(40)), F.lit(""))
    words = F.filter(F.regexp_extract_all(occ, F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= 4)
    lowered = F.lower(text)
    return F.struct(
        F.when(_evidence(cat, text, fixed.CATEGORY_EVIDENCE), cat).alias("category"),
        F.when(_evidence(gen, text, fixed.GENDER_EVIDENCE), gen).alias("gender"),
        F.when(F.exists(words, lambda w: F.contains(lowered, w)), occ).alias("occupation"))


AUTOFILL_FIELDS = ["age", "income_annual", "category", "state", "gender", "occupation"]


def autofill(found: dict[str, Column], scores: dict[str, Column], profile: dict[str, Column]) -> Column:
    """Profile after a document: confident values fill, fair ones fill and need confirmation, others fail."""

    def names(test) -> Column:
        return F.array_compact(F.array(*[F.when(test(f), F.lit(f)) for f in AUTOFILL_FIELDS]))

    fair = {f: found[f].isNotNull() & (scores[f] >= fixed.LOW_CONFIDENCE) for f in AUTOFILL_FIELDS}
    sure = {f: found[f].isNotNull() & (scores[f] >= fixed.HIGH_CONFIDENCE) for f in AUTOFILL_FIELDS}
    return F.struct(
        *[F.when(fair[f], found[f]).otherwise(profile[f]).alias(f) for f in AUTOFILL_FIELDS],
        names(lambda f: sure[f]).alias("high_confidence_fills"), names(lambda f: fair[f] & ~sure[f]).alias("needs_confirmation"),
        names(lambda f: ~F.coalesce(fair[f], F.lit(False))).alias("failed_fields"))
