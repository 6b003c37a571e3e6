import pytest
from pyspark.sql import functions as F

from docweave.functions import eligibility as el
from docweave.operators import verdicts

FIELDS = "age int, gender string, state string, income_annual double, category string, disability boolean, is_ex_serviceman boolean"
NOBODY = (None,) * 7


def person(**known):
    return tuple(known.get(f.split()[0]) for f in FIELDS.split(", "))


def verdict_of(spark, text, profile):
    df = spark.createDataFrame([(text, profile)], f"t string, p struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    return df.select(el.verdict(el.read_rule(F.col("t")), F.col("p")).alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("text, known, expected", [
    ("Age between 18 and 60 years", {"age": 30}, "pass"), ("Age between 18 and 25 years", {"age": 30}, "fail"),
    ("Age between 18 and 25 years", {}, "unverifiable"), ("Persons between 18-25 years in Kerala", {"state": "Kerala"}, "pass"),
    ("not exceeding 40 years", {"age": 40}, "pass"), ("Minimum age of 21", {"age": 20}, "fail"), ("below 21 years", {"age": 21}, "fail"),
    ("above 21 years", {"age": 21}, "fail"), ("priority to those above 21 years", {"age": 18}, "unverifiable"),
    ("income above Rs. 2 lakh", {"income_annual": 150000.0}, "pass"), ("income up to 1.5 lakh", {"income_annual": 200000.0}, "fail"),
    ("BPL family, income below Rs. 5", {"income_annual": 1.0}, "unverifiable"), ("income proof", {"income_annual": 1.0}, "unverifiable"),
    ("Scheduled Caste", {"category": "SC"}, "pass"), ("non-SC only, sc excluded", {"category": "sc"}, "fail"),
    ("women", {"gender": "Female"}, "pass"), ("persons with disability", {"disability": False}, "fail"), ("ex-servicemen", {"is_ex_serviceman": True}, "pass"),
    ("resident of Tamil Nadu", {"state": "tamil nadu"}, "pass"), ("not residing in Tamil Nadu", {"state": "Tamil Nadu"}, "fail"),
    ("a clear goal", {"state": "Kerala"}, "fail"), ("unknown words", {"age": 3}, "unverifiable"),
])
def test_condition_verdicts(spark, text, known, expected):
    assert verdict_of(spark, text, person(**known)) == expected


def assess(spark, conditions, exclusions, **known):
    profiles = spark.createDataFrame([("p", *person(**known))], f"profile_id string, {FIELDS}")
    schemes = spark.createDataFrame([("s", conditions, exclusions)], "scheme_id string, conditions array<string>, exclusions array<string>")
    pairs = spark.createDataFrame([("p", "s", 1)], "profile_id string, scheme_id string, rank int")
    return verdicts.assess_candidates(pairs, profiles, schemes).collect()[0]


def test_status(spark):
    row = assess(spark, ["Age between 18 and 60 years", "Must be Scheduled Caste"], [], state="Tamil Nadu", income_annual=100000.0)
    assert row["status"] == "may" and row["missing"] == ["age", "category"]
    assert assess(spark, ["Age between 18 and 60 years"], [], age=30)["status"] == "eligible"
    assert assess(spark, ["Age between 18 and 25 years"], [], age=30)["status"] == "not"
    assert assess(spark, [], [], age=30)["status"] == "may"
    row = assess(spark, ["Age between 18 and 60 years"], ["Residents of Kerala"], age=30, state="Kerala")
    assert row["status"] == "not" and row["failed_conditions"] == ["Excluded: Residents of Kerala"]
    row = assess(spark, ["Kerala?", "x" * 130], [], state="Goa")
    assert row["failed_conditions"] == [] and not row["eligible"] and row["unverifiable_conditions"] == ["x" * 120 + "..."]


@pytest.mark.parametrize("text, shown", [
    ("What is the benefit of it?", None), ("Note 01 keep the receipt safe", None), ("Step-1: visit the office", None), ("Obligation of the applicant", None),
    ("Whether the land is owned", None), ("Can the applicant apply twice", None), ("issued by the... office of", None),
    ("a" * 120 + "...", "a" * 120 + "..."), ("b " * 90, ("b " * 60).rstrip() + "..."), ("  A   proper  condition ", "A proper condition"), ("tiny", None),
])
def test_display(value, text, shown):
    assert value(el.display_form, text) == shown


def test_distinct_ignores_case(spark):
    df = spark.createDataFrame([(["A b", "a B", "c", "A b"],)], "x array<string>")
    assert df.select(el.distinct_nocase(F.col("x")).alias("x")).collect()[0]["x"] == ["A b", "c"]


def test_benefit_line(value):
    line = lambda c: el.benefit_line(c, F.array().cast("array<string>"))
    assert value(line, "Rs. 6,000 per year in three instalments. Paid directly.") == "Rs. 6,000 per year in three instalments."
    assert value(line, "Pattern of Assistance: Rs. 5,000 per unit") == "Rs. 5,000 per unit"


def test_selection(spark):
    statuses = ["not", "may", "eligible", "not", "may", "eligible", "may", "eligible"]
    rows = [("p", i, s, ["c"] * (i % 3)) for i, s in enumerate(statuses)]
    df = spark.createDataFrame(rows, "profile_id string, rank int, status string, conditions array<string>")
    shown = verdicts.select_shown(df, "rank").orderBy("place").collect()
    assert [r["status"] for r in shown] == ["eligible"] * 3 + ["may"] * 2 and shown[0]["hidden"] == 2
    both = verdicts.select_shown(df, "rank", show_not=True, top=8).orderBy("place").collect()
    assert [r["rank"] for r in both][-2:] == [0, 3] and both[0]["hidden"] == 0
    only_bad = verdicts.select_shown(df.filter("status = 'not'"), "rank").collect()
    assert len(only_bad) == 2 and only_bad[0]["hidden"] == 0


def test_grounding(spark):
    df = spark.createDataFrame([("Community: BC, S/O Ram, weaver", "B.C.", "M", "Weaver"), ("no evidence", "SC", "F", "Farmer")], "t string, c string, g string, o string")
    rows = df.select(el.grounded_fields(F.col("t"), F.col("c"), F.col("g"), F.col("o")).alias("f")).select("f.*").collect()
    assert tuple(rows[0]) == (None, "male", "weaver") or tuple(rows[0]) == ("obc", "male", "weaver")
    assert tuple(rows[1]) == (None, None, None)


def test_null_conditions_and_empty_mentions(spark):
    """A scheme without a list of conditions has nothing missing, and is judged like before the steps were columns."""
    row = assess(spark, None, [], age=30)
    assert row["missing"] == [] and row["reasons"] is None and row["status"] == "eligible"


def test_schemes_are_dealt_before_they_are_read(spark):
    """A table of one file is read by one task; its texts are compiled by several."""
    listed = [(f"s{i}", ["Minimum age of 21"], []) for i in range(2000)]
    schemes = spark.createDataFrame(listed, "scheme_id string, conditions array<string>, exclusions array<string>").coalesce(1)
    off = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = verdicts.compile_schemes(schemes).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", off)
    assert parts > 1


def test_verdicts_of_a_selection_are_computed_once(spark):
    from collections import Counter

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def judged(status):
        seen.add(1)
        return status

    df = spark.createDataFrame([("p", i, "may", ["c"]) for i in range(20)], "profile_id string, rank int, status string, conditions array<string>")
    shown = verdicts.select_shown(df.withColumn("status", judged.asNondeterministic()("status")), "rank").collect()
    assert Counter(r["hidden"] for r in shown) == {0: 5} and seen.value == 20


@pytest.mark.parametrize("text, age", [("BETWEEN 18-60 YEARS", (18, 60)), ("Not Exceeding 40 years", (None, 40)), ("MINIMUM AGE OF 21", (21, None)),
                                       ("between the lines, below 30 years", (None, 29)), ("above 5 and below 30 years", (None, 29)), ("age proof", (None, None))])
def test_age_bounds(spark, text, age):
    row = spark.createDataFrame([(text,)], "t string").select(el.read_age(F.col("t")).alias("a")).collect()[0]["a"]
    assert (row["lo"], row["hi"]) == age and row["bare"] == (age == (None, None))


@pytest.mark.parametrize("text, cap", [("income above Rs. 2,50,000", 250000.0), ("up to 1.5 lakh", 150000.0), ("income above rs. ,", None), ("below 3 crore", 30000000.0)])
def test_income_caps(spark, text, cap):
    assert spark.createDataFrame([(text,)], "t string").select(el.read_income(F.col("t")).alias("a")).collect()[0]["a"]["cap"] == cap
