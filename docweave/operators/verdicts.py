"""Profiles against candidate schemes, and the selection shown to a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from docweave import fixed
from docweave.functions import eligibility as el

PROFILE = ["age", "gender", "state", "income_annual", "category", "disability", "is_ex_serviceman"]


def compile_schemes(schemes: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Condition and exclusion texts read into rules, once per scheme.

    Reading a scheme takes far longer than scanning it, and a table of schemes is often one small file: the texts are
    dealt to all tasks first.
    """
    dealt = schemes.repartition("scheme_id", "conditions", "exclusions")
    return dealt.withColumn("conditions", el.compile_conditions(F.col("conditions"), states)).withColumn(
        "exclusions", el.compile_conditions(F.col("exclusions"), states))


def judge(pairs: DataFrame) -> DataFrame:
    """``pairs`` of compiled conditions, exclusions and a profile, with what ``el.facts`` says and the display status in their place.

    In steps of columns and not in one expression, so that each verdict is found once and what nobody asks for is left out.
    """
    kept = [c for c in pairs.columns if c not in ("conditions", "exclusions", "profile")]
    profile = F.col("profile")
    both = pairs.withColumns({"_cond": el.judged(F.col("conditions"), profile), "_excl": el.judged(F.col("exclusions"), profile)}).drop("conditions", "exclusions")
    both = both.withColumn("_open", el.unverified(F.col("_cond"), F.col("_excl")))
    told = el.facts(F.col("_cond"), F.col("_excl"), F.col("_open"), profile)
    rows = both.select(*kept, *[value.alias(name) for name, value in told.items()])
    return rows.withColumn("status", el.status(*[F.col(c) for c in ("eligible", "conditions", "missing", "reasons")]))


def assess_candidates(candidates: DataFrame, profiles: DataFrame, schemes: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Verdict rows for (profile_id, scheme_id) candidates; equi-joins only, rules already compiled.

    Candidates come from retrieval or another bounded source: the operator never pairs everyone with
    everything. Both lookups have unique keys, so hot schemes or profiles are split by the skew join.
    """
    profile = F.struct(*PROFILE).alias("profile")
    pairs = candidates.join(profiles.select("profile_id", profile), "profile_id").join(
        compile_schemes(schemes, states).select("scheme_id", "conditions", "exclusions"), "scheme_id")
    other = [c for c in candidates.columns if c not in ("profile_id", "scheme_id")]
    return judge(pairs.select("profile_id", "scheme_id", *other, "conditions", "exclusions", "profile"))


def select_shown(verdicts: DataFrame, rank: str, show_not: bool = False, top: int = fixed.MAX_SCHEMES_SHOWN) -> DataFrame:
    """The entries to show per profile and how many "not eligible" ones were hidden.

    Eligible first, then fewest open conditions, then retrieval order. Places and counts are windows over one order of
    a profile's candidates, so verdicts, which take long, are computed once.
    """
    bad = F.col("status") == "not"
    known = verdicts.filter(F.col("profile_id").isNotNull()).withColumn("_size", F.size("conditions"))
    order = [bad.cast("int"), F.when(F.col("status") == "eligible", 0).otherwise(1), F.when(bad, 0).otherwise(F.col("_size")), F.col(rank)]
    mine = W.partitionBy("profile_id")
    counted = known.withColumns({"place": F.row_number().over(mine.orderBy(*order)).cast("long"), "_good": F.count_if(~bad).over(mine), "_bad": F.count_if(bad).over(mine)})
    best = counted.filter(F.col("place") <= top).drop("_size")
    if show_not:
        return best.withColumn("hidden", F.lit(0).cast("long")).drop("_good", "_bad")
    hidden = F.when(F.col("_good") > 0, F.col("_bad")).otherwise(F.lit(0)).cast("long")
    return best.filter(~bad | (F.col("_good") == 0)).withColumn("hidden", hidden).drop("_good", "_bad")
