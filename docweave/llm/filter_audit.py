"""How filters act on one another: what each removes at each step of every order, from one cell per failure mask.

A document enters only as the set of filters it fails (its mask). Masks are counted per part, and each of the at most
2**n cells of a part is folded across the array of all orders: ``transform`` walks the orders, ``aggregate`` walks the
filters of one order with the state "still there". The cell's weighted structs, one per order and step, are then
merged with those of the part's other cells by elementwise sums.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
REPEATS = "E"  # the filter of repeated texts, which no text decides on its own
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3) -> dict[str, Column]:
    """The filters that a (non-null) text fails by itself: A few words, B few distinct words in per cent of all,
    C capitals in per cent of the code points, D symbols. Words are case-sensitive; an empty text fails A alone."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < least_distinct * n,
        "C": 100 * capitals > most_capitals * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", failures=text_failures) -> DataFrame:
    """part, fails (letters of the filters failed, in order), n, good and toxic (documents labelled so).

    ``failures`` gives the filters a text decides; ``REPEATS`` is added: a smaller doc_id has the identical text, seen
    by its SHA-256. Copies are counted per text, part and labels before their smallest ids meet, so a text that is a
    third of the table is a few rows by then, and texts are never moved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = F.concat(*[F.when(c, F.lit(k)).otherwise(F.lit("")) for k, c in failures(text).items()])
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), fails.alias("fails"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        *[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    cell = ["part", "fails", "good", "toxic"]
    ids = rows.groupBy("doc_id", "sha", *cell).agg(F.count("*").alias("n"))
    texts = ids.groupBy("sha", *cell).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = texts.groupBy("sha").agg(F.min("low").alias("least"))
    texts = texts.join(least, "sha")
    first = F.col("n_null") + F.when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(0)
    halves = F.array(F.struct(F.col("fails"), first.alias("n")), F.struct(F.concat("fails", F.lit(REPEATS)).alias("fails"), (F.col("n") - first).alias("n")))
    return texts.select("part", "good", "toxic", F.inline(halves)).groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")).where("n > 0")


def _folded(orders: Column, filters: str) -> Column:
    """A cell's structs, one per order and step, weighted by its documents."""
    kind = "array<struct<filter_order:string,step:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    zero = F.lit(0).cast("bigint")

    def fold(order: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            letter = F.substring(order, k, F.lit(1))
            hit, there = F.contains(F.col("fails"), letter), state["there"]
            lost = there & hit
            when = lambda c, v: F.when(c, F.col(v)).otherwise(zero)
            seen = F.struct(order.alias("filter_order"), k.alias("step"), when(there & ~hit, "n").alias("kept"), when(lost, "n").alias("removed"),
                            when(~there & hit, "n").alias("redundant"), when(F.col("fails") == letter, "n").alias("unique_fails"),
                            when(lost, "good").alias("good_lost"), when(lost, "toxic").alias("toxic_lost"))
            return F.struct((there & ~hit).alias("there"), F.concat(state["steps"], F.array(seen)).alias("steps"))

        start = F.struct(F.lit(True).alias("there"), F.array().cast(kind).alias("steps"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(filters))), start, step, lambda s: s["steps"])

    return F.flatten(F.transform(orders, fold))


def order_audit(cells: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of ``COUNTS`` with shapley, for every order of ``filters``.

    ``cells`` has part, fails, n, good and toxic, one row per part and set of failed filters; a part has at most
    2**n cells, so its structs are merged in one place. ``shapley`` sums what the step's filter removes over all
    orders. Parts without documents do not appear.
    """
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    folded = cells.select("part", _folded(orders, filters).alias("steps"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(
        x["filter_order"].alias("filter_order"), x["step"].alias("step"), *[(x[c] + y[c]).alias(c) for c in COUNTS]))
    several = F.col("several")
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("several")).select(
        "part", F.aggregate(F.slice(several, 2, 1 << len(filters)), several[0], add).alias("steps"))
    letter = lambda s: F.substring(s["filter_order"], s["step"], F.lit(1))

    def removed(k: str) -> Column:
        return F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, s: a + F.when(letter(s) == k, s["removed"]).otherwise(F.lit(0)))

    by_filter = F.array(*[removed(k) for k in filters])
    rows = merged.withColumn("by_filter", by_filter).select("part", "by_filter", F.inline("steps"))
    which = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1)))
    return rows.select("part", "filter_order", "step", *COUNTS, F.element_at("by_filter", which).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", failures=text_failures, filters: str = "ABCDE") -> DataFrame:
    """The audit of ``filters`` over ``docs`` (doc_id, text, ``part``) with labels (doc_id, quality, toxic).

    Null texts count as empty, null parts as the empty string. Null labels, and ids without a label row, are neither
    good nor toxic; of several label rows of an id any 1 counts. Rows that repeat an id and text are not copies of one
    another, and a row without an id repeats nothing and is repeated by nothing. Other columns are ignored. An
    empty table gives no rows.
    """
    return order_audit(failure_cells(docs, labels, part, failures), filters)
