"""URL rules held in a cascade of Bloom filters.

Level 1 holds the listed keys; level 2 the other keys of the corpus that level 1 takes for listed; level 3 the
listed keys that level 2 takes for unlisted, and so on until no key is mistaken. The cascade is exact for every
key it was built over, so URLs are judged by bit tests alone, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_LIMIT = 1 << 33  # bits of one filter; more rules than fit are split over several cascades by key hash
PROBES = 3
Rule = tuple[str, str, str]  # host, path, action

#: The rules of the registered query.
RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """The rules that could match: each suffix of the host at a dot with each prefix of the path of a length in use."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _spots(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def _held(words: Column, key: Column, level: int, bits: int) -> Column:
    tests = [F.getbit(F.element_at(words, (s / 64).cast("int") + 1), (s % 64).cast("int")) == 1 for s in _spots(key, level, bits)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class Cascade:
    """The levels, each a list of 64-bit words; built by Spark over all keys, probed as a column expression."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, list[int]]] = []

    def add(self, keys: DataFrame, count: int, rate: float) -> None:
        bits = max(64, math.ceil(count * -math.log(rate) / math.log(2) ** 2))
        if bits > BITS_LIMIT:
            raise ValueError(f"a level of {bits} bits: split the rules over several cascades by a hash of the key")
        level = len(self.levels)
        spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, bits))).alias("spot"))
        words = spots.groupBy(F.floor(F.col("spot") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("spot") % 64).cast("int"))).alias("value"))
        held = [0] * (-(-bits // 64))
        for row in words.collect():
            held[row["word"]] = row["value"]
        self.levels.append((bits, held))

    def columns(self, df: DataFrame) -> DataFrame:
        """``df`` with the words of every level as scalar columns: their size is that of the rules."""
        if not self.levels:
            return df
        row = df.sparkSession.createDataFrame([[words for _, words in self.levels]],
                                              ", ".join(f"_level{i} array<bigint>" for i in range(len(self.levels))))
        return df.withColumns({c: row.select(c).scalar() for c in row.columns})

    def holds(self, key: Column) -> Column:
        """Whether the key is listed: it is, if the first level that does not hold it has an even number, from 1."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~_held(F.col(f"_level{i}"), key, i, self.levels[i][0]), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """The exact cascade for ``listed`` keys within ``universe`` (a column key each, null keys left out).

    The first level's rate is listed / universe, so about as many false positives as listed keys are left and
    all levels together have a size in proportion to the listed keys, whatever the size of the corpus.
    """
    cascade = Cascade()
    inside = listed.where("key is not null").distinct()
    n_inside = inside.count()
    if not n_inside:
        return cascade
    outside = universe.where("key is not null").distinct().join(inside, "key", "left_anti")
    n_outside = outside.count()
    rate = min(0.5, max(1e-9, n_inside / max(1, n_outside)))
    sides, counts = [inside, outside], [n_inside, n_outside]
    while counts[len(cascade.levels) % 2]:
        side = len(cascade.levels) % 2
        cascade.add(sides[side], counts[side], rate)
        level, (bits, _) = len(cascade.levels) - 1, cascade.levels[-1]
        other = 1 - side
        sides[other] = cascade.columns(sides[other]).where(_held(F.col(f"_level{level}"), F.col("key"), level, bits)).select("key")
        counts[other] = sides[other].count()
        rate = 0.5
        if len(cascade.levels) > 40:
            raise ValueError("two keys cannot be told apart")
    return cascade


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES, otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins (of one
    length, the longer host). Null, empty and malformed urls have an empty host and path and fit no rule; without
    a rule the verdict is ``otherwise``. Where several actions are given for one rule, the last counts.
    """
    spark = pages.sparkSession
    actions = {h + p: a for h, p, a in rules}
    lengths = sorted({len(p) for _, p, _ in rules}, reverse=True)
    judged = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths or [1]))
    universe = judged.select(F.explode("_keys").alias("key"))
    judged = judged.withColumn("_keys", F.array_sort("_keys", lambda a, b: F.length(b) - F.length(a)))
    for action in ("allow", "block"):
        listed = spark.createDataFrame([(k,) for k, a in actions.items() if a == action], "key string")
        cascade = build_cascade(universe, listed)
        hits = F.filter("_keys", cascade.holds) if cascade.levels else F.array().cast("array<string>")
        judged = cascade.columns(judged).withColumn(f"_{action}", F.try_element_at(hits, F.lit(1)))
        judged = judged.drop(*[f"_level{i}" for i in range(len(cascade.levels))])
    longer_block = F.coalesce(F.length("_block"), F.lit(-1)) > F.coalesce(F.length("_allow"), F.lit(-1))
    rule = F.when(longer_block, F.col("_block")).otherwise(F.col("_allow"))
    verdict = F.when(rule.isNull(), otherwise).when(longer_block, "block").otherwise("allow")
    return judged.withColumns({"rule": rule, "verdict": verdict}).select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path", "rule", "verdict")
