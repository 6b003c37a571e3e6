"""Names inside texts: one scan with an automaton of all names, or an equi-join on one rare gram per name."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docweave import fixed
from docweave.functions import text as tx

MAX_SCAN_NEEDLES = 20_000         # names sent to every task as one automaton: about 100 MB at this bound
WORD_SIZES = [1, 2, 3, 4]         # words per gram
CHAR_SIZES = [4, 5, 6, 7, 8]      # characters per gram; needles have at least four
MAX_KNOWN_WORDS = 100_000         # words a task remembers the repair of: about 20 MB


#: What belongs to a word, wherever names are looked for: letters, numbers, marks, connectors and joiners.
WORD = r"[\p{L}\p{N}\p{M}\p{Pc}\x{200C}\x{200D}]"


def _words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(f"({WORD}+)"), F.lit(1))


def _grams(units: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` units. Elements are read by index: one pass, no slicing."""
    last = F.size(units) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(units, i + k) for k in range(n)]))


def _own_grams(units: Column, sizes: list[int]) -> Column:
    """Grams of the largest size that fits."""
    chosen = _grams(units, sizes[0])
    for n in sizes[1:]:
        chosen = F.when(F.size(units) >= n, _grams(units, n)).otherwise(chosen)
    return chosen


def contained_lists(haystacks: DataFrame, needles: DataFrame, whole_words: bool, most: int = MAX_SCAN_NEEDLES) -> DataFrame:
    """hay_id and found, an array of (needle_id, needle), for every hay text with needles in it; exact.

    ``haystacks``: hay_id, hay. ``needles``: needle_id, needle (normalised, at least four characters); nulls are left
    out. Up to ``most`` needles, counted first, make one automaton that runs over each text in its row: the texts are
    read once and never moved. More needles are found by ``gram_pairs``.
    """
    known = needles.select("needle_id", "needle").filter("needle <> ''")
    rows = known.take(most + 1)
    if len(rows) > most:
        pairs = gram_pairs(haystacks, known, whole_words)
        return pairs.groupBy("hay_id").agg(F.collect_list(F.struct("needle_id", "needle")).alias("found"))
    by_form: dict[str, list] = {}
    for needle_id, needle in rows:
        by_form.setdefault(needle, []).append(needle_id)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for form in by_form:
            automaton.add_word(form, form)
        if by_form:
            automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for hay_id, hay in zip(batch["hay_id"], batch["hay"]):
                if not by_form or not hay:
                    continue
                forms = {form for end, form in automaton.iter(hay)
                         if not whole_words or not (_joins(hay, end - len(form)) or _joins(hay, end + 1))}
                if forms:
                    ids.append(hay_id)
                    found.append([{"needle_id": i, "needle": form} for form in forms for i in by_form[form]])
            yield pd.DataFrame({"hay_id": pd.Series(ids, dtype=batch["hay_id"].dtype), "found": pd.Series(found, dtype=object)})

    types = dict(haystacks.dtypes)["hay_id"], dict(needles.dtypes)["needle_id"]
    return haystacks.select("hay_id", "hay").mapInPandas(
        scan, f"hay_id {types[0]}, found array<struct<needle_id:{types[1]},needle:string>>")


def _joins(text: str, at: int) -> bool:
    """Whether the character belongs to a word; the same class as ``WORD``."""
    if not 0 <= at < len(text):
        return False
    kind = unicodedata.category(text[at])
    return kind[0] in "LNM" or kind == "Pc" or text[at] in "\u200c\u200d"


def contained_pairs(haystacks: DataFrame, needles: DataFrame, whole_words: bool, most: int = MAX_SCAN_NEEDLES) -> DataFrame:
    """(hay_id, needle_id, needle) of ``contained_lists``."""
    lists = contained_lists(haystacks, needles, whole_words, most)
    return lists.select("hay_id", F.explode("found").alias("f")).select("hay_id", "f.*")


def gram_pairs(haystacks: DataFrame, needles: DataFrame, whole_words: bool) -> DataFrame:
    """(hay_id, needle_id) pairs where the needle occurs in the hay text; exact.

    ``haystacks``: hay_id, hay. ``needles``: needle_id, needle (normalised, at least four characters).
    Each needle is represented by its rarest gram among all needles (four words, or eight characters),
    so a phrase shared by many needles does not become a hot join key. Only ids and gram hashes are
    exploded and joined; the texts are fetched for the candidates alone, by one shuffle.
    """
    sizes = WORD_SIZES if whole_words else CHAR_SIZES

    def units(col: str) -> Column:
        return _words(F.col(col)) if whole_words else F.split(col, "")

    grams = tx.let(units("needle"), lambda u: _own_grams(u, sizes))
    hay_grams = tx.let(units("hay"), lambda u: F.array_distinct(F.flatten(F.array(*[_grams(u, n) for n in sizes]))))
    exploded = needles.select("needle_id", F.posexplode(grams).alias("pos", "gram"))
    frequency = exploded.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = exploded.join(frequency, "gram").groupBy("needle_id").agg(F.min_by("gram", F.struct("n", "pos")).alias("gram"))
    seen = haystacks.select("hay_id", F.explode(hay_grams).alias("gram"))
    candidates = seen.join(anchors, "gram").select("hay_id", "needle_id").distinct()
    texts = candidates.join(haystacks.select("hay_id", "hay"), "hay_id").join(needles.select("needle_id", "needle"), "needle_id")
    found = F.contains(F.col("hay"), F.col("needle"))
    if whole_words:
        found = found & F.rlike(F.col("hay"), F.concat(F.lit(rf"(?<!{WORD})\Q"), F.col("needle"), F.lit(rf"\E(?!{WORD})")))
    return texts.filter(found).select("hay_id", "needle_id", "needle")


def usable_names(names: DataFrame, generic: list[str] | None = None) -> DataFrame:
    """Normalised names of at least four characters that are not made of generic words only."""
    generic = fixed.GENERIC_NAME_WORDS if generic is None else generic
    formed = names.withColumn("needle", tx.match_form(F.col("name")))
    specific = F.array_except(_words(F.col("needle")), F.array(*[F.lit(g) for g in generic]))
    return formed.filter((F.length("needle") >= fixed.MIN_NAME_CHARS) & (F.size(specific) > 0))


def mentioned_names(texts: DataFrame, names: DataFrame, limit: int = 3, generic: list[str] | None = None) -> DataFrame:
    """Known names inside each text, longest first; names that are part of a kept longer one are dropped.

    ``texts``: text_id, text. ``names``: name_id, name. The names of one text are bounded by that text.
    """
    known = usable_names(names, generic).withColumnRenamed("name_id", "needle_id")
    hay = texts.select(F.col("text_id").alias("hay_id"), tx.match_form(F.col("text")).alias("hay"))
    per_text = contained_lists(hay, known.select("needle_id", "needle"), whole_words=True)
    order = F.sort_array(F.transform("found", lambda f: F.struct((-F.length(f["needle"])).alias("o"), f["needle_id"].alias("needle_id"), f["needle"].alias("needle"))))

    def keep(kept: Column, x: Column) -> Column:
        inside = F.exists(kept, lambda k: F.contains(k["needle"], x["needle"]) | (k["needle_id"] == x["needle_id"]))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))

    kind = dict(known.dtypes)["needle_id"]
    start = F.array().cast(f"array<struct<o:int,needle_id:{kind},needle:string>>")
    kept = per_text.select("hay_id", F.slice(F.aggregate(order, start, keep), 1, limit).alias("kept"))
    return kept.select(F.col("hay_id").alias("text_id"), F.posexplode("kept").alias("place", "k")).select(
        "text_id", F.col("place").cast("long").alias("place"), F.col("k.needle_id").alias("name_id"), F.col("k.needle").alias("name_form"))


def lookup_names(targets: DataFrame, names: DataFrame, limit: int = 2) -> DataFrame:
    """Stored names for a given name: exact matches, else containment either way, shortest name first.

    ``targets``: target_id, target. Equal targets are looked up once.
    """
    known = usable_names(names).select("name_id", "needle")
    asked = targets.select("target_id", tx.match_form(F.col("target")).alias("form")).filter(F.length("form") >= fixed.MIN_NAME_CHARS)
    forms = asked.select("form").distinct()
    exact = forms.join(known, forms.form == known.needle).select("form", "name_id", "needle")
    partial = forms.join(exact.select("form").distinct(), "form", "left_anti").filter(F.length("form") >= fixed.MIN_LOOKUP_CHARS)
    by_name = known.select(F.col("needle").alias("name_form")).distinct()
    inside = contained_pairs(by_name.select(F.col("name_form").alias("hay_id"), F.col("name_form").alias("hay")),
                             partial.select(F.col("form").alias("needle_id"), F.col("form").alias("needle")), False)
    around = contained_pairs(partial.select(F.col("form").alias("hay_id"), F.col("form").alias("hay")),
                             by_name.select(F.col("name_form").alias("needle_id"), F.col("name_form").alias("needle")), False)
    pairs = inside.select(F.col("needle_id").alias("form"), F.col("hay_id").alias("needle")).union(
        around.select(F.col("hay_id").alias("form"), F.col("needle_id").alias("needle"))).distinct()
    loose = pairs.join(known, "needle").select("form", "name_id", "needle")
    first = W.partitionBy("form").orderBy(F.length("needle"), "name_id")
    ranked = exact.unionByName(loose).withColumn("place", F.row_number().over(first).cast("long")).filter(F.col("place") <= limit)
    return asked.join(ranked, "form").select("target_id", "place", "name_id")


def guard_answers(answers: DataFrame, hits: DataFrame, decline: str) -> DataFrame:
    """An answer must name a retrieved scheme, else it is replaced, unsourced and of low confidence.

    ``answers``: query_id, answer, confidence. ``hits``: query_id, scheme_id, name (top-k per query, so a list of k).
    The answers are moved by one join; names are looked for inside the row.
    """
    forms = hits.select("query_id", F.struct("scheme_id", tx.match_form(F.col("name")).alias("form")).alias("hit")).filter(
        F.length("hit.form") >= fixed.MIN_NAME_CHARS)
    listed = forms.groupBy("query_id").agg(F.collect_list("hit").alias("_hits"))
    cited = F.filter("_hits", lambda h: F.contains(F.col("_said"), h["form"]))
    judged = answers.join(listed, "query_id", "left").withColumn("_said", F.when(F.col("_hits").isNotNull(), tx.match_form(F.col("answer"))))
    judged = judged.withColumn("_cited", cited).withColumns({
        "n_cited": F.when(F.size("_cited") > 0, F.size("_cited").cast("long")), "first_cited": F.array_min(F.transform("_cited", lambda h: h["scheme_id"]))})
    good = F.col("n_cited").isNotNull()
    return judged.select(
        "query_id", F.when(good, F.col("answer")).otherwise(F.lit(decline)).alias("answer"),
        F.when(good, F.col("confidence")).otherwise(F.lit("low")).alias("confidence"),
        F.coalesce("n_cited", F.lit(0)).alias("n_cited"), "first_cited")


def protect_names(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Replace the given names of each text by placeholders; ``names`` keeps them for the way back.

    ``texts``: text_id, text. ``mentions``: text_id, place, name (as written). One text's names are few.
    """
    listed = mentions.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("_n"))
    named = texts.join(listed, "text_id", "left").withColumn("names", F.coalesce(F.transform("_n", lambda x: x["name"]), F.array().cast("array<string>"))).drop("_n")
    start = F.struct(F.col("text").alias("t"), F.lit(0).alias("i"))
    hidden = F.aggregate("names", start, lambda s, n: F.struct(
        F.replace(s["t"], n, F.concat(F.lit("__SCHEME_"), s["i"], F.lit("__"))).alias("t"), (s["i"] + 1).alias("i")), lambda s: s["t"])
    return named.withColumn("protected", hidden)


def restore_names(protected: Column, names: Column) -> Column:
    start = F.struct(protected.alias("t"), F.lit(0).alias("i"))
    return F.aggregate(names, start, lambda s, n: F.struct(
        F.replace(s["t"], F.concat(F.lit("__SCHEME_"), s["i"], F.lit("__")), n).alias("t"), (s["i"] + 1).alias("i")), lambda s: s["t"])


def _closest_word(vocabulary: list[str], keep: list[str]) -> Callable[[str], str | None]:
    """The vocabulary word that repairs a word of ASCII letters, or None."""
    from docweave.functions.arrow import matching_ratio

    right = {*vocabulary, *keep}
    near: dict[tuple[str, int], list[tuple[str, frozenset[str]]]] = {}  # by first letter and length of the word
    for v in {*vocabulary} - {""}:
        for n in range(len(v) - 2, len(v) + 3):
            near.setdefault((v[0], n), []).append((v, frozenset(v)))

    def closest(word: str) -> str | None:
        w = word.lower()
        if (w[0], len(w)) not in near or w in right or word.isupper():
            return None
        # Ratio 2M/T of at least the cutoff leaves at most (1 - cutoff) T letters without a partner, and a letter that
        # only one of the words has is one of them: a lossless filter that spares most ratios.
        letters = {*w}
        ratios = [(matching_ratio(w, v), v) for v, own in near[w[0], len(w)]
                  if len(own ^ letters) <= (len(v) + len(w)) * (1 - fixed.TYPO_CUTOFF) + 1e-9]
        return max((r for r in ratios if r[0] >= fixed.TYPO_CUTOFF), default=(0, None))[1]

    return closest


def fix_typos(texts: DataFrame, vocabulary: list[str], keep: list[str], states: list[str] | None = None) -> DataFrame:
    """Repair run-together state names and words close to a vocabulary word: a ratio of at least 0.8, the same first
    letter and at most two letters more or less.

    ``texts``: text_id, text. Each text is repaired in its row, so ids may repeat or be null; texts in other scripts are
    left alone.
    """
    latin = ~tx.non_latin(F.col("text")) & (F.col("text") != "")
    spaced = F.col("text")
    joint = {s: r"[\s-]?".join(tx.literal(w) for w in s.lower().split()) for s in states or fixed.STATES if " " in s}
    for state, pattern in joint.items():
        spaced = F.regexp_replace(spaced, tx.nocase(rf"\b{pattern}\b"), state)
    if joint:  # most texts name none of them: one pass instead of one for each
        named = F.rlike("text", F.lit(tx.nocase(rf"\b(?:{'|'.join(joint.values())})\b")))
        spaced = F.when(named, spaced).otherwise(F.col("text"))

    longest = max(map(len, vocabulary), default=0) + 2

    @F.pandas_udf("string")
    def repaired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, closest = re.compile("([A-Za-z]{4,})"), _closest_word(vocabulary, keep)
        repairs: dict[str, str] = {}
        right: set[str] = set()
        for batch in batches:
            out: list[str | None] = []  # None: nothing to repair
            for text in batch:
                parts = words.split(text or "")
                wrong = False
                for w in {*parts[1::2]} - right:
                    if len(w) > longest:
                        continue
                    if w not in repairs:
                        if (fix := closest(w)) is None:
                            right.add(w)
                            continue
                        repairs[w] = fix
                    wrong = True
                if wrong:
                    parts[1::2] = [repairs.get(w, w) for w in parts[1::2]]
                out.append("".join(parts) if wrong else None)
                if len(right) + len(repairs) > MAX_KNOWN_WORDS:
                    right.clear()
                    repairs.clear()
            yield pd.Series(out, dtype=object)

    cut = texts.select("text_id", "text", F.when(latin, spaced).alias("_spaced"))
    return cut.select("text_id", F.coalesce(repaired("_spaced"), "_spaced", "text").alias("fixed"))
