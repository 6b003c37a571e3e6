"""Text repair, cleaning and splitting as column expressions (whole-stage, no Python per row)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from docweave import fixed

# The 27 characters that Windows-1252 keeps at bytes 80-9F, and their byte positions.
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "".join(map(chr, [
    0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
    0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F,
]))


def nocase(pattern: str) -> str:
    """Case-insensitive with Unicode classes."""
    return "(?iUd)" + pattern


def literal(text: str) -> str:
    """Escape ASCII punctuation for a Java pattern."""
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def loose(text: str) -> str:
    """A pattern for a phrase whose spaces may be missing or wider."""
    return r"\s*".join(literal(word) for word in text.split())


def any_of(patterns: list[str]) -> str:
    return nocase("|".join(f"(?:{p})" for p in patterns))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def squeeze(col: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"(?U)\S+")).cast("long")


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; inside lambdas outer expressions rerun per element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def first_label(col: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule whose pattern occurs."""

    def choose(text: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for label, pattern in reversed(rules):
            chosen = F.when(F.rlike(text, F.lit(nocase(pattern))), F.lit(label)).otherwise(chosen)
        return chosen

    return let(col, choose)


def first_contained(col: Column, values: list[str]) -> Column:
    """The first value (list order) that occurs as a substring, ignoring case."""
    listed = F.array(*[F.struct(F.lit(v).alias("name"), F.lit(v.lower()).alias("form")) for v in values])
    return let(F.lower(col), lambda text: F.get(F.filter(listed, lambda v: F.contains(text, v["form"])), F.lit(0))["name"])


# --- encoding repair ------------------------------------------------------------------------
def _repair_token(token: Column) -> Column:
    legal = ~F.rlike(token, F.lit(f"[^\\x00-\\x7F\\xA0-\\xFF{CP1252_CHARS}]"))
    raw = F.encode(F.when(legal, F.translate(token, CP1252_CHARS, CP1252_BYTES)).otherwise(F.lit("")), "ISO-8859-1")
    decoded = F.when(legal, F.try_validate_utf8(raw.cast("string")))
    repaired = F.coalesce(decoded, token)
    mark = "â€"
    residual = F.replace(F.replace(token, F.lit(mark + "​"), F.lit("”")), F.lit(mark), F.lit("”"))
    return F.when(~F.rlike(token, F.lit(r"[^\x00-\x7F]")), token).when(repaired == token, residual).otherwise(repaired)


def repair_mojibake(col: Column) -> Column:
    """Undo UTF-8 read as Windows-1252, one whitespace-separated token at a time."""
    tokens = F.regexp_extract_all(col, F.lit(r"(?U)(\s+|\S+)"), F.lit(1))
    fixed_text = F.array_join(F.transform(tokens, _repair_token), "")
    return F.when(F.rlike(col, F.lit(r"[^\x00-\x7F]")), fixed_text).otherwise(col)


def clean_string(col: Column) -> Column:
    """Repair, drop control and zero-width characters (newlines too), collapse spaces, strip."""
    return squeeze(F.regexp_replace(repair_mojibake(col), "[\\x00-\\x1F\\x7F\\x{200B}\\x{FEFF}]", ""))


def clean_list(col: Column) -> Column:
    """Clean every entry and keep the first of equal ones."""
    return F.array_distinct(F.transform(col, clean_string))


def marker_hits(col: Column, markers: list[str]) -> Column:
    """Positions (0-based) of the marker characters with their surroundings."""

    def scan(chars: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(chars), F.lit(1))),
                        lambda i: F.get(chars, i - 1).isin(*markers))

        def around(i: Column) -> Column:
            start = F.greatest(i - 5, F.lit(1))
            return F.struct(
                (i - 1).cast("long").alias("at"), F.get(chars, i - 1).alias("marker"),
                F.array_join(F.slice(chars, start, i + 8 - start), "").alias("context"))

        return F.transform(hits, around)

    return let(F.split(col, ""), scan)


def occurrences(col: Column, needle: str) -> Column:
    return ((F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


# --- page noise and section boundaries ------------------------------------------------------
def phrase_pattern(phrase: str) -> str:
    """Whole phrase, also when glued to a neighbour by a lower-to-upper case change (case-sensitive)."""
    body = r"\s*".join(literal(word) for word in phrase.split(" "))
    return r"(?U)(?:(?<!\w)|(?<=[a-z0-9]))" + body + r"(?:(?!\w)|(?=[A-Z]))"


def remove_phrases(col: Column, phrases: list[str]) -> Column:
    for phrase in phrases:
        col = F.regexp_replace(col, phrase_pattern(phrase), "")
    return col


def usable_phrases(listed: list[str], fallback: list[str], headings: list[str]) -> list[str]:
    """Listed phrases, or the fallback when none are listed, without the headings themselves."""
    taken = {h.lower() for h in headings}
    return [p for p in ([x.strip() for x in listed if x.strip()] or fallback) if p.lower() not in taken]


def separate_headings(col: Column, headings: list[str]) -> Column:
    for heading in headings:
        col = F.regexp_replace(col, phrase_pattern(heading), F.lit(f"\n\n{heading}\n"))
    return col


def preprocess(col: Column, phrases: list[str] | None = None, headings: list[str] | None = None) -> Column:
    """Repair, flatten whitespace, remove noise phrases and put headings on their own lines."""
    headings = fixed.HEADINGS if headings is None else headings
    phrases = usable_phrases([], fixed.FALLBACK_NOISE, headings) if phrases is None else phrases
    flat = F.regexp_replace(repair_mojibake(col), r"(?U)\s+", " ")
    quiet = F.regexp_replace(remove_phrases(flat, phrases), " {2,}", " ")
    return strip(separate_headings(quiet, headings))


def footer_pattern(phrases=tuple(fixed.FOOTER_PHRASES), gap=fixed.FOOTER_GAP, spaced=fixed.FOOTER_LOOSE) -> str:
    return "(?iu)" + "|".join([*map(literal, phrases), gap, loose(spaced)])


def strip_footer(col: Column, pattern: str | None = None) -> Column:
    return F.regexp_replace(repair_mojibake(col), pattern or footer_pattern(), "")


def heading_terms(base: list[str], synonyms: list[str]) -> list[str]:
    """Distinct terms without final colon, longest first (alternations prefer the longest)."""
    seen: dict[str, str] = {}
    for term in [*base, *synonyms]:
        name = term.strip().rstrip(":")
        if name:
            seen.setdefault(name.lower(), name)
    return sorted(seen.values(), key=len, reverse=True)


def heading_pattern(terms: list[str]) -> str:
    return "(?iu)(" + "|".join(loose(t) for t in terms) + ")"


def mark_sections(col: Column, terms: list[str]) -> Column:
    return F.regexp_replace(col, heading_pattern(terms), fixed.SECTION_DELIMITER + "$1")


def mark_words(col: Column) -> Column:
    """A line break at every lower-to-upper change and after sentence marks glued to a capital."""
    return F.regexp_replace(col, r"(?<=[a-z])(?=[A-Z])|(?<=[.?!])(?=[A-Z])", "\n")


# --- names and descriptions -----------------------------------------------------------------
def clean_name(col: Column) -> Column:
    """Remove trailing sign-out text with its emphasis marks; other names stay as they are."""
    pattern = nocase(fixed.NAME_SUFFIX)
    cut = F.regexp_replace(F.regexp_replace(col, pattern, ""), r"[ \t\r\n*_]+$", "")
    return F.when(F.rlike(col, F.lit(pattern)), cut).otherwise(F.coalesce(col, F.lit("")))


def clean_description(col: Column) -> Column:
    popup = nocase(fixed.POPUP_SENTENCE)
    rest = F.regexp_replace(col, popup, "")
    header = "(?s)" + fixed.POPUP_HEADER
    cleaned = (
        F.when(F.rlike(rest, F.lit(header)), strip(F.regexp_replace(rest, header, "")))
        .when(F.length(rest) <= fixed.MAX_HEADER_CHARS, F.lit(""))
        .otherwise(strip(rest))
    )
    return F.when(F.rlike(col, F.lit(popup)), cleaned).otherwise(F.coalesce(col, F.lit("")))


def has_description(col: Column) -> Column:
    return F.length(strip(F.coalesce(col, F.lit("")))) >= fixed.MIN_DESCRIPTION_CHARS


def file_key(col: Column) -> Column:
    """File name without extension and copy suffixes, lower-cased."""
    key = F.lower(F.regexp_replace(col, r"(?<=.)\.[^.]*$", ""))
    for suffix in fixed.FILE_SUFFIXES:
        key = F.regexp_replace(key, suffix, "")
    return strip(key)


def plain_lines(col: Column, limit: int = fixed.MAX_LIST_ITEM_CHARS) -> Column:
    """Markdown or HTML flattened to plain, non-blank lines of at most ``limit`` characters."""
    text = F.when(F.contains(col, F.lit("<")) & F.contains(col, F.lit(">")),
                  F.regexp_replace(col, r"<[^>]*>", "\n")).otherwise(col)

    def tidy(line: Column) -> Column:
        line = F.regexp_replace(line, r"^\s*(?:[-*•]|\d+[.)])\s+", "")
        line = F.regexp_replace(line, r"[*_`#>]+", "")
        return F.left(squeeze(F.regexp_replace(line, r"\[([^\]]*)\]\([^)]*\)", "$1")), F.lit(limit))

    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), tidy), lambda x: x != "")


# --- masking and safety ---------------------------------------------------------------------
def mask_ids(col: Column) -> Column:
    for pattern, mark in fixed.ID_MASKS:
        col = F.regexp_replace(col, "(?U)" + pattern, mark)
    return col


def last_digits(col: Column, keep: int = 4) -> Column:
    digits = F.regexp_replace(col, r"(?U)\D", "")
    return F.when(digits != "", F.right(digits, F.lit(keep)))


def safe_text(col: Column, limit: int = fixed.MAX_QUERY_CHARS) -> Column:
    """Control characters and backticks removed, cut to the limit; null if empty or an instruction."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"[\x00-\x1f\x7f]+", " ")
    text = F.left(squeeze(F.replace(text, F.lit("`"), F.lit(""))), F.lit(limit))
    return F.when((text != "") & ~F.rlike(text, F.lit(nocase(fixed.INSTRUCTION_PATTERN))), text)


INJECTIONS = ["ignore previous instructions", "you are now", "pretend you are", "disregard your"]  # fixed values


def has_injection(col: Column) -> Column:
    lowered = F.lower(col)
    hit = F.lit(False)
    for phrase in INJECTIONS:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return hit


# --- matching -------------------------------------------------------------------------------
def match_form(col: Column) -> Column:
    """Lower case, plain hyphens and quotes, single spaces, no punctuation at the edges."""
    plain = F.translate(col, fixed.HYPHENS + fixed.QUOTES, "-" * len(fixed.HYPHENS) + fixed.QUOTES_PLAIN)
    return F.regexp_replace(squeeze(F.lower(plain)), r"(?U)^[\W_]+|[\W_]+$", "")


def content_form(col: Column) -> Column:
    """Lower case, single spaces: the form whose hash identifies equal content."""
    return squeeze(F.lower(col))


# --- sentences and answers ------------------------------------------------------------------
def sentences(col: Column) -> Column:
    """Sentences of one line; a full stop after an abbreviation, digit or initial does not end one."""
    pieces = F.split(col, r"(?U)(?<=[.!?।])\s+")

    def join(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        kept = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        glued = F.concat(kept, F.array(F.concat(last, F.lit(" "), piece)))
        return (F.when(F.size(done) == 0, F.array(piece))
                .when(F.rlike(last, F.lit(fixed.ABBREVIATIONS)), glued)
                .otherwise(F.concat(done, F.array(piece))))

    return F.aggregate(pieces, F.array().cast("array<string>"), join)


def sentence_chunks(col: Column, limit: int = fixed.MAX_SENTENCE_CHUNK) -> Column:
    """Lines cut into chunks of whole sentences, greedily filled up to ``limit`` characters."""

    def pack(line: Column) -> Column:
        def add(state: Column, sentence: Column) -> Column:
            now = state["now"]
            full = (now != "") & (F.length(now) + F.length(sentence) + 1 > limit)
            longer = F.concat(now, F.lit(" "), sentence)
            return F.struct(
                F.when(full, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"),
                F.when(full, sentence).otherwise(strip(longer)).alias("now"),
            )

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
        packed = F.aggregate(F.split(line, r"(?U)(?<=[.!?।])\s+"), start, add,
                             lambda s: F.concat(s["done"], F.array(s["now"])))
        return F.when(F.length(line) <= limit, F.array(line)).otherwise(packed)

    return F.flatten(F.transform(F.split(col, "\n"), pack))


def drop_stray_stars(col: Column) -> Column:
    """Star bullets become dashes, balanced bold stays, other stars go."""
    bold = r"(\*\*(?=[^*\s])[^*]+?(?<=[^*\s])\*\*)"

    def tidy(line: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(line, r"(?U)^(\s*)\*\s+(?=\S)", "$1- "), bold + r"|\*", "$1")

    return F.array_join(F.transform(F.split(col, "\n"), tidy), "\n")


def non_latin(col: Column) -> Column:
    return F.rlike(col, F.lit("[^\\x{0}-\\x{2FF}]"))


def translation_failed(original: Column, translated: Column, language: Column) -> Column:
    judged = (strip(original) == strip(translated)) | (word_count(translated) < 3)
    return F.when((language == "en") | ~non_latin(original), F.lit(False)).otherwise(judged)


def answer_language(pill: Column, source: Column, words: Column, detected: Column, prob: Column) -> Column:
    """Language to answer in: pressed button, confident typed text, chosen language, then detection."""
    known = detected.isin(*fixed.LANGUAGES)
    plain = F.when(prob < 0.7, F.lit("en")).when(known, detected).otherwise(F.lit("unknown"))
    return (
        F.when((source == "button") & pill.isNotNull(), pill)
        .when((words >= fixed.TYPED_MIN_WORDS) & (prob >= fixed.TYPED_CONFIDENCE) & known, detected)
        .otherwise(F.coalesce(pill, plain))
    )


def parse_answer(col: Column) -> Column:
    """{answer, confidence} of a model reply, with or without a code fence; raw text if unreadable."""
    raw = strip(col)
    bare = F.regexp_replace(raw, r"^`+|`+$", "")
    fenced = strip(F.regexp_replace(bare, r"^(?i)json", ""))
    text = F.when(F.startswith(raw, F.lit("```")), fenced).otherwise(raw)
    parsed = F.from_json(text, "answer string, confidence string", {"mode": "PERMISSIVE"})
    level = F.lower(strip(parsed["confidence"]))
    answer = strip(parsed["answer"])
    good = answer.isNotNull() & (answer != "")
    return F.struct(
        F.when(good, answer).otherwise(text).alias("answer"),
        F.when(good & level.isin("high", "medium", "low"), level).otherwise(F.lit("medium")).alias("confidence"),
    )


def cache_key(question: Column, language: Column, pill: Column) -> Column:
    """Key of an answer: normalised question (NFKC already applied), language and chosen language."""
    text = F.regexp_replace(F.regexp_replace(F.lower(question), r"(?U)\s+", " "), r"^[ ?!.,;:।]+|[ ?!.,;:।]+$", "")
    return F.concat_ws("\x1f", text, language, F.coalesce(pill, F.lit("")))


def shorten(col: Column, limit: int = fixed.REASON_LIMIT) -> Column:
    return F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit)), F.lit("..."))).otherwise(col)


def is_junk(col: Column) -> Column:
    """Too short, only punctuation, or a question stub."""

    def judge(text: Column) -> Column:
        stub = let(strip(F.regexp_replace(text, r"\?+$", "")), lambda body: (F.length(body) < 10) | (word_count(body) < 3))
        return (F.length(text) < 10) | F.rlike(text, F.lit(r"(?U)^[\s\W_]+$")) | (F.endswith(text, F.lit("?")) & stub)

    return let(strip(col), judge)


# --- dates ----------------------------------------------------------------------------------
DATE_FORMATS = ["d MMM yyyy", "d MMMM yyyy", "d-M-yyyy", "d/M/yyyy"]  # fixed values


def parse_date(col: Column) -> Column:
    """UTC timestamp of an ISO text, epoch number (seconds or milliseconds) or day-month-year text; 8 digits are a date."""
    text = F.trim(col)
    date = F.when(F.rlike(text, F.lit(r"^(19|20)\d{6}$")), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    number = F.when(F.rlike(text, F.lit(r"^-?\d+(\.\d+)?$")), text.cast("double"))
    epoch = F.timestamp_seconds(F.when(number > 1e11, number / 1000).otherwise(number))
    iso = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_timestamp(text))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(date, epoch, iso, *tries)
