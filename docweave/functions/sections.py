"""Sections of one document as arrays inside its row: no explode, no shuffle, bounded by the document."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docweave import fixed
from docweave.functions import text as tx
from docweave.functions.text import let


def split_sections(marked: Column, terms: list[str]) -> Column:
    """{preamble, sections[{heading, content}]} of a text with section delimiters."""
    start = tx.heading_pattern(terms).replace("(?iu)(", "(?iu)^(", 1)

    def section(piece: Column) -> Column:
        found = F.rlike(piece, F.lit(start))
        return F.struct(
            F.when(found, tx.squeeze(F.regexp_extract(piece, start, 1))).otherwise(F.lit("")).alias("heading"),
            tx.strip(F.when(found, F.regexp_replace(piece, start, "")).otherwise(piece)).alias("content"),
        )

    def parts(pieces: Column) -> Column:
        rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.struct(tx.strip(F.get(pieces, 0)).alias("preamble"), F.transform(rest, section).alias("sections"))

    return let(F.split(marked, fixed.SECTION_DELIMITER), parts)


def items(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, "\n"), lambda x: tx.strip(x)), lambda x: x != "")


def is_label(item: Column, name: Column | None = None) -> Column:
    """A short title-case tag or the document's own name, not content."""
    connectors = F.array(*[F.lit(w) for w in fixed.TITLE_CONNECTORS])

    def judge(text: Column) -> Column:
        words = F.split(text, r"(?U)\s+")
        titled = F.forall(words, lambda w: F.array_contains(connectors, F.lower(w)) | F.rlike(w, F.lit(r"^\p{Lu}")))
        tag = (F.size(words) <= 3) & ~F.rlike(text, F.lit(r"(?U)\d|[.:]$")) & titled
        same = (name != "") & (F.lower(text) == F.lower(tx.strip(name))) if name is not None else F.lit(False)
        return (text != "") & (same | tag)

    return let(tx.strip(item), judge)


def drop_labels(listed: Column, name: Column | None = None) -> Column:
    return F.filter(listed, lambda x: ~is_label(x, name))


def classify(sections: Column, category: Column, score: Column, thresholds: dict[str, float] | None = None) -> Column:
    """Attach a category and score looked up by heading: two maps keyed by the lower-cased heading."""
    thresholds = fixed.CATEGORY_THRESHOLDS if thresholds is None else thresholds

    def one(s: Column) -> Column:
        key = F.lower(tx.strip(s["heading"]))
        value, label = F.coalesce(F.element_at(score, key), F.lit(0.0)), F.element_at(category, key)
        limit = F.lit(fixed.CONFIDENCE_THRESHOLD)
        for name, own in thresholds.items():
            limit = F.when(label == name, F.lit(own)).otherwise(limit)
        return F.struct(s["heading"].alias("heading"), s["content"].alias("content"), label.alias("category"),
                        value.alias("score"), (value >= limit).alias("confident"))

    return F.transform(sections, one)


def _runs(n: Column, starts: Column, build) -> Column:
    """``build(first, length)`` of each run that begins at ``starts`` (ascending places from 0) and ends before the next or ``n``.

    A run reads its own elements alone, so all runs of an array together take time in proportion to it.
    """

    def each(listed: Column) -> Column:
        return F.transform(listed, lambda first, r: build(first, F.coalesce(F.get(listed, r + 1), n) - first))

    return let(starts, each)


def _places(listed: Column, holds) -> Column:
    """Places from 0 at which ``holds(place)``."""
    every = F.when(F.size(listed) > 0, F.sequence(F.lit(0), F.size(listed) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, holds)


def inherit_repeats(sections: Column) -> Column:
    """A heading equal to the one before it continues that section: same category, score and flag."""

    def joined(both: Column) -> Column:
        rows, keys = both["rows"], both["keys"]
        starts = _places(keys, lambda i: (i == 0) | (F.get(keys, i) != F.get(keys, i - 1)))

        def run(first: Column, length: Column) -> Column:
            head = F.get(rows, first)
            return F.transform(F.slice(rows, first + 1, length), lambda s, k: F.struct(
                s["heading"].alias("heading"), s["content"].alias("content"), head["category"].alias("category"), head["score"].alias("score"),
                head["confident"].alias("confident"), (k > 0).alias("continuation")))

        return F.flatten(_runs(F.size(rows), starts, run))

    keyed = F.struct(sections.alias("rows"), F.transform(sections, lambda s: F.lower(tx.strip(s["heading"]))).alias("keys"))
    return let(keyed, joined)


def mark_chains(sections: Column) -> Column:
    """Flag runs of headings without content: all suppressed, the last one is an orphan.

    A heading is in a run exactly when it is empty and has a successor, or its predecessor is empty.
    """

    def flags(all_sections: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            opens = (s["content"] == "") & (i < F.size(all_sections) - 1)
            closes = (i > 0) & (F.coalesce(F.get(all_sections, i - 1)["content"], F.lit("-")) == "")
            return s.withField("suppressed", opens | closes).withField("orphan", closes & ~opens)

        return F.transform(all_sections, one)

    return let(sections, flags)


def orphan_text(sections: Column) -> Column:
    """Content of the first orphan: the description."""
    return F.coalesce(F.get(F.filter(sections, lambda s: s["orphan"]), F.lit(0))["content"], F.lit(""))


def of_category(sections: Column, category: str) -> Column:
    """Items of all confident, unsuppressed sections of a category, in document order."""
    chosen = F.filter(sections, lambda s: s["confident"] & ~s["suppressed"] & (s["category"] == category))
    return F.flatten(F.transform(chosen, lambda s: items(s["content"])))


def faq_pairs(lines: Column) -> Column:
    """A line ending in "?" opens a question; the lines after it, joined by spaces, answer it."""

    def pairs(listed: Column) -> Column:
        asks = _places(listed, lambda i: F.endswith(tx.strip(F.get(listed, i)), F.lit("?")))
        return _runs(F.size(listed), asks, lambda first, length: F.struct(
            F.get(listed, first).alias("question"), tx.strip(F.array_join(F.slice(listed, first + 2, length - 1), " ")).alias("answer")))

    return let(lines, pairs)


def assemble(sections: Column, preamble: Column, stem: Column) -> Column:
    """The nested document: name from the first preamble item, lists by category, FAQ pairs."""
    name = F.coalesce(F.get(items(preamble), F.lit(0)), stem)

    def fields(section: str) -> list[Column]:
        return [drop_labels(of_category(sections, category), name).alias(field)
                for category, (place, field) in fixed.LIST_FIELDS.items() if place == section]

    return F.struct(
        F.struct(name.alias("scheme_name")).alias("metadata"),
        F.struct(orphan_text(sections).alias("description"), *fields("overview")).alias("overview"),
        F.struct(*fields("benefits")).alias("benefits"),
        F.struct(*fields("eligibility")).alias("eligibility"),
        F.struct(*fields("application")).alias("application"),
        faq_pairs(of_category(sections, "faqs")).alias("faq"),
    )


def non_empty_leaves(df, column: str) -> Column:
    """Array of {path, value} of the leaves of a nested column that are not "", [] or null."""
    leaves: list[Column] = []

    def walk(kind, value: Column, path: str) -> None:
        for field in kind.fields:
            here, at = value[field.name], f"{path}.{field.name}" if path else field.name
            if field.dataType.typeName() == "struct":
                walk(field.dataType, here, at)
                continue
            if field.dataType.typeName() == "string":
                present, shown = here != "", here
            elif field.dataType.typeName() == "array":
                present, shown = F.size(here) > 0, F.to_json(here)
            else:
                present, shown = here.isNotNull(), here.cast("string")
            leaves.append(F.when(present, F.struct(F.lit(at).alias("path"), shown.alias("value"))))

    walk(df.schema[column].dataType, F.col(column), "")
    return F.array_compact(F.array(*leaves))
