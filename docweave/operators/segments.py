"""Texts cut around known names, so that only what lies between them is changed, and put together again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docweave import fixed
from docweave.operators.mentions import MAX_SCAN_NEEDLES, gram_pairs

SEGMENTS = "array<struct<kind:string,part:string>>"
NAME, MARK, TEXT, REST = "name", "mark", "text", "rest"


def longest_spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans (from, to) those that a reader meets who takes the leftmost, of equal starts the longest, and goes on behind it."""
    kept, end = [], 0
    for lo, hi in sorted(found, key=lambda s: (s[0], -s[1])):
        if lo >= end:
            kept.append((lo, hi))
            end = hi
    return kept


def _between(text: str) -> Iterator[tuple[str, str]]:
    """Lines without their list markers are texts; markers, line ends and lines without letters are the rest."""
    letter, lead, trail = (re.compile(p) for p in (fixed.SEGMENT_LETTER, fixed.SEGMENT_LEAD, fixed.SEGMENT_TRAIL))
    for n, line in enumerate(text.split("\n")):
        if n:
            yield REST, "\n"
        if not letter.search(line):
            yield REST, line
            continue
        front = lead.match(line).end()
        back = trail.search(line, front).start()
        yield REST, line[:front]
        yield (TEXT if letter.search(line, front, back) else REST), line[front:back]
        yield REST, line[back:]


def _cut(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    out, end = [], 0
    for lo, hi in [*spans, (len(text), len(text))]:
        out += _between(text[end:lo])
        out.append((MARK if text[lo:hi] == fixed.SEGMENT_MARK else NAME, text[lo:hi]))
        end = hi
    merged: list[dict] = []
    for kind, part in out:
        if part and merged and kind == merged[-1]["kind"] == REST:
            merged[-1]["part"] += part
        elif part:
            merged.append({"kind": kind, "part": part})
    return merged


def _segmented(forms: list[str] | None):
    """The segments of each row; without ``forms`` every row brings the names it is cut at."""

    def automaton_of(names):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in {*names, fixed.SEGMENT_MARK} - {""}:
            automaton.add_word(name, len(name))
        automaton.make_automaton()
        return automaton

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None if forms is None else automaton_of(forms)
        for batch in batches:
            texts = batch["_text"].to_pylist()
            names = batch["_names"].to_pylist() if forms is None else [None] * len(texts)
            cut = [None if t is None else _cut(t, longest_spans([(end + 1 - n, end + 1) for end, n in (shared or automaton_of(own or ())).iter(t)]))
                   for t, own in zip(texts, names)]
            kept = batch.drop_columns(["_text"] if forms is not None else ["_text", "_names"])
            yield kept.append_column("segments", pa.array(cut, pa.list_(pa.struct([("kind", pa.string()), ("part", pa.string())]))))

    return run


def split_around_names(texts: DataFrame, names: DataFrame, text: str = "text", id_: str = "text_id", most: int = MAX_SCAN_NEEDLES) -> DataFrame:
    """``id_`` and segments of every text: names and ``**`` as they are, list markers and line ends, and the texts between.

    ``names`` has name; of names that overlap in a text the leftmost counts, of those that begin there the longest. The
    parts of a text's segments in a row are the text. Null texts have null segments, null and empty names are no names.
    Up to ``most`` names, counted first, are one automaton that runs in the row, and texts are not moved. More names are
    looked up by their grams first (those of at least four characters), and each text is joined with the few it holds.
    """
    known = names.select(F.col("name").alias("needle")).filter("needle <> ''").distinct()
    rows = known.take(most + 1)
    out = f"{id_} {dict(texts.dtypes)[id_]}, segments {SEGMENTS}"
    said = texts.select(id_, F.col(text).alias("_text"))
    if len(rows) <= most:
        return said.mapInArrow(_segmented([r["needle"] for r in rows]), out)
    pairs = gram_pairs(said.select(F.col(id_).alias("hay_id"), F.col("_text").alias("hay")), known.withColumn("needle_id", F.col("needle")), False)
    held = pairs.groupBy(F.col("hay_id").alias(id_)).agg(F.collect_set("needle").alias("_names"))
    return said.join(held, id_, "left").mapInArrow(_segmented(None), out)


def changed_between(segments: Column, change: Callable[[Column], Column]) -> Column:
    """The text again, with ``change`` applied to what lies between names and markers."""
    return F.array_join(F.transform(segments, lambda s: F.when(s["kind"] == TEXT, change(s["part"])).otherwise(s["part"])), "")
