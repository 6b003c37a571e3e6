"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash of every ``GRAM`` bytes triggers phrases: the smallest hash of each ``LENGTH``-byte string is its
trigger, and a phrase is the run of strings with one trigger. Phrases overlap by ``LENGTH`` - 1 bytes, so every
string lies in exactly one phrase, and equal strings have their trigger in the same place whatever surrounds
them. The distinct phrases are the dictionary; the documents in their order, as places of phrases, are the parse.

Sorting the parse by trigger and phrase gives each phrase's first place in the corpus, which settles repetitive
text: all later places of a phrase are repeats as a whole, and phrases whose trigger has no other phrase hold no
repeats. Only suffixes of different phrases of one trigger are left. They are sorted in the same way twice more, as
blocks of ``SUFFIXES`` neighbouring suffixes and one by one. The order is that of 128-bit hashes in place of the
bytes, since only equality counts, and within equal ones that of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.ordering import ordered_scan
from docweave.streaming.files import stored

LENGTH = 100  # bytes of a repeated string
GRAM = 24  # bytes of a trigger
SUFFIXES = 8  # neighbouring suffixes of a phrase that are sorted together before one by one
PART = 2 << 20  # bytes handled at once; longer texts are cut into overlapping parts

_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = np.random.default_rng(2).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_MINUS = -(1 << 63)  # the place of a null doc_id in the corpus order: before all others


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Roller:
    """Hashes of all substrings of one buffer."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.powers = length, gram, [_powers(b, 1) for b in _BASE]

    def load(self, data: np.ndarray) -> None:
        if len(self.powers[0][0]) < len(data) + 1:
            self.powers = [_powers(b, max(len(data), PART + self.length) + 1) for b in _BASE]
        self.data, n = data, len(data)
        self.sums = [np.r_[np.zeros(1, np.uint64), np.cumsum(_BYTES[k][data] * self.powers[k][0][:n], dtype=np.uint64)] for k in range(2)]

    def hashes(self, k: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[k][ends] - self.sums[k][starts]) * self.powers[k][1][starts])

    def triggers(self) -> np.ndarray:
        """Position of the smallest gram hash (of equal ones the last) in each string of ``length`` bytes."""
        n = len(self.data) - self.gram + 1
        width = self.length - self.gram + 1
        here = np.arange(n)
        bits = np.uint64(max(1, int(n).bit_length()))
        low = np.uint64((1 << int(bits)) - 1)
        grams = _mixed((self.sums[0][self.gram:] - self.sums[0][:n]) * self.powers[0][1][:n])
        keys = (grams & ~low) | (low - here.astype(np.uint64))
        rows = -(-n // width)
        padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = keys
        grid = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - width + 1
        return (low - (np.minimum(back[:count], ahead[width - 1:width - 1 + count]) & low)).astype(np.int64)


def _parts(texts: list[bytes], order: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (text, from, to) of about ``PART`` bytes; the parts of a long text share length - 1 bytes."""
    held: list[tuple[int, int, int]] = []
    size = 0
    for i in order:
        n = len(texts[i])
        for lo in range(0, max(1, n - length + 1), PART):
            hi = min(n, lo + PART + length - 1)
            if hi - lo < length:
                continue
            if held and size + hi - lo > PART + length:
                yield held
                held, size = [], 0
            held.append((i, lo, hi))
            size += hi - lo
    if held:
        yield held


ROW = "key bigint, phrase bigint, doc bigint, place bigint, count int"
_TEXT = 31  # bits of a place within its text; the checksum of the text stands above them


def _rows(key, phrase, doc, place, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(doc), pa.array(place),
                                       pa.array(count.astype(np.int32))], [c.split()[0] for c in ROW.split(", ")])


def _phrases(length: int, gram: int):
    """The phrases of each batch. Known repeats have a negative count, of strings, and a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(length, gram)
        for batch in batches:
            texts, ids = [t.encode() for t in batch["text"].to_pylist()], batch["doc"].to_numpy()
            crcs = batch["crc"].to_numpy() << _TEXT
            for parts in _parts(texts, np.argsort(ids, kind="stable").tolist(), length):
                doc = np.array([p[0] for p in parts])
                froms, sizes = np.array([p[1] for p in parts]), np.array([p[2] - p[1] for p in parts])
                roller.load(np.frombuffer(b"".join(texts[i][lo:hi] for i, lo, hi in parts), dtype=np.uint8))
                starts = np.cumsum(sizes) - sizes
                part = np.repeat(np.arange(len(parts)), sizes)
                inside = np.flatnonzero(np.arange(len(part)) + length <= (starts + sizes)[part])
                trigger = roller.triggers()[inside]
                new = np.r_[True, (trigger[1:] != trigger[:-1]) | (inside[1:] != inside[:-1] + 1)]
                lo, hi = inside[new], inside[np.r_[np.flatnonzero(new)[1:] - 1, len(inside) - 1]]
                trigger, own = trigger[new], part[lo]
                key = roller.hashes(0, trigger, trigger + gram)
                phrase = roller.hashes(1, lo, hi + length) + (hi - lo).astype(np.uint64)
                text = doc[own]
                place, last = lo - starts[own] + froms[own], hi - starts[own] + froms[own]
                # the later ones of equal phrases of this batch are repeats: their runs go as one row each
                order = np.argsort(phrase, kind="stable")
                same = np.r_[False, (phrase[order][1:] == phrase[order][:-1]) & (key[order][1:] == key[order][:-1])]
                leads = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                again = np.zeros(len(lo), dtype=bool)
                again[order] = same & ((ids[text[order]] > ids[text[leads]]) | (text[order] == text[leads]) & (place[order] > place[leads]))
                first = np.flatnonzero(np.r_[True, ~again[1:] | ~again[:-1] | (text[1:] != text[:-1])])
                last = last[np.r_[first[1:] - 1, len(lo) - 1]]
                key, phrase, text, place, again = key[first], phrase[first], text[first], place[first], again[first]
                salt = _mixed(_mixed(ids[text].astype(np.uint64)) + place.astype(np.uint64))
                count = last - place + 1
                yield _rows(np.where(again, salt, key), np.where(again, salt, phrase), ids[text], crcs[text] + place, np.where(again, -count, count))

    return run


def _suffixes(length: int, gram: int, together: int):
    """The open suffixes of each text, blocks of up to ``together`` neighbours: the key is what all suffixes of a
    full block have in common, the phrase what those of this one cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(length, gram)
        for batch in batches:
            for text, doc, crc, spans in zip(batch["text"], batch["doc"].to_pylist(), batch["crc"].to_pylist(), batch["spans"].to_pylist()):
                data = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                for at in range(0, len(data), PART):
                    ends = [(max(s["lo"], at), min(s["hi"], at + PART - 1)) for s in spans]
                    places = np.concatenate([np.arange(a, b + 1) for a, b in sorted(ends)] or [np.zeros(0, np.int64)])
                    if not len(places):
                        continue
                    roller.load(data[at:at + PART + length - 1])
                    here = places - at
                    trigger = roller.triggers()[here]
                    back = trigger - here
                    block = back // together
                    new = np.r_[True, (trigger[1:] != trigger[:-1]) | (block[1:] != block[:-1]) | (here[1:] != here[:-1] + 1)]
                    first = np.flatnonzero(new)
                    lo, hi = here[first], here[np.r_[first[1:] - 1, len(here) - 1]]
                    core = trigger[first] - block[first] * together
                    key = roller.hashes(0, core, core + length - together + 1) + block[first].astype(np.uint64)
                    phrase = roller.hashes(1, lo, hi + length) + (hi - lo).astype(np.uint64)
                    yield _rows(key, phrase, np.full(len(lo), doc), (crc << _TEXT) + at + lo, hi - lo + 1)

    return run


def _sorted(parse: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that repeat an earlier one as a whole, and rows whose key other phrases have too; both as doc, place, count.

    One exchange by key serves both windows and both results. A key has at most a row for each phrase and batch."""
    parse = parse.repartition("key")
    phrase, key = Window.partitionBy("key", "phrase"), Window.partitionBy("key")
    ranked = parse.withColumn("first", F.min(F.struct("doc", "place")).over(phrase)).withColumns(
        {"few": F.min("phrase").over(key), "most": F.max("phrase").over(key)})
    later = (F.col("count") < 0) | (F.struct("doc", "place") > F.col("first"))
    columns = "doc", "place", F.abs("count").alias("count")
    return ranked.where(later).select(*columns), ranked.where(~later & (F.col("few") != F.col("most"))).select(*columns)


def _per_text(rows: DataFrame) -> DataFrame:
    """doc, crc and spans of every text with rows: as many as its length allows."""
    lo = F.col("place").bitwiseAND((1 << _TEXT) - 1)
    return rows.groupBy("doc", F.shiftright("place", _TEXT).alias("crc")).agg(
        F.collect_list(F.struct(lo.alias("lo"), (lo + F.col("count") - 1).alias("hi"))).alias("spans"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, crc and spans, an array of lo and hi: the strings of ``length`` bytes of the text that start at lo to hi
    also start earlier. ``texts`` has doc, crc and text, none of them null. Texts without repeats are left out."""
    known, open_ = _sorted(texts.mapInArrow(_phrases(length, gram), ROW))
    for together in (SUFFIXES, 1):
        waiting = texts.join(_per_text(open_), ["doc", "crc"]).select("doc", "crc", "text", "spans")
        more, open_ = _sorted(waiting.mapInArrow(_suffixes(length, gram, together), ROW))
        known = known.union(more)
    return _per_text(known)


def named_texts(docs: DataFrame) -> DataFrame:
    """doc, text and crc, which tells the texts of one doc apart.

    It is the CRC-32 of the text. Where different texts of a doc share one, which is looked up among the docs of more
    than one row by 128 more bits, all texts of this doc have their number in the order of these bits instead; such a
    doc may hold any part of the rows.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(_MINUS)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    several = stored(texts.groupBy("doc").count().where("count > 1").select("doc"), "several")
    bits = [F.xxhash64("text").alias("high"), F.xxhash64("text", F.lit(2)).alias("low")]
    if several.isEmpty():
        return texts.withColumn("crc", F.crc32("text"))
    sums = texts.select("doc", F.crc32("text").alias("crc"), *bits).join(several, "doc", "left_semi")
    limits = [f(c).alias(f"{f.__name__}_{c}") for c in ("high", "low") for f in (F.min, F.max)]
    shared = sums.groupBy("doc", "crc").agg(*limits).where("min_high <> max_high or min_low <> max_low")
    shared = stored(shared.select("doc").distinct(), "shared")
    if shared.isEmpty():
        return texts.withColumn("crc", F.crc32("text"))
    different = sums.join(shared, "doc", "left_semi").select("doc", "high", "low").distinct()
    numbers = stored(ordered_scan(different, ["doc"], ["high", "low"], {"nth": F.lit(1)}), "numbers")
    named = texts.select("*", *bits).join(numbers, ["doc", "high", "low"], "left")
    return stored(named.select("doc", "text", F.coalesce("nth", F.crc32("text")).alias("crc")), "named")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that are left.

    Every byte (UTF-8; null counts as empty) of a string of ``length`` bytes that also starts earlier goes: earlier
    is a smaller doc_id (null before all), or the same doc_id and an earlier start. Strings are judged on the input,
    overlaps count, and no string crosses texts. A row repeated with its doc_id and text is one document and gets
    equal results; different texts of one doc_id follow one another in the order of ``named_texts``. Empty tables stay
    empty; other columns are ignored.
    """
    # the same frame each time, so that one exchange of the texts serves all joins
    texts = named_texts(docs)
    spans = repeated_spans(texts, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                data, kept, end, n_spans = text.encode(), [], 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > end or not n_spans:
                        kept.append(data[end:lo])
                        n_spans += 1
                    end = max(end, hi + length)
                kept = b"".join([*kept, data[end:]])
                out.append((len(data), len(data) - len(kept), n_spans, kept))
            columns = list(zip(*out)) if out else [[]] * 4
            ids = pa.array([None if i == _MINUS else i for i in batch["doc"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids] + [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()])],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(spans, ["doc", "crc"], "left").select("doc", "text", "spans").mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


