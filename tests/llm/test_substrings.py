"""Repeated byte strings against a dictionary of all strings."""

import itertools
import random
import zlib

import pytest

from docweave.llm import substring_dedup
from docweave.llm.substring_dedup import remove_repeats


def brute(rows, length):
    seen, out = {}, []
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\1" * length
            seen.setdefault(s, (doc_id, i))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), runs, kept))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = ["the", "été", "moon", "a", "zzz", "ab", "tion", "und"]
    line = " ".join(r.choice(vocab) for _ in range(60))
    rows = ["", None, "x" * 400, "ab" * 300, "x" * 99, "x" * 100, line, line, line + "!" + line]
    for _ in range(60):
        text = " ".join(r.choice(vocab + [str(r.random())[:4]]) for _ in range(r.randint(1, 150)))
        if rows and r.random() < 0.6:
            source = r.choice([t for t in rows if t])
            cut = r.randrange(len(source))
            text = text[: r.randint(0, 80)] + source[cut:cut + r.randint(10, 500)] + text[: r.randint(0, 200)]
        if r.random() < 0.3:
            text = list(text)
            text[r.randrange(len(text))] = "#"
            text = "".join(text)
        rows.append(text)
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("length,gram,part,seed", [(100, 32, 2 << 20, 1), (40, 16, 2 << 20, 2), (100, 32, 300, 3)])
def test_removed(spark, monkeypatch, length, gram, part, seed):
    monkeypatch.setattr(substring_dedup, "PART", part)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", t) for i, t in rows], "doc_id bigint, text string, crc string, spans string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, length, gram).collect())
    assert got == brute(rows, length)


def test_odd_rows(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(90)) + str(2**200)
    rows = [(None, text), (3, text), (3, text), (4, None)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    n = len(text)
    assert got == sorted([(None, n, 0, 0), (3, n, n, 1), (3, n, n, 1), (4, 0, 0, 0)], key=str)
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def clash(length, seed):
    """Two different texts of one length and CRC-32."""
    r, seen = random.Random(seed), {}
    while True:
        text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        at = zlib.crc32(text.encode())
        if at in seen and seen[at] != text:
            return seen[at], text
        seen[at] = text


@pytest.mark.parametrize("id_", [5, None])
def test_texts_of_one_id_and_crc(spark, id_):
    r = random.Random(6)
    shared = "".join(r.choice("abcdefghij ") for _ in range(100))
    one, other = (shared + tail for tail in clash(20, 1))  # CRCs that are equal stay so behind equal bytes
    assert one != other and zlib.crc32(one.encode()) == zlib.crc32(other.encode())
    rows = [(1, shared + "#")] if id_ else []
    rows += [(id_, one), (id_, other), (id_, "a third text " * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted((r.n_bytes, r.n_removed, bytes(r.kept)) for r in remove_repeats(df).collect())
    # the order of an id's texts is theirs to choose, so every order of the three is a right answer
    rest = [x for x in rows if x[0] != id_]
    wants = [sorted((n, gone, kept) for _, n, gone, _, kept in brute(list(enumerate([t for _, t in rest] + list(order))), 100))
             for order in itertools.permutations(t for i, t in rows if i == id_)]
    assert got in wants and sum(x[1] for x in got) >= 100
