"""Token ids, counts and packing against the tokenizers library."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from docweave.llm.bpe import PairTable
from docweave.llm.packing import Encoder, pack_documents
from docweave.llm.token_counts import Counter, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["", " ", "  a  b\n\n c ", "x <|endoftext|> y", "x  <|endoftext|>  y<|endoftext|><|startoftext|>", "a 　 b c", "don't I'LL 'S 've",
       "a" * 3000, "É́é İstanbul ΣΑΣ ſ ß", "12345 １２ ٣", "\r\n\tx\x0b\x0cy\x1cz", "<<< |> <|x|>", "😀‍😀 hi", "漢字かな交じり", "ab" * 500 + "!" * 99]


def noise(n, alphabet, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]


TEXTS = ODD + noise(400, " \n\t<|>endoftx'sva1é  .,!İ́", 1)


def library(name):
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name))


def test_counts_are_the_librarys():
    counter = Counter(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    want = [len(e.ids) for e in library("byte_bpe_50k.json").encode_batch(TEXTS, add_special_tokens=False)]
    assert counter.count([t.encode() for t in TEXTS]).tolist() == want


def test_ids_are_the_librarys():
    import pyarrow as pa

    encoder = Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    ids, at = encoder.texts(pa.array(TEXTS))
    want = [e.ids + [1] for e in library("word_bpe_49k.json").encode_batch(TEXTS, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, length int, n_tokens string")


def test_counts_of_rows(spark):
    rows = [(1, "a b", "x", 1, None), (1, "a b", "x", 1, None), (None, None, None, None, None), (3, "", None, None, None)]
    got = sorted(map(tuple, token_counts(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), 1).collect()), key=str)
    assert got == sorted([(1, 3, 2, True)] * 2 + [(None, 0, 0, False), (3, 0, 0, False)], key=str)
    assert token_counts(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("parts,open_windows", [(1, 2), (3, 4)])
def test_packing_is_whole(spark, parts, open_windows):
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    rows = [(i, " ".join(r.choice(["the", "moon", "x1!", "Été"]) for _ in range(r.choice([0, 3, 9, 40, 200]))), None, None, None) for i in range(60)]
    rows += [(None, None, "a", 1, "b"), (60, "", None, None, None)]
    tk = library("word_bpe_49k.json")
    want = {row[0]: tk.encode(row[1] or "", add_special_tokens=False).ids + [1] for row in rows}
    got = pack_documents(frame(spark, rows).repartition(parts), path, 64, open_windows, 2).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        ids = np.frombuffer(p.ids, dtype="<u4").tolist()
        assert len(ids) == p.length and p.doc_tokens == len(want[p.doc_id]) and zlib.crc32(p.ids) >= 0
        docs[p.doc_id].append((p.start, ids))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {d: sum((ids for _, ids in sorted(x)), []) for d, x in docs.items()} == want
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(map(len, want.values())) > 0.8 * 64 * len(sequences)


def test_packing_nothing(spark):
    assert pack_documents(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_million_letters_take_seconds(name):
    r = random.Random(9)
    table, tk = PairTable(open(public_tokenizers.path(name), encoding="utf-8").read()), library(name)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "short", "a" * 50_001, "".join(r.choice("ab") for _ in range(5000)), "", "xyz" * 3000]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    started = time.time()
    ids, ends = table.encode(np.frombuffer("".join(texts).encode(), dtype=np.uint8), offsets)
    assert time.time() - started < 10
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [tk.encode(t, add_special_tokens=False).ids for t in texts]
