"""Token counts of texts by rank-synchronous merging of ragged arrays.

Each batch of texts is cut at spaces before which a pre-token always ends, equal pieces are counted once, the
library's pattern splits the distinct pieces into pre-tokens, and ``bpe`` merges the distinct pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docweave.llm.bpe import PairTable

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_BYTES = 8 << 20  # bytes of text handled at once


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets of the pieces: texts, cut before each space whose next character begins a word.

    A space before a character that is not white space begins a pre-token. Spaces before white space, before a
    byte that may begin white space outside ASCII, and before < (special strings) are left inside a piece.
    """
    after = np.zeros(256, dtype=bool)
    after[33:] = True
    after[[0x3C, 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
    cut = np.ones(len(data) + 1, dtype=bool)
    cut[1:-1] = False
    cut[:-2] |= (data[:-1] == 32) & after[data[1:]]
    cut[starts] = True
    return np.flatnonzero(cut)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Counter:
    def __init__(self, model_json: str):
        import json

        self.pairs = PairTable(model_json)
        self.pattern = regex.compile(PATTERN)
        self.specials = sorted((t["content"] for t in json.loads(model_json)["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def pre_tokens(self, piece: str) -> tuple[list[str], int]:
        """Pre-tokens of a piece and the number of special strings in it."""
        if self.special is None or "<" not in piece or not self.special.search(piece):
            return self.pattern.findall(piece), 0
        parts = self.special.split(piece)
        return [t for part in parts for t in self.pattern.findall(part)], len(parts) - 1

    def count(self, texts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        bounds = np.r_[0, np.cumsum(lengths)]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64)
        offsets = cuts(data, bounds[:-1])
        pieces = _strings(data, offsets).dictionary_encode()
        split = [self.pre_tokens(p) for p in pieces.dictionary.to_pylist()]
        owners = np.repeat(np.arange(len(split)), [len(t) for t, _ in split])
        distinct = pa.array([t for tokens, _ in split for t in tokens], pa.large_string()).dictionary_encode()
        _, spans, raw = distinct.dictionary.buffers()
        spans = np.frombuffer(spans, dtype=np.int64)[: len(distinct.dictionary) + 1]
        _, out = self.pairs.encode(np.frombuffer(raw or b"", dtype=np.uint8)[: spans[-1]], spans)
        per_token = np.diff(out)[distinct.indices.to_numpy()] if len(distinct) else np.zeros(0, dtype=np.int64)
        per_piece = np.bincount(owners, per_token, len(split)).astype(np.int64) + np.array([n for _, n in split])
        running = np.r_[0, np.cumsum(per_piece[pieces.indices.to_numpy()])]
        return np.diff(running[np.searchsorted(offsets, bounds)])


def chunked(texts: list, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def token_counts(docs: DataFrame, model_path: str, limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), by a byte-level vocabulary file.

    ``model_path`` is a file of the tokenizers library, read on the driver and sent to the tasks (its size is that
    of the vocabulary). Null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as one
    token each, as the library does by default; rows with equal or null doc_id are counted one by one. Needs no
    shuffle. A task holds ``PIECE_BYTES`` of text at a time, or one longer text.
    """
    with open(model_path, encoding="utf-8") as file:
        model_json = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_json)
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            counts = np.concatenate([counter.count(texts[a:b]) for a, b in chunked(texts)] or [np.zeros(0, dtype=np.int64)])
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes), pa.array(counts, pa.int64()), pa.array(counts > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
