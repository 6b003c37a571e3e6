"""Packing tokenised documents into windows of fixed size, online and in bounded space.

Each task keeps a fixed number of open windows. A document's ids are cut into whole windows and a rest; the rest
goes to the open window it fits best. When none fits, the fullest window is filled up with the head of the rest
and emitted, and the tail starts again. The windows still open at the end of a task are merged, by the same rule
but without cutting, in a second pass over groups of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.bpe import PairTable, gather
from docweave.llm.token_counts import chunked
from docweave.streaming.files import stored

WINDOW = 2048
OPEN = 16  # open windows of a task
MERGE = 64  # tasks whose left-over windows are merged in one task
END = 1  # id that closes a document

#: Fixed value: the pre-token pattern of vocabularies with word ends.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of printable ASCII and composed Latin letters: normal forms and lower case leave their pre-tokens alone.
SIMPLE = "^[!-~À-ÖØ-öø-įı-ſ]+$"

PIECE = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint, "
         "open boolean, task int")


class Encoder:
    """Ids as the tokenizers library gives them for a lower-casing vocabulary with word ends, without added tokens.

    White space is dropped by such vocabularies, so texts are cut at ASCII white space and every distinct word is
    encoded once: simple words by ``bpe``, all others by the library itself.
    """

    def __init__(self, model_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model_json)
        self.pairs = PairTable(model_json)
        self.pattern = regex.compile(PATTERN)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct words."""
        simple = pc.and_(pc.match_substring_regex(words, SIMPLE), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(words.filter(pa.array(simple))).dictionary_encode()
        split = [self.pattern.findall(w) for w in lower.dictionary.to_pylist()]
        distinct = pa.array([t for tokens in split for t in tokens], pa.large_string()).dictionary_encode()
        _, spans, raw = distinct.dictionary.buffers()
        spans = np.frombuffer(spans, dtype=np.int64)[: len(distinct.dictionary) + 1]
        ids, at = self.pairs.encode(np.frombuffer(raw or b"", dtype=np.uint8)[: spans[-1]], spans)
        tokens = distinct.indices.to_numpy() if len(distinct) else np.zeros(0, dtype=np.int64)
        ids, sizes = gather(ids, at[:-1][tokens], np.diff(at)[tokens]), np.diff(at)[tokens]
        owner = np.repeat(np.arange(len(split)), [len(t) for t in split])
        per_word = np.bincount(owner, sizes, len(split)).astype(np.int64)
        first = np.cumsum(per_word) - per_word
        which = lower.indices.to_numpy()
        odd = [e.ids for e in self.library.encode_batch_fast(words.filter(pa.array(~simple)).to_pylist(), add_special_tokens=False)]
        counts, starts = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        counts[simple], starts[simple] = per_word[which], first[which]
        odd_counts = np.array([len(x) for x in odd], dtype=np.int64)
        counts[~simple], starts[~simple] = odd_counts, len(ids) + np.cumsum(odd_counts) - odd_counts
        values = np.concatenate([ids, np.array([i for x in odd for i in x], dtype=np.int32)])
        return gather(values, starts, counts), np.r_[0, np.cumsum(counts)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts, each closed by ``END``."""
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        ids, at = self.words(flat.dictionary) if len(flat.dictionary) else (np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64))
        ids, starts, sizes = np.r_[ids, END].astype(np.int32), np.r_[at[:-1], len(ids)], np.r_[np.diff(at), 1]
        ends = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        order = np.insert(flat.indices.to_numpy().astype(np.int64), ends, len(at) - 1)
        total = np.r_[0, np.cumsum(sizes[order])]
        return gather(ids, starts[order], sizes[order]), total[np.r_[0, ends + 1 + np.arange(len(ends))]]


class Windows:
    """The open windows of a task: best fit, emit the fullest."""

    def __init__(self, window: int, open_: int, first_id: int):
        self.window, self.most, self.next_id = window, open_, first_id
        self.held: list[list] = []  # used, sequence id

    def place(self, size: int) -> tuple[int, int] | None:
        """Sequence id and offset for a piece that fits an open window best, or a new one; None when all are taken."""
        best = None
        for w in self.held:
            if w[0] + size <= self.window and (best is None or w[0] > best[0]):
                best = w
        if best is None:
            if len(self.held) == self.most:
                return None
            best = [0, self.next_id]
            self.next_id += 1
            self.held.append(best)
        best[0] += size
        spot = best[1], best[0] - size
        if best[0] == self.window:
            self.held.remove(best)
        return spot

    def fullest(self) -> list:
        """Take the fullest window out."""
        best = max(self.held, key=lambda w: w[0])
        self.held.remove(best)
        return best


def pack_documents(docs: DataFrame, model_path: str, window: int = WINDOW, open_windows: int = OPEN, merge: int = MERGE) -> DataFrame:
    """Pieces of all documents in their sequences: doc_id, start, length, doc_tokens, ids (unsigned little-endian
    32-bit numbers), sequence_id, offset.

    A document's ids are those of the tokenizers library for ``model_path`` (a file, read on the driver and sent
    to the tasks), without special tokens added, then ``END``; null counts as an empty text, which is ``END`` alone.
    Each id lies in exactly one piece and the pieces of a sequence are gapless from offset 0. Repeated rows and
    null ids are packed row by row. An empty table gives no pieces.

    Memory: a task holds 8 MB of text (or one longer text) and the sizes of its open windows. The pieces are written
    once to a shared table, so ids stay the same when executors are lost; only pieces of windows left open, at most
    ``open_windows`` a task, are shuffled.
    """
    with open(model_path, encoding="utf-8") as file:
        model_json = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, windows = Encoder(model_json), Windows(window, open_windows, task << 32)
        left: dict[int, list] = {}  # pieces of the open windows
        for batch in batches:
            sizes = [len(t or "") for t in batch["text"].to_pylist()]
            for a, b in chunked([range(n) for n in sizes]):
                texts = pc.fill_null(batch["text"].slice(a, b - a), "")
                ids, at = encoder.texts(texts)
                done: list = []
                for doc_id, lo, hi in zip(batch["doc_id"].slice(a, b - a).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    for piece in _pieces(windows, doc_id, lo, hi, ids):
                        left.setdefault(piece[5], []).append(piece)
                        if piece[6] + piece[2] == window:
                            done += left.pop(piece[5])
                yield _batch(done, False, task)
        yield _batch([p for pieces in left.values() for p in pieces], True, task)

    pieces = stored(docs.select("doc_id", "text").mapInArrow(run, PIECE), "packed", "open")
    closed = pieces.where("not open").drop("open", "task")
    return closed.unionByName(_merged(pieces.where("open"), window, merge))


def _pieces(windows: Windows, doc_id, lo: int, hi: int, ids: np.ndarray) -> Iterator[tuple]:
    size, at = windows.window, lo
    while at < hi:
        n = min(size, hi - at)
        spot = windows.place(n) if n < size else None
        if n == size:
            spot = windows.next_id, 0
            windows.next_id += 1
        elif spot is None:
            full = windows.fullest()
            n = min(n, size - full[0])
            spot = full[1], full[0]
        yield doc_id, at - lo, n, hi - lo, ids[at:at + n].astype("<u4").tobytes(), spot[0], spot[1]
        at += n


def _batch(pieces: list, open_: bool, task: int) -> pa.RecordBatch:
    columns = list(zip(*pieces)) if pieces else [[]] * 7
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    arrays += [pa.array([open_] * len(pieces), pa.bool_()), pa.array([task] * len(pieces), pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECE.split(", ")])


def _merged(pieces: DataFrame, window: int, merge: int) -> DataFrame:
    """Left-over windows put together, best fit decreasing, in groups of ``merge`` tasks; ids of emptied windows go."""
    columns = [x for x in PIECE.split(", ") if x.split()[0] not in ("open", "task")]

    def run(table: pa.Table) -> pa.Table:
        import pandas as pd

        rows = table.drop_columns(["open", "task"]).to_pandas()
        used = rows.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
        bins: list[list] = []
        moved = {}
        for sequence, size in used.items():
            best = max((b for b in bins if b[0] + size <= window), key=lambda b: b[0], default=None)
            if best is None:
                bins.append(best := [0, sequence])
            moved[sequence] = best[1], best[0]
            best[0] += size
        target = rows["sequence_id"].map(lambda s: moved[s][0])
        rows["offset"] += rows["sequence_id"].map(lambda s: moved[s][1])
        rows["sequence_id"] = target
        return pa.Table.from_pandas(rows.astype({"doc_id": pd.Int64Dtype()}), schema=table.drop_columns(["open", "task"]).schema, preserve_index=False)

    group = F.floor(F.col("task") / merge).alias("group")
    return pieces.groupBy(group).applyInArrow(run, ", ".join(columns))
