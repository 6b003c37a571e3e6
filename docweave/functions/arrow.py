"""Arrow-batched functions for what Spark has no expression for, and hooks for user models."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(col: Column) -> Column:
    """Unicode NFKC; ASCII rows skip Python's work by arriving as null."""
    wide = F.when(F.rlike(col, F.lit(r"[^\x00-\x7F]")), col)
    return F.coalesce(_nfkc(wide), col)


def matching_ratio(left: str, right: str) -> float:
    """Matching-block ratio 2M/T of two strings."""
    return SequenceMatcher(None, right, left).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """``matching_ratio`` of two columns; meant for distinct pairs."""
    return pd.Series([matching_ratio(a, b) for a, b in zip(left, right)])


def embedder(load: Callable[[], Callable[[list[str]], list]], prefix: str = "passage: "):
    """Column function for an embedding model: ``load`` runs once per task, vectors are unit length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = load()
        for batch in batches:
            vectors = np.asarray(model([prefix + (v or "") for v in batch]), dtype="float64")
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list((vectors / np.where(norms == 0, 1, norms)).astype("float32")))

    return embed


def hashing_model(width: int = 64) -> Callable[[list[str]], list]:
    """A model-free default: words hashed into ``width`` signed counters."""
    import re
    import zlib

    import numpy as np

    def vectors(texts: list[str]) -> list:
        out = np.zeros((len(texts), width))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                code = zlib.crc32(word.encode("utf-8"))
                out[row, code % width] += 1.0 if code & 0x80000000 else -1.0
        out[~out.any(axis=1), 0] = 1.0
        return list(out)

    return vectors


def answer_model(load: Callable[[], Callable[[list[str]], list[str]]]):
    """Column function for a text model: a batch of prompts in, raw answers out."""

    @F.pandas_udf(T.StringType())
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(list(batch)))

    return answer


def parse_files(files, first: Callable[[bytes], tuple[str, float]], second: Callable[[bytes], tuple[str, float]],
                min_chars: int = 100):
    """Text of binary files; the second parser runs on files where the first finds too little."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                text, confidence = first(bytes(content))
                method = "first"
                if len(text.strip()) < min_chars:
                    (text, confidence), method = second(bytes(content)), "second"
                rows.append((path, text, method, float(confidence)))
            yield pd.DataFrame(rows, columns=["path", "text", "method", "confidence"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, method string, confidence double")
