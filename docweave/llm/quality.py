"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from how its bytes and words are made up; a gated
attention, learned from the labels of whole documents, weighs the passages; the weighted mean is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.samples import labelled_sample, remainder
from docweave.llm.token_counts import chunked

PASSAGE = 512  # bytes, to the next white space
MOST = 1000  # labelled documents of a class that the model is fitted on
HIDDEN, GATE, EPOCHS, RATE = 16, 8, 150, 0.03
FOLDS = 5  # rows of remainder 0 are held out
THRESHOLD = 0.3

_KINDS = np.zeros(256, dtype=np.uint8)  # 0: other control bytes
for _kind, _bytes in enumerate([b" \t\x0b\x0c\r", b"\n", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:?'\"()-",
                                b"!", b"|", b"#$%&*@^~+=<>_/\\`[]{}", bytes(range(128, 256))], start=1):
    _KINDS[list(_bytes)] = _kind
N_KINDS = 11
FEATURES = N_KINDS + 8


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of all texts, and the number of passages of each text (an empty one has one)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    kinds = _KINDS[data]
    white = (kinds == 1) | (kinds == 2)
    starts_word = ~white & np.r_[True, white[:-1]]
    # passages begin at a text's start and at the first word start after each PASSAGE bytes
    words = np.flatnonzero(starts_word)
    owner = np.searchsorted(begin, words, side="right") - 1
    step = (words - begin[owner]) // PASSAGE
    new = np.r_[True, (step[1:] != step[:-1]) | (owner[1:] != owner[:-1])] if len(words) else np.zeros(0, dtype=bool)
    cuts = np.unique(np.r_[begin, words[new & (step > 0)]])
    counts = np.bincount(np.searchsorted(begin, cuts, side="right") - 1, minlength=len(texts))
    sizes = np.diff(np.r_[cuts, len(data)]).astype(np.float64)
    passage = np.repeat(np.arange(len(cuts)), sizes.astype(np.int64))
    made = np.bincount(passage * N_KINDS + kinds, minlength=len(cuts) * N_KINDS).reshape(-1, N_KINDS) / sizes[:, None]
    ends = np.flatnonzero(~white & np.r_[white[1:], True])
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(7)) ** np.uint64(3) * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)]
    names = (sums[ends + 1] - sums[words]) ^ (data[words].astype(np.uint64) << np.uint64(8)) ^ (ends - words).astype(np.uint64)
    of = passage[words]
    n_words = np.maximum(1, np.bincount(of, minlength=len(cuts)))
    same = np.r_[False, (names[1:] == names[:-1]) & (of[1:] == of[:-1])] if len(words) else np.zeros(0, dtype=bool)
    order = np.lexsort((names, of))
    first = np.r_[True, (names[order][1:] != names[order][:-1]) | (of[order][1:] != of[order][:-1])] if len(words) else np.zeros(0, dtype=bool)
    share = lambda flag: np.bincount(of[flag], minlength=len(cuts)) / n_words
    long_ = ends - words + 1
    upper = kinds[words] == 3
    features = np.column_stack([
        made * 4, share(same), np.bincount(of[order[first]], minlength=len(cuts)) / n_words, share(np.isin(kinds[ends], (6,))),
        share(np.isin(kinds[ends], (7, 8, 9))), share(upper), share(long_ == 1), np.bincount(of, long_, len(cuts)) / n_words / 8, np.log1p(n_words) / 4])
    return features, counts


@dataclass
class Attention:
    """Encoder tanh(x A + a); gate tanh(h V) * sigmoid(h U) . w; score sigmoid(z . c + d)."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]

    def forward(self, features: np.ndarray, counts: np.ndarray):
        a, a0, v, u, w, c, d = self.weights
        x = np.clip((features - self.mean) / self.spread, -6, 6)
        starts = np.cumsum(counts) - counts
        h = np.tanh(x @ a + a0)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        raw = (t * s) @ w
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), counts))
        att = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * att[:, None], starts, axis=0)
        return x, h, t, s, att, z, 1 / (1 + np.exp(-np.clip(z @ c + d, -30, 30)))

    def scores(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(features, counts)[-1] if len(counts) else np.zeros(0)


def fit_attention(rows: list[tuple[str, int, float]], share: float, epochs: int = EPOCHS) -> Attention:
    """Fitted by Adam on all passages of the labelled rows; without rows of both classes every score is ``share``."""
    features, counts = passage_features([t.encode() for t, _, _ in rows] or [b""])
    labels = np.array([y for _, y, _ in rows] or [0], dtype=np.float64)
    weight = np.array([w for _, _, w in rows] or [1.0])
    weight /= weight.sum()
    r = np.random.default_rng(7)
    weights = [r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
               r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), r.normal(0, GATE**-0.5, GATE), np.zeros(HIDDEN), np.array(0.0)]
    share = min(max(share, 1e-3), 1 - 1e-3)
    weights[6] = np.array(np.log(share / (1 - share)))
    model = Attention(features.mean(axis=0), features.std(axis=0) + 0.02, weights)
    if len(set(labels.tolist())) < 2:
        return model
    first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
    for turn in range(1, epochs + 1):
        a, a0, v, u, w, c, d = model.weights
        x, h, t, s, att, z, p = model.forward(features, counts)
        g = (p - labels) * weight
        gz = g[:, None] * c
        gz_each = np.repeat(gz, counts, axis=0)
        g_att = (gz_each * h).sum(axis=1)
        starts = np.cumsum(counts) - counts
        g_raw = att * (g_att - np.repeat(np.add.reduceat(att * g_att, starts), counts))
        gt, gs = g_raw[:, None] * w * s * (1 - t * t), g_raw[:, None] * w * t * s * (1 - s)
        gh = (gz_each * att[:, None] + gt @ v.T + gs @ u.T) * (1 - h * h)
        grads = [x.T @ gh, gh.sum(axis=0), h.T @ gt, h.T @ gs, (t * s).T @ g_raw, z.T @ g, g.sum()]
        for k, (p_, g_) in enumerate(zip(model.weights, grads)):
            g_ = g_ + 1e-5 * p_
            first[k] = 0.9 * first[k] + 0.1 * g_
            second[k] = 0.999 * second[k] + 0.001 * g_ * g_
            step = first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-9)
            model.weights[k] = p_ - RATE * step
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Attention:
    """A model of ``labels.quality`` from training rows alone: at most ``most`` documents of each class."""
    rows, share = labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), FOLDS) != 0, most)
    return fit_attention(rows, share)


def quality_scores(docs: DataFrame, model: Attention) -> DataFrame:
    """Per row: doc_id, score (0 to 1) and n_passages of the whole text, in one pass without a shuffle.

    Null and empty texts are one empty passage. Rows are scored one by one, whatever their ids; other columns are
    ignored; empty tables stay empty. A task holds 8 MB of text or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            scores, n = [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
            for a, b in chunked(texts, 2 << 20):
                features, counts = passage_features(texts[a:b])
                scores.append(model.scores(features, counts))
                n.append(counts)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(scores)), pa.array(np.concatenate(n), pa.int64())],
                                             ["doc_id", "score", "n_passages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, n_passages bigint")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``threshold``) and n_passages of every row."""
    scores = quality_scores(docs, fit_quality(docs, labels, most))
    return scores.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def keep_quality(docs: DataFrame, model: Attention, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            scores = [model.scores(*passage_features(texts[a:b])) for a, b in chunked(texts, 2 << 20)]
            yield batch.filter(pa.array(np.concatenate(scores or [np.zeros(0)]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
