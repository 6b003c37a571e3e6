"""Toxicity by a lexicon trie met with Levenshtein automata, and context windows around its hits.

The lexicon (whole words, and stems of inflected words) is learned from labelled texts on top of a given one. Its
trie and the Levenshtein automata of its entries are intersected once into one deterministic automaton, which
runs over all distinct words of a batch at a time. Every hit is scored in its window of words: other hits nearby
and direct address raise it, quotation marks and words of reporting around it lower it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.samples import labelled_sample, remainder
from docweave.llm.token_counts import chunked

FOLDS = 3  # rows of remainder 1 are held out
THRESHOLD = 0.7
MOST = 1500  # labelled documents of a class that lexicon and weights are learned from
SUPPORT = 4, 0.02  # different preceding words that an entry must have in toxic texts: at least, and as a share of these
PURITY = 0.95  # share of toxic texts among the texts with an entry
WINDOW = 10  # words on either side of a hit
QUOTED = 0.4  # factor of a hit between quotation marks or beside a word of reporting
STEM = "*"

#: Insults known without labels, words of reporting, words of address, characters used for others.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum")
REPORTING = ("said", "says", "say", "quote", "quoted", "quotes", "called", "calls", "wrote", "word", "words", "term", "reported")
ADDRESS = ("you", "your", "youre", "you're", "u", "ur")
LOOKALIKES = str.maketrans("01345@$", "oieasas")
QUOTES = "\"“”„«»‘’"


def allowance(entry: str) -> int:
    """Misspellings allowed: none in stems and words under 5 letters, 1 to 8 letters, 2 beyond."""
    return 0 if entry.endswith(STEM) or len(entry) < 5 else 1 if len(entry) <= 8 else 2


class Automaton:
    """The words within reach of a lexicon: a table of states and character classes.

    A state is a set of (trie node, misspellings so far). ``value`` of a state is what a word that ends there is
    worth: 0 nothing, 1 + misspellings otherwise. A stem's end is a state of its own that no character leaves.
    """

    def __init__(self, entries: list[str]):
        kids: list[dict[str, int]] = [{}]
        room, ends = [0], {}
        stems = set()
        for entry in sorted(set(entries)):
            word, node, most = entry.removesuffix(STEM), 0, allowance(entry)
            room[0] = max(room[0], most)
            for c in word:
                if c not in kids[node]:
                    kids[node][c] = len(kids)
                    kids.append({})
                    room.append(0)
                node = kids[node][c]
                room[node] = max(room[node], most)
            if entry.endswith(STEM):
                stems.add(node)
            else:
                ends[node] = most
        self.letters = sorted({c for k in kids for c in k})
        self.classes = {c: i + 1 for i, c in enumerate(self.letters)}

        def closed(states: dict[int, int]) -> frozenset | None:
            """With letters left out; None when a stem is complete."""
            todo, least = list(states.items()), dict(states)
            while todo:
                node, wrong = todo.pop()
                if node in stems:
                    return None
                for kid in kids[node].values():
                    if wrong + 1 <= room[kid] and wrong + 1 < least.get(kid, 99) and kid not in stems:
                        least[kid] = wrong + 1
                        todo.append((kid, wrong + 1))
            return frozenset(least.items())

        dead, stem = frozenset(), None
        numbers: dict[frozenset | None, int] = {dead: 0, stem: 1}
        start = closed({0: 0})
        numbers[start] = self.start = 2
        queue, table = [start], {0: [0] * (len(self.letters) + 1), 1: [1] * (len(self.letters) + 1)}
        while queue:
            state = queue.pop()
            row = []
            for letter in [None, *self.letters]:
                after: dict[int, int] = {}
                for node, wrong in state:
                    moves = [(node, wrong + 1)] if room[node] > wrong else []
                    moves += [(kid, wrong + (c != letter)) for c, kid in kids[node].items()]
                    for kid, w in moves:
                        if w <= room[kid] and w < after.get(kid, 99) and not (w and kid in stems):
                            after[kid] = w
                to = closed(after)
                if to not in numbers:
                    numbers[to] = len(numbers)
                    queue.append(to)
                row.append(numbers[to])
            table[numbers[state]] = row
        self.table = np.array([table[i] for i in range(len(numbers))], dtype=np.int32)
        self.value = np.zeros(len(numbers), dtype=np.int8)
        self.value[1] = 1
        for state, number in numbers.items():
            fits = [w for node, w in state or () if node in ends and w <= ends[node]]
            if fits:
                self.value[number] = 1 + min(fits)
        codes = np.zeros(0x250, dtype=np.int32)
        self.other = {}
        for c, i in self.classes.items():
            if ord(c) < len(codes):
                codes[ord(c)] = i
            else:
                self.other[ord(c)] = i
        self.codes = codes

    def values(self, words: list[str]) -> np.ndarray:
        """What each word is worth; all words advance by one letter at a time, dead ones drop out."""
        states = np.full(len(words), self.start, dtype=np.int32)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        classes = np.where(points < len(self.codes), self.codes[np.minimum(points, len(self.codes) - 1)], 0)
        for point, i in self.other.items():
            classes[points == point] = i
        begin = np.cumsum(sizes) - sizes
        going, at = np.flatnonzero(sizes > 0), 0
        while len(going):
            states[going] = self.table[states[going], classes[begin[going] + at]]
            at += 1
            going = going[(states[going] > 1) & (sizes[going] > at)]
        return self.value[states]


def plain(word: str) -> str:
    """Lower case without marks around it, lookalike characters replaced."""
    return word.lower().strip(".,;:!?()[]{}<>*_-'" + QUOTES).translate(LOOKALIKES)


@dataclass
class Toxicity:
    """A fitted model: lexicon, and weights of the document features."""

    entries: list[str] = field(default_factory=lambda: list(LEXICON))
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 3.0, 2.0, 1.0]))

    def features(self, texts: pa.Array, automaton: Automaton) -> np.ndarray:
        """Per text: 1, the greatest hit, log(1 + sum of hits), log(1 + hits per 100 words)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten().dictionary_encode()
        words, index = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        at = (lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]).astype(np.int64)
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        if not words:
            return out
        bare = [plain(w) for w in words]
        value = automaton.values(bare)
        hits = np.flatnonzero(value[index] > 0)
        if not len(hits):
            return out
        marks = [w.strip(".,;:!?()") for w in words]
        opens = np.array([w[:1] in QUOTES and w != "" for w in marks])[index]
        closes = np.array([w[-1:] in QUOTES and w != "" for w in marks])[index]
        reports, address = (np.array([w in known for w in bare])[index] for known in (set(REPORTING), set(ADDRESS)))
        owner = np.searchsorted(at, hits, side="right") - 1
        lo, hi = np.maximum(at[owner], hits - WINDOW), np.minimum(at[owner + 1], hits + WINDOW + 1)

        def within(flag: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            running = np.r_[0, np.cumsum(flag)]
            return running[np.maximum(a, b)] - running[a]

        is_hit = value[index] > 0
        nearby = within(is_hit, lo, hi) - 1
        quoted = (within(opens, lo, hits + 1) > within(closes, lo, hits)) & (within(closes, hits, hi) > 0)
        quoted |= within(reports, np.maximum(lo, hits - 3), np.minimum(hi, hits + 4)) > 0
        score = 0.5 ** (value[index[hits]] - 1.0)
        score *= np.where(quoted, QUOTED, 1) * (1 + 0.25 * np.minimum(nearby, 3) + 0.25 * (within(address, np.maximum(lo, hits - 5), np.minimum(hi, hits + 6)) > 0))
        np.maximum.at(out[:, 1], owner, score)
        total = np.bincount(owner, score, len(texts))
        out[:, 2] = np.log1p(total)
        out[:, 3] = np.log1p(100 * total / np.maximum(1, np.diff(at)))
        return out

    def scores(self, texts: pa.Array, automaton: Automaton) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts, automaton) @ self.weights, -30, 30)))


def learn_lexicon(rows: list[tuple[str, int, float]], support: tuple[int, float] = SUPPORT, purity: float = PURITY) -> list[str]:
    """Words and stems that mark toxic texts, wherever they stand.

    An entry's support counts the different words before it, so words that come with copied text have little. Of a
    word and its beginnings the shortest pure one is taken, and lengthened as long as its support stays.
    """
    before: dict[str, set[str]] = defaultdict(set)
    texts = {0: Counter(), 1: Counter()}
    for text, label, weight in rows:
        words = [plain(w) for w in text.split()]
        keys = set()
        for last, word in zip(["", *words], words):
            if 3 <= len(word) <= 40:
                own = [word] + [word[:k] + STEM for k in range(4, min(len(word), 12) + 1)]
                keys.update(own)
                if label:
                    for k in own:
                        before[k].add(last)
        for k in keys:
            texts[label][k] += weight
    least = max(support[0], support[1] * sum(y for _, y, _ in rows))
    pure = {k: len(b) for k, b in before.items() if len(b) >= least and texts[1][k] >= purity * (texts[0][k] + texts[1][k])}
    found: list[str] = []  # stems first, shortest first
    for key in sorted((k for k in pure if k.endswith(STEM)), key=len):
        if any(key.startswith(f.removesuffix(STEM)) or f.startswith(key[:-1]) for f in found):
            continue
        root, best = key, key
        while True:
            longer = [k for k in pure if len(k) == len(best) + 1 and k.endswith(STEM) and k.startswith(best[:-1]) and pure[k] >= 0.95 * pure[root]]
            if not longer:
                break
            best = max(longer, key=pure.get)
        word = best[:-1]
        found.append(word if pure.get(word, 0) >= 0.95 * pure[root] else best)
    found += [k for k in pure if not k.endswith(STEM) and not any(k.startswith(f.removesuffix(STEM)) for f in found)]
    return sorted(set(found))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Toxicity:
    """Lexicon and weights from training rows alone: at most ``most`` documents of each class."""
    rows, share = labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), FOLDS) != 1, most)
    return fit_rows(rows)


def fit_rows(rows: list[tuple[str, int, float]]) -> Toxicity:
    model = Toxicity()
    if len({y for _, y, _ in rows}) < 2:
        return model
    model.entries = sorted({*LEXICON, *learn_lexicon(rows)})
    x = model.features(pa.array([t for t, _, _ in rows]), Automaton(model.entries))
    y, w = np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows])
    w /= w.sum()
    beta, prior = model.weights.copy(), model.weights.copy()
    for _ in range(30):  # Newton steps towards the prior weights, so that separable samples keep finite ones
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 1e-3 * (beta - prior)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 2 / (np.abs(step).max() + 1e-12))
    model.weights = beta
    return model


def toxicity_scores(docs: DataFrame, model: Toxicity) -> DataFrame:
    """Per row: doc_id and score (0 to 1) of the whole text, in one pass without a shuffle.

    Null and empty texts have no hits and get the score of such texts. Rows are scored one by one, whatever their
    ids; other columns are ignored; empty tables stay empty. A task holds 8 MB of text or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.entries)
        for batch in batches:
            texts = batch["text"]
            parts = chunked([range(n or 0) for n in pc.binary_length(texts).to_pylist()])
            scores = [model.scores(texts.slice(a, b - a), automaton) for a, b in parts]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(scores or [np.zeros(0)]))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``threshold``) of every row."""
    scores = toxicity_scores(docs, fit_toxicity(docs, labels, most))
    return scores.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 1).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
