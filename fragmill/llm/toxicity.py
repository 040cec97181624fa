"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Operator 4. Words are compared by the gap-weighted subsequence kernel of order three: every common subsequence of three
letters counts DECAY to the power of the stretch it takes in either word, so inserted characters and gaps weaken a
match instead of ending it. Kernel values at the landmarks, whitened, are the features of a linear machine with squared
hinge loss. The machine is linear in the kernel's own features too, so the landmarks fold into one table of weights per
letter triple and a word's decision needs no walk over landmarks. A sentence's decision is the soft maximum of its
words' (SOFTNESS times the logarithm of the sum of exponentials), so several words, none of them telling alone, add up.

It is trained on sentences of labelled documents. A label belongs to a document, so the positive examples are those of a
toxic document's sentences that have a word which toxic documents surely have more often (log odds less their standard
error; where there is none, any word that no other document has), told by the most telling one. Words of the others'
sentences are negative, those with the highest decisions always among them. Landmarks limit the Nystroem map, not what
is learned: every telling word is an example, spellings that differ pool by their kernel, and each of ROUNDS adds
landmarks for words that are misjudged.

A document's score is the logistic of its highest sentence decision. Sentences end after . ! ? with white space and at
line ends; one of more than LONG_SENTENCE words is read in stretches of that many that overlap by half. Letters that are
spaced out one by one are also read as one word. At most about TRAIN_DOCS documents of either label are learned from,
chosen by a hash of their id outside fold 0, and of those at most about TRAIN_SENTENCES sentences of either label, chosen
by a hash of document and place; in these a word counts by its first LONGEST_TRAINED characters, and about
NEGATIVE_WORDS of the other documents' words are examples, besides the hard ones. Null, empty and wordless texts score 0,
as does everything where one label is missing. Repeated rows get equal results and are learned from once; a null doc_id
counts as held out. Scoring reads only the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fragmill.llm.common import forget, hashed_fold, materialise

TRAIN_DOCS, TRAIN_SENTENCES, LONG_SENTENCE, LONGEST_TRAINED = 2000, 60_000, 48, 48
#: Landmarks at first, half of them from toxic sentences; those that a round may add; the kernel of one with another, at most.
LANDMARKS, MORE_LANDMARKS, TOO_NEAR = 96, 16, 0.8
#: Rounds, and the log odds that a word must surely have to be telling.
ROUNDS, SURE = 3, 3.0
#: Negative words, those that score highest and are added in a round, and their weight.
NEGATIVE_WORDS, HARD_WORDS, HARD_WEIGHT = 8_000, 400, 20.0
DECAY, STRETCH, LONGEST, SOFTNESS = 0.6, 8, 24, 0.05
#: Soft margin, steepness of the score, words remembered by a worker.
COST, STEEPNESS, REMEMBERED = 300.0, 6.0, 500_000
_SENTENCE = re.compile(r"[.!?]+\s+|\n")
_SPACED = re.compile(r"(?<!\S)\w(?: \w){3,}(?!\S)")
_MARKS = "\"'#*$%&|<>.,;:!?()[]{}-_=+~`/\\"
#: Letter codes: a-z, the letters U+00E0 to U+00FF, and a word's two ends; all else is a gap.
LETTERS, ENDS = 64, "<>"
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[0xE0:0x100] = np.arange(27, 59)
_CODE[[ord(c) for c in ENDS]] = 59, 60


def sentences_of(text: str) -> list[set[str]]:
    """Distinct lower-case words, stripped of marks at their ends, of each sentence or stretch; spaced-out words joined."""
    found = []
    for sentence in _SENTENCE.split(text.lower()):
        tokens = sentence.split()
        if len(tokens) > 3:
            tokens += [m[0].replace(" ", "") for m in _SPACED.finditer(sentence)]
        for k in range(0, max(1, len(tokens) - LONG_SENTENCE // 2), LONG_SENTENCE // 2):
            words = {t.strip(_MARKS) for t in (tokens if len(tokens) <= LONG_SENTENCE else tokens[k : k + LONG_SENTENCE])}
            words.discard("")
            if words:
                found.append(words)
            if len(tokens) <= LONG_SENTENCE:
                break
    return found


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes (0: no letter), padded to LONGEST, of each word's pieces; and the word of each piece."""
    pieces, owner = [], []
    for k, word in enumerate(words):
        word = f"{ENDS[0]}{word}{ENDS[1]}"
        for at in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2):
            pieces.append(word[at : at + LONGEST])
            owner.append(k)
    raw = np.frombuffer("".join(p.ljust(LONGEST) for p in pieces).encode("utf-32-le", "replace"), np.uint32).reshape(len(pieces), LONGEST)
    return _CODE[np.where(raw < 256, raw, 0)], np.array(owner, np.int64)


def _triples(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of each letter triple within STRETCH, 0 where it isn't one, and the triples' weights."""
    c = codes[:, :width].astype(np.int32)
    found, weights = [], []
    for i in range(width - 2):
        for k in range(i + 2, min(width, i + STRETCH)):
            for j in range(i + 1, k):
                a, b, d = c[:, i], c[:, j], c[:, k]
                found.append(np.where((a > 0) & (b > 0) & (d > 0), (a * LETTERS + b) * LETTERS + d, 0))
                weights.append(DECAY ** (k - i + 1))
    return np.stack(found, 1), np.array(weights, np.float32)


def _by_width(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of like width, a bounded number at once."""
    used = codes != 0
    widths = np.maximum(LONGEST - used[:, ::-1].argmax(1), 3)
    widths[~used.any(1)] = 3
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), 20_000):
            yield rows[at : at + 20_000], int(width)


def _self_kernel(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """K(w, w): squares of the summed weights of each distinct triple."""
    order = np.argsort(found, axis=1, kind="stable")
    codes = np.take_along_axis(found, order, 1)
    w = np.where(codes > 0, weights[order], 0.0)
    total = np.cumsum(w, axis=1)
    last = np.concatenate([codes[:, 1:] != codes[:, :-1], np.ones((len(codes), 1), bool)], axis=1)
    marks = np.where(last, total, 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(codes), 1)), marks[:, :-1]], axis=1), axis=1)
    return (np.where(last, total - before, 0.0) ** 2).sum(1)


class _Sparse:
    """Rows of normalised kernel features, of which products and combinations are asked for."""

    def __init__(self, words: list[str]) -> None:
        codes, owner = _codes(words)
        self.n, self.parts = len(words), []
        for rows, width in _by_width(codes):
            found, weights = _triples(codes[rows], width)
            norms = np.sqrt(np.maximum(_self_kernel(found, weights), 1e-12))
            self.parts.append((owner[rows], found, weights / norms[:, None]))

    def triples(self) -> np.ndarray:
        """The codes of all letter triples of the rows, in order."""
        return np.unique(np.concatenate([np.unique(found) for _, found, _ in self.parts])) if self.parts else np.zeros(1, np.int64)

    def dense(self, known: np.ndarray) -> np.ndarray:
        """The rows over the triples ``known``, which hold all of theirs; code 0 is none."""
        out = np.zeros((self.n, len(known)), np.float32)
        for owner, found, values in self.parts:
            np.add.at(out, (owner[:, None], np.searchsorted(known, found)), np.where(found > 0, values, 0))
        return out

    def times(self, known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Products with the rows of ``vectors``, which are over the triples ``known`` (words x rows)."""
        out, width = np.zeros((self.n, len(vectors))), len(known)
        for owner, found, values in self.parts:
            for k in range(0, len(found), 512):
                codes = found[k : k + 512]
                at = np.minimum(np.searchsorted(known, codes), width - 1)
                held = np.where((known[at] == codes) & (codes > 0), values[k : k + 512], 0)
                place = at + width * np.arange(len(codes))[:, None]
                rows = np.bincount(place.ravel(), held.ravel(), width * len(codes)).reshape(len(codes), width)
                np.add.at(out, owner[k : k + 512], rows.astype(np.float32) @ vectors.T)
        return out


class Machine:
    """Weights per letter triple, bias, and the decision at which the score is 1/2."""

    def __init__(self, weights: np.ndarray, bias: float, cut: float = 0.0) -> None:
        self.weights, self.bias, self.cut, self.known = weights.astype(np.float32), bias, cut, {}

    def __reduce__(self):
        return Machine, (self.weights, self.bias, self.cut)

    def decisions(self, words: list[str]) -> np.ndarray:
        codes, owner = _codes(words)
        best = np.full(len(words), -np.inf)
        for rows, width in _by_width(codes):
            found, weights = _triples(codes[rows], width)
            norms = np.sqrt(np.maximum(_self_kernel(found, weights), 1e-12))
            np.maximum.at(best, owner[rows], (self.weights[found] @ weights) / norms + self.bias)
        return best

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The highest sentence decision of each text, -inf where it has no word."""
        cut = [sentences_of(t) if t else [] for t in texts]
        flat = [s for sentences in cut for s in sentences]
        high = np.full(len(texts), -np.inf)
        if flat:
            np.maximum.at(high, np.repeat(np.arange(len(texts)), list(map(len, cut))), self.of_sentences(flat))
        return high

    def of_sentences(self, sentences: list[set[str]]) -> np.ndarray:
        """The decision of each sentence; every one has a word."""
        known = self.known
        here = set().union(*sentences)
        new = sorted(here - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = sorted(here)
        for k in range(0, len(new), 20_000):
            known.update(zip(new[k : k + 20_000], self.decisions(new[k : k + 20_000]).tolist(), strict=True))
        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
        starts = np.cumsum(sizes) - sizes
        each = np.fromiter((known[w] for s in sentences for w in s), float, int(sizes.sum()))
        top = np.maximum.reduceat(each, starts)
        return top + SOFTNESS * np.log(np.add.reduceat(np.exp((each - np.repeat(top, sizes)) / SOFTNESS), starts))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        high = self.highest(texts)
        return np.where(np.isneginf(high), 0.0, 1 / (1 + np.exp(np.clip(STEEPNESS * (self.cut - high), -60, 60))))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Primal Newton steps on |w|^2 / 2 + COST * mean of weighted squared hinges; the last column is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        a = x[active] * (weight[active] * COST)[:, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _apart(words: list[str], taken: list[str], most: int) -> list[str]:
    """The first of ``words`` whose kernel with ``taken`` and with each other is not near 1, at most ``most``."""
    words = words[: 2 * most]
    if not words:
        return []
    every = _Sparse([*taken, *words])
    known = every.triples()
    near = every.times(known, every.dense(known)) >= TOO_NEAR
    chosen, held = [], list(range(len(taken)))
    for k, word in enumerate(words, len(taken)):
        if len(chosen) < most and not near[k, held].any():
            chosen.append(word)
            held.append(k)
    return chosen


def train(rows: list[tuple[int, int, set[str]]]) -> Machine | None:
    """The machine of sentences (document, label, words); None where a label is missing."""
    label: dict[int, bool] = {}
    bags: dict[int, list[frozenset[str]]] = {}
    for doc, toxic, words in rows:
        label[doc] = bool(toxic)
        bags.setdefault(doc, []).append(frozenset(words))
    # a sentence counts once a label; a document of sentences that others have is a copy of them
    seen: dict[bool, set[frozenset[str]]] = {True: set(), False: set()}
    for doc in sorted(bags):
        new = [s for s in dict.fromkeys(bags[doc]) if s not in seen[label[doc]]]
        if 2 * len(new) < len(set(bags[doc])):
            del bags[doc]
        else:
            seen[label[doc]].update(new)
            bags[doc] = new
    toxic, clean = sorted(d for d in bags if label[d]), sorted(d for d in bags if not label[d])
    if not toxic or not clean:
        return None
    good, bad = [s for d in toxic for s in bags[d]], [s for d in clean for s in bags[d]]
    sizes, clean_sizes = ([len(bags[d]) for d in docs] for docs in (toxic, clean))
    starts, clean_starts = np.cumsum([0, *sizes[:-1]]), np.cumsum([0, *clean_sizes[:-1]])
    held = {d: frozenset().union(*bags[d]) for d in bags}
    yes, no = (Counter(w for d in docs for w in held[d]) for docs in (toxic, clean))
    # log odds of a word in toxic documents, less their standard error
    odds = {w: np.log((c + 0.5) * (len(clean) + 1) / ((no[w] + 0.5) * (len(toxic) + 1))) - np.sqrt(1 / (c + 0.5) + 1 / (no[w] + 0.5)) for w, c in yes.items() if len(w) >= 3}
    telling = {w: x for w, x in odds.items() if x > SURE} or {w: x for w, x in odds.items() if not no[w]}
    # an example is a toxic sentence that has a telling word, told by the most telling one
    told = Counter(max(own, key=lambda w: (telling[w], w)) for s in good if (own := telling.keys() & s))
    if not told:
        return None
    common = [w for w, _ in sorted(no.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 3]
    marks = _apart(sorted(told, key=lambda w: (-telling[w] * np.log1p(yes[w]), w)), [], LANDMARKS // 2)
    marks += _apart(common, marks, LANDMARKS - len(marks))
    others = sorted(no.keys() - told.keys(), key=lambda w: (hash_of(w), w))
    bad_words, hard = dict.fromkeys(others[:NEGATIVE_WORDS]), set()
    for left in range(ROUNDS, 0, -1):
        machine = _fitted(marks, told, list(bad_words), hard)
        high, high_clean = (np.maximum.reduceat(machine.of_sentences(x), at) for x, at in ((good, starts), (bad, clean_starts)))
        if left > 1:
            # the clean documents' words that come closest become examples and, the closest of them, landmarks
            known = machine.known
            decided = np.array([known[w] for w in others])
            hard = {others[k] for k in np.argsort(-decided, kind="stable")[:HARD_WORDS] if decided[k] > -0.5}
            bad_words |= dict.fromkeys(sorted(hard))
            marks = marks + _apart(sorted(hard, key=lambda w: (-known[w], w)), marks, MORE_LANDMARKS)
            # and so do, as landmarks, telling words that none resembles enough to be told by
            marks = marks + _apart(sorted((w for w in told if known[w] < 0), key=lambda w: (-told[w], w)), marks, MORE_LANDMARKS)
    y, high = np.r_[np.ones(len(toxic), bool), np.zeros(len(clean), bool)], np.r_[high, high_clean]
    # the cut with the best F1 on the training documents, in the middle of the gap below it
    order = np.argsort(-high, kind="stable")
    ranked = high[order]
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + int(y.sum()))
    f1[:-1][ranked[:-1] == ranked[1:]] = -1
    at = int(f1.argmax())
    below = ranked[at + 1] if at + 1 < len(ranked) else ranked[at] - 1
    machine.cut = float((ranked[at] + below) / 2)
    machine.known = {}
    return machine


def _fitted(landmarks: list[str], good: Counter[str], bad: list[str], hard: set[str] = frozenset()) -> Machine:
    """The machine of positive words (by how often they tell) and negative words, over the landmarks' kernel."""
    own = _Sparse(landmarks)
    known = own.triples()
    marks = own.dense(known)
    k_mm, k_nm = (marks @ marks.T).astype(float), _Sparse([*good, *bad]).times(known, marks)
    values, vectors = np.linalg.eigh(k_mm + 1e-6 * np.eye(len(marks)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
    label = np.r_[np.ones(len(good)), -np.ones(len(bad))]
    weight = np.r_[np.sqrt(np.array(list(good.values()), float)), [HARD_WEIGHT if w in hard else 1.0 for w in bad]]
    weight = np.where(label > 0, weight / weight[label > 0].sum() * weight[label < 0].sum(), weight)
    w = _squared_hinge(k_nm @ whiten, label, weight / weight.sum() * 100)
    weights = np.zeros(LETTERS**3)
    weights[known] = (whiten @ w[:-1]) @ marks
    return Machine(weights, float(w[-1]))


def hash_of(word: str) -> int:
    return xxh3_64_intdigest(word.encode("utf-8", "replace"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, toxic in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = [" ".join(sorted(w[:LONGEST_TRAINED] for w in words)) for words in sentences_of(text)]
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array([toxic] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["doc_id", "toxic", "place", "sentence"])


def learn(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Trains on a bounded sample of sentences of labelled documents outside fold 0.

    A document with both labels counts as toxic; of different texts under one doc_id all sentences are one document's.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(hashed_fold() != 0)
    own = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    every = own.groupBy("toxic").agg(F.ceil(F.count("*") / TRAIN_DOCS).alias("every"))
    chosen = own.join(F.broadcast(every), "toxic").where(F.pmod(F.xxhash64("doc_id"), F.col("every")) == 0).select("doc_id", "toxic")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_cut, "doc_id long, toxic int, place int, sentence string")
    rows = materialise(rows, "toxicity-sentences")
    share = rows.groupBy("toxic").agg(F.ceil(F.count("*") / TRAIN_SENTENCES).alias("every"))
    some = rows.join(F.broadcast(share), "toxic").where(F.pmod(F.xxhash64("doc_id", "place", F.lit(1)), F.col("every")) == 0)
    taken = sorted(some.select("doc_id", "toxic", "place", "sentence").distinct().collect(), key=lambda r: (r[0], r[2], r[3]))
    forget(rows)
    return train([(doc, toxic, set(sentence.split(" "))) for doc, toxic, _, sentence in taken])


def _scorer(machine: Machine | None, docs_at_once: int = 256):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, docs_at_once):
                batch = whole.slice(at, docs_at_once)
                got = machine.scores(batch.column(2).to_pylist()) if machine else np.zeros(batch.num_rows)
                predicted = pa.array((got >= 0.5).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), predicted], ["doc_id", "held_out", "score", "predicted"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    machine = learn(docs.select("doc_id", "text"), labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (hashed_fold() == 0).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(machine), "doc_id long, held_out boolean, score double, predicted int")
