"""Byte-level BPE encoding and decoding over a trie of distinct words.

Operator 1. Texts are cut into words by the byte-level pattern; each batch's new distinct words form a trie, which is
walked depth-first. A node's state is the last token of its prefix's encoding: the one token that ends there and may
follow the encoding of what comes before it. Words with a common prefix share the states of that prefix; a word's
tokens are read off by stepping back from its end.

The trie is laid out flat: in sorted order, each word's node path begins with the path that it shares with the word
before, so the walk keeps the states of one path only and takes three numbers a byte of the longest word, however many
words there are and whatever their bytes. Along the path an automaton over the vocabulary tells the tokens that end at
each byte.

Two tokens may stand side by side if no merge crosses their border before both are complete, which is told from the
merge order alone; an encoding is right if all its neighbours may. Special tokens' strings in a text become their
ids, as the tokenizers library does by default. Null text counts as empty: no tokens. Words of any length are
encoded; only short ones are remembered, in a table of bounded size. Texts are taken in parts of AT_ONCE characters
(a longer text alone). Repeated rows get equal results; a null doc_id passes through; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import gives_back

#: The byte-level word pattern, with white space spelled out, and the printable bytes that stand for themselves.
_WHITE = r"\t-\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Words remembered by a worker with their tokens and with the number of these, the longest of the first (characters), token pairs and automaton steps
#: remembered, characters of text at once, bytes of a very long word.
REMEMBERED, COUNTED, REMEMBERED_LENGTH, PAIRS, STEPS, AT_ONCE, LONG_WORD = 800_000, 3_000_000, 40, 400_000, 400_000, 500_000, 100_000



class Codec:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        stands = {chr(b): b for b in PRINTABLE}
        stands |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
        to_bytes = lambda token: bytes(stands[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.ids = {to_bytes(token): i for token, i in vocabulary.items()}
        self.heads = {b[:k] for b in self.ids for k in range(1, len(b) + 1)}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.merged[a, b] = (rank, whole)
            self.parts.setdefault(whole, (rank, a, b))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.words = regex.compile(WORD).findall
        self.known: dict[str, tuple[int, ...]] = {}
        # words whose number of tokens is known: their hashes, in order, and the numbers
        self.counted, self.sizes = np.empty(0, np.int64), np.empty(0, np.int32)
        self.beside: dict[int, bool] = {}
        # the automaton: its states are the strings that begin a token, found as they are met
        self.states: dict[bytes, int] = {b"": 0}
        self.spelt = [b""]
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        self.steps: dict[int, int] = {}

    def may_follow(self, pair: int) -> bool:
        """Whether BPE leaves two tokens (left << 32 | right) as they are when they stand side by side."""
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        found = self.beside[pair] = self._stays_apart(pair >> 32, pair & 0xFFFFFFFF)
        return found

    def next_state(self, step: int) -> int:
        """The state after a byte (state << 8 | byte): the longest end of what was read that begins a token."""
        if len(self.steps) >= STEPS:
            self.steps.clear()
        text = self.spelt[step >> 8] + bytes([step & 255])
        while text not in self.heads:
            text = text[1:]
        if text not in self.states:
            self.states[text] = len(self.spelt)
            self.spelt.append(text)
            self.ending.append(tuple((len(text) - k, self.ids[text[k:]]) for k in range(len(text)) if text[k:] in self.ids))
        found = self.steps[step] = self.states[text]
        return found

    def _stays_apart(self, a: int, b: int) -> bool:
        # Undo the newer of the two border tokens, step by step; a merge across the border that was due before the
        # undone one was made would have come first. Of equal merges the one to the left comes first.
        before = float("inf")
        whole = (-1, -1, -1)
        while True:
            crossing = self.merged.get((a, b))
            if crossing is not None and crossing[0] < before:
                return False
            made_a, made_b = self.parts.get(a, whole), self.parts.get(b, whole)
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            if made_a[0] > made_b[0]:
                before, a = made_a[0], made_a[2]
            else:
                before, b = made_b[0] + 0.5, made_b[1]

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, tokens) of distinct ``words`` in sorted order: their trie, walked depth-first."""
        beside, may_follow, steps, next_state, ending = self.beside, self.may_follow, self.steps, self.next_state, self.ending
        # by depth: the automaton's state, the prefix's last token and that token's size
        # lists are faster, arrays smaller where a word is very long
        row = list if max(map(len, words), default=0) < LONG_WORD else lambda first: array("i", first)
        states, last, sizes = row([0]), row([-1]), row([0])
        before = b""
        for word in words:
            depth = _shared_length(before, word)
            del states[depth + 1 :], last[depth + 1 :], sizes[depth + 1 :]
            state = states[depth]
            for byte in memoryview(word)[depth:]:
                depth += 1
                step = state << 8 | byte
                state = steps.get(step)
                if state is None:
                    state = next_state(step)
                for size, token in ending[state]:
                    if size == depth:
                        break
                    pair = last[depth - size] << 32 | token
                    fits = beside.get(pair)
                    if fits or (fits is None and may_follow(pair)):
                        break
                states.append(state)
                last.append(token)
                sizes.append(size)
            tokens, at = [], depth
            while at:
                tokens.append(last[at])
                at -= sizes[at]
            tokens.reverse()
            yield word, tokens
            before = word

    def cut(self, texts: list[str]) -> list[list[tuple[list[str] | None, int | None]]]:
        """Each text as parts: words, or a special token's id."""
        special = self.split_special and any(s in t for t in texts for s in self.special)
        parts = [[(p, None) if k % 2 == 0 else (None, self.special[p]) for k, p in enumerate(self.split_special(t))] if special else [(t, None)] for t in texts]
        return [[(self.words(p), None) if i is None else (None, i) for p, i in part] for part in parts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        cut, known = self.cut(texts), self.known
        here = set()
        for part in cut:
            for words, _ in part:
                here.update(words or ())
        if len(known) + len(here) > REMEMBERED:
            known.clear()
        extra: dict[str, array] = {}
        for word, tokens in self.encode_words(sorted(w.encode("utf-8", "replace") for w in here if w not in known)):
            text = word.decode()
            if len(text) <= REMEMBERED_LENGTH:
                known[text] = tuple(tokens)
            else:
                extra[text] = array("i", tokens)
        look = known.__getitem__ if not extra else lambda w: known[w] if w in known else extra[w]
        return [list(chain.from_iterable(chain.from_iterable(map(look, words)) if i is None else (i,) for words, i in part)) for part in cut]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text. Words are told apart by 64-bit hashes, so that a worker remembers COUNTED of them in little room."""
        total = np.zeros(len(texts), np.int64)
        flat: list[str] = []
        lengths = np.zeros(len(texts), np.int64)
        for k, part in enumerate(self.cut(texts)):
            for words, i in part:
                if i is None:
                    flat += words
                    lengths[k] += len(words)
                else:
                    total[k] += 1
        if not flat:
            return total.tolist()
        unique, first, which = np.unique(np.fromiter(map(hash, flat), np.int64, len(flat)), return_index=True, return_inverse=True)
        if len(self.counted) + len(unique) > COUNTED:
            self.counted, self.sizes = self.counted[:0], self.sizes[:0]
        place = np.searchsorted(self.counted, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.counted)
        known[inside] = self.counted[place[inside]] == unique[inside]
        size = np.empty(len(unique), np.int32)
        size[known] = self.sizes[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            words = [flat[k].encode("utf-8", "replace") for k in first[new]]
            order = sorted(range(len(words)), key=words.__getitem__)
            size[new[order]] = np.fromiter((len(tokens) for _, tokens in self.encode_words([words[k] for k in order])), np.int32, len(order))
            self.counted = np.insert(self.counted, place[new], unique[new])
            self.sizes = np.insert(self.sizes, place[new], size[new])
        owner = np.repeat(np.arange(len(texts)), lengths)
        return (total + np.bincount(owner, size[which], len(texts)).astype(np.int64)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _shared_length(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    if high and a[0] != b[0]:
        return 0
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


_codecs: dict[int, Codec] = {}


def _codec(source: str) -> Codec:
    key = hash(source)
    if key not in _codecs:
        _codecs[key] = Codec(source)
    return _codecs[key]


def _portions(batch: pa.RecordBatch, docs_at_once: int = 256) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``docs_at_once`` rows and AT_ONCE characters; a longer row is a part of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist() if pa.types.is_string(batch.schema.field(1).type) else [0] * batch.num_rows
    at = held = 0
    for k, length in enumerate(lengths):
        if k > at and (k - at >= docs_at_once or held + length > AT_ONCE):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += length
    if at < batch.num_rows:
        yield batch.slice(at)


def _batched(make: Callable[[Codec, list], list[pa.Array]], names: list[str], shared):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for part in _portions(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *make(codec, part.column(1).to_pylist())], names)

    return run


def _encoded(codec: Codec, texts: list) -> list[pa.Array]:
    return [pa.array(codec.encode([t or "" for t in texts]), pa.list_(pa.int32()))]


def _decoded(codec: Codec, ids: list) -> list[pa.Array]:
    return [pa.array([codec.decode(x or []) for x in ids], pa.string())]


def _counted(codec: Codec, texts: list) -> list[pa.Array]:
    return [pa.array(codec.counts([t or "" for t in texts]), pa.int64())]


def _digested(codec: Codec, texts: list) -> list[pa.Array]:
    counts, of_ids, of_text = [], [], []
    numbers = _numbers
    for ids in codec.encode([t or "" for t in texts]):
        counts.append(len(ids))
        of_ids.append(hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
        of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]


class _Numbers(dict):
    def __missing__(self, i: int) -> str:
        text = self[i] = str(i)
        return text


_numbers = _Numbers()


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text), by the vocabulary file at ``path``."""
    return docs.select("doc_id", "text").mapInArrow(_batched(_encoded, ["doc_id", "ids"], _shared(docs, path)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n) of every row of ``docs`` (doc_id, text): its number of tokens."""
    parsed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return parsed.mapInArrow(_batched(_counted, ["doc_id", "n"], _shared(docs, path)), "doc_id long, n long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_batched(_decoded, ["doc_id", "text"], _shared(encoded, path)), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes, then decodes what it encoded."""
    parsed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return parsed.mapInArrow(_batched(_digested, names, _shared(docs, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
