"""Language identification by multilingual mixture inference.

Operator 8. A document is a mixture of languages: its letter trigrams (hashed, words bounded by blanks) are drawn from
per-language distributions learned from labelled documents. Expectation-maximisation estimates the proportions; the
set of languages grows by the next largest proportion as long as its likelihood, less a penalty for every language
beyond the first, grows with it; sets may be of any size. The prediction is the set's largest proportion, which is also
the score; ties go to the first language by name.

At most about TRAIN_DOCS whole documents a language are learned from, chosen by a hash of their id outside fold 0;
their n-grams are counted in the executors, and the driver gets one number a bucket and language. Null text and texts without a letter: ``und``, score 0; so is everything where nothing could be learned. Repeated rows
get equal results; a null doc_id counts as held out. Only doc_id, text and, to learn, lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import hashed_fold

TRAIN_DOCS, BUCKETS, SMOOTHING = 400, 8192, 0.5
ROUNDS, LAST_ROUNDS, PENALTY = 12, 4, 4.0
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)])


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts of the text's hashed letter trigrams, or None where it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    basic = np.minimum(codes, 0xFFFF)
    letter = _LETTER[basic]
    if len(codes) and codes.max() > 0xFFFF:
        high = codes > 0xFFFF
        letter = np.where(high, np.array([chr(c).isalpha() if c > 0xFFFF else False for c in codes]), letter)
    if not letter.any():
        return None
    c = np.r_[np.uint32(0), np.where(letter, codes, np.uint32(0)), np.uint32(0)]
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
    with np.errstate(over="ignore"):
        h = c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
        h ^= h >> np.uint32(15)
        h *= np.uint32(668265263)
    return np.bincount((h >> np.uint32(19))[c[1:-1] != 0], minlength=BUCKETS)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = trigram_counts(text or "")
            if counts is not None:
                total[lang] = total.get(lang, 0) + counts
    for lang, counts in total.items():
        buckets = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets), pa.string()), pa.array(buckets, pa.int64()), pa.array(counts[buckets], pa.int64())], ["lang", "bucket", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a row of bucket probabilities for each."""
    own = docs.where("lang is not null and text is not null").where(hashed_fold() != 0)
    every = own.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.ceil(F.col("n") / TRAIN_DOCS).alias("every"))
    rows = own.join(F.broadcast(every), "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("every")) == 0).select("lang", "text")
    counted = rows.mapInArrow(_learned, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counted})
    total = np.zeros((len(langs), BUCKETS))
    place = {lang: k for k, lang in enumerate(langs)}
    for lang, bucket, n in counted:
        total[place[lang], bucket] = n
    return langs, ((total + SMOOTHING) / (total.sum(1, keepdims=True) + SMOOTHING * BUCKETS)).astype(np.float32)


def proportions(counts: np.ndarray, table: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """EM from ``start`` (documents x languages); a language that starts at 0 stays out."""
    n = np.maximum(counts.sum(1, keepdims=True), 1)
    for _ in range(rounds):
        start = start * ((counts / np.maximum(start @ table, 1e-30)) @ table.T) / n
    return start


def infer(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Proportions (documents x languages) within the language set of the greatest penalised likelihood."""
    docs, k = len(counts), len(table)
    full = proportions(counts, table, np.full((docs, k), 1 / k, np.float32), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    penalty = PENALTY * np.log(counts.sum(1) + 1)
    chosen, best, open_ = np.zeros((docs, k), np.float32), np.full(docs, -np.inf), np.arange(docs)
    for size in range(1, k + 1):
        own, first = counts[open_], order[open_, :size]
        kept = np.zeros((len(open_), k), np.float32)
        np.put_along_axis(kept, first, np.maximum(np.take_along_axis(full[open_], first, 1), 1e-6), 1)
        kept = proportions(own, table, kept / kept.sum(1, keepdims=True), LAST_ROUNDS if size > 1 else 0)
        likelihood = (own * np.log(np.maximum(kept @ table, 1e-30))).sum(1) - penalty[open_] * (size - 1)
        better = likelihood > best[open_]
        open_ = open_[better]
        best[open_], chosen[open_] = likelihood[better], kept[better]
        if not len(open_):
            break
    return chosen


def _predictor(langs: list[str], table: np.ndarray, docs_at_once: int = 256):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, docs_at_once):
                batch = whole.slice(at, docs_at_once)
                names, scores, rows = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows, {}
                for k, text in enumerate(batch.column(2).to_pylist()):
                    if langs and text and (counts := trigram_counts(text)) is not None:
                        rows[k] = counts
                if rows:
                    shares = infer(np.array(list(rows.values()), np.float32), table)
                    for k, share in zip(rows, shares, strict=True):
                        names[k], scores[k] = langs[int(share.argmax())], min(1.0, float(share.max()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang)."""
    langs, table = learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (hashed_fold() == 0).alias("held_out"), "text")
    return rows.mapInArrow(_predictor(langs, table), "doc_id long, held_out boolean, lang_pred string, score double")
