"""Substring deduplication by sliding sentence spans.

Operator 6. Every document is cut into sentences; every run of several consecutive sentences that reaches MIN_WORDS
and cannot be shortened (from its start or from its end) is hashed, and the hashes are joined over the whole input.
The first occurrence of a run, by (doc_id, sentence), stays; sentences that any other occurrence covers are removed.

A sentence ends after . ! or ? with white space, at a line end, and before a capital letter, so that a passage
pasted into the middle of a sentence is cut where it begins. A sentence of LONG_WORDS is a run of its own. Runs are
compared in lower case with white space collapsed, by hashes of 128 bits. Each batch sends one row for a hash, so a passage that a third of
all documents share reaches its task as a row for each batch, not for each document.

Null text stays null; rows with a null doc_id pass unchanged and take no part; repeated rows (one doc_id, one text)
are one document and get equal results. A document of which all sentences repeat keeps an empty text. All columns
pass through; n_chars, if there, follows the text; columns named n_sentences_removed and n_words_removed are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window
from xxhash import xxh3_128_intdigest

from fragmill.llm.common import all_of, fresh, gives_back, materialise, named, split_by_ids
from fragmill.llm.shingles import mix

MIN_WORDS, LONG_WORDS = 20, 40
_BREAK = re.compile(r"""(?:\n|[.!?]["')\]]*\s|\s(?=[A-ZÀ-ÖØ-Þ]))\s*""")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1024)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(_BASE))])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(_INVERSE))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def sentences(text: str) -> list[str]:
    """``text`` cut at its sentence breaks; the pieces, joined, are the text."""
    cuts = [0, *(m.end() for m in _BREAK.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def runs(text: str) -> tuple[np.ndarray, ...]:
    """(hash, second hash, first sentence, last sentence) of the text's minimal runs."""
    words = [x.lower().split() for x in sentences(text)]
    lengths = np.array([len(x) for x in words], np.int64)
    total = np.r_[np.int64(0), np.cumsum(lengths)]
    n = len(words)
    if not n or total[-1] < MIN_WORDS:
        return (*(np.empty(0, np.uint64),) * 2, *(np.empty(0, np.int64),) * 2)
    places = np.arange(n)
    # the shortest run from each start, then to each end, of two sentences or more; then long sentences
    last = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS) - 1, places + 1)
    first = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1, places - 1)
    alone = places[lengths >= LONG_WORDS]
    forth, back = last < n, first >= 0
    pairs = np.unique(np.r_[places[forth] * n + last[forth], first[back] * n + places[back], alone * n + alone])
    i, j = pairs // n, pairs % n
    both = np.frombuffer(b"".join(xxh3_128_intdigest(" ".join(x)).to_bytes(16, "little") for x in words), np.uint64).reshape(-1, 2)
    up, down = _powers.upto(n)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(mix(both) * up[:, None], axis=0)])
        found = mix((prefix[j + 1] - prefix[i]) * down[i, None])
    return found[:, 0], found[:, 1], i, j


@gives_back
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        found, owner = [], []
        for doc_id, text in zip(ids, texts, strict=True):
            if doc_id is not None and text.is_valid:
                found.append(runs(text.as_py()))
                owner.append(np.full(len(found[-1][0]), doc_id, np.int64))
        if not found:
            continue
        h, c, i, j = (np.concatenate([x[k] for x in found]) for k in range(4))
        doc = np.concatenate(owner)
        order = np.lexsort((i, doc, c, h))
        h, c, i, j, doc = h[order].view(np.int64), c[order].view(np.int64), i[order], j[order], doc[order]
        head = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.empty(0, bool)
        lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
        again = (doc != doc[lead]) | (i != i[lead])
        columns = [pa.array(x) for x in (h, c, doc, i.astype(np.int32), j.astype(np.int32), again)]
        yield pa.RecordBatch.from_arrays(columns, ["h", "c", "doc_id", "i", "j", "again"])


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the first and last sentences of each document's runs that occur earlier."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_spans, "h long, c long, doc_id long, i int, j int, again boolean")
    key = F.when(F.col("again"), F.xxhash64("doc_id", "i", "h")).otherwise(F.col("h"))
    earliest = F.min(F.when(~F.col("again"), F.struct("doc_id", "i"))).over(Window.partitionBy("key", "c"))
    later = rows.withColumn("key", key).withColumn("first", earliest).where("again or struct(doc_id, i) > first")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("i", "j")).alias("spans"))


def _cutter(text_at: int, chars_at: int | None, schema: pa.Schema) -> Callable:
    @gives_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.num_columns - 1)
            touched, texts, gone, lost = found.is_valid(), [], [], []
            for text, spans in zip(batch.column(text_at), found, strict=True):
                if not spans.is_valid:
                    texts.append(None)
                    gone.append(0)
                    lost.append(0)
                    continue
                parts = sentences(text.as_py())
                covered = np.zeros(len(parts) + 1, np.int64)
                for span in spans.as_py():
                    covered[span["i"]] += 1
                    covered[span["j"] + 1] -= 1
                stays = np.cumsum(covered)[:-1] == 0
                texts.append("".join(x for x, s in zip(parts, stays, strict=True) if s))
                gone.append(int((~stays).sum()))
                lost.append(sum(len(x.split()) for x, s in zip(parts, stays, strict=True) if not s))
            columns = batch.columns[:-1]
            columns[text_at] = pc.if_else(touched, pa.array(texts, columns[text_at].type), columns[text_at])
            if chars_at is not None:
                chars = pa.array([x if x is None else len(x) for x in texts], schema.field(chars_at).type)
                columns[chars_at] = pc.if_else(touched, chars, columns[chars_at])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64()), pa.array(lost, pa.int64())], names=[*batch.schema.names[:-1], "sentences", "words"])

    return cut


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated sentences cut from text, plus n_sentences_removed and n_words_removed."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [c for c in docs.columns if c not in ("n_sentences_removed", "n_words_removed")]
    docs = docs.select(*map(named, columns))
    found = materialise(repeated(docs), "dedup-spans")
    maybe, sure = split_by_ids(docs, found.select("doc_id"))
    own, spans = fresh("id", "spans")
    joined = maybe.join(found.toDF(own, spans), named("doc_id").cast("long") == F.col(own), "left")
    joined = joined.select(*all_of(docs), F.when(F.col("text").isNotNull(), F.col(spans)).alias(spans))
    none = {"n_sentences_removed": F.lit(0).cast("long"), "n_words_removed": F.lit(0).cast("long")}
    chars_at = columns.index("n_chars") if "n_chars" in columns else None
    whole = sure.withColumns(none)
    # by place, as Python workers are given columns by names in which a dot or a backtick means something
    plain = [f"c{k}" for k in range(len(columns))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip([*plain, "sentences", "words"], whole.schema, strict=True)])
    cut = _cutter(columns.index("text"), chars_at, to_arrow_schema(docs.schema))
    return whole.union(joined.toDF(*plain, spans).mapInArrow(cut, schema).toDF(*whole.columns))
