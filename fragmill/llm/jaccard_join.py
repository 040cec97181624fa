"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

Operator 10. Two documents link when the Jaccard similarity of their word-shingle sets reaches a threshold.

* Equal sets are one class, told by a fingerprint that each row computes alone, so copies never meet pairwise.
* An n-gram that many classes have never meets in one task unreduced: a batch of documents sends one row for an n-gram
  that several of its classes have, counts are partial before they are shuffled, and where each class needs a count
  back, both sides of the join are written tables, which adaptive execution can split at a frequent key.
* The n-gram order is cut into fragments. The first fragment (the lowest 3/8 of the hash range) is shuffled for
  all classes: a class that shares too few of its n-grams there can link with nothing and is done. At similarity
  3/4 a text may miss a quarter of its n-grams in its partner, so every fragment of over a quarter prunes exactly.
* For the rest, n-grams are ordered by rising document frequency. With ``u`` n-grams that nobody else has, two
  documents share at most min(n_x - u_x, n_y - u_y), which bounds a pair's similarity before it is made. Only n-grams of the prefix (a quarter plus one, rarest first) make candidates.
* Each document is first measured against one anchor (the one with fewest own n-grams in its buckets). Documents that
  are still in different components then meet pairwise, where a bound allows it: of one anchor, they share at most the
  lesser of their overlaps with it, and outside it at most their n-grams that somebody else has. So a copy too far from
  its group's anchor meets almost none of the group, and none of a group's pairs within a component are made.
* A candidate's overlap is counted fragment by fragment and summed per pair.

Null text, or text without words: no set, linked with nothing, its own component. Repeated rows and equal texts
share a class. A null doc_id counts for links; its component_id is the least non-null id, or null. Different texts of
one doc_id, or of none, are different documents. Only doc_id and text are read: other columns don't matter. N-grams and
sets are told apart by hashes of 64 bits: sets of two texts are taken for equal with a chance of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fragmill.llm.common import all_of, components, forget, fresh, gives_back, materialise, named, split_by_ids
from fragmill.llm.shingles import fingerprint, shingle_set

WORDS = 5
#: Similarity as a fraction: intersection / union >= NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: The first fragment of the order: hashes below this.
FIRST = np.uint64((1 << 64) * 3 // 8)
#: Fragments in which a candidate's overlap is counted; a power of two.
FRAGMENTS = 2
#: N-grams that a task folds at once.
FOLDED = 2_000_000


@gives_back
def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, first, fp = [], [], []
        for text in batch.column(1):
            hashes = shingle_set(text.as_py(), WORDS)
            n.append(len(hashes))
            first.append(int(np.searchsorted(hashes, FIRST)))
            fp.append(fingerprint(hashes) if len(hashes) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "n", "n1", "fp"])


@gives_back
def _with_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py(), WORDS) for text in batch.column(0)]
        fp = pa.array([fingerprint(own) if len(own) else None for own in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["text", "fp"])


def _rows(hashes: list[np.ndarray], fps: list[int]) -> pa.RecordBatch:
    h = np.concatenate(hashes).view(np.int64) if hashes else np.empty(0, np.int64)
    fp = np.repeat(np.array(fps, np.int64), [len(x) for x in hashes])
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(fp)], ["h", "fp"])


def _folded(hashes: list[np.ndarray], fps: list[int]) -> pa.RecordBatch:
    """Rows (h, fp) of an n-gram that one class has here, or (h, lo, hi), its least and greatest class, of one that several have.

    What a class shares here is told by a row of its own (fp, known): the number of its n-grams. The rest is null.
    """
    own = np.array(fps, np.int64)
    h, owner = np.concatenate(hashes), np.repeat(np.arange(len(fps), dtype=np.int32), [len(x) for x in hashes])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    del order
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[starts, len(h)])
    fp, alone = own[owner], sizes == 1
    lo, hi = np.minimum.reduceat(fp, starts), np.maximum.reduceat(fp, starts)
    known = np.bincount(owner[np.repeat(~alone, sizes)], minlength=len(fps))
    h = h[starts].view(np.int64)
    del fp, owner, starts, sizes
    told = np.flatnonzero(known)
    none = np.ones(len(told), bool)
    columns = [
        pa.array(np.r_[h, own[told]]),
        pa.array(np.r_[lo, own[told]], mask=np.r_[~alone, ~none]),
        pa.array(np.r_[lo, own[told]], mask=np.r_[alone, none]),
        pa.array(np.r_[hi, own[told]], mask=np.r_[alone, none]),
        pa.array(np.r_[lo, known[told]], mask=np.r_[np.ones(len(alone), bool), ~none]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["h", "fp", "lo", "hi", "known"])


@gives_back
def _first_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, hashes, fps, held = set(), [], [], 0
        for text in batch.column(0):
            own = shingle_set(text.as_py(), WORDS)
            if len(own) and (fp := fingerprint(own)) not in seen:
                seen.add(fp)
                part = own[: np.searchsorted(own, FIRST)].copy()
                if len(part):
                    hashes.append(part)
                    fps.append(fp)
                    held += len(part)
            if held >= FOLDED:
                yield _folded(hashes, fps)
                hashes, fps, held = [], [], 0
        if hashes:
            yield _folded(hashes, fps)


@gives_back
def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, wanted = batch.column(0), batch.column(1).to_pylist()
        for k in range(0, len(wanted), 1000):
            hashes, fps = [], []
            for text, fp in zip(texts[k : k + 1000], wanted[k : k + 1000], strict=True):
                own = shingle_set(text.as_py(), WORDS)
                if len(own) and fingerprint(own) == fp:
                    hashes.append(own)
                    fps.append(fp)
            yield _rows(hashes, fps)


def _missable(n: Column) -> Column:
    """How many of n n-grams a linked partner may lack: n - ceil(3n/4)."""
    return n - F.ceil(n * NUMERATOR / DENOMINATOR)


def _may_link(n_x: Column, n_y: Column, most: Column) -> Column:
    """Whether sets of these sizes can link if they share at most ``most``."""
    return (DENOMINATOR * most >= NUMERATOR * (n_x + n_y - most)) & (DENOMINATOR * F.least(n_x, n_y) >= NUMERATOR * F.greatest(n_x, n_y))


def _measured(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``pairs`` (x, y, n_x, n_y) with ``common``: partial overlaps by fragment, summed per pair."""
    of_y = segments.select(F.col("fp").alias("y"), "fragment", F.col("segment").alias("segment_y"))
    of_x = segments.select(F.col("fp").alias("x"), "fragment", F.col("segment").alias("segment_x"))
    partial = pairs.join(of_y, "y").join(of_x, ["x", "fragment"]).select("x", "y", "n_x", "n_y", F.size(F.array_intersect("segment_x", "segment_y")).alias("common"))
    return partial.groupBy("x", "y").agg(F.first("n_x").alias("n_x"), F.first("n_y").alias("n_y"), F.sum("common").alias("common"))


LINKED = f"{DENOMINATOR} * common >= {NUMERATOR} * (n_x + n_y - common)"


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every row of ``docs`` (doc_id, text): see the module."""
    return _linked(docs).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("best.doc_id", "doc_id").alias("component_id")
    )


def _linked(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and n of every row, with ``first`` and ``best``: the first row (none, doc_id, text_hash) of its class and of its component.

    Rows are ordered by doc_id, those of null doc_id last, then by text_hash; both are null where there are no words.
    """
    parsed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    profile = materialise(parsed.mapInArrow(_profiles, "doc_id long, text_hash long, n long, n1 long, fp long"), "jaccard-profile")
    worded = profile.where("n > 0")
    classes = worded.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("n1").alias("n1"))

    # a class that is met in several tasks may be counted for each, which prunes less, not more
    by_h = Window.partitionBy("h")
    first = parsed.select("text").mapInArrow(_first_fragment, "h long, fp long, lo long, hi long, known long")
    ends = {"lo": F.min(F.coalesce("lo", "fp")).over(by_h), "hi": F.max(F.coalesce("hi", "fp")).over(by_h)}
    met = first.withColumns(ends).where("fp is not null and (known is not null or lo != hi)")
    shared = met.groupBy("fp").agg(F.sum(F.coalesce("known", F.lit(1))).alias("s1"))
    possible = materialise(
        classes.join(shared, "fp", "left")
        .where(F.coalesce("s1", F.lit(0)) >= F.col("n1") - _missable(F.col("n")))
        .select("fp", "rep", "n"),
        "jaccard-possible",
    )

    near, _ = split_by_ids(parsed, possible.select(F.col("rep").alias("doc_id")))
    texts = near.join(possible.select(F.col("rep").alias("doc_id"), "fp"), "doc_id").select("text", "fp")
    # classes that have only rows of null doc_id
    nameless = parsed.where("doc_id is null").select("text").mapInArrow(_with_fingerprints, "text string, fp long").where("fp is not null")
    nameless = nameless.groupBy("fp").agg(F.first("text").alias("text")).join(possible.where("rep is null").select("fp"), "fp")
    texts = texts.union(nameless.select("text", "fp"))
    grams = materialise(texts.mapInArrow(_whole_sets, "h long, fp long"), "jaccard-grams")
    frequency = materialise(grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-frequency")
    gathered = grams.join(frequency, "h").groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("grams"))
    # a class that several tasks met has its n-grams as often
    ordered = gathered.select("fp", F.expr("filter(grams, (g, i) -> i = 0 or g.h != grams[i - 1].h)").alias("grams"))
    nodes = materialise(
        ordered.join(possible.select("fp", "n"), "fp")
        .withColumn("u", F.col("n") - F.size("grams"))
        .where(F.col("u") <= _missable(F.col("n")))
        .select("fp", "n", "u", "grams"),
        "jaccard-nodes",
    )

    forget(grams, frequency, possible)

    n, u = F.col("n"), F.col("u")
    keys = nodes.select("fp", "n", "u", F.slice(F.col("grams.h"), F.lit(1), (_missable(n) + 1 - u).cast("int")).alias("keys"))
    prefix = materialise(keys.select("fp", "n", "u", F.posexplode("keys").alias("place", "h")), "jaccard-prefix")
    fragment = F.shiftrightunsigned(F.col("gram.h"), 64 - (FRAGMENTS.bit_length() - 1)).cast("int")
    segments = nodes.select("fp", F.explode("grams").alias("gram")).groupBy("fp", fragment.alias("fragment")).agg(F.collect_list("gram.h").alias("segment"))
    segments = materialise(segments, "jaccard-segments")

    anchors = prefix.groupBy("h").agg(F.min(F.struct("u", "fp", "n")).alias("a"), F.count("*").alias("c")).where("c > 1").select("h", "a")
    to_anchor = (
        prefix.join(anchors, "h")
        .where("a.fp != fp")
        .where(_may_link(n, F.col("a.n"), F.least(n - u, F.col("a.n") - F.col("a.u"))))
        .groupBy("fp")
        .agg(F.min("a").alias("a"), F.first("n").alias("n_y"))
        .select(F.col("a.fp").alias("x"), F.col("fp").alias("y"), F.col("a.n").alias("n_x"), "n_y")
    )
    anchored = materialise(_measured(to_anchor, segments), "jaccard-anchored")
    links = anchored.where(LINKED).select("x", "y")
    roots = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), "jaccard-1")
    held = anchored.select(F.col("y").alias("fp"), F.col("x").alias("anchor"), F.col("common").alias("in_anchor"))

    # what two documents share is within their anchor (at most the lesser of their overlaps with it) or outside it
    placed = prefix.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    apart = placed.groupBy("h").agg(F.min("u").alias("least_u"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h", "least_u")
    open_ = placed.join(apart, "h").where(DENOMINATOR * (n - u) >= NUMERATOR * (n + F.col("least_u"))).join(held, "fp", "left")
    open_ = open_.join(keys.select("fp", "keys"), "fp").withColumn("earlier", F.slice("keys", F.lit(1), F.col("place")))
    open_ = materialise(open_.select("h", "fp", "n", "u", "root", "earlier", F.coalesce("anchor", "fp").alias("anchor"), F.coalesce("in_anchor", n).alias("in_anchor")), "jaccard-open")
    x, y = open_.alias("x"), open_.alias("y")
    outside = F.least(*(F.greatest(F.expr(f"{s}.n - {s}.u - {s}.in_anchor"), F.lit(0)) for s in "xy"))
    within = F.least("x.in_anchor", "y.in_anchor") + outside
    most = F.least(F.expr("x.n - x.u"), F.expr("y.n - y.u"), F.when(F.col("x.anchor") == F.col("y.anchor"), within).otherwise(F.col("x.n")))
    rest = (
        x.join(
            y,
            (F.col("x.h") == F.col("y.h"))
            & (F.col("x.root") != F.col("y.root"))
            & (F.struct("x.u", "x.fp") < F.struct("y.u", "y.fp"))
            & (F.col("y.anchor") != F.col("x.fp"))
            & (F.col("x.anchor") != F.col("y.fp"))
            & _may_link(F.col("x.n"), F.col("y.n"), most)
            # a pair is made once: in the first bucket that both are in
            & ~F.arrays_overlap("x.earlier", "y.earlier"),
        )
        .select(F.col("x.fp").alias("x"), F.col("y.fp").alias("y"), F.col("x.n").alias("n_x"), F.col("y.n").alias("n_y"))
        .distinct()
    )
    more = materialise(_measured(rest, segments).where(LINKED).select("x", "y"), "jaccard-links")
    forget(open_, prefix, segments, nodes, roots)
    every = reduce(DataFrame.union, [links, more]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(every, "jaccard-2")
    forget(anchored, more)

    firsts = worded.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    members = roots.select(F.col("node").alias("fp"), "root").join(firsts, "fp")
    least = members.join(members.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "least")
    # written, so that the join can be split at a class of many copies
    final = materialise(firsts.join(least, "fp", "left").select("fp", "first", F.coalesce("least", "first").alias("best")), "jaccard-final")
    forget(roots)
    return profile.join(final, "fp", "left").select("doc_id", "text_hash", "n", "first", "best")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id. Rows without words all stay.

    Rows equal in doc_id and text count as one document; different texts of one doc_id, or of null, do not. A row of null
    doc_id stays only where its component has no other. All columns pass through.
    """
    found = materialise(_linked(docs).where("n > 0").select("doc_id", "text_hash", "best"), "jaccard-result")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    gone = found.where(~stays).select("doc_id", "text_hash").distinct()
    twice = found.where(stays).groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    maybe, sure = split_by_ids(docs, gone.select("doc_id").union(twice))
    own, gone_id, gone_hash = fresh("hash", "id", "gone")
    maybe = maybe.withColumn(own, F.xxhash64(named("text")))
    kept = maybe.join(gone.toDF(gone_id, gone_hash), named("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_hash)), "left_anti")
    worded = F.coalesce(named("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = kept.where(worded).dropDuplicates(["doc_id", own]).union(kept.where(~worded))
    return sure.unionByName(once.select(*all_of(docs)))
