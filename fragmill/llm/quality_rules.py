"""Quality rules, native: repetition within a document, and line frequency across the documents of a host.

Operator 7. Base rules look at one document (word, symbol, line and 8-word-window counts). The method then counts,
per host (the ``source`` column), in how many distinct documents each normalised line occurs, removes lines above
the limit and rejects documents that are depleted: ``quality`` judges, ``keep_good`` returns the texts that are left.

Copies of one document are one document: a document is told apart by a hash of the set of its normalised lines, and a
line is boilerplate of its host if more than MAX_LINE_DOCS different documents hold it. So a group of copies counts
once, is left to the deduplication operators and neither makes a line frequent nor masks that others hold it.

Null or empty text: no words, base_failed. Null source: a host of its own. Repeated rows get equal results, and count
as one document. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import all_of, forget, fresh, materialise, named, split_by_ids

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line in more distinct documents of a host than this is removed.
MAX_LINE_DOCS = 20
#: A document is depleted when fewer than this percentage of its words are in lines that stay.
MIN_LEFT_PERCENT = 20
#: Frequent lines are broadcast up to this many; beyond it each is joined under this many salts, as one line may be in a third of all documents.
BROADCAST_LINES, SALTS = 300_000, 64
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``: evaluated once, even where the optimizer copies the expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _doubled(hashes: str, by: int) -> str:
    return f"zip_with({hashes}, slice({hashes}, {by + 1}, greatest(size({hashes}), 1)), (a, b) -> xxhash64(a, b))"


def _repeat_words() -> str:
    """Words of array w that lie in windows found twice or more."""
    # a window's hash is built by doubling: pairs, fours, eights; the last WINDOW - 1 places hold no whole window
    steps = f"zip_with(p, slice(p, 2, size(p)), (a, b) -> coalesce(least({WINDOW}, b - a), {WINDOW}))"
    covered = _let("sort_array(array_distinct(flatten(filter(zip_with(s, slice(s, 2, size(s)), (a, b) -> if(a.h = b.h, array(a.i, b.i), null)), x -> x is not null))))", "p", f"aggregate({steps}, 0L, (t, x) -> t + x)")
    in_order = _let("sort_array(transform(h, (x, i) -> struct(x as h, i as i)))", "s", covered)
    counted = f"if(size(array_distinct(h)) = size(h), 0L, {in_order})"
    whole = _let(f"slice(h4, 1, greatest(size(h4) - {WINDOW - 1}, 0))", "h", counted)
    fours = _let(_doubled("h2", 4), "h4", whole)
    return _let("transform(w, x -> xxhash64(x))", "h0", _let(_doubled("h0", 1), "h1", _let(_doubled("h1", 2), "h2", fours)))


def base(text: str = "text") -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of column ``text``."""
    lines = _let(f"filter(split(t, '\\n'), x -> x rlike '{NOT_SPACE}')", "l", "cast(size(l) - size(array_distinct(l)) as bigint)")
    symbols = f"cast(length(t) - length(regexp_replace(t, '{SYMBOLS}', '')) as bigint)"
    counts = f"struct(cast(size(w) as bigint) as n_words, cast(length(array_join(w, '')) as bigint) as word_chars, {symbols} as n_symbols, {lines} as n_dup_lines, {_repeat_words()} as n_repeat_words)"
    failed = f"b.n_words < {MIN_WORDS} or 100 * b.n_repeat_words > {MAX_REPEAT_PERCENT} * b.n_words"
    names = ", ".join(f"b.{x} as {x}" for x in COUNTS)
    whole = _let(counts, "b", f"struct({names}, {failed} as base_failed)")
    return F.expr(_let(f"coalesce({text}, '')", "t", _let(f"array_remove(split(t, '{SPACE}+'), '')", "w", whole)).replace("\\x", "\\\\x").replace("\\n", "\\\\n"))


def _normalised(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, f"{SPACE}+", " "))), "[0-9]", "0")


def _host() -> Column:
    return F.coalesce("source", F.lit(""))


def boilerplate(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lines, depleted) of the documents that hold frequent lines of their host.

    ``lines`` are (host, h) of the frequent lines; depleted tells whether most of the words are in such lines. Its
    ``reads`` are the written tables that it reads.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _host().alias("host"), F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"))
    hashed = lines.withColumns(
        {
            "h": F.transform("lines", lambda x: F.xxhash64(_normalised(x))),
            "w": F.transform("lines", lambda x: F.size(F.array_remove(F.split(x, f"{SPACE}+"), ""))),
        }
    ).drop("lines")
    hashed = materialise(hashed, "quality-lines")
    lines_of_one = hashed.select("host", F.array_sort(F.array_distinct("h")).alias("h"))
    held = lines_of_one.select("host", F.xxhash64("h").alias("document"), F.explode_outer("h").alias("h"))
    per_document = held.where("h is not null").select("host", "h", "document").distinct()
    frequent = per_document.groupBy("host", "h").agg(F.count("*").alias("distinct_docs")).where(F.col("distinct_docs") > MAX_LINE_DOCS).select("host", "h")
    frequent = materialise(frequent, "quality-frequent")
    total = F.aggregate("w", F.lit(0), lambda t, x: t + x)
    occurring = hashed.select("doc_id", "text_hash", "host", total.alias("total"), F.posexplode_outer(F.arrays_zip("h", "w")).alias("place", "line"))
    occurring = occurring.select("doc_id", "text_hash", "host", "total", "place", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    if frequent.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        met = occurring.join(F.broadcast(frequent), ["host", "h"])
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = occurring.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "place"), F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"])
    removed = met.groupBy("doc_id", "text_hash", "total", "place", "w").agg(F.collect_set(F.struct("host", "h")).alias("lines"))
    found = (
        removed.groupBy("doc_id", "text_hash")
        .agg(F.sum("w").alias("gone"), F.max("total").alias("total"), F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
        .select("doc_id", "text_hash", "lines", (100 * (F.col("total") - F.col("gone")) < MIN_LEFT_PERCENT * F.col("total")).alias("depleted"))
    )
    found.reads = (hashed, frequent)
    return found


def depleted(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the documents whose lines are mostly boilerplate of their host."""
    return boilerplate(docs).where("depleted").select("doc_id", "text_hash")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    docs = docs.select("doc_id", "text", "source")
    names = [*COUNTS, "base_failed"]
    counts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), base().alias("b")).select("doc_id", "text_hash", "b.*")
    gone = depleted(docs).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), F.lit(True).alias("gone"))
    joined = counts.join(gone, counts.doc_id.eqNullSafe(gone.gone_id) & (counts.text_hash == gone.gone_hash), "left")
    return joined.select("doc_id", *names, (~F.col("base_failed") & F.col("gone").isNull()).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``quality`` rejects, and without the frequent lines of the rows that stay.

    n_chars, if there, follows a changed text; other columns pass through. Only rows that may hold frequent lines are shuffled.
    """
    good = docs.where(~base().getField("base_failed"))
    frequent = boilerplate(docs.select("doc_id", "text", "source"))
    found = materialise(frequent, "quality-boilerplate")
    forget(*frequent.reads)
    maybe, sure = split_by_ids(good, found.select("doc_id"))
    gone_id, gone_hash, lines, gone, own = fresh("id", "hash", "lines", "depleted", "own")
    found = found.toDF(gone_id, gone_hash, lines, gone)
    joined = maybe.join(found, named("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64(named("text")) == F.col(gone_hash)), "left").where(~F.coalesce(gone, F.lit(False)))
    of_host = F.transform(F.filter(lines, lambda x: x["host"] == _host()), lambda x: x["h"])
    joined = joined.withColumn(own, F.coalesce(of_host, F.array().cast("array<bigint>")))
    stay = F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(NOT_SPACE) & F.array_contains(own, F.xxhash64(_normalised(x)))))
    cut = F.size(own) > 0
    changed = {"text": F.when(cut, F.array_join(stay, "\n")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return sure.unionByName(joined.withColumns(changed).select(*all_of(docs)))
