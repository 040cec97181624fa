"""Secret scan, native: fixed patterns, plus strings that pass a battery of randomness tests.

Operator 5. Base kinds are found by pattern (``assign``, ``access``, ``hex``). The method looks at long runs of key
characters that hold both a digit and a letter, infers the encoding (hex, base 32, base 36, base 62, base 64) and
tests randomness over its alphabet: chi-squared uniformity, runs about the middle of the alphabet, and serial
correlation at lags 1 and 2. The four statistics are summed to a chi-squared of four degrees of freedom, whose
tail has a closed form.

False discoveries are controlled by encoding and length band over the whole input: p-values of random strings are
uniform, those of other strings pile up near 0, so twice the count above 1/2 estimates the random ones. A band's
threshold is the least p at which the estimated share of others above it is at most FALSE_SHARE. The counts are a
histogram of fixed size over distinct strings, so copies of a document move no threshold. A band of fewer than SPARSE
distinct strings goes by the histogram of all bands of its encoding; where that is sparse too, nothing can be
estimated, and strings from bin FALLBACK on (p of at least FALLBACK / BINS) are taken as random.

Positions are code points, end exclusive. Null and empty texts have no spans. A random string that overlaps a base
span is left to that span. Repeated rows get equal results; only doc_id and text are read,
and ``redact`` passes all other columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fragmill.llm.common import all_of

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "(AKIA[A-Z0-9]{16,})"
HEX = "([0-9a-f]{24,})"
RANDOM = "([A-Za-z0-9+/_-]{20,})"
#: Kinds in their order, with the least length of the pattern's group.
BASE = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
#: Encodings: size of the alphabet, pattern of the whole string, alphabet in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    (16, "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    (32, "^[A-Z2-7]+$", UPPER + "234567"),
    (36, "^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    (62, "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    (64, "^.*$", UPPER + LOWER + DIGITS + "+/"),
)
BINS, FALSE_SHARE = 50, 0.1
#: Fewer distinct strings than this give no histogram; without one, the least bin that is taken as random.
SPARSE, FALLBACK = 50, 5
REDACTED = "[secret]"


def _located(text: str, pattern: str, kind: int, least: int) -> Column:
    """Spans of ``pattern`` in column ``text``: struct(start, kind, end), group 1 having ``least`` characters."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    parts = f"zip_with(regexp_extract_all({text}, '{p}', 0), regexp_extract_all({text}, '{p}', 1), (m, v) -> struct(length(m) as m, length(v) as v))"
    gaps = f"transform(split({text}, '{p}', -1), g -> length(g))"
    walked = (
        f"aggregate(slice(zip_with({parts}, {gaps}, (x, g) -> struct(x.m as m, x.v as v, g as g)), 1, size({gaps}) - 1), "
        "struct(0 as at, cast(array() as array<struct<start:int,kind:int,end:int>>) as found), "
        f"(s, x) -> struct(s.at + x.g + x.m as at, if(x.v >= {least}, concat(s.found, array(struct(s.at + x.g as start, {kind} as kind, s.at + x.g + x.m as end))), s.found) as found), "
        "s -> s.found)"
    )
    return F.expr(f"case when {text} rlike '{p}' then {walked} else cast(array() as array<struct<start:int,kind:int,end:int>>) end")


def _lagged(array: str, by: int, what: str) -> str:
    return f"aggregate(zip_with(slice({array}, 1, greatest(size({array}) - {by}, 0)), slice({array}, {by + 1}, size({array})), (a, b) -> {what}), 0D, (t, x) -> t + x)"


def _case(what: dict[str, str]) -> str:
    return "case " + " ".join(f"when r.value rlike '{p}' then {x}" for p, x in what.items()) + " end"


#: The battery, a field at a time; r is one string's struct so far.
STEPS = (
    ("k", _case({p: str(size) for size, p, _ in ENCODINGS})),
    ("n", "cast(length(r.value) as double)"),
    ("s", "case when r.k in (16, 36) then lower(r.value) else translate(r.value, '-_', '+/') end"),
    ("c", "split(r.s, '')"),
    ("v", "transform(r.c, c -> cast(instr(" + _case({p: f"'{abc}'" for _, p, abc in ENCODINGS}) + ", c) - 1 as double))"),
    ("squares", "aggregate(transform(r.c, c -> length(r.s) - length(replace(r.s, c, ''))), 0, (t, x) -> t + x)"),
    ("mean", "aggregate(r.v, 0D, (t, x) -> t + x) / r.n"),
    ("d", "transform(r.v, x -> x - r.mean)"),
    ("up", "transform(r.v, x -> if(2 * x >= r.k - 1, 1D, 0D))"),
    ("power", "aggregate(r.d, 0D, (t, x) -> t + x * x)"),
    ("ups", "aggregate(r.up, 0D, (t, x) -> t + x)"),
    ("runs", "1D + " + _lagged("r.up", 1, "abs(a - b)")),
    ("mu", "2 * r.ups * (r.n - r.ups) / r.n + 1"),
    ("z_uniform", "(r.k * r.squares / r.n - r.n - (r.k - 1)) / sqrt(2D * (r.k - 1) * (r.n - 1) / r.n)"),
    ("z_runs", "if(r.mu <= 2, sqrt(r.n), (r.runs - r.mu) / sqrt((r.mu - 1) * (r.mu - 2) / (r.n - 1)))"),
    ("z_lag1", "if(r.power = 0, r.n, " + _lagged("r.d", 1, "a * b") + " / r.power * sqrt(r.n))"),
    ("z_lag2", "if(r.power = 0, r.n, " + _lagged("r.d", 2, "a * b") + " / r.power * sqrt(r.n))"),
    ("x", "r.z_uniform * r.z_uniform + r.z_runs * r.z_runs + r.z_lag1 * r.z_lag1 + r.z_lag2 * r.z_lag2"),
    ("band", "case when r.n < 32 then 4 when r.n < 64 then 5 when r.n < 128 then 6 else 7 end"),
    ("bin", f"cast(least(floor(exp(-r.x / 2) * (1 + r.x / 2) * {BINS}), {BINS - 1}) as int)"),
)
KEPT = ("start", "kind", "end", "k", "band", "bin")


def _tested(df: DataFrame, kept_of_run: tuple[str, ...] = KEPT) -> DataFrame:
    """``df`` with __runs: the mixed strings of column __text, each with its encoding, length band and p-value's bin."""
    df = df.withColumn("__runs", _located("__text", RANDOM, len(BASE), 1))
    cut = "filter(transform(__runs, r -> struct(r.start as start, r.kind as kind, r.end as end, substring(__text, r.start + 1, r.end - r.start) as value)), r -> r.value rlike '[0-9]' and r.value rlike '[A-Za-z]')"
    df, fields = df.withColumn("__runs", F.expr(cut)), ["start", "kind", "end", "value"]
    for name, step in STEPS:
        kept = ", ".join(f"r.{x} as {x}" for x in fields)
        df = df.withColumn("__runs", F.expr(f"transform(__runs, r -> struct({kept}, {step} as {name}))"))
        fields.append(name)
    return df.withColumn("__runs", F.expr("transform(__runs, r -> struct(" + ", ".join(f"r.{x} as {x}" for x in kept_of_run) + "))"))


def thresholds(docs: DataFrame) -> DataFrame:
    """(k, band, least): the least bin that is taken as random, by encoding and length band; bounded in size."""
    texts = docs.where(F.col("text").rlike(RANDOM)).select(F.col("text").alias("__text"))
    tested = _tested(texts, ("k", "band", "bin", "value")).select(F.explode("__runs").alias("r"))
    strings = tested.select("r.k", "r.band", "r.bin", F.xxhash64("r.value").alias("h")).distinct()
    own = strings.groupBy("k", "band", "bin").agg(F.count("*").alias("n"))
    # band -1 is all bands of an encoding
    counts = own.withColumn("band", F.explode(F.array("band", F.lit(-1)))).groupBy("k", "band", "bin").agg(F.sum("n").alias("n"))
    down, whole = Window.partitionBy("k", "band").orderBy(F.desc("bin")), Window.partitionBy("k", "band")
    upper = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(whole)
    counts = counts.withColumns({"above": F.sum("n").over(down), "random": 2 * upper})
    false = F.greatest(F.col("above") - F.col("random") * (1 - F.col("bin") / BINS), F.lit(0.0))
    taken = F.when((F.col("bin") >= 1) & (false <= FALSE_SHARE * F.col("above")), F.col("bin"))
    # BINS: no string of the band passes
    found = counts.groupBy("k", "band").agg(F.sum("n").alias("n"), F.coalesce(F.min(taken), F.lit(BINS)).alias("least"))
    pooled = found.where("band = -1").select("k", F.col("n").alias("pooled_n"), F.col("least").alias("pooled"))
    least = F.when(F.col("n") >= SPARSE, F.col("least")).when(F.col("pooled_n") >= SPARSE, F.col("pooled")).otherwise(FALLBACK)
    return found.where("band != -1").join(F.broadcast(pooled), "k").select("k", "band", least.alias("least"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with __base and __spans: arrays of struct(start, kind, end), kind by number, in order."""
    limits = thresholds(docs.select("text")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("k") * 10 + F.col("band"), "least"))))
    found = [_located("__text", pattern, kind, least) for kind, (_, pattern, least) in enumerate(BASE)]
    df = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    df = _tested(df.withColumn("__base", F.sort_array(F.concat(*found)))).withColumn("__limits", limits.scalar())
    passed = "filter(__runs, r -> r.bin >= element_at(__limits, r.k * 10 + r.band) and not exists(__base, b -> b.start < r.end and r.start < b.end))"
    spans = f"case when size(__runs) = 0 then __base else sort_array(concat(__base, transform({passed}, r -> struct(r.start as start, r.kind as kind, r.end as end)))) end"
    return df.withColumn("__spans", F.expr(spans)).drop("__runs", "__limits", "__text")


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{x}'" for x in [*(k for k, _, _ in BASE), "random"])
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs`` (doc_id, text)."""
    df = with_spans(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(__base, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, (name, _, _) in enumerate(BASE)]
    return df.select("doc_id", *counts, F.sha2(_listed("__base"), 256).alias("base_sha256"), _listed("__spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by REDACTED (overlapping ones together); n_chars, if there, follows."""
    walked = (
        "aggregate(__spans, struct(0 as at, '' as out), (s, x) -> case "
        f"when x.start >= s.at then struct(x.end as at, concat(s.out, substring(text, s.at + 1, x.start - s.at), '{REDACTED}') as out) "
        "else struct(greatest(s.at, x.end) as at, s.out as out) end, s -> concat(s.out, substring(text, s.at + 1)))"
    )
    # the row goes along as one struct, so no column of it can clash with those of the scan
    found = with_spans(docs.select(F.struct(*all_of(docs)).alias("row"), "text"))
    text = F.expr(f"case when size(__spans) = 0 then text else {walked} end")
    changed = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
