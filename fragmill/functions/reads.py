"""Column functions on bases, qualities, flags, CIGAR and MD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED_QC, DUPLICATE = (1 << k for k in range(11))
#: Letters of the flag legend, in bit order.
LEGEND = "pPuUrR12sfd"
SANGER, ILLUMINA, MAX_QUALITY = 33, 64, 62


def has(flag: Column | str, bit: int) -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(bit)) != 0


def flag_text(flag: str) -> Column:
    """Eleven letters, one a bit, ``-`` where the bit is off."""
    return F.concat(*(F.when(has(flag, 1 << k), F.lit(x)).otherwise(F.lit("-")) for k, x in enumerate(LEGEND)))


def reverse_complement(bases: str | Column) -> Column:
    return F.reverse(F.translate(bases, "ACGTN", "TGCAN"))


def reencode(quals: str | Column, source: int = ILLUMINA, target: int = SANGER) -> Column:
    """Qualities moved from one offset to another; out-of-range characters raise."""
    column = F.col(quals) if isinstance(quals, str) else quals
    span = range(MAX_QUALITY + 1)
    valid = "".join(chr(source + k) for k in span)
    moved = F.translate(column, valid, "".join(chr(target + k) for k in span))
    rest = F.length(F.translate(column, valid, "")) > 0
    return F.when(rest, F.raise_error(F.lit("base quality out of range"))).otherwise(moved)


def guess_encoding(quals: str) -> Column:
    """sanger, illumina or unknown, from the extreme characters of a quality string."""
    codes = F.transform(F.split(quals, ""), lambda c: F.ascii(c))
    return F.when(F.array_min(codes) < 59, "sanger").when(F.array_max(codes) > 73, "illumina").otherwise("unknown")


def known_bases(bases: str) -> Column:
    """Bases other than N (or the unknown mark ``.``)."""
    return F.length(F.translate(bases, "N.", ""))


def cigar_ops(cigar: str = "cigar") -> Column:
    """array<struct<len:int,op:string>>; ``*`` gives none, anything that isn't a CIGAR raises."""
    whole = r"^(\d+[MIDNSHP])+$"
    parts = f"zip_with(regexp_extract_all({cigar}, '(\\\\d+)[MIDNSHP]', 1), regexp_extract_all({cigar}, '\\\\d+([MIDNSHP])', 1), (n, o) -> struct(cast(n as int) as len, o as op))"
    empty = "cast(array() as array<struct<len:int,op:string>>)"
    return F.when(F.col(cigar) == "*", F.expr(empty)).when(F.col(cigar).rlike(whole), F.expr(parts)).otherwise(F.raise_error(F.concat(F.lit("bad CIGAR "), F.col(cigar))))


def cigar_text(ops: str) -> Column:
    return F.expr(f"if(size({ops}) = 0, '*', array_join(transform({ops}, o -> concat(o.len, o.op)), ''))")


def coordinates(ops: str, pos: str) -> Column:
    """Per base struct(ref, m): reference position and index among the aligned bases, both -1 off the reference."""
    walked = (
        f"aggregate({ops}, struct(cast({pos} as int) as p, 0 as m, cast(array() as array<struct<ref:int,m:int>>) as a), (s, o) -> case "
        "when o.op = 'M' then struct(s.p + o.len as p, s.m + o.len as m, concat(s.a, transform(sequence(0, o.len - 1), j -> struct(s.p + j as ref, s.m + j as m))) as a) "
        "when o.op in ('I', 'S') then struct(s.p as p, s.m as m, concat(s.a, array_repeat(struct(-1 as ref, -1 as m), o.len)) as a) "
        "when o.op = 'D' then struct(s.p + o.len as p, s.m as m, s.a as a) "
        "else raise_error(concat('CIGAR operator ', o.op, ' has no coordinates')) end, s -> s.a)"
    )
    return F.expr(walked)


def md_matches(md: str) -> Column:
    """Booleans per aligned base: whether it equals the reference. Deletions are skipped; a bad or missing MD raises."""
    tokens = f"regexp_extract_all(regexp_replace({md}, '\\\\^[A-Z]+', ' '), '(\\\\d+|[A-Z])', 1)"
    runs = f"flatten(transform({tokens}, t -> if(t rlike '^[0-9]', array_repeat(true, cast(t as int)), array(false))))"
    return F.when(F.col(md).rlike(r"^\d+([A-Z]\d+|\^[A-Z]+\d+)*$"), F.expr(runs)).otherwise(F.raise_error(F.lit("missing or bad MD tag")))


def untrimmed_left(ops: str, pos: str) -> Column:
    """Position of the first base had no end been clipped."""
    return F.expr(f"{pos} - if({ops}[0].op in ('S', 'H'), {ops}[0].len, 0) - if(size({ops}) > 1 and {ops}[0].op = 'H' and {ops}[1].op = 'S', {ops}[1].len, 0)")


def untrimmed_right(ops: str, pos: str) -> Column:
    span = f"aggregate({ops}, 0, (t, o) -> t + if(o.op in ('M', 'D', 'N'), o.len, 0))"
    back = f"reverse({ops})"
    return F.expr(f"{pos} + {span} - 1 + if({back}[0].op in ('S', 'H'), {back}[0].len, 0) + if(size({ops}) > 1 and {back}[0].op = 'H' and {back}[1].op = 'S', {back}[1].len, 0)")


def map_score(quals: str, least: int = 15) -> Column:
    """Sum of the base qualities of at least ``least``."""
    return F.expr(f"aggregate(transform(split({quals}, ''), c -> ascii(c) - {SANGER}), 0L, (t, q) -> t + if(q >= {least}, q, 0))")


def template_length(tlen: str = "tlen") -> Column:
    return F.nullif(F.abs(F.col(tlen)), F.lit(0))


def empirical_quality(observed: str, mismatched: str, smoothing: float = 0.0, most: int = 40) -> Column:
    if smoothing < 0 or most <= 0:
        raise ValueError("smoothing must be at least 0 and the highest quality positive")
    rate = (F.col(mismatched) + F.lit(float(smoothing))) / (F.col(observed) + F.lit(float(smoothing)))
    q = F.rint(-10 * F.log10(rate + F.lit(1e-4)))
    return F.when(q > most, most).when(q <= 0, 1).otherwise(q).cast("int")


def substitutions(tag: str, most: int) -> Column:
    """Every string within ``most`` substitutions of column ``tag`` over ACGTN, itself included; small ``most`` only."""
    found = f"array({tag})"
    for _ in range(most):
        found = f"array_distinct(flatten(transform({found}, t -> flatten(transform(sequence(1, length(t)), i -> transform(array('A', 'C', 'G', 'T', 'N'), b -> overlay(t placing b from i for 1)))))))"
    return F.expr(found)


def hamming(a: str, b: str) -> Column:
    """Substitutions between strings of one length; null where the lengths differ."""
    return F.expr(f"case when length({a}) = length({b}) then size(filter(zip_with(split({a}, ''), split({b}, ''), (x, y) -> x <> y), z -> z)) end")


def quality_array(quals: str) -> Column:
    """Phred+33 text as array<int>."""
    return quality_array_of(F.col(quals))


def quality_array_of(quals: Column) -> Column:
    """As ``quality_array``, of an expression."""
    return F.transform(F.split(quals, ""), lambda c: F.ascii(c) - SANGER)


def quality_text(scores: str) -> Column:
    """array<int> as Phred+33 text."""
    return F.array_join(F.transform(scores, lambda q: F.chr(q + SANGER)), "")


def pack_bases(bases: str) -> Column:
    """struct(n, packed) of a string over ACGT: two bits a base, the first in the highest, 16 bases a word, the last one filled up with A."""
    digits = "rpad(translate(substr(s, k * 16 + 1, 16), 'ACGT', '0123'), 16, '0')"
    words = f"transform(sequence(0, cast((length(s) + 15) div 16 as int) - 1), k -> lpad(conv({digits}, 4, 16), 8, '0'))"
    good = "assert_true(s rlike '^[ACGT]*$', 'only ACGT can be packed')"
    packed = f"case when {good} is null then struct(length(s) as n, unhex(if(length(s) = 0, '', array_join({words}, ''))) as packed) end"
    # as a lambda's variable the string is made once
    return F.expr(f"transform(array({bases}), s -> {packed})[0]")


def unpack_bases(packed: str) -> Column:
    """The string that ``pack_bases`` packed into column ``packed``."""
    words = f"transform(sequence(0, greatest(length({packed}.packed) div 4 - 1, 0)), k -> lpad(conv(hex(substr({packed}.packed, cast(k * 4 + 1 as int), 4)), 16, 4), 16, '0'))"
    return F.expr(f"substr(translate(array_join({words}, ''), '0123', 'ACGT'), 1, {packed}.n)")


def attributes_json(names: str) -> Column:
    """A map of attribute names to values as JSON text, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(names))))


def tile_code(surface: str, swath: str, tile: str) -> Column:
    return F.format_string("%d%d%02d", surface, swath, tile)
