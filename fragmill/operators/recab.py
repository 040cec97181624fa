"""Base-quality recalibration table: per covariate tuple, observations, mismatches and the empirical quality."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragmill.functions import reads as R

#: Known sites are sent to all tasks up to this many positions; beyond it they are joined by shuffle.
SITES_LIMIT = 1_000_000
#: Bases looked at together, positions of all contigs up to which sites are looked up by place, tuples that a task holds.
BASES_AT_ONCE, PLACES_LIMIT, TUPLES_LIMIT = 1 << 20, 1 << 25, 1 << 20
#: The usual covariates, columns of ``bases``.
COVARIATES = ("rg", "quality", "cycle", "dinuc")


def reject_reason(mapq: str = "mapq", flag: str = "flag") -> Column:
    """Why a read takes no part, the first reason that holds; null if it does."""
    q = F.col(mapq)
    return F.when(R.has(flag, R.UNMAPPED), "Unmapped").when((q == 0) | (q == 255), "MapQ").when(R.has(flag, R.DUPLICATE), "Duplicate").when(R.has(flag, R.FAILED_QC), "FailedQC").when(R.has(flag, R.SECONDARY), "SecondaryAlignment")


def _taking_part(sam: DataFrame, default_rg: str | None) -> DataFrame:
    rg = F.coalesce("rg", F.lit(default_rg)) if default_rg else F.col("rg")
    rg = F.coalesce(rg, F.raise_error(F.lit("read without a read group")))
    return sam.where(reject_reason().isNull()).select(rg.alias("rg"), "flag", F.col("rname").alias("contig"), F.col("pos").alias("p"), F.abs(F.coalesce("tlen", F.lit(0))).alias("isize"), "seq", "qual", "cigar", "md")


def bases(sam: DataFrame, default_rg: str | None = None) -> DataFrame:
    """One row for each base that takes part: rg, quality, cycle, dinuc, contig, ref, mismatch.

    Reads are parsed once, to arrays of (position, mismatch), before they are exploded; everything after the explode
    is simple arithmetic inside generated code. ``posexplode_outer`` keeps the optimizer from parsing twice.
    """
    read = _taking_part(sam, default_rg).select("rg", "flag", "contig", "p", "isize", "seq", "qual", R.cigar_ops("cigar").alias("ops"), R.md_matches("md").alias("same"))
    read = read.select("rg", "flag", "contig", "isize", "seq", "qual", R.coordinates("ops", "p").alias("at"), "same")
    read = read.select("rg", "flag", "contig", "isize", "seq", "qual", F.expr("transform(at, c -> struct(c.ref as ref, if(c.m >= 0, not same[c.m], false) as mismatch))").alias("at"))
    base = read.select("rg", "contig", "isize", "seq", "qual", R.has("flag", R.REVERSE).alias("reverse"), R.has("flag", R.SECOND).alias("second"), F.length("seq").alias("n"), F.posexplode_outer("at").alias("i", "c"))
    base = base.select("rg", "contig", "isize", "seq", "reverse", "second", "n", "i", F.col("c.ref").alias("ref"), F.col("c.mismatch").alias("mismatch"), F.expr("ascii(substring(qual, i + 1, 1))").alias("code"), F.expr("substring(seq, i + 1, 1)").alias("b"))
    trimmed = (F.col("isize") > 0) & (F.col("isize") < F.col("n")) & F.when(F.col("reverse"), F.col("i") < F.col("n") - F.col("isize")).otherwise(F.col("i") >= F.col("isize"))
    base = base.where((F.col("ref") > 0) & (F.col("b") != "N") & (F.col("code") > R.SANGER) & ~trimmed)
    other = lambda x: F.translate(x, "ACGT", "TGCA")
    before = F.when(F.col("reverse"), F.expr("if(i = n - 1, 'N', substring(seq, i + 2, 1))")).otherwise(F.expr("if(i = 0, 'N', substring(seq, i, 1))"))
    pair = F.when(F.col("reverse"), F.concat(other(before), other("b"))).otherwise(F.concat(before, "b"))
    cycle = F.when(F.col("reverse"), F.col("n") - F.col("i")).otherwise(F.col("i") + 1) * F.when(F.col("second"), -1).otherwise(1)
    return base.select("rg", (F.col("code") - R.SANGER).alias("quality"), cycle.alias("cycle"), F.when(before == "N", "NN").otherwise(pair).alias("dinuc"), "contig", "ref", "mismatch", "second", "reverse")


def sites(variants: DataFrame) -> DataFrame:
    """(contig, ref): every position that the variants (contig, pos, len) cover."""
    return variants.select("contig", F.explode(F.sequence("pos", F.col("pos") + F.col("len") - 1)).alias("ref")).distinct()


#: Fixed value: the complement of a base's letter.
_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[[*b"ACGT"]] = [*b"TGCA"]
_N, _NONE, _ZERO = ord("N"), 0, 1 << 25
COUNTED = "rg string, quality int, cycle int, dinuc string, second boolean, reverse boolean, n_observations long, n_mismatches long"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}


def _walk(cigar: str | None, md: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Per base of a read: its distance from the read's position on the reference, -1 off it, and whether it is a mismatch."""
    if cigar != "*" and not (cigar and re.fullmatch(r"(?:[0-9]+[MIDNSHP])+", cigar)):
        raise ValueError(f"bad CIGAR {cigar}")
    if not (md and re.fullmatch(r"[0-9]+(?:[A-Z][0-9]+|\^[A-Z]+[0-9]+)*", md)):
        raise ValueError("missing or bad MD tag")
    at, p = [np.empty(0, np.int64)], 0
    for n, op in re.findall(r"([0-9]+)([MIDNSHP])", cigar):
        if op not in "MISD":
            raise ValueError(f"CIGAR operator {op} has no coordinates")
        if op != "D":
            at.append(np.arange(p, p + int(n)) if op == "M" else np.full(int(n), -1))
        p += int(n) if op in "MD" else 0
    distance = np.concatenate(at)
    aligned = distance >= 0
    odd, m = [], 0
    for n, letter in re.findall(r"([0-9]+)|([A-Z])", re.sub(r"\^[A-Z]+", " ", md)):
        if letter:
            odd.append(m)
        m += 1 if letter else int(n)
    if aligned.sum() > m:
        raise ValueError(f"MD tag {md} is too short for CIGAR {cigar}")
    mismatch = np.zeros(len(distance), bool)
    mismatch[np.flatnonzero(aligned)[[k for k in odd if k < aligned.sum()]]] = True
    return distance, mismatch


def _letters(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, a row each, filled up with zeros to ``width``; and their lengths."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    if (data >= 128).any():
        raise ValueError("bases and qualities must be ASCII")
    lengths = np.diff(offsets).astype(np.int64)
    if (lengths == width).all():
        return data.reshape(len(column), width), lengths
    rows = np.zeros((len(column), int(max(width, lengths.max(initial=0)))), np.uint8)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = data
    return rows[:, :width], lengths


class _Known:
    """Whether bases lie on known sites: by place where contigs are short, else by search."""

    def __init__(self, contigs: list[str], contig: np.ndarray, ref: np.ndarray) -> None:
        self.contigs = {name: k for k, name in enumerate(contigs)}
        keep = ref > 0
        key = np.sort(contig[keep].astype(np.int64) << 32 | ref[keep])
        self.key, self.stride = key, int(ref.max(initial=0)) + 1
        self.places = None
        if self.stride * (len(contigs) + 1) <= PLACES_LIMIT:
            self.places = np.zeros(self.stride * (len(contigs) + 1), bool)
            self.places[(key >> 32) * self.stride + (key & 0xFFFFFFFF)] = True

    def found(self, contig: np.ndarray, ref: np.ndarray) -> np.ndarray:
        """contig: its number, -1 without one; ref: positions of at least 1."""
        if not len(self.key):
            return np.zeros(len(ref), bool)
        if self.places is not None:
            inside = (contig >= 0) & (ref < self.stride)
            return self.places[np.where(inside, contig * self.stride + ref, 0)] & inside
        key = np.where(contig >= 0, contig << 32 | ref, -1)
        return self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] == key


def _count(known: tuple | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's reads (columns of ``_taking_part``) to rows of COUNTED, each tuple once as long as TUPLES_LIMIT hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites = _Known(*known) if known else None
        walks: dict[tuple, tuple] = {}
        groups: dict[str, int] = {}
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            rows = np.concatenate(held, axis=1)
            keys, place = np.unique(rows[0], return_inverse=True)
            return np.stack([keys, *(np.bincount(place, r, len(keys)).astype(np.int64) for r in rows[1:])])

        def out(rows: np.ndarray) -> pa.RecordBatch:
            key, n, odd = rows
            group, second, reverse = key >> 49, key & 1, key >> 1 & 1
            before, base = (key >> 2 & 127), (key >> 9 & 127)
            names = list(groups)
            pair = before << 7 | base
            kinds, kind = np.unique(pair, return_inverse=True)
            text = ["NN" if k >> 7 == _N else "".join(chr(c) for c in (k >> 7, k & 127) if c != _NONE) for k in kinds.tolist()]
            cycle = ((key >> 23 & 0x3FFFFFF) - _ZERO) * (1 - 2 * second)
            columns = [pa.array(names, pa.string()).take(pa.array(group)), key >> 16 & 127, cycle, pa.array(text, pa.string()).take(pa.array(kind)), second == 1, reverse == 1, n, odd]
            fields = [f.split(" ") for f in COUNTED.split(", ")]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(_ARROW[t].to_pandas_dtype())) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])

        for whole in batches:
            widest = max(1, *(int(pa.compute.max(pa.compute.binary_length(whole.column(c))).as_py() or 0) for c in ("seq", "qual"))) if len(whole) else 1
            step = max(1, BASES_AT_ONCE // widest)
            for at in range(0, len(whole), step):
                rows = _tuples(whole.slice(at, step), walks, groups, sites)
                if rows.shape[1]:
                    held.append(rows)
                if sum(r.shape[1] for r in held) > TUPLES_LIMIT:
                    held[:] = [merged()]
                if held and (held[0].shape[1] > TUPLES_LIMIT // 2 or len(groups) > 8000):
                    yield out(merged())
                    held.clear()
                    groups.clear()
        if held:
            yield out(merged())

    return run


def _tuples(reads: pa.RecordBatch, walks: dict[tuple, tuple], groups: dict[str, int], sites: _Known | None) -> np.ndarray:
    """Keys (group, cycle, quality, base, base before, reverse, second in bits), observations and mismatches of some reads."""
    column = lambda name: reads.column(reads.schema.get_field_index(name))
    number = lambda name: column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = [column(n).dictionary_encode(null_encoding="encode") for n in ("cigar", "md")]
    both, which = np.unique(coded[0].indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(coded[1].dictionary) + coded[1].indices.to_numpy(zero_copy_only=False), return_inverse=True)
    if len(walks) > 100_000:
        walks.clear()
    found = []
    for k in both.tolist():
        pair = coded[0].dictionary[k // len(coded[1].dictionary)].as_py(), coded[1].dictionary[k % len(coded[1].dictionary)].as_py()
        if pair not in walks:
            walks[pair] = _walk(*pair)
        found.append(walks[pair])
    width = max((len(d) for d, _ in found), default=0)
    if not width:
        return np.empty((3, 0), np.int64)
    distance, odd = np.full((len(found), width), -1, np.int32), np.zeros((len(found), width), bool)
    for k, (d, m) in enumerate(found):
        distance[k, : len(d)], odd[k, : len(d)] = d, m
    wide = width + 1
    seq, n = _letters(column("seq").fill_null(""), wide)
    qual, _ = _letters(column("qual").fill_null(""), wide)
    flag, isize, p = number("flag"), number("isize"), number("p")
    reverse, second = flag & R.REVERSE != 0, flag & R.SECOND != 0
    placed = column("p").is_valid().to_numpy(zero_copy_only=False) & column("seq").is_valid().to_numpy(zero_copy_only=False)
    i = np.arange(width)
    kept = (distance >= 0)[which] & (seq[:, :width] != _N) & (qual[:, :width] > R.SANGER) & placed[:, None]
    # of a template shorter than the read, what lies beyond its end
    cut = (isize > 0) & (isize < n)
    low, high = np.where(cut & reverse, n - isize, 0), np.where(cut & ~reverse, isize, width)
    kept &= (i >= low[:, None]) & (i < high[:, None])
    row, i = np.nonzero(kept)
    ref = distance[which[row], i] + p[row]
    good = ref > 0
    if sites:
        names = column("contig").dictionary_encode()
        code = np.array([sites.contigs.get(x, -1) for x in names.dictionary.to_pylist()] + [-1], np.int64)
        contig = code[names.indices.fill_null(len(code) - 1).to_numpy(zero_copy_only=False)]
        good &= ~sites.found(contig[row], np.maximum(ref, 1))
    if not good.all():
        row, i = row[good], i[good]
    back, last = reverse[row], n[row] - 1
    base = seq[row, i]
    before = np.where(back, seq[row, i + 1], seq[row, i - 1])
    unknown = np.where(back, i == last, i == 0) | (before == _N)
    before = np.where(unknown, _N, np.where(back, _OTHER[before], before))
    base = np.where(unknown, _N, np.where(back, _OTHER[base], base))
    own = column("rg").dictionary_encode()
    group = np.array([groups.setdefault(x, len(groups)) for x in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy(zero_copy_only=False)]
    cycle = np.where(back, last - i + 1, i + 1)
    mismatch = odd[which[row], i]
    # few different letters, groups and qualities: counted by a dense number
    letter = np.zeros(256, np.int64)
    present = np.unique(np.concatenate([base, before])) if len(base) else np.empty(0, np.uint8)
    letter[present] = np.arange(len(present))
    quality = qual[row, i] - R.SANGER
    side = (back * 2 + second[row]).astype(np.int64)
    negative = int(-cycle.min(initial=0))
    sizes = [len(groups), int(cycle.max(initial=0)) + negative + 1, 128, len(present), len(present), 4]
    dense = np.ravel_multi_index((group[row], cycle + negative, quality.astype(np.int64), letter[base], letter[before], side), sizes) if len(base) else np.empty(0, np.int64)
    if len(base) and np.prod(sizes, dtype=float) <= 8 * BASES_AT_ONCE:
        total = np.bincount(dense)
        cells = np.flatnonzero(total)
        seen, wrong = total[cells], np.bincount(dense[mismatch], minlength=len(total))[cells]
    else:
        cells, place = np.unique(dense, return_inverse=True)
        seen, wrong = np.bincount(place, minlength=len(cells)), np.bincount(place[mismatch], minlength=len(cells))
    if not len(cells):
        return np.empty((3, 0), np.int64)
    g, c, q, b, f, s = np.unravel_index(cells, sizes)
    key = g.astype(np.int64) << 49 | (c - negative + _ZERO) << 23 | q << 16 | present[b].astype(np.int64) << 9 | present[f].astype(np.int64) << 2 | s
    return np.stack([key, seen, wrong])


def without_sites(base: DataFrame, known: DataFrame) -> DataFrame:
    return base.join(known, ["contig", "ref"], "left_anti")


def table(sam: DataFrame, variants: DataFrame | None = None, smoothing: float = 0.0, max_quality: int = 40, default_rg: str | None = None, covariates: Sequence[str | tuple[str, Column]] = COVARIATES) -> DataFrame:
    """Covariates, n_observations, n_mismatches, q_empirical; counting within each task precedes the one shuffle.

    A covariate is a column of ``bases``, or a name and an expression over these columns. Covariates of rg, quality,
    cycle, dinuc, second and reverse are counted from arrays of whole batches of reads; with others, or more known
    sites than SITES_LIMIT, each base becomes a row.
    """
    keys = [F.col(c) if isinstance(c, str) else c[1].alias(c[0]) for c in covariates]
    known, few, held = None, True, None
    if variants is not None:
        known = sites(variants)
        first = known.limit(SITES_LIMIT + 1).toArrow()
        few = first.num_rows <= SITES_LIMIT
        if few:
            first = first.drop_null().combine_chunks()
            contig = first["contig"].combine_chunks().dictionary_encode() if first.num_rows else pa.array([], pa.string()).dictionary_encode()
            contig = contig.combine_chunks() if isinstance(contig, pa.ChunkedArray) else contig
            held = contig.dictionary.to_pylist(), contig.indices.to_numpy(zero_copy_only=False), first["ref"].to_numpy().astype(np.int64)
    counted = _taking_part(sam, default_rg).mapInArrow(_count(held), COUNTED) if few else None
    try:
        counts = counted.groupBy(*keys).agg(F.sum("n_observations").alias("n_observations"), F.sum("n_mismatches").alias("n_mismatches")) if few else None
    except AnalysisException:
        counts = None
    if counts is None:
        base = bases(sam, default_rg)
        base = base if known is None else without_sites(base, F.broadcast(known) if few else known)
        counts = base.groupBy(*keys).agg(F.count("*").alias("n_observations"), F.sum(F.col("mismatch").cast("long")).alias("n_mismatches"))
    return counts.withColumn("q_empirical", R.empirical_quality("n_observations", "n_mismatches", smoothing, max_quality))


def counters(sam: DataFrame) -> DataFrame:
    """(name, value): reads used and rejected by reason; reasons without reads are listed as 0."""
    names = ["Used", "Unmapped", "MapQ", "Duplicate", "FailedQC", "SecondaryAlignment"]
    reason = F.coalesce(reject_reason(), F.lit("Used"))
    total = sam.select(reason.alias("r")).agg(*(F.sum((F.col("r") == n).cast("long")).alias(n) for n in names))
    return total.unpivot([], names, "name", "value").select("name", F.coalesce("value", F.lit(0)).alias("value"))


def write_csv(counted: DataFrame, path: str) -> None:
    """The table as one CSV file with a heading; a table has a few thousand rows, whatever its reads. It is counted in many tasks and written in one."""
    #: Fixed value: the heading of the table.
    heading = ["ReadGroup", "QualityScore", "Cycle", "Dinuc", "nObservations", "nMismatches", "Qempirical"]
    counted.toDF(*heading).repartition(1).write.option("header", True).csv(path)
