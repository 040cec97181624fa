"""Alignment of read pairs: hits, their filters, duplicates, and their records as fragments, flat rows and SAM.

An aligner gets batches of pairs and returns for each read one hit. A pair's hits stay in one row, so mates exchange
their fields without a join; only the search for duplicates shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fragmill.functions import reads as R
from fragmill.operators import alignments as A

#: One read's hit: its number, whether it was sequenced as one of a pair; bases and quals as sequenced, pos from 1, ref_len the bases of the contig that it covers.
HIT = "read int, paired boolean, bases string, quals string, mapped boolean, contig string, pos int, cigar string, ref_len int, mapq int, reverse boolean, proper boolean, mismatches int, score int, md string"
SCHEMA = f"id string, hits array<struct<{HIT.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>>"
Link = Callable[[DataFrame], DataFrame]


class PairAligner(Protocol):
    """Finds the hits of pairs: lists of bases and qualities of both reads (the second may be None)."""

    def hits(self, pairs: list[tuple[tuple[str, str], tuple[str, str] | None]]) -> list[list[dict]]: ...


class ExactAligner:
    """A small aligner for tests and examples: the first exact place, on either strand, in a few contigs.

    Places are looked up by each read's first SEED letters; for shorter reads the contigs are searched. Two reads are proper if they are on one contig, on different strands, at most ``reach`` apart.
    """

    SEED = 12
    OTHER = str.maketrans("ACGT", "TGCA")

    def __init__(self, contigs: dict[str, str], reach: int = 1000) -> None:
        self.contigs, self.reach, self.seeds = contigs, reach, {}
        for name, sequence in contigs.items():
            for at in range(len(sequence) - self.SEED + 1):
                self.seeds.setdefault(sequence[at : at + self.SEED], []).append((name, at))

    def _place(self, bases: str) -> tuple[str, int, bool] | None:
        for reverse in (False, True):
            read = bases[::-1].translate(self.OTHER) if reverse else bases
            if len(read) < self.SEED:
                places = ((name, sequence.find(read)) for name, sequence in self.contigs.items())
            else:
                places = self.seeds.get(read[: self.SEED], ())
            for name, at in places:
                if at >= 0 and self.contigs[name].startswith(read, at):
                    return name, at + 1, reverse
        return None

    def hits(self, pairs: list[tuple[tuple[str, str], tuple[str, str] | None]]) -> list[list[dict]]:
        out = []
        for pair in pairs:
            reads = [r for r in pair if r is not None]
            places = [self._place(bases) for bases, _ in reads]
            proper = len(places) == 2 and all(places) and places[0][0] == places[1][0] and places[0][2] != places[1][2] and abs(places[0][1] - places[1][1]) <= self.reach
            own = []
            for (bases, quals), place in zip(reads, places, strict=True):
                hit = {"bases": bases, "quals": quals, "mapped": place is not None, "reverse": False, "proper": False, "mapq": 0}
                if place:
                    n = len(bases)
                    hit |= {"contig": place[0], "pos": place[1], "reverse": place[2], "cigar": f"{n}M", "ref_len": n, "mapq": 60, "proper": proper, "mismatches": 0, "score": n, "md": str(n)}
                own.append(hit)
            out.append(own)
        return out


def align(pairs: DataFrame, aligner: Callable[[], PairAligner], batch: int = 10_000) -> DataFrame:
    """id and hits of pairs (id, bases1, quals1, bases2, quals2); ``aligner`` is built once a task and gets at most ``batch`` pairs."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [(n, kinds[t]) for n, t in (field.split(" ") for field in HIT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner()
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch)
                bases1, quals1, bases2, quals2 = (part.column(k).to_pylist() for k in range(1, 5))
                rows = [((a, b), (c, d) if c is not None else None) for a, b, c, d in zip(bases1, quals1, bases2, quals2, strict=True)]
                full = own.hits(rows)
                flat, starts = [h for found in full for h in found], [0]
                for found in full:
                    starts.append(starts[-1] + len(found))
                made = {"read": [k for found in full for k in range(1, len(found) + 1)], "paired": [len(found) == 2 for found in full for _ in found]}
                columns = [pa.array(made[n] if n in made else [h.get(n) for h in flat], t) for n, t in fields]
                hits = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in fields]))
                yield pa.RecordBatch.from_arrays([part.column(0), hits], ["id", "hits"])

    return pairs.select("id", "bases1", "quals1", "bases2", "quals2").mapInArrow(run, SCHEMA)


NAMES = [field.split(" ")[0] for field in HIT.split(", ")]


def chain(*links: Link) -> Link:
    """One step of several: each link's rows are the next one's."""
    return lambda df: reduce(lambda rows, link: link(rows), links, df)


def good_hits(min_mapq: int = 0, remove_unmapped: bool = True) -> Link:
    """A link that drops hits below a quality, and those that are not mapped; a hit that lost its mate is no longer proper."""

    def link(found: DataFrame) -> DataFrame:
        ok = lambda h: (h["mapped"] | F.lit(not remove_unmapped)) & (h["mapq"] >= min_mapq)
        kept = found.withColumns({"hits": F.filter("hits", ok), "lost": F.size(F.filter("hits", ok)) < F.size("hits")}).where(F.size("hits") > 0)
        alone = F.transform("hits", lambda h: h.withField("proper", h["proper"] & ~F.col("lost")))
        return kept.withColumn("hits", alone).drop("lost")

    return link


def _with_ends(found: DataFrame) -> DataFrame:
    """``found`` (id, hits) with name, the untrimmed ends (ref, pos, rev) of both hits, and the score by which pairs compete."""
    ends = found
    for k in (1, 2):
        hit = F.get("hits", F.lit(k - 1))
        ends = ends.withColumns({f"m{k}": hit["mapped"], f"ops{k}": F.when(hit["mapped"], hit["cigar"])})
        ends = ends.withColumn(f"ops{k}", F.when(F.col(f"m{k}"), R.cigar_ops(f"ops{k}"))).withColumn(f"p{k}", hit["pos"])
        five = F.when(hit["reverse"], R.untrimmed_right(f"ops{k}", f"p{k}")).otherwise(R.untrimmed_left(f"ops{k}", f"p{k}"))
        ends = ends.withColumns({f"ref{k}": F.when(F.col(f"m{k}"), hit["contig"]), f"pos{k}": F.when(F.col(f"m{k}"), five), f"rev{k}": F.when(F.col(f"m{k}"), hit["reverse"])})
    total = F.aggregate(F.transform("hits", lambda h: F.aggregate(R.quality_array_of(h["quals"]), F.lit(0), lambda t, q: t + F.when(q >= 15, q).otherwise(0))), F.lit(0), lambda t, x: t + x)
    return ends.select("id", "hits", F.col("id").alias("name"), *(f"{c}{k}" for k in (1, 2) for c in ("ref", "pos", "rev")), total.cast("long").alias("score"))


def duplicates(discard: bool = False) -> Link:
    """A link that adds ``duplicate``: whether a better pair has the same untrimmed ends; or drops these.

    Hits are written to the shared folder with their ends and read again, so pairs are aligned once, and whole rows
    need not be brought together by their ends.
    """

    def link(found: DataFrame) -> DataFrame:
        from fragmill.sources import formats

        path = formats.shared_folder(found.sparkSession)
        _with_ends(found).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
        return A.mark_duplicates(found.sparkSession.read.parquet(path), discard, row="row").select("id", "hits", "duplicate")

    return link


def _attributes(h: Column) -> Column:
    """JSON of the aligner's tags; of an unmapped read none."""
    return F.when(h["mapped"], F.to_json(F.struct(h["score"].alias("AS"), h["mismatches"].alias("NM"))))


def _record(h: Column) -> dict[str, Column]:
    """Fields of one hit that fragments and flat rows share: places from 0, the end inclusive, the read as on the contig's strand."""
    turned = h["mapped"] & h["reverse"]
    return {
        "readMapped": h["mapped"],
        "contig": F.when(h["mapped"], h["contig"]),
        "start": F.when(h["mapped"], h["pos"] - 1),
        "end": F.when(h["mapped"], h["pos"] + h["ref_len"] - 2),
        "mapq": F.when(h["mapped"], h["mapq"]),
        "cigar": F.when(h["mapped"], h["cigar"]),
        "properPair": h["proper"],
        "readNegativeStrand": turned,
        "mismatchingPositions": F.when(h["mapped"], h["md"]),
        "attributes": _attributes(h),
        "secondaryAlignment": F.lit(False),
        "sequence": F.when(turned, R.reverse_complement(h["bases"])).otherwise(h["bases"]),
        "qual": F.when(turned, F.reverse(h["quals"])).otherwise(h["quals"]),
    }


def _checked(found: DataFrame) -> DataFrame:
    return found.withColumn("hits", F.when(F.size("hits") <= 2, F.col("hits")).otherwise(F.raise_error(F.lit("more than two reads in a fragment"))))


def to_fragments(found: DataFrame) -> DataFrame:
    """Fragments of aligned pairs: readName, inferredInsertSize, sequences as sequenced, and alignments."""
    found = _checked(found)
    fields = lambda h: F.struct(h["read"].alias("readNum"), h["paired"].alias("readPaired"), F.lit(True).alias("primaryAlignment"), *(c.alias(n) for n, c in _record(h).items()))
    sequences = F.transform("hits", lambda h: F.struct(h["bases"].alias("bases"), h["quals"].alias("qualities")))
    a, b = F.get("hits", F.lit(0)), F.get("hits", F.lit(1))
    five = lambda h: F.when(h["reverse"], h["pos"] + h["ref_len"] - 2).otherwise(h["pos"] - 1)
    d = five(b) - five(a)
    size = F.when(a["mapped"] & b["mapped"] & (a["contig"] == b["contig"]), F.when(d >= 0, d + 1).otherwise(d - 1))
    kept = ["duplicate"] if "duplicate" in found.columns else []
    return found.select(F.col("id").alias("readName"), size.alias("inferredInsertSize"), sequences.alias("sequences"), F.transform("hits", fields).alias("alignments"), *kept)


def to_flat(found: DataFrame) -> DataFrame:
    """One flat record a read; its mate's place comes from the same row. ``mateLost`` tells that a link dropped the mate."""
    kept = ["duplicate"] if "duplicate" in found.columns else []
    rows = _checked(found).select("id", F.col("hits").alias("all"), F.posexplode("hits").alias("k", "h"), *kept)
    both, paired = F.size("all") == 2, F.col("h.paired")
    mate = F.get("all", 1 - F.col("k"))
    known = F.coalesce(both & mate["mapped"], F.lit(False))
    extra = [F.col("duplicate").alias("duplicateRead"), F.lit(False).alias("failedVendorQualityChecks")] if kept else []
    return rows.select(
        F.col("id").alias("readName"), paired.alias("readPaired"), (paired & (F.col("h.read") == 1)).alias("firstOfPair"), (paired & (F.col("h.read") == 2)).alias("secondOfPair"), (paired & ~both).alias("mateLost"),
        *(c.alias(n) for n, c in _record(F.col("h")).items()), known.alias("mateMapped"), (known & mate["reverse"]).alias("mateNegativeStrand"), F.when(known, mate["contig"]).alias("mateContig"),
        F.when(known, mate["pos"] - 1).alias("mateStart"), F.when(known, mate["pos"] + mate["ref_len"] - 2).alias("mateEnd"), *extra,
    )


def to_sam(found: DataFrame) -> DataFrame:
    """SAM columns and tags_text; with ``duplicate``, its flag bit too."""
    return A.flat_to_sam(to_flat(found), duplicates="duplicate" in found.columns)


def sam_text() -> Column:
    """The line of SAM columns with tags_text."""
    columns = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    return F.concat_ws("\t", *(F.col(c).cast("string") for c in columns), F.nullif("tags_text", F.lit("")))


def seqal(pairs: DataFrame, aligner: Callable[[], PairAligner], min_mapq: int = 1, remove_unmapped: bool = True, mark: bool = True, discard: bool = False) -> DataFrame:
    """Hits of pairs, without bad ones, duplicates marked or dropped; ``mark=False`` only aligns and filters."""
    links = [good_hits(min_mapq, remove_unmapped), *([duplicates(discard)] if mark else [])]
    return chain(*links)(align(pairs, aligner))


def counters(found: DataFrame) -> DataFrame:
    """(name, value): pairs, reads, mapped and proper reads, and duplicate pairs and lone reads of hits with ``duplicate``."""
    n = F.size("hits")
    of = lambda field: F.sum(F.size(F.filter("hits", lambda h: h[field])))
    total = found.agg(
        F.count_if(n == 2).alias("pairs"), F.sum(n).alias("reads"), of("mapped").alias("mapped reads"), of("proper").alias("proper reads"),
        F.count_if(F.col("duplicate") & (n == 2)).alias("duplicate pairs"), F.count_if(F.col("duplicate") & (n == 1)).alias("duplicate fragments"),
    )
    return total.unpivot([], total.columns, "name", "value").select("name", F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value"))


class Monitor:
    """Counts of rows as they pass, by Spark's own observation: read once an action has run over the observed rows."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def count(self, df: DataFrame, name: str, **values: Column) -> DataFrame:
        """``df``, observed under ``name``: its rows, and any further aggregates."""
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in values.items()))

    def read(self, name: str) -> dict[str, object]:
        return self._seen[name].get


# -- variants placed by their flanks ---------------------------------------------------------------------------------


def snp_pairs(masks: DataFrame) -> DataFrame:
    """Pairs of each variant (vid, mask such as ``ACG[A/G]TTC``): for either allele the flanked sequence and its reverse complement."""
    pattern = r"^([ACGTN]*)\[([ACGTN-]*)/([ACGTN-]*)\]([ACGTN]*)$"
    part = lambda k: F.regexp_extract("mask", pattern, k)
    good = F.when(F.col("mask").rlike(pattern), F.col("vid")).otherwise(F.raise_error(F.concat(F.lit("bad mask "), F.col("mask"))))
    alleles = F.array(*(F.struct(F.lit(n).alias("allele"), F.concat(part(1), F.regexp_replace(part(k), "-", ""), part(4)).alias("s")) for n, k in (("A", 2), ("B", 3))))
    rows = masks.select(good.alias("vid"), F.explode(alleles).alias("a"))
    quals = F.repeat(F.lit("I"), F.length("a.s"))
    return rows.select(F.concat_ws("-", "vid", "a.allele").alias("id"), F.col("a.s").alias("bases1"), quals.alias("quals1"), R.reverse_complement("a.s").alias("bases2"), quals.alias("quals2"))


def snp_places(masks: DataFrame, found: DataFrame, genome: str) -> DataFrame:
    """vid, ref_genome, chromosome, pos, strand, allele and copies of perfect, unambiguous hits; one row of zeros for a variant without."""
    h = F.col("hits")[0]
    name = F.regexp_extract("id", "^(.*)-([AB])$", 1)
    ok = h["mapped"] & (h["mismatches"] <= 0) & (h["mapq"] > 0)
    middle = h["pos"] + F.floor((F.length(h["bases"]) - 1) / 2)
    rows = found.where(ok).select(name.alias("vid"), h["contig"].alias("chromosome"), middle.cast("int").alias("pos"), F.when(h["reverse"], "-").otherwise("+").alias("strand"), F.regexp_extract("id", "-([AB])$", 1).alias("allele"))
    rows = rows.withColumn("copies", F.count("*").over(Window.partitionBy("vid")))
    joined = masks.select("vid").distinct().join(rows, "vid", "left")
    none = {"chromosome": "0", "pos": 0, "strand": "*", "allele": "*", "copies": 0}
    return joined.select("vid", F.lit(genome).alias("ref_genome"), *(F.coalesce(n, F.lit(x)).alias(n) for n, x in none.items()))


# -- the whole way ---------------------------------------------------------------------------------------------------


def workflow(spark: SparkSession, qseq: str | list[str], annotation: str, aligner: Callable[[], PairAligner], output: str, read_groups: list[dict[str, str]] = ()) -> None:
    """From qseq files to one sorted SAM file at ``output``: pairs, alignment, duplicates, order, header."""
    from fragmill.operators import pairing
    from fragmill.sources import formats

    contigs = formats.read_annotation(spark, annotation)
    pairs = pairing.pair(formats.read_qseq(spark, qseq), warn_unpaired=True)
    rows = to_sam(seqal(pairs, aligner))
    ordered = A.coordinate_sort(rows, contigs).select(sam_text().alias("value"))
    A.write_merged(spark, A.header(contigs, "coordinate", read_groups), ordered, output)
