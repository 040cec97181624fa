"""Operators on alignments: duplicates, sorting, filters, conversions, header, comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fragmill.functions import reads as R

UNPLACED = 2**63 - 1
#: Fixed values of the flow-cell sort: lanes, tiles a lane (as the partition stride counts them), reads.
LANES, TILES = 8, 96
CONTIGS_LIMIT = 500_000
#: The best pairs are sent to all tasks up to this many; beyond it they are joined by shuffle.
BEST_LIMIT = 1_000_000


# -- duplicates ------------------------------------------------------------------------------------------------------


def mark_duplicates(pairs: DataFrame, discard: bool = False, row: str | None = None) -> DataFrame:
    """``pairs`` with ``duplicate``: name, ref1, pos1, rev1, ref2, pos2, rev2, score; an end is null if unmapped.

    Complete pairs compete under (ref1, pos1, rev1, ref2, pos2), their ends put in order; lone reads compete under
    their own end and lose to any pair that has an end there. The best score wins, ties by name. Pairs with no mapped
    end pass. If ``row`` names a column that tells rows apart, whenever they are computed, only the best rows are
    searched, in each task first, and looked up by it; else, unless duplicates are dropped, all rows meet by their ends.
    """
    first, second = (F.struct(*(F.col(f"{c}{k}").alias(c) for c in ("ref", "pos", "rev"))) for k in (1, 2))
    has1, has2 = F.col("ref1").isNotNull(), F.col("ref2").isNotNull()
    swap = (has2 & ~has1) | (has1 & has2 & (second < first))
    ends = pairs.withColumns({"end1": F.when(swap, second).otherwise(first), "end2": F.when(swap, first).otherwise(second)})
    kind = F.when(has1 & has2, 2).when(has1 | has2, 1).otherwise(0)
    ends = ends.withColumn("mapped_ends", kind)
    place = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "name"))
    complete = ends.where("mapped_ends = 2").withColumn("place", place("end1", "end2.ref", "end2.pos"))
    touched = ends.where("mapped_ends = 2").select(F.explode(F.array("end1", "end2")).alias("end1")).distinct()
    lone = ends.where("mapped_ends = 1").withColumn("place", place("end1"))
    rest = ends.where("mapped_ends = 0")
    if discard or row:
        best = complete.where("place = 1").select(*pairs.columns).union(lone.where("place = 1").join(touched, "end1", "left_anti").select(*pairs.columns))
        if discard:
            return best.union(rest.select(*pairs.columns)).withColumn("duplicate", F.lit(False))
        best = best.select(row, F.lit(True).alias("best"))
        best = F.broadcast(best) if best.limit(BEST_LIMIT + 1).count() <= BEST_LIMIT else best
        return pairs.join(best, row, "left").withColumn("duplicate", F.col("best").isNull() & (has1 | has2)).select(*pairs.columns, "duplicate")
    complete = complete.withColumn("duplicate", F.col("place") > 1)
    lone = lone.join(touched.withColumn("touched", F.lit(True)), "end1", "left").withColumn("duplicate", (F.col("place") > 1) | F.col("touched").isNotNull())
    rest = rest.withColumn("duplicate", F.lit(False))
    return complete.select(*pairs.columns, "duplicate").union(lone.select(*pairs.columns, "duplicate")).union(rest.select(*pairs.columns, "duplicate"))


# -- sorting ---------------------------------------------------------------------------------------------------------


def sort_lines(lines: DataFrame) -> DataFrame:
    """Lines by their key, in binary order: a range exchange and a sort."""
    return lines.orderBy("key", "value")


def coordinate(sam: DataFrame, contigs: DataFrame) -> DataFrame:
    """``sam`` with ``coord``: the contig's start plus the position, the greatest long where there is no contig.

    Contigs are broadcast up to CONTIGS_LIMIT; an assembly of more is joined by shuffle.
    """
    places = contigs.select(F.col("name").alias("rname"), F.col("start").alias("contig_start"))
    placed = sam.join(F.broadcast(places) if contigs.limit(CONTIGS_LIMIT + 1).count() <= CONTIGS_LIMIT else places, "rname", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown contig "), F.col("rname"))).cast("long")
    at = F.when(F.coalesce("rname", F.lit("*")) == "*", F.lit(UNPLACED)).when(F.col("contig_start").isNull(), unknown).otherwise(F.col("contig_start") + F.col("pos"))
    return placed.withColumn("coord", at).drop("contig_start").select(*sam.columns, "coord")


def coordinate_sort(sam: DataFrame, contigs: DataFrame) -> DataFrame:
    return coordinate(sam, contigs).orderBy("coord", "qname", "flag")


def coordinate_bucket(coord: str, reference_length: int, partitions: int) -> Column:
    """Fixed-width partition of the genome; the last one holds what isn't placed."""
    width = max(1, -(-reference_length // max(1, partitions - 1)))
    c = F.col(coord)
    return F.when(c == UNPLACED, partitions - 1).when(c > reference_length, F.raise_error(F.lit("coordinate beyond the reference")).cast("int")).otherwise(F.floor(c / width)).cast("int")


def flowcell_partition() -> Column:
    """The literal partition of a read: lane stride, tile slot, read 1 odd and read 2 even."""
    tile = F.col("tile")
    slot = F.floor(tile / 1000 - 1) * 48 + F.floor(tile / 100 % 10 - 1) * 16 + tile % 100 - 1
    return ((F.col("lane") - 1) * TILES + 2 * slot + F.col("read") - 1).cast("int")


def flowcell_sort(reads: DataFrame) -> DataFrame:
    return reads.orderBy("lane", "tile", "read", "xpos", "ypos")


# -- filters and conversions -----------------------------------------------------------------------------------------


def remove_mate(flag: str = "flag") -> Column:
    """The flag of a read whose mate went: neither proper nor with a mate's bits."""
    return F.col(flag).bitwiseAND(F.lit(0x7FF & ~(R.PROPER | R.MATE_UNMAPPED | R.MATE_REVERSE)))


def filter_hits(pairs: DataFrame, min_mapq: int = 0, remove_unmapped: bool = True) -> DataFrame:
    """name, flag1, mapq1, flag2, mapq2 of pairs with a read left; a lost read is null and its mate forgets it."""
    gone = lambda k: F.col(f"flag{k}").isNull() | (F.lit(remove_unmapped) & R.has(f"flag{k}", R.UNMAPPED)) | (F.col(f"mapq{k}") < min_mapq)
    df = pairs.withColumns({"gone1": F.coalesce(gone(1), F.lit(True)), "gone2": F.coalesce(gone(2), F.lit(True))}).where("not (gone1 and gone2)")
    left = lambda k, o: F.when(~F.col(f"gone{k}"), F.when(F.col(f"gone{o}"), remove_mate(f"flag{k}")).otherwise(F.col(f"flag{k}")))
    return df.select("name", left(1, 2).alias("flag1"), F.when(~F.col("gone1"), F.col("mapq1")).alias("mapq1"), left(2, 1).alias("flag2"), F.when(~F.col("gone2"), F.col("mapq2")).alias("mapq2"))


def sam_flag(duplicates: bool = False) -> Column:
    """Flag bits of a flat alignment record; 0x400 and 0x200 only if asked for."""
    bits = {"readPaired": R.PAIRED, "properPair": R.PROPER, "mateNegativeStrand": R.MATE_REVERSE, "readNegativeStrand": R.REVERSE, "firstOfPair": R.FIRST, "secondOfPair": R.SECOND, "secondaryAlignment": R.SECONDARY}
    flag = sum((F.when(F.col(c), b).otherwise(0) for c, b in bits.items()), F.lit(0))
    flag = flag + F.when(F.col("readMapped"), 0).otherwise(R.UNMAPPED) + F.when(F.col("readPaired") & ~F.col("mateMapped"), R.MATE_UNMAPPED).otherwise(0)
    if duplicates:
        flag = flag + F.when(F.col("duplicateRead"), R.DUPLICATE).otherwise(0) + F.when(F.col("failedVendorQualityChecks"), R.FAILED_QC).otherwise(0)
    return flag.cast("int")


def insert_size(pos: str, end: str, reverse: str, contig: str, mate_pos: str, mate_end: str, mate_reverse: str, mate_contig: str) -> Column:
    """Distance of the 5' ends, one more or less by direction; 0 on different contigs."""
    here = F.when(F.col(reverse), F.col(end)).otherwise(F.col(pos))
    there = F.when(F.col(mate_reverse), F.col(mate_end)).otherwise(F.col(mate_pos))
    d = there - here
    return F.when(F.col(contig) == F.col(mate_contig), F.when(d >= 0, d + 1).otherwise(d - 1)).otherwise(0)


def attribute_text(attributes: str) -> Column:
    """JSON attributes as sorted SAM tags: integers i, decimals f, one character A, else Z."""
    kind = "case when v rlike '^-?[0-9]+$' then 'i' when v rlike '^-?[0-9]*\\\\.[0-9]+([eE][-+]?[0-9]+)?$' then 'f' when length(v) = 1 then 'A' else 'Z' end"
    entries = f"transform(array_sort(map_entries(from_json({attributes}, 'map<string,string>'))), e -> concat(e.key, ':', transform(array(e.value), v -> {kind})[0], ':', e.value))"
    return F.expr(f"array_join({entries}, '\\t')")


def flat_to_sam(records: DataFrame, duplicates: bool = False) -> DataFrame:
    """SAM columns of flat alignment records (0-based starts); sequence and quality only on primary alignments.

    A record with ``mateLost`` has no bit of its mate left.
    """
    primary = ~F.coalesce("secondaryAlignment", F.lit(False))
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    mapped, mate = F.col("readMapped"), F.col("mateMapped")
    rnext = F.when(~mate | F.col("mateContig").isNull(), "*").when(F.col("mateContig") == F.col("contig"), "=").otherwise(F.col("mateContig"))
    flag = sam_flag(duplicates)
    if "mateLost" in records.columns:
        flag = F.when(F.col("mateLost"), flag.bitwiseAND(F.lit(0x7FF & ~(R.PROPER | R.MATE_UNMAPPED | R.MATE_REVERSE)))).otherwise(flag)
    tags = F.concat_ws("\t", F.when(F.col("mismatchingPositions").isNotNull(), F.concat(F.lit("MD:Z:"), "mismatchingPositions")), F.nullif(attribute_text("attributes"), F.lit("")))
    return records.select(
        F.regexp_replace("readName", "/[0-9]$", "").alias("qname"), flag.alias("flag"), F.when(mapped, star("contig")).otherwise("*").alias("rname"),
        F.when(mapped, F.col("start") + 1).otherwise(0).alias("pos"), F.coalesce("mapq", F.lit(0)).alias("mapq"), star("cigar").alias("cigar"), rnext.alias("rnext"),
        F.when(mate, F.col("mateStart") + 1).otherwise(0).alias("pnext"),
        F.when(mapped & mate, insert_size("start", "end", "readNegativeStrand", "contig", "mateStart", "mateEnd", "mateNegativeStrand", "mateContig")).otherwise(0).alias("tlen"),
        F.when(primary, star("sequence")).otherwise("*").alias("seq"), F.when(primary, star("qual")).otherwise("*").alias("qual"), tags.alias("tags_text"),
    )


def fragment_to_flat(fragments: DataFrame) -> DataFrame:
    """One flat record an alignment of each fragment; each read's mate is the next read's alignment, the last one's the first."""
    check = F.when(F.size("alignments") > 0, F.col("alignments")).otherwise(F.raise_error(F.lit("fragment without alignments")))
    rows = fragments.select("readName", check.alias("all"), F.posexplode(check).alias("k", "a"))
    mate = F.expr("all[(k + 1) % size(all)]")
    names = ["readNum", "contig", "start", "end", "mapq", "cigar", "readMapped", "readNegativeStrand", "properPair", "secondaryAlignment", "sequence", "qual", "mismatchingPositions", "attributes"]
    pair = F.size("all") > 1
    return rows.select(
        "readName", pair.alias("readPaired"), *(F.col(f"a.{n}").alias(n) for n in names if n != "readNum"), (pair & (F.col("a.readNum") == 1)).alias("firstOfPair"), (pair & (F.col("a.readNum") == 2)).alias("secondOfPair"),
        (pair & mate["readMapped"]).alias("mateMapped"), (pair & mate["readNegativeStrand"]).alias("mateNegativeStrand"), F.when(pair, mate["contig"]).alias("mateContig"), F.when(pair, mate["start"]).alias("mateStart"), F.when(pair, mate["end"]).alias("mateEnd"),
    )


def header(contigs: DataFrame, sort_order: str = "coordinate", read_groups: list[dict[str, str]] = (), assembly: str | None = None, species: str | None = None) -> str:
    """The text header: @HD, @SQ in contig order (M5 if ``contigs`` has md5), @RG, @PG. Contigs are few."""
    lines = [f"@HD\tVN:1.0\tSO:{sort_order}"]
    for r in contigs.orderBy("id").collect():
        extra = [f"AS:{assembly}"] * bool(assembly) + ([f"M5:{r['md5']}"] if "md5" in contigs.columns and r["md5"] else []) + [f"SP:{species}"] * bool(species)
        lines.append("\t".join(["@SQ", f"SN:{r['name']}", f"LN:{r['length']}", *extra]))
    for group in read_groups:
        if not {"ID", "SM"} <= set(group):
            raise ValueError("a read group needs ID and SM")
        lines.append("\t".join(["@RG", *(f"{k}:{v}" for k, v in group.items())]))
    return "\n".join([*lines, "@PG\tID:fragmill"]) + "\n"


def write_merged(spark, text: str, lines: DataFrame, path: str) -> None:
    """One SAM file at ``path``: the header ``text``, then ``lines`` (value) in their order. Parts are written beside it first, compressed in haste."""
    from fragmill.sources import formats

    parts = f"{path}.parts"
    lines.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(parts)
    formats.write_text(spark, f"{parts}/part-", text)
    formats.concatenate(spark, parts, path, plain=True)
    fs, folder = formats._file_system(spark, parts)
    fs.delete(folder, True)


def full_order(df: DataFrame) -> DataFrame:
    """Rows in the order of all their columns."""
    return df.orderBy(*df.columns)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reads that two aligners place differently: qname, read_num and both (rname, pos, flag), by all columns."""
    side = lambda df, s: df.select("qname", "read_num", *(F.col(c).alias(f"{c}_{s}") for c in ("rname", "pos", "flag")))
    joined = side(a, "a").join(side(b, "b"), ["qname", "read_num"])
    return joined.where("not (rname_a <=> rname_b and pos_a <=> pos_b and flag_a <=> flag_b)")


def on_holes(spans: DataFrame, holes: DataFrame, width: int = 1000) -> DataFrame:
    """``spans`` (start, length, any more) with ``on_hole``: whether it overlaps a hole; one of null start doesn't.

    Both sides are cut into bins of ``width``.
    """
    bins = lambda s, n: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(s) + F.col(n) - 1) / width)))
    h = holes.select(F.col("start").alias("h_start"), F.col("length").alias("h_length")).withColumn("bin", bins("h_start", "h_length"))
    s = spans.select("start", "length").where("start is not null and length is not null").distinct().withColumn("bin", bins("start", "length"))
    hit = s.join(h, "bin").where("start < h_start + h_length and h_start < start + length").select("start", "length").distinct().withColumn("on_hole", F.lit(True))
    return spans.join(hit, ["start", "length"], "left").select(*(F.col(c) for c in spans.columns), F.coalesce("on_hole", F.lit(False)).alias("on_hole"))


# -- external programs -----------------------------------------------------------------------------------------------


def shell(command: str) -> list[str]:
    """The lines that a program prints; a program that fails raises with its error output."""
    import shlex
    import subprocess

    done = subprocess.run(shlex.split(command), capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{command!r} failed with {done.returncode}: {done.stderr[-2000:]}")
    return done.stdout.splitlines()


def run_commands(commands: DataFrame, runner: Callable[[str], list[str]] = shell) -> DataFrame:
    """Output lines of one command a row (column command); the runner starts the program and raises if it fails.

    A partition's commands run one after the other: a list of one row a partition runs them side by side.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for command in frame["command"]:
                yield pd.DataFrame({"value": runner(command)})

    return commands.mapInPandas(run, "value string")
