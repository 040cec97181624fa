"""Command line: ``python -m fragmill PROGRAM [options] INPUT... OUTPUT``, or by spark-submit."""

from __future__ import annotations

import argparse
import configparser
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill import sources
from fragmill.operators import alignments, demux, hits, pairing, recab
from fragmill.sources import formats, illumina

Options = argparse.Namespace
Program = Callable[[SparkSession, Options], None]
PROGRAMS: dict[str, tuple[Program, Callable[[argparse.ArgumentParser], object]]] = {}
VERSION = "0.1"


def _program(options: Callable[[argparse.ArgumentParser], object] = lambda p: None) -> Callable[[Program], Program]:
    def add(f: Program) -> Program:
        PROGRAMS[f.__name__] = f, options
        return f

    return add


def _reads(spark: SparkSession, o: Options, usual: str) -> DataFrame:
    encoding = {"encoding": o.encoding} if o.encoding else {}
    return sources.read(spark, o.input_format or usual, o.input, **encoding)


def _demux_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--sheet", required=True)
    p.add_argument("--mismatches", type=int, default=0)
    p.add_argument("--no-index", action="store_true")
    p.add_argument("--separate-reads", action="store_true")
    p.add_argument("--drop-failed", action="store_true", help="leave out reads that failed the machine's filter")
    p.add_argument("--create-lane-content", action="store_true", help="a LaneContent file for each sample")


@_program(_demux_options)
def run_demux(spark: SparkSession, o: Options) -> None:
    """Reads, or fragments for bdg, in a folder for each project and sample."""
    sheet = formats.read_sample_sheet(spark, o.sheet)
    found = demux.demultiplex(_reads(spark, o, "qseq"), sheet, o.mismatches, o.no_index, o.separate_reads, drop_failed=o.drop_failed)
    folders = ["project", "sample"]
    if o.output_format == "bdg":
        found = demux.demux_fragments(found)
    elif o.separate_reads:
        found, folders = found.withColumn("read_folder", F.col("read").cast("string")), [*folders, "read_folder"]
    formats.write_by_folder(found, o.output_format or "qseq", o.output, folders, o.compression)
    if o.create_lane_content:
        for name, text in demux.lane_content_files(sheet):
            formats.write_text(spark, f"{o.output}/{name}", text)


def _prq_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--traditional-ids", action="store_true")
    p.add_argument("--num-reads", type=int, default=2, choices=(1, 2))
    p.add_argument("--min-bases", type=int, default=30)
    p.add_argument("--keep-failed", action="store_true")
    p.add_argument("--warn-unpaired", action="store_true")


@_program(_prq_options)
def run_prq(spark: SparkSession, o: Options) -> None:
    """Pairs as text, or as fragments for bdg."""
    pairs = pairing.pair(_reads(spark, o, "qseq"), o.num_reads, o.min_bases, not o.keep_failed, o.warn_unpaired, o.traditional_ids)
    pairs = pairing.prq_fragments(pairs) if o.output_format == "bdg" else pairs
    sources.write(pairs, o.output_format or "prq", o.output, o.compression)


@_program(lambda p: p.add_argument("--annotation", required=True))
def run_read_sort(spark: SparkSession, o: Options) -> None:
    """SAM by reference coordinate; unplaced reads last."""
    contigs = formats.read_annotation(spark, o.annotation)
    sam = alignments.coordinate_sort(sources.read(spark, o.input_format or "sam", o.input), contigs).drop("coord")
    sources.write(sam, "sam", o.output, o.compression)


def _header_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--annotation", required=True)
    p.add_argument("--reference", help="FASTA file, for checksums")
    p.add_argument("--sort-order", default="coordinate", choices=("unknown", "unsorted", "queryname", "coordinate"))
    p.add_argument("--assembly")
    p.add_argument("--species")
    p.add_argument("--read-group", action="append", default=[], metavar="ID=x,SM=y,...")
    p.add_argument("--header-only", action="store_true")


@_program(_header_options)
def run_merge_alignments(spark: SparkSession, o: Options) -> None:
    """One SAM file: the header, then the inputs' rows by coordinate."""
    contigs = formats.read_annotation(spark, o.annotation)
    known = formats.contigs_with_md5(contigs, formats.read_fasta(spark, o.reference)) if o.reference else contigs
    groups = [dict(part.split("=", 1) for part in group.split(",")) for group in o.read_group]
    text = alignments.header(known, o.sort_order, groups, o.assembly, o.species)
    if o.header_only:
        formats.write_text(spark, o.output, text)
        return
    sam = alignments.coordinate_sort(formats.read_sam(spark, o.input), contigs)
    alignments.write_merged(spark, text, sam.select(formats.sam_line().alias("value")), o.output)


def _recab_options(p: argparse.ArgumentParser) -> None:
    sites = p.add_mutually_exclusive_group()
    sites.add_argument("--vcf")
    sites.add_argument("--rod")
    p.add_argument("--snps-only", action="store_true")
    p.add_argument("--smoothing", type=float, default=0.0)
    p.add_argument("--max-quality", type=int, default=40)
    p.add_argument("--default-rg")


@_program(_recab_options)
def run_recab_table(spark: SparkSession, o: Options) -> None:
    """The table as CSV with a heading; a table has a few thousand rows, so one file holds it."""
    sam = sources.read(spark, o.input_format or "sam", o.input).withColumns({"rg": formats.tag("RG"), "md": formats.tag("MD")})
    variants = None
    if o.vcf:
        variants = formats.read_vcf(spark, o.vcf, o.snps_only)
    elif o.rod:
        variants = formats.read_rod(spark, o.rod, o.snps_only)
    table = recab.table(sam, variants, o.smoothing, o.max_quality, o.default_rg)
    recab.write_csv(table, o.output)


@_program()
def run_fetch_recab(spark: SparkSession, o: Options) -> None:
    """One CSV file of a table's parts, with one heading."""
    rows = spark.read.option("header", True).csv(o.input)
    recab.write_csv(rows, o.output)


def _sort_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--key", default="", help="columns, such as 1,3-5; the whole line if empty")
    p.add_argument("--delimiter", default="\t")


@_program(_sort_options)
def run_tsvsort(spark: SparkSession, o: Options) -> None:
    lines = formats.read_tsv(spark, o.input, o.key, o.delimiter)
    sorted_ = alignments.sort_lines(lines).select("value").write
    (sorted_.option("compression", o.compression) if o.compression else sorted_).text(o.output)


@_program()
def run_usort(spark: SparkSession, o: Options) -> None:
    """Reads by lane, tile, read and place on the flow cell."""
    sources.write(alignments.flowcell_sort(_reads(spark, o, "qseq")), o.output_format or "qseq", o.output, o.compression)


def _sam_lines(rows: DataFrame, o: Options) -> None:
    lines = rows.select(hits.sam_text().alias("value")).write
    (lines.option("compression", {"auto": "gzip"}.get(o.compression, o.compression)) if o.compression else lines).text(o.output)


@_program()
def run_bdg2sam(spark: SparkSession, o: Options) -> None:
    """SAM text of aligned fragments."""
    _sam_lines(alignments.flat_to_sam(alignments.fragment_to_flat(sources.read(spark, "bdg", o.input))), o)


@_program()
def run_avo2sam(spark: SparkSession, o: Options) -> None:
    """SAM text of flat alignment records."""
    _sam_lines(alignments.flat_to_sam(sources.read(spark, "avo", o.input)), o)


@_program()
def run_qseq2bdg(spark: SparkSession, o: Options) -> None:
    """Fragments of reads."""
    sources.write(pairing.fragments(_reads(spark, o, "qseq")), "bdg", o.output, o.compression)


@_program()
def run_bdg2qseq(spark: SparkSession, o: Options) -> None:
    """Reads of fragments."""
    sources.write(pairing.fragment_reads(sources.read(spark, "bdg", o.input)), "qseq", o.output, o.compression)


@_program()
def run_prq2bdg(spark: SparkSession, o: Options) -> None:
    """Fragments of pairs."""
    sources.write(pairing.prq_fragments(sources.read(spark, "prq", o.input)), "bdg", o.output, o.compression)


@_program()
def run_prq2fastq(spark: SparkSession, o: Options) -> None:
    """Two folders of fastq, one for each read of the pairs."""
    formats.write_pair_fastq(sources.read(spark, "prq", o.input), f"{o.output}/1", f"{o.output}/2", o.compression)


def _seqal_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--reference", required=True, help="FASTA file")
    p.add_argument("--aligner", default="fragmill.operators.hits:ExactAligner", help="module:class, made from a dictionary of contigs' sequences")
    p.add_argument("--min-mapq", type=int, default=1)
    p.add_argument("--keep-unmapped", action="store_true")
    p.add_argument("--align-only", action="store_true", help="no duplicates are looked for")
    p.add_argument("--discard-duplicates", action="store_true")


@_program(_seqal_options)
def run_seqal(spark: SparkSession, o: Options) -> None:
    """Aligned pairs, duplicates marked, as SAM text, fragments (bdg) or flat records (avo)."""
    import importlib

    module, _, name = o.aligner.partition(":")
    make = getattr(importlib.import_module(module), name)
    contigs = {r["name"]: r["sequence"] for r in formats.read_fasta(spark, o.reference).collect()}
    found = hits.seqal(sources.read(spark, o.input_format or "prq", o.input), lambda: make(contigs), o.min_mapq, not o.keep_unmapped, not o.align_only, o.discard_duplicates)
    if o.output_format in ("bdg", "avo"):
        sources.write(hits.to_fragments(found) if o.output_format == "bdg" else hits.to_flat(found), o.output_format, o.output, o.compression)
    else:
        _sam_lines(hits.to_sam(found), o)


def _bcl_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--command", default="bclToQseq", help="the converter; it prints a tile's lines")
    p.add_argument("--options", default="", help="further options of the converter")
    p.add_argument("--any-state", action="store_true", help="also a run that isn't finished")


@_program(_bcl_options)
def run_bcl2qseq(spark: SparkSession, o: Options) -> None:
    """Runs a converter for every tile of a run directory, a task a tile."""
    directory = o.input[0]
    if not (o.any_state or illumina.is_finished(spark, directory)):
        raise SystemExit(f"the run in {directory} isn't finished")
    work = illumina.work_list(spark, directory, illumina.read_run(spark, directory), o.command, o.options)
    alignments.run_commands(work).write.text(o.output)


@_program()
def run_convert(spark: SparkSession, o: Options) -> None:
    """Rows of one format written in another that takes the same columns."""
    if not (o.input_format and o.output_format):
        raise SystemExit("convert needs --input-format and --output-format")
    sources.write(_reads(spark, o, o.input_format), o.output_format, o.output, o.compression)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("fragmill")
    top.add_argument("--version", action="version", version=VERSION)
    programs = top.add_subparsers(dest="program", required=True)
    for name, (f, options) in PROGRAMS.items():
        p = programs.add_parser(name.removeprefix("run_"), help=f.__doc__)
        p.add_argument("--config", help="INI file; options of the program's section and of DEFAULT, by their long names")
        p.add_argument("--input-format")
        p.add_argument("--output-format")
        p.add_argument("--encoding", choices=("sanger", "illumina"))
        p.add_argument("--compression", choices=("gzip", "bzip2", "snappy", "auto"))
        p.add_argument("--num-reducers", type=int, help="partitions of a shuffle")
        p.add_argument("-D", action="append", default=[], metavar="KEY=VALUE", dest="settings", help="a setting of the session")
        options(p)
        p.add_argument("input", nargs="+")
        p.add_argument("output")
        p.set_defaults(run=f)
    return top


def _configured(arguments: Sequence[str]) -> list[str]:
    """``arguments`` with those of the configuration file before them, so that the command line wins."""
    arguments = list(arguments)
    if "--config" not in arguments:
        return arguments
    config = configparser.ConfigParser(comment_prefixes=("#", ";"))
    with open(arguments[arguments.index("--config") + 1], encoding="utf-8") as file:
        config.read_file(file)
    section = config[arguments[0]] if config.has_section(arguments[0]) else config["DEFAULT"]
    extra = [x for k, v in section.items() for x in ([f"--{k}"] if v.lower() == "true" else [] if v.lower() == "false" else [f"--{k}", v])]
    return [arguments[0], *extra, *arguments[1:]]


def main(arguments: Sequence[str], spark: SparkSession | None = None) -> None:
    o = parser().parse_args(_configured(arguments))
    session = spark or SparkSession.builder.appName(f"fragmill {o.program}").getOrCreate()
    settings = dict(x.split("=", 1) for x in o.settings)
    if o.num_reducers:
        settings["spark.sql.shuffle.partitions"] = str(o.num_reducers)
    before = {k: session.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            session.conf.set(key, value)
        o.run(session, o)
    finally:
        for key, value in before.items():
            session.conf.unset(key) if value is None else session.conf.set(key, value)


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
