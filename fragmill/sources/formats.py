"""Formats: qseq, fastq, prq, sam, fragment Parquet, TSV, VCF, ROD, reference annotations, FASTA, sample sheets.

Text formats are parsed by ``spark.read.text`` and column expressions, so compressed input is transparent, columns are
pruned and no Python runs per row. A malformed line raises, with the file and block it is in, unless
``mode="quarantine"`` drops it.
"""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fragmill.functions import reads as R

READ = ["instrument", "run_number", "flowcell_id", "lane", "tile", "xpos", "ypos", "index_seq", "read", "bases", "quals", "filter_passed", "read_id"]
SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
#: Fixed value: columns of a sample sheet.
SHEET = ["fcid", "lane", "sampleid", "sampleref", "index", "description", "control", "recipe", "operator", "sampleproject"]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value and ``at``, the line's file and the place at which its block begins."""
    block = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string"))
    return spark.read.text(path).where("value != ''").select("value", block.alias("at"))


def _checked(df: DataFrame, good: Column, what: str, mode: str) -> DataFrame:
    if mode == "quarantine":
        return df.where(good)
    return df.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(_bad(df, what))))


def _bad(df: DataFrame, what: str) -> Column:
    where = [F.lit(" in block "), F.col("at")] if "at" in df.columns else []
    return F.concat(F.lit(f"bad {what} line"), *where, F.lit(": "), F.col("value"))


def read_qseq(spark: SparkSession, path: str | list[str], encoding: str = "illumina", mode: str = "fail") -> DataFrame:
    """READ rows of qseq lines: exactly 11 columns, ``.`` becomes N, qualities become Phred+33."""
    df = _checked(_lines(spark, path), F.size(F.split("value", "\t")) == 11, "qseq", mode).select(F.split("value", "\t").alias("c"))
    c = [F.col("c")[k] for k in range(11)]
    quals = R.reencode(c[9]) if encoding == "illumina" else c[9]
    columns = [c[0], c[1].cast("int"), F.lit(None).cast("string"), *(c[k].cast("int") for k in range(2, 6)), F.nullif(c[6], F.lit("0")), c[7].cast("int"), F.translate(c[8], ".", "N"), quals, c[10] == "1", F.lit(None).cast("string")]
    return df.select(*(x.alias(n) for x, n in zip(columns, READ, strict=True)))


def _fastq_records(spark: SparkSession, path: str | list[str], mode: str) -> DataFrame:
    """id, bases and quals of four-line records, without a shuffle of whole records.

    The file is read in pieces that end before a line which begins with @, so files are split like any text. Where that
    line is one of qualities, a record comes as two pieces, of three lines and one; only these are brought together, by
    their place. Pieces are told apart by their number of lines, so each is parsed once.
    """
    pieces = spark.read.option("lineSep", "\n@").text(path).select(
        F.replace("value", F.lit("\r"), F.lit("")).alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )
    # the last piece of a file keeps its line's end, the first its @
    pieces = pieces.withColumn("value", F.when(F.col("value").endswith("\n"), F.regexp_replace("value", r"\n?$", "")).otherwise(F.col("value")))
    first = (F.col("block") == 0) & F.col("value").startswith("@") & F.col("value").contains("\n")
    pieces = pieces.withColumn("value", F.when(first, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))).where("value != ''")
    ends = F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))
    body = F.get("c", F.lit(1)).rlike(r"^[A-Za-z.*]*$") & F.get("c", F.lit(2)).startswith("+")
    fault = lambda text: F.raise_error(F.concat(F.lit("bad fastq record in "), F.col("file"), F.lit(": "), text))
    one = lambda quals: (F.get("c", F.lit(0)).alias("id"), F.get("c", F.lit(1)).alias("bases"), quals.alias("quals"))
    split = lambda df: df.withColumn("c", F.split("value", "\n", -1))
    good = F.coalesce((F.size("c") == 4) & body & (F.length(F.get("c", F.lit(1))) == F.length(F.get("c", F.lit(3)))), F.lit(False))
    whole = split(pieces.where(ends.isin(0, 2) == F.lit(False)))
    whole = whole.where(good) if mode == "quarantine" else whole
    whole = whole.select(*one(F.get("c", F.lit(3)) if mode == "quarantine" else F.when(good, F.get("c", F.lit(3))).otherwise(fault(F.col("value")))))
    # a head's tail is the next piece of its block, or the first of a later block of its file
    halves = pieces.where(ends.isin(0, 2)).withColumn("head", ends == 2)
    sides = [F.max(F.when(F.col("head") == side, F.col("value"))).alias(n) for n, side in (("value", True), ("rest", False))]
    met = halves.groupBy("file", "block", (F.col("place") - F.when(F.col("head"), 0).otherwise(1)).alias("place")).agg(*sides)
    if mode == "quarantine":
        met = split(met).withColumn("value", F.when(body, F.col("value"))).drop("c").where("value is not null or rest is not null")
    beside = met.where("value is not null and rest is not null")
    by_file = Window.partitionBy("file").orderBy("block", "place")
    apart = met.where("value is null or rest is null").withColumns({"after": F.lead("rest").over(by_file), "before": F.lag("value").over(by_file)})
    joined = beside.select("file", "value", "rest").union(apart.where("value is not null or before is null").select("file", "value", F.when(F.col("value").isNotNull(), F.col("after")).otherwise(F.col("rest")).alias("rest")))
    quals = F.concat(F.lit("@"), "rest")
    fits = F.coalesce(body & (F.length(quals) == F.length(F.get("c", F.lit(1)))), F.lit(False))
    joined = split(joined)
    joined = joined.where(fits) if mode == "quarantine" else joined
    return whole.union(joined.select(*one(F.when(fits, quals).otherwise(fault(F.coalesce("value", "rest"))))))


def read_fastq(spark: SparkSession, path: str | list[str], encoding: str = "sanger", mode: str = "fail") -> DataFrame:
    """READ rows of four-line records, with metadata ids or ids that end in /1 or /2.

    A record that lacks a line, has other than letters for bases, no + line or qualities of another length raises, or is
    dropped with ``mode="quarantine"``.
    """
    df = _fastq_records(spark, path, mode)
    meta = r"^([^:\s]+):(\d+):([^:\s]*):(\d+):(\d+):(-?\d+):(-?\d+)(?:\s+(\d):([YN]):(\d*):([ACGTNacgtn]*))?$"
    # one match a record: the fields of an id that fits lie between colons and white space
    df = df.withColumn("m", F.when(F.col("id").rlike(meta), F.split("id", r":|\s+", -1)))
    m = [F.nullif(F.get("m", F.lit(k)), F.lit("")) for k in range(11)]
    plain = F.when(F.col("id").endswith("/1"), 1).when(F.col("id").endswith("/2"), 2)
    quals = R.reencode("quals") if encoding == "illumina" else F.col("quals")
    columns = [m[0], m[1].cast("int"), m[2], *(m[k].cast("int") for k in range(3, 7)), m[10], F.coalesce(m[7].cast("int"), plain), F.translate(F.upper("bases"), ".", "N"), quals, m[8] == "N", F.col("id")]
    return df.select(*(x.alias(n) for x, n in zip(columns, READ, strict=True)))


def read_interleaved_qseq(spark: SparkSession, path: str | list[str], reads: int = 2, encoding: str = "illumina") -> DataFrame:
    """location and sequences (bases, qualities, in read order) of files that hold all reads of a cluster, in any order.

    Read numbers other than 1 to ``reads`` raise, as two reads of one number do; clusters that lack a read are left out.
    """
    if reads not in (1, 2, 3):
        raise ValueError("reads must be 1, 2 or 3")
    df = read_qseq(spark, path, encoding)
    at = F.concat_ws(":", "instrument", "run_number", "lane", "tile", "xpos", "ypos")
    number = F.when(F.col("read").between(1, reads), F.col("read")).otherwise(F.raise_error(F.concat(F.lit("unexpected read number "), F.col("read"))))
    grouped = df.groupBy(at.alias("location")).agg(F.sort_array(F.collect_list(F.struct(number.alias("read"), "bases", F.col("quals").alias("qualities")))).alias("s"))
    twice = F.size(F.array_distinct(F.transform("s", lambda x: x["read"]))) < F.size("s")
    s = F.when(twice, F.raise_error(F.concat(F.lit("a read number comes twice at "), F.col("location")))).otherwise(F.col("s"))
    return grouped.withColumn("s", s).where(F.size("s") == reads).select("location", F.transform("s", lambda x: F.struct(x["bases"].alias("bases"), x["qualities"].alias("qualities"))).alias("sequences"))


def read_multi_qseq(spark: SparkSession, paths: list[str], encoding: str = "illumina") -> DataFrame:
    """location and sequences of clusters that are in every one of ``paths``, a file (or folder) for each read, in their order."""
    at = F.concat_ws(":", "instrument", "run_number", "lane", "tile", "xpos", "ypos").alias("location")
    joined = None
    for k, path in enumerate(paths):
        one = read_qseq(spark, path, encoding).select(at, F.struct("bases", F.col("quals").alias("qualities")).alias(f"s{k}"))
        joined = one if joined is None else joined.join(one, "location")
    return joined.select("location", F.array(*(f"s{k}" for k in range(len(paths)))).alias("sequences"))


def read_prq(spark: SparkSession, path: str | list[str], mode: str = "fail") -> DataFrame:
    """id, bases1, quals1, bases2, quals2; an absent mate is two empty columns, read as null."""
    df = _checked(_lines(spark, path), F.size(F.split("value", "\t", -1)) == 5, "prq", mode)
    names = ["id", "bases1", "quals1", "bases2", "quals2"]
    return df.select(F.split("value", "\t", -1).alias("c")).select(*(F.nullif(F.col("c")[k], F.lit("")).alias(n) for k, n in enumerate(names)))


def parse_sam(lines: DataFrame, mode: str = "fail") -> DataFrame:
    """SAM rows of column ``value``; header lines are skipped; tags become a map of name to struct(type, value)."""
    c = F.col("c")
    good = (F.size(c) >= 11) & ((F.get(c, F.lit(9)) == "*") | (F.get(c, F.lit(10)) == "*") | (F.length(F.get(c, F.lit(9))) == F.length(F.get(c, F.lit(10)))))
    df = lines.where(~F.col("value").startswith("@")).withColumn("c", F.split("value", "\t"))
    if mode == "quarantine":
        df = df.where(good)
    else:
        df = df.withColumn("c", F.when(good, c).otherwise(F.raise_error(_bad(df, "SAM"))))
    kinds = {"flag": "int", "pos": "int", "mapq": "int", "pnext": "int", "tlen": "int"}
    tags = F.expr("map_from_entries(transform(slice(c, 12, size(c)), t -> struct(substring(t, 1, 2) as name, struct(substring(t, 4, 1) as type, substring(t, 6) as value) as tag)))")
    return df.select(*(F.col("c")[k].cast(kinds.get(n, "string")).alias(n) for k, n in enumerate(SAM)), tags.alias("tags"))


def read_sam(spark: SparkSession, path: str | list[str], mode: str = "fail") -> DataFrame:
    return parse_sam(_lines(spark, path), mode)


def tag(name: str, kind: str = "string") -> Column:
    """A tag's value, null where the read has none."""
    return F.try_element_at(F.col("tags"), F.lit(name))["value"].cast(kind)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fragments (nested) or flat alignment records."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_tsv(spark: SparkSession, path: str | list[str], key_columns: str = "", delimiter: str = "\t") -> DataFrame:
    """value and its sort key: the chosen fields (``1,3-5``, from 1) side by side without a separator, or the line."""
    df = spark.read.text(path)
    return df.withColumn("key", key_of(key_columns, delimiter))


def key_of(key_columns: str, delimiter: str = "\t") -> Column:
    if not key_columns.strip():
        return F.col("value")
    fields = [F.element_at(F.split("value", f"\\Q{delimiter}\\E", -1), k) for k in field_list(key_columns)]
    return F.concat(*fields)


def field_list(selector: str) -> list[int]:
    """``1,3-5`` as sorted distinct numbers."""
    found: set[int] = set()
    for part in selector.split(","):
        low, _, high = part.strip().partition("-")
        if not low.isdigit() or (high and not high.isdigit()) or int(low) < 1 or (high and int(high) < int(low)):
            raise ValueError(f"bad column selector {selector!r}")
        found |= set(range(int(low), int(high or low) + 1))
    return sorted(found)


def read_vcf(spark: SparkSession, path: str, snps_only: bool = False) -> DataFrame:
    """contig, pos, len of the variants of a VCF 4 file."""
    head = spark.read.text(path).limit(1).collect()
    if not head or not head[0][0].startswith("##fileformat=VCFv4"):
        raise ValueError("not a VCF 4 file")
    # whatever columns it names: the first line after those of ##
    heading = spark.read.text(path).where(~F.col("value").startswith("##")).limit(1).collect()
    if not heading or len(heading[0][0]) < 2 or heading[0][0][0] != "#":
        raise ValueError("VCF file without a heading")
    df = _lines(spark, path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c"))
    if df.isEmpty():
        raise ValueError("VCF file without variants")
    if snps_only:
        df = df.where(F.col("c")[7].rlike(r"(^|;)VC=SNP(;|$)"))
    return df.select(F.col("c")[0].alias("contig"), F.col("c")[1].cast("int").alias("pos"), F.length(F.col("c")[3]).alias("len"))


def read_rod(spark: SparkSession, path: str, snps_only: bool = True, shift: int = 0) -> DataFrame:
    """contig, pos, len of a dbSNP table's exact single-base genomic variants; only SNPs can be asked for."""
    if not snps_only:
        raise ValueError("a ROD file can only be read for SNPs")
    df = _lines(spark, path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c"))
    c = F.col("c")
    df = df.where((c[10] == "genomic") & (c[11] == "single") & (c[16] == "exact") & (c[3].cast("int") - c[2].cast("int") == 1))
    return df.select(c[1].alias("contig"), (c[2].cast("int") + shift).alias("pos"), F.lit(1).alias("len"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """id, name, start, length of the contigs of a .ann file; small, parsed on the driver."""
    words = [r[0].split() for r in spark.read.text(path, wholetext=False).collect() if r[0].strip()]
    total, count = int(words[0][0]), int(words[0][1])
    rows = [(k + 1, words[1 + 2 * k][1], int(words[2 + 2 * k][0]), int(words[2 + 2 * k][1])) for k in range((len(words) - 1) // 2)]
    if len(rows) != count or sum(r[3] for r in rows) > total:
        raise ValueError("annotation file is inconsistent")
    return spark.createDataFrame(rows, "id int, name string, start long, length long")


def read_holes(spark: SparkSession, path: str) -> DataFrame:
    """start, length, base of the ambiguous stretches of a .amb file."""
    words = [r[0].split() for r in spark.read.text(path).collect() if r[0].strip()]
    return spark.createDataFrame([(int(a), int(b), c) for a, b, c in words[1:]], "start long, length long, base string")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, header, sequence: a record is the text up to the next ``>`` at a line's start."""
    df = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    text = F.regexp_replace("value", "^>", "")
    header = F.regexp_extract(text, r"^([^\n\r]*)", 1)
    sequence = F.regexp_replace(F.regexp_replace(text, r"^[^\n\r]*", ""), r"[\s]", "")
    return df.select(F.regexp_extract(header, r"^(\S*)", 1).alias("name"), header.alias("header"), sequence.alias("sequence"))


def contig_md5(fasta: DataFrame, key: str = "name") -> DataFrame:
    return fasta.select(F.col(key).alias("name"), F.md5("sequence").alias("md5"))


def parse_sample_sheet(spark: SparkSession, text: str) -> DataFrame:
    """A sample sheet, by lane. Headings in any order and case; required Lane, SampleID, Index; (lane, index) unique."""
    lines = [[x.strip().strip('"').strip() for x in row] for row in csv.reader(io.StringIO(text)) if any(x.strip() for x in row)]
    heads = [x.lower() for x in lines[0]] if lines else []
    if missing := {"lane", "sampleid", "index"} - set(heads):
        raise ValueError(f"sample sheet lacks {sorted(missing)}")
    rows, seen = [], set()
    for row in lines[1:]:
        if len(row) != len(heads):
            raise ValueError(f"sample sheet row has {len(row)} columns, not {len(heads)}")
        r = dict(zip(heads, row, strict=True))
        r["index"], r["lane"] = r["index"].upper(), int(r["lane"])
        if r["lane"] < 1 or len(r["index"]) not in (0, *range(6, 13)) or (r["lane"], r["index"]) in seen:
            raise ValueError(f"bad or repeated sample sheet entry: {row}")
        seen.add((r["lane"], r["index"]))
        rows.append(tuple(r.get(n) for n in SHEET))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), ", ".join(f"`{n}` {'int' if n == 'lane' else 'string'}" for n in SHEET))


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    return parse_sample_sheet(spark, spark.read.text(path, wholetext=True).first()[0])


def contigs_with_md5(contigs: DataFrame, fasta: DataFrame) -> DataFrame:
    """``contigs`` with the md5 of their sequences; a contig without a sequence raises."""
    joined = contigs.join(contig_md5(fasta), "name", "left")
    return joined.withColumn("md5", F.coalesce("md5", F.raise_error(F.concat(F.lit("no checksum for contig "), F.col("name")))))


def text_of(columns: list[Column | str], separator: str = "\t") -> Column:
    return F.concat_ws(separator, *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))


def qseq_line() -> Column:
    c = F.col
    return text_of([c("instrument"), c("run_number"), c("lane"), c("tile"), c("xpos"), c("ypos"), F.coalesce("index_seq", F.lit("0")), c("read"), F.translate("bases", "N", "."), R.reencode("quals", R.SANGER, R.ILLUMINA), F.coalesce("filter_passed", F.lit(True)).cast("int")])


def fastq_record() -> Column:
    name = text_of(["instrument", "run_number", "flowcell_id", "lane", "tile", "xpos", "ypos"], ":")
    rest = text_of([F.col("read"), F.when(F.coalesce("filter_passed", F.lit(True)), "N").otherwise("Y"), F.lit("0"), F.col("index_seq")], ":")
    return F.concat(F.lit("@"), name, F.lit(" "), rest, F.lit("\n"), "bases", F.lit("\n+\n"), "quals")


def prq_line() -> Column:
    return text_of(["id", "bases1", "quals1", "bases2", "quals2"])


def fastq_of_pair(read: int) -> Column:
    """The record of one read of a pair (id, bases1, quals1, bases2, quals2), /1 or /2 at its name's end."""
    return F.concat(F.lit("@"), "id", F.lit(f"/{read}\n"), f"bases{read}", F.lit("\n+\n"), f"quals{read}")


def sam_line() -> Column:
    """Eleven columns and the tags by name; nulls are ``*`` or 0; a /1 or /2 at the name's end goes."""
    star = lambda n: F.coalesce(F.col(n), F.lit("*"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    numbered = F.substring("qname", -2, 2).isin([f"/{k}" for k in range(10)])
    columns = [F.when(numbered, F.expr("substring(qname, 1, length(qname) - 2)")).otherwise(F.col("qname")), zero("flag"), star("rname"), zero("pos"), zero("mapq"), star("cigar"), star("rnext"), zero("pnext"), zero("tlen"), star("seq"), star("qual")]
    tags = F.expr("array_join(transform(sort_array(map_entries(tags)), e -> concat(e.key, ':', e.value.type, ':', e.value.value)), '\t')")
    return F.concat_ws("\t", text_of(columns), F.nullif(tags, F.lit("")))


READERS: dict[str, Callable] = {"qseq": read_qseq, "fastq": read_fastq, "sam": read_sam, "prq": read_prq, "bdg": read_parquet, "avo": read_parquet, "vcf": read_vcf, "rod": read_rod, "fasta": read_fasta, "tsv": read_tsv}
WRITERS: dict[str, Callable[[], Column]] = {"qseq": qseq_line, "fastq": fastq_record, "prq": prq_line, "sam": sam_line}


def read(spark: SparkSession, name: str, path: str | list[str], **options) -> DataFrame:
    if name not in READERS:
        raise KeyError(f"unknown input format {name!r}")
    return READERS[name](spark, path, **options)


def write(df: DataFrame, name: str, path: str, compression: str | None = None, partition_by: list[str] | None = None) -> None:
    """Text by the named format, or Parquet for bdg and avo. An existing path is an error."""
    if name not in ("bdg", "avo", *WRITERS):
        raise KeyError(f"unknown output format {name!r}")
    codec = {"auto": "gzip"}.get(compression, compression)
    rows = df if name in ("bdg", "avo") else df.select(*(partition_by or []), WRITERS[name]().alias("value"))
    writer = rows.write.option("compression", codec) if codec else rows.write
    writer.partitionBy(*(partition_by or [])).format("parquet" if name in ("bdg", "avo") else "text").save(path)


#: Fixed value: Spark's name of a folder of nulls.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def shared_folder(spark: SparkSession) -> str:
    """A new folder for files: in the shared folder; only a local session may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fragmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/files-{uuid.uuid4().hex}"


#: Folders to which a task writes at the same time, in the rows' order; only beyond that its rows are sorted by folder.
WRITERS_LIMIT = 100


@contextmanager
def _side_by_side(spark: SparkSession):
    """While this holds, a task has a writer for each folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(WRITERS_LIMIT))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_by_folder(df: DataFrame, name: str, path: str, folders: list[str], compression: str | None = None) -> None:
    """As ``write``, into a folder of ``path`` for each tuple of the columns ``folders``: ``value/value/part-*``.

    A null has no folder of its own. Rows are written under folders that Spark names, which are then renamed, one call a
    folder; values must be fit for file names.
    """
    spark = df.sparkSession
    fs, target = _file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path}/_written"
    with _side_by_side(spark):
        write(df, name, staged, compression, folders)
    join = spark._jvm.org.apache.hadoop.fs.Path

    def place(folder, to, left: int) -> None:
        for status in fs.listStatus(folder):
            if status.isDirectory():
                value = status.getPath().getName().split("=", 1)[1]
                own = to if value == NO_VALUE else join(to, value)
                if left > 1:
                    place(status.getPath(), own, left - 1)
                elif value == NO_VALUE:
                    fs.mkdirs(own)
                    for file in fs.listStatus(status.getPath()):
                        fs.rename(file.getPath(), join(own, file.getPath().getName()))
                else:
                    fs.mkdirs(own.getParent())
                    fs.rename(status.getPath(), own)

    place(join(staged), target, len(folders))
    fs.delete(join(staged), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of this name."""
    fs, target = _file_system(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def concatenate(spark: SparkSession, parts: str, path: str, plain: bool = False) -> None:
    """One file of the part files of folder ``parts``, by name; names that begin with _ or . are skipped. Bytes go through the driver.

    With ``plain``, compressed parts are copied as what they hold.
    """
    fs, folder = _file_system(spark, parts)
    out_fs, target = _file_system(spark, path)
    out = out_fs.create(target, False)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    try:
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isFile())
        for name in (n for n in names if n[0] not in "_."):
            part = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
            source, codec = fs.open(part), codecs.getCodec(part) if plain else None
            source = codec.createInputStream(source) if codec else source
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    finally:
        out.close()


def write_pair_fastq(pairs: DataFrame, first: str, second: str, compression: str | None = None) -> None:
    """Two folders of fastq, read 1 and read 2 of each pair, in one order; a pair without a mate raises.

    Both are written in one pass, each task's pairs to a file of either folder, below a folder that then goes.
    """
    fs, _ = _file_system(pairs.sparkSession, first)
    join = pairs.sparkSession._jvm.org.apache.hadoop.fs.Path
    for path in (first, second):
        if fs.exists(join(path)):
            raise FileExistsError(path)
    whole = F.when(F.col("bases2").isNotNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no second read: "), F.col("id"))))
    both = F.array(*(F.struct(F.lit(read).alias("read"), fastq_of_pair(read).alias("value")) for read in (1, 2)))
    lines, staged = pairs.withColumn("id", whole).select(F.inline(both)), f"{first}.parts"
    with _side_by_side(pairs.sparkSession):
        lines.write.option("compression", compression or "none").partitionBy("read").text(staged)
    for read, path in ((1, first), (2, second)):
        written, to = join(staged, f"read={read}"), join(path)
        fs.mkdirs(to.getParent())
        if not (fs.rename(written, to) if fs.exists(written) else fs.mkdirs(to)):
            raise OSError(f"{staged} can't be put in its place {path}")
    fs.delete(join(staged), True)
