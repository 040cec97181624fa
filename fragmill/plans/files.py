"""Queries that write a format, read it back, and return what was read; and queries of the aligner's way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions import reads as R
from fragmill.operators import alignments as A
from fragmill.operators import demux as D
from fragmill.operators import hits as H
from fragmill.operators import pairing as P
from fragmill.operators import recab
from fragmill.plans import catalogue as C
from fragmill.plans import views as V
from fragmill.sources import formats as S
from fragmill.sources import illumina

query = C.query


_folder = S.shared_folder


def _again(df: DataFrame, name: str, compression: str | None = None, **options) -> DataFrame:
    path = _folder(df.sparkSession)
    S.write(df, name, path, compression)
    return S.read(df.sparkSession, name, path, **options)


# -- reads -----------------------------------------------------------------------------------------------------------

_READ = f"{C.LOCATION} AS location, CAST(read AS INT) AS read, bases, quals, filter_passed"


def _read(df: DataFrame) -> DataFrame:
    return df.select(D.location().alias("location"), "read", "bases", "quals", "filter_passed")


@query(f"SELECT {_READ} FROM ({C.READS}) AS r")
def qseq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(_again(C._reads(spark, sf_dir), "qseq"))


@query(f"SELECT {_READ} FROM ({C.READS}) AS r")
def qseq_gzip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(_again(C._reads(spark, sf_dir), "qseq", "gzip"))


#: Qualities of which some begin with @, as a record's first line does.
AT = "replace(quals, 'C', '@')"


@query(f"SELECT {_READ.replace('quals', f'{AT} AS quals')}, flowcell_id FROM ({C.READS}) AS r")
def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _again(C._reads(spark, sf_dir).withColumn("quals", F.expr(AT)), "fastq")
    return back.select(D.location().alias("location"), "read", "bases", "quals", "filter_passed", "flowcell_id")


@query(C._pairs_sql())
def prq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(C.QUERIES["prq_pairs"](spark, sf_dir), "prq")


_SEQUENCES = f"SELECT {C.LOCATION} AS location, string_agg(concat(bases, ' ', quals), '|' ORDER BY read) AS sequences FROM ({C.READS}) AS r GROUP BY 1 HAVING count(*) = 2"


def _joined(df: DataFrame) -> DataFrame:
    return df.select("location", F.array_join(F.transform("sequences", lambda s: F.concat_ws(" ", s["bases"], s["qualities"])), "|").alias("sequences"))


@query(_SEQUENCES)
def interleaved_qseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    S.write(C._reads(spark, sf_dir), "qseq", path)
    return _joined(S.read_interleaved_qseq(spark, path))


@query(_SEQUENCES)
def multi_qseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    S.write_by_folder(C._reads(spark, sf_dir).withColumn("own", F.col("read")), "qseq", path, ["own"])
    return _joined(S.read_multi_qseq(spark, [f"{path}/1", f"{path}/2"]))


@query(f"""SELECT {C.LOCATION} AS location, CASE WHEN count(*) = 2 THEN 'OK' ELSE 'FAILED' END AS status, CASE WHEN count(*) = 2 THEN max(CASE WHEN read = 1 THEN bases END) END AS bases1,
    CASE WHEN count(*) = 2 THEN max(CASE WHEN read = 2 THEN quals END) END AS quals2 FROM ({C.READS}) AS r WHERE filter_passed GROUP BY 1""")
def quiet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quiet_pairs(C._reads(spark, sf_dir)).select("location", "status", "bases1", "quals2")


@query(f"SELECT CAST(read AS INT) AS read, concat(id, '/', read) AS read_id, CASE read WHEN 1 THEN bases1 ELSE bases2 END AS bases, CASE read WHEN 1 THEN quals1 ELSE quals2 END AS quals FROM ({C._pairs_sql()}) AS p, range(1, 3) AS t(read)")
def prq_fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _folder(spark), _folder(spark)
    S.write_pair_fastq(C.QUERIES["prq_pairs"](spark, sf_dir), first, second, "gzip")
    return S.read_fastq(spark, [first, second]).select("read", "read_id", "bases", "quals")


@query(C._pairs_sql())
def prq_from_plain_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of reads that are known by names with /1 and /2 alone."""
    first, second = _folder(spark), _folder(spark)
    S.write_pair_fastq(C.QUERIES["prq_pairs"](spark, sf_dir), first, second)
    return P.pair(S.read_fastq(spark, [first, second]))


@query(f"SELECT id AS \"readName\", concat(bases1, ' ', quals1, '|', bases2, ' ', quals2) AS sequences, CAST(0 AS INT) AS n_alignments FROM ({C._pairs_sql()}) AS p")
def prq_fragment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _again(P.prq_fragments(C.QUERIES["prq_pairs"](spark, sf_dir)), "bdg")
    text = F.array_join(F.transform("sequences", lambda s: F.concat_ws(" ", s["bases"], s["qualities"])), "|")
    return back.select("readName", text.alias("sequences"), F.size("alignments").alias("n_alignments"))


@query(f"""SELECT {C.LOCATION} AS "readName", string_agg(concat(bases, ' ', quals, ' ', CASE WHEN filter_passed THEN 'false' ELSE 'true' END), '|' ORDER BY read) AS sequences FROM ({C.READS}) AS r GROUP BY 1""")
def fragment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _again(P.fragments(C._reads(spark, sf_dir)), "bdg")
    text = F.array_join(F.transform("sequences", lambda s: F.concat_ws(" ", s["bases"], s["qualities"], s["failedVendorQualityChecks"].cast("string"))), "|")
    return back.select("readName", text.alias("sequences"))


@query(f"SELECT instrument, CAST(run_number AS VARCHAR) AS \"runId\", lane, tile, count(*) AS fragments FROM (SELECT DISTINCT instrument, run_number, lane, tile, xpos, ypos FROM ({C.READS}) AS r) AS l GROUP BY ALL")
def fragments_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = P.by_tile(P.fragments(C._reads(spark, sf_dir)), 100)
    return packs.groupBy("instrument", "runId", "lane", "tile").agg(F.sum(F.size("fragments")).cast("long").alias("fragments"))


_LONG = "concat(instrument, ':', run_number, ':FC:', lane, ':', tile, ':', xpos, ':', ypos, ' ', read, ':N:0:ACGT')"
_SHORT = "concat(instrument, ':', run_number, ':', lane, ':', tile, ':', xpos, ':', ypos, '#ACGT/', read)"


@query(
    f"""SELECT name, CASE WHEN rn % 3 = 0 THEN 'illumina' WHEN rn % 3 = 1 THEN 'fastq' ELSE 'bare' END AS dialect, CASE WHEN rn % 3 < 2 THEN lane END AS lane, CASE WHEN rn % 3 < 2 THEN ypos END AS ypos, 'ACGT' AS index_seq, CAST(read AS INT) AS read
    FROM (SELECT *, CASE WHEN rn % 3 = 0 THEN {_LONG} WHEN rn % 3 = 1 THEN {_SHORT} ELSE concat('x', l_orderkey, '#ACGT/', read) END AS name FROM ({C.READS}) AS r) AS n"""
)
def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = V.reads(spark, sf_dir).select(F.expr(f"CASE WHEN rn % 3 = 0 THEN {_LONG} WHEN rn % 3 = 1 THEN {_SHORT} ELSE concat('x', l_orderkey, '#ACGT/', read) END").alias("name"))
    return named.select("name", P.name_fields("name").alias("f")).select("name", "f.dialect", "f.lane", "f.ypos", "f.index_seq", "f.read")


@query(f"SELECT l_orderkey, rn, bases, CAST(32 AS INT) AS n, quals, CAST(list_sum(list_transform(string_split(quals, ''), lambda c: ascii(c) - 33)) AS BIGINT) AS total FROM (SELECT l_orderkey, rn, replace(bases, 'N', 'A') AS bases, quals FROM ({C.READS}) AS q) AS r")
def packed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = V.reads(spark, sf_dir).select("l_orderkey", F.col("rn").cast("long").alias("rn"), R.pack_bases("replace(bases, 'N', 'A')").alias("b"), R.quality_array("quals").alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda t, x: t + x)
    return packed.select("l_orderkey", "rn", R.unpack_bases("b").alias("bases"), (F.length("b.packed") * 4).alias("n"), R.quality_text("q").alias("quals"), total.alias("total"))


@query("SELECT o_orderkey, concat('{\"AS\":\"', o_custkey, '\",\"NM\":\"', o_orderstatus, '\"}') AS attributes FROM orders")
def attributes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit("NM"), F.col("o_orderstatus"), F.lit("AS"), F.col("o_custkey").cast("string"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", names.alias("m")).select("o_orderkey", R.attributes_json("m").alias("attributes"))


@query(f"SELECT CAST(rank() OVER (ORDER BY lane, tile, read, xpos, ypos) AS BIGINT) AS place, lane, tile, CAST(read AS INT) AS read, xpos, ypos FROM ({C.READS}) AS r")
def flowcell_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the sort, with its place: rows are numbered within their partitions, and partitions by their sizes."""
    rows = A.flowcell_sort(V.reads(spark, sf_dir)).select("lane", "tile", "read", "xpos", "ypos")
    path = _folder(spark)
    rows.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path).withColumns({"part": F.shiftright("id", 33), "own": F.col("id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted(numbered.groupBy("part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "part long, start long")
    return numbered.join(F.broadcast(starts), "part").select((F.col("start") + F.col("own") + 1).alias("place"), "lane", "tile", "read", "xpos", "ypos")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def full_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.full_order(V.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"))


# -- demultiplexed output --------------------------------------------------------------------------------------------

_DEMUXED = f"""SELECT destination, concat_ws(chr(9), instrument, run_number, r.lane, tile, xpos, ypos, index_seq, d.read, replace(r.bases, 'N', '.'), translate(quals, {C.SHIFT}), CAST(filter_passed AS INT)) AS line
    FROM ({C._demux_sql(1, separate=True)}) AS d JOIN ({C.READS}) AS r ON d.location = {C.LOCATION.replace("lane", "r.lane")} AND d.read = r.read"""


@query(_DEMUXED)
def demux_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.demultiplex(V.multiplexed(spark, sf_dir), V.sheet(spark, sf_dir), mismatches=1, separate_reads=True)
    path = _folder(spark)
    S.write_by_folder(found.withColumn("read_folder", F.col("read").cast("string")), "qseq", path, ["project", "sample", "read_folder"])
    back = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.split("_metadata.file_path", "/").alias("p"))
    at = lambda k: F.element_at("p", k)
    # reads without a sample have no folder of a project
    folder = F.when(at(-3) == D.UNKNOWN, F.concat_ws("/", at(-3), at(-2))).otherwise(F.concat_ws("/", at(-4), at(-3), at(-2)))
    return back.select(folder.alias("destination"), F.col("value").alias("line"))


@query(f"""SELECT destination, d.location AS "readName", string_agg(concat(d.bases, ' ', quals, ' ', CASE WHEN filter_passed THEN 'false' ELSE 'true' END), '|' ORDER BY d.read) AS sequences
    FROM ({C._demux_sql(1)}) AS d JOIN ({C.READS}) AS r ON d.location = {C.LOCATION} AND d.read = r.read GROUP BY 1, 2""")
def demux_fragment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.demultiplex(V.multiplexed(spark, sf_dir), V.sheet(spark, sf_dir), mismatches=1)
    path = _folder(spark)
    S.write_by_folder(D.demux_fragments(found), "bdg", path, ["project", "sample"])
    text = F.array_join(F.transform("sequences", lambda s: F.concat_ws(" ", s["bases"], s["qualities"], s["failedVendorQualityChecks"].cast("string"))), "|")
    return spark.read.option("recursiveFileLookup", True).parquet(path).select("destination", "readName", text.alias("sequences"))


@query(f"SELECT * FROM ({C._demux_sql(0)}) AS d WHERE location IN (SELECT {C.LOCATION} FROM ({C.READS}) AS r WHERE filter_passed) AND (location, read) IN (SELECT {C.LOCATION}, read FROM ({C.READS}) AS r WHERE filter_passed)")
def demux_drop_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._demux(spark, sf_dir, drop_failed=True)


@query(
    f"""WITH d AS ({C._demux_sql(1)}) SELECT destination AS "group", 'reads' AS name, count(*) AS value FROM d GROUP BY 1 UNION ALL SELECT destination, 'bases', CAST(sum(length(bases)) AS BIGINT) FROM d GROUP BY 1
    UNION ALL SELECT 'barcode mismatches', CAST(mismatches AS VARCHAR), count(*) FROM d WHERE sampleid IS NOT NULL GROUP BY mismatches"""
)
def demux_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.demux_counters(D.demultiplex(V.multiplexed(spark, sf_dir), V.sheet(spark, sf_dir), mismatches=1))


@query(f"""WITH s AS ({C.SHEET}) SELECT concat('LaneContent.', sampleid) AS file, concat(lane - 1, ':', CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.sampleid = n.sampleid AND s.lane = l.lane) THEN sampleid ELSE '' END) AS line FROM (SELECT DISTINCT sampleid FROM s) AS n, range(1, 9) AS l(lane)""")
def lane_content_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    for name, text in D.lane_content_files(V.sheet(spark, sf_dir)):
        S.write_text(spark, f"{path}/{name}", text)
    return spark.read.text(path).select(F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("line"))


@query(f'SELECT fcid, CAST(lane AS INT) AS lane, sampleid, "index", sampleproject FROM ({C.SHEET}) AS s')
def sample_sheet_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.sheet(spark, sf_dir).collect()
    lines = ['Lane,"SampleID",FCID,INDEX,SampleProject', *(f'{r["lane"]},"{r["sampleid"]}",{r["fcid"]},{r["index"]},{r["sampleproject"]}' for r in rows)]
    path = _folder(spark)
    S.write_text(spark, path, "\n".join(lines) + "\n")
    return S.read_sample_sheet(spark, path).select("fcid", "lane", "sampleid", "index", "sampleproject")


# -- alignments, variants, references --------------------------------------------------------------------------------


def _sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(*(x for n in ("MD", "RG") for x in (F.lit(n), F.struct(F.lit("Z").alias("type"), F.col(n.lower()).alias("value")))))
    return V.alignments(spark, sf_dir).withColumns({"rnext": F.lit("*"), "pnext": F.lit(0), "tags": tags})


@query(f"SELECT qname, flag, rname, pos, mapq, cigar, tlen, seq, qual, md, rg FROM ({C.ALIGNED}) AS a")
def sam_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _again(_sam(spark, sf_dir), "sam", "bzip2")
    return back.select("qname", "flag", "rname", "pos", "mapq", "cigar", "tlen", "seq", "qual", S.tag("MD").alias("md"), S.tag("RG").alias("rg"))


@query(f"SELECT qname, {C.FLAG} AS flag FROM ({C.ALIGNED}) AS a")
def flat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flat_to_sam(_again(C._flat(spark, sf_dir), "avo")).select("qname", "flag")


@query("SELECT o_orderkey || chr(9) || o_orderstatus || chr(9) || o_custkey AS value, o_orderkey || '' || o_custkey AS key FROM orders")
def tsv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    V.table(spark, sf_dir, "orders").select(F.concat_ws("\t", "o_orderkey", "o_orderstatus", "o_custkey").alias("value")).write.text(path)
    return S.read_tsv(spark, path, "1,3")


_VCF = "concat_ws(chr(9), concat('c', p_partkey % 5), p_partkey, '.', repeat('A', CAST(p_partkey % 3 + 1 AS INT)), 'T', '.', 'PASS', concat('DB;VC=', CASE WHEN p_partkey % 3 = 0 THEN 'SNP' ELSE 'INDEL' END))"


def _merged(lines: DataFrame, head: str) -> str:
    path = _folder(lines.sparkSession)
    A.write_merged(lines.sparkSession, head, lines, path)
    return path


@query("SELECT concat('c', p_partkey % 5) AS contig, CAST(p_partkey AS INT) AS pos, CAST(p_partkey % 3 + 1 AS INT) AS len, p_partkey % 3 = 0 AS snp FROM part")
def vcf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _merged(V.table(spark, sf_dir, "part").select(F.expr(_VCF.replace("chr(9)", "'\\t'")).alias("value")), "##fileformat=VCFv4.1\n##source=x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n")
    snps = S.read_vcf(spark, path, snps_only=True).select("contig", "pos", F.lit(True).alias("snp"))
    return S.read_vcf(spark, path).join(snps, ["contig", "pos"], "left").select("contig", "pos", "len", F.coalesce("snp", F.lit(False)).alias("snp"))


_ROD = "concat_ws(chr(9), 585, concat('c', p_partkey % 5), p_partkey, p_partkey + CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END, 'rs', 0, '+', 'A', 'A', 'A/T', 'genomic', CASE WHEN p_partkey % 5 = 0 THEN 'insertion' ELSE 'single' END, 'x', 0, 0, 'y', CASE WHEN p_partkey % 7 = 0 THEN 'between' ELSE 'exact' END)"


@query("SELECT concat('c', p_partkey % 5) AS contig, CAST(p_partkey AS INT) AS pos, CAST(1 AS INT) AS len FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def rod_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    V.table(spark, sf_dir, "part").select(F.expr(_ROD.replace("chr(9)", "'\\t'")).alias("value")).write.text(path)
    return S.read_rod(spark, path)


@query("SELECT CAST(n_nationkey + 1 AS INT) AS id, replace(n_name, ' ', '_') AS name, CAST(n_nationkey * 100 AS BIGINT) AS start, CAST(100 AS BIGINT) AS length FROM nation")
def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    path = _folder(spark)
    body = "".join(f"0 {r['n_name'].replace(' ', '_')} (null)\n{r['n_nationkey'] * 100} 100 0\n" for r in rows)
    S.write_text(spark, path, f"{len(rows) * 100} {len(rows)} 11\n{body}")
    return S.read_annotation(spark, path)


@query("SELECT CAST(n_nationkey * 100 + 7 AS BIGINT) AS start, CAST(n_regionkey + 1 AS BIGINT) AS length, 'N' AS base FROM nation")
def hole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    path = _folder(spark)
    S.write_text(spark, path, f"2500 25 {len(rows)}\n" + "".join(f"{r['n_nationkey'] * 100 + 7} {r['n_regionkey'] + 1} N\n" for r in rows))
    return S.read_holes(spark, path)


_LONG_SEQUENCE = "concat(" + ", ".join(f"translate(md5(concat(n_nationkey, '-', {k})), '0123456789abcdef', 'ACGTACGTACGTACGT')" for k in range(16)) + ")"
_CONTIGS = f"SELECT n_nationkey AS n, concat('n', lpad(concat(n_nationkey, ''), 2, '0')) AS name, {_LONG_SEQUENCE} AS sequence FROM {{nation}}"


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CONTIGS.format(nation="{t}"), t=V.table(spark, sf_dir, "nation"))


def _fasta(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark)
    lines = F.concat(F.lit(">"), "name", F.lit(" a contig\n"), F.substring("sequence", 1, 60), F.lit("\n"), F.substring("sequence", 61, 1000))
    _contigs(spark, sf_dir).select(lines.alias("value")).write.text(path)
    return path


@query(f"SELECT name, concat(name, ' a contig') AS header, md5(sequence) AS md5 FROM ({_CONTIGS.format(nation='nation')}) AS c")
def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    fasta = S.read_fasta(spark, _fasta(spark, sf_dir))
    return fasta.select("name", "header").join(S.contig_md5(fasta), "name")


_LINES = f"SELECT concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, '*', 0, tlen, seq, qual, concat('MD:Z:', md), concat('RG:Z:', rg)) AS line FROM ({C.ALIGNED}) AS a"


@query(f"SELECT concat_ws(chr(9), '@HD', 'VN:1.0', 'SO:coordinate') AS line UNION ALL SELECT concat_ws(chr(9), '@SQ', concat('SN:c', k), 'LN:50000', concat('M5:', md5(concat('ACGT', k)))) FROM range(5) AS t(k) UNION ALL SELECT concat_ws(chr(9), '@PG', 'ID:fragmill') UNION ALL {_LINES}")
def merged_sam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = spark.createDataFrame([(k + 1, f"c{k}", k * 50_000, 50_000) for k in range(5)], "id int, name string, start long, length long")
    fasta = spark.createDataFrame([(f"c{k}", f"ACGT{k}") for k in range(5)], "name string, sequence string")
    ordered = A.coordinate_sort(_sam(spark, sf_dir), contigs).select(S.sam_line().alias("value"))
    return spark.read.text(_merged(ordered, A.header(S.contigs_with_md5(contigs, fasta)))).select(F.col("value").alias("line"))


@query(f"WITH t AS ({C._recab_sql('')}) SELECT rg AS \"ReadGroup\", quality AS \"QualityScore\", cycle AS \"Cycle\", dinuc AS \"Dinuc\", n_observations AS \"nObservations\", n_mismatches AS \"nMismatches\", q_empirical AS \"Qempirical\" FROM t")
def recab_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    recab.write_csv(recab.table(V.alignments(spark, sf_dir)), path)
    return spark.read.csv(path, header=True, schema="ReadGroup string, QualityScore int, Cycle int, Dinuc string, nObservations long, nMismatches long, Qempirical int")


@query(f"{C.BASES}, t AS (SELECT rg, CASE WHEN cycle < 0 THEN 2 ELSE 1 END AS read, count(*) AS n_observations, CAST(sum(CAST(mismatch AS INT)) AS BIGINT) AS n_mismatches FROM d GROUP BY ALL) {C._empirical(0.0, 40)}")
def recab_other_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recab.table(V.alignments(spark, sf_dir), covariates=("rg", ("read", F.when(F.col("second"), 2).otherwise(1))))


# -- aligning --------------------------------------------------------------------------------------------------------

#: Pairs that lie 60 apart on a contig; of some, a read has letters that nothing matches.
_PAIRS = """SELECT concat('o', o_orderkey) AS id, n, name, p, o_orderkey % 2 = 1 AS turned, o_orderkey % 17 = 0 AS bad1, o_orderkey % 13 = 0 AS bad2,
    concat(CASE WHEN o_orderkey % 17 = 0 THEN 'NNN' ELSE substr(CASE WHEN o_orderkey % 2 = 1 THEN r ELSE f END, 1, 3) END, substr(CASE WHEN o_orderkey % 2 = 1 THEN r ELSE f END, 4)) AS bases1,
    concat(CASE WHEN o_orderkey % 13 = 0 THEN 'NNN' ELSE substr(CASE WHEN o_orderkey % 2 = 1 THEN f ELSE r END, 1, 3) END, substr(CASE WHEN o_orderkey % 2 = 1 THEN f ELSE r END, 4)) AS bases2,
    substr(translate(md5(concat('q', o_orderkey)), '0123456789abcdef', '#+3;CK5ABDEFGHI!'), 1, 24) AS quals1, substr(translate(md5(concat('r', o_orderkey)), '0123456789abcdef', '#+3;CK5ABDEFGHI!'), 1, 24) AS quals2
  FROM (SELECT o_orderkey, n, name, CAST(o_orderkey * 7 % 400 + 1 AS INT) AS p, substr(sequence, CAST(o_orderkey * 7 % 400 + 1 AS INT), 24) AS f,
      reverse(translate(substr(sequence, CAST(o_orderkey * 7 % 400 + 61 AS INT), 24), 'ACGT', 'TGCA')) AS r
    FROM {orders} AS o JOIN ({contigs}) AS c ON o_orderkey % 25 = n) AS x"""
_SQL_PAIRS = _PAIRS.format(orders="orders", contigs=_CONTIGS.format(nation="nation"))


def _order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' keys, dealt to all tasks: aligning takes long for so few bytes as a key has."""
    return V.table(spark, sf_dir, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAIRS.format(orders="{o}", contigs=_CONTIGS.format(nation="{t}")), o=_order_keys(spark, sf_dir), t=V.table(spark, sf_dir, "nation"))


def _aligner(spark: SparkSession, sf_dir: str):
    # 25 contigs of 512 bases
    contigs = {r["name"]: r["sequence"] for r in S.read_fasta(spark, _fasta(spark, sf_dir)).collect()}
    return lambda: H.ExactAligner(contigs)


def _aligned(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    pairs = _query_pairs(spark, sf_dir).select("id", "bases1", "quals1", "bases2", "quals2")
    return H.seqal(pairs, _aligner(spark, sf_dir), **options)


#: One row a read: where it lies, as its pair was made.
_SIDES = f"""WITH pr AS ({_SQL_PAIRS}), side AS (
  SELECT id, n, name, 1 AS read, bad1 AS bad, bad2 AS other_bad, turned AS rev, CASE WHEN turned THEN p + 60 ELSE p END AS pos, CASE WHEN turned THEN p ELSE p + 60 END AS other_pos, bases1 AS bases, quals1 AS quals FROM pr
  UNION ALL SELECT id, n, name, 2, bad2, bad1, NOT turned, CASE WHEN turned THEN p ELSE p + 60 END, CASE WHEN turned THEN p + 60 ELSE p END, bases2, quals2 FROM pr),
good AS (SELECT *, CAST(list_sum(list_transform(list_filter(string_split(quals, ''), lambda c: ascii(c) >= 48), lambda c: ascii(c) - 33)) AS BIGINT) AS own FROM side WHERE NOT bad)"""
_ENDS = f"""{_SIDES}, p AS (SELECT id AS name, CAST(sum(own) AS BIGINT) AS score, min(n) AS ref1, CASE WHEN min(read) = 1 THEN max(CASE WHEN read = 1 THEN pos + CASE WHEN rev THEN 23 ELSE 0 END END) ELSE max(pos + CASE WHEN rev THEN 23 ELSE 0 END) END AS pos1,
    CASE WHEN min(read) = 1 THEN bool_or(read = 1 AND rev) ELSE bool_or(rev) END AS rev1, CASE WHEN count(*) = 2 THEN min(n) END AS ref2, CASE WHEN count(*) = 2 THEN max(CASE WHEN read = 2 THEN pos + CASE WHEN rev THEN 23 ELSE 0 END END) END AS pos2,
    CASE WHEN count(*) = 2 THEN bool_or(read = 2 AND rev) END AS rev2 FROM good GROUP BY id)"""
_MARKS = C.MARKED.strip()
_MARKED_HITS = f"{_ENDS}, {_MARKS[_MARKS.index('k AS (') :]}"
_FLAGS = """CAST(1 + CASE WHEN NOT other_bad THEN 2 ELSE 0 END + CASE WHEN rev THEN 16 ELSE 0 END + CASE WHEN NOT other_bad AND NOT rev THEN 32 ELSE 0 END + CASE WHEN read = 1 THEN 64 ELSE 128 END AS INT)"""
_SAM = f"""SELECT id AS qname, {_FLAGS} + CASE WHEN duplicate THEN 1024 ELSE 0 END AS flag, good.name AS rname, CAST(pos AS INT) AS pos, CAST(60 AS INT) AS mapq, '24M' AS cigar,
    CASE WHEN other_bad THEN '*' ELSE '=' END AS rnext, CAST(CASE WHEN other_bad THEN 0 ELSE other_pos END AS INT) AS pnext, CAST(CASE WHEN other_bad THEN 0 WHEN rev THEN -84 ELSE 84 END AS INT) AS tlen,
    CASE WHEN rev THEN reverse(translate(bases, 'ACGT', 'TGCA')) ELSE bases END AS seq, CASE WHEN rev THEN reverse(quals) ELSE quals END AS qual, concat_ws(chr(9), 'MD:Z:24', 'AS:i:24', 'NM:i:0') AS tags_text"""


@query(f"{_MARKED_HITS} {_SAM} FROM good JOIN marked ON marked.name = id")
def seqal_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    H.to_sam(_aligned(spark, sf_dir)).select(H.sam_text().alias("value")).write.text(path)
    back = S.read_sam(spark, path)
    tags = F.concat_ws("\t", *(F.concat(F.lit(f"{n}:"), F.col("tags")[n]["type"], F.lit(":"), F.col("tags")[n]["value"]) for n in ("MD", "AS", "NM")))
    return back.select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", tags.alias("tags_text"))


@query(f"{_MARKED_HITS} SELECT name AS id FROM marked WHERE NOT duplicate")
def seqal_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, discard=True).select("id")


@query(
    f"""{_SIDES} SELECT id AS "readName", CAST(CASE WHEN count(*) = 2 THEN max(CASE WHEN read = 1 THEN CASE WHEN rev THEN -84 ELSE 84 END END) END AS INT) AS "inferredInsertSize",
    string_agg(concat_ws(' ', read, good.name, pos - 1, pos + 22, CASE WHEN rev THEN 'true' ELSE 'false' END, CASE WHEN rev THEN reverse(translate(bases, 'ACGT', 'TGCA')) ELSE bases END), '|' ORDER BY read) AS alignments FROM good GROUP BY id"""
)
def seqal_fragment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _again(H.to_fragments(_aligned(spark, sf_dir, mark=False)), "bdg")
    text = F.transform("alignments", lambda a: F.concat_ws(" ", *(a[n].cast("string") for n in ("readNum", "contig", "start", "end", "readNegativeStrand", "sequence"))))
    return back.select("readName", "inferredInsertSize", F.array_join(text, "|").alias("alignments"))


@query(f"""{_SIDES} SELECT id AS "readName", read = 1 AS "firstOfPair", good.name AS contig, CAST(pos - 1 AS INT) AS start, NOT other_bad AS "mateMapped", CAST(CASE WHEN NOT other_bad THEN other_pos - 1 END AS INT) AS "mateStart", '{{"AS":24,"NM":0}}' AS attributes FROM good""")
def seqal_flat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(H.to_flat(_aligned(spark, sf_dir, mark=False)), "avo").select("readName", "firstOfPair", "contig", "start", "mateMapped", "mateStart", "attributes")


@query(f"{_SIDES} {_SAM.replace('+ CASE WHEN duplicate THEN 1024 ELSE 0 END', '')} FROM good WHERE NOT other_bad")
def bdg_to_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _again(H.to_fragments(_aligned(spark, sf_dir, mark=False)), "bdg").where(F.size("alignments") == 2)
    return A.flat_to_sam(A.fragment_to_flat(whole)).withColumn("tlen", F.col("tlen").cast("int"))


@query(
    f"""{_MARKED_HITS}, h AS (SELECT id, count(*) AS n, sum(CASE WHEN NOT other_bad THEN 1 ELSE 0 END) AS proper, bool_or(duplicate) AS duplicate FROM good JOIN marked ON marked.name = id GROUP BY id)
    SELECT name, CAST(value AS BIGINT) AS value FROM (SELECT sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS pairs, sum(n) AS reads, sum(n) AS "mapped reads", sum(proper) AS "proper reads", sum(CASE WHEN duplicate AND n = 2 THEN 1 ELSE 0 END) AS "duplicate pairs",
      sum(CASE WHEN duplicate AND n = 1 THEN 1 ELSE 0 END) AS "duplicate fragments" FROM h) AS t UNPIVOT (value FOR name IN (pairs, reads, "mapped reads", "proper reads", "duplicate pairs", "duplicate fragments"))"""
)
def seqal_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.counters(_aligned(spark, sf_dir))


_MASKS = "SELECT concat('V', o_orderkey) AS vid, concat(substr(sequence, p, 12), '[', substr(sequence, p + 12, 1), '/', translate(substr(sequence, p + 12, 1), 'ACGT', 'CGTA'), ']', substr(sequence, p + 13, 12)) AS mask, name, p, n, o_orderkey FROM (SELECT o_orderkey, n, name, sequence, CAST(o_orderkey * 11 % 400 + 1 AS INT) AS p FROM {orders} AS o JOIN ({contigs}) AS c ON o_orderkey % 25 = n) AS x"


@query(f"SELECT vid, 'hg' AS ref_genome, name AS chromosome, CAST(p + 12 AS INT) AS pos, '+' AS strand, 'A' AS allele, CAST(1 AS BIGINT) AS copies FROM ({_MASKS.format(orders='orders', contigs=_CONTIGS.format(nation='nation'))}) AS m")
def snp_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = spark.sql(_MASKS.format(orders="{o}", contigs=_CONTIGS.format(nation="{t}")), o=_order_keys(spark, sf_dir), t=V.table(spark, sf_dir, "nation")).select("vid", "mask")
    return H.snp_places(masks, H.align(H.snp_pairs(masks), _aligner(spark, sf_dir)), "hg")


# -- run directories and work lists ----------------------------------------------------------------------------------

RUN_INFO = '<RunInfo><Run Id="r1" Number="7"><Flowcell>FC1</Flowcell><Instrument>M1</Instrument><Date>200131</Date><Reads><Read Number="1"/><Read Number="2"/></Reads><FlowcellLayout LaneCount="8"/></Run></RunInfo>'
RUN_PARAMETERS = (
    "<RunParameters><Version>1</Version><Setup><SelectedSurface>BothLaneSurfaces</SelectedSurface><NumSwaths>3</NumSwaths><NumTilesPerSwath>16</NumTilesPerSwath><AlignToPhiX>"
    + "".join(f"<Lane>{k}</Lane>" for k in range(1, 9))
    + '</AlignToPhiX><Reads><Read Number="1" NumCycles="101" IsIndexedRead="N"/><Read Number="2" NumCycles="7" IsIndexedRead="Y"/><Read Number="3" NumCycles="101" IsIndexedRead="N"/></Reads></Setup></RunParameters>'
)


def _run_directory(spark: SparkSession) -> str:
    path = _folder(spark)
    S.write_text(spark, f"{path}/RunInfo.xml", RUN_INFO)
    S.write_text(spark, f"{path}/runParameters.xml", RUN_PARAMETERS)
    return path


@query("SELECT CAST(lane AS INT) AS lane, concat(surface, swath, lpad(CAST(number AS VARCHAR), 2, '0')) AS tile FROM range(1, 9) AS l(lane), range(1, 3) AS s(surface), range(1, 4) AS w(swath), range(1, 17) AS t(number)")
def run_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return illumina.tiles(spark, illumina.read_run(spark, _run_directory(spark))).select("lane", "tile").coalesce(8)


@query("SELECT concat_ws(' ', '--lane', lane, '--tile', concat(surface, swath, lpad(CAST(number AS VARCHAR), 2, '0')), '--read 1:1-101 --read 2:102-108:index --read 3:109-209') AS line FROM range(1, 9) AS l(lane), range(1, 3) AS s(surface), range(1, 4) AS w(swath), range(1, 17) AS t(number)")
def tile_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A converter a tile; here a program that prints what it is asked for."""
    path = _run_directory(spark)
    work = illumina.work_list(spark, path, illumina.read_run(spark, path), "echo")
    return A.run_commands(work.coalesce(8)).select(F.regexp_extract("value", "^(.*?) --filter", 1).alias("line"))
