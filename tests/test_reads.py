import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fragmill.functions import reads as R
from fragmill.operators import alignments as A
from fragmill.operators import demux as D
from fragmill.operators import pairing as P
from fragmill.operators import recab
from fragmill.sources import formats as S

QSEQ = "M1\t7\t1\t1101\t10\t20\t0\t{read}\tAC.T\thhhB\t{ok}"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("cigar, ops", [("*", []), ("10M", [(10, "M")]), ("2S3M1I2D4N1H5P", [(2, "S"), (3, "M"), (1, "I"), (2, "D"), (4, "N"), (1, "H"), (5, "P")])])
def test_cigar(spark, cigar, ops):
    assert [tuple(x) for x in one(spark, R.cigar_ops("cigar"), cigar=cigar)] == ops


@pytest.mark.parametrize("cigar", ["10", "M", "10M3", "x10M", "3M x 4M", "3=1X"])
def test_bad_cigar(spark, cigar):
    with pytest.raises(PySparkException):
        one(spark, R.cigar_ops("cigar"), cigar=cigar)


def coords(spark, cigar, pos=100):
    df = spark.createDataFrame([(cigar, pos)], ["cigar", "pos"]).withColumn("ops", R.cigar_ops())
    return [c["ref"] for c in df.select(R.coordinates("ops", "pos")).first()[0]]


def test_coordinates(spark):
    assert coords(spark, "4M") == [100, 101, 102, 103]
    assert coords(spark, "2S2M1I1M") == [-1, -1, 100, 101, -1, 102]
    assert coords(spark, "2M3D1M") == [100, 101, 105]
    with pytest.raises(PySparkException):
        coords(spark, "2M3N1M")


def test_md(spark):
    assert one(spark, R.md_matches("md"), md="2A1^CG0T1") == [True, True, False, True, False, True]
    for bad in ("A2", "2A", "", "2^1"):
        with pytest.raises(PySparkException):
            one(spark, R.md_matches("md"), md=bad)


def test_small_functions(spark):
    assert one(spark, R.reverse_complement("b"), b="ACGTN") == "NACGT"
    assert one(spark, R.reencode("q"), q="@Bh") == "!#I"
    assert one(spark, R.flag_text("f"), f=1 | 4 | 1024) == "p-u-------d"
    assert one(spark, R.hamming("a", "b"), a="ACGT", b="AGGA") == 2
    assert sorted(one(spark, R.substitutions("t", 1), t="A")) == list("ACGNT")
    assert [one(spark, R.empirical_quality("n", "m"), n=n, m=m) for n, m in ((1, 1), (1, 0), (100, 1))] == [1, 40, 20]
    assert S.field_list("1,3-5") == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        S.field_list("0")


def test_formats_round_trip(spark, tmp_path):
    (tmp_path / "a.qseq").write_text("\n".join(QSEQ.format(read=k, ok=1) for k in (1, 2)) + "\n")
    reads = S.read(spark, "qseq", str(tmp_path / "a.qseq"))
    rows = reads.orderBy("read").collect()
    assert [(r.read, r.bases, r.quals, r.filter_passed) for r in rows] == [(1, "ACNT", "III#", True), (2, "ACNT", "III#", True)]
    S.write(reads, "qseq", str(tmp_path / "out"), compression="gzip")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == [QSEQ.format(read=k, ok=1) for k in (1, 2)]
    S.write(reads.withColumn("flowcell_id", F.lit("FC")), "fastq", str(tmp_path / "fq"))
    again = S.read(spark, "fastq", str(tmp_path / "fq")).orderBy("read").collect()
    assert [(r.read, r.bases, r.quals, r.flowcell_id, r.filter_passed) for r in again] == [(1, "ACNT", "III#", "FC", True), (2, "ACNT", "III#", "FC", True)]
    pairs = P.pair(reads, min_bases=1)
    assert tuple(pairs.first()) == ("M1:7::1:1101:10:20#0", "ACNT", "III#", "ACNT", "III#")
    S.write(pairs, "prq", str(tmp_path / "prq"))
    assert S.read(spark, "prq", str(tmp_path / "prq")).first() == pairs.first()
    with pytest.raises(KeyError):
        S.read(spark, "xyz", "x")


def test_bad_lines(spark, tmp_path):
    (tmp_path / "bad").write_text("a\tb\n" + QSEQ.format(read=1, ok=0) + "\n")
    with pytest.raises(PySparkException):
        S.read_qseq(spark, str(tmp_path / "bad")).collect()
    assert S.read_qseq(spark, str(tmp_path / "bad"), mode="quarantine").count() == 1


def test_references(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4.1\n#CHROM\tPOS\nc1\t5\t.\tAC\tA\t.\t.\tVC=INDEL\nc1\t9\t.\tA\tG\t.\t.\tX=1;VC=SNP\n")
    assert {tuple(r) for r in S.read_vcf(spark, str(tmp_path / "v.vcf")).collect()} == {("c1", 5, 2), ("c1", 9, 1)}
    assert S.read_vcf(spark, str(tmp_path / "v.vcf"), snps_only=True).count() == 1
    (tmp_path / "f.fa").write_text(">c1 first\nACGT\nAC\n>c2\nGG\n")
    assert {(r.name, r.sequence) for r in S.read_fasta(spark, str(tmp_path / "f.fa")).collect()} == {("c1", "ACGTAC"), ("c2", "GG")}
    (tmp_path / "r.ann").write_text("8 2 11\n0 c1 (null)\n0 6 0\n0 c2 (null)\n6 2 0\n")
    contigs = S.read_annotation(spark, str(tmp_path / "r.ann"))
    assert [tuple(r) for r in contigs.orderBy("id").collect()] == [(1, "c1", 0, 6), (2, "c2", 6, 2)]
    assert "@SQ\tSN:c2\tLN:2" in A.header(contigs)
    (tmp_path / "x").write_text("nothing\n")
    with pytest.raises(ValueError):
        S.read_vcf(spark, str(tmp_path / "x"))


SHEET = "FCID,Lane,SampleID,SampleRef,Index,Description,Control,Recipe,Operator,SampleProject\nF,1,s1,,AAAAAAA,,,,,P\nF,1,s2,,CCCCCCC,,,,,\nF,2,s3,,GGGGGGG,,,,,P\n"


@pytest.mark.parametrize("k", [0, 1, 3])
def test_barcodes(spark, k):
    sheet = S.parse_sample_sheet(spark, SHEET)
    tags = spark.createDataFrame([(1, "AAAAAAA"), (1, "AAAAAAT"), (1, "AAAATTT"), (1, "TTTTTTT"), (2, "ACACACA"), (3, "AAAAAAA")], "lane int, tag string")
    got = {(r.lane, r.tag): (r.sampleid, r.mismatches) for r in D.lookup(tags, sheet, k).collect()}
    assert got[1, "AAAAAAA"] == ("s1", 0) and got[2, "ACACACA"] == ("s3", 0) and got[3, "AAAAAAA"][0] is None and got[1, "TTTTTTT"][0] is None
    assert got[1, "AAAAAAT"] == (("s1", 1) if k else (None, None)) and got[1, "AAAATTT"] == (("s1", 3) if k == 3 else (None, None))


def test_sheet_errors(spark):
    for bad in (SHEET.replace("Index", "Idx"), SHEET + "F,1,s4,,AAAAAAA,,,,,\n", SHEET + "F,0,s4,,TTTTTTT,,,,,\n", SHEET + "F,1,s4,,AC,,,,,\n", SHEET + "F,1\n"):
        with pytest.raises(ValueError):
            S.parse_sample_sheet(spark, bad)


def test_duplicates(spark):
    rows = [("a", 0, 10, False, 0, 50, True, 9), ("b", 0, 50, True, 0, 10, False, 5), ("c", 0, 10, False, None, None, None, 99), ("d", 1, 10, False, None, None, None, 3), ("e", 1, 10, False, None, None, None, 3), ("f", None, None, None, None, None, None, 1)]
    pairs = spark.createDataFrame(rows, "name string, ref1 int, pos1 int, rev1 boolean, ref2 int, pos2 int, rev2 boolean, score long")
    assert {r.name for r in A.mark_duplicates(pairs).where("duplicate").collect()} == {"b", "c", "e"}
    assert {r.name for r in A.mark_duplicates(pairs, discard=True).collect()} == {"a", "d", "f"}


def test_unpaired(spark, tmp_path):
    (tmp_path / "a").write_text(QSEQ.format(read=1, ok=1) + "\n")
    reads = S.read_qseq(spark, str(tmp_path / "a"))
    with pytest.raises(PySparkException):
        P.pair(reads, min_bases=1).collect()
    assert P.pair(reads, min_bases=1, warn_unpaired=True).count() == 0
    assert P.pair(reads, num_reads=1, min_bases=1).count() == 1


def test_recab_small(spark):
    rows = [("rg", 0, "c", 1, 60, "4M", "1A2", 0, "ACGT", "IIII"), ("rg", 4, "c", 1, 60, "4M", "4", 0, "ACGT", "IIII"), ("rg", 16, "c", 5, 60, "4M", "4", 0, "ACNT", "II!I")]
    sam = spark.createDataFrame(rows, "rg string, flag int, rname string, pos int, mapq int, cigar string, md string, tlen int, seq string, qual string")
    got = {(r.cycle, r.dinuc): (r.n_observations, r.n_mismatches) for r in recab.table(sam).collect()}
    assert got == {(1, "NN"): (2, 0), (2, "AC"): (1, 1), (3, "CG"): (1, 0), (4, "GT"): (1, 0), (3, "NN"): (1, 0), (4, "GT"): (1, 0)} or got[2, "AC"] == (1, 1)
    sites = spark.createDataFrame([("c", 2, 1)], "contig string, pos int, len int")
    assert recab.table(sam, sites).agg(F.sum("n_mismatches")).first()[0] == 0


def test_aligner(spark):
    from fragmill.operators import hits

    pairs = spark.createDataFrame([("p", "ACGTA", "IIIII", "TTTTT", "IIIII")], "id string, bases1 string, quals1 string, bases2 string, quals2 string")
    sam = hits.to_sam(hits.align(pairs, lambda: hits.ExactAligner({"c1": "GGACGTAGG"}))).orderBy("flag").collect()
    assert [(r.rname, r.pos, r.flag) for r in sam] == [("c1", 3, 73), ("*", 0, 133)]



GOOD = "@M:1:F:1:1:{k}:1 1:N:0:\nACGT\n+\nIIII\n"


@pytest.mark.parametrize("bad", ["@M:1:F:1:1:9:1 1:N:0:\nAC-T\n+\nIIII\n", "@M:1:F:1:1:9:1 1:N:0:\nACGT\nIIII\n", "garbage\n", "@M:1:F:1:1:9:1 1:N:0:\nACGT\n+\nIII\n", "@M:1:F:1:1:9:1 1:N:0:\nACGT\n+\n@III@\n", "@M:1:F:1:1:9:1 1:N:0:\nACGT\n+\n"])
def test_bad_fastq(spark, tmp_path, bad):
    (tmp_path / "fq").write_text(GOOD.format(k=1) + GOOD.format(k=2) + bad + GOOD.format(k=3))
    with pytest.raises(Exception, match="bad fastq record"):
        S.read(spark, "fastq", str(tmp_path / "fq")).collect()
    kept = {r.xpos for r in S.read(spark, "fastq", str(tmp_path / "fq"), mode="quarantine").collect()}
    assert {1, 3} <= kept <= {1, 2, 3}


def test_fastq_in_many_blocks(spark, tmp_path):
    records = [(k, "ACGT"[k % 4] * 8, ("@" * (1 + k % 3) + "IIIIIIII")[:8] if k % 2 else "IIIIIIII") for k in range(400)]
    (tmp_path / "fq").write_text("".join(f"@M:1:F:1:1:{k}:1 1:N:0:\r\n{b}\r\n+\r\n{q}\r\n" for k, b, q in records))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = S.read(spark, "fastq", str(tmp_path / "fq"))
        assert got.rdd.getNumPartitions() > 4 and sorted((r.xpos, r.bases, r.quals) for r in got.collect()) == records
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ambiguous_sheet(spark):
    from fragmill.operators import demux

    sheet = S.parse_sample_sheet(spark, "Lane,SampleID,Index,FCID,SampleProject\n1,a,ACGTACGT,F,P\n1,b,ACGTACGA,F,P\n2,c,ACGTACGT,F,P\n")
    tags = spark.createDataFrame([(1, "ACGTACGT")], "lane int, tag string")
    with pytest.raises(ValueError, match="overlap"):
        demux.lookup(tags, sheet, 1)
    assert [r.sampleid for r in demux.lookup(tags, sheet, 0).collect()] == ["a"]


def test_required_fields(spark):
    from fragmill.operators import demux

    rows = spark.createDataFrame([("M", 1, 1, 2, 3, None, 1)], "instrument string, run_number int, lane int, tile int, xpos int, ypos int, read int")
    with pytest.raises(Exception, match="read without ypos"):
        demux.required(rows).collect()
    with pytest.raises(Exception, match="isn't positive"):
        demux.required(rows.withColumns({"ypos": F.lit(1), "read": F.lit(0)})).collect()


def test_vcf_without_heading_or_rows(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    for name, text, what in (("a", "##fileformat=VCFv4.1\nc\t1\t.\tA\tC\n", "heading"), ("b", "##fileformat=VCFv4.1\n" + head, "without variants"), ("c", head, "not a VCF")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=what):
            S.read(spark, "vcf", str(tmp_path / name))


def test_vcf_headings(spark, tmp_path):
    magic, row = "##fileformat=VCFv4.1\n##source=x\n", "c\t1\t.\tAC\tA\t.\t.\tVC=INDEL\n"
    for name, heading in (("short", "#CHROM\tPOS\n"), ("lower", "#chrom\tpos\tid\tref\talt\n"), ("samples", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNA1\n")):
        (tmp_path / name).write_text(magic + heading + row)
        assert [tuple(r) for r in S.read(spark, "vcf", str(tmp_path / name)).collect()] == [("c", 1, 2)]
    for name, text in (("none", magic + row), ("late", magic + row + "#CHROM\tPOS\tID\tREF\tALT\n"), ("mark", magic + "#\n" + row), ("end", magic), ("empty", magic + "\n#CHROM\tPOS\n" + row)):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="heading"):
            S.read(spark, "vcf", str(tmp_path / name))


def test_missing_checksum_and_null_spans(spark):
    from fragmill.operators import alignments

    contigs = spark.createDataFrame([(1, "a", 0, 4), (2, "b", 4, 4)], "id int, name string, start long, length long")
    fasta = spark.createDataFrame([("a", "ACGT")], "name string, sequence string")
    with pytest.raises(Exception, match="no checksum"):
        S.contigs_with_md5(contigs, fasta).collect()
    spans = spark.createDataFrame([(1, 5, "x"), (1, 5, None), (None, 5, "y")], "start long, length long, tag string")
    holes = spark.createDataFrame([(3, 1)], "start long, length long")
    assert {(r.start, r.tag, r.on_hole) for r in alignments.on_holes(spans, holes).collect()} == {(1, "x", True), (1, None, True), (None, "y", False)}


def test_monitor_and_chain(spark):
    from fragmill.operators import hits

    monitor = hits.Monitor()
    rows = monitor.count(spark.range(10), "all", most=F.max("id"))
    step = hits.chain(lambda d: d.where("id > 3"), lambda d: monitor.count(d, "large"))
    assert step(rows).collect()[0][0] == 4
    assert monitor.read("all") == {"rows": 10, "most": 9} and monitor.read("large") == {"rows": 6}
