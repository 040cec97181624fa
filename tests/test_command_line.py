import pytest

from fragmill.__main__ import main

QSEQ = "M1\t7\t{lane}\t1101\t10\t{y}\t0\t{read}\t{bases}\t{quals}\t1"
SHEET = "FCID,Lane,SampleID,SampleRef,Index,Description,Control,Recipe,Operator,SampleProject\nF,1,s1,,AAAAAAA,,,,,P\nF,1,s2,,CCCCCCC,,,,,\n"
SAM = ["r1\t0\tc2\t2\t60\t4M\t*\t0\t0\tACGT\tIIII\tMD:Z:1A2\tRG:Z:g", "r2\t0\tc1\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\tMD:Z:4\tRG:Z:g", "r3\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII"]


def line(y, read, bases, lane=1):
    return QSEQ.format(lane=lane, y=y, read=read, bases=bases, quals="h" * len(bases))


def text(spark, path):
    return [r[0] for r in spark.read.text(str(path)).collect()]


@pytest.fixture
def reads(tmp_path):
    rows = [line(20, 1, "ACGT"), line(20, 2, "AAAAAAT"), line(20, 3, "TTTT"), line(30, 1, "GGGG"), line(30, 2, "CCCCCCC"), line(30, 3, "CCCC")]
    (tmp_path / "in").write_text("\n".join(rows) + "\n")
    (tmp_path / "sheet").write_text(SHEET)
    return tmp_path


def test_demux(spark, reads):
    main(["demux", "--sheet", str(reads / "sheet"), "--mismatches", "1", str(reads / "in"), str(reads / "out")], spark)
    got = {(str(f.parent.relative_to(reads / "out")), x.split("\t")[8]) for f in (reads / "out").rglob("part-*") for x in f.read_text().splitlines()}
    assert got == {("P/s1", "ACGT"), ("P/s1", "TTTT"), ("DefaultProject/s2", "GGGG"), ("DefaultProject/s2", "CCCC")}


def test_config(spark, reads):
    (reads / "c.ini").write_text("[DEFAULT]\ncompression = gzip\n[demux]\nmismatches: 1\nseparate-reads = true\n; a remark\n")
    main(["demux", "--config", str(reads / "c.ini"), "--sheet", str(reads / "sheet"), "--mismatches", "0", str(reads / "in"), str(reads / "out")], spark)
    assert {str(f.parent.relative_to(reads / "out")) for f in (reads / "out").rglob("part-*")} == {"unknown/1", "unknown/2", "DefaultProject/s2/1", "DefaultProject/s2/2"}
    assert list((reads / "out").rglob("*.gz"))


def test_prq(spark, tmp_path):
    (tmp_path / "in").write_text("\n".join([line(20, 1, "ACGT"), line(20, 2, "TTTT")]) + "\n")
    main(["prq", "--min-bases", "4", str(tmp_path / "in"), str(tmp_path / "out")], spark)
    assert text(spark, tmp_path / "out") == ["M1:7::1:1101:10:20#0\tACGT\tIIII\tTTTT\tIIII"]


def test_sort_and_merge(spark, tmp_path):
    (tmp_path / "in").write_text("\n".join(SAM) + "\n")
    (tmp_path / "ann").write_text("20 2 11\n0 c1 (null)\n0 10 0\n0 c2 (null)\n10 10 0\n")
    main(["read_sort", "--annotation", str(tmp_path / "ann"), str(tmp_path / "in"), str(tmp_path / "sorted")], spark)
    assert {x.split("\t")[0] for x in text(spark, tmp_path / "sorted")} == {"r1", "r2", "r3"}
    main(["merge_alignments", "--annotation", str(tmp_path / "ann"), "--read-group", "ID=g,SM=s", str(tmp_path / "in"), str(tmp_path / "merged")], spark)
    lines = (tmp_path / "merged").read_text().splitlines()
    main(["merge_alignments", "--annotation", str(tmp_path / "ann"), "--header-only", str(tmp_path / "in"), str(tmp_path / "head")], spark)
    assert [x.split("\t")[0] for x in (tmp_path / "head").read_text().splitlines()] == ["@HD", "@SQ", "@SQ", "@PG"]
    assert [x.split("\t")[0] for x in lines] == ["@HD", "@SQ", "@SQ", "@RG", "@PG", "r2", "r1", "r3"]


def test_recab(spark, tmp_path):
    (tmp_path / "in").write_text("\n".join(SAM) + "\n")
    main(["recab_table", str(tmp_path / "in"), str(tmp_path / "out")], spark)
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r.Cycle, r.Dinuc, r.nObservations, r.nMismatches) for r in rows} == {("1", "NN", "2", "0"), ("2", "AC", "2", "1"), ("3", "CG", "2", "0"), ("4", "GT", "2", "0")}


def test_lines(spark, tmp_path):
    (tmp_path / "in").write_text("b\t1\na\t2\nc\t0\n")
    main(["tsvsort", "--key", "2", str(tmp_path / "in"), str(tmp_path / "out")], spark)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert lines == ["c\t0", "b\t1", "a\t2"]


def test_usort_and_convert(spark, reads):
    main(["usort", str(reads / "in"), str(reads / "sorted")], spark)
    assert len(text(spark, reads / "sorted")) == 6
    main(["convert", "--input-format", "qseq", "--output-format", "fastq", str(reads / "in"), str(reads / "fq")], spark)
    assert sum(x == "+" for x in text(spark, reads / "fq")) == 6
    with pytest.raises(SystemExit):
        main(["convert", str(reads / "in"), str(reads / "x")], spark)
    with pytest.raises(SystemExit):
        main(["recab_table", "--vcf", "a", "--rod", "b", "in", "out"], spark)


def test_demux_outputs(spark, reads):
    main(["demux", "--sheet", str(reads / "sheet"), "--mismatches", "1", "--create-lane-content", "--output-format", "bdg", "-D", "spark.sql.shuffle.partitions=2", str(reads / "in"), str(reads / "out")], spark)
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(reads / "out" / "P"), str(reads / "out" / "DefaultProject")).collect()
    assert {(r.readName, tuple(s.bases for s in r.sequences)) for r in rows} == {("M1:7:1:1101:10:20", ("ACGT", "TTTT")), ("M1:7:1:1101:10:30", ("GGGG", "CCCC"))}
    assert (reads / "out" / "LaneContent.s1").read_text().splitlines() == ["0:s1", *(f"{k}:" for k in range(1, 8))]


def test_from_pairs_to_sam(spark, tmp_path):
    contig = "ACGTTGCAAGCTTAGGCTAACGATTCGGATCCAAGTTCGACTGATCGGCTAAGTC"
    other = contig[::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "ref").write_text(f">c1 x\n{contig[:20]}\n{contig[20:]}\n")
    quals = "I" * 16
    (tmp_path / "prq").write_text("\n".join(f"{n}\t{contig[:16]}\t{quals}\t{other[:16]}\t{q}" for n, q in (("a", quals), ("b", "H" * 16))) + "\n")
    main(["seqal", "--reference", str(tmp_path / "ref"), str(tmp_path / "prq"), str(tmp_path / "sam")], spark)
    got = {tuple(x.split("\t")[:9]) for x in text(spark, tmp_path / "sam")}
    at = str(len(contig) - 15)
    whole = str(len(contig) - 1 + 1)
    assert got == {("a", "99", "c1", "1", "60", "16M", "=", at, whole), ("a", "147", "c1", at, "60", "16M", "=", "1", f"-{whole}"), ("b", "1123", "c1", "1", "60", "16M", "=", at, whole), ("b", "1171", "c1", at, "60", "16M", "=", "1", f"-{whole}")}
    for name, back in (("bdg", "bdg2sam"), ("avo", "avo2sam")):
        main(["seqal", "--align-only", "--output-format", name, "--reference", str(tmp_path / "ref"), str(tmp_path / "prq"), str(tmp_path / name)], spark)
        main([back, str(tmp_path / name), str(tmp_path / back)], spark)
        assert {tuple(x.split("\t")[:9]) for x in text(spark, tmp_path / back)} == {(n, str(int(f) & ~1024), *rest) for n, f, *rest in got}
    main(["prq2fastq", str(tmp_path / "prq"), str(tmp_path / "fq")], spark)
    assert len(text(spark, tmp_path / "fq" / "2")) == 8
    main(["prq2bdg", str(tmp_path / "prq"), str(tmp_path / "fragments")], spark)
    assert {r.readName for r in spark.read.parquet(str(tmp_path / "fragments")).collect()} == {"a", "b"}


def test_run_directory(spark, tmp_path):
    from fragmill.plans.files import RUN_INFO, RUN_PARAMETERS

    (tmp_path / "RunInfo.xml").write_text(RUN_INFO)
    (tmp_path / "runParameters.xml").write_text(RUN_PARAMETERS.replace("<NumSwaths>3", "<NumSwaths>1").replace("Tile>16", "Tile>2").replace("Swath>16", "Swath>2"))
    with pytest.raises(SystemExit):
        main(["bcl2qseq", "--command", "echo", str(tmp_path), str(tmp_path / "out")], spark)
    (tmp_path / "Basecalling_Netcopy_complete_Read2.txt").write_text("")
    main(["bcl2qseq", "--command", "echo", str(tmp_path), str(tmp_path / "out")], spark)
    assert len(text(spark, tmp_path / "out")) == 8 * 2 * 2
    with pytest.raises(Exception, match="failed"):
        main(["bcl2qseq", "--command", "false", str(tmp_path), str(tmp_path / "no")], spark)


def test_workflow(spark, tmp_path):
    from fragmill.operators import hits

    contig = "ACGTTGCAAGCTTAGGCTAACGATTCGGATCCAAGTTCGACTGATCGGCTAAGTC"
    other = contig[::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "in").write_text("\n".join([line(20, 1, contig[:32]), line(20, 2, other[:32])]) + "\n")
    (tmp_path / "ann").write_text(f"{len(contig)} 1 11\n0 c1 (null)\n0 {len(contig)} 0\n")
    hits.workflow(spark, str(tmp_path / "in"), str(tmp_path / "ann"), lambda: hits.ExactAligner({"c1": contig}), str(tmp_path / "out.sam"))
    lines = (tmp_path / "out.sam").read_text().splitlines()
    assert [x.split("\t")[0] for x in lines[:3]] == ["@HD", "@SQ", "@PG"] and [x.split("\t")[3] for x in lines[3:]] == ["1", str(len(contig) - 31)]
