"""How much work plans do: what is shuffled, how often input is read, what is computed once."""

import random
import re
import uuid
from pathlib import Path

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fragmill.functions import reads as R
from fragmill.operators import alignments as A
from fragmill.operators import demux as D
from fragmill.operators import hits as H
from fragmill.operators import pairing as P
from fragmill.operators import recab
from fragmill.plans import catalogue
from fragmill.plans import views as V
from fragmill.sources import formats as S

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_reads_are_numbered_while_narrow(spark):
    """What is hashed into bases and qualities is shuffled, not these."""
    for view in (V.reads, V.alignments):
        above = plan(view(spark, DATA)).split("Exchange hashpartitioning")[0]
        assert above.count("md5(") >= 2


def test_pairs_of_numbered_reads_need_no_shuffle_of_their_own(spark):
    assert shuffles(catalogue.QUERIES["prq_pairs"](spark, DATA)) == 1


def test_pairs_are_computed_once(spark, tmp_path):
    def named(frames):
        for frame in frames:
            yield pd.DataFrame({"id": [uuid.uuid4().hex for _ in range(len(frame))], "bases1": "AC", "quals1": "II", "bases2": "GT", "quals2": "II"})

    pairs = spark.range(20).mapInPandas(named, "id string, bases1 string, quals1 string, bases2 string, quals2 string")
    first, second = str(tmp_path / "a"), str(tmp_path / "b" / "c")
    S.write_pair_fastq(pairs, first, second)
    names = [[r.read_id for r in S.read_fastq(spark, path).collect()] for path in (first, second)]
    assert len(names[0]) == 20
    assert [n[:-2] for n in names[0]] == [n[:-2] for n in names[1]]
    with pytest.raises(FileExistsError):
        S.write_pair_fastq(pairs, str(tmp_path / "d"), second)


def test_no_pairs(spark, tmp_path):
    pairs = spark.createDataFrame([], "id string, bases1 string, quals1 string, bases2 string, quals2 string")
    S.write_pair_fastq(pairs, str(tmp_path / "a"), str(tmp_path / "b"))
    assert S.read_fastq(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 0


def test_fastq_is_read_three_times_at_most(spark, tmp_path):
    (tmp_path / "x").write_text("@a/1\nAC\n+\n@I\n@b/1\nACG\n+\nIII\n")
    assert plan(S.read_fastq(spark, str(tmp_path / "x"))).count("FileScan text") <= 3


@pytest.mark.parametrize("text", ["@a\nAC\n+\n", "@a\nAC\n+\nII\n@b\nA1\n+\n@I\n", "@a\nAC\n+\n@III\n", "@a\nAC\n+\nII\n@x\n", "@a\nAC\n\nII\n", "@a\nAC\n+\nII\nII\n"])
def test_bad_fastq_still_raises(spark, tmp_path, text):
    (tmp_path / "x").write_text(text)
    with pytest.raises(PySparkException):
        S.read_fastq(spark, str(tmp_path / "x")).collect()
    good = S.read_fastq(spark, str(tmp_path / "x"), mode="quarantine").collect()
    assert {r.read_id for r in good} <= {"a"}


def test_ids_of_both_kinds(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"@M1:7::1:1101:-5:20 2:Y:0:ACG\r\nAC.\r\n+\r\n@@I\r\n@M1:7:FC:1:1101:5:20\nACG\n+x\nIII\n@x y/2\nA\n+\nI\n\n")
    rows = {r.read_id: r for r in S.read_fastq(spark, str(tmp_path / "x")).collect()}
    a, b, c = (rows[n] for n in ("M1:7::1:1101:-5:20 2:Y:0:ACG", "M1:7:FC:1:1101:5:20", "x y/2"))
    assert (a.instrument, a.run_number, a.flowcell_id, a.xpos, a.ypos, a.read, a.filter_passed, a.index_seq, a.bases, a.quals) == ("M1", 7, None, -5, 20, 2, False, "ACG", "ACN", "@@I")
    assert (b.instrument, b.flowcell_id, b.lane, b.ypos, b.read, b.filter_passed) == ("M1", "FC", 1, 20, None, None)
    assert (c.instrument, c.read, c.bases) == (None, 2, "A")


def test_pairs_by_place_and_by_name(spark):
    row = lambda read, read_id=None, instrument="M1", bases="ACGT": (instrument, 1, None, 1, 2, 3, 4, None, read, bases, "IIII", True, read_id)
    schema = "instrument string, run_number int, flowcell_id string, lane int, tile int, xpos int, ypos int, index_seq string, read int, bases string, quals string, filter_passed boolean, read_id string"
    reads = spark.createDataFrame([row(2, bases="TTTT"), row(1), row(1, "n/1", None), row(2, "n/2", None, "GGGG")], schema)
    assert sorted((r.id, r.bases1, r.bases2) for r in P.pair(reads, min_bases=1).collect()) == [("M1:1::1:2:3:4#0", "ACGT", "TTTT"), ("n", "ACGT", "GGGG")]
    with pytest.raises(PySparkException, match="too many"):
        P.pair(reads.union(spark.createDataFrame([row(1)], schema)), min_bases=1).collect()


SAM = "rg string, flag int, rname string, pos int, mapq int, tlen int, seq string, qual string, cigar string, md string"
SHAPES = [("8M", "8"), ("8M", "0A3C3"), ("2S6M", "6"), ("3M2I3M", "1T4"), ("4M2D4M", "4^AC0G3"), ("4M1S", "4"), ("10M", "10"), ("*", "0"), ("1M3D1I2M", "1^AAA2"), ("7S", "0")]


def alignments(spark, n=400):
    dice = random.Random(5)
    rows = []
    for _ in range(n):
        long = dice.choice([1, 5, 8, 8, 8, 12])
        cigar, md = dice.choice(SHAPES)
        rows.append((dice.choice(["a", "b", "c"]), dice.choice([0, 16, 128, 144, 1, 4, 1024]), dice.choice(["c0", "c1", None]), dice.choice([-3, 1, 2, 5, 50, None]), dice.choice([0, 30, 255, 9]), dice.choice([None, 0, 3, -5, 8, 200]),
            "".join(dice.choice("ACGTNa") for _ in range(long)), "".join(dice.choice("!#5I~") for _ in range(long)), cigar, md))
    return spark.createDataFrame(rows, SAM)


@pytest.mark.parametrize("known", [None, [("c0", 3, 2), ("c1", 50, 1), ("c0", -1, 3), ("c9", 7, 1), (None, 5, 1)], [], [("c0", 4, 1), ("c1", 2**30, 1)]])
def test_counted_by_batches_as_by_rows(spark, known):
    sam = alignments(spark)
    variants = None if known is None else spark.createDataFrame(known, "contig string, pos int, len int")
    plain = ["rg", "quality", "cycle", "dinuc", "reverse", "second"]
    slow = recab.table(sam, variants, covariates=(*plain, ("x", F.col("ref") * 0))).drop("x")
    fast = recab.table(sam, variants, covariates=plain)
    assert "Generate" in plan(slow) and "Generate" not in plan(fast)
    assert fast.schema.simpleString() == slow.schema.simpleString()
    rows = sorted(map(tuple, fast.collect()))
    assert len(rows) > 50 and rows == sorted(map(tuple, slow.collect()))


def test_many_tuples_at_once(spark, monkeypatch):
    sam = alignments(spark).coalesce(1)
    whole = sorted(map(tuple, recab.table(sam).collect()))
    count = recab._count
    for name, n in (("BASES_AT_ONCE", 64), ("TUPLES_LIMIT", 20)):
        monkeypatch.setattr(recab, name, n)
    reads = recab._taking_part(sam, None).toArrow().to_batches()
    parts = [b for b in count(None)(iter(reads))]
    assert len(parts) > 3
    back = spark.createDataFrame(pd.concat([b.to_pandas() for b in parts]))
    assert back.agg(F.sum("n_observations")).first()[0] == sum(r[4] for r in whole)
    assert back.select("rg", "quality", "cycle", "dinuc").distinct().count() == len(whole)


@pytest.mark.parametrize("cigar, md", [("4M", None), ("4M", "3"), ("4Q", "4"), ("2M2N2M", "4"), (None, "4"), ("4M", "4A")])
def test_bad_alignments_raise(spark, cigar, md):
    with pytest.raises(PySparkException):
        recab.table(spark.createDataFrame([("a", 0, "c", 5, 9, 0, "ACGT", "IIII", cigar, md)], SAM)).collect()


def test_csv_is_written_in_one_task_but_not_counted_in_one(spark, tmp_path):
    counted = spark.range(100).repartition(4).select(*(F.lit(k).alias(f"c{k}") for k in range(6)), F.spark_partition_id().alias("part"))
    recab.write_csv(counted, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), header=True)
    assert back.select("Qempirical").distinct().count() == 4 and len(list((tmp_path / "t").glob("part-*"))) == 1


def counted(contigs, log):
    """An aligner that notes the pairs that it gets in a file."""

    class Counted(H.ExactAligner):
        def hits(self, pairs):
            with open(log, "a") as out:
                out.write("x\n" * len(pairs))
            return H.ExactAligner.hits(self, pairs)

    return lambda: Counted(contigs)


CONTIG = "ACGTTGCAAGGCTTACGATCCGATTAGGCATCAGTTACGGCATGCCATTGACCTGA"


def test_pairs_are_aligned_once(spark, tmp_path):
    log, contigs = str(tmp_path / "log"), {"c": CONTIG}
    pairs = spark.createDataFrame([(f"p{k}", CONTIG[3:19], "I" * 16, (CONTIG[30:46] if k % 3 else None), ("I" * 16 if k % 3 else None)) for k in range(30)], "id string, bases1 string, quals1 string, bases2 string, quals2 string")
    found = H.seqal(pairs, counted(contigs, log))
    rows = found.collect()
    assert open(log).read().count("x") == 30
    assert len(rows) == 30 and sum(not r.duplicate for r in rows) == 1
    assert H.seqal(pairs, lambda: H.ExactAligner(contigs), discard=True).count() == 1


def test_variants_are_aligned_once(spark, tmp_path):
    log = str(tmp_path / "log")
    masks = spark.createDataFrame([("v", f"{CONTIG[:12]}[{CONTIG[12]}/N]{CONTIG[13:25]}"), ("w", "NNN[A/C]NNN")], "vid string, mask string")
    rows = {r.vid: r for r in H.snp_places(masks, H.align(H.snp_pairs(masks), counted({"c": CONTIG}, log)), "hg").collect()}
    assert open(log).read().count("x") == 4
    assert (rows["v"].pos, rows["v"].copies, rows["w"].copies) == (13, 1, 0)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_duplicates_by_the_best_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "BEST_LIMIT", limit)
    dice = random.Random(3)
    end = lambda: (dice.choice(["c", "d"]), dice.choice([1, 2]), dice.choice([True, False])) if dice.random() < 0.7 else (None, None, None)
    rows = [(k, f"n{k:03}", *end(), *end(), dice.choice([5, 6, None])) for k in range(300)]
    pairs = spark.createDataFrame(rows, "row long, name string, ref1 string, pos1 int, rev1 boolean, ref2 string, pos2 int, rev2 boolean, score long")
    whole = {r.row: r.duplicate for r in A.mark_duplicates(pairs).collect()}
    assert len(whole) == 300 and 20 < sum(whole.values()) < 290
    assert {r.row: r.duplicate for r in A.mark_duplicates(pairs, row="row").collect()} == whole
    assert {r.row for r in A.mark_duplicates(pairs, discard=True).collect()} == {k for k, d in whole.items() if not d}


def test_same_rows_have_one_best(spark):
    pairs = spark.createDataFrame([(k, "n", "c", 1, True, "c", 9, False, 5) for k in range(4)], "row long, name string, ref1 string, pos1 int, rev1 boolean, ref2 string, pos2 int, rev2 boolean, score long")
    assert sum(not r.duplicate for r in A.mark_duplicates(pairs, row="row").collect()) == 1


def test_reads_of_a_place_meet_once(spark):
    """Numbered reads are demultiplexed, counted and made fragments without another shuffle of reads."""
    found = D.demultiplex(V.multiplexed(spark, DATA), V.sheet(spark, DATA), mismatches=1)
    assert shuffles(found.select("location", "read", "bases", "quals", "sampleid", "mismatches")) <= 3  # the sheet is numbered by lane, for lanes of one sample and of several
    assert plan(D.demux_fragments(found)).count("FileScan parquet") == plan(found).count("FileScan parquet")
    assert plan(D.demux_counters(found)).count("lineitem.parquet") == 1


def test_two_index_reads_of_a_place(spark):
    """Data reads come once for each index read of their place, and without one they come with nulls."""
    row = lambda read, ypos, bases: ("M1", 1, None, 1, 2, 3, ypos, read, bases, "I" * len(bases), True, None)
    schema = "instrument string, run_number int, flowcell_id string, lane int, tile int, xpos int, ypos int, read int, bases string, quals string, filter_passed boolean, index_seq string"
    reads = spark.createDataFrame([row(1, 1, "AC"), row(2, 1, "AAAAAAAA"), row(2, 1, "CCCCCCCC"), row(3, 1, "GT"), row(1, 2, "AC")], schema)
    sheet = spark.createDataFrame([("f", 1, "s", "AAAAAAAA", "p"), ("f", 1, "t", "GGGGGGGG", "p")], "fcid string, lane int, sampleid string, index string, sampleproject string")
    found = D.demultiplex(reads, sheet, mismatches=1)
    rows = sorted((r.ypos, r.read, r.index_seq or "", r.sampleid or "", r.mismatches, r.destination) for r in found.collect())
    assert rows == [(1, 1, "AAAAAAAA", "s", 0, "p/s"), (1, 1, "CCCCCCCC", "", None, "unknown"), (1, 2, "AAAAAAAA", "s", 0, "p/s"), (1, 2, "CCCCCCCC", "", None, "unknown"), (2, 1, "", "", None, "unknown")]
    assert sorted((r.destination, r.readName, [s.bases for s in r.sequences]) for r in D.demux_fragments(found).collect()) == [("p/s", "M1:1:1:2:3:1", ["AC", "GT"]), ("unknown", "M1:1:1:2:3:1", ["AC", "GT"]), ("unknown", "M1:1:1:2:3:2", ["AC"])]
    counts = {(r.group, r.name): r.value for r in D.demux_counters(found).collect()}
    assert counts == {("p/s", "reads"): 2, ("p/s", "bases"): 4, ("unknown", "reads"): 3, ("unknown", "bases"): 6, ("barcode mismatches", "0"): 2}


def test_lines_are_made_once_before_they_are_parsed(spark):
    assert plan(catalogue.QUERIES["sam_round_trip"](spark, DATA)).count("map_entries(") == 2  # for what is parsed, and for what is returned


def test_expression_is_packed_once(spark):
    df = spark.createDataFrame([("ACGTNACGTACGTACGTAC",), ("",), ("T",)], "b string").select("b", R.pack_bases("replace(b, 'N', 'A')").alias("p"))
    assert plan(df).count("replace(b") == 1
    rows = {r.b: (r.p.n, r.p.packed.hex()) for r in df.collect()}
    assert rows == {"ACGTNACGTACGTACGTAC": (19, "1b06c6c6c4000000"), "": (0, ""), "T": (1, "c0000000")}
    assert [r.x for r in df.select(R.unpack_bases("p").alias("x")).collect()] == ["ACGTAACGTACGTACGTAC", "", "T"]


def test_reads_of_both_files_are_made_once(spark, monkeypatch):
    calls, write = [], S.write
    monkeypatch.setattr(S, "write", lambda *a, **k: (calls.append(a[1]), write(*a, **k)))
    assert catalogue.QUERIES["multi_qseq"](spark, DATA).count() > 100
    assert calls == ["qseq"]


def test_merged_file_of_compressed_parts(spark, tmp_path, monkeypatch):
    parts, whole = [], S.concatenate
    monkeypatch.setattr(S, "concatenate", lambda spark, folder, *a, **k: (parts.extend(Path(folder).glob("part-?*")), whole(spark, folder, *a, **k)))
    lines = spark.range(1000).orderBy("id").select(F.concat(F.lit("line "), "id").alias("value")).repartitionByRange(3, "value")
    A.write_merged(spark, "@HD\n", lines, str(tmp_path / "x"))
    text = (tmp_path / "x").read_text().splitlines()
    assert text[0] == "@HD" and sorted(text[1:]) == sorted(f"line {k}" for k in range(1000))
    assert len(parts) == 3 and all(p.suffix == ".gz" for p in parts)


@pytest.mark.parametrize("line, good", [("a\t0\t*\t0\t0\t*\t*\t0\t0\tAC\tII", True), ("a\t0\t*\t0\t0\t*\t*\t0\t0\tAC\tI", False), ("a\t0\t*\t0\t0\t*\t*\t0\t0\tAC", False), ("a\t0\t*\t0\t0\t*\t*\t0\t0\t*\tI\tXA:A:x", True)])
def test_sam_lines_are_still_checked(spark, line, good):
    lines = spark.createDataFrame([("@HD\tVN:1",), (line,)], "value string")
    assert S.parse_sam(lines, "quarantine").count() == good
    if good:
        assert [r.l for r in S.parse_sam(lines).select(S.sam_line().alias("l")).collect()] == [line]
    else:
        with pytest.raises(PySparkException, match="bad SAM line"):
            S.parse_sam(lines).collect()
