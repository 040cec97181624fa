"""The registered queries over the views, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions import reads as R
from fragmill.operators import alignments as A
from fragmill.operators import demux as D
from fragmill.operators import pairing as P
from fragmill.operators import recab
from fragmill.plans import views as V
from fragmill.sources import formats as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

READS, ALIGNED = V.reads_sql(), V.alignments_sql()
SHEET, INDEX, SITES = V.sheet_sql().replace("STRING", "VARCHAR"), V.index_sql(), V.SITES.format(part="part")
LOCATION = "concat_ws(':', instrument, run_number, lane, tile, xpos, ypos)"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- recalibration ---------------------------------------------------------------------------------------------------

BASES = f"""
WITH a AS ({ALIGNED}), kept AS (
  SELECT * FROM a WHERE (flag & 4) = 0 AND mapq NOT IN (0, 255) AND (flag & 1024) = 0 AND (flag & 512) = 0 AND (flag & 256) = 0),
b AS (
  SELECT rg, rname AS contig, ascii(substr(qual, i + 1, 1)) - 33 AS quality, substr(seq, i + 1, 1) AS base, (flag & 16) <> 0 AS rev, (flag & 128) <> 0 AS two, abs(tlen) AS isize, seq, i,
    CASE shape WHEN 0 THEN pos + i WHEN 1 THEN CASE WHEN i < 3 THEN -1 ELSE pos + i - 3 END
      WHEN 2 THEN CASE WHEN i < 10 THEN pos + i WHEN i < 12 THEN -1 ELSE pos + i - 2 END
      ELSE CASE WHEN i < 10 THEN pos + i ELSE pos + i + 3 END END AS ref,
    (shape = 0 AND i = 5) OR (shape = 1 AND i = 3) OR (shape = 3 AND i = 10) AS mismatch
  FROM kept, range(32) AS t(i)),
c AS (
  SELECT *, CASE WHEN rev THEN CASE WHEN i = 31 THEN 'N' ELSE translate(substr(seq, i + 2, 1), 'ACGT', 'TGCA') END
                 ELSE CASE WHEN i = 0 THEN 'N' ELSE substr(seq, i, 1) END END AS before
  FROM b WHERE ref > 0 AND base <> 'N' AND quality > 0
    AND NOT (isize > 0 AND isize < 32 AND CASE WHEN rev THEN i < 32 - isize ELSE i >= isize END)),
d AS (
  SELECT rg, CAST(quality AS INT) AS quality, CAST((CASE WHEN rev THEN 32 - i ELSE i + 1 END) * CASE WHEN two THEN -1 ELSE 1 END AS INT) AS cycle,
    CASE WHEN before = 'N' THEN 'NN' ELSE concat(before, CASE WHEN rev THEN translate(base, 'ACGT', 'TGCA') ELSE base END) END AS dinuc, contig, ref, mismatch
  FROM c)
"""
COUNTED = "SELECT rg, quality, cycle, dinuc, count(*) AS n_observations, CAST(sum(CAST(mismatch AS INT)) AS BIGINT) AS n_mismatches FROM d {where} GROUP BY ALL"
KNOWN = f"WHERE (contig, ref) NOT IN (SELECT contig, unnest(range(pos, pos + len)) FROM ({SITES}) AS s)"


def _empirical(smoothing: float, most: int) -> str:
    q = f"round_even(-10 * log10((n_mismatches + {smoothing}) / (n_observations + {smoothing}) + 1e-4), 0)"
    return f"SELECT *, CAST(CASE WHEN {q} > {most} THEN {most} WHEN {q} <= 0 THEN 1 ELSE {q} END AS INT) AS q_empirical FROM t"


def _recab_sql(where: str, smoothing: float = 0.0, most: int = 40) -> str:
    return f"{BASES}, t AS ({COUNTED.format(where=where)}) {_empirical(smoothing, most)}"


@query(_recab_sql(KNOWN))
def recab_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recab.table(V.alignments(spark, sf_dir), V.sites(spark, sf_dir))


@query(_recab_sql(""))
def recab_no_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recab.table(V.alignments(spark, sf_dir))


@query(_recab_sql("", 1.0, 30))
def recab_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recab.table(V.alignments(spark, sf_dir), smoothing=1.0, max_quality=30)


@query(
    f"""WITH r AS (SELECT CASE WHEN (flag & 4) <> 0 THEN 'Unmapped' WHEN mapq IN (0, 255) THEN 'MapQ' WHEN (flag & 1024) <> 0 THEN 'Duplicate' WHEN (flag & 512) <> 0 THEN 'FailedQC'
        WHEN (flag & 256) <> 0 THEN 'SecondaryAlignment' ELSE 'Used' END AS reason FROM ({ALIGNED}) AS a)
    SELECT name, count(reason) AS value FROM (VALUES ('Used'), ('Unmapped'), ('MapQ'), ('Duplicate'), ('FailedQC'), ('SecondaryAlignment')) AS n(name) LEFT JOIN r ON reason = name GROUP BY name"""
)
def recab_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recab.counters(V.alignments(spark, sf_dir))


# -- demultiplexing --------------------------------------------------------------------------------------------------


def _demux_sql(mismatches: int, separate: bool = False, only: str = "") -> str:
    part = ", '/', CAST(read AS VARCHAR)" if separate else ""
    return f"""
WITH sheet AS (SELECT *, count(*) OVER (PARTITION BY lane) AS n FROM ({SHEET}) AS s), i AS ({INDEX}),
found AS (SELECT {LOCATION.replace("lane", "i.lane")} AS location, i.bases AS tag, sampleid, sampleproject, fcid, CASE WHEN n = 1 THEN 0 ELSE hamming("index", i.bases) END AS mm
  FROM i LEFT JOIN sheet ON i.lane = sheet.lane AND (n = 1 OR hamming("index", i.bases) <= {mismatches})),
r AS (SELECT *, {LOCATION} AS location FROM ({READS}) AS q)
SELECT r.location, CAST(r.read AS INT) AS read, r.bases, tag AS index_seq, sampleid, CAST(mm AS INT) AS mismatches, CASE WHEN sampleid IS NULL THEN '' ELSE fcid END AS flowcell_id,
  CASE WHEN sampleid IS NULL THEN concat('unknown'{part}) ELSE concat(coalesce(nullif(sampleproject, ''), 'DefaultProject'), '/', replace(sampleid, ' ', '_'){part}) END AS destination
FROM r JOIN found ON r.location = found.location {only}"""


def _demux(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    out = D.demultiplex(V.multiplexed(spark, sf_dir), V.sheet(spark, sf_dir), **options)
    return out.select("location", "read", "bases", "index_seq", "sampleid", "mismatches", "flowcell_id", "destination")


@query(_demux_sql(0))
def demux_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demux(spark, sf_dir)


@query(_demux_sql(1))
def demux_mismatch1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demux(spark, sf_dir, mismatches=1)


@query(_demux_sql(1, separate=True))
def demux_separate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demux(spark, sf_dir, mismatches=1, separate_reads=True)


@query(_demux_sql(0, only="WHERE r.lane = 8"))
def demux_lone_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demux(spark, sf_dir).where("split(location, ':')[2] = '8'")


@query(_demux_sql(0, only="WHERE sampleid IS NULL"))
def demux_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demux(spark, sf_dir).where("sampleid is null")


@query(
    f"""WITH one AS (SELECT * FROM ({SHEET}) AS s WHERE lane = 8)
    SELECT {LOCATION.replace("lane", "r.lane")} AS location, CAST(read AS INT) AS read, sampleid, CASE WHEN sampleid IS NULL THEN 'unknown' ELSE concat(sampleproject, '/', sampleid) END AS destination
    FROM ({READS}) AS r LEFT JOIN one ON r.lane = one.lane"""
)
def demux_no_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = V.reads(spark, sf_dir).withColumn("index_seq", F.lit(None).cast("string"))
    return D.demultiplex(data, V.sheet(spark, sf_dir).where("lane = 8"), no_index=True).select("location", "read", "sampleid", "destination")


@query(f'SELECT a.lane, a."index" AS a, b."index" AS b FROM ({SHEET}) AS a JOIN ({SHEET}) AS b ON a.lane = b.lane AND a."index" < b."index" WHERE hamming(a."index", b."index") <= 4')
def demux_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ambiguous(V.sheet(spark, sf_dir), 2)


@query(f"""WITH s AS ({SHEET}) SELECT sampleid, CAST(lane AS INT) AS lane, concat(lane - 1, ':', CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.sampleid = n.sampleid AND s.lane = l.lane) THEN sampleid ELSE '' END) AS content FROM (SELECT DISTINCT sampleid FROM s) AS n, range(1, 9) AS l(lane)""")
def lane_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lane_content(V.sheet(spark, sf_dir))


@query(f"SELECT destination, count(*) AS n FROM ({_demux_sql(1)}) AS d GROUP BY destination")
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demux(spark, sf_dir, mismatches=1).groupBy("destination").agg(F.count("*").alias("n"))


# -- pairing ---------------------------------------------------------------------------------------------------------


def _pairs_cte(min_bases: int = 30, drop: bool = True) -> str:
    return f"""WITH r AS (SELECT *, {LOCATION} AS location, {"NOT filter_passed" if drop else "false"} AS failed,
        {"filter_passed AND" if drop else ""} length(replace(bases, 'N', '')) < {min_bases} AS short FROM ({READS}) AS q),
    g AS (SELECT location, count(*) AS n, sum(CAST(failed OR short AS INT)) AS bad, sum(CAST(failed AS INT)) AS n_failed, sum(CAST(short AS INT)) AS n_short,
        max(CASE WHEN read = 1 THEN bases END) AS bases1, max(CASE WHEN read = 1 THEN quals END) AS quals1,
        max(CASE WHEN read = 2 THEN bases END) AS bases2, max(CASE WHEN read = 2 THEN quals END) AS quals2,
        max(concat_ws(':', instrument, run_number, flowcell_id, lane, tile, xpos, ypos)) AS id,
        max(concat(instrument, '_', run_number, ':', concat_ws(':', lane, tile, xpos, ypos))) AS old_id FROM r GROUP BY location)"""


def _pairs_sql(min_bases: int = 30, drop: bool = True, name: str = "id") -> str:
    return f"{_pairs_cte(min_bases, drop)} SELECT concat({name}, '#0') AS id, bases1, quals1, bases2, quals2 FROM g WHERE n = 2 AND bad < 2"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reads(spark, sf_dir).withColumns({"index_seq": F.lit(None).cast("string"), "read_id": F.lit(None).cast("string")})


@query(_pairs_sql())
def prq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair(_reads(spark, sf_dir), warn_unpaired=True)


@query(_pairs_sql(32))
def prq_min_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair(_reads(spark, sf_dir), warn_unpaired=True, min_bases=32)


@query(_pairs_sql(30, drop=False))
def prq_failed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair(_reads(spark, sf_dir), warn_unpaired=True, drop_failed=False)


@query(_pairs_sql(30, name="old_id"))
def prq_traditional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair(_reads(spark, sf_dir), warn_unpaired=True, traditional_ids=True)


@query(f"""{_pairs_cte()} SELECT concat(id, '#0') AS id, bases1, quals1, CAST(NULL AS VARCHAR) AS bases2, CAST(NULL AS VARCHAR) AS quals2 FROM g JOIN r ON g.location = r.location AND read = 1 WHERE NOT failed AND NOT short""")
def prq_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair(_reads(spark, sf_dir).where("read = 1"), num_reads=1)


@query(
    f"""{_pairs_cte()} SELECT 'NotEnoughBases' AS name, CAST(sum(n_short) AS BIGINT) AS value FROM g UNION ALL SELECT 'FailedFilter', CAST(sum(n_failed) AS BIGINT) FROM g
    UNION ALL SELECT 'Dropped', CAST(coalesce(sum(CASE WHEN n = 2 AND bad = 2 THEN 2 END), 0) AS BIGINT) FROM g UNION ALL SELECT 'Unpaired', CAST(coalesce(sum(CASE WHEN n < 2 THEN n END), 0) AS BIGINT) FROM g"""
)
def prq_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_counters(_reads(spark, sf_dir))


@query(f"""SELECT {LOCATION} AS readName, min(instrument) AS instrument, string_agg(concat(bases, ' ', quals, ' ', CASE WHEN filter_passed THEN 'false' ELSE 'true' END), '|' ORDER BY read) AS sequences FROM ({READS}) AS r GROUP BY 1""")
def qseq_to_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("sequences", lambda s: F.concat_ws(" ", s["bases"], s["qualities"], s["failedVendorQualityChecks"].cast("string"))), "|")
    return P.fragments(_reads(spark, sf_dir)).select("readName", "instrument", text.alias("sequences"))


SHIFT = ", ".join(["'" + "".join(chr(33 + k) for k in range(63)).replace("'", "''") + "'", "'" + "".join(chr(64 + k) for k in range(63)) + "'"])


@query(f"""SELECT concat_ws(chr(9), instrument, run_number, lane, tile, xpos, ypos, 0, read, replace(bases, 'N', '.'), translate(quals, {SHIFT}), CAST(filter_passed AS INT)) AS line FROM ({READS}) AS r""")
def fragment_to_qseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fragment_reads(P.fragments(_reads(spark, sf_dir))).select(S.qseq_line().alias("line"))


# -- duplicates ------------------------------------------------------------------------------------------------------

ENDS = f"""SELECT concat('t', l_orderkey, '-', rn) AS name,
    CASE WHEN rn % 13 <> 0 THEN CAST(l_suppkey % 5 AS INT) END AS ref1, CASE WHEN rn % 13 <> 0 THEN CAST(l_partkey % 50 * 10 AS INT) END AS pos1, CASE WHEN rn % 13 <> 0 THEN l_linenumber % 2 = 0 END AS rev1,
    CASE WHEN l_orderkey % 4 <> 0 THEN CAST(l_orderkey % 3 AS INT) END AS ref2, CASE WHEN l_orderkey % 4 <> 0 THEN CAST(l_orderkey % 50 * 10 AS INT) END AS pos2, CASE WHEN l_orderkey % 4 <> 0 THEN l_linenumber % 3 = 0 END AS rev2,
    CAST(l_partkey % 100 AS BIGINT) AS score FROM ({{reads}}) AS r"""
MARKED = f"""
WITH p AS ({ENDS.format(reads=READS)}), k AS (SELECT *, coalesce(concat(lpad(CAST(ref1 AS VARCHAR), 3, '0'), ':', lpad(CAST(pos1 AS VARCHAR), 9, '0'), ':', CASE WHEN rev1 THEN 'R' ELSE 'F' END), '~') AS a,
    coalesce(concat(lpad(CAST(ref2 AS VARCHAR), 3, '0'), ':', lpad(CAST(pos2 AS VARCHAR), 9, '0'), ':', CASE WHEN rev2 THEN 'R' ELSE 'F' END), '~') AS b FROM (
      SELECT * REPLACE (CASE WHEN ref1 IS NULL THEN NULL ELSE pos1 END AS pos1) FROM p) AS q),
n AS (SELECT name, score, CASE WHEN ref1 IS NULL THEN '~' ELSE a END AS a, CASE WHEN ref2 IS NULL THEN '~' ELSE b END AS b FROM k),
o AS (SELECT name, score, least(a, b) AS e1, greatest(a, b) AS e2 FROM n),
full_ AS (SELECT name, row_number() OVER (PARTITION BY e1, substr(e2, 1, 13) ORDER BY score DESC, name) > 1 AS duplicate FROM o WHERE e2 <> '~'),
ends AS (SELECT e1 AS e FROM o WHERE e2 <> '~' UNION SELECT e2 FROM o WHERE e2 <> '~'),
lone AS (SELECT name, e1 IN (SELECT e FROM ends) OR row_number() OVER (PARTITION BY e1 ORDER BY score DESC, name) > 1 AS duplicate FROM o WHERE e2 = '~' AND e1 <> '~'),
marked AS (SELECT * FROM full_ UNION ALL SELECT * FROM lone UNION ALL SELECT name, false FROM o WHERE e1 = '~')
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENDS.format(reads=V.reads_sql("{l}")), l=V.lineitem(spark, sf_dir))


@query(f"{MARKED} SELECT name, duplicate FROM marked")
def dup_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mark_duplicates(_pairs(spark, sf_dir)).select("name", "duplicate")


@query(f"{MARKED} SELECT name FROM marked WHERE NOT duplicate")
def dup_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mark_duplicates(_pairs(spark, sf_dir), discard=True).select("name")


@query(f"SELECT qname, CAST(list_sum(list_transform(list_filter(string_split(qual, ''), lambda c: ascii(c) >= 48), lambda c: ascii(c) - 33)) AS BIGINT) AS score FROM ({ALIGNED}) AS a")
def map_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.alignments(spark, sf_dir).select("qname", R.map_score("qual").alias("score"))


@query(f"SELECT qname, CAST(CASE WHEN shape = 1 THEN pos - 3 ELSE pos END AS INT) AS left_pos, CAST(pos - 1 + CASE shape WHEN 0 THEN 32 WHEN 1 THEN 29 WHEN 2 THEN 30 ELSE 35 END AS INT) AS right_pos FROM ({ALIGNED}) AS a")
def untrimmed_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.alignments(spark, sf_dir).withColumn("ops", R.cigar_ops()).select("qname", R.untrimmed_left("ops", "pos").alias("left_pos"), R.untrimmed_right("ops", "pos").alias("right_pos"))


# -- sorting ---------------------------------------------------------------------------------------------------------

CONTIGS = [(k + 1, f"c{k}", k * 50_000, 50_000) for k in range(4)]


def _contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTIGS, "id int, name string, start long, length long")


PLACED = f"SELECT qname, flag, CASE WHEN rname = 'c4' THEN 9223372036854775807 ELSE CAST(substr(rname, 2) AS BIGINT) * 50000 + pos END AS coord FROM ({ALIGNED}) AS a"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.alignments(spark, sf_dir).select("qname", "flag", F.when(F.col("rname") == "c4", "*").otherwise(F.col("rname")).alias("rname"), "pos")


@query(PLACED)
def coordinate_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the sort, with the column that orders them."""
    return A.coordinate_sort(_placed(spark, sf_dir), _contigs(spark)).select("qname", "flag", "coord")


@query(f"SELECT bucket, count(*) AS n, min(coord) AS low FROM (SELECT *, CAST(CASE WHEN coord = 9223372036854775807 THEN 9 ELSE floor(coord / 22223.0) END AS INT) AS bucket FROM ({PLACED}) AS p) AS b GROUP BY bucket")
def coord_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = A.coordinate(_placed(spark, sf_dir), _contigs(spark))
    bucket = A.coordinate_bucket("coord", 200_000, 10)
    return placed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("coord").alias("low"))


TSV = "concat_ws(chr(9), o_orderpriority, o_orderstatus, o_orderkey)"


@query(f"SELECT {TSV} AS value, concat(o_orderpriority, o_orderkey) AS key FROM orders")
def tsv_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.table(spark, sf_dir, "orders").select(F.concat_ws("\t", "o_orderpriority", "o_orderstatus", "o_orderkey").alias("value"))
    return A.sort_lines(lines.withColumn("key", S.key_of("1,3")))


@query(f"SELECT lane, tile, CAST(read AS INT) AS read, CAST((lane - 1) * 96 + 2 * (floor(tile / 1000.0 - 1) * 48 + floor(tile / 100.0 % 10 - 1) * 16 + tile % 100 - 1) + read - 1 AS INT) AS part, count(*) AS n FROM ({READS}) AS r GROUP BY ALL")
def usort_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reads(spark, sf_dir).withColumn("part", A.flowcell_partition()).groupBy("lane", "tile", "read", "part").agg(F.count("*").alias("n"))


# -- conversions and scalar functions --------------------------------------------------------------------------------

def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat alignment records: mates by arithmetic on the order."""
    aligned = V.alignments(spark, sf_dir)
    c = F.col
    return aligned.select(
        F.concat("qname", F.lit("/1")).alias("readName"), F.lit(True).alias("readPaired"), R.has("flag", 64).alias("firstOfPair"), R.has("flag", 128).alias("secondOfPair"), (~R.has("flag", 4)).alias("readMapped"), (c("l_orderkey") % 3 != 0).alias("mateMapped"),
        (c("l_orderkey") % 2 == 0).alias("properPair"), R.has("flag", 16).alias("readNegativeStrand"), (c("l_orderkey") % 5 == 1).alias("mateNegativeStrand"), R.has("flag", 256).alias("secondaryAlignment"),
        c("rname").alias("contig"), (c("pos") - 1).alias("start"), (c("pos") + 31).alias("end"), "mapq", "cigar", F.when(c("l_orderkey") % 3 != 0, F.concat(F.lit("c"), c("l_orderkey") % 5)).alias("mateContig"), (c("l_orderkey") % 1000 * 30).cast("int").alias("mateStart"), (c("l_orderkey") % 1000 * 30 + 32).cast("int").alias("mateEnd"),
        c("seq").alias("sequence"), "qual", c("md").alias("mismatchingPositions"), F.concat(F.lit('{"NM":'), "shape", F.lit(',"XA":"x","AS":"ab"}')).alias("attributes"),
    )


FLAG = "CAST(1 + CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 0 END + (flag & 4) + CASE WHEN l_orderkey % 3 = 0 THEN 8 ELSE 0 END + (flag & 16) + CASE WHEN l_orderkey % 5 = 1 THEN 32 ELSE 0 END + (flag & 64) + (flag & 128) + (flag & 256) AS INT)"


@query(f"SELECT qname, {FLAG} AS flag FROM ({ALIGNED}) AS a")
def sam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flat_to_sam(_flat(spark, sf_dir)).select("qname", "flag")


_HERE, _THERE = "(CASE WHEN (flag & 16) <> 0 THEN pos + 31 ELSE pos - 1 END)", "(l_orderkey % 1000 * 30 + CASE WHEN l_orderkey % 5 = 1 THEN 32 ELSE 0 END)"


@query(
    f"""SELECT qname, {FLAG} AS flag, CASE WHEN (flag & 4) = 0 THEN rname ELSE '*' END AS rname, CASE WHEN (flag & 4) = 0 THEN pos ELSE 0 END AS pos, mapq, cigar,
    CASE WHEN l_orderkey % 3 = 0 THEN '*' WHEN concat('c', l_orderkey % 5) = rname THEN '=' ELSE concat('c', l_orderkey % 5) END AS rnext, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 1000 * 30 + 1 END AS INT) AS pnext,
    CAST(CASE WHEN (flag & 4) = 0 AND l_orderkey % 3 <> 0 AND concat('c', l_orderkey % 5) = rname THEN {_THERE} - {_HERE} + CASE WHEN {_THERE} >= {_HERE} THEN 1 ELSE -1 END ELSE 0 END AS INT) AS tlen,
    CASE WHEN (flag & 256) = 0 THEN seq ELSE '*' END AS seq, CASE WHEN (flag & 256) = 0 THEN qual ELSE '*' END AS qual, concat_ws(chr(9), concat('MD:Z:', md), 'AS:Z:ab', concat('NM:i:', shape), 'XA:A:x') AS tags_text FROM ({ALIGNED}) AS a"""
)
def sam_from_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flat_to_sam(_flat(spark, sf_dir)).withColumn("tlen", F.col("tlen").cast("int"))


_LEGEND = ", ".join(f"CASE WHEN (flag & {1 << k}) <> 0 THEN '{x}' ELSE '-' END" for k, x in enumerate(R.LEGEND))


@query(f"SELECT qname, concat({_LEGEND}) AS flags FROM ({ALIGNED}) AS a")
def flag_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.alignments(spark, sf_dir).select("qname", R.flag_text("flag").alias("flags"))


@query(f"SELECT qname, CAST(flag & 2005 AS INT) AS flag, nullif(abs(tlen), 0) AS template_length FROM ({ALIGNED}) AS a")
def remove_mate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.alignments(spark, sf_dir).select("qname", A.remove_mate().alias("flag"), R.template_length().alias("template_length"))


HITS = f"SELECT a.qname AS name, a.flag AS flag1, a.mapq AS mapq1, b.flag AS flag2, b.mapq AS mapq2 FROM ({ALIGNED}) AS a JOIN ({ALIGNED}) AS b ON a.l_orderkey = b.l_orderkey AND a.rn % 2 = 1 AND b.rn = a.rn + 1"


@query(
    f"""WITH h AS ({HITS}), g AS (SELECT *, (flag1 & 4) <> 0 OR mapq1 < 20 AS g1, (flag2 & 4) <> 0 OR mapq2 < 20 AS g2 FROM h)
    SELECT name, CASE WHEN NOT g1 THEN CASE WHEN g2 THEN flag1 & 2005 ELSE flag1 END END AS flag1, CASE WHEN NOT g1 THEN mapq1 END AS mapq1,
      CASE WHEN NOT g2 THEN CASE WHEN g1 THEN flag2 & 2005 ELSE flag2 END END AS flag2, CASE WHEN NOT g2 THEN mapq2 END AS mapq2 FROM g WHERE NOT (g1 AND g2)"""
)
def hit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.alignments(spark, sf_dir).select("l_orderkey", "rn", "qname", "flag", "mapq")
    first = a.where("rn % 2 = 1").select("l_orderkey", "rn", F.col("qname").alias("name"), F.col("flag").alias("flag1"), F.col("mapq").alias("mapq1"))
    second = a.where("rn % 2 = 0").select("l_orderkey", (F.col("rn") - 1).alias("rn"), F.col("flag").alias("flag2"), F.col("mapq").alias("mapq2"))
    return A.filter_hits(first.join(second, ["l_orderkey", "rn"]).drop("l_orderkey", "rn"), min_mapq=20)


@query(f"SELECT l_orderkey, rn, translate(quals, {SHIFT}) AS illumina, quals AS sanger FROM ({READS}) AS r")
def quality_reencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.reads(spark, sf_dir).select("l_orderkey", F.col("rn").cast("long").alias("rn"), R.reencode("quals", R.SANGER, R.ILLUMINA).alias("illumina"))
    return df.withColumn("sanger", R.reencode("illumina"))


@query(f"SELECT l_orderkey, rn, reverse(translate(bases, 'ACGTN', 'TGCAN')) AS bases FROM ({READS}) AS r")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reads(spark, sf_dir).select("l_orderkey", F.col("rn").cast("long").alias("rn"), R.reverse_complement("bases").alias("bases"))


@query(f"""SELECT DISTINCT "index", concat(substr("index", 1, i - 1), b, substr("index", i + 1)) AS near FROM ({SHEET}) AS s, range(1, 9) AS p(i), (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) AS l(b)""")
def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sheet(spark, sf_dir).select("index", F.explode(R.substitutions("index", 1)).alias("near"))


@query(f"""SELECT l_orderkey, rn, CASE WHEN regexp_matches(quals, '[!-:]') THEN 'sanger' WHEN regexp_matches(quals, '[J-~]') THEN 'illumina' ELSE 'unknown' END AS encoding FROM ({READS}) AS r""")
def fq_format_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reads(spark, sf_dir).select("l_orderkey", F.col("rn").cast("long").alias("rn"), R.guess_encoding("quals").alias("encoding"))


@query(f"SELECT a.qname, a.rname AS rname_a, a.pos AS pos_a, a.flag AS flag_a, a.rname AS rname_b, CAST(CASE WHEN l_orderkey % 3 = 0 THEN pos + 1 ELSE pos END AS INT) AS pos_b, flag AS flag_b, CAST((rn - 1) % 2 + 1 AS INT) AS read_num FROM ({ALIGNED}) AS a WHERE l_orderkey % 3 = 0")
def aligner_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = V.alignments(spark, sf_dir).withColumn("read_num", ((F.col("rn") - 1) % 2 + 1).cast("int"))
    b = a.withColumn("pos", F.when(F.col("l_orderkey") % 3 == 0, F.col("pos") + 1).otherwise(F.col("pos")))
    return A.compare(a, b)


HOLES = "SELECT CAST(n_nationkey * 1500 + 7 AS BIGINT) AS start, CAST(n_nationkey * 10 + 1 AS BIGINT) AS length FROM nation"


@query(f"SELECT start, length, EXISTS (SELECT 1 FROM ({HOLES}) AS h WHERE s.start < h.start + h.length AND h.start < s.start + s.length) AS on_hole FROM (SELECT DISTINCT CAST(pos AS BIGINT) AS start, CAST(32 AS BIGINT) AS length FROM ({ALIGNED}) AS a) AS s")
def hole_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.alignments(spark, sf_dir).select(F.col("pos").cast("long").alias("start"), F.lit(32).cast("long").alias("length")).distinct()
    holes = V.table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 1500 + 7).cast("long").alias("start"), (F.col("n_nationkey") * 10 + 1).cast("long").alias("length"))
    return A.on_holes(spans, holes)


@query("SELECT n_name AS name, md5(concat(n_name, n_regionkey)) AS md5 FROM nation")
def contig_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contig_md5(V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", "n_regionkey").alias("sequence")))


@query(f"""SELECT qname, concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, '*', 0, tlen, seq, qual, concat('MD:Z:', md), concat('RG:Z:', rg)) AS line, md, rg, CAST(length(seq) AS INT) AS n FROM ({ALIGNED}) AS a""")
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(*(x for n in ("MD", "RG") for x in (F.lit(n), F.struct(F.lit("Z").alias("type"), F.col(n.lower()).alias("value")))))
    rows = V.alignments(spark, sf_dir).withColumns({"rnext": F.lit("*"), "pnext": F.lit(0), "tags": tags})
    # a generator's lines are made once, where the filter on them would make them a second time
    lines = rows.select(F.explode(F.array(S.sam_line())).alias("value"))
    parsed = S.parse_sam(lines)
    return parsed.select("qname", S.sam_line().alias("line"), S.tag("MD").alias("md"), S.tag("RG").alias("rg"), F.length("seq").alias("n"))


from fragmill.plans import files  # noqa: E402, F401  (registers the queries on files)
