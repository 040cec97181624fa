"""Deterministic sequencing views over the TPC-H-like tables: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 32 bases, 1 in 16 unknown, Phred+33. Rows are numbered inside an order by columns that are unique.
READS = """
SELECT instrument, 1 AS run_number, 'FC1' AS flowcell_id, lane, tile, xpos, CAST(floor((rn - 1) / 2) AS INT) AS ypos,
       CAST((rn - 1) % 2 + 1 AS INT) AS read, bases, quals, filter_passed, l_suppkey, l_partkey, l_orderkey, rn, l_linenumber
FROM (
  SELECT concat('M', l_orderkey % 4) AS instrument, CAST(l_orderkey % 8 + 1 AS INT) AS lane, CAST(1101 + l_orderkey % 12 AS INT) AS tile,
         CAST(l_orderkey AS INT) AS xpos, l_returnflag <> 'R' AS filter_passed, l_suppkey, l_partkey, l_orderkey, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
         translate(md5(concat(l_orderkey, '-', l_linenumber)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS bases,
         translate(md5(concat(l_linenumber, '-', l_orderkey)), '0123456789abcdef', '#+3;CK5ABDEFGHI!') AS quals
  FROM {lineitem}) AS numbered
"""

#: Four shapes of alignment, by line number; flags, mapping qualities and insert sizes that make every filter work.
ALIGNMENTS = """
SELECT concat('q', l_orderkey, '-', rn) AS qname, concat('rg', l_suppkey % 3) AS rg, concat('c', l_suppkey % 5) AS rname,
       CAST(l_partkey % 1000 * 40 + 1 AS INT) AS pos, CAST(l_partkey % 61 AS INT) AS mapq, bases AS seq, quals AS qual,
       CAST(1 + CASE WHEN l_linenumber % 3 = 0 THEN 16 ELSE 0 END + CASE WHEN rn % 2 = 0 THEN 128 ELSE 64 END
         + CASE WHEN l_orderkey % 17 = 0 THEN 4 ELSE 0 END + CASE WHEN l_orderkey % 19 = 0 THEN 1024 ELSE 0 END
         + CASE WHEN l_orderkey % 23 = 0 THEN 512 ELSE 0 END + CASE WHEN l_orderkey % 29 = 0 THEN 256 ELSE 0 END AS INT) AS flag,
       CAST(CASE WHEN l_orderkey % 5 = 0 THEN 20 WHEN l_orderkey % 7 = 0 THEN -25 ELSE 200 END AS INT) AS tlen,
       CASE l_linenumber % 4 WHEN 0 THEN '32M' WHEN 1 THEN '3S29M' WHEN 2 THEN '10M2I20M' ELSE '10M3D22M' END AS cigar,
       CASE l_linenumber % 4 WHEN 0 THEN '5A26' WHEN 1 THEN '0C28' WHEN 2 THEN '30' ELSE '10^ACG0T21' END AS md,
       CAST(l_linenumber % 4 AS INT) AS shape, l_orderkey, rn
FROM ({reads}) AS r
"""

SITES = "SELECT concat('c', p_partkey % 5) AS contig, CAST(p_partkey % 1000 * 40 + p_partkey % 37 AS INT) + 1 AS pos, CAST(p_partkey % 3 + 1 AS INT) AS len FROM {part}"

#: Barcodes of eight letters from suppliers; the last lane has one sample, the index read of a read's supplier has substitutions.
SHEET = """
SELECT 'FC9' AS fcid, CAST(s_suppkey % 7 + 1 AS INT) AS lane, concat('S ', s_suppkey) AS sampleid, CAST(NULL AS STRING) AS sampleref,
       substr(translate(md5(concat('bc', s_suppkey)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8) AS "index",
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('P', s_suppkey % 4) END AS sampleproject
FROM {supplier} WHERE s_suppkey <= 40
UNION ALL SELECT 'FC9', 8, 'alone', NULL, 'ACGTACGT', 'P9'
"""

_BARCODE = "substr(translate(md5(concat('bc', (l_orderkey % 6) * 7 + l_orderkey % 8)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8)"
_INDEX = "CASE WHEN xpos % 11 = 0 THEN 'GGGGGGGG' WHEN xpos % 7 = 0 THEN concat('NN', substr(bc, 3)) WHEN xpos % 5 = 0 THEN concat('N', substr(bc, 2)) ELSE bc END"
INDEX_READS = f"""
SELECT DISTINCT instrument, run_number, lane, tile, xpos, ypos,
       {_INDEX} AS bases
FROM (SELECT r.*, {_BARCODE} AS bc FROM ({{reads}}) AS r) AS t
"""

#: READS as Spark runs it: rows are numbered while they are narrow, and by the place of their cluster, which is an order's,
#: so what is brought together by place afterwards needs no shuffle of its own. Sequences are made after that.
PLACED_READS = """
SELECT instrument, 1 AS run_number, 'FC1' AS flowcell_id, lane, tile, xpos, CAST(floor((rn - 1) / 2) AS INT) AS ypos, CAST((rn - 1) % 2 + 1 AS INT) AS read,
       translate(md5(concat(l_orderkey, '-', l_linenumber)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS bases,
       translate(md5(concat(l_linenumber, '-', l_orderkey)), '0123456789abcdef', '#+3;CK5ABDEFGHI!') AS quals,
       l_returnflag <> 'R' AS filter_passed, l_suppkey, l_partkey, l_orderkey, rn, l_linenumber
FROM (
  SELECT *, row_number() OVER (PARTITION BY {place} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM (
    SELECT *, concat('M', l_orderkey % 4) AS instrument, CAST(l_orderkey % 8 + 1 AS INT) AS lane, CAST(1101 + l_orderkey % 12 AS INT) AS tile, CAST(l_orderkey AS INT) AS xpos
    FROM {lineitem}) AS placed) AS numbered
"""


def reads_sql(lineitem: str = "lineitem") -> str:
    return READS.format(lineitem=lineitem)


def alignments_sql(lineitem: str = "lineitem") -> str:
    return ALIGNMENTS.format(reads=reads_sql(lineitem))


def sheet_sql(supplier: str = "supplier") -> str:
    return SHEET.format(supplier=supplier)


def index_sql(lineitem: str = "lineitem") -> str:
    return INDEX_READS.format(reads=reads_sql(lineitem))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLACED_READS.format(place="xpos, tile, lane, instrument", lineitem="{l}"), l=lineitem(spark, sf_dir))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ALIGNMENTS.format(reads=PLACED_READS.format(place="l_orderkey", lineitem="{l}")), l=lineitem(spark, sf_dir))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SITES.format(part="{p}"), p=table(spark, sf_dir, "part"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(sheet_sql("{s}").replace('"index"', "`index`"), s=table(spark, sf_dir, "supplier"))


#: Data reads, and beside each cluster's first one its index read, as INDEX_READS has it, so that all stay in one place.
MULTIPLEXED = f"""
SELECT instrument, run_number, CAST(NULL AS STRING) AS flowcell_id, lane, tile, xpos, ypos, s.read, s.bases, s.quals, s.filter_passed, CAST(NULL AS STRING) AS index_seq
FROM (
  SELECT *, explode(CASE WHEN read = 1 THEN array(own, named_struct('read', 2, 'bases', {_INDEX.replace("bc", _BARCODE)}, 'quals', CAST(NULL AS STRING), 'filter_passed', true)) ELSE array(own) END) AS s
  FROM (SELECT *, named_struct('read', 2 * read - 1, 'bases', bases, 'quals', quals, 'filter_passed', filter_passed) AS own FROM {{reads}}) AS o) AS e
"""


def multiplexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data reads numbered 1 and 3, and an index read 2 for each location."""
    return spark.sql(MULTIPLEXED.format(reads="{r}"), r=reads(spark, sf_dir))
