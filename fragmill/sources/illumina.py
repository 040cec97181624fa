"""Sequencing run directories: their descriptions, tiles, and the list of work a tile.

Descriptions are two small XML files, read by Spark's reader, so the directory may be in any store that Spark reads, and
parsed on the driver. A run's tiles are a range of rows, one partition a tile.
"""

from __future__ import annotations

from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions.reads import tile_code

#: Files whose presence tells that a run is complete, and surfaces by name.
FINISHED = ("Basecalling_Netcopy_complete_SINGLEREAD.txt", "Basecalling_Netcopy_complete_READ2.txt", "Basecalling_Netcopy_complete_Read{reads}.txt")
SURFACES = {"BothLaneSurfaces": 2, "FirstLaneSurface": 1}


@dataclass(frozen=True)
class Cycles:
    """A read's number, its first and last cycle, and whether it is an index read."""

    number: int
    first: int
    last: int
    indexed: bool


@dataclass(frozen=True)
class Run:
    run_id: str
    number: int
    flowcell_id: str
    instrument: str
    date: str
    lanes: tuple[int, ...]
    reads: tuple[Cycles, ...]
    surfaces: int
    swaths: int
    tiles: int
    described: int
    """Reads that the run information lists, which may leave out index reads."""


def _xml(spark: SparkSession, path: str) -> ElementTree.Element:
    return ElementTree.fromstring(spark.read.text(path, wholetext=True).first()[0])


def read_run(spark: SparkSession, directory: str) -> Run:
    """The run that RunInfo.xml and runParameters.xml of ``directory`` describe."""
    run = _xml(spark, f"{directory}/RunInfo.xml").find("Run")
    setup = _xml(spark, f"{directory}/runParameters.xml").find("Setup")
    surface = setup.find("SelectedSurface").text
    if surface not in SURFACES:
        raise ValueError(f"unknown surface {surface!r}")
    reads, cycle = [], 1
    for read in setup.find("Reads"):
        n = int(read.attrib["NumCycles"])
        reads.append(Cycles(int(read.attrib["Number"]), cycle, cycle + n - 1, read.attrib["IsIndexedRead"] == "Y"))
        cycle += n
    lanes = tuple(int(lane.text) for lane in setup.find("AlignToPhiX"))
    info = [run.find(n).text for n in ("Flowcell", "Instrument", "Date")]
    return Run(run.attrib["Id"], int(run.attrib["Number"]), *info, lanes, tuple(reads), SURFACES[surface], int(setup.find("NumSwaths").text), int(setup.find("NumTilesPerSwath").text), len(run.find("Reads")))


def is_finished(spark: SparkSession, directory: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(directory).getFileSystem(spark._jsc.hadoopConfiguration())
    reads = read_run(spark, directory).described
    return any(fs.exists(path(f"{directory}/{name.format(reads=reads)}")) for name in FINISHED)


def tiles(spark: SparkSession, run: Run) -> DataFrame:
    """lane, surface, swath, number and tile (its code) of every tile; one partition each."""
    each = run.surfaces * run.swaths * run.tiles
    n = each * len(run.lanes)
    rows = spark.range(0, n, 1, max(1, n)).select((F.col("id") / each).cast("int").alias("k"), (F.col("id") % each).cast("int").alias("j"))
    lane = F.element_at(F.array(*map(F.lit, run.lanes)), F.col("k") + 1)
    per_surface = run.swaths * run.tiles
    rows = rows.select(lane.alias("lane"), (F.floor(F.col("j") / per_surface) + 1).cast("int").alias("surface"), (F.floor(F.col("j") % per_surface / run.tiles) + 1).cast("int").alias("swath"), (F.col("j") % run.tiles + 1).cast("int").alias("number"))
    return rows.withColumn("tile", tile_code("surface", "swath", "number"))


def work_list(spark: SparkSession, directory: str, run: Run, command: str = "bclToQseq", options: str = "") -> DataFrame:
    """lane, tile and command of every tile: the converter, its options, and the tile's files and reads; one partition each."""
    calls, places = f"{directory}/Data/Intensities/BaseCalls", f"{directory}/Data/Intensities"
    name = lambda kind: F.format_string(f"L%03d/s_%d_%s.{kind}", "lane", "lane", "tile")
    reads = " ".join(f"--read {r.number}:{r.first}-{r.last}{':index' if r.indexed else ''}" for r in run.reads)
    parts = [F.lit(command), *([F.lit(options)] if options else []), F.format_string("--lane %d --tile %s", "lane", "tile"), F.lit(reads)]
    files = [F.concat(F.lit(f"--{kind} {root}/"), name(kind)) for kind, root in (("filter", calls), ("control", calls), ("clocs", places))]
    return tiles(spark, run).select("lane", "tile", F.concat_ws(" ", *parts, *files).alias("command"))


def qseq_name(lane: str, tile: str, read: str):
    """The usual name of a tile's qseq file."""
    return F.format_string("s_%d_%d_%s_qseq.txt", lane, read, tile)
