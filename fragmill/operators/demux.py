"""Demultiplexing: the sample of each read, by its lane and the barcode in its location's index read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fragmill.functions.reads import hamming, substitutions

#: The fields of a cluster's place, and their order where clusters are brought together.
LOCATION = ["instrument", "run_number", "lane", "tile", "xpos", "ypos"]
CLUSTER = ["xpos", "tile", "lane", "instrument", "run_number", "ypos"]
UNKNOWN, DEFAULT_PROJECT = "unknown", "DefaultProject"
#: A sample sheet describes one flow cell; above this many rows it isn't one and is joined by shuffle.
SHEET_LIMIT = 100_000


def location() -> Column:
    """The key of a cluster on the flow cell: all reads of it share it."""
    return F.concat_ws(":", *LOCATION)


def sanitise(name: str | Column) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return F.when(F.coalesce(column, F.lit("")) == "", F.raise_error(F.lit("empty file name"))).otherwise(F.regexp_replace(column, r"[^\w.-]", "_"))


def ambiguous(sheet: DataFrame, mismatches: int) -> DataFrame:
    """(lane, a, b): barcodes of one lane whose neighbourhoods overlap, being within twice the tolerated distance."""
    a, b = sheet.select("lane", F.col("index").alias("a")), sheet.select("lane", F.col("index").alias("b"))
    return a.join(b, "lane").where("a < b").where(hamming("a", "b") <= 2 * mismatches)


def refuse_ambiguous(sheet: DataFrame, mismatches: int) -> None:
    """Raise if two barcodes of a lane could both claim a read. A sample sheet is small: one flow cell's."""
    first = ambiguous(sheet, mismatches).head()
    if first is not None:
        raise ValueError(f"barcodes {first['a']} and {first['b']} of lane {first['lane']} overlap at {mismatches} mismatches")


def required(reads: DataFrame) -> DataFrame:
    """``reads``, raising where a field of the location, or the read number, is missing or the read number isn't positive."""
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), c) for c in [*LOCATION, "read"]))
    fault = F.when(missing != "", F.concat(F.lit("read without "), missing)).when(F.col("read") <= 0, F.lit("read number isn't positive"))
    return reads.withColumn("read", F.when(fault.isNull(), F.col("read")).otherwise(F.raise_error(fault).cast("int")))


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SHEET_LIMIT + 1).count() <= SHEET_LIMIT else df


def lookup(tags: DataFrame, sheet: DataFrame, mismatches: int = 0) -> DataFrame:
    """``tags`` (lane, tag, ...) with sampleid, sampleproject, barcode, sheet_fcid and mismatches; nulls where none fits.

    A lane with a single sheet row takes any tag, at 0 mismatches. Up to two substitutions, the sheet's rows are
    exploded to their neighbourhoods and looked up by equality; beyond that, distances are compared within the lane.
    Barcodes of a lane whose neighbourhoods overlap raise.
    """
    if not 0 <= mismatches <= 10:
        raise ValueError("mismatches must be in 0..10")
    refuse_ambiguous(sheet, mismatches)
    sheet = sheet.withColumns({"in_lane": F.count("*").over(Window.partitionBy("lane")), "index": F.upper("index")})
    entry = ["sampleid", "sampleproject", F.col("index").alias("barcode"), F.col("fcid").alias("sheet_fcid")]
    alone = sheet.where("in_lane = 1").select("lane", F.col("sampleid").alias("l_sampleid"), F.col("sampleproject").alias("l_sampleproject"), F.col("index").alias("l_barcode"), F.col("fcid").alias("l_fcid"))
    several = sheet.where("in_lane > 1")
    tags = tags.withColumn("tag", F.upper("tag"))
    if mismatches <= 2:
        near = several.withColumn("near", F.explode(substitutions("index", mismatches))).select("lane", F.col("near").alias("tag"), *entry)
        found = tags.join(_hint(near), ["lane", "tag"], "left")
    else:
        rows = several.select(F.col("lane").alias("s_lane"), *entry)
        close = (F.col("lane") == F.col("s_lane")) & (hamming("tag", "barcode") <= mismatches) & F.col("tag").rlike("^[ACGTN]*$")
        found = tags.join(_hint(rows), close, "left").drop("s_lane")
    found = found.join(_hint(alone), "lane", "left")
    only = F.col("l_sampleid").isNotNull()
    return found.select(
        *(c for c in tags.columns),
        F.coalesce("l_sampleid", "sampleid").alias("sampleid"),
        F.coalesce("l_sampleproject", "sampleproject").alias("sampleproject"),
        F.coalesce("l_barcode", "barcode").alias("barcode"),
        F.coalesce("l_fcid", "sheet_fcid").alias("sheet_fcid"),
        F.when(only, 0).otherwise(hamming("tag", "barcode")).alias("mismatches"),
    )


def demultiplex(reads: DataFrame, sheet: DataFrame, mismatches: int = 0, no_index: bool = False, separate_reads: bool = False, trim_last_base: bool = False, drop_failed: bool = False) -> DataFrame:
    """Data reads with sampleid, project, mismatches and destination.

    Read 2 of a location is its index read, looked up before anything is shuffled; its sample goes to the location's
    other reads where all reads of a location meet, and reads above 2 move down by one. Without index reads, lanes of one
    sample name theirs. Locations without an index read get no sample. With ``drop_failed``, reads that failed the
    machine's filter go first. ``project`` and ``sample`` are the destination's folders; reads of no sample have the one.
    """
    if drop_failed:
        reads = reads.where(F.coalesce("filter_passed", F.lit(True)))
    where = required(reads).withColumn("location", location())
    if no_index:
        data = lookup(where.withColumn("tag", F.lit("")), sheet, 0).drop("tag")
        number = F.col("read")
    else:
        tag = F.col("bases") if not trim_last_base else F.expr("substring(bases, 1, length(bases) - 1)")
        fits = F.length(tag).between(7, 12)
        checked = F.when(fits, tag).otherwise(F.raise_error(F.lit("index read must have 7 to 12 bases")))
        found = lookup(where.drop("index_seq").withColumn("tag", F.when(F.col("read") == 2, checked)), sheet, mismatches)
        of_index = ["tag", "sampleid", "sampleproject", "barcode", "sheet_fcid", "mismatches"]
        index = F.collect_list(F.when(F.col("read") == 2, F.struct(*of_index))).over(Window.partitionBy(*CLUSTER))
        data = found.withColumn("index", index).drop(*of_index)
        data = data.where("read != 2").select("*", F.explode_outer("index").alias("i")).select(*(c for c in data.columns if c != "index"), *(F.col(f"i.{c}").alias("index_seq" if c == "tag" else c) for c in of_index))
        number = F.when(F.col("read") > 2, F.col("read") - 1).otherwise(F.col("read"))
    project = sanitise(F.coalesce(F.nullif("sampleproject", F.lit("")), F.lit(DEFAULT_PROJECT)))
    parts = [project, sanitise("sampleid"), *([number.cast("string")] if separate_reads else [])]
    known = F.col("sampleid").isNotNull()
    return data.withColumns(
        {
            "read": number,
            "flowcell_id": F.when(known, F.coalesce("flowcell_id", "sheet_fcid")).otherwise(F.coalesce("flowcell_id", F.lit(""))),
            "project": F.when(known, project).otherwise(F.lit(UNKNOWN)),
            "sample": F.when(known, sanitise("sampleid")),
            "destination": F.when(known, F.concat_ws("/", *parts)).otherwise(F.concat_ws("/", F.lit(UNKNOWN), *([number.cast("string")] if separate_reads else []))),
        }
    )


def lane_content(sheet: DataFrame) -> DataFrame:
    """(sampleid, lane, content) of lanes 1 to 8: ``lane:sample`` where the lane holds the sample, else ``lane:``."""
    samples = sheet.select("sampleid").distinct()
    held = sheet.select("sampleid", "lane").distinct().withColumn("held", F.lit(True))
    every = samples.select("sampleid", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("lane"))
    return every.join(held, ["sampleid", "lane"], "left").select("sampleid", "lane", F.concat(F.col("lane") - 1, F.lit(":"), F.when(F.col("held"), F.col("sampleid")).otherwise("")).alias("content"))


def lane_content_files(sheet: DataFrame) -> list[tuple[str, str]]:
    """(file name, text) of each sample of the sheet: eight lines, one a lane."""
    rows = lane_content(sheet).orderBy("sampleid", "lane").collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r["sampleid"], []).append(r["content"] + "\n")
    return [(f"LaneContent.{sample}", "".join(lines)) for sample, lines in texts.items()]


def demux_fragments(found: DataFrame) -> DataFrame:
    """Fragments of demultiplexed reads: one a location and destination, its sequences in read order."""
    own = Window.partitionBy(*CLUSTER, "destination", "project", "sample").orderBy("read", "bases", "quals", "failed")
    one = F.struct("bases", F.col("quals").alias("qualities"), F.col("failed").alias("failedVendorQualityChecks"))
    lined = found.withColumn("failed", ~F.coalesce("filter_passed", F.lit(True)))
    lined = lined.select("project", "sample", "destination", *LOCATION, F.row_number().over(own).alias("k"), F.collect_list(one).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("sequences"))
    return lined.where("k = 1").select("project", "sample", "destination", location().alias("readName"), "instrument", F.col("run_number").cast("string").alias("runId"), "sequences")


def demux_counters(found: DataFrame) -> DataFrame:
    """(group, name, value): reads and bases by destination, and reads by the number of mismatches of their barcode."""
    by = found.groupBy("destination", F.when(F.col("sampleid").isNotNull(), F.struct("mismatches")).alias("near")).agg(F.count("*").alias("reads"), F.sum(F.length("bases")).cast("long").alias("bases"))
    row = lambda group, name, value: F.struct(group.alias("group"), name.alias("name"), F.col(value).alias("value"))
    of_sample = F.array(*(row(F.col("destination"), F.lit(n), n) for n in ("reads", "bases")))
    near = F.when(F.col("near").isNotNull(), F.array(row(F.lit("barcode mismatches"), F.col("near.mismatches").cast("string"), "reads"))).otherwise(F.array().cast("array<struct<group:string,name:string,value:bigint>>"))
    return by.select(F.inline(F.concat(of_sample, near))).groupBy("group", "name").agg(F.sum("value").alias("value"))
