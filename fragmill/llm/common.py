"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the membership filter of ``split_by_ids``: 8 MB in all, whatever the input's size.
FILTER_BITS = 1 << 26


def scratch(spark: SparkSession) -> str:
    """The shared folder for written intermediates: a folder of this application's in spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error, as executors could not
    see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="fragmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/fragmill-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(*written: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in written:
        _delete(df.sparkSession, df.written_to)


def clean(spark: SparkSession) -> None:
    """Delete all intermediates of this application: to be called once the results that read them are written."""
    _delete(spark, scratch(spark))


def workers_find_package(spark: SparkSession) -> None:
    """Put the folder that holds this package on the Python workers' path, as where it is not installed."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))


def give_back() -> None:
    """Return to the system the memory that this process has freed: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its worker, which waits for the next task beside the JVM's own work, gives back what it has freed."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def fresh(*names: str) -> list[str]:
    """Names for internal columns that no input column has."""
    mark = uuid.uuid4().hex
    return [f"{n}_{mark}" for n in names]


def hashed_fold(id_column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds, F.lit(0))


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` that may have an id in ``ids``, rows that surely have none), without a shuffle of ``docs``.

    A one-hash Bloom filter in bitmaps of 4 KB each is broadcast: at most FILTER_BITS / 8 bytes at any input
    size. Beyond about 10^7 ids it lets more rows through; the exact join that follows is then larger, not wrong.
    """
    p, bucket, bits, position, hit = fresh("p", "bucket", "bits", "position", "hit")
    place = F.pmod(F.xxhash64(named(key).cast("long")), F.lit(FILTER_BITS)) + 1
    bitmap = ids.select(place.alias(p)).groupBy(F.bitmap_bucket_number(p).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias(bits))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({position} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = (
        docs.withColumns({bucket: F.bitmap_bucket_number(place), position: F.bitmap_bit_position(place)})
        .join(F.broadcast(bitmap), bucket, "left")
        .withColumn(hit, F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({position} % 8 as int))")) != 0, F.lit(False)))
    )
    return marked.where(hit).select(*all_of(docs)), marked.where(f"not {hit}").select(*all_of(docs))


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, root): connected components of ``edges`` (a, b), root being the least node; a written table.

    Min-label propagation with pointer jumping, in which a node also tells its root the least label beside it: without
    that, the rounds of a long chain grow with its length. Every round is a written table, so a lost executor costs a
    round at most, and is deleted when the next one is there. Simulated chains of 1000 and 300,000 nodes in random order
    take 14 and 24 rounds.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = materialise(labels, f"{name}-labels")
    for _ in range(most):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("next"), "root", "near")
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        own = F.struct("node", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("old"))
        hook = F.struct(F.col("root").alias("node"), F.col("near").alias("root"), F.lit(None).cast(labels.schema["node"].dataType).alias("old"))
        told = step.join(jump, "next", "left").select(F.inline(F.array(own, hook)))
        new = materialise(told.groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old")), f"{name}-labels")
        forget(labels)
        labels = new
        if not new.where("root != old").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    forget(both)
    found = labels.select("node", "root")
    found.written_to = labels.written_to
    return found
