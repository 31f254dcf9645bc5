"""Where operators keep what must outlive an executor: the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of the Arrow batches of tables that are written, for each worker holds some of them.
BATCH_BYTES = 8 << 20


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, a new temporary folder, if there is one machine only."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not known:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        if not jvm_dir.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = jvm_dir.get() if jvm_dir.isDefined() else tempfile.mkdtemp(prefix="linkgraph-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with its lineage cut."""
    path = new_path(df.sparkSession, name)
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter that ``narrowed`` broadcasts, in blocks of 4 KB: 1 MB in all, whatever the number of ids.
FILTER_BITS, BLOCK_BITS = 1 << 23, 1 << 15


def narrowed(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows without most of those whose id isn't in ids, so that a join with ids shuffles fewer; it drops no row that joins.

    One bit for each id's hash is set in a bitmap of fixed size, which is broadcast.  The more
    ids there are, the fewer rows it spares.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    block, place = F.floor(bit / BLOCK_BITS), F.pmod(bit, F.lit(BLOCK_BITS))
    bits = ids.select(block.alias("_block"), place.alias("_place")).groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(_byte, CAST(_at AS INT)) % 2 = 1")
    marked = rows.join(F.broadcast(bits), block == F.col("_block")).withColumn("_byte", byte).withColumn("_at", F.pmod(place, F.lit(8)))
    return marked.where(held).select(*rows.columns)
