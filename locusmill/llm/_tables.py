"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast, as bytes of its Parquet files.
BROADCAST_BYTES = 4 << 20

#: The same for bitmaps, and bits of the bitmap of texts that may be wanted.
BITMAP_BYTES, CELLS = 16 << 20, 25

_marked: set[str] = set()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder named by spark.checkpoint.dir; it is deleted when the driver ends.

    Where the setting is missing a temporary folder will do for a local master; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="locusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    own = f"{found}/locusmill-{context.applicationId}"
    if own not in _marked:
        p, fs = _path(spark, own)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and lost executors cost nothing done before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._locusmill_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_locusmill_path", None):
            p, fs = _path(df.sparkSession, path)
            fs.delete(p, True)


def small(table: DataFrame, part: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """A table that written() made (or a part of its columns), to be broadcast if its files are few enough bytes; else the join stays Spark's choice."""
    p, fs = _path(table.sparkSession, table._locusmill_path)
    part = table if part is None else part
    return F.broadcast(part) if fs.getContentSummary(p).getLength() <= (BROADCAST_BYTES if most is None else most) else part


def bitmap(rows: DataFrame, number: Column, name: str) -> DataFrame:
    """A written table __bucket, __bits with the bit of each number (0 or more) set: 4 KB for every 32768 numbers among which there is one."""
    n = rows.select((number + 1).alias("n"))
    return written(n.groupBy(F.bitmap_bucket_number("n").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("__bits")), name)


def with_bit(df: DataFrame, number: Column, bits: DataFrame, name: str) -> DataFrame:
    """df and a boolean column: whether bitmap() has the number's bit set. The bitmap is broadcast if it is small enough."""
    at = F.bitmap_bit_position(number + 1)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    out = df.withColumn("__at", F.bitmap_bucket_number(number + 1))
    out = out.join(small(bits, most=BITMAP_BYTES), F.col("__at") == F.col("__bucket"), "left")
    return out.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__at", "__bucket", "__bits")


def texts_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """wanted (a written table with doc_id and dg, the xxhash64 of a text) with the text of each row of docs that it means.

    Whole texts are only moved where they may be wanted: a bitmap of 2^CELLS hashed keys (4 MB, whatever the data) tells most of the others."""
    value = docs[text].cast("string")
    src = docs.select(docs["doc_id"].cast("long").alias("__id"), F.xxhash64(value).alias("__dg"), value.alias("text"))
    cell = lambda i, d: F.pmod(F.xxhash64(i, d), F.lit(1 << CELLS))
    cells = bitmap(wanted, cell(F.col("doc_id"), F.col("dg")), "cells")
    src = with_bit(src, cell(F.col("__id"), F.col("__dg")), cells, "__may").where("__may").drop("__may")
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__dg") == F.col("dg"))
    return src.join(wanted.hint("merge"), same).drop("__id", "__dg")
