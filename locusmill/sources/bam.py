"""BAM files as a Spark data source: spark.dataSource.register(BamDataSource); spark.read.format("bam").load(path or pattern).

BGZF is a chain of gzip members, so a file is read as one stream, a partition for each file. Columns are those of text.sam(), with cigar as a
string until sam_columns() makes the array. For very large single files, split them by region first or read SAM text.
"""

from __future__ import annotations

import glob
import gzip
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusmill.functions import cigar as G

#: Codes of operations and bases, and sizes of tag values.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SIZES = {"A": ("c", 1), "c": ("b", 1), "C": ("B", 1), "s": ("h", 2), "S": ("H", 2), "i": ("i", 4), "I": ("I", 4), "f": ("f", 4)}

SCHEMA = "read string, flag int, contig string, start long, mapq int, cigar_text string, seq string, cs string, md string, de double"


def _tags(raw: bytes) -> dict:
    out, at = {}, 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            size, n = SIZES[chr(raw[at])][1], struct.unpack_from("<I", raw, at + 1)[0]
            at += 5 + size * n
        else:
            code, size = SIZES[kind]
            out[name] = struct.unpack_from("<" + code, raw, at)[0]
            at += size
    return out


def records(path: str) -> Iterator[tuple]:
    with gzip.open(path, "rb") as f:
        if f.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        names = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
            f.read(4)
        while len(head := f.read(4)) == 4:
            b = f.read(struct.unpack("<i", head)[0])
            ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", b)
            at = 32
            read, at = b[at : at + n_name - 1].decode(), at + n_name
            ops = struct.unpack_from(f"<{n_ops}I", b, at)
            at += 4 * n_ops
            packed, at = b[at : at + (n_seq + 1) // 2], at + (n_seq + 1) // 2
            seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:n_seq]
            tags = _tags(b[at + n_seq :])
            de = tags.get("de")
            yield (read, flag, names[ref] if ref >= 0 else "*", pos, mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", seq, tags.get("cs", ""), tags.get("MD", ""), None if de is None else float(de))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path)) or [self.path]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return records(partition.value)


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def sam_columns(rows: DataFrame) -> DataFrame:
    bit = lambda n: F.col("flag").bitwiseAND(F.lit(n)) != 0
    out = rows.withColumn("cigar", G.parse(F.col("cigar_text"))).drop("cigar_text").withColumn("strand", F.when(bit(16), "-").otherwise("+")).withColumn("secondary", bit(256)).withColumn("supplementary", bit(2048)).withColumn("unmapped", bit(4))
    return out.withColumn("end", G.ref_end(F.col("start"), F.col("cigar"))).withColumn("l_clip", G.left_clip(F.col("cigar"))).withColumn("r_clip", G.right_clip(F.col("cigar")))


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamDataSource)
    return sam_columns(spark.read.format("bam").load(path))
