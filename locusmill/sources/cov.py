"""The coverage format: header lines, a line for each contig, and run-length rows with 1-based closed coordinates.

Reading is a Spark data source of its own, since a contig's line holds for the rows after it: one partition for each file, read as a stream.
Files are opened through Spark's file system on the driver only to list them; the text comes through `binaryFile`-free local or mounted paths.
For stores that only Spark can open, read_text() does the same from lines.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "contig string, contig_len long, start long, end long, cov int, cov_mapq int, cov_clip int, annots string, region int, truth int, pred int"


@dataclass
class Header:
    annotations: list[str] = field(default_factory=list)
    regions: list[int] = field(default_factory=list)
    labels: int = 0
    truth: bool = False
    prediction: bool = False
    avg_alignment_len: int = 0
    start_only: bool = False

    def lines(self) -> list[str]:
        out = [f"#annotation:len:{len(self.annotations)}", *[f"#annotation:name:{i}:{n}" for i, n in enumerate(self.annotations)]]
        out += [f"#region:len:{len(self.regions)}", *[f"#region:coverage:{i}:{c}" for i, c in enumerate(self.regions)]]
        if self.labels:
            out.append(f"#label:len:{self.labels}")
        out += [f"#truth:{str(self.truth).lower()}", f"#prediction:{str(self.prediction).lower()}"]
        if self.avg_alignment_len:
            out.append(f"#avg_alignment_len:{self.avg_alignment_len}")
        return [*out, f"#start-only:{str(self.start_only).lower()}"]


def parse_header(lines: list[str]) -> Header:
    """The header of the lines that begin with #. Annotations without a name are NA; the counts of annotations and regions must be given, each
    region's coverage too, the number of labels if there are labels, and the average length in start-only mode."""
    h, names, cover, seen = Header(), {}, {}, {}
    for line in lines:
        part = line.strip().lstrip("#").split(":")
        if part[:2] == ["annotation", "name"] and len(part) >= 4:
            names[int(part[2])] = ":".join(part[3:])
        elif part[:2] == ["region", "coverage"] and len(part) >= 4:
            cover[int(part[2])] = int(part[3])
        elif len(part) == 3 and part[1] == "len":
            seen[part[0]] = int(part[2])
        elif len(part) == 2:
            seen[part[0]] = part[1]
    for need in ("annotation", "region"):
        if need not in seen:
            raise ValueError(f"the header has no #{need}:len line")
    h.annotations = [names.get(i, "NA") for i in range(seen["annotation"])]
    if missing := [i for i in range(seen["region"]) if i not in cover]:
        raise ValueError(f"the header has no coverage of regions {missing}")
    h.regions = [cover[i] for i in range(seen["region"])]
    h.labels = int(seen.get("label", 0))
    h.truth, h.prediction, h.start_only = (seen.get(k) == "true" for k in ("truth", "prediction", "start-only"))
    h.avg_alignment_len = int(seen.get("avg_alignment_len", 0))
    if (h.truth or h.prediction) and not h.labels:
        raise ValueError("labels are there but #label:len isn't")
    if h.start_only and not h.avg_alignment_len:
        raise ValueError("start-only coverage needs #avg_alignment_len")
    return h


def header(spark: SparkSession, path: str) -> Header:
    """Reads the header lines, a few dozen, from anywhere in the file."""
    return parse_header([r.value for r in spark.read.text(path).where("value LIKE '#%'").collect()])


def _row(contig: str, length: int, f: list[str]) -> tuple:
    number = lambda i, d=-1: int(f[i]) if len(f) > i and f[i] not in ("", "NA") else d
    return (contig, length, int(f[0]) - 1, int(f[1]), number(2, 0), number(3, 0), number(4, 0), f[5] if len(f) > 5 else "0", number(6, 0), number(7), number(8))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path)) or [self.path]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        opened = gzip.open(partition.value, "rt") if partition.value.endswith(".gz") else open(partition.value)
        contig, length = "", -1
        with opened as lines:
            for line in lines:
                if line.startswith("#") or not line.strip():
                    continue
                if line.startswith(">"):
                    contig, length = line[1:].split()[0], int(line.split()[1])
                    continue
                yield _row(contig, length, line.rstrip("\n").split("\t"))


class CovDataSource(DataSource):
    """spark.dataSource.register(CovDataSource); spark.read.format("cov").load(path or pattern)."""

    @classmethod
    def name(cls) -> str:
        return "cov"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CovDataSource)
    return spark.read.format("cov").load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The same from lines that Spark reads: each contig's part of a file is one line, so a file is split between contigs."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.col("value").rlike(r"^>?\S+ \d+\n"))
    text = F.regexp_replace("value", "^>", "")
    rows = rows.select(F.regexp_extract(text, r"^(\S+) ", 1).alias("contig"), F.regexp_extract(text, r"^\S+ (\d+)", 1).cast("long").alias("contig_len"), F.explode(F.split(text, "\n")).alias("l"))
    f = F.split("l", "\t")
    number = lambda i, d: F.coalesce(F.get(f, F.lit(i)).try_cast("int"), F.lit(d))
    return rows.where(F.col("l").rlike(r"^\d+\t")).select("contig", "contig_len", (F.get(f, F.lit(0)).cast("long") - 1).alias("start"), F.get(f, F.lit(1)).cast("long").alias("end"), number(2, 0).alias("cov"), number(3, 0).alias("cov_mapq"), number(4, 0).alias("cov_clip"), F.coalesce(F.get(f, F.lit(5)), F.lit("0")).alias("annots"), number(6, 0).alias("region"), number(7, -1).alias("truth"), number(8, -1).alias("pred"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Coverage as BED rows: contig, start, end and the same attributes; contig_len is null."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    number = lambda i, d: F.coalesce(F.get(f, F.lit(i)).try_cast("int"), F.lit(d))
    return rows.select(F.get(f, F.lit(0)).alias("contig"), F.lit(None).cast("long").alias("contig_len"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), number(3, 0).alias("cov"), number(4, 0).alias("cov_mapq"), number(5, 0).alias("cov_clip"), F.coalesce(F.get(f, F.lit(6)), F.lit("0")).alias("annots"), number(7, 0).alias("region"), number(8, -1).alias("truth"), number(9, -1).alias("pred"))


def columns_of(kind: str) -> list[str]:
    """Attributes of a row: default, truth, both, only_total, only_high_mapq."""
    base = ["cov", "cov_mapq", "cov_clip", "annots", "region"]
    return {"default": base, "truth": [*base, "truth"], "both": [*base, "truth", "pred"], "only_total": ["cov"], "only_high_mapq": ["cov_mapq"]}[kind]


def write(segments: DataFrame, head: Header, path: str, kind: str = "default", gz: bool = False) -> None:
    """A folder of text parts, whole contigs in each, contigs in order: header lines first in the first one. segments have contig_len."""
    spark = segments.sparkSession
    attributes = [F.col(c).cast("string") for c in columns_of(kind)]
    rows = segments.select("contig", F.struct(F.col("start").alias("s"), F.lit(1).alias("k"), F.concat_ws("\t", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), *attributes).alias("l")).alias("r"))
    tops = segments.groupBy("contig").agg(F.max("contig_len").alias("n")).select("contig", F.struct(F.lit(-1).cast("long").alias("s"), F.lit(0).alias("k"), F.concat(F.lit(">"), "contig", F.lit(" "), F.col("n").cast("string")).alias("l")).alias("r"))
    heads = spark.createDataFrame([("", i, x) for i, x in enumerate(head.lines())], "contig string, i long, l string").select("contig", F.struct(F.col("i").alias("s"), F.lit(0).alias("k"), "l").alias("r"))
    every = heads.unionByName(tops).unionByName(rows).repartitionByRange(F.col("contig")).sortWithinPartitions("contig", "r.s", "r.k")
    every.select(F.col("r.l").alias("value")).write.mode("overwrite").option("compression", "gzip" if gz else "none").text(path)
