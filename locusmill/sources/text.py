"""Readers of text formats as DataFrames in 0-based half-open coordinates. Paths are read by Spark alone, so any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions import cigar as G


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _fields(rows: DataFrame, n: int, sep: str = "\t") -> list[Column]:
    f = F.split("value", sep)
    return [F.get(f, F.lit(i)) for i in range(n)]


def bed(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """contig, start, end and the named further columns as strings; comments and track lines are left out; any white space parts."""
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^(#|track\b|browser\b)") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    return rows.select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), *[F.get(f, F.lit(3 + i)).alias(c) for i, c in enumerate(extra or [])])


def bed_of(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """bed() of the listed contigs only."""
    return bed(spark, path).join(contigs.select("contig"), "contig", "left_semi").select("contig", "start", "end")


def label_bed(spark: SparkSession, path: str, truth: bool) -> DataFrame:
    """contig, start, end, truth, pred: the fourth column is one of them, the other is -1."""
    rows = bed(spark, path, ["label"])
    label = F.col("label").try_cast("int")
    return rows.select("contig", "start", "end", (label if truth else F.lit(-1)).alias("truth"), (F.lit(-1) if truth else label).alias("pred"))


def block_list(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end, info: the fourth column as a number (0 without one)."""
    return bed(spark, path, ["info"]).withColumn("info", F.coalesce(F.col("info").try_cast("double"), F.lit(0.0)))


def fai(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where(F.trim("value") != "")
    name, length = _fields(rows, 2)
    return rows.select(name.alias("contig"), length.try_cast("long").alias("len"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines that aren't blank, trimmed."""
    return _lines(spark, path).select(F.trim("value").alias("value")).where("value <> ''")


def size_bins(spark: SparkSession, path: str) -> DataFrame:
    """bin, b_start, b_end from start, end, name; numbers may be written as 1e9."""
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    return rows.select(F.get(f, F.lit(2)).alias("bin"), F.get(f, F.lit(0)).try_cast("double").cast("long").alias("b_start"), F.get(f, F.lit(1)).try_cast("double").cast("long").alias("b_end"))


def counts(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where(F.col("value").rlike(r"^\s*\d"))
    f = F.split(F.trim("value"), r"\s+")
    return rows.select(F.get(f, F.lit(0)).try_cast("long").alias("cov"), F.get(f, F.lit(1)).try_cast("double").cast("long").alias("bases"))


def probability_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """cov, freq, fit and one float column for each name."""
    rows = _lines(spark, path).where(F.col("value").rlike(r"^\s*\d"))
    f = F.split(F.trim("value"), r"\s+")
    return rows.select(F.get(f, F.lit(0)).try_cast("long").alias("cov"), F.get(f, F.lit(1)).try_cast("double").alias("freq"), F.get(f, F.lit(2)).try_cast("double").alias("fit"), *[F.get(f, F.lit(3 + i)).try_cast("float").alias(c) for i, c in enumerate(names)])


def position_depth(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos (from 1), depth."""
    rows = _lines(spark, path).where(F.trim("value") != "")
    a, b, c = _fields(rows, 3)
    return rows.select(a.alias("contig"), b.try_cast("long").alias("pos"), c.try_cast("long").alias("depth"))


def _tag(name: str, pattern: str = r"[^\t]+") -> Column:
    return F.regexp_extract("value", rf"\t{name}:[A-Za-z]:({pattern})", 1)


def paf(spark: SparkSession, path: str) -> DataFrame:
    """aln, contig, contig_len, contig_start, contig_end, strand, chrom, chrom_len, chrom_start, chrom_end, mapq, is_primary, nm, de, cigar (array).

    aln is a digest of the line, so that it stays when a plan runs again; equal lines are one alignment."""
    rows = _lines(spark, path).where(F.trim("value") != "")
    c = _fields(rows, 12)
    number = lambda i: c[i].try_cast("long")
    return rows.select(
        F.xxhash64("value").alias("aln"), c[0].alias("contig"), number(1).alias("contig_len"), number(2).alias("contig_start"), number(3).alias("contig_end"), c[4].alias("strand"),
        c[5].alias("chrom"), number(6).alias("chrom_len"), number(7).alias("chrom_start"), number(8).alias("chrom_end"), number(11).cast("int").alias("mapq"),
        F.col("value").contains("tp:A:P").alias("is_primary"), _tag("NM", r"\d+").try_cast("long").alias("nm"), _tag("de").try_cast("double").alias("de"), G.parse(_tag("cg")).alias("cigar"),
    )


def sam(spark: SparkSession, path: str) -> DataFrame:
    """read, flag, contig, start, end, mapq, cigar (array), seq, cs, md, de and what flags and clips say: strand, secondary, supplementary, unmapped,
    l_clip, r_clip."""
    rows = _lines(spark, path).where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    c = _fields(rows, 11)
    flag, start, ops = c[1].try_cast("int"), c[3].try_cast("long") - 1, G.parse(c[5])
    bit = lambda n: flag.bitwiseAND(F.lit(n)) != 0
    out = rows.select(c[0].alias("read"), flag.alias("flag"), c[2].alias("contig"), start.alias("start"), c[4].try_cast("int").alias("mapq"), ops.alias("cigar"), c[9].alias("seq"), _tag("cs").alias("cs"), _tag("MD").alias("md"), _tag("de").try_cast("double").alias("de"), F.when(bit(16), "-").otherwise("+").alias("strand"), bit(256).alias("secondary"), bit(2048).alias("supplementary"), bit(4).alias("unmapped"))
    return out.withColumn("end", G.ref_end(F.col("start"), F.col("cigar"))).withColumn("l_clip", G.left_clip(F.col("cigar"))).withColumn("r_clip", G.right_clip(F.col("cigar")))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig and len from @SQ lines."""
    rows = _lines(spark, path).where(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).try_cast("long").alias("len"))


def contig_alignments(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """SAM rows of contigs against a reference in the columns of paf(). lengths: contig, len; hard clips are counted in."""
    ops = F.col("cigar")
    left, right, used = G.left_clip(ops), G.right_clip(ops), G.query_bases(ops)
    s = F.when(F.col("strand") == "-", right).otherwise(left)
    r = rows.where("NOT unmapped").select(F.xxhash64("read", "flag", "contig", "start").alias("aln"), F.col("read").alias("__q"), s.alias("contig_start"), (s + used).alias("contig_end"), "strand", F.col("contig").alias("chrom"), F.col("start").alias("chrom_start"), F.col("end").alias("chrom_end"), "mapq", (~F.col("secondary") & ~F.col("supplementary")).alias("is_primary"), "de", G.without_clips(ops).alias("cigar"))
    return r.join(lengths.select(F.col("contig"), F.col("len").alias("contig_len")), F.col("__q") == F.col("contig")).drop("__q")


def vcf_snps(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos (from 0), ref, alt of the single-base variants."""
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    c = _fields(rows, 5)
    return rows.select(c[0].alias("contig"), (c[1].try_cast("long") - 1).alias("pos"), c[3].alias("ref"), c[4].alias("alt")).where("length(ref) = 1 AND length(alt) = 1")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq: one row for each record; records are parted by '>' at a line's start, so a file is split between records."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", r"^>", "")
    return rows.select(F.regexp_extract(text, r"^(\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s", "").alias("seq")).where("name <> ''")


def base_intervals(sequences: DataFrame, pattern: str = "[nN]+") -> DataFrame:
    """contig, start, end of runs of the pattern (N runs; [ACGTacgt]+ for canonical bases) in (name, seq)."""
    marked = F.regexp_replace("seq", f"({pattern})", "\u0001$1\u0001")
    parts = F.posexplode(F.split(marked, "\u0001")).alias("k", "p")
    from pyspark.sql import Window

    rows = sequences.select(F.col("name").alias("contig"), parts)
    w = Window.partitionBy("contig").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("p")).over(w), F.lit(0)).cast("long"))
    return rows.where((F.col("k") % 2 == 1) & (F.length("p") > 0)).select("contig", "start", (F.col("start") + F.length("p")).alias("end"))
