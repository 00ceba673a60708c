"""Interval data made of the star-schema tables: contigs, alignments, annotations and labels, in whole numbers only.

Each view is there twice, as a DataFrame and as SQL for an outside check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATIONS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("contig"), F.col("n_nationkey").cast("long").alias("key"), (20000 + 1000 * F.col("n_nationkey").cast("long")).alias("len"))


def _placed(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows (key, at, length, ...) on contigs; contigs are 25 rows."""
    out = rows.join(F.broadcast(contigs(spark, sf_dir)), "key").withColumn("start", F.col("at") % (F.col("len") - 100))
    return out.withColumn("end", F.least("len", F.col("start") + F.col("length")))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, contig, start, end, mapq, l_clip, r_clip, secondary."""
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read"), (F.col("l_suppkey") % 25).alias("key"),
        (F.col("l_orderkey") * 131 + F.col("l_linenumber") * 977 + F.col("l_partkey") * 17).alias("at"), (100 + F.col("l_quantity").cast("long") * 8).alias("length"),
        (8 * F.round(F.col("l_tax") * 100).cast("long")).alias("mapq"), F.round(F.col("l_discount") * 100).cast("long").alias("clip"), (F.col("l_returnflag") == "R").alias("secondary"),
    )
    out = _placed(li, spark, sf_dir).withColumn("l_clip", F.expr("clip * (end - start) div 100"))
    return out.select("read", "contig", "start", "end", "mapq", "l_clip", F.lit(0).cast("long").alias("r_clip"), "secondary")


def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark, sf_dir).where(~F.col("secondary"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annot (1 to 6), contig, start, end."""
    p = table(spark, sf_dir, "part").select((1 + F.col("p_size") % ANNOTATIONS).cast("int").alias("annot"), (F.col("p_partkey") % 25).alias("key"), (F.col("p_partkey") * 911).alias("at"), (F.col("p_size").cast("long") * 20).alias("length"))
    return _placed(p, spark, sf_dir).select("annot", "contig", "start", "end")


def tiles(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """contig, start, end, label: contigs in tiles of 500, with labels -1 to 3; truth or pred."""
    c = contigs(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(len - 1) div 500"))))
    label = F.expr("CASE WHEN (key * 7 + t * 13) % 97 % 11 = 0 THEN -1 WHEN (key * 7 + t * 13) % 97 < 60 THEN 2 ELSE (key * 7 + t * 13) % 97 % 4 END") if kind == "truth" else F.expr("CASE WHEN (key * 5 + t * 13) % 89 % 13 = 0 THEN -1 WHEN (key * 7 + t * 13) % 97 < 50 THEN 2 ELSE (key * 3 + t * 13) % 97 % 4 END")
    return c.select("contig", (F.col("t") * 500).alias("start"), F.least("len", F.col("t") * 500 + 500).alias("end"), label.cast("int").alias("label"))


def orders_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, start, end, value: one interval for each order."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("key"), (F.col("o_orderkey") * 613).alias("at"), (50 + F.col("o_orderkey") % 300).alias("length"), (F.col("o_orderkey") % 5).cast("int").alias("value"))
    return _placed(o, spark, sf_dir).select("contig", "start", "end", "value")


SQL = """
contigs AS (SELECT n_name AS contig, n_nationkey::BIGINT AS key, 20000 + 1000 * n_nationkey::BIGINT AS len FROM nation),
aln0 AS (SELECT l_orderkey * 8 + l_linenumber AS read, contig, len, (l_orderkey * 131 + l_linenumber * 977 + l_partkey * 17) % (len - 100) AS s, 100 + l_quantity::BIGINT * 8 AS length,
                8 * round(l_tax * 100)::BIGINT AS mapq, round(l_discount * 100)::BIGINT AS clip, l_returnflag = 'R' AS secondary
         FROM lineitem JOIN contigs ON key = l_suppkey % 25),
aln AS (SELECT read, contig, s, least(len, s + length) AS e, mapq, clip * (least(len, s + length) - s) // 100 AS l_clip, 0::BIGINT AS r_clip, secondary FROM aln0),
prim AS (SELECT * FROM aln WHERE NOT secondary),
ann0 AS (SELECT (1 + p_size % 6)::INTEGER AS annot, contig, len, (p_partkey * 911) % (len - 100) AS s, p_size::BIGINT * 20 AS length FROM part JOIN contigs ON key = p_partkey % 25),
ann AS (SELECT annot, contig, s, least(len, s + length) AS e FROM ann0),
tile AS (SELECT contig, key, len, unnest(range(0, (len - 1) // 500 + 1)) AS t FROM contigs),
truth AS (SELECT contig, t * 500 AS s, least(len, t * 500 + 500) AS e,
                 (CASE WHEN (key * 7 + t * 13) % 97 % 11 = 0 THEN -1 WHEN (key * 7 + t * 13) % 97 < 60 THEN 2 ELSE (key * 7 + t * 13) % 97 % 4 END)::INTEGER AS label FROM tile),
pred AS (SELECT contig, t * 500 AS s, least(len, t * 500 + 500) AS e,
                (CASE WHEN (key * 5 + t * 13) % 89 % 13 = 0 THEN -1 WHEN (key * 7 + t * 13) % 97 < 50 THEN 2 ELSE (key * 3 + t * 13) % 97 % 4 END)::INTEGER AS label FROM tile),
ord0 AS (SELECT contig, len, (o_orderkey * 613) % (len - 100) AS s, 50 + o_orderkey % 300 AS length, (o_orderkey % 5)::INTEGER AS value FROM orders JOIN contigs ON key = o_custkey % 25),
ord AS (SELECT contig, s, least(len, s + length) AS e, value FROM ord0)
"""
