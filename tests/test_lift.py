import re

from conftest import rows
from pyspark.sql import functions as F

from locusmill.functions import cigar as G
from locusmill.functions import scalar as X
from locusmill.operators import lift as L

CIGAR = "4=1X2I2=1X10D1X2=10I1X1=5D5=1X4=5I3=1X6="


def alignments(spark):
    data = [(1, "ctg", 100, 150, "+", "ref", 10, 58, True, CIGAR), (2, "ctg", 200, 250, "-", "ref", 10, 58, True, CIGAR)]
    return spark.createDataFrame(data, "aln long, contig string, contig_start long, contig_end long, strand string, chrom string, chrom_start long, chrom_end long, is_primary boolean, c string").withColumn("cigar", G.parse(F.col("c"))).drop("c")


def test_lengths(spark):
    r = alignments(spark).select(G.query_bases(F.col("cigar")).alias("q"), G.total(F.col("cigar"), G.REF_OPS).alias("r"), G.render(F.col("cigar")).alias("c")).first()
    assert (r.q, r.r, r.c) == (50, 48, CIGAR)


def test_forward(spark):
    b = spark.createDataFrame([("ctg", 80, 106), ("ctg", 110, 116), ("ctg", 123, 126), ("ctg", 113, 123)], "contig string, start long, end long")
    p = L.project(b, alignments(spark).where("aln = 1"))
    assert rows(p, "start", "end", "to_start", "to_end") == [(80, 106, 10, 15), (110, 116, 28, 31), (123, 126, 31, 39)]
    assert rows(L.sub_cigars(p, alignments(spark)), "start", "cigar") == [(80, "4=1X"), (110, "1X2="), (123, "1X1=5D1=")]


def test_backward(spark):
    b = spark.createDataFrame([("ref", 10, 19), ("ref", 20, 35), ("ref", 38, 58), ("ref", 14, 16), ("ref", 39, 45)], "contig string, start long, end long")
    p = L.project(b, alignments(spark).where("aln = 2"), to="asm")
    assert rows(p, "start", "end", "to_start", "to_end") == [(10, 19, 240, 250), (14, 16, 242, 246), (20, 35, 225, 240), (38, 58, 200, 225), (39, 45, 218, 224)]


def test_divergence(spark):
    b = spark.createDataFrame([("ctg", 100, 109)], "contig string, start long, end long")
    r = L.project(b, alignments(spark).where("aln = 1")).first()
    assert (r.from_start, r.from_end, r.to_start, r.to_end) == (100, 109, 10, 17) and abs(r.divergence - 100 * 3 / 7) < 1e-9


def test_cs_md_and_clips(spark):
    r = spark.range(1).select(
        G.parse_cs(F.lit(":6-ata:10+gtc:4*at:3")).alias("cs"), G.parse_md(F.lit("10A5^AC6")).alias("md"), G.left_clip(G.parse(F.lit("3H2S5M4S"))).alias("l"), G.right_clip(G.parse(F.lit("3H2S5M4S"))).alias("r"),
        G.render(G.swap_indels(G.parse(F.lit("3I2D1=")))).alias("s"), X.reverse_complement(F.lit("AACG")).alias("rc"), X.file_extension(F.lit("x/a.cov.gz")).alias("e"), X.argmax(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("am"),
    ).first()
    assert [(x.op, x.len) for x in r.cs] == [("=", 6), ("D", 3), ("=", 10), ("I", 3), ("=", 4), ("X", 1), ("=", 3)]
    assert [(x.op, x.len) for x in r.md] == [("=", 10), ("X", 1), ("=", 5), ("D", 2), ("=", 6)]
    assert (r.l, r.r, r.s, r.rc, r.e, r.am) == (5, 4, "3D2I1=", "CGTT", "cov.gz", 1)


def test_joint_steps():
    assert G.joint_steps([("M", 10), ("I", 2), ("M", 5)], [("=", 4), ("X", 1), ("=", 10)]) == [("=", 4), ("X", 1), ("=", 5), ("I", 2), ("=", 5)]


def test_candidates(spark):
    a = alignments(spark).where("aln = 1")
    ref = spark.createDataFrame([("ref", 158)], "contig string, len long")
    ctg = spark.createDataFrame([("ctg", 350)], "contig string, len long")
    assert rows(L.collapsed_candidates(a, ref, 8)) == [("ref", 0, 10), ("ref", 18, 28), ("ref", 58, 158)]
    assert rows(L.duplicated_candidates(a, ctg, 8)) == [("ctg", 0, 100), ("ctg", 113, 123), ("ctg", 150, 350)]
    assert rows(L.homozygous(a, 5), "ref_start", "ref_end") == [(38, 43), (52, 58)]


def test_conservative(spark):
    own = spark.createDataFrame([("a", 0, 10, 1), ("a", 10, 20, 3), ("a", 20, 30, 0)], "contig string, start long, end long, label int")
    other = spark.createDataFrame([("a", 0, 10, 2, "x"), ("a", 10, 20, 0, "x"), ("a", 10, 20, 2, "y")], "contig string, start long, end long, label int, way string")
    assert rows(L.conservative_labels(own, other)) == [("a", 0, 10, 2), ("a", 10, 20, 3), ("a", 20, 30, 0)]


def test_both_strands_base_by_base(spark):
    a = alignments(spark)
    b = spark.createDataFrame([("ctg", s, s + n) for lo in (100, 200) for n in (1, 7, 50) for s in range(lo - 3, lo + 50, 4)], "contig string, start long, end long")
    pairs = {1: [], 2: []}
    for aln, lo, hi in ((1, 100, 150), (2, 200, 250)):
        q, r = 0, 10
        for op in "".join(o * int(k) for k, o in re.findall(r"(\d+)([=XID])", CIGAR)):
            if op in "=X":
                pairs[aln].append((lo + q if aln == 1 else hi - 1 - q, r))
            q, r = q + (op != "D"), r + (op != "I")
    want = []
    for _, s, e in b.collect():
        for aln, at in pairs.items():
            met = [(x, y) for x, y in at if s <= x < e]
            if met:
                x, y = zip(*met)
                want.append((s, e, aln, min(x), max(x) + 1, min(y), max(y) + 1))
    assert rows(L.project(b, a), "start", "end", "aln", "from_start", "from_end", "to_start", "to_end") == sorted(want)
