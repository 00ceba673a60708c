from conftest import rows
from pyspark.sql import functions as F

from locusmill.functions import bits as B
from locusmill.operators import benchmark as M
from locusmill.operators import coverage as C

COV = """1 10 4 4 4 0 0
11 15 6 0 0 0 0
16 20 6 0 0 1 1
21 60 10 10 10 1 1
61 64 14 14 10 1,2 1
65 70 14 14 10 0 0
71 110 16 16 16 2 1"""
COV2 = "1 2 4 4 4 1,2 1\n3 10 8 8 0 0 0"


def segments(spark):
    out = []
    for contig, text in (("ctg1", COV), ("ctg2", COV2)):
        for line in text.split("\n"):
            s, e, a, b, c, ann, r = line.split(" ")
            bits = sum(1 << (int(k) - 1) for k in ann.split(",") if k != "0")
            out.append((contig, int(s) - 1, int(e), int(a), int(b), int(c), bits, int(r)))
    return spark.createDataFrame(out, "contig string, start long, end long, cov int, cov_mapq int, cov_clip int, annot_bits long, region int")


def contigs(spark):
    return spark.createDataFrame([("ctg1", 110), ("ctg2", 10)], "contig string, len long")


def test_windows(spark):
    got = rows(C.tumbling(segments(spark), contigs(spark), 20, 40), "contig", "start", "end", "cov", "cov_mapq", "cov_clip", "region", "annot_bits")
    assert got == [
        ("ctg1", 0, 20, 5, 2, 2, 0, 1), ("ctg1", 20, 40, 10, 10, 10, 1, 1), ("ctg1", 40, 60, 10, 10, 10, 1, 1), ("ctg1", 60, 80, 15, 15, 13, 1, 3),
        ("ctg1", 80, 100, 16, 16, 16, 1, 2), ("ctg1", 100, 110, 16, 16, 16, 1, 2), ("ctg2", 0, 10, 7, 7, 1, 0, 3),
    ]


def test_clamps(spark):
    s = spark.createDataFrame([("a", 0, 10, 400, 0)], "contig string, start long, end long, cov int, annot_bits long")
    c = spark.createDataFrame([("a", 10)], "contig string, len long")
    assert rows(C.annotation_histogram(s)) == [(0, 249, 10)]
    assert rows(C.tumbling(s, c, 5, None), "cov") == [(250,), (250,)]


def test_modes_and_bias(spark):
    h = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 9), (2, 1, 4), (3, 0, 7)], "annot int, cov int, bases long")
    assert rows(C.modes(h, ["annot"], 1)) == [(1, 2, 9, 23), (2, 1, 4, 4), (3, -1, 0, 7)]
    t = {r.annot: (r.biased, r.region, r.region_cov) for r in C.bias_table(C.modes(h, ["annot"], 1), 1, [1, 2, 3], 0.2, 1).collect()}
    assert t == {1: (0, 0, 2), 2: (1, 1, 1), 3: (0, 0, 2)}


def test_bits(spark):
    df = spark.createDataFrame([(0,), (5,), (1 << 40,)], "b long")
    assert [r.x for r in df.select(B.indices(F.col("b")).alias("x")).collect()] == [[0], [1, 3], [41]]
    assert [r.x for r in df.select(B.lowest(F.col("b")).alias("x")).collect()] == [-1, 0, 40]
    assert spark.range(1).select(B.flags(F.array(F.lit(1), F.lit(3), F.lit(0))).alias("x")).first().x == 5


def test_labels(spark):
    s = spark.createDataFrame([("contig_1", 0, 50, 7)], "contig string, start long, end long, v int")
    t = spark.createDataFrame([("contig_1", 0, 10, 0), ("contig_1", 8, 20, 1), ("contig_1", 30, 40, 3)], "contig string, start long, end long, label int")
    assert rows(C.with_labels(s, t, "truth")) == [("contig_1", 0, 8, 7, 0), ("contig_1", 8, 10, 7, 1), ("contig_1", 10, 20, 7, 1), ("contig_1", 20, 30, 7, -1), ("contig_1", 30, 40, 7, 3), ("contig_1", 40, 50, 7, -1)]


def test_short_runs_become_haploid(spark):
    w = spark.createDataFrame([("a", 0, 10, 2), ("a", 10, 12, 1), ("a", 12, 30, 2), ("a", 30, 50, 3), ("a", 50, 52, -1)], "contig string, start long, end long, pred int")
    assert rows(M.final_blocks(w, min_length={1: 5, 3: 5})) == [("a", 0, 30, 2), ("a", 30, 50, 3), ("a", 50, 52, 4)]


def test_runs_ignore_distance_but_not_rows_between(spark):
    s = spark.createDataFrame([("a", 0, 5, 1, 1, True), ("a", 9, 10, 1, 2, True), ("a", 10, 11, 1, 2, False), ("a", 11, 13, 1, 2, True)], "contig string, start long, end long, t int, p int, i boolean")
    got = rows(M.runs(s, "t", "p", F.col("i")), "ref", "query", "bases")
    assert got == [(1, 1, 5), (1, 2, 1), (1, 2, 2)]
    assert M.runs(s, "t", "p", F.col("i")).select("run").distinct().count() == 2


def test_depth_to_segments(spark):
    d = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 5, 3), ("a", 6, 4)], "contig string, pos long, depth long")
    assert rows(C.depth_to_segments(d), "contig", "start", "end", "cov") == [("a", 0, 5, 3), ("a", 5, 6, 4)]


def test_effective_windows(spark):
    b = spark.createDataFrame([("a", 0, 25)], "contig string, start long, end long")
    x = spark.createDataFrame([("a", 5, 8)], "contig string, start long, end long")
    assert rows(C.effective_windows(b, x, 10)) == [("a", 0, 5, 0), ("a", 8, 13, 0), ("a", 13, 25, 1)]
