import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from locusmill.operators import intervals as I


def frame(spark, data, cols="contig string, start long, end long"):
    return spark.createDataFrame(data, cols)


def covered(data):
    return {(c, p) for c, s, e in data for p in range(s, e)}


def test_merge_rules(spark):
    b = frame(spark, [("a", 0, 10), ("a", 10, 20), ("a", 15, 30), ("a", 35, 40), ("b", 0, 1)])
    assert rows(I.merge(b, abut=False), "contig", "start", "end") == [("a", 0, 10), ("a", 10, 30), ("a", 35, 40), ("b", 0, 1)]
    assert rows(I.merge(b), "contig", "start", "end") == [("a", 0, 30), ("a", 35, 40), ("b", 0, 1)]
    assert rows(I.merge(b, gap=5), "contig", "start", "end") == [("a", 0, 40), ("b", 0, 1)]


def test_sweep_keeps_cuts_without_change(spark):
    b = frame(spark, [("a", 0, 10), ("a", 10, 20)])
    assert rows(I.sweep(b), "contig", "start", "end", "n") == [("a", 0, 10, 1), ("a", 10, 20, 1)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_against_bases(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(rng.choice("ab"), s := rng.randrange(60), s + rng.randrange(1, 25)) for _ in range(n)]
    x, y = make(25), make(15)
    a, b = frame(spark, x), frame(spark, y)
    depth = {}
    for c, s, e in x:
        for p in range(s, e):
            depth[c, p] = depth.get((c, p), 0) + 1
    got = {}
    for c, s, e, n in rows(I.sweep(a, tile=16), "contig", "start", "end", "n"):
        for p in range(s, e):
            assert (c, p) not in got
            got[c, p] = n
    assert got == depth
    assert covered(rows(I.subtract(a, b, tile=16))) == covered(x) - covered(y)
    assert covered(rows(I.merge(a, tile=16), "contig", "start", "end")) == covered(x)
    assert covered(rows(I.multi_intersect([a, b], tile=16))) == covered(x) & covered(y)
    pairs = sorted((p, q) for p in x for q in y if p[0] == q[0] and p[1] < q[2] and q[1] < p[2])
    found = sorted(((r[0], r[1], r[2]), (r[3], r[4], r[5])) for r in I.overlap_join(a, b, bucket=8).collect())
    assert found == pairs
    hit = {p for p, _ in pairs}
    assert set(rows(I.overlap_join(a.distinct(), b, bucket=8, how="left_semi"))) == hit
    assert set(rows(I.overlap_join(a.distinct(), b, bucket=8, how="left_anti"))) == set(x) - hit


def test_empty(spark):
    none = frame(spark, [])
    assert rows(I.merge(none)) == [] and rows(I.sweep(none)) == [] and rows(I.subtract(none, none)) == []


def test_chunk_rule(spark):
    c = spark.createDataFrame([("ctg1", 110), ("ctg2", 10), ("x", 39), ("y", 40), ("z", 59), ("w", 58)], "contig string, len long")
    got = rows(I.tile_contigs(c, 20), "contig", "start", "end")
    assert [r for r in got if r[0] == "ctg1"] == [("ctg1", 0, 20), ("ctg1", 20, 40), ("ctg1", 40, 60), ("ctg1", 60, 80), ("ctg1", 80, 110)]
    assert [r for r in got if r[0] == "ctg2"] == [("ctg2", 0, 10)]
    assert [r for r in got if r[0] == "x"] == [("x", 0, 39)]
    assert [r for r in got if r[0] == "y"] == [("y", 0, 20), ("y", 20, 40)]
    assert [r for r in got if r[0] == "w"] == [("w", 0, 20), ("w", 20, 58)]
    assert [r for r in got if r[0] == "z"] == [("z", 0, 20), ("z", 20, 40), ("z", 40, 59)]


def test_collapse_needs_touching(spark):
    s = frame(spark, [("a", 0, 5, 1), ("a", 5, 9, 1), ("a", 10, 12, 1), ("a", 12, 13, 2)], "contig string, start long, end long, v int")
    assert rows(I.collapse(s, ["v"], tile=4)) == [("a", 0, 9, 1), ("a", 10, 12, 1), ("a", 12, 13, 2)]


def test_gap_shares(spark):
    b = frame(spark, [("a", 0, 10, "x"), ("a", 40, 60, "y")], "contig string, start long, end long, source string")
    assert rows(I.fill_gaps(b)) == [("a", 10, 20, "x"), ("a", 20, 40, "y")]


def test_unsplit(spark):
    assert rows(I.unsplit(frame(spark, [("c:100-200", 1, 5), ("d", 1, 5)]))) == [("c", 101, 105), ("d", 1, 5)]
