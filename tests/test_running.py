"""Sweeps, unions and running values are the same in small tiles, in one tile and by plain loops."""

import random

from pyspark.sql import functions as F

from locusmill.operators import intervals as I
from locusmill.operators import running as R


def brute_sweep(rows):
    out = []
    for c in {r[0] for r in rows}:
        cuts = sorted({x for r in rows if r[0] == c for x in r[1:3]})
        for a, b in zip(cuts, cuts[1:]):
            over = [r for r in rows if r[0] == c and r[1] <= a and b <= r[2]]
            if over:
                out.append((c, a, b, len(over), sum(r[3] for r in over)))
    return sorted(out)


def brute_merge(rows, gap, abut):
    out = []
    for c in {r[0] for r in rows}:
        now = None
        for r in sorted(r for r in rows if r[0] == c):
            if now and (r[1] <= now[2] + gap if abut else r[1] < now[2]):
                now[2], now[3], now[4] = max(now[2], r[2]), now[3] + 1, now[4] + r[3]
            else:
                now = [c, r[1], r[2], 1, r[3]]
                out.append(now)
    return sorted(map(tuple, out))


def found(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_tiles(spark):
    rng, got = random.Random(1), {}
    rows = [(rng.choice("ab"), (s := rng.randrange(0, 200)), s + rng.choice([1, 3, 8, 10, 16, 40, 120]), rng.randrange(5)) for _ in range(40)]
    few = [r for r in rows if r[2] - r[1] < 40][:25]
    df, some = (spark.createDataFrame(x, "contig string, start long, end long, v long").coalesce(1) for x in (rows, few))
    for t in (8, 1 << 20):
        assert found(I.sweep(df, {"v": F.col("v")}, t), "contig", "start", "end", "n", "v") == sorted(brute_sweep(rows), key=str)
        for gap, abut in ((0, True), (0, False), (30, True)):
            assert found(I.merge(some, gap, abut, {"v": F.col("v")}, t), "contig", "start", "end", "n", "v") == sorted(brute_merge(few, gap, abut), key=str)
        seg = I.sweep(df, {"v": F.col("v")}).select("contig", "start", "end", (F.col("n") > 2).alias("n"), (F.col("n") > 2).cast("int").alias("x"))
        d = R.tiled(seg, F.col("start"), t)
        begins = {"k": lambda p: ~p["n"].eqNullSafe(F.col("n")), "j": lambda p: F.col("x") == 1}
        cases = {
            "collapse": found(I.collapse(seg, ["n"], t), "contig", "start", "end", "n"),
            "running": found(R.running(d, ["contig"], ["start"], {"s": ("sum", F.col("end") - F.col("start")), "m": ("max", F.col("end"))}, before=True), "contig", "start", "s", "m"),
            "neighbour": found(R.neighbour(R.neighbour(d, ["contig"], ["start"], ["end"], "p"), ["contig"], ["start"], ["start"], "q", ahead=True), "contig", "start", "p", "q"),
            "numbered": found(R.numbered(d, ["contig"], ["start"], ["n"], begins), "contig", "start", "k", "j"),
        }
        for k, v in cases.items():
            assert got.setdefault(k, v) == v
