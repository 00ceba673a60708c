import duckdb
from conftest import rows
from helpers import WORD

from locusmill.llm import mixing


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((x for x in sizes if x is not None)) + ([None] if None in sizes else [])
    w = {x: weights[k % 3] for k, x in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [x for x in names if x not in capped]
        left = total - sum(capped.values())
        share = {x: left * w[x] / sum(w[y] for y in free) for x in free}
        over = [x for x in free if share[x] > most * sizes[x]]
        if not over:
            return {**capped, **share}
        for x in over:
            capped[x] = float(most * sizes[x])


def docs(spark):
    data = [(i, " ".join(["w"] * (1 + i * 7 % 23)), ["s1", "s2", "s10", "small", None][min(4, i % 9 // 2)] if i % 50 else "tiny") for i in range(900)]
    data += [(1000, None, "s1"), (1001, "", "empty"), (1002, "  ", "empty"), (1003, "x " * 4000, "s2"), (None, "a b c", "s1"), (5, "w w", "s1")]
    return spark.createDataFrame(data, "doc_id long, text string, source string"), data


def test_targets_and_counts(spark):
    df, data = docs(spark)
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = water(sizes)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s]
    assert rows(mixing.mix(df)) == rows(mixing.mix(df.repartition(7)))


def test_like_the_sql(spark):
    df, _ = docs(spark)
    documents = df.where("doc_id IS NOT NULL AND doc_id <> 5").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(tuple(r) for r in con.execute(mixing.targets_sql()).fetchall())
    got = rows(mixing.mix(df.where("doc_id IS NOT NULL AND doc_id <> 5")), "doc_id", "size", "source_size", "target", "taken")
    assert got == want


def test_mixed_repeats_whole_rows(spark):
    df, _ = docs(spark)
    df = df.where("doc_id <> 5")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = {}
    for r in mixing.mixed(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0
