"""What the second round's findings named, on small tables made for each."""

import random

import duckdb
import pytest
import sqlcheck

from conftest import rows
from locusmill.llm import html
from locusmill.operators import intervals as I
from locusmill.plans.queries import ORACLES, QUERIES


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """Puts tables in the place of the smallest ones, which stay as they are where none is given."""

    def put(**given):
        con = duckdb.connect()
        for name in ("nation", "part", "orders", "lineitem"):
            if name in given:
                given[name].write.parquet(str(tmp_path / "made" / name))
                con.execute(f"COPY (SELECT * FROM '{tmp_path}/made/{name}/*.parquet') TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
            else:
                con.execute(f"COPY (SELECT * FROM '{sqlcheck.SF}/{name}.parquet') TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        monkeypatch.setattr(sqlcheck, "SF", str(tmp_path))
        return str(tmp_path)

    return put


def test_overlap_totals_against_pairs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        make = lambda n, *more: [(rng.choice(["a", "b", None]), s := rng.randrange(60), s + rng.randrange(0, 25), *[f() for f in more]) for _ in range(n)]
        x, y = make(60), make(40, lambda: rng.choice([1, 2, 3, None]), lambda: rng.choice("uv"))
        a, b = spark.createDataFrame(x, "contig string, start long, end long"), spark.createDataFrame(y, "contig string, start long, end long, k int, m string")
        want = {}
        for c, s, e in x:
            for c2, s2, e2, k, m in y:
                if c is not None and c == c2 and max(s, s2) < min(e, e2):
                    n, shared = want.get((k, m), (0, 0))
                    want[k, m] = n + 1, shared + min(e, e2) - max(s, s2)
        assert {(r.k, r.m): (r.pairs, r.bases) for r in I.overlap_totals(a, b, ["k", "m"], tile=16).collect()} == want
        assert {(r.k, r.m): (r.pairs, r.bases) for r in I.overlap_totals(a, b, ["k", "m"]).collect()} == want
    assert rows(I.overlap_totals(a.where("false"), b, ["k"])) == rows(I.overlap_totals(a, b.where("false"), ["k"])) == []


def test_j4_with_many_pairs(spark, tables):
    """200,000 alignments and 200,000 annotations of one place: 40,000,000,000 pairs, which nothing can list."""
    n = 200_000
    path = tables(
        lineitem=spark.range(n).selectExpr("0L AS l_orderkey", "0L AS l_partkey", "0L AS l_suppkey", "0 AS l_linenumber", "1D AS l_quantity", "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag"),
        part=spark.range(n).selectExpr("0L AS p_partkey", "IF(id % 2 = 0, 1, 2) AS p_size"),
    )
    assert rows(QUERIES["j4_range_join"](spark, path), "annot", "pairs", "bases") == [(2, n * n // 2, n * n // 2 * 20), (3, n * n // 2, n * n // 2 * 40)]


def test_j4_like_its_sql(spark, tables):
    tables()
    assert sqlcheck.same(spark, QUERIES["j4_range_join"], ORACLES["j4_range_join"]) == 6


def test_a1_where_depths_exceed_1000(spark, tables):
    """1,200 alignments of one place: the query ends at depth 1000 as its SQL does, the whole one at 1200."""
    tables(lineitem=spark.range(1200).selectExpr("0L AS l_orderkey", "0L AS l_partkey", "0L AS l_suppkey", "0 AS l_linenumber", "1D AS l_quantity", "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag"))
    assert sqlcheck.same(spark, QUERIES["a1_coverage_counts"], ORACLES["a1_coverage_counts"]) == 1001
    assert sqlcheck.same(spark, QUERIES["a1_coverage_counts_whole"], ORACLES["a1_coverage_counts_whole"]) == 1201


def colliding(spark):
    """Alignments of like numbers whose CIGARs differ: suppliers that agree modulo 4 and not modulo 7, and parts 250,000 apart with the next line number."""
    return spark.sql("""SELECT 7L AS l_orderkey, p * 250000 + 3 AS l_partkey, s * 4 AS l_suppkey, CAST(n - p AS int) AS l_linenumber, CAST(q AS double) AS l_quantity, 0D AS l_discount, 0D AS l_tax, 'N' AS l_returnflag
        FROM (SELECT explode(sequence(0L, 1L)) AS p), (SELECT explode(sequence(0L, 9L)) AS s), (SELECT explode(sequence(3, 4)) AS n), (SELECT explode(sequence(5, 6)) AS q)""")


def test_c6_c10_where_numbers_collide(spark, tables):
    tables(lineitem=colliding(spark))
    assert sqlcheck.same(spark, QUERIES["c6_c10_long_deletions"], ORACLES["c6_c10_long_deletions"]) == 24


def test_x1_where_numbers_collide(spark, tables):
    tables(lineitem=colliding(spark))
    assert sqlcheck.same(spark, QUERIES["x1_projection"], ORACLES["x1_projection"]) == 168


def test_c11_where_numbers_collide(spark, tables):
    tables(lineitem=colliding(spark))
    assert sqlcheck.same(spark, QUERIES["c11_covered_reference"], ORACLES["c11_covered_reference"]) > 100


def mixed_pages():
    """Pages of three hosts with boxes that hold a text on some pages and stories on others, menus, and layouts that few pages share."""
    rng = random.Random(5)
    out = []
    for h in range(3):
        for i in range(40):
            box = "Share this page" if i % 2 else f"<p>Story {i} of host {h} by nobody else.</p><p>And {rng.randrange(3)} more.</p>"
            deep = "<div>" * (i % 5) + f"<p>All the same. Part {i % 3}.</p>" + "</div>" * (i % 5)
            menu = "".join(f"<div><p>Entry {k}</p></div>" for k in range(rng.choice([2, 2, 2, 3])))
            out.append((len(out), f"http://h{h}.example/{i}", f"<body><div class=top>{menu}</div><div class=box>{box}</div><div class=k{i % 4}>{deep}<p>Text {i} {h}</p></div><div class=end>{deep}</div></body>"))
    return out


def test_op8_trees_of_large_hosts_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame(mixed_pages(), "page_id long, url string, html string").repartition(3)
    want, named = rows(html.site_tree(df)), html.site_tree(df).columns
    assert any(r[named.index("noise")] for r in want)
    whole, texts = html.site_tree, rows(html.extract(df))
    for most in (1, len(want) // 3):
        assert rows(whole(df, most=most).select(named)) == want
    monkeypatch.setattr(html, "site_tree", lambda *a: whole(*a, most=1))
    assert rows(html.extract(df)) == texts
    assert {r[0]: r[2] for r in texts}[0].startswith("Story 0 of host 0")
    assert rows(whole(df.where("page_id < 3"), most=1)) == []
