import pytest
from sqlcheck import same

from locusmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_all_ten():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_whole_tables(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    table = {"op5_ann": "embeddings", "op8_html_extraction": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    if name in ("op3_language_id", "op6_bpe", "op8_html_extraction", "op10_jaccard_join"):
        assert df.count() == n
    else:
        assert df.count() > 0
