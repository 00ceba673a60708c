import subprocess
import sys

import pytest
from sqlcheck import same

from locusmill.plans.queries import ORACLES, QUERIES

ROOT = __file__.rsplit("/tests/", 1)[0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    """The rest imports and has its queries where llm and the pipeline are gone."""
    subprocess.run(["cp", "-r", f"{ROOT}/locusmill", f"{ROOT}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "locusmill/llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
