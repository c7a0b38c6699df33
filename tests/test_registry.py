"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry_point
from checks import catalogue, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck_connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare.differences(spark, con, name, SF) is None


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).columns == ["month", "avg_sentiment", "sentiment_label", "n"]


def test_a_run_leaves_no_scratch_behind(spark):
    import os

    from hearsay.session import cut_lineage, scratch_run

    with scratch_run(spark) as folder:
        rows = cut_lineage(spark.range(5))
        with scratch_run(spark) as inner:
            assert cut_lineage(rows).count() == 5 and inner.startswith(folder)
        assert os.path.isdir(folder.removeprefix("file:")) and not os.path.isdir(inner.removeprefix("file:")) and rows.count() == 5
    assert not os.path.isdir(folder.removeprefix("file:"))
    assert "/run-" not in cut_lineage(spark.range(1)).inputFiles()[0]


def test_entry_goes_without_the_training_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/hearsay", tmp_path / "hearsay", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{root}/checks", tmp_path / "checks", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 150 and out.stdout.split()[1] == "False"
