"""Every registered query of the core against its SQL, or for rows where there is none."""

import pytest

from flowsieve.plans import registry
from oracle import connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), SQL[name], con)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("ml")))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["ml06_calibration_fit", "ml09_leave_one_out"])
def test_models_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_settings_of_the_session(spark, sf):
    from flowsieve.plans.base import decided

    before = decided(spark, sf).where("pred = 'Unknown'").count()
    spark.conf.set("spark.flowsieve.tau", "0.99")
    try:
        assert decided(spark, sf).where("pred = 'Unknown'").count() > before
    finally:
        spark.conf.unset("spark.flowsieve.tau")


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """A missing subpackage is left out; an error inside it is not hidden."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "flowsieve"), tmp_path / "flowsieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert int(run().stdout) > 200
    (tmp_path / "flowsieve" / "llm").mkdir()
    (tmp_path / "flowsieve" / "llm" / "__init__.py").write_text("")
    (tmp_path / "flowsieve" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in run().stderr
