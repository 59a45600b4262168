"""Every query of the panel operators against its SQL twin, and its plan against the rules; tests/llm has those of the subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from panelwright.plans import oracle, queries as registry
from tests.compare import difference, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = oracle.oracle_sql()
# No SQL engine fits boosted trees; the ranker is tested end to end in test_views.py.
WITHOUT_SQL = {"gbt_rank_predictions", "gbt_rank_metrics"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_registry_is_covered():
    panel = set(registry.queries())
    assert panel - set(ORACLE) == WITHOUT_SQL and set(ORACLE) <= panel
    assert panel <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    assert difference(df, ORACLE[name], con) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["date", "sid", "label", "label_valid", "label_reason"] and df.count() > 0


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_the_rest_imports_without_the_optional_subpackage(tmp_path, also):
    root = os.path.dirname(os.path.abspath(contract.__file__))
    left_out = shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", *also)
    shutil.copytree(root, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.queries()), sorted(e.oracle_sql()) == sorted(e.oracle.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert run.stdout.split() == ["True", "True"], run.stderr
