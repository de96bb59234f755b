import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from docloom import registry

from .helpers import same_as_sql, tables


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    same_as_sql(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_contract(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setenv("ENTRY_SF_DIR", sf_dir)
    assert entry.entry(spark).columns == ["query_id", "prompt"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


WITHOUT = """
import sys
import __spark_entry__ as entry
assert entry.llm_registry is None and entry.corpus_pipeline is None
assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
assert set(entry.oracle_sql()) <= set(entry.queries())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.queries()["word_counts"](spark, sys.argv[1]).count() > 0
spark.stop()
"""


@pytest.mark.parametrize("gone", [["docloom/llm"], ["docloom/llm", "corpus_pipeline.py"]])
def test_the_entry_works_without_the_training_data_operators(sf_dir, tmp_path, gone):
    root, copy = Path(__file__).parents[1], tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True) if not name.endswith(".py") else (copy / name).unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(copy)}
    ran = subprocess.run([sys.executable, "-c", WITHOUT, sf_dir], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
