"""Every registered core query against its SQL."""

import ast
import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.oracle import ORACLE_SQL
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b)
    return a == b and (a is None) == (b is None)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    said = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in said.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(said.fetchall(), key=lambda r: tuple(map(str, r)))
    have = sorted(map(tuple, got.select(*columns).collect()), key=lambda r: tuple(map(str, r)))
    assert len(have) == len(want)
    assert all(same(x, y) for a, b in zip(have, want, strict=True) for x, y in zip(a, b, strict=True))


def test_queries_without_sql_run(spark):
    assert set(QUERIES) - set(ORACLE_SQL) == {"stream_dedup_late"}
    assert QUERIES["stream_dedup_late"](spark, SF).count() == 5


def test_session_zone_does_not_matter(spark):
    before = sorted(map(tuple, QUERIES["ticks_from_events"](spark, SF).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, QUERIES["ticks_from_events"](spark, SF).collect())) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_plans_have_no_python_and_prune_columns(spark):
    for name in ("naive_features", "replay_features", "streaming_features", "parity_skew"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "props" not in plan and "CartesianProduct" not in plan


def test_nothing_imports_the_optional_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_entry_without_the_optional_subpackage(tmp_path, spark):
    import shutil
    import subprocess
    import sys

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and len(e.oracle_sql()) > 40 and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120).returncode == 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
