"""Every registered query against its SQL in DuckDB at the smallest scale; those without SQL must give rows."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from verilume.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    if name not in catalog.oracle_sql():
        assert got
        return
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in cols] for r in cur.fetchall()), key=str)
    assert sorted(names) == cols
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "dense_rank", "lexical_rank", "rank"]


PROBE = """
import __spark_entry__ as entry
from verilume.plans import catalog
assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
import sys
assert not [m for m in sys.modules if m.startswith("verilume.llm") or m == "corpus_pipeline"]
"""


def test_all_else_works_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "verilume"), tmp_path / "verilume", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "verilume")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                assert "verilume.llm" not in open(os.path.join(folder, name), encoding="utf-8").read(), name
