"""The driver's contract: every query runs beside its SQL on the smallest tables, and the stream keeps the last version."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import code_oracles, code_queries, oracles, queries
from scripts.compare import rows_of

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = {**queries.QUERIES, **code_queries.QUERIES}, {**oracles.ORACLES, **code_oracles.ORACLES}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        assert mine == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_llm_part_can_be_deleted(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(entry.__file__).parent
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)
