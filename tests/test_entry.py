"""The entry module by itself: without a session, and without the parts that can be absent."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

REPO = Path(__file__).resolve().parents[1]
SAMPLE = Path("/root/testdata/sf0.001")
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"


def names(folder: Path) -> set[str]:
    return set(subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split())


def test_queries_can_be_listed_without_a_session():
    assert "o8_20_all_charts" in names(REPO)


def test_library_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO / "occspark", tmp_path / "occspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert "o8_20_all_charts" in found and not [n for n in found if n.startswith("op") or n == "pipeline"]


def test_library_works_without_what_the_corpus_operators_need(tmp_path):
    for name in ("zstandard", "xxhash"):
        (tmp_path / f"{name}.py").write_text("raise ImportError('absent')")
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=REPO, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    found = set(run.stdout.split())
    assert "o8_20_all_charts" in found and not [n for n in found if n.startswith("op")]


@pytest.mark.skipif(not SAMPLE.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["o1_1_csv_round_trip", "o1_1_csv_in_splits", "o4_8_clean_date", "o6_14_refresh_known_tables", "o8_20_all_charts", "o11_4_import_decisions"])
def test_twins_agree(spark, name):
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as entry

    con = duckdb.connect()
    for table in SAMPLE.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    frame = entry.queries()[name](spark, str(SAMPLE))
    columns = sorted(frame.columns)
    want = sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in frame.select(*columns).collect()) == want
