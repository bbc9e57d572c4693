import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402


def core():
    return sorted(n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("p") or n == "p4_found" or n in ("profile_ema", "profile_labels"))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", core())
def test_query_equals_its_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, (compare._plain(r[c]) for c in cols))) for r in (x.asDict(True) for x in df.collect()))
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(map(str, (compare._plain(dict(zip(names, r))[c]) for c in cols))) for r in cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_llm():
    code = "import sys, importlib, __spark_entry__ as e; [importlib.import_module(m) for m in e._MODULES + ['mnemospark.sources.store', 'mnemospark.streaming.ingest']]; sys.exit(any(m.startswith('mnemospark.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
