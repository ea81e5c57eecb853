"""Every graph query against its SQL on the smallest tables."""

import math
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from knotwork.plans import evidence, queries, resolution, upkeep  # noqa: F401  they register themselves
from knotwork.plans.base import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float | Decimal):
        return "nan" if math.isnan(value) else float(f"{float(value):.8g}")
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(columns).collect()), key=repr)
    found = duck.execute(ORACLE[name])
    place = [[d[0] for d in found.description].index(c) for c in columns]
    assert len(place) == len(found.description)
    assert got == sorted(([plain(r[k]) for k in place] for r in found.fetchall()), key=repr)


def test_entry_without_the_training_subpackage():
    code = "import sys; sys.modules['knotwork.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and set(q) == set(e.oracle_sql()) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code.replace("k.startswith('op')", "k[:2] == 'op' and k[2:3].isdigit()")], cwd=Path(__file__).resolve().parents[1], check=True)
