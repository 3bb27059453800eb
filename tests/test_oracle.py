"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tessera.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()
NAMES = sorted(E.queries())


#: Queries that run a tokenizer, a parser of whole texts or a model; no SQL does.
WITHOUT_SQL = {"D1_D3_pages_to_markdown", "D4_chunk_documents", "U3_dedupe_chunks", "D5_T4_bm25_top10_chunks",
               *(n for n in NAMES if n.startswith("op") or n == "pipeline")}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "MPE" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got and name in WITHOUT_SQL  # these have tests of their own against plain versions
        return
    rel = con.execute(ORACLES[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want
