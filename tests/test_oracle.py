"""Every query that has SQL against DuckDB, on the smallest tables."""

from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest

from drawwell.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(str, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["active_table_multi_cache", "cache_offsets", "locate_physical"])
def test_any_language(spark, tmp_path, name):
    docs = [(i, lang, i, "s", "t") for i, lang in enumerate(["en", "pl", None, "de", "pl", None, "en"])]
    spark.createDataFrame(docs, "doc_id long, lang string, n_chars long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_partial_failure_writes_all(spark, monkeypatch):
    from drawwell.plans import queries

    sizes = []
    monkeypatch.setattr(queries, "write_cache", lambda spark, sources, path: sizes.extend(s.frame.count() for s in sources) or [])
    monkeypatch.setattr(queries, "FrameSource", lambda name, frame, keys: SimpleNamespace(frame=frame))
    monkeypatch.setattr(spark, "createDataFrame", lambda *_: None, raising=False)
    queries.write_results_partial_failure(spark, SF)
    assert sizes == [spark.read.parquet(f"{SF}/documents.parquet").count()] * 2
