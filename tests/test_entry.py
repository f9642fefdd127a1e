import __spark_entry__ as entry
import duckdb
import pytest

from acervo import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = ("documentos", "entrada", "resultados", "lotes", "documents", "itens_avaliacao", "areas", "rotulos_area")


def _rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple("" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert _rows(core.queries()[name](spark, DIR).toPandas()) == _rows(duck.execute(core.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
