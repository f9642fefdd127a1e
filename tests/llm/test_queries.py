import duckdb
import pytest

from acervo.llm import queries as llm

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["id", "campo"], "p2_found": ["id", "campo"], "p3_found": ["id", "tipo"], "p5_found": ["id", "tipo"],
    "p6_found": ["id_a", "id_b"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "area"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, name):
    df = llm.queries()[name](spark, DIR)
    rows = df.collect()
    assert df.columns == COLUMNS[name] and rows
    assert len({tuple(map(str, r)) for r in rows}) == len(rows)


def test_leaks_equal_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "itens_avaliacao"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = set(con.execute(llm.oracle_sql()["p8_found"]).fetchall())
    assert {tuple(r) for r in llm.queries()["p8_found"](spark, DIR).collect()} == want and want
