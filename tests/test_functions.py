import random
import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from acervo.functions import dates, scoring
from acervo.functions.text import normal, normalized, sqlite_like, stem, suffix

# text, scores, category, dates in order
GOLDEN = [
    ("Fatura: CONSUMO 214 kWh, Energia\nElétrica", {"conta_luz": 7}, "conta_luz", []),
    ("Tarifa de água: 12 m³ consumidos", {"conta_agua": 4}, "conta_agua", []),
    ("NF-e DANFE CNPJ 12.345.678/0001-90 TOTAL 92,70", {"nota_fiscal": 6}, "nota_fiscal", []),
    ("Boleto código de barras vencimento 05/04/2026", {"boleto": 9}, "boleto", ["2026-04-05"]),
    ("CONTRATO DE LOCAÇÃO cláusula das partes 28 de fevereiro de 2026", {"contrato": 8}, "contrato", ["2026-02-28"]),
    ("RG e CPF", {"documento_pessoal": 4}, "documento_pessoal", []),
    ("pagamento do total", {"nota_fiscal": 1, "comprovante": 1}, "outros", []),
    ("contratos e boletos", {}, "outros", []),
    ("ágüa aguardente", {"conta_agua": 2}, "conta_agua", []),
    ("cpf_123 cnpj.", {"nota_fiscal": 1}, "nota_fiscal", []),
    ("中kwh kwh", {"conta_luz": 3}, "conta_luz", []),
    ("total‍ pago", {"nota_fiscal": 1}, "nota_fiscal", []),
    ("", {}, "outros", []),
    ("31/02/2026 depois 1/3/26", {}, "outros", ["2026-03-01"]),
    ("2026-03-12T10:00", {}, "outros", []),
    ("2026-03-12.45", {}, "outros", ["2045-12-03", "2026-03-12"]),
    ("2026-01-05 e 07/08/2025", {}, "outros", ["2025-08-07", "2026-01-05"]),
    ("1º de março de 2026", {}, "outros", []),
    ("12 DE MARÇO  DE 2026 e 2025-12-31", {}, "outros", ["2025-12-31", "2026-03-12"]),
    ("1/2/123", {}, "outros", ["0123-02-01"]),
    ("1/2/99", {}, "outros", ["2099-02-01"]),
    ("00/01/2026 e 31/12/0026", {}, "outros", ["2026-12-31"]),
    ("1.2.3.4 e 10-11/12", {}, "outros", ["2012-11-10"]),
    ("12/03/2026/04/2027", {}, "outros", ["2026-03-12"]),
    ("12/03/20261", {}, "outros", []),
    ("29 de fevereiro de 2025 e 29 de fevereiro de 2024", {}, "outros", ["2024-02-29"]),
    ("12/13/2026 e 2026-13-01", {}, "outros", []),
    ("1/2/000", {}, "outros", ["2000-02-01"]),
    ("0000-01-01", {}, "outros", ["2000-01-01"]),
    ("१२/०३/२०२६", {}, "outros", ["2026-03-12"]),
    ("１２／０３／２０２６", {}, "outros", ["2026-03-12"]),
    ("R$ 1.234,56 em 3-4-2022", {}, "outros", ["2022-04-03"]),
]


def test_golden(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(GOLDEN)], "id int, t string").select("id", normalized(F.col("t")).alias("n"))
    out = scoring.with_category(rows, "n").select("id", "categoria", scoring.scores(F.col("n")).alias("s"), dates.all_dates(F.col("n")).alias("d")).collect()
    for r in out:
        _, board, category, found = GOLDEN[r.id]
        assert {x.categoria: x.pontos for x in r.s} == board, GOLDEN[r.id]
        assert r.categoria == category, GOLDEN[r.id]
        assert r.d == found, GOLDEN[r.id]


def test_normal_against_the_definition(spark):
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF)])) for _ in range(40)) for _ in range(300)]
    want = [re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))) for t in texts]
    assert [normal(t) for t in texts] == want
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(normalized(F.col("t"))).collect()
    assert [r[0] for r in got] == [*want, None]


def test_theta_join_is_the_score_board(spark):
    rows = spark.createDataFrame([(i, normal(t)) for i, (t, *_) in enumerate(GOLDEN)], "id int, n string")
    got = {(r.id, r.categoria): r.pontos for r in scoring.score_rows(rows, "id", "n").collect()}
    assert got == {(i, c): p for i, (_, board, *_) in enumerate(GOLDEN) for c, p in board.items()}


@pytest.mark.parametrize("pattern", ["%ação%", "%CONTA%", "ç_o", "a\\%", "%\\_b%", "%"])
def test_like_is_sqlite(spark, pattern):
    texts = ["AÇÃO", "ação", "CONTA", "conta", "ção", "a\\x", "a\\", "\\_b", "x\\zb", "", None]
    own = sqlite3.connect(":memory:")
    want = [own.execute("SELECT ? LIKE ?", (t, pattern)).fetchone()[0] for t in texts]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sqlite_like(F.col("t"), pattern)).collect()]
    assert [None if w is None else bool(w) for w in want] == got


def test_names(spark):
    names = ["a.tar.gz", ".env", "x", "relatorio.PDF", "a.", "com espaço.txt"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(stem(F.col("n")), suffix(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("a.tar", ".gz"), (".env", ""), ("x", ""), ("relatorio", ".PDF"), ("a.", ""), ("com espaço", ".txt")]
