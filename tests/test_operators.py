import random

from pyspark.sql import functions as F

from acervo.operators import index, search
from acervo.operators.archive import free_names
from acervo.operators.components import components
from acervo.operators.ingest import gated
from acervo.operators.ranking import ordinals
from acervo.plans.workspace import Workspace


def first_free(stem, ext, held):
    n, name = 1, stem + ext
    while name in held:
        n += 1
        name = f"{stem} ({n}){ext}"
    return name


def test_free_names_like_one_after_the_other(spark):
    rng = random.Random(5)
    taken = {("p", f"a{x}.pdf") for x in ("", " (2)", " (5)", " (6)", " (9)")} | {("q", "a (3).pdf"), ("p", "b.txt")}
    files = [(i, rng.choice("pq"), rng.choice(["a.pdf", "b.txt", "c"])) for i in range(60)]
    want, held = {}, set(taken)
    for i, p, n in files:
        stem, ext = (n.rsplit(".", 1)[0], "." + n.rsplit(".", 1)[1]) if "." in n else (n, "")
        want[i] = first_free(stem, ext, {x for q, x in held if q == p})
        held.add((p, want[i]))
    df = spark.createDataFrame(files, "ordem int, pasta string, arquivo string")
    got = free_names(df, spark.createDataFrame(sorted(taken), "pasta string, nome string"), ["ordem"], Workspace(spark, "t"))
    assert {r.ordem: r.nome for r in got.collect()} == want


def test_ordinals_over_partitions(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("y").alias("g"), "id")
    got = ordinals(df, ["g"], ["id"], "n", Workspace(spark, "t")).collect()
    for g in ("x", "y", None):
        own = sorted((r.id, r.n) for r in got if r.g == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    empty = ordinals(df.where("false"), [], ["id"], "n", Workspace(spark, "t"))
    assert empty.collect() == []


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"))
    assert {r.no: r.grupo for r in got.collect()} == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).collect() == []


def test_gates(spark):
    files = [(1, "a.txt", "h1", None), (2, "b.TXT", "h1", None), (3, "c.exe", "h2", None), (4, "d.pdf", "h3", "quebrado"), (5, "e.pdf", "h3", None), (6, "f.png", "k", None), (7, "g.txt", None, None), (8, "h.txt", None, None)]
    told = gated(spark.createDataFrame(files, "n int, arquivo string, hash string, erro string"), spark.createDataFrame([("k",), (None,)], "hash string"), ["n"])
    assert {r.n: r.ignorado for r in told.collect()} == {1: None, 2: "ja indexado", 3: "extensao nao monitorada", 4: "quebrado", 5: None, 6: "ja indexado", 7: None, 8: None}


def test_insert_ignore(spark):
    now = spark.createDataFrame([(5, "/p/a", "h1")], "id long, caminho string, hash string")
    new = spark.createDataFrame([(1, "/p/b", "h1"), (2, "/p/c", "h2"), (3, "/p/d", "h2"), (4, "/p/a", "h4"), (5, "/p/e", None), (6, "/p/e", None), (7, "/p/f", None)], "n int, caminho string, hash string")
    got = index.insert_ignore(now, new, ["n"], Workspace(spark, "t")).collect()
    assert {(r.n, r.id) for r in got} == {(2, 6), (5, 7), (7, 8)}


def test_search_order_and_limits(spark):
    rows = [(1, "Conta.pdf", "/x/1", "conta_luz", "2024-01-01", "texto"), (2, "b", "/x/2", "outros", None, "CONTA"), (3, "c", "/x/3", "outros", "2025-01-01", "conta"), (4, "d", "/x/4", "outros", "2025-01-01", None)]
    df = spark.createDataFrame(rows, "id long, arquivo string, caminho string, categoria string, data_documento string, texto string").withColumn("processado_em", F.current_timestamp())
    assert [r.id for r in search.search(df, "conta").collect()] == [3, 1, 2]
    assert [r.id for r in search.search(df, "conta", 1).collect()] == [3]
    assert search.search(df, "conta", 0).collect() == []
    assert [r.id for r in search.listing(df, -1).collect()] == [4, 3, 2, 1]
    assert {r.nome: r.contagem for r in search.facet_counts(df).collect()} == {"Todos": 4, "Contas": 1, "A revisar": 3}
    assert search.printed(df).where("id = 2").first().linhas == "[   2] sem data  outros             b\n       /x/2"
