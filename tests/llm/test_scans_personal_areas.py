import random

import pytest

from acervo.llm import areas, personal, scans

SENTENCES = [
    "o registro da conta venceu na agência central", "a transferência bancária do caixa manteve o contrato", "o prazo do segundo semestre encerrou a conta",
    "a empresa referente ao curto-circuito pagou o registro", "o contrato da empresa descreveu a transferência",
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    clean = [(i, "\n".join(rng.choice(SENTENCES) for _ in range(6)) + f"\nlinha {i}") for i in range(150)]
    noisy = [
        (1000, "o reg1stro da conta venceu"), (1001, "a ernpresa referente ao prazo"), (1002, "o contrato da emprcsa descreveu"),
        (1003, "a transferên-\ncia bancária do caixa"), (1004, "ao curto-\ncircuito pagou"), (1005, "a trans¬\nferência bancária"),
        (1006, "Página 1 de 2\no contrato da empresa\n\fPágina 2 de 2\na conta"), (1007, "texto\n1\no contrato\n2\nfim"), (1008, "livro\n12\nfim"),
        (1009, "SETOR CENTRAL DE PROTOCOLO | 17\no contrato\nSetor centra1 de protocolo | 18\na conta da empresa"),
        (1010, None), (1011, ""), (1012, " \n "), (1013, "o cotnrato da empesa"), (1014, "código C7D5018 e lote 12345"),
        (1015, "o contrato da empresa " * 20_000 + "reg1stro da conta"),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in [*clean, *noisy, noisy[0]]], "id long, texto string, classe string, n int")


def test_scans(spark, pages):
    got = {(r.id, r.tipo) for r in scans.found(spark, pages).collect() if r.id >= 1000}
    assert got == {
        (1000, "caractere"), (1001, "caractere"), (1002, "caractere"), (1003, "hifenizacao"), (1005, "hifenizacao"), (1006, "pagina"),
        (1007, "pagina"), (1009, "cabecalho"), (1015, "caractere"),
    }
    assert scans.found(spark, pages.where("false")).collect() == []


def test_repair(spark, pages):
    got = {r.id: r.reparado for r in scans.repaired(spark, pages.dropDuplicates(["id"])).collect()}
    assert got[1000] == "o registro da conta venceu" and got[1001] == "a empresa referente ao prazo"
    assert got[1003] == "a transferência bancária do caixa" and got[1005] == "a transferência bancária"
    assert got[1006] == "o contrato da empresa\n\na conta" or got[1006] == "o contrato da empresa a conta"
    assert "SETOR" not in got[1009] and "o contrato" in got[1009]


def test_scans_do_not_depend_on_partitions(spark, pages):
    want = {(r.id, r.tipo) for r in scans.found(spark, pages.coalesce(1)).collect()}
    before, scans.SEGMENT = scans.SEGMENT, 7
    try:
        for n in (4, 32):
            assert {(r.id, r.tipo) for r in scans.found(spark, pages.repartition(n)).collect()} == want
    finally:
        scans.SEGMENT = before


def test_hashes_equal_sparks(spark):
    words = ["ação", "a", "", "日本", "reg1stro"]
    got = [r.h for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").selectExpr("xxhash64(w) AS h").collect()]
    assert got == [scans.hashed(w) for w in words]


def test_breaks_have_no_bounds():
    long = "x" * 90 + "palavra"
    text = f"{long}-\n" + "\n" * 20 + " " * 500 + "Página 3\nfim da linha"
    assert list(scans.breaks(text)) == [(long, "-", "fim")]


def test_skeletons():
    for a, b in (("juclicial", "judicial"), ("ariálise", "análise"), ("f1scal", "fiscal"), ("anua|", "anual"), ("compr@", "compra"), ("cheqiie", "cheque"), ("pressäo", "pressão"), ("informaçöes", "informações"), ("nümero", "número")):
        assert scans.skeleton(a) == scans.skeleton(b)
    assert scans.skeleton("cotnrato") != scans.skeleton("contrato")


PERSONAL = {
    1: ("Assinado por Carla Mendonça da Silva. Tel.: (11) 98765-4321", {"nome", "telefone"}),
    2: ("CPF nº 123.456.789-00, mora na Rua das Flores, 12, apto 3", {"identidade", "endereco"}),
    3: ("Contato: carla_mendonca [at] correio [ponto] example\nCNH 12345678901", {"email", "identidade"}),
    4: ("em nome de mendonça, carla\nPassaporte XW123456", {"nome", "identidade"}),
    5: ("com protocolo 98765432101 na conta. Central gratuita 0800 123 4567. CNPJ 12.345.678/0001-90", set()),
    6: ("Encaminhado ao Hospital Carla Mendonça. A feira da Rua das Flores foi adiada. 20 itens @ R$ 9,90 cada", set()),
    7: ("Acesso pela rua de trás, sem placa. Perfil da loja: @comercio. a pedido do responsável", set()),
    8: (None, set()),
    9: ("", set()),
    10: ("Entrega em Av. Brasil, s/n - Centro. SR(A). HEITOR LOPES\nValor R$ 10,00", {"endereco", "nome"}),
    11: ("nada " * 40_000 + "responder em HEITOR@CORREIO.EXAMPLE até sexta", {"email"}),
    12: ("CPF 123" + chr(0xA0) + "456" + chr(0x2007) + "789 00", {"identidade"}),
}


def test_personal(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in PERSONAL.items()] + [(1, PERSONAL[1][0], "x")], "id long, texto string, tipos string")
    got = {}
    for r in personal.found(spark, df).collect():
        got.setdefault(r.id, set()).add(r.tipo)
    assert got == {i: k for i, (_, k) in PERSONAL.items() if k}
    masked = {r.id: r.mascarado for r in personal.masked(spark, df).collect()}
    assert masked[1] == "Assinado por [NOME]. Tel.: [TELEFONE]" and masked[2] == "CPF nº [IDENTIDADE], mora na [ENDERECO], apto 3"
    assert personal.found(spark, df.where("false")).collect() == []


def test_best_segmentation_against_all(spark):
    rng = random.Random(8)
    model = personal.SemiCRF()
    for trial in range(40):
        spans = []
        for k in range(rng.randint(0, 8)):
            a = rng.randrange(30)
            spans.append((a, a + rng.randint(1, 9), rng.choice("xy"), [f"f{trial}{k}"]))
            model.weights[spans[-1][2], spans[-1][3][0]] = rng.uniform(-1, 2)
        for k in "xy":
            for before in (None, "x", "y"):
                model.weights[k, f"after {before}"] = rng.uniform(-1, 1)
        total_of = lambda own: sum(model.score(s[2], s[3]) + model.step(s[2], b[2] if b else None) for b, s in zip([None, *own], own, strict=False))
        best, total = 0.0, 0.0
        sums = []
        for mask in range(1 << len(spans)):
            own = sorted(spans[i] for i in range(len(spans)) if mask >> i & 1)
            if all(p[1] <= q[0] for p, q in zip(own, own[1:], strict=False)):
                sums.append((own, total_of(own)))
        best = max(s for _, s in sums)
        got = model.best(spans)
        by = {(s[0], s[1], s[2]): s for s in spans}
        assert abs(total_of([by[g] for g in got]) - best) < 1e-9
        import math

        total = sum(math.exp(s) for _, s in sums)
        for s, p in zip(spans, model.marginals(spans), strict=True):
            assert abs(p - sum(math.exp(v) for own, v in sums if s in own) / total) < 1e-9


def test_areas_held_out(spark):
    rng = random.Random(5)
    words = {a: [f"{a}{i}" for i in range(25)] for a in ("luz", "água", "saúde")}
    words = {a: ["".join(chr(97 + int(d)) if d.isdigit() else d for d in w) for w in own] for a, own in words.items()}

    def sentence(a):
        return " ".join(["o", rng.choice(words[a]), "manteve", "a", rng.choice(words[a]), "do", rng.choice(words[a])]) + "."

    docs, truth = [], {}
    for i in range(900):
        own = rng.sample(sorted(words), rng.choice([1, 1, 2]))
        lines = ["# Registro 12"]
        for a in own:
            s = [sentence(a) for _ in range(4)]
            if rng.random() < 0.2:
                s[2] = sentence(rng.choice(sorted(words)))
            lines.append(" ".join(s))
        docs.append((i, rng.choice(["\n", "\r\n", "\n\n"]).join(lines), rng.choice(["p1", "p2", None])))
        truth[i] = set(own)
    labels = []
    for i in range(600):
        for a in truth[i]:
            x = rng.random()
            if x > 0.1:
                labels.append((i, rng.choice([a, f" {a}", a.upper()]) if x > 0.15 else rng.choice(sorted(words))))
    docs += [(5000, None, "p1"), (5001, "", None), (5002, "  ", "p1"), (0, docs[0][1], docs[0][2])]
    corpus = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, source string, area string, areas string")
    given = spark.createDataFrame([*labels, labels[0], (7, None), (None, "luz"), (8, "nenhuma")], "doc_id long, area string")
    names = spark.createDataFrame([(a,) for a in words], "area string")
    got = {}
    for r in areas.classify(spark, corpus, given, names).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    right = sum(got.get(i) == truth[i] for i in range(600, 900))
    assert right >= 285, right
    assert not {5000, 5001, 5002} & set(got)
    assert areas.classify(spark, corpus, given.where("false"), names).collect() == []
    assert areas.classify(spark, corpus.where("false"), given, names).collect() == []


@pytest.mark.parametrize("space", [" ", "  ", "\n", " \n ", "\t", "\r\n"])
def test_introductions_over_any_space(space):
    text = f"Recibo emitido em{space}nome de Falvedo Quirino, a{space}pedido de Paulo, A{space}PEDIDO DE Ana; assinado{space}por Rui, eu,{space}Zuleica, sra.{space}Brandina"
    assert [m.span() for m in personal.introductions(text)] == [m.span() for m in personal._INTRO.finditer(text)] != []
    assert len(personal.introductions(text)) == 6


#: Names and introductions that neither the lists nor the grammar of the model have.
UNSEEN = """Locatário Edmilson Tavares Rocha
Quem recebeu foi o Wellington Prado
Falei com Zuleica Prado ontem
O porteiro Genivaldo Pinheiro assinou
A encomenda ficou com Lucimara Bastos
entregue para Kelly Sampaio na recepção
segundo informou Valdirene Couto
o engenheiro Osvaldo Peixoto visitou a obra
Mandei a cópia para Rosilene Farias
a enfermeira Ivonete Braga ligou cedo
conforme acerto com Deusdete Aguiar
quem veio foi Cleonice Matos
Beneficiário final Jurandir Salles
recado deixado por Nilza Queiroz
o caseiro Erasmo Vilela saiu
pagamento feito por Dirceu Fontes
dona Marinalva Reis reclamou
o zelador, Ademir Lacerda, concordou
retirado por Odete Guerra às 10h
o eletricista Gilvan Moura trocou o relógio""".splitlines()
NOBODY = """Reunião em Campo Formoso na terça
A feira de Santo Amaro foi boa
Comprado na Padaria Flor Dourada
Relatório Mensal de Vendas
obra no Parque Central
a Prefeitura de Bela Vista informou
Viagem a Nova Friburgo
Entrega na Rua das Pedras, 40, Morro Azul, CEP 12345-000
O RELATÓRIO DA ANTENA FOI ENTREGUE
prazo da empresa Delta Norte Ltda""".splitlines()


def test_names_that_no_list_has():
    model = personal.trained()
    told = lambda t: [(t[a:b], k) for a, b, k in model.best(personal.candidates(t + "."))]
    whole = [t for t in UNSEEN if any(k == "nome" and len(x.split()) > 1 and x in t for x, k in told(t))]
    assert len(whole) >= 0.9 * len(UNSEEN), set(UNSEEN) - set(whole)
    assert sum(any(k == "nome" for _, k in told(t)) for t in NOBODY) <= 1
    assert told("escreva a joao em correio ponto com") == [("joao em correio ponto com", "email")]


def test_boundaries_are_chosen():
    model = personal.trained()
    told = lambda t: [(t[a:b], k) for a, b, k in model.best(personal.candidates(t))]
    assert ("Bela Moura, Ana", "nome") in told("A pedido de Bela Moura, Ana, o prazo mudou")
    assert ("Ivone Paula", "nome") in told("Atendeu Ivone Paula\nDurante a tarde choveu")
    assert all(len(personal.ends_of(f"Ana Rita da Silva {x}", 0)) >= 3 for x in ("hoje", "Prado"))


def test_transitions_count(spark):
    model = personal.SemiCRF()
    spans = [(0, 3, "x", ["p"]), (4, 6, "y", ["p"]), (4, 6, "x", ["p"])]
    model.weights = {("x", "p"): 1.0, ("y", "p"): 1.0}
    assert model.best(spans)[0] == (0, 3, "x") and len(model.best(spans)) == 2
    for before, after in (("x", "y"), ("x", "x")):
        model.weights = {("x", "p"): 1.0, ("y", "p"): 1.0, (after, f"after {before}"): 0.5}
        assert model.best(spans) == [(0, 3, "x"), (4, 6, after)]
        p = model.marginals(spans)
        assert (p[1] > p[2]) == (after == "y") and abs(p[1] - p[2]) > 0.01
    model.weights = {("x", "p"): -0.2, ("y", "p"): 0.1, ("y", "after x"): 0.5}  # a poor segment for the sake of the next
    assert model.best(spans) == [(0, 3, "x"), (4, 6, "y")]
