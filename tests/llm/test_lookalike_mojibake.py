from collections import Counter

import pyarrow as pa
import pytest

from acervo.llm import lookalike, mojibake

PLAIN = "A cláusula de rescisão suspendeu o prazo; § 1º, 12 m³, ½ hora, nº 4… — “Дружба” «Ωμέγα» 40 Ω, 10 µF ™ ação"


def _odd():
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in "valor R$ 12")
    return [
        (1, PLAIN, "boleto"), (2, None, None), (3, "", ""), (4, "   ", " "),
        (5, "O " + wide + " foi pago", "boleto"), (6, "a noti" + chr(0xFB01) + "cação", "bol" + chr(0x200B) + "eto"),
        (7, "insiste" + chr(0x302) + "ncia", chr(0xA0) + "boleto"), (8, "da" + chr(0xA0) + "nota", "b" + chr(0x43E) + "leto"),
        (9, "т" + "axa pаga", "boleto"), (10, "Ã" + chr(0xA0) + " razÃ£o do sÃ" + chr(0xAD) + "tio", "boleto"),
        (11, "fam" + chr(0x1F468) + chr(0x200D) + chr(0x1F469), "boleto"), (12, ("palavra " * 30_000) + "fi" + chr(0x2060) + "m", "boleto"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "x", "y", "z") for r in _odd()] + [(5, _odd()[4][1], "boleto", "x", "y", "z")]
    return spark.createDataFrame(rows, "id long, texto string, categoria string, peca string, campo string, valor string")


def test_lookalike_found(spark, odd):
    got = {(r.id, r.campo) for r in lookalike.found(spark, odd).collect()}
    assert got == {(5, "texto"), (6, "texto"), (6, "categoria"), (7, "texto"), (7, "categoria"), (8, "texto"), (8, "categoria"), (9, "texto"), (12, "texto")}


def test_lookalike_consistent(spark, odd):
    got = {(r.id, r.campo): r.forma for r in lookalike.consistent(spark, odd.dropDuplicates(["id"])).collect()}
    assert got[5, "texto"] == "O valor R$ 12 foi pago" and got[6, "texto"] == "a notificação" and got[6, "categoria"] == "boleto"
    assert got[7, "texto"] == "insistência" and got[7, "categoria"] == "boleto" and got[8, "texto"] == "da nota" and got[8, "categoria"] == "boleto"
    assert got[12, "texto"] == ("palavra " * 30_000) + "fim"


def _canonical(spark, forms, words):
    pieces, known = spark.createDataFrame([(f,) for f in forms], "peca string"), spark.createDataFrame(words, "palavra string, n long")
    return {r.peca: r.canonica for r in lookalike.canonical(spark, pieces, known).collect()}


def test_lookalike_canonical_is_one_a_class(spark):
    forms = ["ação", "ac" + chr(0x327) + "a" + chr(0x303) + "o", "aç" + chr(0x200B) + "ão"]
    assert _canonical(spark, forms, [("acao", 90), ("Ação", 80)]) == {forms[1]: "ação", forms[2]: "ação"}


def test_the_corpus_reads_letters_that_look_like_two(spark):
    forms = ["υalor", "υnidade", "Іuz", "Іvo", "vаlor"]
    got = _canonical(spark, forms, [("valor", 50), ("ualor", 1), ("unidade", 40), ("vnidade", 1), ("luz", 30), ("Iuz", 1), ("Ivo", 9), ("lvo", 1)])
    assert got == {"υalor": "valor", "υnidade": "unidade", "Іuz": "luz", "Іvo": "Ivo", "vаlor": "valor"}
    assert lookalike.mapped_form("υalor") == "ualor" and lookalike.mapped_form("Іuz") == "Iuz"
    assert _canonical(spark, ["uаlor"], [("valor", 50)]) == {"uаlor": "ualor"}  # a plain u is no v, however frequent


def test_lookalike_map_by_rules():
    pairs = {"ʀua": "rua", "pꜱo": "pso", "ᎪÇÃO": "AÇÃO", "ℓuz": "luz", "Ⅳ": "IV", "①": "1", "ｃasa": "casa", "ﬁm": "fim"}
    assert {k: lookalike.mapped_form(k) for k in pairs} == pairs
    assert all(lookalike.mapped_form(x) == x for x in ("ℓ", "5ℓ", "kΩ", "№", "™", "м²", "Дружба"))


def test_lookalike_empty(spark, odd):
    assert lookalike.found(spark, odd.where("false")).collect() == []


GOOD = "A conciliação bancária do caixa manteve a cláusula de rescisão após insistência do setor. Referência número {} em São João, à razão de {} horas até amanhã."


def _garbled():
    rows = [(i, GOOD.format(i, i * 7), f"depósito-{i}.pdf") for i in range(400)]
    bad = {
        1000: GOOD.format(1, 2).encode().decode("cp1252", "ignore"), 1001: GOOD.format(3, 4).encode().decode("cp850"),
        1002: GOOD.format(5, 6).encode().decode("mac_roman"), 1003: GOOD.format(7, 8).encode("cp1252").decode("cp850"),
        1004: GOOD.format(9, 8).encode("cp850").decode("latin-1"), 1005: GOOD.format(7, 7).encode().decode("latin-1").encode().decode("latin-1"),
        1006: "Conta de " + chr(0xFFFD) + "gua", 1007: GOOD.format(8, 8) + " " + "manhã".encode().decode("cp1252"),
    }
    fine = [(2000, "NÃO HÁ SITUAÇÃO: CERTIDÃO, ÂNGULO, ÔNUS", "nf_EMISSÃO.pdf"), (2001, "Straße cotada a £ 30, «Прибор» ½ ™ ñandú über", "x.pdf"), (2002, None, "a.pdf"), (2003, "", None), (2004, "  ", "b.pdf")]
    return rows, bad, fine


@pytest.fixture(scope="module")
def garbled(spark):
    rows, bad, fine = _garbled()
    rows = rows + [(i, t, "a.pdf") for i, t in bad.items()] + [(1007, bad[1007], "a.pdf")] + fine + [(3000, "ok", "ServiÃ§o.pdf")]
    return spark.createDataFrame([(*r, "v", "h") for r in rows], "id long, texto string, arquivo string, v string, valor string")


def test_mojibake(spark, garbled):
    got = {(r.id, r.campo): r for r in mojibake.restored(spark, garbled).collect()}
    assert set(got) == {(i, "texto") for i in range(1000, 1008)} | {(3000, "arquivo")}
    assert got[1001, "texto"].original == GOOD.format(3, 4) and got[1002, "texto"].original == GOOD.format(5, 6)
    assert got[1003, "texto"].original == GOOD.format(7, 8) and got[1005, "texto"].original == GOOD.format(7, 7)
    assert got[1006, "texto"].perdido and got[1006, "texto"].cadeia is None
    assert got[1007, "texto"].original.endswith("amanhã. manhã") and got[3000, "arquivo"].original == "Serviço.pdf"
    assert mojibake.found(spark, garbled).count() == 9


def test_the_dictionaries_decide(spark, monkeypatch):
    # a code page that turns letters into other known letters: only what the language is like tells which reading is right
    good = "a conta elétrica do prédio {} cobre o café, É SÉRIE ÚTIL"
    df = spark.createDataFrame([(good.format(i), f"elétrica-{i}.pdf") for i in range(300)], "texto string, arquivo string")
    wrong = [good.format(i).replace("É", "E").replace("Ú", "U").encode("cp1252").decode("cp850") for i in range(900, 910)]
    assert "elÚtrica do prÚdio" in wrong[0]

    def restored() -> int:
        model = mojibake.fit(df, ["texto", "arquivo"])
        assert set("éÚÉ") <= model.known
        return sum("elétrica do prédio" in model.restore(t)[0] for t in wrong)

    with_them = restored()
    monkeypatch.setattr(mojibake.Restorer, "packed", lambda self, text: 0)
    assert (with_them, restored()) == (10, 0)


def test_chains_of_three_links_and_mixed_fields(spark, garbled):
    model = mojibake.fit(garbled, ["texto", "arquivo"])
    thrice = GOOD.format(1, 1)
    for _ in range(3):
        thrice = thrice.encode().decode("latin-1")
    assert model.restore(thrice)[0] == GOOD.format(1, 1)
    mixed = GOOD.format(1, 1) + " " + GOOD.format(2, 2).encode().decode("cp850") + " " + GOOD.format(3, 3).encode().decode("cp1252", "ignore")
    text, chains = model.restore(mixed)
    assert text.startswith(GOOD.format(1, 1) + " " + GOOD.format(2, 2)) and len(chains) == 2
    assert model.restore(GOOD.format(1, 1)) == (GOOD.format(1, 1), [])


def test_the_sample_takes_equal_values_once(spark):
    rows = [("igual a todos os outros", "a.pdf")] * 500 + [(GOOD.format(i, i), f"b{i}.pdf") for i in range(50)]
    df = spark.createDataFrame(rows, "texto string, arquivo string")
    assert mojibake.fit(df.repartition(1), ["texto", "arquivo"]).raw == mojibake.fit(df.repartition(9), ["texto", "arquivo"]).raw


def test_the_dictionaries_learn_from_every_value(spark):
    # the texts that hold the words are the last by hash, behind thousands of others: no choice of values by hash sees them
    other = spark.range(20_000).selectExpr("concat('nota fiscal ', id, ' do setor') AS v").where("xxhash64(v) < 0")
    own = spark.range(8_000).selectExpr("concat('rede elétrica do prédio ', id) AS v").where("xxhash64(v) > 0")
    assert other.count() > 8_000 and own.count() > 3_000
    df = other.union(own).selectExpr("v AS texto", "CAST(NULL AS string) AS arquivo")
    model = mojibake.fit(df, ["texto", "arquivo"])
    assert any("elétrica do".encode() in raw for raw in model.raw)
    assert model.restore("a rede elÚtrica do prÚdio 9")[0] == "a rede elétrica do prédio 9"


def test_counts_of_pairs_equal_brute_force(monkeypatch):
    values = ["a conta 12 de luz", "a conta 77 de luz", None, "", " ", "só", "conta de the of and", "á" * 50, "Â£ spoilt", "µ e µ"] * 3
    want = Counter({("valor", b""): 27, ("sinal", "µ".encode()): 3, ("pt", b"a conta"): 6, ("pt", b"conta 00"): 6, ("pt", b"00 de"): 6, ("pt", b"de luz"): 6})
    want += Counter({("pt", "só".encode()): 3, ("pt", ("á" * 20).encode() + b" " + ("á" * 20).encode()): 3, ("pt", ("á" * 20).encode() + b" " + ("á" * 10).encode()): 3})
    want += Counter({("pt", "µ e".encode()): 3, ("pt", "e µ".encode()): 3, ("en", b"conta de"): 3, ("en", b"de the"): 3, ("en", b"the of"): 3, ("en", b"of and"): 3})
    for held, size in ((1, 4), (200_000, 4), (3, 100)):
        monkeypatch.setattr(mojibake, "HELD", held)
        got = Counter()
        for part in mojibake.counted(pa.table({"texto": pa.array(values, pa.string())}).to_batches(size)):
            for tipo, item, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                got[tipo, item] += n
        assert got == want


def test_mojibake_empty(spark, garbled):
    assert mojibake.found(spark, garbled.where("false")).collect() == []
    assert mojibake.found(spark, garbled.where("texto IS NULL")).collect() == []


def test_redecode_is_exact_round_trip():
    word = "ação-é-“ü”-Ω"
    for wrong in ("cp850", "mac_roman", "latin-1"):
        assert mojibake.redecode(word.encode().decode(wrong), wrong, "utf-8") == word
    assert mojibake.redecode("NÃO", "cp1252", "utf-8") == "NÃO"
