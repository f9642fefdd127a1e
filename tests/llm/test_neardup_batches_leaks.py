import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from acervo.llm import batches, leaks, neardup

WORDS = [f"palavra{i}" for i in range(3000)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.12 else "") for _ in range(n))


def _edit(rng, text, rate):
    out = []
    for w in text.split():
        x = rng.random()
        out += [] if x < rate / 2 else [w, rng.choice(WORDS)] if x < rate else [w]
    return " ".join(out)


def _sets(rows):
    return {i: frozenset(zip(w, w[1:], w[2:])) for i, t in rows if t and len(w := neardup.words_of(t)) > 2}


def _like(a, b):
    return len(a & b) >= 0.5 * len(a | b)


@pytest.fixture(scope="module")
def papers():
    rng = random.Random(1)
    rows = []
    for g in range(40):
        base = _text(rng, rng.randint(20, 160))
        rows += [_edit(rng, base, 0.04) if k else base for k in range(rng.choice([1, 1, 2, 3, 9]))]
    rows += ["mesma frase curta de todos os dias"] * 30 + [rows[0].upper(), rows[1].replace("palavra", "pala" + chr(0x200B) + "vra"), rows[2].replace("palavra", "p" + chr(0x430) + "lavra"), "um dois", "", "  ", None]
    long = _text(rng, 70_000)
    return [*enumerate([*rows, long, long + " fim"], 1)]


def _groups(rows):
    sets, up = _sets(rows), {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if _like(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    by = defaultdict(list)
    for x in up:
        by[root(x)].append(x)
    return {(a, b) for own in by.values() for a in own for b in own if a < b}


def test_groups_against_all_pairs(spark, papers):
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in papers], "id long, texto string, n int, marca string")
    got = {(r.id_a, r.id_b) for r in neardup.found(spark, df).collect()}
    assert got == _groups(papers)
    assert neardup.found(spark, df.where("false")).collect() == []
    assert {(r.id_a, r.id_b) for r in neardup.found(spark, df.union(df)).collect()} == got


def test_banded_alignment_is_lcs_within_the_band():
    rng = random.Random(2)
    for _ in range(30):
        a = np.array([rng.randrange(6) for _ in range(rng.randint(1, 18))])
        b = np.array([rng.randrange(6) for _ in range(rng.randint(1, 18))])
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = max(d[i, j] + (a[i] == b[j]), d[i, j + 1], d[i + 1, j])
        assert neardup.banded([(a, b)])[0] == d[-1, -1]


def test_sketches_keep_text_order():
    a, b = np.arange(1, 40, dtype=np.int32), np.concatenate([np.arange(20, 40), np.arange(1, 20)]).astype(np.int32)
    none = np.zeros(0, np.uint64)
    both, text = neardup.sketches(np.concatenate([a, a, b]), np.array([39, 78, 117]), none)
    own = [set(both[text == i]) for i in range(3)]
    assert own[0] == own[1] and 0 < len(own[0] & own[2]) < len(own[0])


def _accept(documents, inbox):
    hashes = {h.lower() for _, h, _ in documents if h}
    held, out = list(_sets([(("d", i), t) for i, _, t in documents]).values()), {}
    for e, _, h, t, err in inbox:
        if err:
            continue
        own = _sets([(0, t)]).get(0)
        if h and h.lower() in hashes:
            out[e] = "exata"
        elif own and any(_like(own, s) for s in held):
            out[e] = "quase"
        else:
            if h:
                hashes.add(h.lower())
            if own:
                held.append(own)
    return out


def test_batches_against_one_after_the_other(spark):
    rng = random.Random(4)
    base = [_text(rng, 90) for _ in range(30)]
    documents = [(i, f"h{i}", base[i]) for i in range(12)] + [(20, None, None), (21, "h21", ""), (22, "h22", "  ")]
    inbox = []
    for e in range(1, 121):
        i = rng.randrange(30)
        text = rng.choice([base[i], base[i].upper(), _edit(rng, base[i], 0.03), base[i] + " " + _text(rng, 200), None, ""])
        digest = rng.choice([f"H{i}", f"h{i}", f"e{e}", None])
        inbox.append((e, 1 + (e - 1) // 40, digest, text, "quebrado" if rng.random() < 0.1 else None))
    inbox += [(200 + k, 4, f"novo{k}", "copia sempre igual de um texto que chega muitas vezes no mesmo lote", None) for k in range(40)]
    inbox += [(300, 4, "r1", None, None), (301, 4, "R1", None, None)]
    docs = spark.createDataFrame(documents, "id long, hash string, texto string").withColumn("chave", F.lit(1))
    box = spark.createDataFrame(inbox, "entrada_id long, lote int, hash string, texto string, erro string").withColumn("classe", F.lit("x"))
    lots = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "lote int")
    got = {r.entrada_id: r.tipo for r in batches.found(spark, docs, box, lots).collect()}
    assert got == _accept(documents, inbox)
    assert batches.found(spark, docs.where("false"), box.where("false"), lots).collect() == []
    assert batches.found(spark, docs, box, lots.where("false")).collect() == []


def test_leaks_against_all_windows(spark):
    rng = random.Random(6)
    common = _text(rng, 30)
    items = [(i, _text(rng, 40) + " " + common) for i in range(20)] + [(98, None), (99, "curto demais"), (3, _text(rng, 15))]
    docs = []
    for i in range(200):
        words = _text(rng, 80).split()
        source = rng.choice(items[:20])[1].split()
        n = rng.choice([0, 8, 11, 12, 13, 40])
        at = rng.randrange(len(source) - n)
        words[30:30] = [w.upper() for w in source[at : at + n]]
        docs.append((i, ("\n" if i % 2 else " ").join(words)))
    docs += [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (503, "x " * 60_000 + items[1][1])]
    windows = defaultdict(set)
    for i, t in items:
        w = neardup.words_of(t or "")
        for k in range(len(w) - 11):
            windows[tuple(w[k : k + 12])].add(i)
    want = set()
    for i, t in docs:
        w = neardup.words_of(t or "")
        for k in range(len(w) - 11):
            want |= {(i, x) for x in windows.get(tuple(w[k : k + 12]), ())}
    corpus = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, pos int, item int")
    held = spark.createDataFrame(items, "item_id long, enunciado string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(spark, corpus, held).collect()} == want
    assert leaks.leaks(spark, corpus, held.where("false")).collect() == []
    assert leaks.leaks(spark, corpus.where("false"), held).collect() == []
    before, leaks.BROADCAST = leaks.BROADCAST, 10
    try:
        assert {(r.doc_id, r.item_id) for r in leaks.leaks(spark, corpus, held).collect()} == want
    finally:
        leaks.BROADCAST = before


def test_large_groups_of_near_copies_and_of_copies(spark):
    rng = random.Random(6)
    base, other, many = [_text(rng, 100).split() for _ in range(3)]
    rows = []
    for own, k in ((base, 60), (many, 3)):  # each with one word changed
        for at in rng.sample(range(5, 95), k):
            rows.append(" ".join([*own[:at], f"outra{at}", *own[at + 1 :]]))
    rows += [" ".join(many)] * (neardup.AT_LEAST + 10) + [" ".join(other)]
    got = {(r.id_a, r.id_b) for r in neardup.found(spark, spark.createDataFrame([*enumerate(rows)], "id long, texto string")).collect()}
    assert got == _groups([*enumerate(rows)])


def test_a_bucket_is_compared_whole(spark, monkeypatch):
    # all texts in one bucket: chains whose ends differ, behind more dissimilar texts than pivots
    monkeypatch.setattr(neardup, "meetings", lambda b: b.select(F.lit(1).cast("long").alias("balde"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b")).distinct())
    rng, rows = random.Random(7), []
    for _ in range(12):
        rows.append(_text(rng, 120))
        for _ in range(rng.randint(0, 5)):
            words = rows[-1].split()
            rows.append(" ".join([*words[25:], *_text(rng, 25).split()]))
    rng.shuffle(rows)
    df = spark.createDataFrame([*enumerate(rows)], "id long, texto string")
    for held in (neardup.HELD, 10):
        monkeypatch.setattr(neardup, "HELD", held)
        assert {(r.id_a, r.id_b) for r in neardup.found(spark, df).collect()} == _groups([*enumerate(rows)])


def test_bitmaps_exclude_no_similar_pair():
    rng = random.Random(8)
    texts = [np.array([rng.randrange(9) for _ in range(rng.randint(3, 400))], np.int32) for _ in range(40)]
    texts += [np.concatenate([t[: rng.randint(3, len(t))], t[:9]]) for t in texts]
    own = [set(neardup.kmers(t).tolist()) for t in texts]
    maps = neardup.Maps(np.array([len(s) for s in own]), [neardup.bitmap(t)[1] for t in texts])
    may = maps.may(maps)
    assert all(may[i, j] for i, a in enumerate(own) for j, b in enumerate(own) if _like(a, b))


def test_batches_of_texts_without_long_sentences(spark):
    form = "Nome: Rita. Cidade: Bom Retiro. Valor: cem reais. Uso: casa. Pago: sim. Data: ontem. Fim."
    long = "uma frase com mais de cinco palavras que vem inteira outra frase que tem mais de cinco palavras"
    documents = [(1, "d1", "dois tres quatro"), (2, "d2", form), (3, "d3", long)]
    inbox = [(1, 1, None, "dois tres quatro", None), (2, 1, "e2", form.replace("casa", "loja"), None), (3, 1, None, long.replace(" que", ". que"), None)]
    inbox += [(4, 1, None, "cinco seis sete", None), (5, 2, "e5", "Cinco, seis. Sete!", None), (6, 2, None, "oito. nove. dez. onze", None)]
    docs = spark.createDataFrame(documents, "id long, hash string, texto string")
    box = spark.createDataFrame(inbox, "entrada_id long, lote int, hash string, texto string, erro string")
    got = {r.entrada_id: r.tipo for r in batches.found(spark, docs, box, spark.createDataFrame([(1,), (2,)], "lote int")).collect()}
    assert got == _accept(documents, inbox) == {1: "quase", 2: "quase", 3: "quase", 5: "quase"}


def _boxes(spark, documents, inbox):
    docs = spark.createDataFrame(documents, "id long, hash string, texto string")
    box = spark.createDataFrame(inbox, "entrada_id long, lote int, hash string, texto string, erro string")
    return docs, box, spark.createDataFrame([(k,) for k in sorted({r[1] for r in inbox})], "lote int")


def _sentences(rng, count, size):
    return [[rng.choice(WORDS) for _ in range(size)] for _ in range(count)]


def test_batches_of_texts_edited_in_every_sentence(spark):
    rng, documents, inbox = random.Random(9), [], []
    for i in range(60):
        own = _sentences(rng, 12, 16)
        documents.append((i, f"d{i}", " ".join(" ".join(x) + "." for x in own)))
        for x in own:
            x[rng.randrange(16)] = rng.choice(WORDS)
        inbox.append((i, 1, f"e{i}", " ".join(" ".join(x) + "." for x in own), None))
    docs, box, lots = _boxes(spark, documents, inbox)
    got = {r.entrada_id: r.tipo for r in batches.found(spark, docs, box, lots).collect()}
    assert got == _accept(documents, inbox) and len(got) == 60


def test_batches_of_hot_groups(spark, monkeypatch):
    # near copies of one text in the history and of another in the batches, more than HOT, behind set phrases of all
    monkeypatch.setattr(batches, "HOT", 4)
    rng = random.Random(10)
    phrases = [" ".join(x) for x in _sentences(rng, 3, 12)]
    old, new = (" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(2))
    vary = lambda t: t.replace(" ", f" v{rng.randrange(999)} ", 1) + ". " + ". ".join(phrases)
    documents = [(i, f"d{i}", vary(old)) for i in range(40)] + [(100 + i, None, _text(rng, 50) + ". " + ". ".join(phrases)) for i in range(20)]
    inbox = [(e, 1 + e % 3, rng.choice([None, f"e{e % 30}"]), vary(rng.choice([old, new])) if e % 5 else ". ".join(rng.sample(phrases, 3)) + ". " + _text(rng, 30), None) for e in range(90)]
    order = sorted(inbox, key=lambda r: (r[1], r[0]))
    docs, box, lots = _boxes(spark, documents, inbox)
    assert {r.entrada_id: r.tipo for r in batches.found(spark, docs, box, lots).collect()} == _accept(documents, order)


def test_batches_in_two_calls_equal_one(spark):
    rng = random.Random(12)
    base = [_text(rng, 80) for _ in range(12)]
    documents = [(i, f"d{i}", base[i]) for i in range(4)]
    inbox = [(e, 1 + e // 10, rng.choice([None, f"d{e % 6}", f"e{e % 9}"]), _edit(rng, rng.choice(base), 0.03), None) for e in range(40)]
    docs, box, lots = _boxes(spark, documents, inbox)
    from acervo.plans.workspace import Workspace

    with Workspace(spark, "calls") as work:
        past = work.save(batches.features(docs.withColumn("k", F.col("id") * 2), "k", "hash", "texto"), "past")
        rows = work.save(batches.features(box.withColumn("k", F.col("entrada_id") * 2 + 1), "k", "hash", "texto", "lote"), "rows")
        history = batches.begin(spark, work, past)
        try:
            calls = [batches.check(history, rows.where(f"lote {x}")).collect() for x in ("<= 2", "> 2")]
        finally:
            history.drop()
    assert {(r.id - 1) // 2: r.tipo for call in calls for r in call} == _accept(documents, inbox)


def test_common_kmers_do_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["frase que vem em todo papel " + _text(rng, 20) for _ in range(120)]
    rows = neardup.tokens(spark.createDataFrame([*enumerate(texts)], "id long, texto string"), "id", "texto")
    want = neardup.common_kmers(rows.repartition(1))
    monkeypatch.setattr(neardup, "SEGMENT", 9)
    assert len(want) == 4 and all((neardup.common_kmers(rows.repartition(n)) == want).all() for n in (3, 16))
    monkeypatch.setattr(neardup, "NAMED", 5)
    assert (neardup.common_kmers(rows.repartition(3)) == want).all()


def test_recall_of_the_sketches_alone(spark):
    rng, pairs, rows = random.Random(14), [], []
    for i in range(400):
        base = _text(rng, 100)
        for rate in (0.02, 0.06, 0.1):
            rows.append(base)
            rows.append(_edit(rng, base, rate))
            pairs.append((len(rows) - 2, len(rows) - 1))
    texts = [np.array([neardup.Numbers()[w] for w in neardup.words_of(t)], np.int32) for t in rows]
    buckets, text = neardup.sketches(np.concatenate(texts), np.cumsum([len(t) for t in texts]), np.zeros(0, np.uint64))
    own = defaultdict(set)
    for b, t in zip(buckets.tolist(), text.tolist(), strict=True):
        own[t].add(b)
    sets = _sets(enumerate(rows))
    like = [(a, b) for a, b in pairs if _like(sets[a], sets[b])]
    assert len(like) > 900 and sum(bool(own[a] & own[b]) for a, b in like) >= 0.998 * len(like)


def _paragraphs(text):
    """By the definition, over the whole text: the numbers of its words, and its units with their sizes."""
    text = re.sub(r"[.;:!?…]+(?:\s|$)|\n\s*\n", chr(0x1D), neardup.consistent(text))
    text = neardup.folded(re.sub(r"(\d)\s+(?=[A-ZÀ-Ý])", r"\1" + chr(0x1E), text))
    number, own, units, short, covered = neardup.Numbers(), [], {}, {}, 0
    for sentence in text.split(chr(0x1D)):
        parts = [[number[w] for w in neardup.words_in(part)] for part in sentence.split(chr(0x1E))]
        whole = [n for part in parts for n in part]
        own += whole
        covered += len(whole) if len(whole) >= batches.LEAST_WORDS else 0
        for x in filter(None, [whole, *parts]):
            (units if len(x) >= batches.LEAST_WORDS else short)[np.array(x, np.int32).tobytes()] = len(x)
    raw = np.array(own, np.int32).tobytes()
    units |= short | {raw: len(own)} if 2 * covered < len(own) else {}
    return raw, {xxhash.xxh3_64_intdigest(x) - (1 << 63): n for x, n in units.items()}


def test_paragraphs_fold_a_stretch_once(monkeypatch):
    rng, folded, folds = random.Random(15), batches.folded, Counter()
    signs = "aZ9É. ;!?…\n\t2 İßς_-º½" + "".join(map(chr, (0xA0, 0x200B, 0x430, 0x301, 0xFF01, 0xFF21, 0x2003, 0x1D, 0x1E, 0x85, 0xFFE3, 0x660, 0x1D400, 0x3000, 0xFB01)))
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3_000)] + [_text(rng, 200) for _ in range(50)]
    texts += ["Nota 12. Valor 3\n\nTotal 4 . Fim", "", " ", "x" * 100_000 + " fim de um texto com mais de cinco palavras."]
    want = [_paragraphs(t) for t in texts]
    monkeypatch.setattr(batches, "folded", lambda t: (folds.update([t]), folded(t))[1])
    known = batches.Stretches()
    for _ in range(2):
        assert [(raw, dict(zip(u, n, strict=True))) for raw, u, n in (batches.paragraphs(t, known) for t in texts)] == want
    assert max(n for t, n in folds.items() if len(t) <= 64) == 1 and len(max(known, key=len)) <= 64


def test_members_and_labels():
    rng = random.Random(16)
    hashes = neardup.mix(np.arange(1, 4_000, dtype=np.uint64) * neardup._M3)
    for n in (0, 1, 2, 700):
        some = np.sort(np.concatenate([hashes[:n], np.array([0, 2**64 - 1], np.uint64)[: n // 2]]))
        assert (neardup.Members(some)(hashes) == np.isin(hashes, some)).all() and neardup.Members(some)(some).all()
    for most in (40, 10**9):
        text = np.sort([rng.randrange(20) for _ in range(600)])
        own = neardup.mix(np.array([rng.randrange(most) for _ in text], np.uint64))
        seen, want = Counter(), []
        for k, t in zip(own, text.tolist(), strict=True):
            n = seen[k, t]
            seen[k, t] += 1
            want.append(neardup.mix(np.array([k]) + np.array([n], np.uint64) * neardup._M3)[0] if n else k)
        assert neardup.labelled(own, text).tolist() == [int(x) for x in want]
    assert len(neardup.labelled(own[:0], text[:0])) == 0
