"""Problem 5: noise in the text of scanned pages.

* caractere: words are grouped by a skeleton in which confusable glyphs are one; in each class the frequent form that the
  neighbouring words support replaces the rare ones.
* cabecalho: lines with masked digits and confusable glyphs made one, repeated inside a text.
* pagina: lines that hold a page number and nothing else.
* hifenizacao: a word that a mark breaks at a line's end, unless the corpus writes it with its own hyphen.

A first pass over the texts (Arrow batches) counts all words and all neighbouring pairs, added up within segments of at most
``SEGMENT`` texts and then over all of them, so how texts are split changes nothing.  The classes then tell which spellings
are rare; a second pass gives the neighbours of their occurrences, found by a bitmap of their hashes of a fixed size
(``BITS``) and made exact by a join.  Everything after that is joins on words and SQL windows over the lines of the affected
texts.  A pair of neighbours is known by the hash of its words and supports a form if the corpus has it twice.

A header has ``HEADER`` characters at least and at most: longer lines that come again are paragraphs.  Words of up to three
characters are corrected only if they hold a digit or sign, and only if both neighbours support the form.

Defined cases: null, empty and blank texts have no noise; a text of one line can have misread characters only; pure
numbers and codes are never corrected; missing or swapped letters have another skeleton and stay; ties between forms of a
class go to the lesser form; repeated ids give one row; other columns are ignored; whole texts are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.plans.workspace import Workspace

SEGMENT = 20_000
#: A form has to be so many times as frequent as a rare spelling of its class that is made of letters only, or that holds
#: a digit or sign between letters.
RATIO_LETTERS, RATIO_SIGNS = 30, 3
HEADER = 8, 90
BITS = 1 << 24

# Glyphs that scanners confuse, longer ones first; and line marks.
GROUPS = (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"))
SINGLES = str.maketrans({
    "0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "$": "s", "9": "g", "q": "g", "@": "a", "4": "a", "+": "t", "7": "t",
    "e": "c", "3": "c", "8": "b", "6": "b", "2": "z", "ä": "ã", "ö": "õ", "ü": "ú",
})
SIGNS = "0123456789|@+$"
MARK = "-¬" + chr(0xAD) + chr(0x2010)

_END = re.compile(rf"([{MARK}])[ \t]*\r?\n")
_LEFT = re.compile(r"(?:^|(?<![\w.@+-]))[^\W\d_]+(?:-[^\W\d_]+)*$")
_WORD = re.compile(r"[\w@+|$][\w@+|$'’-]*")
_FIRST = re.compile(r"[\w@.+-]+")
_LETTERS = re.compile(r"[^\W\d_]")
_N = r"[0-9oOlI|]{1,4}"
PAGE = re.compile(rf"(?:p[aá@4]g(?:[iíl1|]n[aá@4])?|f[o0][l1|]ha|f[l1|]s?|page)\.?\s*(?:n[º°o.]{{0,2}})?\s*{_N}(?:\s*(?:/|de|of)\s*{_N})?|-+\s*{_N}\s*-+|\[\s*{_N}\s*\]|\(\s*{_N}\s*\)|{_N}\s*/\s*{_N}", re.IGNORECASE)
_BARE = re.compile(r"\d{1,4}")


def skeleton(word: str) -> str:
    """The word in small letters with confusable glyphs made one."""
    s = word.casefold()
    for a, b in GROUPS:
        s = s.replace(a, b)
    return s.translate(SINGLES)


class Skeletons(dict):
    """Word to its skeleton, remembered."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        w = word.strip("|+$@'’-")
        s = self[word] = "9" if w.isdigit() else skeleton(w)
        return s


_SKELETONS = Skeletons()


def line_form(line: str) -> str:
    """What stays the same of a header: skeletons of its words, numbers masked, no punctuation."""
    return " ".join([s for w in _WORD.findall(line) if (s := _SKELETONS[w])])


def page_lines(lines: list[str]) -> list[int]:
    """Positions of the lines that hold nothing but a page number; bare numbers count from two in sequence."""
    out, bare = [], []
    for i, line in enumerate(lines):
        if line:
            if PAGE.fullmatch(line):
                out.append(i)
            elif _BARE.fullmatch(line):
                bare.append((i, int(line)))
    follows = {j for (i, a), (j, b) in zip(bare, bare[1:], strict=False) if b == a + 1 for j in (i, j)}
    return sorted(out + [i for i in dict.fromkeys(follows)])


def header_lines(lines: list[str]) -> list[int]:
    """Positions of the lines whose form comes again in the text, has two words or more and never goes on a sentence."""
    at: dict[str, list[int]] = defaultdict(list)
    for i, line in enumerate(lines):
        if HEADER[0] <= len(line) <= HEADER[1]:
            at[line_form(line)].append(i)
    found = []
    for form, where in at.items():
        words = [w for w in form.split() if len(w) > 2 and not w.isdigit()]
        if len(where) > 1 and len(words) > 1 and not any(lines[i][0].islower() for i in where):
            found += where
    return sorted(found)


def halves(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Where a word that a mark breaks at a line's end begins and its line ends, its left half and the mark."""
    for m in _END.finditer(text):
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        word = line[len(line) - len(line.split()[-1]) :] if line and not line[-1].isspace() else ""
        if left := _LEFT.search(word):
            yield m.start() - len(left[0]), m.end(), left[0], m[1]


def breaks(text: str) -> Iterator[tuple[str, str, str]]:
    """Left half, mark and right half of each word that a mark breaks at a line's end."""
    for _, end, left, mark in halves(text):
        while end < len(text):
            to = text.find("\n", end)
            line, end = text[end : to if to >= 0 else None].strip(), to + 1 if to >= 0 else len(text)
            if line and not PAGE.fullmatch(line):
                right = _FIRST.match(line)
                word = right[0].rstrip(".-") if right else ""
                if word and "@" not in word and _LETTERS.match(word):
                    yield left, mark, re.split(r"[^\w-]", word)[0]
                break


def unbroken(text: str) -> str:
    """The text without the left halves of broken words."""
    if not _END.search(text):
        return text
    out, last = [], 0
    for a, b, _, _ in halves(text):
        out.append(text[last:a])
        last = b
    return " ".join([*out, text[last:]])


def hashed(word: str) -> int:
    """The hash of a word, the same that Spark's ``xxhash64`` gives."""
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def pair_hash(left, right):
    """The hash of two neighbours from the hashes of their words, in numpy or in Spark."""
    if isinstance(left, np.ndarray):
        return (left << np.int64(1)) ^ right
    return F.shiftleft(left, 1).bitwiseXOR(right)


class Segment:
    """Words of up to ``SEGMENT`` texts."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[np.ndarray] = []

    def add(self, text: str) -> None:
        number = self.number
        self.texts.append(np.array([number.setdefault(w, len(number)) for w in _WORD.findall(unbroken(text))], np.int32))

    def words(self) -> Iterator[tuple]:
        """The words that can be corrected or correct others, their classes and counts."""
        words = list(self.number)
        counts = np.bincount(np.concatenate([*self.texts, np.zeros(0, np.int32)]), minlength=len(words))
        for w, n in zip(words, counts.tolist(), strict=True):
            if _LETTERS.search(w):
                yield "p", None, w.casefold(), skeleton(w), None, None, n

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of all pairs of neighbours."""
        own = np.array([hashed(w.casefold()) for w in self.number], np.int64)
        flat = [pair_hash(own[t[:-1]], own[t[1:]]) for t in self.texts if len(t) > 1]
        return np.unique(np.concatenate([*flat, np.zeros(0, np.int64)]), return_counts=True)


def signals(spark: SparkSession, df: DataFrame, key: str, text: str, work: Workspace) -> DataFrame:
    """The first pass: counts of words (p) and of pairs (b, by hash in ``n``), broken words (h), page numbers and headers (l)."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"tipo string, id {kind}, palavra string, classe string, antes string, depois string, n long, vezes long"
    arrow_key = pa.int64() if kind == "bigint" else None

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        types = [pa.string(), arrow_key, *[pa.string()] * 4, pa.int64()]
        out = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        return pa.RecordBatch.from_arrays([*out, pa.nulls(len(rows), pa.int64())], names=["tipo", "id", "palavra", "classe", "antes", "depois", "n", "vezes"])

    def sums(segment: Segment) -> Iterator[pa.RecordBatch]:
        rows = list(segment.words())
        for i in range(0, len(rows), 50_000):
            yield pack(rows[i : i + 50_000])
        both, times = segment.pairs()
        for i in range(0, len(both), 100_000):
            n = len(both[i : i + 100_000])
            none = [pa.nulls(n, arrow_key or pa.string()), *[pa.nulls(n, pa.string())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(["b"] * n), *none, pa.array(both[i : i + n]), pa.array(times[i : i + n])], names=["tipo", "id", "palavra", "classe", "antes", "depois", "n", "vezes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, out = Segment(), []
        for part in batches:
            for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                segment.add(t)
                if "\n" in t:
                    lines = [x.strip() for x in re.split(r"[\n\f\v]", t)]
                    if pages := set(page_lines(lines)):
                        out.append(("l", k, "pagina", None, None, None, len(pages)))
                    if heads := header_lines([x for i, x in enumerate(lines) if i not in pages]):
                        out.append(("l", k, "cabecalho", None, None, None, len(heads)))
                    for a, mark, b in breaks(t):
                        out.append(("h", k, (a + b).casefold(), None, mark, f"{a}-{b}".casefold(), 1))
                if len(segment.texts) >= SEGMENT:
                    yield from sums(segment)
                    segment = Segment()
            if len(out) > 5_000:
                yield pack(out)
                out = []
        yield pack(out)
        yield from sums(segment)

    texts = df.select(key, text).where(F.length(F.trim(F.col(text))) > 0)
    return work.save(texts.mapInArrow(run, schema), "signals")


def occurrences(spark: SparkSession, df: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """The second pass: ``id``, ``palavra``, ``antes``, ``depois`` of every occurrence of the words of ``words``."""
    kind = df.schema[key].dataType.simpleString()
    at = F.pmod(F.xxhash64("palavra"), F.lit(BITS))
    blocks = words.select(F.bitmap_bucket_number(at).alias("bloco"), F.bitmap_bit_position(at).alias("bit"))
    bits = np.zeros(BITS + (1 << 15), bool)
    for r in blocks.groupBy("bloco").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        own = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        start = (r.bloco - 1) * (1 << 15) + 1 if r.bloco else 0
        bits[start : start + len(own)] |= own.astype(bool)[: len(bits) - start]
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    class Known(dict):
        def __missing__(self, word: str) -> bool:
            if len(self) > 300_000:
                self.clear()
            i = hashed(word.casefold()) % BITS
            known = self[word] = bool(shared.value[i >> 3] >> (7 - (i & 7)) & 1)
            return known

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for part in batches:
            rows, words, before, after = [], [], [], []
            for k, t in enumerate(part.column(1).to_pylist()):
                own = _WORD.findall(unbroken(t))
                for i, w in enumerate(own):
                    if known[w]:
                        rows.append(k)
                        words.append(w.casefold())
                        before.append(own[i - 1].casefold() if i else "")
                        after.append(own[i + 1].casefold() if i + 1 < len(own) else "")
            ids = part.column(0).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.string()) for x in (words, before, after)]], names=["id", "palavra", "antes", "depois"])

    texts = df.select(key, text).where(F.length(F.trim(F.col(text))) > 0)
    return texts.mapInArrow(run, f"id {kind}, palavra string, antes string, depois string")


def misread(spark: SparkSession, df: DataFrame, key: str, text: str, seen: DataFrame, work: Workspace) -> DataFrame:
    """``id``, ``palavra``, ``forma`` of the misread spellings that their neighbours support."""
    words = seen.where("tipo = 'p'").groupBy("classe", "palavra").agg(F.sum("n").alias("n"))
    odd = F.col("palavra").rlike(r"[\p{L}][0-9|@+$]|[0-9|@+$][\p{L}]")
    long = (F.length("palavra") > 3) & (F.length(F.regexp_replace("palavra", r"[^\p{L}]", "")) > 2)
    words = work.save(words.where(long | (F.length("palavra") < 4)).withColumn("curta", ~long), "words")
    plain = words.where(~odd)
    best = plain.groupBy("classe").agg(F.max_by(F.struct(F.col("palavra").alias("forma"), F.col("n").alias("nf")), F.struct("n", "palavra")).alias("b")).select("classe", "b.*")
    ratio = F.when(odd, F.lit(RATIO_SIGNS)).otherwise(RATIO_LETTERS)
    swaps = words.where(~F.col("curta") | odd).join(best, "classe").where((F.col("palavra") != F.col("forma")) & (F.col("nf") >= ratio * F.col("n")))
    swaps = work.save(swaps.select("palavra", "forma", "curta"), "swaps")
    each = occurrences(spark, df, key, text, swaps.select("palavra")).join(swaps, "palavra").distinct()
    hash_ = {c: F.xxhash64(c) for c in ("antes", "forma", "depois")}
    left, right = pair_hash(hash_["antes"], hash_["forma"]), pair_hash(hash_["forma"], hash_["depois"])
    each = work.save(each.select("id", "palavra", "forma", "curta", left.alias("esquerda"), right.alias("direita")), "nominated")
    pairs = seen.where("tipo = 'b'").groupBy("n").agg(F.sum("vezes").alias("vezes")).where("vezes > 1").select(F.col("n").alias("par"))
    both = each.select("id", "palavra", "forma", "curta", F.explode(F.array("esquerda", "direita")).alias("par"), "esquerda", "direita")
    known = both.join(pairs, "par", "left_semi").groupBy("id", "palavra", "forma", "curta", "esquerda", "direita").agg(F.countDistinct("par").alias("lados"))
    return known.where("NOT curta OR lados = 2").select("id", "palavra", "forma").distinct()


def broken(seen: DataFrame) -> DataFrame:
    """``id``, ``palavra`` (joined) and ``composta`` (with hyphen) of the broken words that don't own their hyphen."""
    words = seen.where("tipo = 'p'").groupBy("palavra").agg(F.sum("n").alias("n"))
    each = seen.where("tipo = 'h'").select("id", "palavra", F.col("depois").alias("composta"), F.col("antes").alias("marca"))
    whole = words.select("palavra", F.col("n").alias("inteira"))
    own = words.select(F.col("palavra").alias("composta"), F.col("n").alias("hifen"))
    both = each.join(whole, "palavra", "left").join(own, "composta", "left")
    return both.where((F.col("marca") != "-") | (F.coalesce("hifen", F.lit(0)) <= F.coalesce("inteira", F.lit(0)))).select("id", "palavra", "composta")


def found(spark: SparkSession, df: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """``id`` and ``tipo`` of the kinds of noise in each text."""
    work = Workspace(spark, "scans")
    seen = signals(spark, df, key, text, work)
    lines = seen.where("tipo = 'l'").select("id", F.col("palavra").alias("tipo"))
    letters = misread(spark, df, key, text, seen, work).select("id", F.lit("caractere").alias("tipo"))
    marks = broken(seen).select("id", F.lit("hifenizacao").alias("tipo"))
    return work.finish(lines.union(letters).union(marks).distinct().withColumnRenamed("id", key))


def repaired(spark: SparkSession, df: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """``id`` and ``reparado``: the affected texts without headers and page numbers, words joined and corrected, reflowed.

    Paragraphs end where a line is blank or ends a sentence well before the text's usual width.  ``key`` has to be unique.
    """
    work = Workspace(spark, "scans")
    seen = signals(spark, df, key, text, work)
    letters = misread(spark, df, key, text, seen, work).groupBy("id", "palavra").agg(F.min("forma").alias("forma"))
    letters = letters.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("palavra", "forma"))).alias("trocas"))
    joined = broken(seen).groupBy("id").agg(F.collect_set("composta").alias("partidas"))
    kinds = seen.where("tipo = 'l'").select("id").distinct().withColumn("linhas", F.lit(True))
    what = kinds.join(letters, "id", "full").join(joined, "id", "full")
    what = work.save(what, "what")
    affected = df.select(F.col(key).alias("id"), F.col(text).alias("texto")).join(what, "id")
    lines = affected.select("id", F.posexplode(F.pandas_udf(_kept, T.ArrayType(T.StringType()))("texto")).alias("n", "linha"), "trocas", "partidas")
    text_w = W.partitionBy("id").orderBy("n")
    lines = lines.withColumn("largura", F.max(F.length("linha")).over(W.partitionBy("id"))).withColumn("anterior", F.lag("linha").over(text_w))
    starts = F.col("anterior").isNull() | (F.col("linha") == "") | (F.col("anterior") == "") | (F.col("anterior").rlike(r"[.;:!?]$") & (F.length("anterior") < 0.75 * F.col("largura")))
    lines = lines.withColumn("paragrafo", F.sum(starts.cast("int")).over(text_w)).where("linha <> ''")
    paragraphs = lines.groupBy("id", "paragrafo").agg(F.sort_array(F.collect_list(F.struct("n", "linha"))).alias("l"), F.first("trocas").alias("trocas"), F.first("partidas").alias("partidas"))
    out = paragraphs.select("id", "paragrafo", F.pandas_udf(_joined, T.StringType())("l.linha", "partidas", F.map_entries("trocas")).alias("p"))
    return out.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragrafo", "p"))), lambda x: x["p"]), "\n\n").alias("reparado")).withColumnRenamed("id", key)


def keep_lines(text: str) -> list[str]:
    """The lines of a text without page numbers and without headers."""
    lines = [x.strip() for x in re.split(r"[\n\f\v]", text)]
    pages = set(page_lines(lines))
    rest = [i for i in range(len(lines)) if i not in pages]
    heads = {rest[i] for i in header_lines([lines[i] for i in rest])}
    return [lines[i] for i in rest if i not in heads]


def join_lines(lines: list[str], parts: Iterable[str] | None, swaps: dict[str, str] | None) -> str:
    """One paragraph of its lines: broken words joined, misread words corrected in their own case."""
    known, out = set(parts if parts is not None else ()), ""
    for line in lines:
        m = re.search(rf"([^\W\d_]+(?:-[^\W\d_]+)*)[{MARK}]$", out)
        right = re.match(r"[\w-]+", line)
        if m and right:
            whole = f"{m[1]}-{right[0]}".casefold() in known
            out = (out[:-1] if whole or out[-1] != "-" else out) + line
        else:
            out = f"{out} {line}" if out else line
    if swaps:
        def fix(m: re.Match) -> str:
            new = swaps.get(m[0].casefold())
            return m[0] if new is None else new.upper() if m[0].isupper() else new.capitalize() if m[0][0].isupper() else new

        out = _WORD.sub(fix, out)
    return out


def _kept(texts: pd.Series) -> pd.Series:
    return texts.map(keep_lines)


def _joined(lines: pd.Series, parts: pd.Series, swaps: pd.Series) -> pd.Series:
    maps = ({} if x is None else {e["key"]: e["value"] for e in x} for x in swaps)
    return pd.Series([join_lines(list(a), b, c) for a, b, c in zip(lines, parts, maps, strict=True)], dtype=object)
