"""Problem 1: text that looks the same but is written with other characters.

Fields are cut into words and the stretches between them.  The distinct odd pieces are mapped (width and ligature forms,
letters of another alphabet inside a Latin word, invisible characters, unusual spaces) and keyed by what their look may be
read as; all ordinary words of the corpus have such a key too.  Keys are grouped in SQL under ``COLLATE UNICODE``, which
tells accents and case apart but not a composed letter from its parts, so a class holds every spelling of the corpus that
looks alike.  Its canonical member is an ordinary spelling before an odd one, then the one the corpus has most often, then
the shortest, then the least: so it is the corpus that reads a letter which looks like two (``EITHER``).  It is joined back to
every odd piece; where it has another letter than the piece's look allows, the mapped form stands.

Defined cases: null, empty and blank fields have no case and keep their value; superscripts, ordinals, fractions, dashes,
quotes and signs are ordinary; words wholly in another alphabet stay; a no-break space or soft hyphen that is a byte of
wrongly decoded text stays; joiners inside an emoji stay; repeated ids give one row a field; other columns are ignored.
Every text is read whole and every odd piece of it is looked up: the dictionary is a table that is joined, of any size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.plans.workspace import Workspace

# Letters of other alphabets and the Latin letters that they imitate.
LOOKALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ї": "Ï",
    "а": "a", "е": "e", "к": "k", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ά": "Á", "Έ": "É", "Ί": "Í", "Ό": "Ó",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ά": "á", "έ": "é",
    "ί": "í", "ό": "ó", "ύ": "ú", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ɑ": "a", "ɡ": "g", "Ӏ": "I",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

# Letters whose look is read as either of two, whichever makes a word of the corpus.
EITHER = {"І": "Il", "Ι": "Il", "ӏ": "Il", "Ӏ": "Il", "υ": "uv", "ս": "uv", "ѵ": "uv", "ν": "uv"}


def _small_capitals() -> dict[str, str]:
    """Small capitals, by their names in Unicode."""
    start, out = "LATIN LETTER SMALL CAPITAL ", {}
    for code in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D30), *range(0xA730, 0xA800)):
        name = unicodedata.name(chr(code), "")
        if name.startswith(start) and len(name) == len(start) + 1:
            out[chr(code)] = name[-1].lower()
    return out


LOOKALIKE |= _small_capitals()


def _span(*codes: int | tuple[int, int]) -> str:
    """The inside of a regular expression's class, of code points and ranges of them."""
    return "".join(chr(c) if isinstance(c, int) else f"{chr(c[0])}-{chr(c[1])}" for c in codes)


NBSP, SHY, ZWJ, VS16 = map(chr, (0xA0, 0xAD, 0x200D, 0xFE0F))
WIDE = _span((0xFF01, 0xFFEF), (0xFB00, 0xFB06), (0x2160, 0x2188), (0x2460, 0x24EA))
#: Letters in another style that are signs when they stand alone; those of units are left out.
STYLED = _span(0x2102, (0x210A, 0x2113), 0x2115, (0x2119, 0x211D), 0x2124, (0x212C, 0x2134), (0x213C, 0x213F), (0x2145, 0x2149))
BOLD = _span((0x1D400, 0x1D7FF))
MARKS = _span((0x300, 0x36F))
HIDDEN = _span(0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x180E, (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), 0x3164, 0xFEFF)
SPACES = _span(0xA0, 0x1680, (0x2000, 0x200A), 0x202F, 0x205F, 0x3000)
OTHER = "".join(LOOKALIKE)
ODD = f"[{WIDE}{BOLD}{STYLED}{MARKS}{HIDDEN}{SPACES}{OTHER}]"
#: The same for Java, whose classes of many ranges are slow: only what is beyond Latin-1, or one of its two blanks, is looked at.
FAST = f"(?=[{NBSP}{SHY}{_span((0x100, 0x10FFFF))}]){ODD}"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: An ordinary word.
WORD = rf"\p{{L}}[\p{{L}}\p{{N}}]*"
PIECE = rf"[\p{{L}}\p{{M}}\p{{N}}{HIDDEN}]+|[^\p{{L}}\p{{M}}\p{{N}}{HIDDEN}]+"

#: What looks odd but belongs to wrong decoding or to an emoji is set aside as a private character meanwhile.
ASIDE = (
    (f"([ÂÃÄÅÎÏÐÑ]){NBSP}", NBSP, chr(0xE000)),
    (f"([ÂÃÄÅÎÏÐÑ]){SHY}", SHY, chr(0xE001)),
    (rf"([\p{{So}}\p{{Sk}}{VS16}]){ZWJ}(?=[\p{{So}}\p{{Sm}}])", ZWJ, chr(0xE002)),
)
#: Text of DOS letters read as Windows letters: there the no-break space was an "a" with acute accent.
DOS = rf"\p{{L}}[‡‚ˆ¢£„]|[‡‚ˆ¢£]\p{{L}}|[{_span((0x80, 0x9F))}]"

_WIDE, _STYLED, _MARKS, _HIDDEN, _SPACES = (re.compile(f"[{x}]") for x in (WIDE + BOLD, STYLED, MARKS, HIDDEN, SPACES))
_LATIN, _TO = re.compile(f"[{LATIN}]"), str.maketrans(LOOKALIKE)


def mapped_form(piece: str) -> str:
    """One piece in the usual characters."""
    out = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), piece)
    out = _SPACES.sub(" ", out)
    if any(c.isalpha() for c in out) and not _LATIN.search(out):
        return out  # a word of another alphabet keeps its joiners, marks and letters
    out = _STYLED.sub(lambda m: unicodedata.normalize("NFKC", m[0]), out)
    out = _HIDDEN.sub("", out).translate(_TO) if _LATIN.search(out) else _HIDDEN.sub("", out)
    return unicodedata.normalize("NFC", out) if _MARKS.search(out) else out


#: A key takes one of the two letters for both.
_KEY = "Iv", "lu"


def read_as(piece: str, form: str, other: str) -> str:
    """``other`` if the look of the odd ``piece``, whose mapped form is ``form``, may be read as it; else ``form``."""
    pairs = {EITHER[c] for c in piece if c in EITHER}
    same = len(form) == len(other) and all(a == b or "".join(sorted((a, b))) in pairs for a, b in zip(form, other, strict=True))
    return other if same or unicodedata.normalize("NFC", other) == form else form


@F.pandas_udf(T.StringType())
def _read(pieces: pd.Series, forms: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([read_as(*x) for x in zip(pieces, forms, others, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _mapped(pieces: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pieces:
        yield s.map(mapped_form)


def _set_aside(c):
    out = reduce(lambda c, x: F.regexp_replace(c, x[0], "$1" + x[2]), ASIDE, c)
    return F.when(c.rlike(DOS), F.translate(out, NBSP, chr(0xE000))).otherwise(out)


def _put_back(c):
    return F.translate(c, "".join(x[2] for x in ASIDE), "".join(x[1] for x in ASIDE))


def fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``id``, ``campo``, ``valor`` of the fields that hold any odd character, the set-aside ones apart."""
    odd = df.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor")) for c in columns])).alias("x"))
    odd = odd.select("id", "x.campo", "x.valor").where(F.col("valor").rlike(FAST))
    return odd.withColumn("valor", _set_aside(F.col("valor"))).where(F.col("valor").rlike(FAST))


def ordinary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``palavra`` and ``n``: the ordinary words of the corpus and how often it has them, added up before they are shuffled."""
    texts = df.select(F.explode(F.array(*columns)).alias("v")).where("v IS NOT NULL")
    # stretches between blanks are counted first: few are distinct, and only these are cut into words
    parts = texts.select(F.explode(F.split("v", "[ \t\r\n]+")).alias("trecho")).groupBy("trecho").agg(F.count("*").alias("n"))
    words = parts.select(F.explode(F.regexp_extract_all("trecho", F.lit(WORD), F.lit(0))).alias("palavra"), "n")
    return words.groupBy("palavra").agg(F.sum("n").alias("n")).where(~F.col("palavra").rlike(FAST))


def canonical(spark: SparkSession, pieces: DataFrame, words: DataFrame) -> DataFrame:
    """``peca`` and its ``canonica`` for a table of distinct pieces and one of the corpus's words (``palavra``, ``n``)."""
    members = pieces.withColumn("forma", _mapped("peca")).withColumn("chave", F.translate("forma", *_KEY))
    chosen = spark.sql(
        """
        WITH candidatas AS (
          SELECT chave AS classe, peca AS membro, CAST(0 AS BIGINT) AS n FROM {members} UNION ALL SELECT chave, forma, 0 FROM {members}
          UNION ALL SELECT w.chave, w.palavra, w.n FROM {words} w LEFT SEMI JOIN {members} m ON w.chave COLLATE UNICODE = m.chave COLLATE UNICODE),
        classes AS (
          SELECT classe COLLATE UNICODE AS classe, min_by(membro, struct(membro RLIKE :odd, -n, length(membro), membro)) AS canonica
          FROM candidatas GROUP BY classe COLLATE UNICODE)
        SELECT m.peca, m.forma, c.canonica FROM {members} m JOIN classes c ON m.chave COLLATE UNICODE = c.classe
        """,
        args={"odd": FAST},
        members=members,
        words=words.withColumn("chave", F.translate("palavra", *_KEY)),
    )
    return chosen.select("peca", _read("peca", "forma", "canonica").alias("canonica")).where("peca <> canonica")


def occurrences(spark: SparkSession, df: DataFrame, key: str, columns: list[str], work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The odd fields; and ``id``, ``campo``, ``peca``, ``canonica`` of each odd piece in them that has another canonical form."""
    odd = work.save(fields(df, key, columns), "fields")
    each = odd.select("id", "campo", F.explode(F.array_distinct(F.regexp_extract_all("valor", F.lit(PIECE), F.lit(0)))).alias("peca"))
    each = work.save(each.where(F.col("peca").rlike(FAST)), "pieces")
    names = canonical(spark, work.save(each.select("peca").distinct(), "distinct"), work.save(ordinary(df, columns), "words"))
    return odd, each.join(work.save(names, "canonical"), "peca")


def found(spark: SparkSession, df: DataFrame, key: str = "id", columns: tuple[str, ...] = ("texto", "categoria")) -> DataFrame:
    """``id`` and ``campo`` of every field with a piece that is not its class's canonical member."""
    work = Workspace(spark, "lookalike")
    return work.finish(occurrences(spark, df, key, [*columns], work)[1].select("id", "campo").distinct())


def consistent(spark: SparkSession, df: DataFrame, key: str = "id", columns: tuple[str, ...] = ("texto", "categoria")) -> DataFrame:
    """``id``, ``campo``, ``forma``: every reported field in its consistent form, without unusual spaces at its ends.

    ``id`` has to be unique.
    """
    odd, each = occurrences(spark, df, key, [*columns], Workspace(spark, "lookalike"))
    swaps = each.groupBy("id", "campo").agg(F.map_from_entries(F.collect_set(F.struct("peca", "canonica"))).alias("trocas"))
    inner = F.regexp_replace("valor", f"^[{SPACES}]+|[{SPACES}]+$", "")
    pieces = F.regexp_extract_all(inner, F.lit(PIECE), F.lit(0))
    whole = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("trocas", p), p)), "")
    return odd.join(swaps, ["id", "campo"]).select("id", "campo", _put_back(whole).alias("forma"))
