"""Column functions on text: normal form, whole-word tests, SQLite's LIKE, parts of file names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a word of letters, digits and underscores begins or ends.  Java's own test counts joiners as part of words.
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    """Lower case, compatibility decomposition without combining marks, white space runs as one space."""
    if text.isascii():
        return _SPACE.sub(" ", text.lower())
    out = unicodedata.normalize("NFKD", text.lower())
    return _SPACE.sub(" ", "".join(c for c in out if c < "̀" or not unicodedata.combining(c)))


def normalized(text: Column) -> Column:
    """``normal`` of a column, in Arrow batches: Spark has no built-in decomposition.  Null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(normal, na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())(text)


def has_word(text: Column, term: str) -> Column:
    """Whether ``term`` stands in a normalised text as a whole word or words."""
    return text.contains(term) & text.rlike(rf"{EDGE_BEFORE}\Q{term}\E{EDGE_AFTER}")


@lru_cache(1)
def _digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and the ASCII ones they stand for."""
    own = [chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(own), "".join(str(unicodedata.digit(c)) for c in own)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, *_digits())


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sqlite_like(text: Column, pattern: str) -> Column:
    """``LIKE`` as SQLite has it: case is folded for A to Z only, and the backslash escapes nothing."""
    folded = pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return F.translate(text, _UPPER, _LOWER).like(folded)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot begins no extension."""
    found = F.regexp_extract(name, r"(?s)^(.+)(\.[^.]+)$", 1)
    return F.when(found == "", name).otherwise(found)


def suffix(name: Column) -> Column:
    """The last extension with its dot, or the empty string."""
    return F.regexp_extract(name, r"(?s)^(.+)(\.[^.]+)$", 2)


def human_size(size: Column) -> Column:
    """A number of bytes in B, KB or MB, with a decimal comma."""
    mega = F.replace(F.format_string("%.1f", F.round(size / (1 << 20), 1)), F.lit("."), F.lit(","))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(F.floor(size / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(mega, F.lit(" MB")))
