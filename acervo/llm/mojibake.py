"""Problem 2: text decoded with the wrong character encoding.

A regular expression in the JVM passes every field that holds any sign of wrong decoding (a superset of the cases).  For
those, every chain of up to ``LINKS`` wrong and right encodings is applied to each word that is not plain.  A candidate
decoding is described by its words in their context under the better of the languages' zstandard dictionaries, ``ESCAPE``
bytes for each character that the clean texts lack (a dictionary has no code for it), and the links of its chain.  The
chain with the shortest description is applied to the words that it does not make longer, then the next to the words that
are left, while the total gets shorter; otherwise the field stays unchanged.

A field that holds the replacement character is a case whatever its description: nothing can restore what it stands for.
A mark of a word broken at a line's end, and words between no-break spaces, are not read by another code page; a word that may
be written with imitated characters (problem 1) speaks for a page only if that is shorter than its usual form, too, and a word of
less than two letters never does; both are read by the page that the other words of their field speak for.

The dictionaries are the only fitted model: pairs of neighbouring words, digits alike, are counted over all clean values, and
each language's dictionary is trained from its ``PAIRS`` most frequent ones, several times what it has room for; the dictionaries
are broadcast (``DICTIONARY`` bytes each).  The characters that clean texts have are counted over all values by the same reading.

Defined cases: null, empty and blank fields are not reported; a field that no chain makes shorter is left unchanged; correct
capitals with accents, foreign words and signs have no shorter candidate; repeated rows give one row; other columns are
ignored; ties go to the shorter chain.  Only counts and the final distinct are shuffled, and texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.plans.workspace import Workspace

from .lookalike import ODD, mapped_form

PAIRS, DICTIONARY, LEVEL = 30_000, 64 * 1024, 19
LINKS = 3
#: Bytes that a link costs: one that yields UTF-8 is checked by its own form, one between two code pages is not.
COST_UTF8, COST_PAGE = 1, 1.5
#: Bytes that a character costs besides if fewer than one in ``KNOWN`` values, or than ``LEAST``, is clean and has it.
ESCAPE, KNOWN, LEAST = 2, 1_300, 3
#: Bytes more by itself that a reading may take to be tried in context.
SLACK = 1
#: Characters of context on either side of a word.
CONTEXT = 20
#: Pairs that a task holds before it hands on their counts.
HELD = 200_000

# Wrong decoder, right decoder.
CHAINS = (
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"),
    ("cp850", "cp1252"), ("cp1252", "cp850"),
)

# Frequent small words that tell the languages apart.
COMMON = {"pt": "de do da em no na para com um uma por ao sem sob", "es": "de del el la los las en y con una por al", "en": "the of and to in for with on by at from is"}

PLAIN, CAPITALS = "áàâãéêíóôõúüçñ", "ÁÀÂÃÉÊÍÓÔÕÚÜÇÑ"
#: What every garbled field holds: a character that plain text lacks, small letters right before accented capitals or the
#: reverse, what a byte of UTF-8 becomes after its lead, signs inside words.  The look ahead passes over plain text quickly.
SIGNS = (
    f"(?=[^\\x00-\\x7f])(?:[^\\x00-\\x7f{PLAIN}{CAPITALS}ªº³½§©«»“”…™¬]|(?<=[a-z])[{CAPITALS}§¬]|(?<=[A-Z])[{PLAIN}]"
    "|[ÃÂ][ªº§©«»½³“”…™¬]|(?<=[A-Za-z])[“”…«»³½©](?=[a-z])|(?<=[0-9])¬)"
)

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What no clean text has: only such values are kept from what the dictionaries learn.  The first class passes over ASCII quickly.
SPOILT = "[^\\x00-\\x7f](?:" + "|".join((
    f"(?<=[{chr(0xFFFD)}{chr(0x80)}-{chr(0x9F)}])",
    f"(?<=[ÂÃÎÏÐÑÅ])(?=[{chr(0x80)}-{chr(0xBF)}€‚ƒ„…†‡ˆ‰Š‹ŒŽ’•˜™š›œžŸ])|(?<=â)(?=[€„‚])",
    r"(?<=[─-▟√∫≠≥≤∂∑∏∆◊ıˆ˜¯˘˙˚¸˝˛ˇ⌐⌠⌡∙ⁿƒ†‡])|(?<=[¬Ô])(?=[Ç¢£§•¶ß®©™´¨])",
    f"(?<=[þ¾¶¢£¤¥‚„±¦¨¬§])(?=[{_LETTER}])|(?<=[{_LETTER}][þ¾¶¢£¤¥¡‚„±¦¨¬§·])|(?<=[a-zß-öø-ÿ][À-Þ])",
)) + ")"

#: Marks of a word broken at a line's end: no page turns them into a letter.
BREAKS = ("¬", chr(0xAD))

_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_ODD = re.compile(ODD)
_GAP = " \\t\\n\\r\\f\\v"
_WORD = re.compile(f"[^{_GAP}]+")
#: What makes a word not plain: anything beyond an accent in small letters that doesn't follow a capital.
_MARK = re.compile(f"[^\\x00-\\x7f{PLAIN}]|(?<=[A-Z])[{PLAIN}]")
_NEXT = re.compile(r"[ \t\n\r\f\v]+[^ \t\n\r\f\v]*")
_LAST = re.compile(r"[^ \t\n\r\f\v]*[ \t\n\r\f\v]+$")
_SPOILT = re.compile(SPOILT)
_BEYOND = re.compile(f"[^\\x00-~{PLAIN}{CAPITALS}]")
#: Words as the pairs have them: a longer one counts as several.
_PIECE = re.compile(b"[^ \t\n\r\f\v]{1,40}")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_SMALL = {k: frozenset(f.encode() for w in v.split() for f in (w, w.capitalize(), w.upper())) for k, v in COMMON.items()}


def _bytes_of(codec: str) -> dict[str, str]:
    """Character to byte (as a character of that number) above ASCII; bytes without a character stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = chr(b)
        except UnicodeDecodeError:
            out[chr(b)] = chr(b)
    return out


_TABLES = {c: _bytes_of(c) for c, _ in CHAINS}
_PAGES = {(w, r): {c: bytes([ord(b)]).decode(r, "replace") for c, b in _TABLES[w].items()} for w, r in CHAINS if r != "utf-8"}


def redecode(word: str, wrong: str, right: str) -> str:
    """``word`` with the stretches that fit read again by the right decoder; the rest as it was."""
    if right != "utf-8":
        table = _PAGES[wrong, right]
        out = "".join(table.get(c, c) for c in word)
        return word if chr(0xFFFD) in out else out
    table = _TABLES[wrong]
    raw = "".join(c if c < "\x80" else table.get(c, "\x00") for c in word)
    out, last = [], 0
    for m in _UTF8.finditer(raw):
        try:
            new = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [word[last : m.start()], new]
        last = m.end()
    return "".join(out) + word[last:] if out else word


class Restorer:
    """Chooses the chain of shortest description by zstandard dictionaries, one a language."""

    def __init__(self, pairs: dict[str, list[bytes]], known: set[str], size: int = DICTIONARY):
        """``pairs`` are each language's, by falling count."""
        self.known, self.raw = known, []
        for own in pairs.values():
            if sum(map(len, own)) > 4 * size and len(own) >= 32:
                self.raw.append(zstandard.train_dictionary(size, own, k=256, d=8).as_bytes())
        if not self.raw:  # too little text to train from: the pairs themselves are the dictionary, the frequent ones last
            self.raw = [b"\n".join(x for own in pairs.values() for x in reversed(own))[-size:] or b"\n" * 16]
        self.packers: list = []
        self.sizes: dict[str, int] = {}
        self.others: dict[str, dict[str, tuple]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"packers": [], "sizes": {}, "others": {}}

    def packed(self, text: str) -> int:
        """Bytes of ``text`` under the better of the dictionaries."""
        if not self.packers:
            for raw in self.raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        return min(len(p.compress(text.encode("utf-8", "replace"))) for p in self.packers)

    def length(self, text: str) -> int:
        """Bytes that describe ``text``."""
        if (n := self.sizes.get(text)) is None:
            if len(self.sizes) > 200_000:
                self.sizes.clear()
            n = self.sizes[text] = self.packed(text) + ESCAPE * sum(c > "~" and c not in self.known for c in text)
        return n

    def described(self, left: str, word: str, tail: str) -> float:
        """Bytes that describe a word in its context: the mean with both neighbours, either and none.

        A compressor counts whole bytes and may end a match anywhere, so one length alone is off by a byte or two.
        """
        return (self.length(left + word + tail) + self.length(left + word) + self.length(word + tail) + self.length(word)) / 4

    def decodings(self, word: str) -> dict[str, tuple]:
        """What chains of up to ``LINKS`` links make of a word, and the shortest such chain.

        Left out is what takes over ``SLACK`` bytes more than the word by itself: no context makes that up.
        """
        if (out := self.others.get(word)) is None:
            if len(self.others) > 50_000:
                self.others.clear()
            out, level = {}, {word: ()}
            chains = [c for c in CHAINS if c[1] == "utf-8"] if word.endswith(BREAKS) or word.count(chr(0xA0)) > 1 else CHAINS
            for _ in range(LINKS):
                following: dict[str, tuple] = {}
                for w, chain in level.items():
                    for link in chains:
                        new = redecode(w, *link)
                        if new != word and new not in out:
                            out[new] = following[new] = (*chain, link)
                level = following
            most = self.length(word) + SLACK
            out = self.others[word] = {new: chain for new, chain in out.items() if self.length(new) <= most}
        return out

    def restore(self, text: str) -> tuple[str, list[tuple]]:
        """The text of shortest description and the chains that lead to it."""
        spots, gains = [], {}
        for m in _WORD.finditer(text):
            if m[0].isascii() or not _MARK.search(m[0]):
                continue
            k = len(spots)
            before = _LAST.search(text, max(0, m.start() - CONTEXT), m.start())
            after = _NEXT.match(text, m.end(), m.end() + CONTEXT)
            left, tail = before[0] if before else "", after[0] if after else ""
            spots.append((m.start(), m.end()))
            others = self.decodings(m[0])
            if not others:
                continue
            now = usual = self.described(left, m[0], tail)
            if _ODD.search(m[0]):  # it may be problem 1's: a page has to be better than the usual characters, too
                usual = min(now, self.described(left, mapped_form(m[0]), tail))
            if sum(map(str.isalpha, m[0])) < 2:
                usual = 0  # a sign by itself doesn't speak for a page
            for new, chain in others.items():
                size = self.described(left, new, tail)
                if size <= now:
                    less = (now if all(right == "utf-8" for _, right in chain) else usual) - size
                    gains.setdefault(chain, {})[k] = less, new
        cost = {c: sum(COST_UTF8 if right == "utf-8" else COST_PAGE for _, right in c) for c in gains}
        swaps: dict[int, str] = {}
        used = []
        while gains:
            total = {c: sum(max(0, less) for k, (less, _) in own.items() if k not in swaps) - cost[c] for c, own in gains.items()}
            best = max(total, key=lambda c: (total[c], -len(c), c))
            if total[best] <= 0:
                break
            for k, (_, new) in gains.pop(best).items():
                swaps.setdefault(k, new)
            used.append(best)
        out, last = [], 0
        for k, (a, b) in enumerate(spots):
            if k in swaps:
                out += [text[last:a], swaps[k]]
                last = b
        return "".join(out) + text[last:], used


def language(words: list[bytes]) -> str:
    """The language that most of the small words tell."""
    return max(_SMALL, key=lambda k: (sum(map(_SMALL[k].__contains__, words)), k == "pt"))


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tipo``, ``item`` and ``n``: how many values there are, how many clean ones have a character, the pairs of words by language."""
    counts: dict[str, Counter] = {k: Counter() for k in ("valor", "sinal", *COMMON)}

    def part(tipo: str) -> pa.RecordBatch:
        own = counts[tipo]
        items = [b" ".join(x) if tipo in COMMON else x.encode() for x in own]
        out = pa.RecordBatch.from_arrays([pa.array([tipo] * len(own), pa.string()), pa.array(items, pa.binary()), pa.array(list(own.values()), pa.int64())], names=["tipo", "item", "n"])
        own.clear()
        return out

    for rows in batches:
        for column in rows.columns:
            for v in column.to_pylist():
                if v is None:
                    continue
                counts["valor"][""] += 1
                if not v.isascii():
                    if _SPOILT.search(v):
                        continue
                    counts["sinal"].update(set(_BEYOND.findall(v)))
                words = _PIECE.findall(v.encode().translate(_DIGITS))
                tipo = language(words)
                counts[tipo].update(zip(words, words[1:]) if len(words) > 1 else zip(words))
                if len(counts[tipo]) > HELD:
                    yield part(tipo)
    yield from map(part, counts)


def fit(df: DataFrame, columns: list[str]) -> Restorer:
    """Dictionaries from the ``PAIRS`` most frequent pairs of words a language, counted over all clean values.

    The known characters are those of plain text and what one in ``KNOWN`` values has, counted over all clean values.
    """
    each = df.select(*columns).mapInArrow(counted, "tipo string, item binary, n long")
    with Workspace(df.sparkSession, "mojibake") as work:
        sums = work.save(each.groupBy("tipo", "item").agg(F.sum("n").alias("n")), "sums")
        total = sums.where("tipo = 'valor'").first()
        least = max(LEAST, total.n / KNOWN) if total else LEAST
        known = {bytes(r.item).decode() for r in sums.where("tipo = 'sinal'").where(F.col("n") >= least).collect()}
        pairs = {k: [bytes(r.item) for r in sums.where(F.col("tipo") == k).orderBy(F.desc("n"), "item").limit(PAIRS).collect()] for k in COMMON}
    return Restorer(pairs, {*PLAIN, *CAPITALS, *known})


def restored(spark: SparkSession, df: DataFrame, key: str = "id", columns: tuple[str, ...] = ("texto", "arquivo")) -> DataFrame:
    """``id``, ``campo``, ``original``, ``cadeia`` and ``perdido`` of every garbled field.

    ``cadeia`` has the chains that were applied, null where none helps; ``perdido`` tells that replacement characters are left.
    """
    shared = spark.sparkContext.broadcast(fit(df, [*columns]))
    each = df.select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor")) for c in columns])).alias("x"))
    signs = each.select("id", "x.campo", "x.valor").where(F.col("valor").rlike(SIGNS))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep, texts, chains, lost = [], [], [], []
            for i, value in enumerate(rows.column(2).to_pylist()):
                text, links = shared.value.restore(value)
                gone = chr(0xFFFD) in text
                if links or gone:
                    keep.append(i)
                    texts.append(text)
                    chains.append(", ".join(" > ".join(f"{w}:{r}" for w, r in chain) for chain in links) or None)
                    lost.append(gone)
            out = rows.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.array(texts, pa.string()), pa.array(chains, pa.string()), pa.array(lost, pa.bool_())], names=["id", "campo", "original", "cadeia", "perdido"])

    return signs.mapInArrow(run, f"id {kind}, campo string, original string, cadeia string, perdido boolean")


def found(spark: SparkSession, df: DataFrame, key: str = "id", columns: tuple[str, ...] = ("texto", "arquivo")) -> DataFrame:
    """``id`` and ``campo`` of every garbled field."""
    return restored(spark, df, key, columns).select("id", "campo").distinct()
