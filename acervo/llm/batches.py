"""Problem 4: new batches against all history, by hashes in bucketed tables.

The index holds, for every accepted row, the hash of its file, the hash of its normalised text, the hashes of its
paragraphs and, for texts edited in every paragraph, some ordered sketches (``SKETCHES``); beside these its words as numbers,
never the texts.  Its tables are bucketed by what they are joined on, so the rows to check are shuffled to the
buckets and the history is not: a semi-join finds full copies, and shared paragraphs, weighed by their words, give the
coverage that makes a pair a candidate.  A candidate is checked exactly by the similarity of its sets of three-word
sequences.  What has been accepted is appended as its hashes.

All batches that wait are probed at once: the history's keys are read once for a call of ``check``, however many batches
it takes, in a fixed number of Spark jobs; the arrival order is decided afterwards among the rows that are like each other.

Of a row's paragraphs those are looked up that the fewest history rows hold, all but ``REST`` of its words, so set phrases
are looked up only where they are the text.  A history row is a candidate if what it shares of these, and all of the rest,
may reach ``COVERAGE`` of the words, or if it shares a sketch.  Of a key that more than ``HOT`` rows hold about ``HOT`` are
tried first, and the others only for rows that are like none of these.  So, too, in the batches: the first row of each hot
key is compared with all that share a key with it and decided before any other pair of hot keys is made.

Defined cases: rows with an error are neither cases nor accepted; null hashes equal nothing; null, empty and blank texts,
and those under three words, are compared by hash only; the first row of equal ones in arrival order is the one that may
be accepted; an empty batch changes nothing; ids are unique; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.plans.workspace import Workspace

from .neardup import buckets, common_kmers, consistent, folded, verify, words_in

COVERAGE, REST, LEAST_WORDS = 0.4, 0.25, 5
#: Sketches of a text, of problem 6's first and second kind.
SKETCHES = 7, 4
#: Rows of ids or keys that are broadcast at most; more are joined.
BROADCAST = 300_000
#: Rows of a key that are tried at first; more make it hot.
HOT = 64
#: Kinds of keys.
FILE, TEXT, PARAGRAPH, SKETCH = range(4)

#: Marks before a blank or the end, or an empty line. All begin in one class, so the search passes quickly over the rest.
_PARAGRAPH = re.compile(r"[.;:!?…\n](?:(?<!\n)[.;:!?…]*(?:\s|$)|(?<=\n)\s*\n)")
#: Where a field that ends in a number is followed by a sentence without a mark between them.
_FIELD = re.compile(r"\s(?<=\d\s)\s*(?=[A-ZÀ-Ý])")
_NEXT, _PART = chr(0x1D), chr(0x1E)
#: Bytes of a word's number.
_WIDE = 4


class Stretches(dict):
    """A stretch of consistent text without blanks to the numbers of its words, as bytes, remembered if it is short."""

    def __missing__(self, stretch: str) -> bytes:
        numbers = [xxhash.xxh32_intdigest(w) ^ (1 << 31) for w in words_in(folded(stretch))]  # as of neardup.Numbers
        raw = b"".join([n.to_bytes(_WIDE, sys.byteorder) for n in numbers])
        if len(stretch) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[stretch] = raw
        return raw


def paragraphs(text: str, known: Stretches) -> tuple[bytes, list[int], list[int]]:
    """Numbers of all words; hashes and sizes of the sentences and of their parts, of ``LEAST_WORDS`` words or more.

    Where these hold less than half of the words, as in forms, the shorter ones count too, and the whole text.
    """
    text = _FIELD.sub(_PART, _PARAGRAPH.sub(_NEXT, consistent(text)))
    numbers, digest = known.__getitem__, xxhash.xxh3_64_intdigest
    sentences, covered = [], 0
    units: dict[int, int] = {}
    short: dict[int, int] = {}
    for sentence in text.split(_NEXT):
        if _PART in sentence:
            parts = [b"".join(map(numbers, part.split())) for part in sentence.split(_PART)]
            parts.insert(0, whole := b"".join(parts))
        else:
            parts = [whole := b"".join(map(numbers, sentence.split()))]
        sentences.append(whole)
        if len(whole) >= _WIDE * LEAST_WORDS:
            covered += len(whole)
        for raw in parts:
            if raw:
                (units if len(raw) >= _WIDE * LEAST_WORDS else short)[digest(raw) - (1 << 63)] = len(raw) // _WIDE
    own = b"".join(sentences)
    if 2 * covered < len(own):
        units |= short | {digest(own) - (1 << 63): len(own) // _WIDE}
    return own, list(units), list(units.values())


def features(df: DataFrame, key: str, digest: str, text: str, batch: str | None = None) -> DataFrame:
    """``id``, ``hash`` (lower case), ``marca``, ``palavras``, ``paragrafos``, ``tamanhos`` and the batch of every row."""
    lot = F.lit(0) if batch is None else F.col(batch).cast("int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stretches()
        for part in batches:
            raw, units, sizes, ends = [], [], [], [0]  # units lie one after the other up to ends
            for text in part.column(2).to_pylist():
                own, u, n = paragraphs(text, known) if text and not text.isspace() else (b"", [], [])
                if len(own) > 2 * _WIDE:
                    raw.append(own)
                    units += u
                    sizes += n
                else:
                    raw.append(None)
                ends.append(len(units))
            marks = [xxhash.xxh3_128_hexdigest(x) if x else None for x in raw]
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(marks, pa.string()), pa.array(raw, pa.binary()),
                pa.ListArray.from_arrays(ends, pa.array(units, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(sizes, pa.int32())),
                part.column(3),
            ], names=["id", "hash", "marca", "palavras", "paragrafos", "tamanhos", "lote"])

    rows = df.select(F.col(key).cast("long").alias("id"), F.lower(F.col(digest)).alias("hash"), F.col(text).alias("texto"), lot.alias("lote"))
    return rows.mapInArrow(run, "id long, hash string, marca string, palavras binary, paragrafos array<long>, tamanhos array<int>, lote int")


def few(rows: DataFrame) -> DataFrame:
    """Rows of a number or two, saved, to be broadcast if they are ``BROADCAST`` or less."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def first_texts(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The rows with a text, without those whose text an earlier one has; the ids of the copies are broadcast if they are few."""
    marked = rows.where("marca IS NOT NULL")
    order = F.struct("lote", "id")
    again = marked.groupBy("marca").agg(F.min(order).alias("primeira"), F.count("*").alias("n")).where("n > 1").select("marca", "primeira")
    copies = work.save(marked.select("id", "lote", "marca").join(again, "marca").where(order > F.col("primeira")).select("id"), name)
    return marked.join(few(copies), "id", "left_anti")


class History:
    """The bucketed index of what has been accepted.

    ``common`` are the k-mers that sketches pass over; they are fixed when the index is begun, else sketches made at
    different times could not be compared.
    """

    def __init__(self, spark: SparkSession, work: Workspace, common: np.ndarray, buckets: int | None = None):
        self.spark, self.work, self.name, self.common = spark, work, f"acervo_{uuid.uuid4().hex}", common
        self.buckets, self.parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 0

    def _add(self, df: DataFrame, part: str, by: str) -> None:
        out = df.repartition(self.buckets, by).write.mode("append").format("parquet").bucketBy(self.buckets, by)
        out.option("path", f"{self.work.path}/{part}").saveAsTable(f"{self.name}_{part}")

    def append(self, rows: DataFrame, texts: DataFrame, own: DataFrame) -> None:
        """Take up rows with features: the hashes of their files, and the words and ``own`` units of ``texts``, the first of each text."""
        none = F.lit(None).cast("string")
        files = rows.where("hash IS NOT NULL").select(F.xxhash64("hash").alias("chave"), "id", F.lit(FILE).cast("byte").alias("tipo"), F.col("hash").alias("valor"))
        marks = texts.select(F.xxhash64("marca").alias("chave"), "id", F.lit(TEXT).cast("byte").alias("tipo"), F.col("marca").alias("valor"))
        self._add(files.union(marks).union(own.select("chave", "id", "tipo", none.alias("valor"))), "keys", "chave")
        self._add(texts.select("id", "palavras"), "words", "id")

    def held(self, wanted: DataFrame) -> DataFrame:
        """The keys of the history among ``wanted``: a semi-join in the buckets, hashed on the side of what is wanted."""
        few = wanted.select("chave").distinct().repartition(self.buckets, "chave")
        return self.spark.table(f"{self.name}_keys").join(few.hint("shuffle_hash"), "chave", "left_semi")

    def words(self, ids: DataFrame) -> DataFrame:
        """The words of some history rows, in the buckets of their ids."""
        few = ids.select("id").distinct().repartition(self.buckets, "id")
        return self.spark.table(f"{self.name}_words").join(few.hint("shuffle_hash"), "id", "left_semi").select("id", "palavras")

    def drop(self) -> None:
        for part in ("keys", "words"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")


def units(history: History, texts: DataFrame) -> DataFrame:
    """``id``, ``chave``, ``w`` (words), ``todas`` (of all), ``tipo``: the paragraphs and the sketches of texts."""
    whole = F.aggregate("tamanhos", F.lit(0), lambda x, y: x + y)
    each = texts.select("id", whole.alias("todas"), F.explode(F.arrays_zip("paragrafos", "tamanhos")).alias("x"))
    each = each.select("id", F.col("x.paragrafos").alias("chave"), F.col("x.tamanhos").alias("w"), "todas", F.lit(PARAGRAPH).cast("byte").alias("tipo"))
    sketch = buckets(history.spark, texts.select("id", "palavras"), history.common, *SKETCHES)
    return each.union(sketch.select("id", F.col("balde").alias("chave"), F.lit(0).alias("w"), F.lit(0).alias("todas"), F.lit(SKETCH).cast("byte").alias("tipo")))


def lookups(own: DataFrame) -> DataFrame:
    """``b``, ``chave``, ``w``, ``todas``, ``resto``, ``tipo``, ``df``: what is looked up of the texts of ``own``.

    ``own`` has the units that others hold, ``df`` of them.  All sketches are looked up, and the paragraphs but the most
    frequent, up to ``REST`` of the text's words, which are ``resto``.
    """
    order = W.partitionBy("id").orderBy(F.desc("df"), F.desc("chave"))
    late = (F.col("tipo") == PARAGRAPH) & (F.col("ate") < REST * F.col("todas"))
    seen = own.withColumn("ate", F.sum("w").over(order))
    seen = seen.withColumn("resto", F.sum(F.when(late, F.col("w")).otherwise(0)).over(W.partitionBy("id")))
    return seen.where(~late).select(F.col("id").alias("b"), "chave", "w", "todas", "resto", "tipo", "df")


def candidates(rare: DataFrame, held: DataFrame) -> DataFrame:
    """``a``, ``b``, ``w``: texts that share a sketch, or paragraphs that may reach ``COVERAGE`` of the words of ``b``."""
    shared = rare.join(held.select("chave", F.col("id").alias("a")), "chave").where("a <> b")
    shared = shared.groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("todas").alias("todas"), F.max("resto").alias("resto"), F.max("tipo").alias("tipo"))
    return shared.where((F.col("tipo") == SKETCH) | (F.col("w") + F.col("resto") >= COVERAGE * F.col("todas"))).select("a", "b", "w")


def like_history(history: History, words: DataFrame, ids: DataFrame, own: DataFrame, held: DataFrame, limit: float) -> DataFrame:
    """``b``: those of ``ids`` that are like a text of the history; ``words`` has the words of all texts of the batch."""
    work = history.work
    sizes = held.groupBy("chave").agg(F.count("*").alias("df"))
    rare = work.save(lookups(own.join(few(ids), "id", "left_semi").join(sizes, "chave")), "lookups")
    # of a hot key the rows whose own number falls under HOT in df come first: the same rows for all their keys
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    hot = work.save(rare.where(F.col("df") > HOT).select("chave", "df").distinct(), "hot")
    cold = hot.isEmpty()
    first = held if cold else held.join(hot, "chave", "left").where(F.col("df").isNull() | (share < HOT / F.col("df")))
    pairs = work.save(candidates(rare, first), "pairs")

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        ids = work.save(pairs.select(F.col("b").alias("id")).distinct(), f"{name}-ids")
        both = history.words(pairs.select(F.col("a").alias("id"))).union(words.join(few(ids), "id", "left_semi"))
        return work.save(verify(pairs.select("a", "b"), both, limit, False).where("ok").select("b").distinct(), name)

    tried = work.save(pairs.groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a")).select("a", "b"), "tried")
    done = alike(tried, "like")
    left = rare.join(done, "b", "left_anti")
    more = pairs.select("a", "b") if cold else candidates(left, held).select("a", "b")
    more = work.save(more.join(done, "b", "left_anti").join(tried, ["a", "b"], "left_anti"), "more")
    return done.union(alike(more, "like2"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs of ids with the lesser first, each once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def resolve(rows: DataFrame, edges: DataFrame, work: Workspace, name: str, only: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """The accepted of ``rows`` (``ordem``, ``id``, ``hash``, ``classe``), and those that are left undecided.

    ``edges`` has ``x``, ``y``: classes that are alike, both ways.  In a round those rows are accepted that come before all
    rows of their hash, of their class and of the classes like it; all that these rule out leave.  ``only`` holds the
    classes that may be accepted; without it nothing is left.
    """
    accepted, step = None, 0
    while True:
        least = rows.where("classe IS NOT NULL").groupBy("classe").agg(F.min("ordem").alias("m"))
        owner = rows.where("hash IS NOT NULL").groupBy("hash").agg(F.min("ordem").alias("h"))
        near = edges.join(least.select(F.col("classe").alias("y"), "m"), "y").groupBy("x").agg(F.min("m").alias("p"))
        free = rows.join(least, "classe", "left").join(owner, "hash", "left").join(near.withColumnRenamed("x", "classe"), "classe", "left")
        free = free.where("(m IS NULL OR ordem = m) AND (h IS NULL OR ordem = h) AND (p IS NULL OR ordem < p)")
        if only is not None:
            free = free.join(only, "classe", "left_semi")
        new = work.save(free.select("ordem", "id", "hash", "classe"), f"{name}{step}-new")
        if new.isEmpty():
            return accepted, rows
        accepted = new if accepted is None else accepted.union(new)
        out = new.select("classe").union(edges.join(new.select(F.col("classe").alias("x")), "x", "left_semi").select("y"))
        rows = rows.join(new.select("id"), "id", "left_anti").join(new.where("hash IS NOT NULL").select("hash").distinct(), "hash", "left_anti")
        rows = work.save(rows.join(out.where("classe IS NOT NULL").distinct(), "classe", "left_anti").select("ordem", "id", "hash", "classe"), f"{name}{step}-left")
        step += 1


def among(history: History, rows: DataFrame, texts: DataFrame, own: DataFrame, words: DataFrame, limit: float) -> DataFrame:
    """The accepted of ``rows``, none of which the history has; ``texts`` (``id``, ``ordem``, ``classe``) are the first of their classes."""
    work = history.work

    def shared(own: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The units that several texts have; and those that are looked up."""
        sizes = work.save(own.groupBy("chave").agg(F.count("*").alias("df")).where("df > 1"), f"{name}-sizes")
        own = work.save(own.join(few(sizes), "chave"), f"{name}-units")
        return own, work.save(lookups(own), f"{name}-lookups")

    def edges(pairs: DataFrame, name: str) -> DataFrame:
        pairs = work.save(ordered(pairs), f"{name}-pairs")
        ids = work.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
        ok = verify(pairs, words.join(few(ids), "id", "left_semi"), limit, False).where("ok").select("a", "b")
        ok = ok.join(texts.select(F.col("id").alias("a"), F.col("classe").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("classe").alias("y")), "b")
        return work.save(ok.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.*"), name)

    accepted = None
    held, rare = shared(own.join(few(texts.select("id")), "id", "left_semi"), "first")
    hot = rare.where(F.col("df") > HOT)
    if not hot.isEmpty():
        pivots = held.join(hot.select("chave").distinct(), "chave", "left_semi").join(texts.select("id", "ordem"), "id").groupBy("chave").agg(F.min_by("id", "ordem").alias("id"))
        pivots = work.save(pivots.select("id").distinct(), "pivots")
        star = candidates(rare.join(pivots.select(F.col("id").alias("b")), "b", "left_semi"), held)
        star = star.union(candidates(rare, held.join(pivots, "id", "left_semi")))
        accepted, rows = resolve(rows, edges(star.select("a", "b"), "star"), work, "star", pivots.join(texts, "id").select("classe"))
        live = work.save(texts.join(rows.select("classe").distinct(), "classe", "left_semi").select("id"), "live")
        held, rare = shared(held.drop("df").join(few(live), "id", "left_semi"), "live")
    rest, _ = resolve(rows, edges(candidates(rare, held).select("a", "b"), "edges"), work, "rest")
    out = [x for x in (accepted, rest) if x is not None]
    return rows.where("false") if not out else out[0] if len(out) == 1 else out[0].union(out[1])


def check(history: History, batch: DataFrame, limit: float = 0.5) -> DataFrame:
    """``id``, ``tipo`` of the cases of one or more batches; takes their other rows into the history.

    ``batch`` has the features of rows without error, saved; arrival order is (``lote``, ``id``).
    """
    work = history.work
    order = F.col("lote").cast("decimal(10,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("id")
    rows = batch.select(order.cast("decimal(38,0)").alias("ordem"), "id", "hash", F.col("marca").alias("classe"))
    # one row stands for all of the same text
    firsts = first_texts(batch, work, "batch-copies")
    own = work.save(units(history, firsts), "units")
    wanted = own.select("chave").union(rows.where("hash IS NOT NULL").select(F.xxhash64("hash"))).union(rows.where("classe IS NOT NULL").select(F.xxhash64("classe")))
    held = work.save(history.held(wanted), "held")
    exact = held.where(F.col("tipo") == FILE).select(F.col("valor").alias("hash")).distinct()
    same = held.where(F.col("tipo") == TEXT).select(F.col("valor").alias("classe")).distinct()
    fresh = work.save(rows.join(exact, "hash", "left_anti"), "fresh")
    texts = firsts.select("id", order.cast("decimal(38,0)").alias("ordem"), F.col("marca").alias("classe"))
    texts = work.save(texts.join(same, "classe", "left_anti").join(fresh.select("classe").distinct(), "classe", "left_semi"), "open")
    words = batch.select("id", "palavras")
    like = like_history(history, words, texts.select("id"), own, held.where(F.col("tipo") >= PARAGRAPH).select("chave", "id"), limit)
    like = work.save(texts.join(like.select(F.col("b").alias("id")), "id", "left_semi").select("classe"), "like-history")
    left = work.save(fresh.join(same.union(like), "classe", "left_anti").select("ordem", "id", "hash", "classe"), "undecided")
    texts = work.save(texts.join(like, "classe", "left_anti"), "left")
    accepted = work.save(among(history, left, texts, own, words, limit), "accepted")

    owner = accepted.where("hash IS NOT NULL").groupBy("hash").agg(F.min("ordem").alias("dono"))
    out = rows.join(exact.withColumn("exata", F.lit(True)), "hash", "left").join(owner, "hash", "left").join(accepted.select("id", F.lit(True).alias("aceita")), "id", "left")
    kind = F.when(F.col("exata") | (F.col("dono") < F.col("ordem")), "exata").when(F.col("aceita"), F.lit(None)).otherwise("quase")
    out = work.save(out.select("id", kind.alias("tipo")).where("tipo IS NOT NULL"), f"cases-{history.parts}")
    accepted = few(accepted.select("id"))
    taken = batch.join(accepted, "id", "left_semi")
    texts = taken.where("marca IS NOT NULL")
    # an accepted row is not always the first of its text: the units are found by the first, and belong to the accepted
    owner = texts.select("marca", F.col("id").alias("_a")).join(firsts.select("id", "marca"), "marca").select("id", "_a")
    history.append(taken, texts, own.join(few(work.save(owner, "owners")), "id").withColumn("id", F.col("_a")).drop("_a"))
    history.parts += 1
    return out


def begin(spark: SparkSession, work: Workspace, rows: DataFrame) -> History:
    """An index of rows with features, saved, that are all accepted."""
    texts = first_texts(rows, work, "copies")
    history = History(spark, work, common_kmers(texts.select("palavras")))
    history.append(rows, texts, units(history, texts))
    return history


def found(spark: SparkSession, documents: DataFrame, inbox: DataFrame, batches: DataFrame) -> DataFrame:
    """``entrada_id``, ``tipo`` of the cases of every batch of ``batches``."""
    work = Workspace(spark, "batches")
    past = work.save(features(documents.withColumn("chave", F.col("id") * 2), "chave", "hash", "texto"), "past")
    history = begin(spark, work, past)
    work.discard("past")
    try:
        own = inbox.where("erro IS NULL").join(batches.select("lote").distinct(), "lote", "left_semi").withColumn("chave", F.col("entrada_id") * 2 + 1)
        cases = check(history, work.save(features(own, "chave", "hash", "texto", "lote"), "inbox"))
        return work.finish(cases.select(((F.col("id") - 1) / 2).cast("long").alias("entrada_id"), "tipo"))
    finally:
        history.drop()
