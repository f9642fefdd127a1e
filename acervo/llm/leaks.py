"""Problem 8: evaluation passages inside the corpus, by a prefix-filtered set join.

A leak is ``WINDOW`` consecutive words of an item in a document.  Its set is the ``WINDOW - K + 1`` sequences of ``K``
words of that window, all of which the document has to hold.  So one of them is enough to find it: of each window the
sequence that the fewest documents hold (counts are over the whole corpus).  Documents that hold such a prefix token are
candidates if the window fits between their ends at that position; a candidate is verified by the unbroken run of the
item's sequences around it, on the diagonal that the token fixes.

The corpus is read once: each document gives the positions of the sequences that any item has.  The items' sequences are
broadcast only up to ``BROADCAST`` of them (their number is checked); beyond that the sequences are joined.  Runs are
found with SQL windows over one document, item and diagonal, so no task gathers a token's documents.

Defined cases: null, empty and blank texts and items, and those under ``WINDOW`` words, have no leak; items and documents
may repeat (one row for each pair of ids); case, accents, punctuation and line breaks don't matter; other columns are
ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.plans.workspace import Workspace

from .neardup import kmers, words_of

WINDOW, K = 12, 5
BROADCAST = 2_000_000


class Hashes(dict):
    """Word to a 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return n


def sequences(df: DataFrame, key: str, text: str, only: object = None) -> DataFrame:
    """``id``, ``pos``, ``seq`` and ``n`` (sequences in the text); of all sequences, or of a broadcast sorted array's."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Hashes()
        for part in batches:
            at, pos, seq, size = [], [], [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                own = kmers(np.array([number[w] for w in words_of(t)], np.int64), K).astype(np.int64)
                if len(own) < WINDOW - K + 1:
                    continue
                keep = np.arange(len(own))
                if only is not None:
                    known = only.value
                    near = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                    keep = np.flatnonzero(known[near] == own) if len(known) else keep[:0]
                at.append(np.full(len(keep), i))
                pos.append(keep)
                seq.append(own[keep])
                size.append(np.full(len(keep), len(own)))
            flat = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (at, pos, seq, size)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(flat[0])), pa.array(flat[1].astype(np.int32)), pa.array(flat[2]), pa.array(flat[3].astype(np.int32))], names=["id", "pos", "seq", "n"])

    rows = df.select(key, text).where(F.length(F.trim(F.col(text))) > 0)
    return rows.mapInArrow(run, f"id {kind}, pos int, seq long, n int")


def leaks(
    spark: SparkSession, corpus: DataFrame, items: DataFrame,
    key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "enunciado",
) -> DataFrame:
    """``key``, ``item`` of every document with a passage of an item; each pair once."""
    work = Workspace(spark, "leaks")
    held = WINDOW - K + 1
    own = work.save(sequences(items, item, passage).select(F.col("id").alias("item"), F.col("pos").alias("q"), "seq").distinct(), "items")
    known = own.select("seq").distinct()
    if known.count() <= BROADCAST:
        only = np.sort(np.array([r.seq for r in known.toLocalIterator()], np.int64))
        hits = sequences(corpus, key, text, spark.sparkContext.broadcast(only))
    else:
        hits = sequences(corpus, key, text).join(known, "seq", "left_semi")
    hits = work.save(hits, "hits")
    rarity = hits.groupBy("seq").agg(F.countDistinct("id").alias("df"))
    # windows whose rarest sequence no document holds can't leak: an inner join drops sequences, so all must be there
    ahead = W.partitionBy("item").orderBy("q").rowsBetween(0, held - 1)
    rare = own.join(rarity, "seq", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = rare.select("item", "q", F.min(F.struct("df", "seq", F.col("q").alias("em"))).over(ahead).alias("m"), F.count("*").over(ahead).alias("c"))
    prefix = rare.where((F.col("c") == held) & (F.col("m.df") > 0)).select("item", F.col("q").alias("q0"), F.col("m.seq").alias("seq"), F.col("m.em").alias("q"))
    met = hits.join(prefix, "seq").withColumn("desvio", F.col("pos") - F.col("q"))
    met = met.where((F.col("q0") + F.col("desvio") >= 0) & (F.col("q0") + F.col("desvio") + held <= F.col("n")))
    lanes = work.save(met.select("id", "item", "desvio").distinct(), "lanes")
    runs = lanes.join(hits.select("id", "pos", F.col("seq").alias("lido")), "id").withColumn("q", F.col("pos") - F.col("desvio"))
    runs = runs.join(own, ["item", "q"]).where("seq = lido").select("id", "item", "desvio", "q").distinct()
    lane = W.partitionBy("id", "item", "desvio").orderBy("q")
    runs = runs.withColumn("trecho", F.col("q") - F.row_number().over(lane))
    whole = runs.groupBy("id", "item", "desvio", "trecho").agg(F.count("*").alias("c")).where(F.col("c") >= held)
    return work.finish(whole.select(F.col("id").alias(key), F.col("item").alias(item)).distinct(), "leaks")
