"""From inbox rows to index rows: gates, classification, dates, archive paths, and a status for every file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.dates import document_date, modified_date
from acervo.functions.scoring import with_category
from acervo.functions.text import normalized, suffix
from acervo.operators.archive import folder, free_names
from acervo.plans.rules import INDEXED, NOT_WATCHED, WATCHED
from acervo.plans.workspace import Workspace


def gated(files: DataFrame, index: DataFrame, order: list[str], watched: tuple[str, ...] = WATCHED) -> DataFrame:
    """``files`` with ``ignorado``: why a file is left out, null for those that go on.

    The gates stand in the order of their cost: extension, known hash, failed reading, earlier file of the same hash.  A
    file that can't be read doesn't hide a later one of the same hash.
    """
    known = index.select(F.col("hash").alias("_h")).where("_h IS NOT NULL").distinct()
    out = files.join(known, files["hash"] == known["_h"], "left")
    gate = F.when(~F.lower(suffix(F.col("arquivo"))).isin(*watched), NOT_WATCHED).when(F.col("_h").isNotNull(), INDEXED).when(F.col("erro").isNotNull(), F.col("erro"))
    out = out.withColumn("ignorado", gate).drop("_h")
    going = out.where("ignorado IS NULL AND hash IS NOT NULL").groupBy("hash").agg(F.min(F.struct(*order)).alias("_primeiro"))
    out = out.join(going, "hash", "left")
    later = F.col("ignorado").isNull() & F.col("_primeiro").isNotNull() & (F.struct(*order) > F.col("_primeiro"))
    return out.withColumn("ignorado", F.when(later, INDEXED).otherwise(F.col("ignorado"))).drop("_primeiro")


def classified(files: DataFrame, moment: str = "modificationtime") -> DataFrame:
    """``files`` with ``categoria`` and ``data``; the text is normalised once."""
    out = files.withColumn("_normal", normalized(F.coalesce("texto", F.lit(""))))
    return with_category(out, "_normal").withColumn("data", document_date(F.col("_normal"), modified_date(F.col(moment)))).drop("_normal")


def archived(files: DataFrame, taken: DataFrame, root: str, order: list[str], work: Workspace) -> DataFrame:
    """``files`` with ``destino``: the folder of category and year, and a name free there."""
    placed = files.withColumn("pasta", folder(root, F.col("categoria"), F.col("data")))
    return free_names(placed, taken, order, work).withColumn("destino", F.concat_ws("/", "pasta", "nome")).drop("pasta", "nome")


def results(
    files: DataFrame, index: DataFrame, root: str, order: list[str], work: Workspace, moment: str = "modificationtime", watched: tuple[str, ...] = WATCHED,
) -> DataFrame:
    """A result for every file: ``order`` columns, ``arquivo``, ``categoria``, ``data``, ``destino``, ``ignorado``."""
    told = work.save(gated(files, index, order, watched), "gated")
    going = work.save(classified(told.where("ignorado IS NULL"), moment).select(*order, "arquivo", "categoria", "data", "ignorado"), "classified")
    taken = index.select(F.regexp_extract("caminho", r"(?s)^(.*)/[^/]*$", 1).alias("pasta"), F.element_at(F.split("caminho", "/"), -1).alias("nome"))
    done = archived(going, taken, root, order, work).select(*order, "arquivo", "categoria", "data", "destino", "ignorado")
    none = F.lit(None).cast("string")
    left = told.where("ignorado IS NOT NULL").select(*order, "arquivo", none.alias("categoria"), none.alias("data"), none.alias("destino"), "ignorado")
    return done.union(left)
