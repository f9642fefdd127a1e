"""The document index: what is known already, first copies, insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.operators.ranking import ordinals
from acervo.plans.workspace import Workspace


def already_indexed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose hash the index has."""
    return files.join(index.select("hash").where("hash IS NOT NULL"), "hash", "left_semi")


def not_indexed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose hash the index doesn't have; files without a hash are among them."""
    return files.join(index.select("hash").where("hash IS NOT NULL"), "hash", "left_anti")


def first_copies(files: DataFrame, order: list[str], key: str = "hash") -> DataFrame:
    """The first file of each hash by ``order``; files without a hash all stay.

    The first of each hash that comes again is found by a partial aggregation of hash and order, so a hash that many files
    share costs no sort, and no other column is read for it; the join with these few leaves the other files where they are.
    """
    columns = files.columns
    again = files.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*order)).alias("_f"), F.count("*").alias("_n"))
    again = again.where("_n > 1").drop("_n")
    out = files.join(again, F.col(key) == F.col("_k"), "left")
    return out.where(F.col("_f").isNull() | (F.struct(*order) == F.col("_f"))).select(*columns)


def insert_ignore(index: DataFrame, new: DataFrame, order: list[str], work: Workspace) -> DataFrame:
    """Rows of ``new`` with ids, without those whose ``caminho`` or ``hash`` the index or an earlier new row has.

    Rows are taken in ``order``; of two that share a path or a hash the first goes in.
    """
    fresh = not_indexed(new, index).join(index.select("caminho"), "caminho", "left_anti")
    fresh = first_copies(first_copies(fresh, order), order, "caminho")
    last = index.agg(F.max("id")).first()[0] or 0
    return ordinals(fresh, [], order, "_n", work).withColumn("id", F.col("_n") + last).drop("_n")
