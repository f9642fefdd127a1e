"""Where files are archived: folder by category and year, free names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import stem, suffix
from acervo.operators.ranking import ordinals
from acervo.plans.workspace import Workspace


def year(date: Column) -> Column:
    """The year of an ISO date, or ``sem-data``."""
    return F.coalesce(F.split(date, "-")[0], F.lit("sem-data"))


def folder(root: str, category: Column, date: Column) -> Column:
    return F.concat_ws("/", F.lit(root), category, year(date))


def backup_folder(root: str, category: Column) -> Column:
    return F.concat_ws("/", F.lit(root), category)


def numbered(name: Column, n: Column) -> Column:
    """The ``n``-th name that is tried: the name itself, then ``stem (2).ext`` and so on."""
    return F.when(n == 1, name).otherwise(F.concat(stem(name), F.lit(" ("), n.cast("string"), F.lit(")"), suffix(name)))


def free_names(files: DataFrame, taken: DataFrame, order: list[str], work: Workspace, place: str = "pasta", name: str = "arquivo") -> DataFrame:
    """``files`` with ``nome``: the first name free in ``place``, files taken in ``order``.

    ``taken`` has ``place`` and ``nome``.  Of the numbers 1, 2, ... that stand for a name and its variants, the ``k``-th
    file gets the ``k``-th that is not taken: ``k`` plus the taken numbers with fewer than ``k`` free ones before them.
    Sorted by that test, the files and the taken numbers of a name are one sequence, and a file's place in it is its number:
    both steps are ordinals, so a name that many files share is spread over tasks.
    """
    ours = ordinals(files, [place, name], order, "_k", work)
    variant = r"(?s)^(.*) \((\d{1,9})\)(\.[^.]+)?$"
    used = taken.select(place, F.col("nome"))
    plain = used.select(place, F.col("nome").alias(name), F.lit(1).cast("long").alias("_e"))
    other = used.where(F.col("nome").rlike(variant)).select(
        place,
        F.concat(F.regexp_extract("nome", variant, 1), F.regexp_extract("nome", variant, 3)).alias(name),
        F.regexp_extract("nome", variant, 2).cast("long").alias("_e"),
    )
    held = plain.union(other.where("_e > 1")).distinct().join(files.select(place, name).distinct(), [place, name], "left_semi")
    ranked = ordinals(held, [place, name], ["_e"], "_i", work)
    columns = ours.drop("_k").columns
    rows = ours.select(F.struct(*columns).alias("_linha"), place, name, F.col("_k").alias("_v"), F.lit(0).alias("_tipo"), F.lit(0).cast("long").alias("_e"))
    gaps = ranked.select(F.lit(None).alias("_linha"), place, name, (F.col("_e") - F.col("_i")).alias("_v"), F.lit(1).alias("_tipo"), "_e")
    out = ordinals(rows.union(gaps), [place, name], ["_v", "_tipo", "_e"], "_numero", work).where("_tipo = 0")
    return out.select("_linha.*", numbered(F.col(name), F.col("_numero")).alias("nome"))
