"""Classification by weighted terms: each term counts once, the highest score wins, a tie is nobody's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.text import EDGE_AFTER, EDGE_BEFORE, has_word
from acervo.plans.rules import DEFAULT, RULES


def scores(text: Column) -> Column:
    """Array of (pontos, categoria) of the categories with any point, for a normalised text."""
    each = []
    for category, terms in RULES:
        points = reduce(lambda a, b: a + b, [F.when(has_word(text, t), F.lit(w)).otherwise(F.lit(0)) for t, w in terms])
        each.append(F.struct(points.alias("pontos"), F.lit(category).alias("categoria")))
    return F.filter(F.array(*each), lambda s: s["pontos"] > 0)


def winner(board: Column) -> Column:
    """The one category with the most points, or the default."""
    best = F.array_max(F.transform(board, lambda s: s["pontos"]))
    top = F.filter(board, lambda s: s["pontos"] == best)
    return F.when(F.size(top) == 1, F.get(top, F.lit(0))["categoria"]).otherwise(F.lit(DEFAULT))


def with_category(df: DataFrame, text: str, name: str = "categoria") -> DataFrame:
    """``df`` with the category of a normalised text; the scores are a column of their own, so they are computed once."""
    return df.withColumn("_pontos", scores(F.col(text))).withColumn(name, winner(F.col("_pontos"))).drop("_pontos")


def matched_terms(text: Column, category: Column) -> Column:
    """The terms of a row's category that a normalised text holds, joined in the order of the rules."""
    out = F.lit("")
    for name, terms in RULES:
        own = F.array_compact(F.array(*[F.when(has_word(text, t), F.lit(t)) for t, _ in terms]))
        out = F.when(category == name, F.array_join(own, ", ")).otherwise(out)
    return out


def rule_rows() -> Column:
    """The rule base as an array of (categoria, ordem, termo, peso)."""
    rows = [(c, i + 1, t, w) for i, (c, terms) in enumerate(RULES) for t, w in terms]
    return F.array(*[F.struct(F.lit(c).alias("categoria"), F.lit(o).alias("ordem"), F.lit(t).alias("termo"), F.lit(w).alias("peso")) for c, o, t, w in rows])


def score_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``categoria``, ``pontos`` by a theta join of texts with the rule rows, which are part of the plan."""
    rules = df.select(key, text, F.explode(rule_rows()).alias("r")).select(key, text, "r.*")
    hit = rules.where(F.rlike(text, F.concat(F.lit(EDGE_BEFORE), "termo", F.lit(EDGE_AFTER))))
    return hit.groupBy(key, "categoria").agg(F.sum("peso").cast("long").alias("pontos"))
