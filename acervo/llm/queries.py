"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acervo.plans.tables import table

from . import areas, batches, bpe, leaks, lookalike, mojibake, neardup, personal, scans

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(spark, table(spark, sf_dir, "documentos"))


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent(spark, table(spark, sf_dir, "documentos"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(spark, table(spark, sf_dir, "documentos"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(spark, table(spark, sf_dir, "documentos"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found(spark, table(spark, sf_dir, "documentos"))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.masked(spark, table(spark, sf_dir, "documentos"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox = table(spark, sf_dir, "entrada")
    return batches.found(spark, table(spark, sf_dir, "documentos"), inbox, table(spark, sf_dir, "lotes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(spark, table(spark, sf_dir, "documentos"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(spark, table(spark, sf_dir, "documentos"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(spark, table(spark, sf_dir, "documentos"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(spark, table(spark, sf_dir, "documentos"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(spark, table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "itens_avaliacao"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, labels = table(spark, sf_dir, "areas"), table(spark, sf_dir, "rotulos_area")
    return areas.classify(spark, table(spark, sf_dir, "documents"), labels, names)


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_consistent": p1_consistent,
        "p2_found": p2_found,
        "p2_restored": p2_restored,
        "p3_found": p3_found,
        "p3_masked": p3_masked,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p5_repaired": p5_repaired,
        "p6_found": p6_found,
        "p6_groups": p6_groups,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p9_found": p9_found,
    }


_WINDOWS = """
    SELECT DISTINCT {key}, array_to_string(palavras[i:i + 11], ' ') AS janela FROM (
      SELECT {key}, palavras, unnest(range(1, len(palavras) - 10)) AS i FROM (
        SELECT {key}, regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+') AS palavras FROM {table} WHERE {text} IS NOT NULL))"""


def oracle_sql() -> dict[str, str]:
    """Queries of this package that plain SQL can state in full."""
    docs = _WINDOWS.format(key="doc_id", text="text", table="documents")
    items = _WINDOWS.format(key="item_id", text="enunciado", table="itens_avaliacao")
    return {"p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({docs}) d JOIN ({items}) i USING (janela)"}
