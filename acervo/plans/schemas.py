"""Schemas of the index, of inbox files and of the log of results."""

from __future__ import annotations

from pyspark.sql import types as T

INDEX = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("arquivo", T.StringType(), False),
    T.StructField("caminho", T.StringType(), False),
    T.StructField("categoria", T.StringType(), False),
    T.StructField("data_documento", T.StringType()),
    T.StructField("texto", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("processado_em", T.TimestampType(), False),
])

FILES = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

RESULTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("arquivo", T.StringType()),
    T.StructField("categoria", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("destino", T.StringType()),
    T.StructField("copia", T.StringType()),
    T.StructField("ignorado", T.StringType()),
    T.StructField("registrado_em", T.TimestampType()),
    T.StructField("lote", T.StringType()),
])

LISTED = ("id", "arquivo", "caminho", "categoria", "data_documento", "processado_em")
