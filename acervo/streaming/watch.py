"""Ingest of an inbox: the backlog first, then what arrives, each micro-batch idempotent.

``ingest`` takes raw files into the index in a fixed order: results are worked out and saved, rows are appended to the index,
results to the log, and only then are files moved.  A batch that is run again after a crash finds its rows by their hashes,
and its part of the log is written over.  Of the index only ``id``, ``hash`` and ``caminho`` are read.

Two streams give the raw files.  ``stream`` is Spark's file source: it never delivers a path twice, and passes over empty
files and names with a leading underscore; it is told to keep files of any age.  ``watch`` uses a clock instead and lists
the folder at each tick (names only), which finds all of these; files are moved away once they are done.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyarrow import fs as files_on
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acervo.functions.text import base_name
from acervo.operators.archive import backup_folder, free_names
from acervo.operators.index import insert_ignore
from acervo.operators.ingest import results
from acervo.plans.schemas import FILES, INDEX, LISTED, RESULTS
from acervo.plans.workspace import Workspace, file_system
from acervo.sources.config import Settings
from acervo.sources.inbox import files, listed, settled


def _table(spark: SparkSession, path: str, schema, by: str | None = None) -> DataFrame:
    store, at = file_system(spark, path)
    if not store.exists(at):
        writer = spark.createDataFrame([], schema).write.mode("ignore")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index table; an empty one is made where there is none."""
    return _table(spark, path, INDEX)


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of results; an empty one is made where there is none."""
    return _table(spark, path, RESULTS, "lote")


def ingest(raw: DataFrame, settings: Settings, batch: str | None = None, move: bool = True) -> DataFrame:
    """Take raw files into the index; returns this batch's part of the log, a row for each file."""
    spark, batch = raw.sparkSession, batch or uuid.uuid4().hex
    with Workspace(spark, "ingest") as work:
        index = open_index(spark, settings.index).select("id", "hash", "caminho")
        log = open_log(spark, settings.log)
        read = work.save(files(raw).where(~F.col("arquivo").startswith(".")), "files")
        told = work.save(results(read, index, settings.archive, ["path"], work, watched=settings.extensions), "results")
        done = told.where("ignorado IS NULL")
        if settings.backup:
            placed = done.select("path", "arquivo", backup_folder(settings.backup, F.col("categoria")).alias("pasta"))
            taken = log.where("copia IS NOT NULL").select(F.regexp_extract("copia", r"(?s)^(.*)/[^/]*$", 1).alias("pasta"), base_name(F.col("copia")).alias("nome"))
            copies = free_names(placed, taken.distinct(), ["path"], work).select("path", F.concat_ws("/", "pasta", "nome").alias("copia"))
            told = told.join(copies, "path", "left")
        else:
            told = told.withColumn("copia", F.lit(None).cast("string"))
        told = work.save(told.withColumn("registrado_em", F.current_timestamp()).select(*[c for c in RESULTS.names if c != "lote"]), "told")
        new = told.where("ignorado IS NULL").join(read.select("path", "texto", "hash"), "path")
        rows = new.select("path", "arquivo", F.col("destino").alias("caminho"), "categoria", F.col("data").alias("data_documento"), "texto", "hash", F.col("registrado_em").alias("processado_em"))
        rows = insert_ignore(index, rows, ["path"], work)
        rows.select(*[F.col(c.name).cast(c.dataType) for c in INDEX]).write.mode("append").parquet(settings.index)
        told.write.mode("overwrite").parquet(f"{settings.log}/lote={batch}")
        if move:
            move_files(told.where("ignorado IS NULL").select("path", "destino", "copia"))
    return spark.read.schema(RESULTS).parquet(settings.log).where(F.col("lote") == batch)


def move_files(rows: DataFrame) -> None:
    """Move each file to its place and copy it to its backup, on the executors, on any file system that Arrow knows."""

    def place(path: str):
        path = path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path
        return files_on.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))

    def run(part) -> None:
        for r in part:
            source, at = place(r.path)
            target, to = place(r.destino)
            target.create_dir(to.rpartition("/")[0], recursive=True)
            if source.get_file_info(at).type == files_on.FileType.File:
                if source == target:
                    source.move(at, to)
                else:
                    files_on.copy_files(at, to, source_filesystem=source, destination_filesystem=target)
                    source.delete_file(at)
            if r.copia:
                store, copy = place(r.copia)
                store.create_dir(copy.rpartition("/")[0], recursive=True)
                files_on.copy_files(to, copy, source_filesystem=target, destination_filesystem=store)

    rows.foreachPartition(run)


def ingest_folder(spark: SparkSession, settings: Settings) -> DataFrame:
    """One pass over the inbox folder, in the order of paths."""
    return ingest(listed(spark, settings.inbox), settings)


def successes(told: DataFrame) -> int:
    """How many files of a log were taken in."""
    return told.where("ignorado IS NULL").count()


def stream(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """The inbox as a stream of raw files, by Spark's file source."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFileAge", "36500d")
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(folder)


def backlog(spark: SparkSession, settings: Settings, checkpoint: str, per_batch: int | None = None) -> StreamingQuery:
    """Start the stream of Spark's file source; it ends when what is there has been taken in."""
    writer = stream(spark, settings.inbox, per_batch).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, n: ingest(rows, settings, f"{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint)}-{n}") and None).start()


def watch(spark: SparkSession, settings: Settings, checkpoint: str, every: float = 2.0, gate: Callable[[DataFrame], DataFrame] = settled) -> StreamingQuery:
    """Start the live stream: at each tick the files that are in the inbox, once ``gate`` finds them copied completely."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, n: int) -> None:
        rows = gate(listed(spark, settings.inbox, content=False))
        if rows is not None:
            ingest(rows, settings, f"{uuid.uuid5(uuid.NAMESPACE_URL, checkpoint)}-{n}")

    return clock.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} seconds").foreachBatch(tick).start()


def feed(spark: SparkSession, path: str) -> DataFrame:
    """The new rows of the index as a stream, as a screen lists them."""
    open_index(spark, path)
    return spark.readStream.schema(INDEX).parquet(path).select(*LISTED)
