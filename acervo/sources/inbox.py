"""Reading of an inbox folder: listing, hashes, text by format.

Spark's file source hides names with a leading underscore and empty files; ``listed`` finds them by listing the folder on
the driver (names only) and reading the bytes on the executors.  ``settled`` waits for files that are still being copied.
``read`` is the native source for all else.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.functions.text import base_name, suffix
from acervo.plans.rules import IMAGE_EXTENSIONS, NO_OCR, NO_PDF, TEXT_EXTENSIONS, UNSUPPORTED
from acervo.plans.schemas import FILES

READ = T.StructType([T.StructField("texto", T.StringType()), T.StructField("erro", T.StringType())])


def read(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Regular files of a folder with their bytes, by the native binary source."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def names(folder: str) -> list[str]:
    """Paths of the regular files of a folder but dot files, sorted; not recursive."""
    store, at = FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    found = store.get_file_info(FileSelector(at))
    return sorted(f"{folder.rstrip('/')}/{f.base_name}" for f in found if f.type == FileType.File and not f.base_name.startswith("."))


def _local(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def content_of(paths: DataFrame) -> DataFrame:
    """Raw files of ``path``, read on the executors."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:  # a row at a time: a task holds one file
                store, at = _local(path)
                info = store.get_file_info(at)
                if info.type == FileType.File:
                    with store.open_input_stream(at) as f:
                        content = f.read()
                    yield pd.DataFrame({"path": pd.Series([path], dtype=object), "modificationTime": pd.to_datetime([info.mtime_ns], unit="ns").astype("datetime64[us]"), "length": [len(content)], "content": [content]})

    return paths.select("path").mapInPandas(load, FILES)


def listed(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """All regular files of a folder but dot files, empty and underscored ones too; without ``content`` their paths only."""
    own = names(folder)
    rows = spark.createDataFrame([(n,) for n in own], "path string").repartition(max(1, min(len(own), spark.sparkContext.defaultParallelism)))
    return content_of(rows) if content else rows


#: Looks at a file's size, and seconds between them.
LOOKS, PAUSE = 20, 0.5


def settled(paths: DataFrame, looks: int = LOOKS, pause: float = PAUSE) -> DataFrame | None:
    """Raw files of ``path`` once their copying has ended: the size came twice and is not zero, or ``looks`` are over.

    The files of an Arrow batch are watched together, so many of them wait no longer than one; a file that vanishes is left out.
    None if there is no path.
    """
    if paths.isEmpty():
        return None

    def gate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            waiting, ready = dict.fromkeys(b["path"], -1), []
            for look in range(looks):
                for path, before in list(waiting.items()):
                    store, at = _local(path)
                    info = store.get_file_info(at)
                    if info.type != FileType.File:
                        del waiting[path]
                    elif info.size == before and info.size > 0:
                        ready.append(path)
                        del waiting[path]
                    else:
                        waiting[path] = info.size
                if not waiting:
                    break
                time.sleep(pause)
            yield pd.DataFrame({"path": pd.Series([*ready, *waiting], dtype=object)})

    return content_of(paths.select("path").mapInPandas(gate, "path string"))


def text_of(content: bytes) -> str:
    """UTF-8 text without the bytes that aren't, line ends as newlines."""
    return content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def _pdf(content: bytes) -> tuple[str | None, str | None]:
    try:
        import io

        from pypdf import PdfReader
    except ImportError:
        return None, NO_PDF
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages).strip(), None


def _image(content: bytes) -> tuple[str | None, str | None]:
    try:
        import io

        import pytesseract
        from PIL import Image
    except ImportError:
        return None, NO_OCR
    return pytesseract.image_to_string(Image.open(io.BytesIO(content)), lang="por").strip(), None


def extract(content: bytes, extension: str) -> tuple[str | None, str | None]:
    """Text and error of a file; a file that breaks its reader gives an error row, not a failed job."""
    try:
        if extension in TEXT_EXTENSIONS:
            return text_of(content), None
        if extension == ".pdf":
            return _pdf(content)
        if extension in IMAGE_EXTENSIONS:
            return _image(content)
    except Exception as e:  # noqa: BLE001 - any reader's failure is the file's
        return None, f"erro: {type(e).__name__}"
    return None, UNSUPPORTED + extension


def extracted(content: Column, extension: Column) -> Column:
    """Struct of ``texto`` and ``erro`` by the reader of the extension."""

    def run(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(c, e) for c, e in zip(content, extension, strict=True)], columns=["texto", "erro"])

    run.__annotations__ = {"content": pd.Series, "extension": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, READ)(content, extension)


def files(raw: DataFrame) -> DataFrame:
    """``path``, ``arquivo``, ``extensao``, ``modificationtime``, ``hash``, ``texto``, ``erro`` of raw files."""
    name = base_name(F.col("path"))
    out = raw.select("path", name.alias("arquivo"), F.lower(suffix(name)).alias("extensao"), F.col("modificationTime").alias("modificationtime"), F.sha2("content", 256).alias("hash"), "content")
    return out.withColumn("_x", extracted(F.col("content"), F.col("extensao"))).select("path", "arquivo", "extensao", "modificationtime", "hash", "_x.texto", "_x.erro")
