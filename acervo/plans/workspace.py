"""Tables that cut a plan's lineage, in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Where that is unset a local session (tests, a
laptop) gets a temporary folder; a cluster has to name one, since a folder of one machine would not be seen by the others.
Tables written here outlive a lost executor, unlike blocks kept by executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets one only where a local session has none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="acervo-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Workspace:
    """A folder of its own under the shared folder, for the tables of one run of one operator.

    ``finish`` keeps the result and deletes all else; what is kept goes when the session ends, or by ``drop``.  As a context
    the folder goes at its end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/acervo-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet, in folders ``by`` a column, and read it again: its plan is not run a second time."""
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, name: str) -> None:
        """Delete a table that is not read again."""
        fs, at = file_system(self.spark, f"{self.path}/{name}")
        fs.delete(at, True)

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Save the result ``df`` and delete all other tables of this workspace."""
        out = self.save(df, name)
        try:
            fs, at = file_system(self.spark, self.path)
            for entry in fs.listStatus(at):
                if entry.getPath().getName() != name:
                    fs.delete(entry.getPath(), True)
        except Exception:  # noqa: BLE001 - what can't be deleted now goes at the end
            pass
        return out

    def drop(self) -> None:
        """Delete the folder; a session that has ended leaves it to the cluster's own clean-up."""
        atexit.unregister(self.drop)
        try:
            fs, at = file_system(self.spark, self.path)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001 - at exit the JVM may be gone
            pass

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()
