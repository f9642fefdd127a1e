"""Ordinals within groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.plans.workspace import Workspace


def ordinals(df: DataFrame, group: list[str], order: list[str], name: str, work: Workspace) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... by ``order`` within ``group`` (all rows if it is empty).

    Rows are range-partitioned by group and order, so a group may span partitions: each partition numbers its own rows,
    and the counts of the partitions before it, one row for each group and partition, are added.  ``order`` has to be
    total within the group.
    """
    by = [*group, *order]
    parts = df.repartitionByRange(*by).withColumn("_parte", F.spark_partition_id())
    parts = work.save(parts.withColumn("_n", F.row_number().over(W.partitionBy("_parte", *group).orderBy(*order))), f"{name}-parts")
    counts = parts.groupBy("_parte", *group).agg(F.count("*").alias("_c"))
    before = W.partitionBy(*group).orderBy("_parte").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_parte", *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_antes"))
    on = parts["_parte"] == offsets["_parte"]
    for g in group:
        on = on & parts[g].eqNullSafe(offsets[f"_g_{g}"])
    out = parts.join(offsets, on)
    return out.select(*[parts[c] for c in df.columns], (F.col("_n") + F.col("_antes")).cast("long").alias(name))
