"""Row numbers in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fotoloom.session import Scratch


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The rows with their number, from 1, among those of equal keys in the given order, which should be total.

    The rows are range-partitioned by keys and order, so that a large group spreads over many tasks,
    written once (a range partitioning must not be sampled twice) and numbered inside a task; each task's
    rows are then counted on from those of the tasks before, of which a group has few. Null keys are a
    group of their own; an empty table gives an empty result.
    """
    s = Scratch(rows.sparkSession)
    ranged = rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__task", F.spark_partition_id())
    ranged = s.cut(ranged)
    inside = ranged.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__task").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = ranged.groupBy(*keys, "__task").agg(F.count("*").alias("__of"))
    tasks = tasks.select(*[F.col(k).alias("__k" + k) for k in keys], F.col("__task").alias("__t"), F.coalesce(F.sum("__of").over(before), F.lit(0)).alias("__before"))
    same = F.col("__task") == F.col("__t")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("__k" + k))
    return inside.join(tasks, same).withColumn(name, (F.col("__n") + F.col("__before")).cast("bigint")).select(*rows.columns, name)
