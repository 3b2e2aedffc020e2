"""Row numbers inside keys of any size.

A window by key alone puts a key that holds a third of all rows into one task. Here rows are range-partitioned by key and
order, numbered inside (partition, key), and moved up by what the key has in earlier partitions: one small row for each
partition that a key spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def row_numbers(df: DataFrame, key: str, order: list[str], name: str = "turn") -> DataFrame:
    """``df`` with the place of each row (from 1) among those of its key, null keys being one key; ties fall as they may."""
    placed = written(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(key, "_part").orderBy(*order)
    numbered = placed.withColumn("_turn", F.row_number().over(inner))
    joined = numbered.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_turn") + F.col("_start")).cast("long").alias(name))
