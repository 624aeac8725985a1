"""Dense numbers over rows in an order, without a task that has a whole group."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the session's checkpoint folder; on a local master without one, as in tests, a new one."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vellumlake-"))
    return df.checkpoint()


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 within `by` (may be empty), in the order of `order`, as a long: row_number() - 1, but as a prefix
    sum. Ranges of the order are dealt out and sorted; a row's number is its place in its part and what the parts before hold of
    its group. Give only the columns that are needed: these rows are moved and written. Ties are numbered in some order; nulls
    of `by` are a group."""
    keys = [*by, *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows
    spread = checkpointed(spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    parts = spread.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_of"), "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return spread.join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_least")).alias(name))
