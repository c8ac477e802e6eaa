"""Row numbers in a global order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _own(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_ordinals(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0 for the first row by ``order``, 1 for the next one, and so on.

    Rows are dealt to ranges of ``order`` and written with their range; the rows of each
    range are counted, the counts of the ranges before give the offset, and a window per
    range numbers its rows. Ranges hold about equally many rows (rows that are equal in
    ``order`` stay in one); the only window without a key runs over one row per range.
    """
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = _own(df, "_range")
    ranged = written(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)     # at most n rows
    offsets = counts.select(F.col(part).alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    numbered = ranged.withColumn(name, local.cast("long")).join(F.broadcast(offsets), F.col(part) == F.col("_of"))
    return numbered.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)
