"""Tables written once and read again, in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
ROW_GROUP = 16 << 20  # bytes that a writing task buffers
BROADCAST_ROWS = 200_000  # keys that are copied to every executor at most: some 10 MB there
HOT_ROWS, HOT_SHARE = 100_000, 1000  # a key is hot with more rows than this, and more than one in so many of all


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python end at ``BATCH_ROWS`` rows or ``BATCH_BYTES``, whichever comes first: whole texts may be long, and every running task holds a few batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: computed once, lineage cut, lost executors harmless."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_folder(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_side(small: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``small``, a materialized table of ids, ready to be joined to whole texts: copied out while its rows, or those that it was gathered from (``counted``), are few, else merged by a shuffle."""
    rows = (small if counted is None else counted).count()
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")


def hot_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", n: str = "n") -> DataFrame:
    """``rows`` joined to ``side``, a materialized table with one row a key and the number ``n`` of rows that have the key.

    Rows of hot keys stay where they are and meet a copy of these few rows of
    ``side``, at most ``HOT_SHARE`` by their definition; the others are shuffled
    by the key.  ``how`` is inner, left or left_semi.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(side.where(F.col(n) > limit))
    if hot.isEmpty():
        return rows.join(side, key, how)
    cold = rows.join(hot.select(key), key, "left_anti").join(side.where(F.col(n) <= limit), key, how)
    return rows.join(hot, key, "inner" if how == "left" else how).unionByName(cold)
