"""The folder that driver and executors share, and tables written there once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that a join may copy to all tasks.
COPIED_ROWS = 200_000


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets its own folder.

    A cluster without the setting is an error: its executors share no local folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="chronolith-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is there yet."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once: written as Parquet and read back, so that lineage ends there and lost executors cost a task."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_side(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and counted, ready to be joined to more rows: copied while its own rows are few, else merged by a shuffle.

    Spark decides by bytes of files, in which millions of repeated values are small, and would copy the other side.
    """
    t = shared_table(df, name)
    return F.broadcast(t) if t.count() <= COPIED_ROWS else t.hint("merge")
