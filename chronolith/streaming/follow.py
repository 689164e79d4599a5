"""Followers as streams: heads that changed, updates of forks after a cursor, and bursts that are too large to list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retention import with_previous
from .radar import _E, drained, event_stream, seals, stepped

QUEUE = 3  # changes of a burst that are listed; more than these call for a scan of everything


def moved(rows: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(workspace, sequence, content)`` whose content differs from the head before, across batches; and the heads after them, ``heads(workspace, head)``."""
    r = with_previous(rows, ["workspace"], "sequence", {"before": "content"}).join(heads, "workspace", "left")
    told = r.where(~F.col("content").eqNullSafe(F.coalesce("before", "head"))).select("workspace", "sequence")
    last = rows.groupBy("workspace").agg(F.max_by("content", "sequence").alias("head"))
    return told, last.unionByName(heads.join(last.select("workspace"), "workspace", "left_anti"))


def head_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the content of a workspace's head changed: a follower is told of these and of no others.  All files are one batch, as they may interleave."""
    s = event_stream(spark, sf_dir, files=None).select("workspace", "sequence", F.concat_ws(":", "kind", F.col("k").cast("string")).alias("content"))
    return stepped(s, moved, "workspace long, head string", "workspace long, sequence long")


def fork_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of forks after the cursor of each; forks without a cursor are not watched."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cursors = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("workspace")).agg(F.min("event_id").alias("cursor"))
    s = event_stream(spark, sf_dir).select("workspace", "sequence", "kind").join(cursors, "workspace").where("sequence > cursor")
    return drained(s.select("workspace", "sequence", "kind"), "append")


def overflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each burst is taken up: by its paths, or by a scan of everything where it passed the bound of the queue."""
    s = seals(spark, sf_dir)
    return s.groupBy(F.when(F.col("changes") > QUEUE, "rescan").otherwise("paths").alias("mode")).agg(F.count("*").alias("bursts"), F.sum("changes").alias("changes"))


QUERIES = {
    "stream_head_changes": (head_changes, f"WITH {_E} SELECT workspace, sequence FROM (SELECT *, lag(kind || ':' || k) OVER (PARTITION BY workspace ORDER BY sequence) AS b FROM e) WHERE b IS DISTINCT FROM kind || ':' || k"),
    "stream_fork_watch": (fork_watch, f"WITH {_E} SELECT workspace, sequence, kind FROM e JOIN (SELECT workspace, min(sequence) AS cursor FROM e WHERE kind = 'signup' GROUP BY 1) c USING (workspace) WHERE sequence > cursor"),
    "stream_overflows": (overflows, f"""WITH {_E}, g AS (SELECT *, sum(CASE WHEN us - p < 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY workspace ORDER BY us, sequence) AS b FROM (SELECT *, lag(us) OVER (PARTITION BY workspace ORDER BY us, sequence) AS p FROM e)),
n AS (SELECT workspace, b, count(*) AS n FROM g GROUP BY 1, 2) SELECT CASE WHEN n > {QUEUE} THEN 'rescan' ELSE 'paths' END AS mode, count(*) AS bursts, sum(n)::BIGINT AS changes FROM n GROUP BY 1"""),
}
