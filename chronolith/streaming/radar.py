"""Streaming forms: sealing after quiet, event dedup, and the conflict state machine.  All end with what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retention import running_sum, with_previous
from ..sources.files import read_ndjson, write_ndjson
from ..sources.shared import shared_folder

GAP = "1 hour"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files: int | None = 64) -> DataFrame:
    """Events in batches of at most so many files; None is one batch of all that is there."""
    reader = spark.readStream.schema(EVENTS)
    e = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1))
    return e.select(F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("workspace"), F.col("event_type").alias("kind"), k.alias("k"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a query over all that its sources hold now, and returns its result; complete results replace each other."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        q = w.format("parquet").option("path", f"{folder}/out").start()
    else:
        q = w.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seal per workspace and burst: first and last time, changes, kinds, by a session window of ``GAP``."""
    s = event_stream(spark, sf_dir)
    g = s.groupBy("workspace", F.session_window("at", GAP)).agg(F.count("*").alias("changes"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))
    out = drained(g.select("workspace", F.unix_seconds("session_window.start").alias("start"), (F.unix_seconds("session_window.end") - 3600).alias("end"), "changes", "first", "last"), "complete")
    return out.select("workspace", "start", "end", "changes", "first", "last")


def distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (workspace, kind, k) once, however often it comes; state falls to what the watermark still lets in."""
    s = event_stream(spark, sf_dir).withWatermark("at", "3650 days").dropDuplicates(["workspace", "kind", "k"])
    return drained(s.select("workspace", "kind", "k"), "append")


def transitions(rows: DataFrame, dirty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(k, workspace, sequence, kind)`` of a batch and the forks that were dirty before it, ``dirty(k, workspace)``, to changes of paths and the forks that are dirty now.

    A path is opened at two dirty forks, updated while they change, resolved below two: k, sequence, state, forks.
    A purchase cleans its fork, anything else makes it dirty.  A path that most rows are of is summed in blocks, not in one task.
    """
    fork = ["k", "workspace"]
    on = (F.col("kind") != "purchase").cast("int")
    r = with_previous(rows.select(*fork, "sequence", on.alias("on")), fork, "sequence", {"before": "on"})
    r = r.join(dirty.select(*fork, F.lit(1).alias("was")), fork, "left")
    r = r.select(*fork, "sequence", (F.col("on") - F.coalesce("before", "was", F.lit(0))).cast("long").alias("step"))
    r = running_sum(r, ["k"], "sequence", "step", "now").join(dirty.groupBy("k").agg(F.count("*").alias("held")), "k", "left")
    now = F.col("now") + F.coalesce("held", F.lit(0))
    was = now - F.col("step")
    state = F.when(was < 2, "opened").when(now < 2, "resolved").otherwise("updated")
    changed = r.where((F.col("step") != 0) & (F.greatest(now, was) >= 2)).select("k", "sequence", state.alias("state"), now.alias("forks"))
    last = rows.groupBy(*fork).agg(F.max_by(on, "sequence").alias("on"))
    left = last.where("on = 1").select(*fork).unionByName(dirty.join(last.select(*fork), fork, "left_anti").select(*fork))
    return changed, left


def stepped(stream: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], state: str, out: str) -> DataFrame:
    """Runs ``step(batch, state)``, which gives a batch's rows and the state after it, over all that the source holds now; ``state`` and ``out`` are schemas.

    A batch writes both under its own number, from the state before: a repeated one writes the same again.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stepped")
    spark.createDataFrame([], state).write.parquet(f"{folder}/state/before=0")
    spark.createDataFrame([], out).write.parquet(f"{folder}/out/batch=-1")  # of a source that holds nothing

    def take(batch: DataFrame, i: int) -> None:
        rows, after = step(batch, batch.sparkSession.read.schema(state).parquet(f"{folder}/state/before={i}"))
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
        after.write.mode("overwrite").parquet(f"{folder}/state/before={i + 1}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(take).start().awaitTermination()
    found = spark.read.schema(out).parquet(f"{folder}/out")
    return found.drop("batch")


def conflict_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of paths in the order of their sequence, which files may interleave: so all files are one batch."""
    s = event_stream(spark, sf_dir, files=None).select("k", "sequence", "workspace", "kind")
    return stepped(s, transitions, "k int, workspace long", "k int, sequence long, state string, forks long")


def ndjson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as NDJSON and read back."""
    folder = shared_folder(spark, "ndjson")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("sequence"), F.col("event_type").alias("kind"), F.col("user_id").alias("workspace"))
    write_ndjson(e, folder)
    return read_ndjson(spark, folder, "sequence long, kind string, workspace long").where("_corrupt IS NULL").select("sequence", "kind", "workspace")


_E = "e AS (SELECT event_id AS sequence, floor(epoch_us(ts) / 1000000)::BIGINT AS sec, user_id AS workspace, event_type AS kind, coalesce(json_extract_string(props, '$.k')::INT, -1) AS k, epoch_us(ts) AS us FROM events)"
QUERIES = {
    "stream_seals": (seals, f"""WITH {_E}, g AS (SELECT *, sum(CASE WHEN us - p < 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY workspace ORDER BY us, sequence) AS b FROM (SELECT *, lag(us) OVER (PARTITION BY workspace ORDER BY us, sequence) AS p FROM e))
SELECT workspace, min(sec) AS start, max(sec) AS "end", count(*) AS changes, min(sequence) AS first, max(sequence) AS last FROM g GROUP BY workspace, b"""),
    "stream_distinct_events": (distinct_events, f"WITH {_E} SELECT DISTINCT workspace, kind, k FROM e"),
    "stream_conflict_states": (conflict_states, f"""WITH {_E}, s AS (SELECT *, (kind <> 'purchase')::INT AS on_ FROM e),
d AS (SELECT *, on_ - coalesce(lag(on_) OVER (PARTITION BY k, workspace ORDER BY sequence), 0) AS d FROM s),
n AS (SELECT *, (sum(d) OVER (PARTITION BY k ORDER BY sequence))::BIGINT AS n FROM d)
SELECT k, sequence, CASE WHEN n - d < 2 THEN 'opened' WHEN n < 2 THEN 'resolved' ELSE 'updated' END AS state, n AS forks FROM n WHERE d <> 0 AND greatest(n, n - d) >= 2"""),
    "sink_ndjson": (ndjson_round_trip, f"WITH {_E} SELECT sequence, kind, workspace FROM e"),
}
