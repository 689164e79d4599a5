"""Stores as tables: bundles, compaction, pins, forks, published versions, previews, transitions."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import CONTROL, is_identity, legacy_fork_id, merge_allowed, radar_ignored
from .diff import diff
from .trees import without_subtrees

RECORD_HEAD = 82  # bytes beside the payload of a stored object


def export_bundle(reached: DataFrame, objects: DataFrame, path: str) -> int:
    """Writes the objects of ``objects(id, ...)`` that ``reached(node)`` names, and returns their number; a name without an object is an error."""
    wanted = reached.select(F.col("node").alias("id")).distinct()
    lost = wanted.join(objects.select("id"), "id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"object {lost[0].id} is missing")
    objects.join(wanted, "id", "left_semi").write.mode("errorifexists").parquet(path)
    return objects.sparkSession.read.parquet(path).count()


def compacted(objects: DataFrame, live: DataFrame) -> DataFrame:
    """Live objects of ``objects(id, len)`` in the order of their ids, as they lie in one new pack: id, len, offset.

    Offsets are running sums in two steps, over ranges of ids and inside each, so that no task sees the whole pack.
    """
    kept = objects.join(live.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("id", "len")
    kept = kept.withColumn("range", F.substring("id", 1, 3))
    before = kept.groupBy("range").agg(F.sum(F.col("len") + RECORD_HEAD).alias("size"))
    before = before.withColumn("before", F.sum("size").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    inside = F.sum(F.col("len") + RECORD_HEAD).over(W.partitionBy("range").orderBy("id").rowsBetween(W.unboundedPreceding, 0)) - (F.col("len") + RECORD_HEAD)
    placed = kept.withColumn("inside", inside).join(before.drop("size"), "range")
    return placed.select("id", "len", (F.col("before") + F.col("inside")).cast("long").alias("offset"))


def publish(df: DataFrame, folder: str, name: str) -> str:
    """A new version of a table: written whole first, and named in the pointer after that, so readers see one version or the other."""
    spark = df.sparkSession
    version = f"{folder.rstrip('/')}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.createDataFrame([(time.time_ns(), version)], "at long, version string").coalesce(1).write.mode("append").json(f"{folder.rstrip('/')}/pointers/{name}")
    return version


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The version that the newest pointer names."""
    newest = spark.read.schema("at long, version string").json(f"{folder.rstrip('/')}/pointers/{name}").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(newest)


def swap(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """New versions of several tables, which appear together: all are written before one pointer row names them all."""
    root = folder.rstrip("/")
    versions = {name: f"{root}/{name}/{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(versions[name])
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(versions,)], "versions map<string,string>").coalesce(1).write.mode("append").json(f"{root}/pointers/all")
    return versions


def pin(pins: DataFrame, asked: DataFrame, grades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pins after, refused): ``asked(workspace, sequence)`` join ``pins`` once each if ``grades(sequence, grade)`` calls them exact; partial or unknown ones are refused."""
    graded = asked.select("workspace", "sequence").distinct().join(grades.select("sequence", "grade"), "sequence", "left")
    exact = F.coalesce(F.col("grade") == "exact", F.lit(False))
    after = pins.select("workspace", "sequence").unionByName(graded.where(exact).select("workspace", "sequence")).distinct()
    return after, graded.where(~exact).select("workspace", "sequence")


def unpin(pins: DataFrame, asked: DataFrame) -> DataFrame:
    return pins.select("workspace", "sequence").distinct().join(asked.select("workspace", "sequence"), ["workspace", "sequence"], "left_anti")


FORK = "fork_id string, name string, base_snapshot string, created_at long"


def fork_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptors of forks, one JSON file each: fork_id, name, base_snapshot, created_at; those from before forks had ids get theirs."""
    d = spark.read.schema(FORK).option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    return with_fork_ids(d)


def with_fork_ids(d: DataFrame) -> DataFrame:
    own = F.when(F.col("fork_id") != "", F.col("fork_id"))
    return d.withColumn("fork_id", F.coalesce(own, legacy_fork_id(F.col("name"), F.col("base_snapshot"))))


def fork_order() -> list[Column]:
    """Newest first, then by name."""
    return [F.col("created_at").desc(), F.col("name").asc()]


def find_forks(forks: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(wanted)`` by name or by id: wanted, fork_id, name; null where there is none."""
    keys = forks.select(F.col("name").alias("wanted"), "fork_id", "name").unionByName(forks.select(F.col("fork_id").alias("wanted"), "fork_id", "name")).distinct()
    return asked.select("wanted").distinct().join(keys, "wanted", "left")


def entries_at(state: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries of a state at given paths, with misses: path, found and the entry's fields."""
    rest = [c for c in state.columns if c != "path"]
    return paths.select("path").distinct().join(state.withColumn("found", F.lit(True)), "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"), *rest)


def entries_for_plan(state: DataFrame, plan: DataFrame) -> DataFrame:
    """Entries that a plan's restores and replacements need, in ``verdict`` told apart from those the state lacks, which are an error to apply."""
    need = plan.where("action <> 'remove'").select("path", "action")
    return entries_at(state, need).join(need, "path").withColumn("verdict", F.when(F.col("found"), "present").otherwise("missing"))


def transition(current: DataFrame, target: DataFrame, current_rules: DataFrame, target_rules: DataFrame) -> DataFrame:
    """Changes that bring one snapshot to another: those at the control directory, and those that a rule of either excludes, are left alone."""
    d = diff(current, target).where(F.col("path") != CONTROL)
    return without_subtrees(d, current_rules.select("path").unionByName(target_rules.select("path")))


def captured_paths(changed: DataFrame, rules: DataFrame) -> DataFrame:
    """Changed paths that a capture looks at: no rule excludes them, and they are no control state."""
    return without_subtrees(changed.select("path").distinct().where(~is_identity(F.col("path"))), rules)


def merge_inputs(state: DataFrame) -> DataFrame:
    return state.where(merge_allowed(F.col("path")))


def radar_inputs(state: DataFrame) -> DataFrame:
    return state.where(~radar_ignored(F.col("path")))


def preview_digest(changes: DataFrame, *context: str) -> DataFrame:
    """One row: a digest of a plan's (path, action) rows in the order of their paths, under what the plan is for.

    Rows are digested by 65,536 groups of paths first, so that what is put together at the end is at most so many digests.
    """
    row = F.concat_ws("\0", "action", "path")
    part = F.substring(F.sha2("path", 256), 1, 4)
    parts = changes.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "")
    head = F.lit("\0".join(context) + "\0")
    return parts.agg(F.sha2(F.concat(head, whole), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("changes"))


def pages(children: DataFrame, limit: int = 65_536) -> DataFrame:
    """``children(dir, name, size)`` to pages: dir, page, entries, bytes.  Names fill a page in their order until the next would pass the limit.

    The rule is sequential in a directory: rows come sorted, and a task keeps two numbers, not the directory.
    """
    import pandas as pd

    def fill(batches):  # noqa: ANN001, ANN202
        at, page, n, used, out = None, 0, 0, 0, []
        for pdf in batches:
            for d, size in zip(pdf["dir"], pdf["size"], strict=True):
                if d != at:
                    if n:
                        out.append((at, page, n, used))
                    at, page, n, used = d, 0, 0, 0
                if n and used + size > limit:
                    out.append((at, page, n, used))
                    page, n, used = page + 1, 0, 0
                n, used = n + 1, used + int(size)
            yield pd.DataFrame(out, columns=["dir", "page", "entries", "bytes"])
            out = []
        if n:
            yield pd.DataFrame([(at, page, n, used)], columns=["dir", "page", "entries", "bytes"])

    rows = children.select("dir", "name", "size").repartition("dir").sortWithinPartitions("dir", F.col("name").cast("binary"))
    return rows.mapInPandas(fill, "dir string, page int, entries long, bytes long")
