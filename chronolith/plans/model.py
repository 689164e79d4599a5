"""The versioned-dataset model over the driver's tables: entries of three tree states, timeline, forks' scopes, chunks, graph.

Projections use literals and arithmetic only, so every relation is the same on each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import with_ancestors

SIDES = ("base", "ours", "theirs")
#: Which orders a side has, and the version of their content; k is the order's key, c the customer's group.
EXISTS = {"base": "k % 19 <> 0", "ours": "k % 13 <> 0 AND c <> 5", "theirs": "k % 17 <> 0 AND c <> 8"}
VERSION = {
    "base": "0",
    "ours": "CASE WHEN k % 11 = 0 THEN 1 WHEN c = 8 AND k % 2 = 0 THEN 3 ELSE 0 END",
    "theirs": "CASE WHEN k % 7 = 0 THEN 1 WHEN k % 38 = 0 THEN 2 ELSE 0 END",
}
KIND = {"base": "'File'", "ours": "'File'", "theirs": "CASE WHEN k % 23 = 0 THEN 'Symlink' ELSE 'File' END"}
TOUCHED = {"base": "0", "ours": "CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END", "theirs": "0"}
ENTRY = ("kind", "target", "mode", "size", "mtime")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def leaves(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Files of a side: path, kind, target, mode, size, mtime and the order's key."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 97).alias("c"), "o_orderpriority", "o_orderstatus",
        F.floor("o_totalprice").cast("long").alias("sz"), seconds("o_orderdate").alias("mt"),
    )
    v = F.expr(VERSION[side]).cast("int")
    return o.where(EXISTS[side]).select(
        "k",
        F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.col("c").cast("string"), F.col("k").cast("string")).alias("path"),
        F.expr(KIND[side]).alias("kind"),
        F.sha2(F.concat(F.col("k").cast("string"), F.lit(":"), v.cast("string")), 256).alias("target"),
        F.lit(420).alias("mode"),
        (F.col("sz") + v).alias("size"),
        (F.col("mt") + F.expr(TOUCHED[side])).alias("mtime"),
    )


def tree(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Files and the directories above them; a directory's target changes with what it holds."""
    files = leaves(spark, sf_dir, side)
    dirs = with_ancestors(files).groupBy("above").agg(F.count("*").alias("n"), F.sum(F.col("k") * 8 + F.col("size") % 8).alias("s"))
    dirs = dirs.select(
        F.col("above").alias("path"), F.lit("Directory").alias("kind"), F.concat_ws(":", F.lit("dir"), F.col("n").cast("string"), F.col("s").cast("string")).alias("target"),
        F.lit(493).alias("mode"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"),
    )
    return files.drop("k").unionByName(dirs)


_LEAF_SQL = """
{s}_files AS (
  SELECT k, p || '/' || st || '/' || c || '/' || k AS path, {kind} AS kind, sha256(k || ':' || ({ver})) AS target, 420 AS mode,
         sz + ({ver}) AS size, mt + ({touched}) AS mtime, p, st, c
  FROM (SELECT o_orderkey AS k, o_custkey % 97 AS c, o_orderpriority AS p, o_orderstatus AS st, floor(o_totalprice)::BIGINT AS sz,
               floor(epoch_us(o_orderdate) / 1000000)::BIGINT AS mt FROM orders) WHERE {exists})"""
_TREE_SQL = """,
{s} AS (
  SELECT path, kind, target, mode, size, mtime FROM {s}_files
  UNION ALL
  SELECT d, 'Directory', 'dir:' || count(*) || ':' || sum(k * 8 + size % 8)::BIGINT, 493, 0, 0
  FROM (SELECT unnest([p, p || '/' || st, p || '/' || st || '/' || c]) AS d, k, size FROM {s}_files) GROUP BY d)"""


def tree_sql(*sides: str, dirs: bool = True) -> str:
    """The same as common table expressions in DuckDB, without WITH: {side}_files and {side}."""
    out = []
    for s in sides:
        sql = _LEAF_SQL.format(s=s, kind=KIND[s], ver=VERSION[s], touched=TOUCHED[s], exists=EXISTS[s])
        out.append(sql + (_TREE_SQL.format(s=s) if dirs else ""))
    return ",".join(out)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot log of a workspace per user: workspace, sequence, sealed_at, kind, k, snapshot_id."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1))
    return e.select(
        F.col("user_id").alias("workspace"), F.col("event_id").alias("sequence"), seconds("ts").alias("sealed_at"), F.col("event_type").alias("kind"), k.alias("k"),
        F.sha2(F.concat_ws(":", F.col("event_type"), k.cast("string")), 256).alias("snapshot_id"),
    )


TIMELINE_SQL = """
timeline AS (
  SELECT user_id AS workspace, event_id AS sequence, floor(epoch_us(ts) / 1000000)::BIGINT AS sealed_at, event_type AS kind,
         coalesce(json_extract_string(props, '$.k')::INT, -1) AS k,
         sha256(event_type || ':' || coalesce(json_extract_string(props, '$.k')::INT, -1)) AS snapshot_id FROM events)"""


def long_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of years: workspace, sequence, sealed_at from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("sequence"), seconds("o_orderdate").alias("sealed_at"))


HISTORY_SQL = """
timeline AS (SELECT o_custkey AS workspace, o_orderkey AS sequence, floor(epoch_us(o_orderdate) / 1000000)::BIGINT AS sealed_at FROM orders)"""


#: Which of the log's sequences the forks of a phase have.
PHASES = ("sequence % 10 <> 7", "sequence % 10 <> 3")


def _scoped(t: DataFrame, *more: Column) -> DataFrame:
    subtree = F.col("sequence") % 101 == 0
    path = F.concat_ws("/", "kind", F.col("k").cast("string"), F.when(~subtree, (F.col("sequence") % 30).cast("string")))
    return t.select(F.col("workspace").alias("fork"), path.alias("path"), subtree.cast("int").alias("scope"), *more)


def dirty_scopes(spark: SparkSession, sf_dir: str, phase: int = 0) -> DataFrame:
    """What each fork has changed: fork, head, path, scope (1: the whole subtree). Phase 1 is a later state."""
    t = timeline(spark, sf_dir).where(PHASES[phase])
    head = t.groupBy(F.col("workspace").alias("fork")).agg(F.max("sequence").alias("head"))
    return _scoped(t).distinct().join(head, "fork")


def dirty_scopes_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dirty_scopes`` of both phases, with the column phase: what both have is read and shuffled once.

    Heads, a row a fork, are hashed and not sorted.
    """
    t = timeline(spark, sf_dir)
    earlier, later = map(F.expr, PHASES)
    bits = F.when(earlier, 1).otherwise(0) + F.when(later, 2).otherwise(0)
    rows = _scoped(t, bits.alias("phases")).where("phases > 0").groupBy("fork", "path", "scope").agg(F.bit_or("phases").alias("phases"))
    heads = t.groupBy(F.col("workspace").alias("fork")).agg(F.max(F.when(earlier, F.col("sequence"))).alias("one"), F.max(F.when(later, F.col("sequence"))).alias("two"))
    both = rows.join(heads.hint("shuffle_hash"), "fork")
    phase = F.explode(F.when(F.col("phases") == 1, F.array(F.lit(0))).when(F.col("phases") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1))))
    return both.withColumn("phase", phase).select("fork", F.when(F.col("phase") == 0, F.col("one")).otherwise(F.col("two")).alias("head"), "path", "scope", "phase")


def scopes_sql(name: str = "scopes", phase: int = 0) -> str:
    keep = "sequence % 10 <> 3" if phase else "sequence % 10 <> 7"
    return f"""
{name} AS (
  SELECT DISTINCT t.workspace AS fork, h.head, kind || '/' || k || CASE WHEN sequence % 101 = 0 THEN '' ELSE '/' || (sequence % 30) END AS path,
         CASE WHEN sequence % 101 = 0 THEN 1 ELSE 0 END AS scope
  FROM timeline t JOIN (SELECT workspace, max(sequence) AS head FROM timeline WHERE {keep} GROUP BY workspace) h USING (workspace) WHERE {keep})"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks: blob, ordinal, chunk_id, len, and whether the document is in the store already."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("blob"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).select(
        "blob", "ordinal", F.sha2("line", 256).alias("chunk_id"), F.octet_length("line").cast("long").alias("len"), (F.col("blob") % 3 == 0).alias("stored")
    )


CHUNKS_SQL = """
chunks AS (
  SELECT doc_id AS blob, ordinal - 1 AS ordinal, sha256(line) AS chunk_id, strlen(line)::BIGINT AS len, doc_id % 3 = 0 AS stored
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal, unnest(string_split(text, chr(10))) AS line FROM documents))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object graph: region, nation, customer, order, line; an edge carries the class of what it leads to."""
    def pick(name: str, src: str, dst: str, cls: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.expr(cls).alias("class_bit"))

    return (
        pick("nation", "concat('r', n_regionkey)", "concat('n', n_nationkey)", "1")
        .unionByName(pick("customer", "concat('n', c_nationkey)", "concat('c', c_custkey)", "1"))
        .unionByName(pick("orders", "concat('c', o_custkey)", "concat('o', o_orderkey)", "CASE WHEN o_orderkey % 5 = 0 THEN 32 ELSE 1 END"))
        .unionByName(pick("lineitem", "concat('o', l_orderkey)", "concat('p', l_partkey)", "CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE 128 END"))
    )


EDGES_SQL = """
edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 1 AS class_bit FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 1 FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 32 ELSE 1 END FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE 128 END FROM lineitem)"""


def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of made-up projects, by part: path, size."""
    p = table(spark, sf_dir, "part")
    dirs = F.array(*map(F.lit, PROJECT_DIRS))
    names = F.array(*map(F.lit, PROJECT_NAMES))
    path = F.concat_ws(
        "/", F.concat(F.lit("proj"), (F.col("p_partkey") % 7).cast("string")), F.element_at(dirs, (F.col("p_partkey") % len(PROJECT_DIRS) + 1).cast("int")),
        F.concat(F.lit("f"), (F.col("p_partkey") % 11).cast("string")), F.element_at(names, (F.col("p_partkey") % len(PROJECT_NAMES) + 1).cast("int")),
    )
    return p.select("p_partkey", path.alias("path"), F.col("p_size").cast("long").alias("size"))


PROJECT_DIRS = ("src", ".git", "node_modules", "target", "docs", "venv", "build", ".ssh", "tmp", "lib", "logs", ".cache", "site-packages", "data", "dist", "vendor", "coverage")
PROJECT_NAMES = ("main.rs", "app.py", ".env", ".env.local", "id_rsa", "key.pem", "Cargo.lock", "go.sum", "x.sqlite", "y.db-wal", "a.o", "b.pyc", "run.log", "note~", ".#lock", "readme.md", "Cargo.toml", "z.tmp", "index.html")
_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
PATHS_SQL = f"""
paths AS (
  SELECT p_partkey, 'proj' || (p_partkey % 7) || '/' || ([{_quoted(PROJECT_DIRS)}])[p_partkey % {len(PROJECT_DIRS)} + 1] || '/f' || (p_partkey % 11) || '/' ||
         ([{_quoted(PROJECT_NAMES)}])[p_partkey % {len(PROJECT_NAMES)} + 1] AS path, p_size::BIGINT AS size FROM part)"""
