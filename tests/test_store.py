"""Scopes, stores, names, streams' logs: small inputs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions import names as N
from chronolith.functions import paths as P
from chronolith.functions import values as V
from chronolith.operators import chunks as C
from chronolith.operators import logs as L
from chronolith.operators import radar as R
from chronolith.operators import reach as G
from chronolith.operators import scopes as S
from chronolith.operators import store as T
from chronolith.operators.diff import paired


def state(spark, *rows):
    full = [(p, k, t, 420, 1, c) for p, k, t, c in rows]
    return spark.createDataFrame(full, "path string, kind string, target string, mode int, size long, class string")


def scopes(df):
    return sorted((r.path, r.scope, r.action) for r in df.collect())


def test_scopes_by_case(spark):
    base = state(spark, ("d", "Directory", None, "source"), ("d/a", "File", "1", "source"), ("d/b", "File", "1", "dependency"), ("gone", "Directory", None, "source"), ("gone/x", "File", "1", "source"), ("flip", "File", "1", "source"), ("same", "File", "1", "source"))
    head = state(spark, ("d", "Directory", None, "source"), ("d/a", "File", "2", "source"), ("d/b", "File", "2", "dependency"), ("flip", "Directory", None, "source"), ("flip/y", "File", "1", "source"), ("same", "File", "1", "source"), ("new", "Directory", None, "source"), ("new/z", "File", "1", "source"), ("new/t", "File", "1", "scratch"), ("bare", "Directory", None, "source"), ("bare/t", "File", "1", "scratch"), (".git", "Directory", None, "source"))
    want = [("bare", 0, "add"), ("d/a", 0, "modify"), ("flip", 1, "modify"), ("gone", 1, "delete"), ("new/z", 0, "add")]
    assert scopes(S.observe(base, head)) == want
    middle = base.where("path <> 'gone/x'")
    stored = S.observe(base, middle)
    assert scopes(stored) == [("gone/x", 0, "delete")]
    assert scopes(S.observe(base, head, middle, stored)) == want
    # the rule looks at base and head alone: what a directory left that came and went between stays told
    assert scopes(S.observe(base, base, head, S.observe(base, head))) == [("new/z", 0, "add")]


def test_states_of_observed_heads_are_made_once(spark):
    from chronolith.plans import catalog

    plans = spark._jsparkSession.sharedState().statusStore()
    runs = lambda: (lambda s: {s.apply(i).executionId() for i in range(s.size())})(plans.executionsList())
    before = runs()
    assert catalog.radar_observe(spark, "/root/testdata/sf0.001").count() > 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    nodes = [n.apply(i).desc() for n in (plans.planGraph(r).allNodes() for r in runs() - before) for i in range(n.size())]
    assert sum("part.parquet" in d for d in nodes) <= 6  # of each of three states the files and the directories


@pytest.mark.parametrize(("pattern", "path", "hit"), [("a[!]b", "a[!]b", True), ("a[!]b", "ab", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[z-a]", "m", False), ("[]", "[]", True), ("x[", "x[", True), ("[^/]y", "/y", False), ("a.[ch]", "a.c", True), ("a.[ch]", "abc", False), ("[]]", "]", False), ("[.-0]/**", "//q", False), ("[\\]", "\\", True)])
def test_globs_with_classes(spark, pattern, path, hit):
    one = spark.createDataFrame([(pattern, path)], "g string, path string")
    assert one.select(F.col("path").rlike(P.glob_to_regex(pattern)).alias("h")).first().h is hit
    assert one.withColumn("re", P.glob_column("g")).where(F.expr("path RLIKE re")).count() == hit


def test_claims_with_classes_and_without_a_literal_start(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/d.rs",), ("z",)], "path string")
    claims = spark.createDataFrame([("a/[b]/*.py", 1), ("**/*.py", 2), ("a/d.rs", 3), ("*", 3)], "pattern string, workspace int")
    assert sorted(map(tuple, R.claim_states(paths, claims).collect())) == [("a/b/c.py", "contested"), ("a/d.rs", "covered"), ("z", "covered")]


def test_sizes_cursors_and_sums_out_of_range(spark):
    rows = [("99999999999999999999K", None), ("5ib", None), ("7 kB", 7168), ("12", 12), ("", None), ("-1", None), ("8388608T", None), ("3GiB", 3 << 30)]
    df = spark.createDataFrame(rows, "t string, want long")
    assert df.where(~V.parse_bytes(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    cursors = [("f:a:3", "f:a", 3), ("f.a:3", "f:a", None), ("f:a:-1", "f:a", None), ("f:a:99999999999999999999", "f:a", None), ("f:a:", "f:a", None)]
    for text, family, want in cursors:
        assert spark.range(1).select(V.cursor_sequence(F.lit(text), family)).first()[0] == want
    assert spark.range(1).select(V.saturating_add(F.lit(2**63 - 5), F.lit(9)), V.saturating_add(F.lit(2), F.lit(3))).first()[:] == (2**63 - 1, 5)


def test_following_and_pulling(spark):
    rows = [(5, None, 4, 4, "publish"), (5, 5, None, None, "idle"), (5, 6, None, None, "pull"), (5, 6, 5, 6, "idle"), (7, 6, 5, 6, "publish"), (7, 8, 5, 6, "pull")]
    df = spark.createDataFrame(rows, "l int, r int, sl int, sr int, want string")
    assert df.where(L.follow_decision(*map(F.col, ("l", "r", "sl", "sr"))) != F.col("want")).count() == 0
    rows = [(1, 1, 0, None, None, False, "up_to_date"), (1, 2, 1, None, None, False, "fast_forwarded"), (1, 2, 3, 1, 3, False, "fast_forwarded"), (1, 2, 3, 4, 3, False, "diverged"), (1, 2, None, None, None, True, "bootstrapped")]
    df = spark.createDataFrame(rows, "l int, r int, b int, pl int, pr int, boot boolean, want string")
    assert df.where(L.sync_disposition(*map(F.col, ("l", "r", "b", "pl", "pr", "boot"))) != F.col("want")).count() == 0


def test_slow_growth_is_tried_again_in_the_end(spark):
    log = spark.createDataFrame([(1, i, 10 * i, i, False) for i in range(1, 30)] + [(2, 1, 5, 0, True), (2, 2, 5, 1, False), (2, 3, 5, 86_401, False)], "workspace long, sequence long, used long, at long, satisfied boolean")
    got = sorted(map(tuple, L.pressure_tries(log, growth=64).collect()))
    assert got == [(1, 1), (1, 8), (1, 15), (1, 22), (1, 29), (2, 1), (2, 2), (2, 3)]


def test_deep_graphs_cycles_and_merge_bases(spark):
    parents = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 25)] + [("t1", "c3"), ("x", "t1"), ("x", "c9"), ("y", "z"), ("z", "y")], "src string, dst string")
    tip = lambda n: spark.createDataFrame([(n,)], "node string")
    assert G.reach(tip("c24"), parents).agg(F.max("depth")).first()[0] == 24
    lineage = spark.createDataFrame([(f"c{i}",) for i in range(25)], "node string")
    assert G.merge_base(parents, lineage, tip("t1")).first()[:] == ("found", "c3")
    assert G.merge_base(parents, lineage, tip("x")).first()[:] == ("ambiguous", None)
    assert G.merge_base(parents, lineage, tip("y")).first()[:] == ("none", None)
    with pytest.raises(ValueError, match="first"):
        G.bisect_search([1, 2, 3], lambda s: False)


def test_boundaries_byte_by_byte():
    rng = random.Random(7)
    data = rng.randbytes(60_000)
    smallest, average, largest = 256, 1024, 4096
    bits, ends, start, h = average.bit_length() - 1, [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(C._GEAR[b])) % 2**64
        n = i + 1 - start
        zero = bits + 1 if n < average + 1 else bits - 1
        if n > smallest and h >> (64 - zero) == 0 or n == largest:
            ends.append(i + 1)
            start = i + 1
    if start < len(data):
        ends.append(len(data))
    assert C.boundaries(data, smallest, average, largest) == ends


def test_names(spark):
    assert spark.range(1).select(N.lossy_text(F.lit(b"a\xff"))).first()[0] == "a�"
    assert spark.range(1).select(N.family_verdict(F.lit("0" * 32)), N.family_verdict(F.lit("g" * 32)), N.pattern_verdict(F.lit(None).cast("string"))).first()[:] == ("valid", "invalid", "empty")


def test_fork_descriptors_and_swaps(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"fork_id": "", "name": "old", "base_snapshot": "s", "created_at": 1}')
    (tmp_path / "b.json").write_text('{"fork_id": "f2", "name": "new", "base_snapshot": "s", "created_at": 2, "other": 1}')
    (tmp_path / "c.txt").write_text("{}")
    d = T.fork_descriptors(spark, str(tmp_path)).orderBy(*T.fork_order()).collect()
    assert [(r.name, len(r.fork_id)) for r in d] == [("new", 2), ("old", 32)]
    versions = T.swap({"x": spark.range(3), "y": spark.range(4)}, str(tmp_path / "s"))
    assert spark.read.parquet(versions["y"]).count() == 4
    with pytest.raises(ValueError, match="missing"):
        T.export_bundle(spark.createDataFrame([("q",)], "node string"), spark.createDataFrame([("a", 1)], "id string, len long"), str(tmp_path / "bundle"))


def test_estimates_count_what_is_left_out(spark):
    from chronolith.operators import trees

    rows = [("a", "Directory", 0), ("a/x", "Directory", 0), ("a/x/1", "File", 1), ("a/y", "File", 513), ("b", "Socket", 0), ("c", "Symlink", 0), ("ab", "File", 2)]
    rules = spark.createDataFrame([("a/x",), ("a/x/1",), ("a/x",), ("c",), ("zz",)], "path string")
    e = trees.estimate(spark.createDataFrame(rows, "path string, kind string, size long"), rules).first().asDict()
    assert e == {"files": 2, "directories": 2, "symlinks": 0, "logical_bytes": 515, "physical_bytes": 1536, "special_entries": 1, "excluded_subtrees": 2, "policy_rules": 4}
    nothing = trees.estimate(spark.createDataFrame([], "path string, kind string, size long"), rules).first()
    assert (nothing.files, nothing.directories, nothing.excluded_subtrees) == (0, 1, 0)


def test_a_directory_of_many_pages_has_one_identity(spark):
    import hashlib

    from chronolith.operators import trees

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    names = [f"n{i}" for i in range(300)]
    pages = {}
    for n in names:
        pages.setdefault(sha(n)[:3], []).append(f"{n}\tFile\t{sha('t' + n)}")
    d = sha("".join(sha("\n".join(sorted(pages[p]))) for p in sorted(pages)))
    rows = [(f"d/{n}", "File", sha("t" + n)) for n in names]
    got = {r.path: (r.tree_id, r.children) for r in trees.merkle(spark.createDataFrame(rows, "path string, kind string, target string").repartition(5)).collect()}
    assert got == {"d": (d, 300), "": (sha(sha(f"d\tDirectory\t{d}")), 1)}


def test_pairs_of_given_paths(spark):
    schema = "path string, kind string"
    left = spark.createDataFrame([("a", "File"), ("b", "File"), ("d", "Directory")], schema)
    right = spark.createDataFrame([("a", "Symlink"), ("c", "File"), ("d", "Directory")], schema)
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("x",)], "path string")
    got = paired(left, right, asked).select("path", "l.kind", "r.kind").orderBy("path").collect()
    assert [tuple(r) for r in got] == [("a", "File", "Symlink"), ("b", "File", None), ("c", None, "File")]
    assert paired(left, right, asked.limit(0)).isEmpty()
