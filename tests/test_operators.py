"""Operators on small inputs: merge rules, retention bounds, reachability, chunks, radar life cycle, packs, policies."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import chunks as C
from chronolith.operators import diff as D
from chronolith.operators import logs as L
from chronolith.operators import merge as M
from chronolith.operators import radar as R
from chronolith.operators import reach as G
from chronolith.operators import retention as T
from chronolith.sources import files as S

ENTRY = "path string, kind string, target string, mode int, size long, mtime long"


def tree(spark, **entries):
    rows = [(p.replace("__", "/"), *(v if isinstance(v, tuple) else ("File", v, 420, 1, 0))) for p, v in entries.items()]
    return spark.createDataFrame(rows, ENTRY)


DIR = lambda t="t": ("Directory", t, 493, 0, 0)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_merge_takes_over_independent_changes(spark):
    base = tree(spark, d=DIR("1"), d__a="x", d__b="x")
    changes, conflicts = M.merge(base, tree(spark, d=DIR("2"), d__a="y", d__b="x"), tree(spark, d=DIR("3"), d__a="x", d__b="z"))
    assert pairs(changes, "path", "action") == [("d/b", "set")]
    assert conflicts.count() == 0


def test_merge_ignores_times_of_equal_additions(spark):
    base, ours, theirs = tree(spark, k="1"), tree(spark, k="1", c=("File", "t", 420, 1, 5)), tree(spark, k="1", c=("File", "t", 420, 1, 9))
    assert [x.count() for x in M.merge(base, ours, theirs)] == [0, 0]


def test_merge_conflict_kinds(spark):
    base = tree(spark, a="1", b="1", c="1", e="1")
    ours = tree(spark, a="2", c=DIR(), e="1")
    theirs = tree(spark, a="3", b="2", c="2")
    changes, conflicts = M.merge(base, ours, theirs)
    assert pairs(conflicts, "path", "kind") == [("a", "modify_modify"), ("b", "delete_modify"), ("c", "type")]
    assert pairs(changes, "path", "action") == [("e", "remove")]


def test_merge_sees_changes_below_a_removed_directory_also_behind_a_sibling(spark):
    base = tree(spark, **{"d": DIR(), "d__old": "1", "d-x": "1"})
    theirs = tree(spark, **{"d": DIR(), "d__old": "1", "d__new": "1", "d-x": "2"})
    ours = tree(spark, **{"d-x": "1"})
    changes, conflicts = M.merge(base, ours, theirs)
    assert ("d", "ancestor") in pairs(conflicts, "path", "kind")
    assert pairs(changes, "path", "action") == [("d-x", "set")]


def test_diff_leaves_out_directories_that_differ_in_target_alone(spark):
    d = D.diff(tree(spark, d=DIR("1"), d__a="1"), tree(spark, d=DIR("2"), d__a="2"))
    assert pairs(d, "path", "action") == [("d/a", "modify")]
    assert D.diff(tree(spark, a="1"), tree(spark, a="1").limit(0)).collect()[0].action == "delete"


def test_retention_of_half_a_year(spark):
    now = 200 * 86400
    log = spark.range(721).select(F.lit(1).alias("workspace"), (F.col("id") + 1).alias("sequence"), (F.lit(now) - (720 - F.col("id")) * 21600).alias("sealed_at"))
    none = log.select("workspace", "sequence").limit(0)
    kept = T.retained(log, none, now)
    assert kept.count() < 300
    assert kept.where(F.col("sealed_at") >= now - 86400).count() == 5
    assert kept.where("sequence = 721").count() == 1
    assert T.retained(log, log.where("sequence = 1").select("workspace", "sequence"), now).where("sequence = 1").count() == 1
    assert T.retained(log.limit(0), none, now).count() == 0


def test_ranges_are_islands(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 9, 10)], "workspace int, sequence long")
    assert pairs(T.ranges(df), "first", "last", "n") == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]


def test_blocks_of_a_log_change_nothing(spark, monkeypatch):
    """Runs, predecessors, sums and bisection of one large key over many blocks, against plain loops."""
    monkeypatch.setattr(T, "BLOCK_BITS", 2)
    monkeypatch.setattr(G, "BLOCK_BITS", 2)
    rng = random.Random(4)
    logs = {1: sorted(rng.sample(range(-9, 90), 60)), 2: list(range(40)), 3: [5]}
    rows = [(w, s, rng.randrange(3)) for w, ss in logs.items() for s in ss]
    df = spark.createDataFrame(rows, "workspace int, sequence long, v long")
    runs, before, sums = [], [], []
    for w, ss in logs.items():
        v = {s: x for ww, s, x in rows if ww == w}
        for i, s in enumerate(ss):
            if i and ss[i - 1] == s - 1:
                runs[-1][2:] = [s, runs[-1][3] + 1]
            else:
                runs.append([w, s, s, 1])
            before.append((w, s, v[ss[i - 1]] if i else -1))
            sums.append((w, s, sum(v[x] for x in ss[: i + 1])))
    assert pairs(T.ranges(df), "workspace", "first", "last", "n") == sorted(map(tuple, runs))
    assert pairs(T.with_previous(df, ["workspace"], "sequence", {"b": "v"}).fillna(-1), "workspace", "sequence", "b") == sorted(before)
    assert pairs(T.running_sum(df, ["workspace"], "sequence", "v", "s"), "workspace", "sequence", "s") == sorted(sums)
    checks = [(1, s, s < 21 and s != 13) for s in range(40)] + [(2, s, True) for s in range(9)] + [(3, s, False) for s in range(6)]
    b = G.bisect(spark.createDataFrame(checks, "workspace int, sequence long, good boolean")).fillna(-1)
    assert pairs(b, "workspace", "last_good", "first_bad") == [(1, 12, 13), (2, 8, -1), (3, -1, 0)]


def test_reach_and_marks(spark):
    edges = spark.createDataFrame([("s", "t", 1), ("t", "b", 1), ("b", "c", 128), ("t", "x", 1), ("o", "y", 1), ("c", "t", 1)], "src string, dst string, class_bit int")
    roots = spark.createDataFrame([("s", 1)], "node string, mask int")
    assert pairs(G.reach(roots, edges), "node", "depth") == [("b", 2), ("c", 3), ("s", 0), ("t", 1), ("x", 2)]
    assert pairs(G.marks(roots, edges), "node", "mask") == [("b", 1), ("s", 1), ("t", 1), ("x", 1)]
    both = spark.createDataFrame([("s", 1), ("b", 128)], "node string, mask int")
    assert ("c", 129) in pairs(G.marks(both, edges), "node", "mask")


def test_bisect_search_asks_few(spark):
    asked = []
    assert G.bisect_search(list(range(100)), lambda s: asked.append(s) or s < 63) == 63
    assert len(asked) <= 8
    assert G.bisect_search([1, 2], lambda s: True) is None


def test_content_chunks_are_bounded_and_whole(spark):
    data = bytes(n % 251 for n in range(3 * 4096 + 17))
    noise = random.Random(1).randbytes(60_000)
    for x in (data, noise, b"", b"a"):
        ends = C.boundaries(x, 256, 1024, 4096)
        assert (ends[-1] if ends else 0) == len(x)
        assert all(b - a <= 4096 for a, b in zip([0, *ends], ends, strict=False))
    cut = lambda x: {x[a:b] for a, b in zip([0, *C.boundaries(x, 256, 1024, 4096)], C.boundaries(x, 256, 1024, 4096), strict=False)}
    before, after = cut(noise), cut(noise[:100] + b"!" + noise[100:])
    assert len(before & after) >= len(before) - 3  # boundaries find back
    df = spark.createDataFrame([(1, bytearray(noise)), (2, None)], "blob long, content binary")
    assert C.content_chunks(df, 256, 1024, 4096).agg(F.sum("len")).first()[0] == len(noise)


def test_radar_life_cycle(spark):
    scopes = lambda rows: spark.createDataFrame(rows, "fork long, head long, path string, scope int")
    claims = spark.createDataFrame([("src/**", 1)], "pattern string, workspace int")
    apart = R.conflicts(scopes([(1, 5, "src/alpha.rs", 0), (2, 6, "src/beta.rs", 0)]), claims)
    assert apart.count() == 0
    whole = R.conflicts(scopes([(1, 7, "src", 1), (2, 6, "src/beta.rs", 0)]), claims)
    assert pairs(whole, "path", "claim_state", "forks") == [("src", "unclaimed", 2)]
    one = R.conflicts(scopes([(1, 7, "src/a", 0), (2, 6, "src/a", 0), (3, 8, "src/a", 0)]), claims)
    assert pairs(one, "path", "signature", "claim_state") == [("src/a", "1@7,2@6,3@8", "covered")]
    opened = R.events(apart, one, "f")
    assert pairs(opened, "path", "state") == [("src/a", "opened")]
    assert R.events(apart, one, "f", opened).count() == 0
    assert pairs(R.events(one, apart, "f"), "state") == [("resolved",)]


def test_radar_members_agree_with_pairs(spark):
    rng = random.Random(2)
    names = ["a", "a-x", "b"]
    rows = {(rng.randint(1, 4), 1, "/".join(rng.choice(names) for _ in range(rng.randint(1, 4))), rng.randint(0, 1)) for _ in range(60)}
    s = spark.createDataFrame(sorted(rows), "fork long, head long, path string, scope int")
    plain = set()
    for f1, _, p1, s1 in rows:
        for f2, _, p2, s2 in rows:
            under = lambda p, q: p == q or p.startswith(q + "/")
            if f1 < f2 and (not s1 and not s2 and p1 == p2 or s1 and under(p2, p1) or s2 and under(p1, p2)):
                plain.add((p1 if s1 else p2 if s2 else p1, f1, f2))
    assert set(pairs(R.pairs(s), "path", "left_id", "right_id")) == plain
    top = {p for p, *_ in plain if not any(p.startswith(q + "/") for q, *_ in plain)}
    assert set(pairs(R.members(s), "path", "fork")) == {(p, f) for p, a, b in plain if p in top for f in (a, b)}


def _most(spark, act):
    """The most rows that a step of any plan made, and the records shuffled, while ``act`` ran."""
    plans, store = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: (lambda s: [s.apply(i) for i in range(s.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()))
    runs = lambda: (lambda s: {s.apply(i).executionId() for i in range(s.size())})(plans.executionsList())
    known, before = runs(), {s.stageId() for s in stages()}
    act()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for run in runs() - known:
        values, nodes = plans.executionMetrics(run), plans.planGraph(run).allNodes()
        for metrics in (nodes.apply(i).metrics() for i in range(nodes.size())):
            for m in (metrics.apply(i) for i in range(metrics.size())):
                value = values.get(m.accumulatorId())
                if m.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most, sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)


def _crowd(spark, forks):
    """Every fork changes one path, has a path of its own in a directory, and a third of them all of the directory."""
    rows = [(f, 1, p, s) for f in range(forks) for p, s in [("one/path", 0), (f"d/{f}", 0), *([("d", 1)] if f % 3 == 0 else [])]]
    return spark.createDataFrame(rows, "fork long, head long, path string, scope int")


def test_radar_pairs_are_not_shuffled(spark):
    s, got = _crowd(spark, 300), []
    _, shuffled = _most(spark, lambda: got.extend(map(tuple, R.pairs(s).collect())))
    n = range(300)
    want = {("one/path", a, b) for a in n for b in n if a < b} | {("d", min(a, b), max(a, b)) for a in n if a % 3 == 0 for b in n if a != b}
    assert len(got) == len(want) == len(set(got)) and set(got) == want
    assert shuffled < 20_000 < len(want)


@pytest.mark.parametrize("block", [1, 3, 50])
def test_radar_pairs_in_blocks(spark, monkeypatch, block):
    s = _crowd(spark, 20).unionByName(spark.createDataFrame([(f, 1, p, c) for f in (1, 5, 30) for p, c in (("d/5", 1), ("d/5/x", 1), ("d", 0))], "fork long, head long, path string, scope int"))
    want = sorted(map(tuple, R.pairs(s).collect()))
    monkeypatch.setattr(R, "BLOCK", block)
    assert sorted(map(tuple, R.pairs(s).collect())) == want


def test_radar_members_make_no_pairs(spark):
    s, got = _crowd(spark, 600), []
    most, _ = _most(spark, lambda: got.extend(map(tuple, R.members(s).collect())))
    assert sorted(got) == sorted([("one/path", f) for f in range(600)] + [("d", f) for f in range(600)])
    assert most < 10_000  # a third of the forks and all of them are 120,000 pairs


def test_radar_events_make_no_pairs(spark):
    old, new = _crowd(spark, 500), _crowd(spark, 600)
    claims, got = spark.createDataFrame([("one/**", 1)], "pattern string, workspace int"), []
    most, _ = _most(spark, lambda: got.extend(pairs(R.events(R.conflicts(old, claims), R.conflicts(new, claims), "f"), "path", "state", "claim_state")))
    assert got == [("d", "updated", "unclaimed"), ("one/path", "updated", "covered")]
    assert most < 10_000


def test_radar_copies_no_scopes_to_all_tasks(spark):
    """Scopes take few bytes in files; a join copies the paths that they are led to, and not the scopes."""
    plans = spark._jsparkSession.sharedState().statusStore()
    runs = lambda: (lambda s: {s.apply(i).executionId() for i in range(s.size())})(plans.executionsList())
    known, got = runs(), []
    s = spark.range(4000).selectExpr("id AS fork", "id AS head", "concat('d/', id % 7) AS path", "0 AS scope")
    claims = spark.createDataFrame([("d/**", 1)], "pattern string, workspace int")
    got.extend(pairs(R.conflicts(s, claims), "path", "forks", "claim_state"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    copied = []
    for run in runs() - known:
        values, nodes = plans.executionMetrics(run), plans.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                found = [values.get(m.accumulatorId()) for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if m.name() == "number of output rows"]
                copied.extend(int(v.get().replace(",", "")) for v in found if v.isDefined())
    assert got == [(f"d/{i}", 4000 // 7 + (i < 4000 % 7), "covered") for i in range(7)]
    assert copied and max(copied) < 100


def test_radar_conflicts_of_states_in_one_pass(spark):
    """States told together are those told alone, with null forks and heads, several heads of a fork, and paths that are empty or begin with a slash."""
    rng = random.Random(5)
    names = ["", "a", "b", "a-x"]
    rows = {(rng.choice([0, 1]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 7, 8]), "/".join(rng.choice(names) for _ in range(rng.randint(1, 3))), rng.randint(0, 1)) for _ in range(60)}
    claims = spark.createDataFrame([("a/**", 1), ("**", 2)], "pattern string, workspace int")
    columns = ("path", "signature", "claim_state", "forks")
    for rows in (rows, {(p, f, f and f + 10 * p, path, c) for p, f, _, path, c in rows}):
        s = spark.createDataFrame([*rows, (0, 1, 5, None, 0)], "phase int, fork long, head long, path string, scope int")
        both = R.conflicts(s, claims, "phase")
        for phase in (0, 1):
            t = s.where(f"phase = {phase}").drop("phase")
            alone = pairs(R.conflicts(t, claims), *columns)
            assert pairs(both.where(f"phase = {phase}"), *columns) == alone != []
            heads = {}
            for r in t.collect():
                heads.setdefault(r.fork, set()).add((r.head is not None, r.head or 0))
            told = {}
            for path, fork in pairs(R.members(t).where("fork IS NOT NULL"), "path", "fork"):
                told.setdefault(path, []).extend(f"{fork}@{h}" if given else str(fork) for given, h in sorted(heads[fork]))
            assert [(p, sig, n) for p, sig, _, n in alone] == [(p, ",".join(told[p]), len(told[p])) for p in sorted(told)]


def test_scopes_of_both_phases_from_one_read(spark):
    from chronolith.plans.model import dirty_scopes, dirty_scopes_by_phase

    both, columns = dirty_scopes_by_phase(spark, "/root/testdata/sf0.001"), ("fork", "head", "path", "scope")
    for phase in (0, 1):
        assert pairs(both.where(f"phase = {phase}"), *columns) == pairs(dirty_scopes(spark, "/root/testdata/sf0.001", phase), *columns) != []


def test_updates_after_cursors(spark):
    log = spark.createDataFrame([(i, f"s{i}") for i in range(1, 9)], "sequence long, snapshot_id string")
    assert pairs(L.updates_after(log, "s3", 2), "sequence", "cursor_found") == [(4, True), (5, True)]
    assert pairs(L.updates_after(log, "?", 2), "sequence", "cursor_found") == [(7, False), (8, False)]
    assert pairs(L.updates_after(log, None, 2), "sequence") == [(8,)]


def test_packs_keep_whole_records_of_a_torn_file(spark, tmp_path):
    whole = S.pack_records([(1, b"abc"), (2, b""), (3, b"x" * 1000)])
    (tmp_path / "a.pack").write_bytes(whole[:-5])
    (tmp_path / "b.pack").write_bytes(whole)
    r = S.recover_packs(spark, str(tmp_path))
    assert pairs(r.groupBy("pack").agg(F.count("offset").alias("n")), "pack", "n") == [("a.pack", 2), ("b.pack", 3)]


def test_policy_and_capture(spark, tmp_path):
    (tmp_path / "policy").write_text("# rules\nexclude cache\nexclude cache/\n\nexclude /abs\nkeep x\n")
    rules = S.policy_rules(spark, str(tmp_path / "policy"))
    assert sorted(r.path for r in rules.where("path IS NOT NULL").collect()) == ["cache"]
    assert rules.where("invalid IS NOT NULL").count() == 2
    (tmp_path / "tree" / "sub").mkdir(parents=True)
    (tmp_path / "tree" / "sub" / "id_rsa").write_text("T=1\n")
    (tmp_path / "tree" / "d.bin").write_bytes(S.SQLITE_MAGIC + b"..")
    assert pairs(S.capture(spark, str(tmp_path / "tree")), "path", "class", "is_sqlite") == [("d.bin", "source", True), ("sub/id_rsa", "config-secret", False)]


def test_ndjson_keeps_corrupt_lines_apart(spark, tmp_path):
    S.write_ndjson(spark.createDataFrame([(1, "a"), (2, None)], "n long, s string"), str(tmp_path / "o"))
    (tmp_path / "o" / "extra.json").write_text("{broken\n")
    r = S.read_ndjson(spark, str(tmp_path / "o"), "n long, s string")
    assert r.where("_corrupt IS NULL").count() == 2
    assert r.cache().where("_corrupt IS NOT NULL").count() == 1


def test_conflict_states_do_not_depend_on_the_number_of_files(spark, tmp_path):
    from chronolith.streaming import radar

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    e.coalesce(1).write.parquet(f"{one}/events.parquet")
    e.repartition(70, "event_id").write.parquet(f"{many}/events.parquet")
    assert len(list((tmp_path / "many" / "events.parquet").glob("*.parquet"))) > 64
    states = [sorted(map(tuple, radar.conflict_states(spark, d).collect())) for d in (one, many)]
    assert states[0] == states[1] and states[0]


def test_conflict_states_over_batches(spark):
    """One batch of all rows, or two with the state between them, tell the same changes."""
    from chronolith.streaming import radar

    rng = random.Random(8)
    rows = [(i % 3, rng.randrange(4), i, rng.choice(["purchase", "view", "click"])) for i in range(120)]
    schema = "k int, workspace long, sequence long, kind string"
    df, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], "k int, workspace long")
    changed, left = radar.transitions(df, none)
    one, between = radar.transitions(df.where("sequence < 50"), none)
    two, after = radar.transitions(df.where("sequence >= 50"), between)
    columns = ("k", "sequence", "state", "forks")
    assert pairs(changed, *columns) == pairs(one.unionByName(two), *columns) != []
    assert pairs(left, "k", "workspace") == pairs(after, "k", "workspace")


CLAIM = "id long, pattern string, owner string, workspace long, created_at long, expires_at long"


def test_claims_meet_whom_they_overlap(spark):
    """Verdicts on every pair of a pattern and a claim, against the rule spelled out."""
    from chronolith.operators import claims

    patterns = ["a/b", "a/b/c", "a/*", "a/b/*.py", "*/b", "**", "a", "b/c", "a/bc/*", "a/[bc]"]
    lead = lambda p: p.split("/")[: next((i for i, c in enumerate(p.split("/")) if set(c) & set("*?[")), len(p.split("/")))]

    def meet(p, q):
        if not set(p + q) & set("*?["):
            return p == q
        n = min(len(lead(p)), len(lead(q)))
        return lead(p)[:n] == lead(q)[:n]

    held = [(i, p, f"o{i % 3}", i % 2, 100 - i, 1000) for i, p in enumerate(patterns)]
    asks = [(p, f"o{o}", w, 60) for p in patterns for o in range(3) for w in range(2)]
    got = {(r.pattern, r.owner, r.workspace): (r.verdict, r.claim_id) for r in claims.verdicts(spark.createDataFrame(asks, "pattern string, owner string, workspace long, ttl long"), spark.createDataFrame(held, CLAIM), 500).collect()}
    for p, o, w, _ in asks:
        own = [h for h in held if h[1:4] == (p, o, w)]
        block = sorted((h[4], h[0]) for h in held if h[2:4] != (o, w) and meet(p, h[1]))
        want = ("held", own[0][0]) if own else ("blocked", block[0][1]) if block else ("granted", None)
        assert got[p, o, w] == want, (p, o, w)


def test_claims_run_out_and_come_back(spark):
    from chronolith.operators import claims

    held = spark.createDataFrame([(1, "a/*", "me", 1, 0, 10), (2, "b", "me", 1, 0, 99), (3, "b", "you", 1, 0, 99)], CLAIM)
    asks = spark.createDataFrame([("a/x", "you", 2, 60), ("b", "me", 1, 60), ("c", "me", 1, 0), ("/c", "me", 1, 9), (None, "me", 1, 9)], "pattern string, owner string, workspace long, ttl long")
    assert pairs(claims.verdicts(asks, held, 10).fillna(-1).fillna("~"), "pattern", "verdict", "claim_id", "expires_at") == [("/c", "invalid", -1, -1), ("a/x", "granted", -1, 70), ("b", "held", 2, 99), ("c", "invalid", -1, -1), ("~", "invalid", -1, -1)]
    gone = claims.released(held, spark.createDataFrame([("b", "me", 1), ("1", "you", 1), ("3", "you", 1)], "selector string, owner string, workspace long"))
    assert pairs(gone, "id") == [(2,), (3,)]
    assert pairs(claims.restored(held.where("id <> 2"), gone.withColumn("owner", F.lit("back"))), "id", "owner") == [(1, "me"), (2, "back"), (3, "back")]
    ask = lambda i, at: ("k", 1, i, at, 10)
    last = L.last_leases(spark.createDataFrame([ask(0, 0), ask(1, 9), ask(2, 10), ask(3, 15), ("j", 2, 4, 1, 1)], "key string, workspace long, sequence long, at long, ttl long"))
    assert pairs(last, "key", "workspace", "expires_at", "begun") == [("j", 2, 2, 1), ("k", 1, 20, 2)]


def test_heads_move_over_batches(spark):
    from chronolith.streaming import follow

    rng = random.Random(5)
    df = spark.createDataFrame([(i % 2, i, rng.choice("ab")) for i in range(60)] + [(7, 99, "z")], "workspace long, sequence long, content string")
    none = spark.createDataFrame([], "workspace long, head string")
    told, heads = follow.moved(df, none)
    one, between = follow.moved(df.where("sequence < 31"), none)
    two, after = follow.moved(df.where("sequence >= 31"), between)
    rows, last, want = sorted(tuple(r) for r in df.collect()), {}, []
    for w, s, c in rows:
        if last.get(w) != c:
            want.append((w, s))
        last[w] = c
    assert pairs(told, "workspace", "sequence") == pairs(one.unionByName(two), "workspace", "sequence") == sorted(want)
    assert pairs(heads, "workspace", "head") == pairs(after, "workspace", "head") == sorted(last.items())
