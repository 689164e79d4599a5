"""Path and value expressions against tables of cases."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions import paths as P
from chronolith.functions import values as V


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def results(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(expression(F.col("v"))).collect()]


def test_classes(spark):
    cases = {
        ".git/config": "vcs-meta", "a/.env": "config-secret", "a/.env.local": "config-secret", "k.pem": "config-secret", "Cargo.lock": "lockfile", "x/a.sqlite-wal": "database",
        "node_modules/x/y.js": "dependency", "lib/my-site-packages/a.py": "dependency", "target/debug/a": "build-output", "a.pyc": "build-output", "tmp/x": "scratch", "n~": "scratch",
        "src/main.rs": "source", "": "source", "node_modules/.git/x": "vcs-meta", "a//b": "source",
    }
    assert results(spark, list(cases), P.classify) == list(cases.values())


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/a/b.rs", False), ("src/**", "src/a/b.rs", True), ("src/?.rs", "src/ab.rs", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False),
        ("[!a]b", "/b", False), ("a[b", "a[b", True), ("a.b", "axb", False), ("**/x", "a/b/x", True),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert results(spark, [path], lambda c: c.rlike(P.glob_to_regex(pattern))) == [hit]
    df = spark.createDataFrame([(pattern, path)], "g string, p string").withColumn("re", P.glob_column(F.col("g")))
    assert df.select(F.expr("p RLIKE re")).first()[0] is hit


def test_globs_of_a_column_match_what_single_patterns_match(spark):
    rng = random.Random(9)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    fixed = ["[!]", "[]", "[", "[^^]", "[!]a]", "[b-a]", "[!b-a]", "[a-]", "[-a]", "[a-c-e]", "[é-ü😀]", "[[]", "[\\]", "a\nb", "{}()|+$^\\E", ""]
    patterns = fixed + [text("ab[]!^-*?/é.", 8) for _ in range(300)]
    cases = [(i, p, text("abc[]!^-/é.\n", 4) if i % 3 else p) for i, p in enumerate(patterns * 3)]
    df = spark.createDataFrame(cases, "i int, g string, p string").withColumn("re", P.glob_column(F.col("g")))
    single = spark.createDataFrame([(i, P.glob_to_regex(p)) for i, p, _ in cases], "i int, single string")
    hits = df.join(single, "i").select("g", "p", F.expr("p RLIKE re").alias("a"), F.expr("p RLIKE single").alias("b")).collect()
    assert len(hits) == len(cases) and sum(r.b for r in hits) > 100
    assert [(r.g, r.p) for r in hits if r.a != r.b] == []
    assert spark.createDataFrame([(None,)], "g string").select(P.glob_column(F.col("g"))).first()[0] is None


def test_overlaps(spark):
    cases = [("src/*.rs", "src/*.md", True), ("src", "src/a", False), ("src/a", "src/a", True), ("src/**", "src/a/b", True), ("a/**", "b/**", False), ("**", "x/y", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", P.may_overlap(F.col("a"), F.col("b"))).collect())


def test_ancestors(spark):
    assert results(spark, ["a/b/c", "a", ""], P.ancestors) == [["a", "a/b"], [], []]
    assert results(spark, ["a/b", "a"], P.self_and_ancestors) == [["a", "a/b"], ["a"]]
    assert results(spark, ["a/b/c", "a"], P.parent_of) == ["a/b", ""]


def test_byte_masks_at_their_bounds(spark):
    now, day = 100 * V.DAY, V.DAY
    ages = [30 * day, 30 * day + 1, 3 * day, 3 * day + 1, day, day + 1, -1]
    kept = 1 + 2 + 4 + 64
    want = [kept + 32, kept, kept + 32 + 24, kept + 32, kept + 32 + 24 + 128, kept + 32 + 24, 255]
    assert results(spark, [now - a for a in ages], lambda c: V.byte_mask(now, c, F.lit(False)), "long") == want


def test_sizes_and_cursors(spark):
    assert results(spark, [0, 1023, 1024, 1536, 5 * 1024**3], V.human_bytes, "long") == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "5.0 GiB"]
    assert results(spark, ["10", "2K", "3 MiB", "1gb", "x", "1.5M", None], V.parse_bytes) == [10, 2048, 3 * 1024**2, 1024**3, None, None, None]
    assert results(spark, ["f:12", "g:12", "f:x", None], lambda c: V.cursor_sequence(c, "f")) == [12, None, None, None]
    assert results(spark, [-7, 7], lambda c: V.bucket(c, 3), "long") == [-3, 2]


def test_glob_agrees_with_a_matcher_of_its_own(spark):
    def match(p, s):
        if not p:
            return not s
        if p.startswith("**"):
            return any(match(p[2:], s[i:]) for i in range(len(s) + 1))
        if p[0] == "*":
            return any(match(p[1:], s[i:]) for i in range(len(s) + 1) if "/" not in s[:i])
        return bool(s) and (s[0] != "/" if p[0] == "?" else s[0] == p[0]) and match(p[1:], s[1:])

    rng = random.Random(4)
    pairs = [("".join(rng.choice("ab/*?.") for _ in range(rng.randint(1, 6))), "".join(rng.choice("ab/.") for _ in range(rng.randint(0, 6)))) for _ in range(400)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, g string, p string").withColumn("re", P.glob_column(F.col("g")))
    for r in df.select("i", F.expr("p RLIKE re").alias("hit")).collect():
        assert r.hit == match(*pairs[r.i]), pairs[r.i]
