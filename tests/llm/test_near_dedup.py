"""Near-duplicates against all pairs of full sets, and the cases that a table may hold."""

import random
import re

import numpy as np
import pytest

from chronolith.llm import near_dedup as N
from chronolith.llm.words import shingle_sets
import pyarrow as pa

SCHEMA = "doc_id long, text string, lang string, component_id string, node long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return {i: (len(x), top(i)) for i, x in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for n in (3, 8, 20, 60, 200):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, 5, 9):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
                texts.append("  ".join(w).upper() if edits == 1 else "\t".join(w))
    texts += [None, "", " \n\t", "One", "one", "ONE two", "é É", "É é"]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_matches_all_pairs(spark):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame([(i, t, None, "x", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in N.near_duplicates(df).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_crowded_buckets_are_compared_in_blocks(spark, monkeypatch):
    """One text in many variants: links that don't touch the hub are found, in several blocks and several stars."""
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "STAR", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_ties_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "z y x w v u"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted(r.component_id for r in got if r.doc_id in (1, 2, 3)) == [1, 1, 1, 1, 3]  # each row of 3 by its own text
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in N.keep_first(df).collect()) == [(False, 1, "a b c d e f"), (False, 3, "a b c d e f"), (False, 4, ""), (True, 0, "a b c d e f")]


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_and_sketch_estimates():
    rng = random.Random(8)
    words = [f"t{rng.randrange(10**6)}" for _ in range(200_000)]
    a = " ".join(words)
    b = " ".join(words[:180_000] + [f"u{i}" for i in range(20_000)])
    (_, x, _), (_, y, _) = shingle_sets(pa.array([a, b]))
    assert len(x) == len(shingles(a))
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    level = N.levels(np.array([len(x), len(y)]))
    assert N.estimate(N.sketch(x), N.sketch(y), level[0], level[1]) == pytest.approx(exact, abs=0.12)
    assert N.linked(x, y, 75) == (exact >= 0.75)
