"""Every operator and stage on rows that a table may hold: nulls, empty and long texts, repeats, no rows, columns with clashing names; and plain computations beside the fast ones."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from chronolith.llm import fingerprints, language, licences, line_dedup, mixing, near_dedup, ogg, packing, quality, queries
from tests.llm.test_near_dedup import brute
from tests.llm.test_text_operators import brute_lines
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
CLASHING = ("gone", "_rows", "_id", "key", "n_lines", "features", "h", "words", "n", "node", "class", "copies", "kept", "stretch", "spread", "bucket", "target", "taken", "held_out", "score", "rows", "hub", "line", "hash")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} map<string,int>" if c == "gone" else f"{c} string" for c in CLASHING)
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "another text of its own here"), (3, None), (4, ""), (5, " \n\t"), (None, "one two three four five six seven"), (6, LONG), (7, LONG + " end"), (8, "x" * 200_000)]
TOKENS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s", len(t or ""), {"a": 1}, *("x" for _ in CLASHING[1:])) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (2, 0, 0, "x"), (6, 1, 0, "x"), (7, 1, 0, "x"), (8, 0, 0, "x"), (4, 0, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, features string")


ROW_BY_ROW = {
    "near": lambda d, _: near_dedup.near_duplicates(d),
    "quality": quality.score_documents,
    "fingerprints": lambda d, _: fingerprints.fingerprint_documents(d),
    "licences": lambda d, _: licences.document_licences(d),
    "language": lambda d, _: language.identify(d),
    "media": lambda d, _: ogg.media_columns(d),
    "mix": lambda d, _: mixing.mixed_takes(d),
}


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_operators_give_a_row_for_each_row(docs, labels, name):
    got = ROW_BY_ROW[name](docs, labels)
    assert sorted(r.doc_id or -1 for r in got.collect()) == sorted(i or -1 for i, _ in TEXTS)
    assert ROW_BY_ROW[name](docs.limit(0), labels).count() == 0
    assert ROW_BY_ROW[name](docs.limit(0), labels.limit(0)).schema == got.schema


KEEPING = {
    "good": (quality.keep_good, None),
    "first": (lambda d, _: near_dedup.keep_first(d), [-1, 1, 2, 3, 4, 5, 6, 8]),
    "mixed": (lambda d, _: mixing.mixed_documents(d), None),
}


@pytest.mark.parametrize("name", KEEPING)
def test_stages_keep_all_columns(docs, labels, name):
    stage, ids = KEEPING[name]
    got = stage(docs, labels)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r.gone == {"a": 1} and r.hub == "x" for r in rows)
    assert ids is None or sorted(r.doc_id or -1 for r in rows) == ids
    assert stage(docs.limit(0), labels).count() == 0


def test_lines_and_pieces_of_edge_rows(docs):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) and all(r.gone == {"a": 1} for r in rows)
    dropped = {(r.doc_id, r.n_dropped) for r in rows}
    assert {(1, 0), (2, 1), (2, 0), (3, 0), (None, 0), (6, 0), (7, 1)} <= dropped
    pieces = packing.pack(docs, TOKENS).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in TEXTS}
    assert sum(r.piece == 0 for r in pieces) == len(TEXTS)
    assert packing.pack(docs.limit(0), TOKENS).count() == 0


def test_quality_of_labels_of_one_class(spark, docs, labels):
    assert quality.keep_good(docs, labels.where("quality = 1")).count() == len(TEXTS)


def test_near_duplicates_match_sql(spark):
    """All links of whole tables: the recall of the bands against an exact join of shingles."""
    for sf in (SF, "/root/testdata/sf0.01"):
        same(queries.op1_minhash_near_dedup(spark, sf), connect(sf), queries.ORACLES["op1_minhash_near_dedup"])


def test_tiny_sets_are_not_lost_by_the_estimate(spark):
    """Sets of three against four shingles, at exactly 0.75."""
    rng, rows = random.Random(1), []
    for i in range(400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(8)]
        rows += [(2 * i, " ".join(w[:7])), (2 * i + 1, " ".join(w))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").count()
    assert got == 400


def test_stages_against_plain_versions(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.score_documents(raw, labels).where("predicted = 1").collect()}
    kept = corpus_pipeline.quality_stage(spark, raw, SF).cache()
    assert {r.doc_id for r in kept.collect()} == good
    lines = corpus_pipeline.line_stage(spark, kept, SF).cache()
    assert {r.doc_id: r.text for r in lines.collect()} == brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    firsts = corpus_pipeline.near_dedup_stage(spark, lines, SF).cache()
    want = brute([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in firsts.collect()} == {i for i, (_, top) in want.items() if i == top}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = corpus_pipeline.mixing_stage(spark, firsts, SF).cache()
    took = {r.doc_id: r.taken for r in mixing.mixed_takes(firsts).collect()}
    sums = Counter()
    for r in mixed.collect():
        sums[r.doc_id] += count(r.text)
    assert sums == Counter({i: n for i, n in took.items() if n})
    packed = corpus_pipeline.packing_stage(spark, mixed, SF)
    assert packed.where("piece = 0").count() == mixed.count()


def test_densities_by_plain_linear_algebra():
    rng = np.random.default_rng(4)
    x = [rng.normal(k, 1 + k, (200, 3)) @ rng.normal(0, 1, (3, 3)) for k in (0, 1)]
    moments = {k: (200.0, v.sum(axis=0), v.T @ v) for k, v in enumerate(x)}
    far = np.full(3, 1e9)
    model = quality.fit(moments, -far, far)
    pooled = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in x) / 398
    logs = []
    for v in x:
        c = 0.9 * np.cov(v.T) + 0.1 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(3)
        d = np.vstack(x) - v.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(c, d.T).T) - 0.5 * np.linalg.slogdet(c)[1])
    assert model.scores(np.vstack(x)) == pytest.approx(1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40))))


def test_features_by_plain_counting():
    text = "The cat, THE cat cat; sat 12 times é"
    f = dict(zip(quality.FEATURES, quality.features(pa.array([text]))[0], strict=True))
    words = [w.lower() for w in text.split()]
    assert f["distinct_words"] == pytest.approx(np.log((len(set(words)) + 15) / (len(words) + 15) ** 0.75))
    share = lambda cases, of, usual, draw: np.log((x := (cases + draw * usual) / (of + draw)) / (1 - x))
    assert f["top_word"] == pytest.approx(share(Counter(words).most_common(1)[0][1] - 1, len(words), 0.06, 15))
    assert f["adjacent_repeats"] == pytest.approx(share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words), 0.01, 15))
    solid = sum(not c.isspace() for c in text)
    assert f["digits"] == pytest.approx(share(2, solid, 0.01, 75))
    assert f["upper"] == pytest.approx(share(4, sum(c.isascii() and c.isalpha() for c in text), 0.03, 75))


def test_trigrams_and_nearest_centroid_plainly(monkeypatch):
    def plain(text):
        s = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + text.encode().lower().replace(b"\xc3\x89", b"\xc3\x89") + b" ")
        out = np.zeros(language.DIMENSIONS, dtype=np.int64)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            out[(((a << 16 | b << 8 | c) * 2654435761) % 2**32) >> 19] += 1
        return out

    rng = random.Random(3)
    texts = ["", "Ab  c", "...", "été 12 la mer!", "".join(rng.choice("ab é,.\n") for _ in range(5_000))]
    for chunk in (1 << 20, 7, 1):
        monkeypatch.setattr(language, "_CHUNK", chunk)
        for t in texts:
            assert (language.counts(np.frombuffer(t.encode(), dtype=np.uint8)) == plain(t)).all(), (chunk, t[:20])
    x = np.random.default_rng(1).random((4, language.DIMENSIONS))
    c = np.random.default_rng(2).random((3, language.DIMENSIONS))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    model = language.Centroids(np.ones(language.DIMENSIONS), c.T, np.array([0, 0, 1]), ["a", "b"], np.zeros(2))
    pick, _, top, _ = model.predict(x)
    v = np.log1p(x)
    cosine = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ c.T
    assert pick.tolist() == [int(k == 2) for k in cosine.argmax(axis=1)]
    assert top == pytest.approx(cosine.max(axis=1))


def test_likeness_against_exact_overlaps_of_word_runs():
    rng, error = random.Random(9), []
    for _ in range(60):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(3, 400))]
        b = a[: rng.randint(0, len(a))] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 200))]
        runs = [Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) for w in (a, b)]
        if not b:
            continue
        p = fingerprints.fingerprints(pa.array([" ".join(a), " ".join(b)]))
        error.append(fingerprints.likeness(p[0], p[1]) - sum((runs[0] & runs[1]).values()) / sum((runs[0] | runs[1]).values()))
    assert abs(np.mean(error)) < 0.03 and np.std(error) < 0.09


def test_media_features_by_plain_loops():
    rng = random.Random(2)
    for n in (64, 640, 64 * 1500):
        payload = rng.randbytes(n)
        media = ogg.store(payload)
        data, time, pages = ogg.load(media)
        x = [b - 128 for b in data]
        cuts = [k * n // 8 for k in range(9)]
        stretches = ",".join(str(sum(v * v for v in x[a:b]) // (b - a)) for a, b in zip(cuts, cuts[1:], strict=False))
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
        assert time == pytest.approx(n / ogg.RATE)
        assert ogg.features(data, time, pages) == f"seconds={time:.6f};pages={pages};mean={sum(x) * 1000 // n};power={sum(v * v for v in x) // n};crossings={crossings};stretches={stretches}"


def test_a_repeated_page_is_read_once():
    pages = ogg.write_stream([(b"head", 0), (b"x" * 300, 5), (b"y" * 70_000, 9)], 7)
    s = ogg.read(pages[0] + pages[1] + pages[1] + b"".join(pages[2:]))[7]
    assert [len(p) for p, _ in s.packets] == [4, 300, 70_000] and s.lost == 0 and s.ended
