"""Language identification: nearest of several centroids per language, by cosine of TF-IDF byte-trigram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .scratch import materialize

DIMENSIONS = 8192  # hashed trigrams
CENTROIDS, ITERATIONS = 4, 10
SAMPLE = 400  # training texts a language that the clusters are fitted on, about; document frequencies come from all of them
REJECT_QUANTILE, SHARPNESS = 0.005, 25.0
UNDETERMINED = "und"
_CHUNK = 1 << 20  # bytes that are mapped at a time; trigrams run on across

_MAP = np.full(256, 0x20, dtype=np.uint8)  # what is no letter becomes a space; bytes beyond ASCII stay
_MAP[0x80:] = np.arange(0x80, 0x100)
_MAP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True


def counts(data: np.ndarray) -> np.ndarray:
    """Trigram counts of one text in UTF-8, by hash; runs of other characters than letters count as one space, and a space stands at both ends."""
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    last = np.full(1, 0x20, dtype=np.uint8)  # the last two characters so far, or fewer
    for at in range(0, len(data) + 1, _CHUNK):
        part = _MAP[data[at : at + _CHUNK]]
        x = np.concatenate((last, part) if at + _CHUNK <= len(data) else (last, part, [0x20])).astype(np.uint32)
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
        x = x[keep]
        code = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(32 - 13), minlength=DIMENSIONS)
        last = x[-2:].astype(np.uint8)
    return out


def _text_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, counts, whether the text has a letter) for each row."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    buf = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    for r in range(len(column)):
        text = data[offsets[r] : offsets[r + 1]]
        letter = bool(_ASCII_LETTER[text].any()) or any(map(str.isalpha, column[r].as_py()))
        yield r, counts(text), letter


@dataclass(frozen=True)
class Centroids:
    """Weights of the dimensions, centroids of all languages as columns, and for each its language and least usual similarity."""

    idf: np.ndarray
    matrix: np.ndarray
    owner: np.ndarray
    languages: list[str]
    floor: np.ndarray

    def vectors(self, c: np.ndarray) -> np.ndarray:
        x = np.log1p(c) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def predict(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For rows of counts: language index, score, best cosine, whether that is further off than training texts are."""
        cosine = self.vectors(c) @ self.matrix
        best = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        pick = best.argmax(axis=1)
        top = best[np.arange(len(best)), pick]
        score = 1.0 / np.exp(SHARPNESS * (best - top[:, None])).sum(axis=1)
        return pick, score, top, top < self.floor[pick]


def cluster(x: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means from farthest first starts; as many as there are distinct ones at most."""
    start = [x[(x @ x.mean(axis=0)).argmax()]]
    while len(start) < min(k, len(x)):
        near = np.max(x @ np.array(start).T, axis=1)
        if near.min() > 1 - 1e-9:
            break
        start.append(x[near.argmin()])
    c = np.array(start)
    for _ in range(ITERATIONS):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _training_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, chosen) of training rows to counts of chosen texts, and at the end document frequencies of all of the task's."""
    df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        lang, vectors = [], []
        chosen = batch.column(2).to_pylist()
        for r, c, letter in _text_counts(batch.column(1)):
            if letter:
                df += c > 0
                n += 1
                if chosen[r]:
                    lang.append(batch.column(0)[r].as_py())
                    vectors.append(c.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(vectors, pa.binary()), pa.nulls(len(lang), pa.list_(pa.int64())), pa.nulls(len(lang), pa.int64())], names=["lang", "counts", "df", "n"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], names=["lang", "counts", "df", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Centroids | None:
    """Fits on documents with a language outside the held-out fold; None if there are none.

    Document frequencies cover every one of them.  Clusters are fitted on about
    ``sample`` texts a language, those of least id hash, a language in a task; their centroids come to the driver.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / n)))))
    chosen = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    found = materialize(rows.select("lang", "text", chosen.alias("chosen")).mapInArrow(_training_batches, "lang string, counts binary, df array<long>, n long"), "language-training")
    df, total = np.zeros(DIMENSIONS), found.agg(F.sum("n")).first()[0] or 0
    for r in found.where("df IS NOT NULL").select(F.posexplode("df").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r.i] = r.n
    idf = np.log((1.0 + total) / (1.0 + df)) + 0.1
    base = Centroids(idf, np.zeros((0, 0)), np.zeros(0), [], np.zeros(0))

    def clustered(pdf: pd.DataFrame) -> pd.DataFrame:
        """The sample of one language, about ``sample`` rows, to its centroids and its least usual similarity."""
        x = base.vectors(np.array([np.frombuffer(c, dtype="<i4") for c in sorted(pdf["counts"])]))
        c = cluster(x)
        floor = float(np.quantile((x @ c.T).max(axis=1), REJECT_QUANTILE))
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1].tolist(), "centroids": [c.astype("<f4").tobytes()], "floor": [floor]})

    sampled = found.where("counts IS NOT NULL").select("lang", "counts")
    fitted = sampled.groupBy("lang").applyInPandas(clustered, "lang string, centroids binary, floor double")
    rows_ = sorted(fitted.collect(), key=lambda r: r.lang)  # a few centroids for each language
    if not rows_:
        return None
    matrices = [np.frombuffer(r.centroids, dtype="<f4").reshape(-1, DIMENSIONS) for r in rows_]
    owner = np.repeat(np.arange(len(rows_)), [len(m) for m in matrices])
    return Centroids(idf.astype(np.float32), np.vstack(matrices).T.copy(), owner, [r.lang for r in rows_], np.array([r.floor for r in rows_]))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` to doc_id, held_out, lang_pred, score, similarity, rejected, a row for each row.

    Learns from text and non-null lang outside the held-out fold (checksum of the
    id modulo 4 is 2).  ``lang_pred`` is ``und`` with score 0 for a null text, one without a
    letter, and where nothing could be learned.  ``score`` weighs the nearest centroid of the
    language against those of the others; ``rejected`` marks texts that are
    further from it than all but a few training texts.  Rows without an id are predicted too.
    Repeated rows are predicted alike, texts of any length are counted whole, an empty table gives no rows,
    and other columns of ``docs`` are ignored.
    """
    model = train(docs, sample)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            lang, score, near, far = [UNDETERMINED] * n, np.zeros(n), np.zeros(n), np.ones(n, dtype=bool)
            held: list[tuple[int, np.ndarray]] = []

            def flush(held: list = held, lang: list = lang, score: np.ndarray = score, near: np.ndarray = near, far: np.ndarray = far) -> None:
                if held:
                    at = np.array([r for r, _ in held])
                    pick, score[at], near[at], far[at] = model.predict(np.array([c for _, c in held], dtype=np.float32))
                    for r, k in zip(at.tolist(), pick.tolist(), strict=True):
                        lang[r] = model.languages[k]
                    held.clear()

            if model:
                for r, c, letter in _text_counts(batch.column(1)):
                    if letter:
                        held.append((r, c))
                    if len(held) == 256:
                        flush()
                flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score), pa.array(near), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "similarity", "rejected"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double, similarity double, rejected boolean")
