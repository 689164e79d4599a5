"""Document quality by regularised quadratic discriminant analysis on transformed text statistics.

Statistics come from bytes and word hashes of the whole text, without Python
objects for words.  Class means and covariances are sums over every labelled
document; covariances are shrunk towards the pooled one and towards their
diagonal, factored once (Cholesky), and a score is the logistic of the
difference of the two Mahalanobis log-densities plus the log prior ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keyed_side, materialize
from .words import shingle_hashes, word_hashes

FEATURES = (
    "word_length", "upper", "symbols", "digits", "stops", "non_ascii", "distinct_words",
    "top_word", "adjacent_repeats", "repeated_shingles", "line_length", "bare_words", "letters",
)
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.1
THRESHOLD = 0.7
TRAIN = "held_out = false"

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digits": b"0123456789",
    "stops": b".,;:?'\"()-",
    "space": b" \t\n\r\x0b\x0c",
    "line": b"\n",
}
_names = [*_CLASSES, "high", "continuation", "symbols"]
_LUT = np.zeros((len(_names), 256), dtype=np.uint8)
for _i, _b in enumerate(_CLASSES.values()):
    _LUT[_i, list(_b)] = 1
_LUT[_names.index("high"), 0xC0:] = 1
_LUT[_names.index("continuation"), 0x80:0xC0] = 1
_LUT[_names.index("symbols"), [c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in _CLASSES["stops"]]] = 1


#: Pseudo-cases, and the usual value that they hold: what a short text does not tell is taken to be usual.
DRAW = 15
USUAL = {
    "upper": 0.03, "symbols": 0.005, "digits": 0.01, "stops": 0.03, "high": 0.04, "top_word": 0.06,
    "adjacent": 0.01, "repeated": 0.03, "bare_words": 0.01, "letters": 0.95, "word_length": 5.0, "line_words": 40.0,
}


def _logit(cases: np.ndarray, of: np.ndarray, usual: float, draw: float = DRAW) -> np.ndarray:
    """Log odds of a share, drawn towards its usual value; a share is known no better than 400 cases tell."""
    scale = np.minimum(of, 400.0) / np.maximum(of, 1.0)
    x = (np.clip(cases, 0, of) * scale + draw * usual) / (of * scale + draw)
    return np.log(x / (1 - x))


def features(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1] if rows else np.zeros(1, dtype=np.int64)
    buf = column.buffers()[2] if rows else None
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    count = np.zeros((len(_names), rows))
    words, distinct, top, adjacent, shingles, fresh = (np.zeros(rows) for _ in range(6))
    for first, last, h, n in word_hashes(column):
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi > lo:
            filled = np.flatnonzero(offsets[first + 1 : last + 1] > offsets[first:last])
            at = offsets[first:last][filled] - lo
            for k in range(len(_names)):
                count[k, first + filled] = np.add.reduceat(_LUT[k][data[lo:hi]], at, dtype=np.int64)
        words[first:last] = n
        end = 0
        for r, m in enumerate(n.tolist(), first):
            w, end = h[end : end + m], end + m
            if not m:
                continue
            s = np.sort(w)
            starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            distinct[r], top[r] = len(starts) - 1, np.diff(starts).max()
            adjacent[r] = np.count_nonzero(w[1:] == w[:-1])
            g = np.sort(shingle_hashes(w, 5))
            shingles[r], fresh[r] = len(g), 1 + np.count_nonzero(g[1:] != g[:-1])
    c = dict(zip(_names, count, strict=True))
    solid = np.maximum(np.diff(offsets) - c["continuation"] - c["space"], 0.0)
    letters = c["upper"] + c["lower"] + c["high"]
    u, many = USUAL, DRAW * 5  # as many characters as DRAW words have
    return np.column_stack([
        np.log((solid + DRAW * u["word_length"]) / (words + DRAW)),
        _logit(c["upper"], c["upper"] + c["lower"], u["upper"], many),
        _logit(c["symbols"], solid, u["symbols"], many),
        _logit(c["digits"], solid, u["digits"], many),
        _logit(c["stops"], solid, u["stops"], many),
        _logit(c["high"], solid, u["high"], many),
        np.log((distinct + DRAW) / (words + DRAW) ** 0.75),
        _logit(top - 1, words, u["top_word"]),
        _logit(adjacent, words, u["adjacent"]),
        _logit(shingles - fresh, shingles, u["repeated"]),
        np.log((words + u["line_words"]) / (c["line"] + 1)),
        _logit(c["symbols"], words, u["bare_words"]),
        _logit(letters, solid, u["letters"], many),
    ])


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log prior ratio."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    prior: float
    low: np.ndarray
    high: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        d = [-0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) - 0.5 * self.log_det[k] for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(d[1] - d[0] + self.prior, -40, 40)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray) -> Discriminant | None:
    """From each class's count, sum and sum of outer products; None if a class is missing."""
    if any(moments.get(k, (0,))[0] < 2 for k in (0, 1)):
        return None
    n = np.array([moments[k][0] for k in (0, 1)])
    mean = np.array([moments[k][1] / moments[k][0] for k in (0, 1)])
    scatter = [moments[k][2] - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = sum(scatter) / max(n.sum() - 2, 1)
    factors, dets = [], []
    for k in (0, 1):
        own = (1 - SHRINK_POOLED) * scatter[k] / max(n[k] - 1, 1) + SHRINK_POOLED * pooled
        own = (1 - SHRINK_DIAGONAL) * own + SHRINK_DIAGONAL * np.diag(np.diag(own)) + 1e-3 * np.eye(len(own))
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(mean, np.array(factors), np.array(dets), float(np.log(n[1] / n[0])), low, high)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = features(batch.column(1))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["doc_id", "features"])


def held_out(doc_id: Column) -> Column:
    """True for every fourth document, by the checksum of its id; these are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def document_features(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text").mapInArrow(_feature_batches, "doc_id long, features array<double>")
    return rows.withColumn("held_out", held_out(F.col("doc_id")))


def train(rows: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fits on every labelled row of ``rows(doc_id, features, held_out)`` outside the held-out fold: sums only come to the driver."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = rows.where(TRAIN).join(known, "doc_id")
    d = len(FEATURES)
    f = [F.col("features")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(f)] + [F.sum(f[i] * f[j]).alias(f"p{i}_{j}") for i, j in pairs]
    bounds = [F.min(x).alias(f"lo{i}") for i, x in enumerate(f)] + [F.max(x).alias(f"hi{i}") for i, x in enumerate(f)]
    moments, low, high = {}, np.full(d, np.inf), np.full(d, -np.inf)
    for r in rows.groupBy("quality").agg(F.count("*").alias("n"), *sums, *bounds).collect():
        outer = np.zeros((d, d))
        for i, j in pairs:
            outer[i, j] = outer[j, i] = r[f"p{i}_{j}"]
        moments[r.quality] = float(r.n), np.array([r[f"s{i}"] for i in range(d)]), outer
        low = np.minimum(low, [r[f"lo{i}"] for i in range(d)])
        high = np.maximum(high, [r[f"hi{i}"] for i in range(d)])
    return fit(moments, low, high)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``labels(doc_id, quality, ...)`` to doc_id, held_out, score, predicted, a row for each row.

    Labels of held-out documents (checksum of the id modulo 4 is 2) are not used.
    Null and empty texts get a score like any other.  Without labels of both
    classes every score is 0.5.  A row without a doc_id is scored and never learned from.
    """
    rows = materialize(document_features(docs), "features")
    model = train(rows, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").combine_chunks() if isinstance(b.column("features"), pa.ChunkedArray) else b.column("features")
            s = _scores(model, np.asarray(x.flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def _scores(model: Discriminant | None, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), 0.5) if model is None else model.scores(x)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, with all their columns; texts stay where they are, none is shuffled.

    Features of labelled documents alone are computed to learn from.  With no
    labels, or of one class only, nothing can be told apart and every row stays.
    Null and empty texts are scored as empty; equal rows stay or go together.
    """
    known = materialize(labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id").distinct(), "labelled")
    labelled = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(keyed_side(known), "doc_id", "left_semi")
    model = train(materialize(document_features(labelled), "features"), labels)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(_scores(model, features(pa.Array.from_pandas(text, type=pa.large_string()))))

    return docs.where(score(F.col("text")) >= THRESHOLD)
