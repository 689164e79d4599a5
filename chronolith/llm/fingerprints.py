"""Document fingerprints by consistent weighted sampling of word-run counts.

A term is a run of ``RUN`` words, its weight the number of times it occurs.  For
each of ``SAMPLES`` samples a term draws r and c from Gamma(2, 1) and beta from
U(0, 1), by its hash; t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta + 1), and the term of least a, with its t, is the
sample.  Two texts draw the same sample with the probability of their
generalised Jaccard similarity, sum of least by sum of greatest weights.

A term's 64 hash bits for a sample give three independent exponential draws e, f
and g: with c = e + f, r = ln(c / e) + g and beta = g / r these are the
distributions above, and a is e at weight 1.  So terms of weight 1 are compared by
their hash bits alone, and heavier ones by ln a in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .words import mix, shingle_hashes, word_hashes

SAMPLES, RUN = 64, 3
PARTITION_ROWS, MOST_PARTITIONS = 4000, 20_000

_rng = np.random.default_rng(5150)
_ODD = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SAMPLE_SALT = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_F_SALT, _G_SALT = _rng.integers(1, 2**63, 2, dtype=np.uint64)
BLOCK = 2048  # terms hashed at a time, for all samples
FIRST, LAST = "1 first", "2 last"  # of a stretch, in the order of sorting
EMPTY = np.zeros(SAMPLES, dtype=np.uint16)


def _exponential(bits: np.ndarray) -> np.ndarray:
    return -np.log1p(-(bits.astype(np.float64) + 0.5) * 2.0**-64 * (1 - 2.0**-53))


def _least_heavy(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least ln a of each sample, its term and its t."""
    x = terms[None, :] * _ODD[:, None]
    e, f, g = _exponential(x), _exponential(mix(x ^ _F_SALT)), _exponential(mix(x ^ _G_SALT))
    ln_c = np.log(e + f)
    r = ln_c - np.log(e) + g
    beta = g / r
    t = np.floor(np.log(weights)[None, :] / r + beta)
    ln_a = ln_c - r * (t - beta + 1.0)
    best = ln_a.argmin(axis=1)
    own = np.arange(SAMPLES), best
    return ln_a[own], terms[best], t[own]


def weighted_samples(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sixteen bits for each sample of a set of distinct term hashes with positive integer weights."""
    if not len(terms):
        return EMPTY
    least, best, level = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, dtype=np.uint64), np.zeros(SAMPLES, dtype=np.uint64)
    heavy = weights > 1
    light, heavy, weights = terms[~heavy], terms[heavy], weights[heavy]
    for at in range(0, len(light), BLOCK):
        part = light[at : at + BLOCK]
        x = part[None, :] * _ODD[:, None]
        i = x.argmin(axis=1)
        ln_a = np.log(_exponential(x[np.arange(SAMPLES), i]))
        less = ln_a < least
        least[less], best[less] = ln_a[less], part[i[less]]
    for at in range(0, len(heavy), BLOCK):
        ln_a, term, t = _least_heavy(heavy[at : at + BLOCK], weights[at : at + BLOCK])
        less = ln_a < least
        least[less], best[less], level[less] = ln_a[less], term[less], t[less].astype(np.uint64)
    return (mix(best ^ _SAMPLE_SALT ^ (level * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def fingerprints(column: pa.Array) -> np.ndarray:
    """A row of samples for each text; texts without words have zeros, which no other text has."""
    out = np.zeros((len(column), SAMPLES), dtype=np.uint16)
    for first, _, h, counts in word_hashes(column):
        end = 0
        for r, n in enumerate(counts.tolist(), first):
            words, end = h[end : end + n], end + n
            if n:
                out[r] = weighted_samples(*np.unique(shingle_hashes(words, RUN), return_counts=True))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples: an estimate of generalised Jaccard similarity."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _finished(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    other = fingerprints(pa.array(changed, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([x.tobytes().hex() for x in own], pa.string()), pa.array([x.tobytes().hex() for x in other], pa.string()),
            pa.array(likeness(own, other), pa.float64()), pa.array(likeness(own, after), pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _with_edges(batch: pa.RecordBatch, text: list | None = None, role: list | None = None, stretch: list | None = None) -> pa.RecordBatch:
    n = len(batch)
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(text or [None] * n, pa.string()), pa.array(role or [None] * n, pa.string()), pa.array(stretch or [None] * n, pa.int32())],
        names=[*batch.schema.names, "text", "edge", "stretch"],
    )


def _edge_rows(rows: list[tuple], stretch: int) -> pa.RecordBatch:
    empty = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return _with_edges(empty, [r[1] for r in rows], [r[2] for r in rows], [stretch] * len(rows))


def _stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted stretch of (doc_id, text): results of all rows but the last, and the first and last row as edges to the neighbours."""
    held: tuple | None = None
    first: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column(1).fill_null("")
        ids, texts, prints = batch.column(0).to_pylist(), column.to_pylist(), fingerprints(column)
        first = first or (ids[0], texts[0])
        if held:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], np.vstack([held[2][None], prints])
        held = ids[-1], texts[-1], prints[-1]
        if len(ids) > 1:
            yield _with_edges(_finished(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]))
    if held:
        yield _edge_rows([(*first, FIRST), (*held[:2], LAST)], TaskContext.get().partitionId())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of stretches with the first text of the next one, row by row: doc_id, text, following."""
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(k) for k in range(3)), strict=True):
            yield _pair((doc_id.as_py(), text.as_py()), following.as_py())


def _pair(own: tuple, following: str) -> pa.RecordBatch:
    p = fingerprints(pa.array([own[1], following], pa.large_string()))
    return _finished([own[0]], [own[1]], [following], p[:1], p[1:])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to fingerprints of each text and of its edited text, a row for each row.

    The edited text ends with the beginning of the next document in descending
    doc_id (after the last comes the first; a lone document follows itself).
    Null counts as empty.  Equal ids follow each other in the order of their
    texts, and rows without an id come last.  Fingerprints are hexadecimal; texts without words share
    one that is unlike all others.
    Texts are sorted once, in stretches; only two rows of each stretch go on to meet their neighbours, each pair by itself.
    Repeated rows follow each other, long texts are hashed in blocks, an empty table gives no rows, and other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    stretches = min(max(docs.count() // PARTITION_ROWS, 8), MOST_PARTITIONS)
    order = F.col("doc_id").desc_nulls_last()
    ranged = docs.repartitionByRange(stretches, order).sortWithinPartitions(order, "text")
    found = materialize(ranged.mapInArrow(_stretch, f"{_SCHEMA}, text string, edge string, stretch int"), "stretches")
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    first, last = (found.where(F.col("edge") == e).select("stretch", "doc_id", "text") for e in (FIRST, LAST))
    # the numbers of the stretches that have rows, at most so many as there are stretches; after the last comes the first
    numbers = sorted(r.stretch for r in first.select("stretch").collect())
    after = docs.sparkSession.createDataFrame(list(zip(numbers, [*numbers[1:], *numbers[:1]], strict=True)), "stretch int, following int")
    edges = last.join(F.broadcast(after), "stretch").join(first.select(F.col("stretch").alias("following"), F.col("text").alias("next_text")), "following")
    return found.where("edge IS NULL").select(*names).unionByName(edges.select("doc_id", "text", "next_text").mapInArrow(_pairs, _SCHEMA))
