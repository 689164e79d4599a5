"""Near-duplicate documents: HyperMinHash sketches, banded registers, estimated then exact Jaccard similarity.

1. A pass over the texts makes, for each document, a 128-bit class (equal word
   sequences share it), the number of distinct word shingles and a sketch: the
   shingle hashes are dealt to 128 buckets, and each bucket stores the leading
   zeros of its least hash and the ten bits after the leading one in a 16-bit
   register.  An empty bucket borrows the register of the non-empty bucket that
   its own random order puts first, so small sets keep the collision rate.
2. One document stands for its class, so copies never meet each other.
3. 32 bands of 4 registers are hashed.  In each band bucket the least document
   is the hub; (hub, member) pairs whose collision-corrected estimate reaches
   ``ESTIMATE_FLOOR``, and all with a set of at most ``SMALL`` shingles, are verified on the full shingle sets.
4. Pairs without the hub matter only where a bucket still holds several
   components.  What lies outside a bucket's largest component is compared with all
   of it, in blocks, on the sketches: rows grow with the blocks outside, so with the
   square of a bucket only if it falls into many components.  Documents with a
   partner left are sent once to each bucket that first joins them, and are
   verified there, skipping what is linked already; nothing is capped or dropped.
5. Verified links are contracted to components.

A pair at similarity 0.75 shares no band with probability 5e-6 at most
((1 - 0.75**4)**32), and less the more alike it is; an estimate falls below the
floor at five standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import hot_join, keyed_side, materialize
from .words import mix, shingle_sets

BUCKETS, BANDS, MANTISSA = 128, 32, 10
ROWS = BUCKETS // BANDS
ESTIMATE_FLOOR = 0.56  # 0.75 less five standard deviations of a 128-register estimate
SMALL = 128  # sets of at most so many shingles are verified whatever the estimate: few elements make it coarse, and they are quick to compare
BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # documents and shingles of one bucket that are held on a side in one task; larger buckets are dealt out as pairs of blocks
STAR = 2000  # members that are verified against one copy of the hub's text
_VALUE_BITS = 64 - 7
_U = np.uint64
_ORDER = np.random.default_rng(77).random((BUCKETS, BUCKETS))
_BAND_SALT = np.random.default_rng(78).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | _U(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """16-bit registers of a sorted set of distinct shingle hashes; it must not be empty."""
    bucket = (shingles >> _U(_VALUE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))  # the least of its bucket, as hashes are sorted
    value = shingles[first] & _U((1 << _VALUE_BITS) - 1)
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)  # bits up to the leading one; rounding up is harmless, it is the same for equal values
    length = np.minimum(length, _VALUE_BITS)
    shift = length - 1 - MANTISSA
    mantissa = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64)) & _U((1 << MANTISSA) - 1)
    register = (((_VALUE_BITS - length) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)
    out = np.zeros(BUCKETS, dtype=np.uint16)
    out[bucket[first]] = register
    if len(first) < BUCKETS:
        empty = np.setdiff1d(np.arange(BUCKETS), bucket[first], assume_unique=True)
        out[empty] = register[_ORDER[np.ix_(empty, bucket[first])].argmin(axis=1)]
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a sketch (or of each sketch)."""
    x = registers.reshape(*registers.shape[:-1], BANDS, ROWS).astype(np.uint64) + _U(1)
    return mix((mix(x) * _BAND_SALT).sum(axis=-1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def levels(n: np.ndarray) -> np.ndarray:
    """For sets of these sizes, the probability of each number of leading zeros in a register."""
    load = np.maximum(np.asarray(n) / BUCKETS, 1.0)[:, None]
    below = 1.0 - (1.0 - 0.5 ** np.arange(_VALUE_BITS + 2)) ** load  # at least so many zeros
    return (below[:, :-1] - below[:, 1:]).astype(np.float32)


def estimate(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance collisions.

    Registers of unlike buckets agree if their leading zeros agree (``la``, ``lb``: their
    levels) and then their mantissa bits.
    """
    chance = (la * lb).sum(axis=-1) * 2.0**-MANTISSA
    return ((a == b).mean(axis=-1) - chance) / (1.0 - chance)


def _worth(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of sketches, of sets of n and m shingles, are to be verified."""
    return (np.minimum(n, m) <= SMALL) | (estimate(a, b, levels(n), levels(m)) >= ESTIMATE_FLOOR)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (n + m - common)


def _sketch_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    salt = np.random.default_rng(79).integers(1, 2**63, 2, dtype=np.uint64) | _U(1)
    for batch in batches:
        n, cls, reg = [], np.zeros((len(batch), 2), dtype=np.uint64), []
        for r, s, h in shingle_sets(batch.column(1), shingle):
            n.append(len(s))
            if len(h):
                place = np.arange(1, len(h) + 1, dtype=np.uint64)
                cls[r] = [mix(h * salt[0] + place * salt[1]).sum(dtype=np.uint64), mix(h ^ (place * salt[0])).sum(dtype=np.uint64)]
            reg.append(sketch(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(cls[:, 0].view(np.int64)), pa.array(cls[:, 1].view(np.int64)), pa.array(reg, pa.binary())],
            names=["doc_id", "n_shingles", "c1", "c2", "registers"],
        )


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = bands(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)) if len(batch) else np.zeros((0, BANDS), dtype=np.int64)
        ids = np.repeat(np.asarray(batch.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], names=["node", "key"])


def _estimate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for k in (2, 3))
        n, m = np.asarray(batch.column(4)), np.asarray(batch.column(5))
        yield batch.select([0, 1]).filter(pa.array(_worth(a, b, n, m)))


def _star_batches(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, node, text), sorted by them with the hub's own first, to the pairs that are linked."""
    at, own = None, []
    for batch in batches:
        hub, salt, node = (batch.column(k).to_pylist() for k in range(3))
        a, b = [], []
        for r, s, _ in shingle_sets(batch.column(3), shingle):
            if at != (hub[r], salt[r]):
                at, own = (hub[r], salt[r]), []
            if node[r] == hub[r]:
                own.append(s)
            elif any(linked(x, s, percent) for x in own):
                a.append(hub[r])
                b.append(node[r])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows, sorted by their first ``keys`` columns, that agree in these."""
    at, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        k = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        cuts = [0, *(i for i in range(1, len(k)) if k[i] != k[i - 1]), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if k[lo] != at:
                if held:
                    yield at, held
                at, held = k[lo], []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, held


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket rows (key, i, j, block, node, component, n, registers) to the (key, i, j, block, node) that have a partner to verify here."""
    for (key, i, j), held in _groups(batches, 3):
        t = pa.Table.from_batches(held)
        block, node, comp, n = (t.column(k).to_numpy() for k in range(3, 7))
        reg = np.frombuffer(b"".join(t.column(7).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
        own, level = bands(reg), levels(n)
        band = int(np.argmax(own[0] == key))
        wanted = np.zeros(len(node), dtype=bool)
        for x in range(len(node)):
            other = np.flatnonzero((comp != comp[x]) & (node > node[x]) & ((block != block[x]) | (i == j)))
            other = other[100 * np.minimum(n[other], n[x]) >= 75 * np.maximum(n[other], n[x])]
            if len(other):
                other = other[~(own[other, :band] == own[x, :band]).any(axis=1)]  # another bucket joined them before
            if len(other):
                other = other[(np.minimum(n[other], n[x]) <= SMALL) | (estimate(reg[other], reg[x], level[other], level[x]) >= ESTIMATE_FLOOR)]
                wanted[other] = True
                wanted[x] |= len(other) > 0
        k = int(wanted.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, key)), pa.array(np.full(k, i, dtype=np.int32)), pa.array(np.full(k, j, dtype=np.int32)), pa.array(block[wanted].astype(np.int32)), pa.array(node[wanted]), pa.array(comp[wanted])],
            names=["key", "i", "j", "block", "node", "comp"],
        )


def _verify_groups(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, block, node, component, text) to links that join components."""
    for (_, i, j), held in _groups(batches, 3):
        nodes, comps, blocks, sets = [], [], [], []
        for part in held:
            blocks += part.column(3).to_pylist()
            nodes += part.column(4).to_pylist()
            comps += part.column(5).to_pylist()
            sets += [(s, sketch(s)) for _, s, _ in shingle_sets(part.column(6), shingle)]
        up = {c: c for c in comps}

        def top(c: int, up: dict = up) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        size = np.array([len(x[0]) for x in sets])
        reg, level = np.array([x[1] for x in sets]), levels(size)
        a, b = [], []
        for x in range(len(nodes)):
            near = x + 1 + np.flatnonzero((np.minimum(size[x + 1 :], size[x]) <= SMALL) | (estimate(reg[x + 1 :], reg[x], level[x + 1 :], level[x]) >= ESTIMATE_FLOOR))
            for y in near.tolist():
                if (blocks[x] != blocks[y] or i == j) and top(comps[x]) != top(comps[y]) and linked(sets[x][0], sets[y][0], percent):
                    up[top(comps[x])] = top(comps[y])
                    a.append(nodes[x])
                    b.append(nodes[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per input row: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set
    holds its distinct ``shingle``-word runs, or its whole word sequence if that
    is shorter.  Documents with ``100 * |intersection| >= percent * |union|`` are
    linked; ``component_id`` is the least doc_id that can be reached.

    Null, empty and blank texts have no shingles and form components of their
    own.  Rows that share a doc_id come back once each, by their own texts; as
    representatives they are one node.
    A row without a doc_id keeps its n_shingles, and has a null component and
    kept = false.  Texts of any length are taken whole, an empty table gives no rows, and
    other columns of ``docs`` are ignored.
    """
    if percent < 75:
        raise ValueError("bands and floor are laid out for similarities of 0.75 and more")
    docs = docs.select("doc_id", "text")
    sketched = docs.mapInArrow(lambda it: _sketch_batches(it, shingle), "doc_id long, n_shingles long, c1 long, c2 long, registers binary")
    sketched = materialize(sketched, "sketches")
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(filled.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "classes")
    # one row for each node: it takes no join on the class, whose copies may be a third of all rows
    reps = filled.withColumnRenamed("doc_id", "node").join(classes, ["node", "c1", "c2"], "left_semi")
    reps = reps.groupBy("node", "c1", "c2").agg(F.first("n_shingles").alias("n"), F.first("registers").alias("registers")).select("node", "n", "registers")
    reps = materialize(reps, "representatives")

    keyed = materialize(reps.select("node", "registers").mapInArrow(_band_batches, "node long, key long"), "bands")
    hubs = materialize(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"), "hubs")
    member = materialize(hot_join(keyed, hubs, "key", n="members"), "buckets")
    pairs = materialize(member.where("node <> hub").select("hub", "node").distinct(), "hub-pairs")
    side = reps.select(F.col("node").alias("hub"), F.col("registers").alias("hub_registers"), F.col("n").alias("hub_n"))
    side = materialize(pairs.groupBy("hub").agg(F.count("*").alias("pairs")).join(side, "hub"), "hub-sketches")
    scored = hot_join(pairs.join(reps, "node"), side, "hub", n="pairs").select("hub", "node", "hub_registers", "registers", "hub_n", "n")
    pairs = materialize(scored.mapInArrow(_estimate_batches, "hub long, node long"), "pairs")

    sizes = materialize(pairs.groupBy("hub").agg(F.count("*").alias("members")), "star-sizes")
    salted = hot_join(pairs, sizes, "hub", n="members").select("hub", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / STAR).cast("long")).cast("int").alias("salt"), "node")
    star = salted.union(salted.select("hub", "salt", F.col("hub").alias("node")).distinct())
    # whole texts are met once: those of documents that share a bucket are few, and are kept by themselves
    met = keyed_side(materialize(member.select("node").distinct(), "met"))
    text = materialize(docs.select(F.col("doc_id").alias("node"), "text").join(met, "node", "left_semi"), "texts")
    star = star.join(text, "node").select("hub", "salt", "node", "text")
    star = star.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node") != F.col("hub"))
    links = materialize(star.mapInArrow(lambda it: _star_batches(it, shingle, percent), "a long, b long"), "links")
    first = materialize(connected_components(links), "first")

    here = member.where("members > 2").join(first, "node", "left").select("key", "hub", "node", "members", F.coalesce("component_id", "node").alias("comp"))
    here = materialize(here.where("node <> hub"), "members")
    # pairs with the hub have been tried: what is left has two components beside the hub itself
    mixed = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("key", "rows")
    here = materialize(hot_join(here, materialize(mixed, "mixed"), "key", n="rows").join(reps, "node"), "mixed-members")
    # the largest component of a bucket is not compared with itself: what is outside it meets all members, block by block
    size = here.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    blocks = lambda rows, shingles: F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")
    size = size.groupBy("key").agg(F.max(F.struct("rows", "comp", "shingles")).alias("most"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    size = size.select("key", "rows", F.col("most.comp").alias("main"), blocks(F.col("rows"), F.col("shingles")).alias("g_all"), blocks(F.col("rows") - F.col("most.rows"), F.col("shingles") - F.col("most.shingles")).alias("g_rest"))
    met_ = hot_join(here.drop("rows"), materialize(size, "bucket-sizes"), "key", n="rows")
    cell = lambda i, j, block: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(block).alias("block"))
    every = lambda g: F.sequence(F.lit(0).cast("long"), F.col(g) - 1)
    among = lambda g: F.pmod(F.xxhash64("node"), F.col(g))
    as_one_of_all = F.transform(every("g_rest"), lambda i: cell(i, among("g_all"), 1))
    as_one_outside = F.when(F.col("comp") != F.col("main"), F.transform(every("g_all"), lambda j: cell(among("g_rest"), j, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,block:int>>"))
    open_ = met_.withColumn("cell", F.explode(F.concat(as_one_of_all, as_one_outside))).select("key", "cell.i", "cell.j", "cell.block", "node", "comp", "n", "registers")
    open_ = open_.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    wanted = materialize(open_.mapInArrow(_left_over, "key long, i int, j int, block int, node long, comp long"), "left-over")
    rest = wanted.join(text, "node").select("key", "i", "j", "block", "node", "comp", "text")
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    more = rest.mapInArrow(lambda it: _verify_groups(it, shingle, percent), "a long, b long")
    final = connected_components(materialize(more, "more").union(first.selectExpr("node AS a", "component_id AS b")))

    named = classes.join(final, "node", "left").select(F.struct("c1", "c2").alias("class"), "rows", F.coalesce("component_id", "node").alias("component_id"))
    # a doc_id with several texts is one node, whatever class each text is in
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.struct("c1", "c2")).alias("class"))
    out = out.where("class IS NULL").withColumn("component_id", F.lit(None).cast("long")).unionByName(hot_join(out.where("class IS NOT NULL"), materialize(named, "named"), "class", "left", "rows").drop("rows"))
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """Rows of ``docs``, with all their columns, that stand for their near-duplicates: one row of each component.

    Documents without words and rows without a doc_id are nobody's duplicates and all stay.
    Of rows that share the kept doc_id one stays, the one whose columns come first in order.
    """
    found = near_duplicates(docs, shingle, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("copies"), F.max("kept").alias("kept"))
    found = materialize(found, "kept")
    # the columns of the table travel in one struct, so that none of their names can clash
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    gone = keyed_side(found.where("NOT kept OR copies > 1").select("doc_id"))
    several = rows.join(keyed_side(found.where("kept AND copies > 1").select("doc_id")), "doc_id").select("doc_id", F.to_json("doc").alias("text_of"), "doc")
    several = several.groupBy("doc_id").agg(F.min_by("doc", "text_of").alias("doc"))
    return rows.join(gone, "doc_id", "left_anti").unionByName(several).select("doc.*")


#: The same rows in DuckDB: all pairs that share a shingle, and the closure of the links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, array_to_string(ws, ' ') AS g FROM w WHERE len(ws) BETWEEN 1 AND 4
    UNION ALL SELECT doc_id, array_to_string(ws[i : i + 4], ' ') FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""
