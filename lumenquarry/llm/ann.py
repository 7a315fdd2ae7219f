"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

The index is a table of classes (equal vectors) in blocks; hashing a block gives rows (bucket, block,
classes), probing a block of query vectors gives rows (bucket, block, queries), and these two tables
are joined on the bucket. What meets is gathered per pair of blocks, made distinct there, and
scored exactly. No vector is compared with one that no probed bucket holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenquarry.llm.common import bounded_batches, dropped, lean, saved

#: Hash tables, rounds of a pseudo-rotation, its seed.
TABLES, ROUNDS, SEED = 16, 3, 11
#: A table has a bucket for so many classes or fewer; the number of probes is the square root of that of the buckets.
ROWS_A_BUCKET, LEAST_PROBES = 4, 8
#: Rows of a block of classes, of a block of queries, and bytes of a block's vectors, at most (on average).
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 1024, 1 << 14, 1 << 23
#: Scores that are this close are computed anew with more digits before they are ordered.
CLOSE = 1e-11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length is a power of two), scaled to keep norms."""
    n, d = x.shape
    half = 1
    while half < d:
        pair = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """Buckets of unit vectors in several tables.

    A hash is the nearest signed axis after rounds of random signs and Hadamard transforms. A bucket is
    a run of hashes, the last of which may look at the first few axes only, so that the number of
    buckets follows that of the classes at every size.
    """

    def __init__(self, dim: int, classes: int, tables: int, seed: int):
        self.dim, self.width = dim, 1 << max(0, (dim - 1).bit_length())
        wanted, self.axes = max(2, classes // ROWS_A_BUCKET), []
        while wanted > 1:
            self.axes.append(min(self.width, 1 << max(0, math.ceil(math.log2(wanted / 2)))))
            wanted = -(-wanted // (2 * self.axes[-1]))
        self.buckets_in = math.prod(2 * a for a in self.axes)
        self.probes_in = min(self.buckets_in, max(LEAST_PROBES, math.ceil(math.sqrt(self.buckets_in))))
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, len(self.axes), ROUNDS, self.width))

    def _signed(self, x: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """The signed axes of each hash of a table, (rows, 2 * axes)."""
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for rounds, axes in zip(self.signs[table], self.axes, strict=True):
            y = x
            for s in rounds:
                y = hadamard(y * s)
            yield np.concatenate([y[:, :axes], -y[:, :axes]], 1)

    def _named(self, table: int, code: np.ndarray) -> np.ndarray:
        """Bucket numbers that no other table or length of vector has."""
        return (np.int64(self.dim) << 48) + (np.int64(table) << 42) + code if self.buckets_in < 1 << 42 else code * np.int64(1 << 6) + table + self.dim

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row, (rows, 1)."""
        code = np.zeros(len(x), np.int64)
        for signed in self._signed(x, table):
            code = code * signed.shape[1] + signed.argmax(1)
        return self._named(table, code)[:, None]

    def probes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The nearest buckets of each row: those whose axes fall short of the nearest ones by the least sum of squares."""
        code, short = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for signed in self._signed(x, table):
            gap, n = (signed.max(1, keepdims=True) - signed) ** 2, signed.shape[1]
            both = (short[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            most = min(self.probes_in, both.shape[1])  # the best of longer runs begin with the best of shorter ones
            best = np.argpartition(both, most - 1, 1)[:, :most]
            short, code = np.take_along_axis(both, best, 1), np.take_along_axis(code, best // n, 1) * n + best % n
        return self._named(table, code)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # squares of very small or large numbers would be 0 or infinite
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


BUCKETS = "bucket long, dim int, block int, rows array<smallint>"


@lean
def _bucket_rows(batches: Iterator[pa.RecordBatch], hashes: dict[int, CrossPolytope], probing: bool) -> Iterator[pa.RecordBatch]:
    """Of each block: the buckets that its rows fall into (or look into), and which rows."""
    for batch in batches:
        for i, (dim, block) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("block").to_pylist(), strict=True)):
            unit, h = _unit(_matrix(batch.column("vectors").slice(i, 1).flatten(), dim)), hashes[dim]
            step = max(1, (1 << 21) // (h.probes_in * 2 * h.width))
            for t in range(len(h.signs)):
                code = np.concatenate([h.probes(unit[a : a + step], t) if probing else h.buckets(unit[a : a + step], t) for a in range(0, len(unit), step)])
                row = np.repeat(np.arange(len(code)), code.shape[1])
                order = np.argsort(code.ravel(), kind="stable")
                name, first = np.unique(code.ravel()[order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, code.size], pa.int32()), pa.array(row[order].astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(name), *(pa.array(np.full(len(name), v, np.int32)) for v in (dim, block)), lists], names=["bucket", "dim", "block", "rows"])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _best_of_cell(queries: np.ndarray, classes: np.ndarray, first: np.ndarray, mask: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, class, score) of the `keep` best classes of each query among the pairs in mask: by score, then first id."""
    unit = _unit(classes)
    picked: list[tuple[np.ndarray, np.ndarray]] = []
    for q, wanted in enumerate(_unit(queries)):
        met = np.flatnonzero(mask[q])
        if len(met):
            score = unit[met] @ wanted
            least = np.partition(score, -keep)[-keep] if len(met) > keep else -2.0
            met = met[score >= least - CLOSE]  # all that may tie
            picked.append((np.full(len(met), q), met))
    qs, cs = (np.concatenate(x) for x in zip(*picked, strict=True)) if picked else (np.zeros(0, np.int64),) * 2
    score = np.empty(len(qs))
    for a in range(0, len(qs), 1 << 14):
        some = slice(a, a + (1 << 14))
        score[some] = _cosines(queries[qs[some]].astype(np.longdouble), classes[cs[some]].astype(np.longdouble)).astype(np.float64)
    order = np.lexsort((first[cs], -score, qs))
    qs, cs, score = qs[order], cs[order], score[order]
    top = np.arange(len(qs)) - np.searchsorted(qs, qs) < keep
    return qs[top], cs[top], score[top]


def _pairs(met: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, class) rows of all lists that met, some at a time."""
    c, q = met.flatten()  # (field() would not heed the offset of a slice)
    nq, nc = (x.value_lengths().to_numpy().astype(np.int64) for x in (q, c))
    flat_q, flat_c = q.flatten().to_numpy(), c.flatten().to_numpy()
    at_q, at_c, ends = np.cumsum(nq) - nq, np.cumsum(nc) - nc, np.cumsum(nq * nc)
    a = 0
    while a < len(nq):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 20))))
        n = nq[a:b] * nc[a:b]
        of = np.repeat(np.arange(a, b), n)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        yield flat_q[at_q[of] + turn // nc[of]], flat_c[at_c[of] + turn % nc[of]]
        a = b


BEST = "key long, score double, first long, ids array<long>"


@lean
def _reranked(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Rows of two blocks of vectors each, with the lists of rows that met in a bucket (none: all are compared)."""
    for batch in batches:
        for i, dim in enumerate(batch.column("dim").to_pylist()):
            one = lambda name, i=i: batch.column(name).slice(i, 1).flatten()
            queries, classes = _matrix(one("q_vectors"), dim), _matrix(one("vectors"), dim)
            first, keys, ids = one("first").to_numpy(), one("keys").to_numpy(), one("ids").to_pylist()
            if "met" in batch.schema.names:
                mask = np.zeros((len(queries), len(classes)), bool)
                for q, c in _pairs(one("met")):
                    mask[q, c] = True
            else:
                mask = np.ones((len(queries), len(classes)), bool)
            scale = lambda x: x / np.abs(x).max(1, keepdims=True) if len(x) and not 1e-100 < np.abs(x).max() < 1e100 else x
            q, c, score = _best_of_cell(scale(queries), scale(classes), first, mask, keep)
            yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(score), pa.array(first[c]), pa.array([ids[x] for x in c], pa.list_(pa.int64()))], names=["key", "score", "first", "ids"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, key) of the rows that take part: an id, and a vector without null or non-finite components that isn't zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("key", F.xxhash64("vector"))


def _blocked(rows: DataFrame, by: str, counts: dict[int, int], most: int) -> DataFrame:
    """Rows with a `vector` in blocks: their lengths and the hash of `by` say which; no block grows with the table."""
    size = F.lit(1)
    for dim, n in counts.items():
        size = F.when(F.col("dim") == dim, -(-n // max(16, min(most, BLOCK_BYTES // (8 * dim))))).otherwise(size)
    return rows.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64(by, F.lit(1)), size).cast("int"))


def _per_length(rows: DataFrame) -> dict[int, int]:
    """Rows of each length of vector."""
    return {r["dim"]: r["n"] for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = TABLES, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found by cosine for each row whose id `every` divides: query_id, rank, vec_id, score.

    Rows with equal vectors are one class with its k + 1 least ids, so copies are neither compared nor
    gathered. A class is a candidate of a query if one of the query's probed buckets holds it, in any
    table; a table has about a bucket for every four classes and is probed in the square root of that
    number, so a query meets about the square root of the classes. Scores are computed from the vectors
    themselves; those that are nearly equal with extended precision, so that scaled copies tie. Ties go
    to the smaller id. Queries that found fewer than k are compared with all classes, block by block.
    Rows with a null id, or a vector that is null, zero or holds a null or non-finite component, take no
    part; vectors of unlike lengths are never compared; repeated rows (equal id and vector) count once.
    With fewer candidates than k, all are returned; an empty table gives an empty table; other columns
    are not read.
    """
    bounded_batches(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["key", "vec_id"])
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    index = ranked.groupBy("key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = saved(index.select("vector", "ids", F.col("ids")[0].alias("first")), "index")
    queries = saved(rows.where(F.col("vec_id") % every == 0), "queries")
    distinct = saved(queries.groupBy("key").agg(F.first("vector").alias("vector")), "distinct")
    counts = _per_length(index)
    hashes = vectors.sparkSession.sparkContext.broadcast({d: CrossPolytope(d, n, tables, seed) for d, n in counts.items()})
    blocks = _blocked(index, "first", counts, BLOCK_ROWS).groupBy("dim", "block").agg(F.collect_list(F.struct("first", "ids", "vector")).alias("m"))
    blocks = saved(blocks.select("dim", "block", F.col("m.first").alias("first"), F.col("m.ids").alias("ids"), F.col("m.vector").alias("vectors")), "blocks")

    def query_blocks(some: DataFrame) -> DataFrame:
        made = _blocked(some, "key", _per_length(some), QUERY_ROWS).groupBy("dim", "block").agg(F.collect_list(F.struct("key", "vector")).alias("m"))
        return saved(made.select("dim", F.col("block").alias("q_block"), F.col("m.key").alias("keys"), F.col("m.vector").alias("q_vectors")), "asked")

    asked = query_blocks(distinct)
    entries = blocks.select("dim", "block", "vectors").mapInArrow(lambda it: _bucket_rows(it, hashes.value, False), BUCKETS)
    probes = asked.select("dim", F.col("q_block").alias("block"), F.col("q_vectors").alias("vectors")).mapInArrow(lambda it: _bucket_rows(it, hashes.value, True), BUCKETS)
    hits = entries.withColumnRenamed("rows", "c").join(probes.select("bucket", F.col("block").alias("q_block"), F.col("rows").alias("q")).hint("shuffle_merge"), "bucket")
    cells = saved(hits.groupBy("dim", "block", "q_block").agg(F.collect_list(F.struct("c", "q")).alias("met")), "cells")
    full = cells.join(blocks.hint("shuffle_merge"), ["dim", "block"]).join(asked.hint("shuffle_merge"), ["dim", "q_block"])
    best = full.select("dim", "q_vectors", "vectors", "first", "keys", "ids", "met").mapInArrow(lambda it: _reranked(it, k + 1), BEST)
    best = saved(_top(best, k), "best")
    # a class with several ids, or the query's own, says nothing of how many were found: ids are counted
    found = best.groupBy("key").agg(F.sum(F.size("ids")).alias("n"))
    short = distinct.join(found.hint("shuffle_merge"), "key", "left").where(F.coalesce("n", F.lit(0)) <= k).select("key", "vector")
    short = saved(short, "short")
    if not short.isEmpty():
        rest = blocks.join(query_blocks(short).hint("shuffle_merge"), "dim")
        rest = rest.select("dim", "q_vectors", "vectors", "first", "keys", "ids").mapInArrow(lambda it: _reranked(it, k + 1), BEST)
        best = saved(_top(best.join(short.select("key").hint("shuffle_merge"), "key", "left_anti").unionByName(rest), k), "best")
    dropped(cells, index, distinct)
    flat = best.select("key", "score", F.explode("ids").alias("vec_id"))
    lists = flat.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))), 1, k + 1).alias("near"))
    near = queries.select("vec_id", "key").join(lists.hint("shuffle_merge"), "key").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    out = near.select("query_id", F.posexplode("near").alias("rank", "near"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))


def _top(best: DataFrame, k: int) -> DataFrame:
    """The k + 1 best classes of each query vector."""
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "first"))
    return best.withColumn("r", turn).where(F.col("r") <= k + 1).drop("r")
