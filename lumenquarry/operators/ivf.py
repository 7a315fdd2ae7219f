"""A stored vector index: inverted lists around trained centroids, product-quantized residuals, half-precision vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that the quantizer is trained on, those of least hashed key; lists, at most; dimensions of a part; codes of a part.
SAMPLE, MOST_LISTS, PART, CODES = 16_384, 1024, 4, 256
#: Fewer vectors than this are one list.
LEAST_TRAINED = 1024
#: Rounds of k-means.
ROUNDS = 8
#: Candidates by codes, for each result, that are scored by their vectors.
RERANKED = 10
ROW = "list int, codes binary, half binary"


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(rows, centers)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(rows[order], np.minimum(np.cumsum(np.r_[0, n])[:-1], len(rows) - 1), axis=0)
        centers = np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], centers).astype(np.float32)
    return centers


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center of each row, some rows at a time."""
    half = 0.5 * (centers * centers).sum(1)
    return np.concatenate([np.argmax(rows[i : i + 4096] @ centers.T - half, axis=1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


@dataclass
class Quantizer:
    """centroids of the lists; for each part of the dimensions a book of codes for what a vector lacks from its centroid."""

    centroids: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, lists: int, seed: int = 7) -> Quantizer:
        rng = np.random.default_rng(seed)
        sample = np.asarray(sample, np.float32)
        d = sample.shape[1]
        centroids = _k_means(sample, max(1, min(lists, len(sample))), rng)
        rest = np.pad(sample - centroids[_nearest(sample, centroids)], ((0, 0), (0, -d % PART)))
        codes = min(CODES, len(sample))
        return Quantizer(centroids, np.stack([_k_means(np.ascontiguousarray(rest[:, p : p + PART]), codes, rng) for p in range(0, rest.shape[1], PART)]))

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each row."""
        rows = np.asarray(rows, np.float32)
        lists = _nearest(rows, self.centroids)
        rest = np.pad(rows - self.centroids[lists], ((0, 0), (0, -rows.shape[1] % PART)))
        return lists, np.stack([_nearest(rest[:, i * PART : (i + 1) * PART], book) for i, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def probes(self, query: np.ndarray, n: int) -> np.ndarray:
        """The n lists whose centroids have the greatest product with a query."""
        return np.argsort(-(self.centroids @ query), kind="stable")[:n]

    def estimates(self, query: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of a query with rows, from their lists and codes: a table look-up for each part."""
        parts = np.pad(query, (0, len(self.books) * PART - len(query))).reshape(len(self.books), PART)
        table = np.einsum("mkd,md->mk", self.books, parts)
        return (self.centroids @ query)[lists] + table[np.arange(len(self.books)), codes].sum(1)

    def rows(self) -> list[tuple[str, int, list[float]]]:
        """(kind, number, values): as rows of a small table."""
        return [("list", i, c.tolist()) for i, c in enumerate(self.centroids)] + [("book", i, b.ravel().tolist()) for i, b in enumerate(self.books)]

    @staticmethod
    def of(rows: list[tuple[str, int, list[float]]]) -> Quantizer:
        of = lambda kind: [np.asarray(v, np.float32) for k, _, v in sorted(rows, key=lambda r: r[1]) if k == kind]
        return Quantizer(np.stack(of("list")), np.stack([b.reshape(-1, PART) for b in of("book")]))


QUANTIZER = "kind string, number int, values array<float>"


def trained(vectors: DataFrame, key: Column, vector: str = "v", sample: int = SAMPLE, lists: int | None = None, seed: int = 7) -> Quantizer | None:
    """A quantizer fitted on at most `sample` vectors, which come to the driver; None for fewer than LEAST_TRAINED."""
    n = vectors.count()
    if n < LEAST_TRAINED:
        return None
    got = vectors.select(F.xxhash64(key).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(sample).select("v").toArrow().column("v").combine_chunks()
    rows = got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)
    return Quantizer.fit(rows, lists or min(MOST_LISTS, int(4 * n**0.5)), seed)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as binary values."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def halves(column: pa.Array, dtype: type = np.float16) -> np.ndarray:
    """The matrix of a column of equally long binary values."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def encoded(vectors: DataFrame, quantizer: Quantizer | None, vector: str = "v") -> DataFrame:
    """The rows with list, codes and half (the vector in 16-bit floats). Narrow. Without a quantizer all rows are of list 0."""
    sent = vectors.sparkSession.sparkContext.broadcast(quantizer)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(vector))
            lists, codes = sent.value.encode(rows) if sent.value else (np.zeros(len(rows), np.int64), np.zeros((len(rows), 1), np.uint8))
            more = [pa.array(lists.astype(np.int32)), _binary(codes), _binary(rows.astype(np.float16))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "list", "codes", "half"])

    return vectors.mapInArrow(run, f"{fields}, {ROW}")


def unpacked(index: DataFrame, keys: tuple[str, ...], half: str = "half") -> DataFrame:
    """(keys, v array<double>) of stored rows."""
    kinds = ", ".join(f"`{x}` {index.schema[x].dataType.simpleString()}" for x in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = halves(batch.column(half)).astype(np.float64)
                ends = pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keys), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=[*keys, "v"])

    return index.select(*keys, half).mapInArrow(run, f"{kinds}, v array<double>")


def radii(index: DataFrame, quantizer: Quantizer, vector: str = "v") -> dict[int, tuple[float, int]]:
    """Of each list the greatest distance of a row from its centroid, and its rows: one row a list to the driver."""
    sent = index.sparkSession.sparkContext.broadcast(quantizer.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("list").to_numpy()
                rows = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("list"), pa.array(np.sqrt(((rows - sent.value[lists]) ** 2).sum(1)))], names=["list", "far"])

    found = index.select("list", vector).mapInArrow(run, "list int, far double").groupBy("list").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    return {r["list"]: (r["far"], r["n"]) for r in found}


def _best(index: DataFrame, quantizer: Quantizer | None, query: np.ndarray, keys: tuple[str, ...], vector: str, k: int, reranked: int | None) -> DataFrame:
    """(keys, score): of each task's rows the k best; by their vectors, of the `reranked` * k best by codes (None: of all)."""
    sent = index.sparkSession.sparkContext.broadcast((quantizer, query))
    kinds = ", ".join(f"`{x}` {index.schema[x].dataType.simpleString()}" for x in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, want = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if q is not None and reranked is not None and batch.num_rows > reranked * k:
                near = q.estimates(want, batch.column("list").to_numpy(), halves(batch.column("codes"), np.uint8))
                batch = batch.take(pa.array(np.argpartition(-near, reranked * k)[: reranked * k]))
            column = batch.column(vector)
            rows = halves(column).astype(np.float64) if pa.types.is_binary(column.type) else column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            score = np.einsum("ij,j->i", rows, want.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keys), pa.array(score)], names=[*keys, "score"])

    return index.select(*keys, "list", "codes", vector).mapInArrow(run, f"{kinds}, score double")


def search(index: DataFrame, quantizer: Quantizer | None, query: list[float], k: int, keys: tuple[str, ...] = ("vec_id",), vector: str = "half", probes: int = 16, reranked: int | None = RERANKED) -> DataFrame:
    """(keys, score) of the rows of the nearest lists, best by their vectors of those that are best by codes: not all of a list, so order and cut them.

    Only the rows of `probes` lists are read: the lists are literals in the scan's filter. Filters and
    deletions are rows that `index` doesn't have.
    """
    want = np.asarray(query, np.float32)
    if quantizer is not None:
        index = index.where(F.col("list").isin(*(int(x) for x in quantizer.probes(want, probes))))
    return _best(index, quantizer, want, keys, vector, k, reranked)


def search_exactly(index: DataFrame, quantizer: Quantizer, bounds: dict[int, tuple[float, int]], query: list[float], k: int, keys: tuple[str, ...] = ("vec_id",), vector: str = "v", probes: int = 4) -> tuple[DataFrame, int]:
    """(keys, score) of the k best rows, exactly, and how many rows were read.

    No row of a list has a greater product with the query than its centroid's plus the list's radius times
    the query's length. The k-th score of the lists with the greatest bounds rules out all lists whose
    bound is smaller.
    """
    want = np.asarray(query, np.float64)
    near = quantizer.centroids.astype(np.float64) @ want
    size = float(np.linalg.norm(want))
    order = sorted(bounds, key=lambda x: -(near[x] + bounds[x][0] * size))
    top = lambda some, n: _best(index.where(F.col("list").isin(*some)), None, want, keys, vector, k, None).orderBy(F.desc("score"), *keys).limit(n)
    first = order[:probes]
    best = [r["score"] for r in top(first, k).select("score").collect()] if first else []
    least = best[k - 1] - 1e-6 * max(1.0, abs(best[k - 1])) if len(best) >= k else float("-inf")
    left = [x for x in order if near[x] + bounds[x][0] * size >= least]
    return top(left or [-1], k), sum(bounds[x][1] for x in left)
