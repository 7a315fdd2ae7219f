"""How document filters interact: what each removes in every order, from packed bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import bounded_batches, lean, saved, slices

#: The filters of `document_failures`, in the order of their bits.
FILTERS = "ABCDE"
#: Fewest words; least distinct words and most capitals, in per cent; characters of junk.
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, JUNK = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
#: Bytes that don't begin a code point.
CONTINUATION = bytes(range(128, 192))
#: Rows that a bitmap covers: what a task holds at a time.
BLOCK_ROWS = 1 << 18
#: Places that rows without an id are dealt to: they join nothing.
NULL_SALTS = 256
SLICE_BYTES = 1 << 20
#: Most filters: 2**n subsets are counted and n! orders reported.
MOST_FILTERS = 7


def _failures(text: bytes) -> int:
    """Bits of the filters A to D."""
    words = text.split()  # at space and the controls from tab to carriage return
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUATION))
    junk = len(text.translate(None, JUNK)) < len(text)
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1 | (100 * capitals > CAPITALS_PERCENT * points) << 2 | junk << 3


@lean
def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = batch.column("doc_id")
            salts = np.where(np.asarray(ids.is_null()), np.arange(len(texts)) % NULL_SALTS, 0)
            digests = pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, batch.column("part"), pa.array([_failures(t) for t in texts], pa.int32()), digests, pa.array(salts, pa.int32())], names=["doc_id", "part", "fails", "digest", "salt"])


def document_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per row: doc_id, part, fails: bits 0 to 4 for the filters A to E.

    A under 50 words; B under 65 % of the words distinct; C over 5 % of the code points in A-Z; D any of
    #$%&*|; E the text is also that of a smaller id, in any part. Words are runs without space and the
    controls from tab to carriage return. Null texts and parts are empty ones; a null id is neither
    smaller nor larger than others, so its row passes E; repeated rows pass or fail E together.

    Texts are read once; what moves is 16 bytes of hash and the id of each row. A text's first id is
    counted with partial sums, and rows join their own id, never a group of copies.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    facts = saved(rows.mapInArrow(_facts, "doc_id long, part string, fails int, digest binary, salt int"), "facts")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id", "digest", F.lit(0).alias("salt"), F.lit(True).alias("first"))
    joined = facts.join(first.hint("shuffle_merge"), ["doc_id", "digest", "salt"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "salt", "part", F.col("fails").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("fails"))


class Bitmaps:
    """Filters and labels of a block of rows as packed bits, the rows of a part in 64-bit words of their own."""

    def __init__(self, parts: np.ndarray, fails: np.ndarray, n_filters: int, labels: list[np.ndarray]):
        order = np.argsort(parts, kind="stable")
        self.parts, counts = np.unique(parts, return_counts=True)
        words = -(-counts // 64)
        self.starts = np.cumsum(np.r_[0, words])[:-1]
        bit = np.arange(len(parts)) - np.repeat(np.cumsum(np.r_[0, counts])[:-1], counts) + np.repeat(self.starts, counts) * 64
        size = int(words.sum()) * 64
        fails = fails[order]
        self.rows = self._packed(bit, np.ones(len(parts), bool), size)
        self.filters = [self._packed(bit, (fails >> f & 1).astype(bool), size) for f in range(n_filters)]
        self.labels = [self._packed(bit, x[order], size) for x in labels]

    @staticmethod
    def _packed(bit: np.ndarray, on: np.ndarray, size: int) -> np.ndarray:
        flags = np.zeros(size, bool)
        flags[bit] = on
        return np.packbits(flags, bitorder="little").view(np.uint64)

    def counted(self, bits: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), self.starts)

    def survivors(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each set of filters: how many rows of each part fail none of them, in all and with each label."""
        left = [self.rows]
        for f in self.filters:  # a set's rows are those of the set without its last filter, AND NOT that filter
            left += [x & ~f for x in left]
        for subset, bits in enumerate(left):
            yield subset, [self.counted(bits), *(self.counted(bits & label) for label in self.labels)]


@lean
def _subset_counts(batches: Iterator[pa.RecordBatch], n_filters: int, labels: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            block = whole.slice(at, BLOCK_ROWS)
            names = block.column("part").dictionary_encode()
            maps = Bitmaps(names.indices.to_numpy(), block.column("fails").to_numpy(), n_filters, [np.asarray(block.column(x)) for x in labels])
            found = pa.array(names.dictionary.take(pa.array(maps.parts)))
            for subset, counts in maps.survivors():
                yield pa.RecordBatch.from_arrays([found, pa.array(np.full(len(found), subset, np.int32)), *map(pa.array, counts)], names=["part", "subset", "n", *(f"n_{x}" for x in labels)])


def subset_counts(rows: DataFrame, n_filters: int, labels: tuple[str, ...]) -> DataFrame:
    """(part, subset, n, n_<label>...): rows of a part that fail no filter of the subset (a bit mask), for all subsets.

    rows: part string, fails int (a bit for each filter), a boolean for each label. Every block of rows
    of a task becomes a packed bitmap; only 2**n_filters counts a part and block leave it.
    """
    if not 1 <= n_filters <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    picked = rows.select("part", "fails", *(F.coalesce(F.col(x), F.lit(False)).alias(x) for x in labels))
    sums = ["n", *(f"n_{x}" for x in labels)]
    counts = picked.mapInArrow(lambda it: _subset_counts(it, n_filters, labels), "part string, subset int, " + ", ".join(f"{s} long" for s in sums))
    return counts.groupBy("part", "subset").agg(*(F.sum(s).alias(s) for s in sums))


def order_report(counts: DataFrame, filters: str, good: str = "good", toxic: str = "toxic") -> DataFrame:
    """Every order of the filters, step by step, of each part, from `subset_counts`: 2**n rows a part in, n * n! rows out."""
    size, n = 1 << len(filters), len(filters)
    at = lambda mask, what="n": F.element_at("s", mask + 1)[what]

    def shapley(f: int) -> Column:
        """Of all orders, those with just the filters of a set before f: (size of the set)! * (the rest without f)!"""
        out = F.lit(0).cast("long")
        for s in range(size):
            if not s >> f & 1:
                k = s.bit_count()
                out = out + factorial(k) * factorial(n - 1 - k) * (at(F.lit(s)) - at(F.lit(s | 1 << f)))
        return out

    lists = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", f"n_{good}", f"n_{toxic}"))).alias("s"))
    lists = lists.select("part", "s", F.array(*(shapley(f) for f in range(n))).alias("shares"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    rows = lists.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit = lambda i: F.element_at(F.create_map(*(F.lit(x) for f, c in enumerate(filters) for x in (c, 1 << f))), F.substr("filter_order", i, F.lit(1)))
    before = F.aggregate(F.when(F.col("step") > 1, F.sequence(F.lit(1), F.col("step") - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda a, i: a.bitwiseOR(bit(i)))
    rows = rows.withColumn("before", before).withColumn("own", bit(F.col("step")))
    own, after = F.col("own"), F.col("before").bitwiseOR(F.col("own"))
    removed = at(F.col("before")) - at(after)
    place = F.element_at(F.create_map(*(F.lit(x) for f in range(n) for x in (1 << f, f + 1))), own)
    return rows.select(
        "part", "filter_order", "step", at(after).alias("kept"), removed.alias("removed"), (at(F.lit(0)) - at(own) - removed).alias("redundant"), (at(F.lit(size - 1) - own) - at(F.lit(size - 1))).alias("unique_fails"),
        (at(F.col("before"), f"n_{good}") - at(after, f"n_{good}")).alias("good_lost"), (at(F.col("before"), f"n_{toxic}") - at(after, f"n_{toxic}")).alias("toxic_lost"), F.element_at("shares", place).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): see `document_failures` for the filters.

    A part without rows has no report, so an empty table gives none. A document is good or toxic if any
    of its labels says so; labels with a null id or value say nothing; a null id has no labels. Repeated
    rows count each. Other columns are not read.
    """
    fails = document_failures(docs, id_col, text_col, part_col)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = fails.join(marks.withColumn("salt", F.lit(0)).hint("shuffle_merge"), ["doc_id", "salt"], "left")
    return order_report(subset_counts(rows, len(FILTERS), ("good", "toxic")), FILTERS)
