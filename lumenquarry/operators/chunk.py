"""Blocks and chunks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenquarry.functions.text import words
from lumenquarry.workers import bounded_batches

#: Blocks that a task hands on at a time.
BLOCK_ROWS = 1 << 14

#: What a regular expression's \\s is, without the flag for Unicode.
ASCII_SPACE = " \t\n\v\f\r"


def window_starts(n: Column, target: int, overlap: int) -> Column:
    """Starts (from 0) of windows of `target` words that overlap; the last one reaches the end. Null for no words."""
    step = target - min(overlap, target - 1)
    last = F.when(n <= target, F.lit(0)).otherwise(F.ceil((n - target) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))


def chunk_windows(docs: DataFrame, key: str | tuple[str, ...], text: Column, target: int = 512, overlap: int = 128) -> DataFrame:
    """(key, chunk_ord, first_word, n_words, text): overlapping windows of words, in order; key may be several columns."""
    keys = (key,) if isinstance(key, str) else key
    d = docs.select(*keys, words(text).alias("w"))
    d = d.select(*keys, "w", F.posexplode(window_starts(F.size("w"), target, overlap)).alias("chunk_ord", "first_word"))
    part = F.slice(F.col("w"), F.col("first_word") + 1, F.lit(target))
    return d.select(*keys, "chunk_ord", "first_word", F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))


def blocks(docs: DataFrame, key: str, text: Column, separator: str = "\n\n") -> DataFrame:
    """(key, block_ord, byte_start, byte_end, text): pieces between separators that aren't blank, trimmed, with byte offsets.

    Offsets come from the lengths of the pieces before, added up inside the row in Arrow batches: no
    shuffle, and time in proportion to the text. A task holds a batch of bounded bytes and up to
    BLOCK_ROWS blocks, or those of one text. Null texts have none.
    """
    bounded_batches(docs.sparkSession)
    step = len(separator.encode())
    rows = docs.select(key, text.cast("string").alias("text"))
    names = [key, "block_ord", "byte_start", "byte_end", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, order, start, end, pieces = [], [], [], [], []

            def flushed() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(order, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(pieces, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=names)

            for i, t in enumerate(batch.column(1)):
                at = n = 0
                for p in (t.as_py() or "").split(separator):
                    upto = at + len(p.encode())
                    if piece := p.strip(ASCII_SPACE):
                        row.append(i), order.append(n), start.append(at), end.append(upto), pieces.append(piece)
                        n += 1
                    at = upto + step
                if len(row) >= BLOCK_ROWS:
                    yield flushed()
                    row, order, start, end, pieces = [], [], [], [], []
            yield flushed()

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, block_ord int, byte_start long, byte_end long, text string")


def with_heading(rows: DataFrame, key: str, order: str, heading: str) -> DataFrame:
    """Adds `context`: the nearest heading at or before each row of its document."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("context", F.last(heading, ignorenulls=True).over(w))


def merged(blocks_: DataFrame, key: str, target: int = 512, order: str = "block_ord") -> DataFrame:
    """Consecutive blocks of a document joined greedily while their words stay within target; whole blocks only."""
    d = blocks_.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"), F.size(words(F.col("text"))).alias("n")))).alias("b"))
    zero = F.array().cast("array<struct<n:int,t:string,first:int>>")

    def add(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce(last["n"] + b["n"] <= target, F.lit(False))
        joined = F.struct((last["n"] + b["n"]).alias("n"), F.concat_ws("\n\n", last["t"], b["t"]).alias("t"), last["first"].alias("first"))
        fresh = F.struct(b["n"].cast("int").alias("n"), b["t"].alias("t"), b["o"].cast("int").alias("first"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    rows = d.select(key, F.posexplode(F.aggregate("b", zero, add)).alias("chunk_ord", "c"))
    return rows.select(key, "chunk_ord", F.col("c.first").alias("first_block"), F.col("c.n").alias("n_words"), F.col("c.t").alias("text"))


def sentence_chunks(rows: DataFrame, key: str, order: str, text: Column, target: int = 512, hard_max: int = 8192) -> DataFrame:
    """(key, order, piece, n_words, text): blocks of over target words cut between sentences; a sentence of over hard_max words is cut between words."""
    from lumenquarry.functions.text import sentences

    parts = sentences(text)
    pieces = F.flatten(
        F.transform(
            parts,
            lambda s: F.when(F.size(words(s)) <= hard_max, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(words(s)) - 1) / hard_max).cast("int")), lambda i: F.array_join(F.slice(words(s), i * hard_max + 1, F.lit(hard_max)), " "))),
        )
    )
    zero = F.array().cast("array<struct<n:int,t:string>>")

    def add(acc: Column, s: Column) -> Column:
        last, n = F.try_element_at(acc, F.lit(-1)), F.size(words(s))
        fits = F.coalesce(last["n"] + n <= target, F.lit(False))
        joined = F.struct((last["n"] + n).alias("n"), F.concat_ws(" ", last["t"], s).alias("t"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(F.struct(n.alias("n"), s.alias("t")))))

    d = rows.select(key, order, F.posexplode(F.aggregate(pieces, zero, add)).alias("piece", "c"))
    return d.select(key, order, "piece", F.col("c.n").alias("n_words"), F.col("c.t").alias("text"))
