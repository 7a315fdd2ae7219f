"""Removal of word windows that repeat from documents with smaller ids.

Every window of `length` words has an anchor: the gram of GRAM words in it with the least Rabin-Karp
hash (the leftmost, if equal). Equal windows have equal anchors, so a window can only repeat where
its anchor does. Consecutive windows with one anchor form a segment; a segment's hash stands for all
windows in it. Anchors are counted in Spark first, then the segments of repeated anchors, and
single windows only where an anchor's segments differ: every window is decided, few are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import dropped, id_and_text, lean, saved, slices
from lumenquarry.llm.words import Rolling, hashed_words

LENGTH, GRAM = 50, 16
SLICE_BYTES = 1 << 18
#: In a packed (hash, index) pair, the bits of the index.
INDEX_BITS = 28


class Segments:
    """Segments of a slice of texts: doc (row in the slice), first and last window, anchor, hash."""

    def __init__(self, texts: list[bytes], length: int):
        hashes, self.counts = hashed_words(texts)
        self.ends = np.cumsum(self.counts)
        self.rolling = Rolling(hashes)
        gram = min(GRAM, length)
        n = len(hashes) - gram + 1
        empty = np.zeros(0, np.int64)
        self.doc = self.first = self.last = empty
        self.anchor = self.hash = empty.astype(np.uint64)
        if len(hashes) < length:
            return
        grams = self.rolling(np.arange(n), gram)
        low = np.uint64((1 << INDEX_BITS) - 1)
        least, reach, width = (grams & ~low) | np.arange(n, dtype=np.uint64), 1, length - gram + 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        at = (least & low).astype(np.int64)
        window = np.arange(len(at))
        doc = np.searchsorted(self.ends, window, "right")
        ok = np.flatnonzero(window + length <= self.ends[np.minimum(doc, len(self.ends) - 1)])
        if not len(ok):
            return
        at, doc = at[ok], doc[ok]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        self.doc, self.first = doc[new], ok[new]
        self.last = ok[np.r_[new[1:] - 1, len(ok) - 1]]
        self.anchor = grams[at[new]]
        self.hash = self.rolling(self.first, self.last - self.first + length)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


@lean
def _segment_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            s = Segments(_texts(batch), length)
            once = np.lexsort((s.hash, s.doc))  # a document that repeats itself gives each segment once
            same = (s.doc[once][1:] == s.doc[once][:-1]) & (s.hash[once][1:] == s.hash[once][:-1])
            once = once[np.r_[True, ~same]] if len(once) else once
            s.anchor, s.hash, s.doc = s.anchor[once], s.hash[once], s.doc[once]
            yield pa.RecordBatch.from_arrays([pa.array(s.anchor.view(np.int64)), pa.array(s.hash.view(np.int64)), batch.column("doc_id").take(pa.array(s.doc))], names=["anchor", "segment", "doc_id"])


def _chosen(s: Segments, column: pa.Array) -> np.ndarray:
    """Segments whose hash is in their document's list."""
    lists = column.to_pylist()
    out = np.zeros(len(s.doc), bool)
    bounds = np.searchsorted(s.doc, np.arange(len(lists) + 1))
    for i, some in enumerate(lists):
        if some:
            a, b = bounds[i], bounds[i + 1]
            out[a:b] = np.isin(s.hash[a:b].view(np.int64), some)
    return out


def _windows(s: Segments, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the segments `which`, and the segment of each."""
    which = np.flatnonzero(which)
    n = s.last[which] - s.first[which] + 1
    seg = np.repeat(which, n)
    return np.repeat(s.first[which] - np.cumsum(n) + n, n) + np.arange(n.sum()), seg


@lean
def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            s = Segments(_texts(batch), length)
            window, seg = _windows(s, _chosen(s, batch.column("parts")))
            yield pa.RecordBatch.from_arrays([pa.array(s.anchor[seg].view(np.int64)), pa.array(s.rolling(window, length).view(np.int64)), batch.column("doc_id").take(pa.array(s.doc[seg]))], names=["anchor", "window", "doc_id"])


@lean
def _removals(batches: Iterator[pa.RecordBatch], length: int, with_text: bool, carried: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            texts = _texts(batch)
            s = Segments(texts, length)
            cover = np.zeros(int(s.ends[-1]) + 1, np.int32)
            gone = np.flatnonzero(_chosen(s, batch.column("wholes")))
            np.add.at(cover, s.first[gone], 1)
            np.add.at(cover, s.last[gone] + length, -1)
            window, seg = _windows(s, _chosen(s, batch.column("parts")))
            if len(window):
                hashes, lists = s.rolling(window, length).view(np.int64), batch.column("windows").to_pylist()
                bounds = np.searchsorted(s.doc[seg], np.arange(len(lists) + 1))
                for i, some in enumerate(lists):
                    if some:
                        a, b = bounds[i], bounds[i + 1]
                        hit = window[a:b][np.isin(hashes[a:b], some)]
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + length, -1)
            removed = np.cumsum(cover)[:-1] > 0
            n_removed, kept, spans = [], [], []
            for text, a, b in zip(texts, s.ends - s.counts, s.ends, strict=True):
                words, mask = text.split(), removed[a:b]
                n_removed.append(int(mask.sum()))
                kept.append(b" ".join(compress(words, ~mask) if n_removed[-1] else words))
                edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
                spans.append([{"first": x, "last": y - 1} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            columns = [batch.column("doc_id"), pa.array(s.counts), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                kept_text = [k.decode() if r else t.decode() for k, t, r in zip(kept, texts, n_removed, strict=True)]
                columns += [pa.array(kept_text, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
                names += ["kept", "removed"]
            for c in range(carried):
                columns.append(batch.column(f"carried{c}"))
                names.append(f"carried{c}")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def substring_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256; with_text adds the kept text (as it was, if nothing goes) and the
    maximal removed intervals (word numbers); carry names columns of docs that come along.

    A word goes if a window of `length` words over it also starts in a document with a smaller id;
    windows are those of the input. Null text: no words. Texts under `length` words keep all. Rows
    with a null id, or with equal ids, neither remove from each other nor lose words to each other
    (a null id is smaller than none and larger than none). Repeated rows each give a row. An empty
    table gives an empty table; other columns are not read.
    """
    carried = [F.col(c).alias(f"carried{i}") for i, c in enumerate(carry)]
    full_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carried)
    rows = full_rows.select("doc_id", "text") if carry else id_and_text(docs, id_col, text_col)
    segments = rows.where("doc_id is not null").mapInArrow(lambda it: _segment_rows(it, length), "anchor long, segment long, doc_id long")
    anchors = segments.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("segment").alias("s0"), F.max("segment").alias("s1"))
    # a table of its own: the joins below then read plain exchanges, which Spark splits where a key is hot
    anchors = saved(anchors.where("lo < hi").select("anchor", "lo", (F.col("s0") == F.col("s1")).alias("same")), "anchors")
    repeated = saved(segments.join(anchors.hint("shuffle_merge"), "anchor").where("not same or doc_id > lo"), "repeated")
    whole = repeated.where("same").select("doc_id", "segment", F.lit(True).alias("whole"))
    differing = repeated.where("not same").select("anchor", "segment", "doc_id")
    first = saved(differing.groupBy("anchor", "segment").agg(F.min("doc_id").alias("lo")), "first")
    decided = differing.join(first.hint("shuffle_merge"), ["anchor", "segment"]).select("doc_id", "segment", (F.col("doc_id") > F.col("lo")).alias("whole"))
    marks = whole.unionByName(decided).groupBy("doc_id").agg(F.collect_set(F.when(F.col("whole"), F.col("segment"))).alias("wholes"), F.collect_set(F.when(~F.col("whole"), F.col("segment"))).alias("parts"))
    marks = saved(marks, "marks")
    dropped(anchors, repeated, first)
    some = rows.join(marks.where(F.size("parts") > 0).select("doc_id", "parts").hint("shuffle_merge"), "doc_id")
    windows = some.mapInArrow(lambda it: _window_rows(it, length), "anchor long, window long, doc_id long")
    least = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    gone = windows.join(least.hint("shuffle_merge"), ["anchor", "window"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    full = (full_rows if carry else rows).join(marks.hint("shuffle_merge"), "doc_id", "left").join(gone.hint("shuffle_merge"), "doc_id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, removed array<struct<first:long,last:long>>" if with_text else "")
    names = [f"carried{i}" for i in range(len(carry))]
    schema += "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))
    out = full.select("doc_id", "text", "wholes", "parts", "windows", *names).mapInArrow(lambda it: _removals(it, length, with_text, len(carry)), schema)
    return out.withColumnsRenamed(dict(zip(names, carry, strict=True)))
