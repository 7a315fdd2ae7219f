"""Best-two-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenquarry.llm.common import id_and_text, lean, saved, slices
from lumenquarry.llm.tokenizer import default_encoding, encode_batch

CAPACITY, END_ID = 1024, 2
#: Rows that a (length, salt) group of ranks holds on average at most, and the least number of salts.
SALT_ROWS, LEAST_SALTS = 1_000_000, 256
BATCH_BYTES = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lean
def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = default_encoding()
    for whole in batches:
        for batch in slices(whole, BATCH_BYTES):
            doc, piece, start, length, crc, ids_out = [], [], [], [], [], []
            for d, parts in zip(batch.column("doc_id").to_pylist(), encode_batch(enc, batch.column("text").to_pylist()), strict=True):
                ids = [*chain.from_iterable(parts), end_id]
                raw = memoryview(np.array(ids, "<u4").tobytes())
                # the first piece takes what is over, so that all others are whole sequences
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(d), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    if with_ids:
                        ids_out.append(ids[a:b])
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, add end_id, cut what is over capacity; with_ids keeps the ids themselves.

    Null or empty text: one piece of one token. Null ids and repeated rows stay; an empty table gives an
    empty table; other columns are not read.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: _pieces(it, capacity, end_id, with_ids), schema)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Best-two-fit on a histogram of lengths: (times, lengths in a bin) patterns that use every length up.

    A bin is filled greedily, largest first; then its smallest length gives way to the two unpacked
    ones that fill the widened gap best, if they fill it better. Equal lengths are interchangeable,
    so a bin is repeated as often as the counts allow: there are at most about
    capacity * ln(capacity) patterns, however many documents there are.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plans: list[tuple[int, list[int]]] = []

    def largest() -> np.ndarray:
        """At x: the largest unpacked length up to x (0: none)."""
        return np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    while left.any():
        below, gap, bin_ = largest(), capacity, []
        while gap and (x := int(below[gap])):
            use = int(min(left[x], gap // x))
            bin_ += [x] * use
            left[x] -= use
            gap -= x * use
            if not left[x]:
                below = largest()
        if gap and len(bin_) > 1:
            s = bin_[-1]
            room = gap + s
            firsts = np.flatnonzero(left[: room + 1])
            if len(firsts):
                below = largest()
                seconds = below[room - firsts]
                for i in np.flatnonzero((seconds == firsts) & (left[firsts] < 2)):
                    seconds[i] = below[firsts[i] - 1]
                both = np.where(seconds > 0, firsts + seconds, 0)
                best = len(both) - 1 - int(both[::-1].argmax())
                if both[best] > s:
                    bin_[-1:] = sorted((int(firsts[best]), int(seconds[best])), reverse=True)
                    left[s] += 1
                    left[firsts[best]] -= 1
                    left[seconds[best]] -= 1
        sizes, use = np.unique(bin_, return_counts=True)
        more = int((left[sizes] // use).min())
        left[sizes] -= more * use
        plans.append((1 + more, sorted(bin_, reverse=True)))
    return plans


def _places(plans: list[tuple[int, list[int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each run of equal lengths in a pattern: the ranks (by length) that it takes, and where they go."""
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for times, bin_ in plans:
        at = 0
        sizes, first, use = np.unique(-np.array(bin_), return_index=True, return_counts=True)
        for size, k in zip(-sizes, use, strict=True):
            rows.append((size, taken[size], k, sequence, at))
            taken[size] += times * k
            at += size * k
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (columns[0] << 48) + columns[1], "first": columns[1], "use": columns[2], "sequence": columns[3], "offset": columns[4]}


@lean
def _place(batches: Iterator[pa.RecordBatch], at: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        k = np.searchsorted(at["key"], (length << 48) + rank, "right") - 1
        over = rank - at["first"][k]
        use = at["use"][k]
        keep = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(at["sequence"][k] + over // use), pa.array(at["offset"][k] + over % use * length)],
            names=[*keep, "sequence_id", "offset"],
        )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of 1 to capacity.

    Only the histogram of lengths (capacity rows) reaches the driver; the plan goes back as a table
    bounded by the capacity. A row's rank among those of its length is counted within salted groups
    and added to the salts before, so no length, however frequent, meets in one task.
    """
    pieces = saved(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = _places(plan_bins(counts, capacity), capacity)
    salts = max(LEAST_SALTS, -(-sum(counts.values()) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    tally = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    tally = tally.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("rank", (rank - 1).cast("long")).join(tally, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("before")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(lambda it: _place(it, at), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack: one row per piece (doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids).

    Documents longer than capacity are cut; the first piece takes the remainder. A null or empty text
    is a piece of one token, end_id. Repeated rows are packed each on their own; null ids stay null.
    Ties between equal lengths are settled by salt, then doc_id and piece. An empty table gives no
    rows; columns other than the id and the text are not read.
    """
    return pack(token_pieces(docs, capacity, end_id, with_ids, id_col, text_col), capacity)
