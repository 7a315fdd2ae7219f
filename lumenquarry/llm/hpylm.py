"""Language-model scores from a hierarchical Pitman-Yor model.

A context is the word before (or the start of a text) and has a restaurant over words; all of them
share one parent restaurant, whose base is uniform over the training words and one unknown word. The
tables of the contexts are the customers of the parent. Seatings are sampled by Gibbs: one customer at
a time leaves the table and is seated anew, at a table of the same word or at a new one; of words with
many customers in a restaurant all are seated at once. Predictive
probabilities are averaged over the last samples.

How it is laid out: texts become chunks of about CHUNK_TOKENS tokens, written once as word numbers. A
chunk sends its distinct pairs of words, with their training counts, to the buckets that the pairs'
hashes name, as sorted, packed arrays; a bucket holds all that is known of its pairs, seats them, and
answers each chunk in the order it asked in. No pair moves as a row, and a frequent pair is one entry
a chunk. The HOT most frequent words have short numbers and their statistics are broadcast; all others
go by their hashes and are joined.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import dropped, dropped_kind, id_and_text, lean, packed, saved, slices, unpacked
from lumenquarry.llm.words import hashed_words, mixed

U = np.uint64
#: Folds by the id's crc32, and the one that is held out.
FOLDS, HELD_OUT = 7, 2
#: The end of a text, in place of a word's hash; as the word before, the start of a text.
END = np.uint64(0xE0D5C3B1A79F8D6B)
STRENGTH = 1.0
#: Words with short numbers (under 100 bytes each in broadcasts), bits of such a number.
HOT, BITS = 1 << 18, 18
#: Tokens of a chunk (a longer text is one of its own); entries of a bucket, on average.
CHUNK_TOKENS, BUCKET_ENTRIES = 1 << 19, 1 << 19
SLICE_BYTES = 1 << 20
#: Distinct words that a task gathers before it hands them on.
GATHERED = 1_000_000
#: Passes over all pairs that measure the restaurants; sweeps before the first sample; samples whose probabilities are averaged.
PASSES, BURN_IN, SAMPLES, SEED = 1, 1, 2, 5
#: Words of up to so many customers in a restaurant are seated one customer at a time, of more all at once; weights are stored for each number of customers up to EXACT.
RESEATED, EXACT = 32, 1024
#: Log-weights that are so far below the greatest one are left out of a draw.
NEGLIGIBLE = 40.0
#: Hot words in a row of sums; pairs that are scored at once.
BLOCK = 1 << 14


def in_training(doc_ids: list[int | None]) -> np.ndarray:
    """A null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % FOLDS != HELD_OUT for d in doc_ids], bool)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (each text ends in END) and the number of tokens of each text."""
    hashes, counts = hashed_words(texts, lower=True)
    token = np.full(len(hashes) + len(texts), END)
    token[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts)] = hashes
    return token, counts + 1


# words


@lean
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, training tokens, other tokens); the other tokens are counted as one sum, with END."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held, other = 0, 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        word, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return word, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(word: np.ndarray, n: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(more)], names=["word", "n", "other"])

    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            train = in_training(batch.column("doc_id").to_pylist())
            token, counts = tokens_of(batch.column("text").cast(pa.binary()).to_pylist())
            use = np.repeat(train, counts)
            other += int((~use).sum())
            parts.append(np.unique(token[use], return_counts=True))
            held += len(parts[-1][0])
            if held > GATHERED:
                parts = [reduced()]
                held = len(parts[0][0])
                if held > GATHERED // 2:
                    yield rows(*parts[0], np.zeros(held, np.int64))
                    parts, held = [], 0
    if parts:
        word, n = reduced()
        yield rows(word, n, np.zeros(len(word), np.int64))
    if other:
        yield rows(np.array([END]), np.zeros(1, np.int64), np.array([other]))


class HotWords:
    """Numbers of the most frequent words: the more frequent, the smaller."""

    def __init__(self, word: np.ndarray):
        order = np.argsort(word)
        self.word, self.number = word[order], order.astype(np.int32)

    def __len__(self) -> int:
        return len(self.word)

    def numbers(self, word: np.ndarray) -> np.ndarray:
        """-1 for other words."""
        if not len(self.word):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[at] == word, self.number[at], -1).astype(np.int64)


# chunks


class Pairs:
    """Distinct pairs (word before, word) of a chunk, dealt to buckets in the order that questions and answers have."""

    def __init__(self, code: np.ndarray, cold: np.ndarray, hot: int, ends: np.ndarray, buckets: int):
        """code: numbers of the words, from `hot` on places in `cold`; ends: where texts end (with END, the last word of all)."""
        width = hot + len(cold)
        before = np.empty_like(code)
        before[1:] = code[:-1]
        before[np.r_[0, ends[:-1]]] = code[-1]
        pair, self.inverse = np.unique(before * width + code, return_inverse=True)
        prev, word = pair // width, pair % width
        size = len(pair)
        del before, pair  # such arrays are most of what a task holds
        known = (prev < hot) & (word < hot)
        name = np.zeros(size, np.uint64)
        name[known] = (prev[known] << BITS | word[known]).astype(np.uint64)
        rare = np.flatnonzero(~known)
        self.hashes = np.zeros((2, size), np.int64)  # of a frequent word its number; it is marked as such by sign: see sent()
        for side, codes in enumerate((prev[rare], word[rare])):
            is_hot = codes < hot
            value = codes.copy()
            if len(cold):
                value[~is_hot] = cold[codes[~is_hot] - hot]
            self.hashes[side, rare] = value
        mark = (prev[rare] < hot).astype(np.uint64) + U(2) * (word[rare] < hot).astype(np.uint64)
        name[rare] = mixed(self.hashes[0, rare].view(np.uint64) + mark * U(0x9E3779B97F4A7C15)) + self.hashes[1, rare].view(np.uint64)
        self.mark = np.zeros(size, np.int64)
        self.mark[rare] = mark.astype(np.int64)
        bucket = (mixed(name) % U(buckets)).astype(np.int64)
        # pairs are in order within a bucket: those of hot words first, then the others; 16 bits are sorted in linear time
        order = np.argsort((2 * bucket + ~known).astype(np.uint16 if 2 * buckets <= 1 << 16 else np.int64), kind="stable")
        self.prev, self.word, self.known, self.name, self.order = prev[order], word[order], known[order], name[order], order
        self.hashes, self.mark = self.hashes[:, order], self.mark[order]
        bucket = bucket[order]
        self.first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        self.bucket = bucket[self.first]

    def sent(self, n: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
        """For each bucket: names of pairs of hot words (as differences), their counts; marks, hashes, counts of the others."""
        n = n[self.order]
        for b, a, z in zip(self.bucket.tolist(), self.first.tolist(), [*self.first[1:].tolist(), len(self.order)], strict=True):
            m = a + int(self.known[a:z].sum())
            keys = np.diff(self.name[a:m].astype(np.int64), prepend=0)
            yield b, [packed(keys), packed(n[a:m]), packed(self.mark[m:z]), *(packed(self.hashes[side, m:z].view(np.uint64)) for side in (0, 1)), packed(n[m:z])]


CHUNKS = "kind string, chunk long, bucket long, ids array<long>, counts array<long>, cold array<long>, data array<binary>"


@lean
def _chunks(batches: Iterator[pa.RecordBatch], hot: HotWords, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk: its texts as word numbers, and what it asks of each bucket."""
    part, made = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    schema = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids", "counts", "cold")), ("data", pa.list_(pa.binary()))])

    def chunk() -> Iterator[pa.RecordBatch]:
        nonlocal made, ids, held, size
        token, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        word, at = np.unique(token, return_inverse=True)
        number = hot.numbers(word.view(np.int64))
        cold = word[number < 0].view(np.int64)
        number[number < 0] = len(hot) + np.arange(len(cold))
        code = number[at]
        pairs = Pairs(code, cold, len(hot), np.cumsum(counts), buckets)
        n = np.bincount(pairs.inverse, weights=np.repeat(in_training(ids), counts), minlength=len(pairs.order)).astype(np.int64)
        name = (part << 32) + made
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((["text"], [name], [None], [ids], [counts], [cold], [[packed(code)]]), schema, strict=True)], schema=schema)
        asked = list(pairs.sent(n))
        for a in range(0, len(asked), 256):
            some = asked[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((["pairs"] * len(some), [name] * len(some), [b for b, _ in some], *([None] * len(some) for _ in range(3)), [d for _, d in some]), schema, strict=True)], schema=schema)
        made, ids, held, size = made + 1, [], [], 0

    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            held.append(tokens_of(batch.column("text").cast(pa.binary()).to_pylist()))
            ids += batch.column("doc_id").to_pylist()
            size += len(held[-1][0])
            if size >= CHUNK_TOKENS:
                yield from chunk()
    if held and ids:
        yield from chunk()


# seating


def seated(n: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after n customers of a word have come in turn; new: weight of a new table, against 1 for a customer less `discount` a table.

    A start for the sampling. Beyond 16 customers they come in groups of a sixteenth of those seated.
    n is sorted, largest first.
    """
    tables, i = np.ones(len(n)), 1
    live = int(np.searchsorted(-n, -1, "left"))
    while live:
        group = np.minimum(max(1, i // 16), n[:live] - i)
        odds = new[:live] / (np.maximum(i - discount * tables[:live], 0) + new[:live])
        tables[:live] += np.floor(group * odds + rng.random(live))
        i += max(1, i // 16)
        live = int(np.searchsorted(-n, -i, "left"))
    return np.minimum(tables, n).astype(np.int64)


def _ratios(r: np.ndarray, n: int, discount: float) -> None:
    """From S(n, t) / S(n, t - 1), t from 2, to those of n + 1; S(n, t) weighs all seatings of n customers at t tables (generalized Stirling numbers)."""
    k = min(n, len(r))
    t = np.arange(2, k + 2)
    below = np.empty(k)
    below[0], below[1:] = 0, 1 / r[: k - 1]
    r[:k] = (1 + (n - discount * t) * r[:k]) / (below + n - discount * (t - 1))


@lru_cache(maxsize=2)
def _small_sums(discount: float) -> tuple[list[np.ndarray], np.ndarray]:
    """For n up to EXACT: log S(n, t) less log S(n, 1), t from 1 to n; and the ratios of EXACT."""
    r, out = np.zeros(EXACT), [np.zeros(0), np.zeros(1)]
    for n in range(1, EXACT):
        _ratios(r, n, discount)
        out.append(np.r_[0, np.cumsum(np.log(r[:n]))])
    return out, r


def _tables_of(sums: np.ndarray, new: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """Tables for rows of one number of customers; None: with so few numbers of tables weights are missing."""
    out = np.empty(len(new), np.int64)
    step = max(1, (1 << 20) // len(sums))
    for a in range(0, len(new), step):
        weight = sums + np.log(new[a : a + step])[:, None] * np.arange(len(sums))
        weight -= weight.max(1, keepdims=True)
        if (weight[:, -1] > -NEGLIGIBLE).any():
            return None
        upto = np.cumsum(np.exp(weight), 1)
        out[a : a + step] = 1 + (upto[:, :-1] < (rng.random(len(upto)) * upto[:, -1])[:, None]).sum(1)
    return out


class Ratios:
    """Ratios of more than EXACT customers (see `_ratios`), in place, from the nearest number below that is kept: some hundred stops at most, and the last one asked for."""

    def __init__(self, discount: float, width: int):
        r = np.zeros(max(width, EXACT))
        r[:EXACT] = _small_sums(discount)[1]
        self.at, self.kept = [EXACT], [r[:width].copy()]
        self.now, self.r = EXACT, r[:width].copy()
        t = np.arange(2, width + 2)
        self.here, self.below = discount * t, discount * (t - 1)
        self.room = np.empty(width), np.zeros(width)
        self.told: dict[int, np.ndarray] = {}

    def walk(self, n: int) -> np.ndarray:
        i = bisect.bisect_right(self.at, n) - 1
        if not self.at[i] <= self.now <= n:
            self.now, self.r[:] = self.at[i], self.kept[i]
        k = -1
        while self.now < n:
            if k != min(self.now, len(self.r)):
                k = min(self.now, len(self.r))
                r, here, below, up, down = (x[:k] for x in (self.r, self.here, self.below, *self.room))
                before, down_but_first = r[:-1], down[1:]
            np.subtract(self.now, here, out=up)
            up *= r
            up += 1
            np.divide(1, before, out=down_but_first)
            down[0] = 0
            down += self.now
            down -= below
            np.divide(up, down, out=r)
            self.now += 1
            if self.now >= self.at[-1] + max(256, self.at[-1] // 64):
                self.at.append(self.now), self.kept.append(self.r.copy())
        return self.r

    def sums(self, n: int) -> np.ndarray:
        """log S(n, t) less log S(n, 1); those of the same n are asked for again in the next sample."""
        if n not in self.told:
            if len(self.told) * len(self.r) >= 1 << 18:
                self.told.clear()
            sums = np.r_[0, np.cumsum(np.log(self.walk(n)[: n - 1]))]
            self.told[n] = np.r_[sums, -np.inf] if n - 1 <= len(self.r) else sums
        return self.told[n]


_far = lru_cache(maxsize=8)(Ratios)


def _sums_of(n: int, discount: float, width: int) -> np.ndarray:
    """log S(n, t) less log S(n, 1) for t up to width + 1; if those are all, a weight of none follows."""
    return np.r_[_small_sums(discount)[0][n], -np.inf] if n <= EXACT else _far(discount, width).sums(n)


def drawn(n: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator, width: int = 256) -> np.ndarray:
    """Tables of n > 0 customers, all of them seated anew: t tables have the weight new**t * S(n, t).

    Rows whose numbers of tables go beyond `width` are drawn with more.
    """
    out = np.empty(len(n), np.int64)
    order = np.argsort(n, kind="stable")
    cuts = np.flatnonzero(np.diff(n[order])) + 1
    for rows in np.split(order, cuts) if len(n) else []:
        wide, got = width, None
        while got is None:
            got = _tables_of(_sums_of(int(n[rows[0]]), discount, wide), new[rows], rng)
            wide *= 4
        out[rows] = got
    return out


class Seating:
    """Tables of words in restaurants, one row per (restaurant, word), sampled; every sweep seats all customers.

    A row's conditional depends on its own seats and on `new`, the weight of a new table (strength and
    discounted tables of the restaurant, times the parent's probability of the word), which is held
    fixed within a pass. Rows with one customer have one table; they are not touched. Of rows of up to
    RESEATED one customer at a time leaves and is seated; of more the tables are drawn from their whole
    distribution, without a chain.
    """

    def __init__(self, n: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator):
        self.total, self.discount, self.rng = len(n), discount, rng
        self.whole = np.flatnonzero(n > RESEATED)
        self.of_whole = n[self.whole], new[self.whole]
        several = np.flatnonzero((n > 1) & (n <= RESEATED))
        self.row = several[np.argsort(-n[several], kind="stable")]
        self.n, self.new = n[self.row], new[self.row]
        self.tables = seated(self.n, self.new, discount, rng)
        self.single = (n > 0).astype(np.int64)
        self._room(np.minimum(self.n, self.tables + self.tables // 4 + 3))
        owner = np.repeat(np.arange(len(self.row)), self.tables)
        share = rng.exponential(size=len(owner))
        share /= np.bincount(owner, weights=share, minlength=len(self.row))[owner]
        size = 1 + np.floor(share * (self.n - self.tables)[owner]).astype(np.int64)
        self.size[self.at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(self.tables) - self.tables, self.tables)] = size
        self.size[self.at] += self.n - np.bincount(owner, weights=size, minlength=len(self.row)).astype(np.int64)

    def _room(self, room: np.ndarray, old: np.ndarray | None = None) -> None:
        """Places for `room` tables of each row; the tables that are taken move along."""
        at = np.cumsum(room) - room
        size = np.zeros(int(room.sum()), np.int64)
        if old is not None:
            turn = np.arange(int(self.tables.sum())) - np.repeat(np.cumsum(self.tables) - self.tables, self.tables)
            size[np.repeat(at, self.tables) + turn] = old[np.repeat(self.at, self.tables) + turn]
        self.at, self.room, self.size = at, room, size

    def sweep(self) -> None:
        for step in range(RESEATED):
            m = int(np.searchsorted(-self.n, -step, "left"))  # rows of more than `step` customers
            if not m:
                return
            if ((self.tables[:m] >= self.room[:m]) & (self.room[:m] < self.n[:m])).any():
                self._room(np.minimum(self.n, np.where(self.tables >= self.room, self.room * 2, self.room)), self.size)
            end = int(self.at[m - 1] + self.room[m - 1])
            at, tables, size = self.at[:m], self.tables[:m], self.size
            upto = np.r_[0, np.cumsum(size[:end])]
            leave = np.searchsorted(upto, upto[at] + (self.rng.random(m) * self.n[:m]).astype(np.int64), "right") - 1
            size[leave] -= 1
            empty = np.flatnonzero(size[leave] == 0)  # its last table takes the place of one that is left empty
            last = at[empty] + tables[empty] - 1
            size[leave[empty]] = size[last]
            size[last] = 0
            tables[empty] -= 1
            old = np.maximum(self.n[:m] - 1 - self.discount * tables, 0)
            chance = self.rng.random(m) * (old + self.new[:m])
            joins = chance < old
            weight = np.r_[0, np.cumsum(np.maximum(size[:end] - self.discount, 0))]
            to = np.searchsorted(weight, weight[at] + chance, "right") - 1
            to = np.where(joins, np.clip(to, at, at + np.maximum(tables - 1, 0)), at + tables)
            size[to] += 1
            tables += ~joins

    def sample(self) -> np.ndarray:
        out = self.single.copy()
        out[self.row] = self.tables
        out[self.whole] = drawn(*self.of_whole, self.discount, self.rng)
        return out


class Sizes:
    """What a seating needs to know: of hot words, the tables in their restaurants and their probability in the parent; of all others the means."""

    def __init__(self, tables: np.ndarray, tables_else: float, parent: np.ndarray, parent_else: float, discount: float, above: tuple[float, float, float, float]):
        self.tables, self.parent = np.r_[tables, tables_else], np.r_[parent, parent_else]  # -1 is all others
        self.discount = discount
        #: Discount of the parent, its customers, its tables, its base.
        self.above = above

    def new(self, prev: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (STRENGTH + self.discount * self.tables[prev]) * self.parent[word]


def in_parent(customers: np.ndarray, tables: np.ndarray, above: tuple[float, float, float, float]) -> np.ndarray:
    """Probability of words with so many customers and tables in the parent."""
    discount, all_customers, all_tables, base = above
    return (customers - discount * tables + (STRENGTH + discount * all_tables) * base) / (STRENGTH + all_customers)


# buckets


MERGED = "bucket long, pairs array<binary>, chunks array<long>, places array<binary>"
_MERGED = pa.schema([("bucket", pa.int64()), ("pairs", pa.list_(pa.binary())), ("chunks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])


def merged(asked: list[list[bytes]]) -> tuple[list[bytes], list[bytes]]:
    """From what chunks ask of a bucket (see Pairs.sent): its distinct pairs with their training counts; for each chunk the places of its questions among them."""
    names = [np.cumsum(unpacked(d[0])) for d in asked]
    name, at_hot = np.unique(np.concatenate(names), return_inverse=True)
    n_hot = np.bincount(at_hot, weights=np.concatenate([unpacked(d[1]) for d in asked]), minlength=len(name))
    marks = [unpacked(d[2]) for d in asked]
    mark = np.concatenate(marks)
    prev, word = (np.concatenate([unpacked(d[i]) for d in asked]) for i in (3, 4))
    order = np.lexsort((word, prev, mark))
    mark, prev, word = mark[order], prev[order], word[order]
    new = np.r_[True, (mark[1:] != mark[:-1]) | (prev[1:] != prev[:-1]) | (word[1:] != word[:-1])][: len(mark)]
    at_rare = np.empty(len(mark), np.int64)
    at_rare[order] = np.cumsum(new) - 1 + len(name)
    n_rare = np.bincount(at_rare - len(name), weights=np.concatenate([unpacked(d[5]) for d in asked]), minlength=int(new.sum()))
    places, a, b = [], 0, 0
    for x, y in zip(map(len, names), map(len, marks), strict=True):
        places.append(packed(np.r_[at_hot[a : a + x], at_rare[b : b + y]]))
        a, b = a + x, b + y
    n = np.r_[n_hot, n_rare].astype(np.int64)
    return [packed(np.diff(name, prepend=0)), packed(mark[new]), packed(prev[new].view(np.uint64)), packed(word[new].view(np.uint64)), packed(n)], places


@lean
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket and chunk: one row a bucket."""
    number, chunks, asked = None, [], []

    def out() -> pa.RecordBatch:
        pairs, places = merged(asked)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, pairs, chunks, places), _MERGED, strict=True)], schema=_MERGED)

    for batch in batches:
        for b, chunk, data in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
            if asked and b != number:
                yield out()
                chunks, asked = [], []
            number = b
            chunks.append(chunk), asked.append(data.as_py())
    if asked:
        yield out()


class Bucket:
    """Distinct pairs of a bucket with their training counts."""

    def __init__(self, pairs: list[bytes]):
        name = np.cumsum(unpacked(pairs[0]))
        mark, prev, word, self.n = (unpacked(x) for x in pairs[1:])
        #: Numbers of hot words, -1 for others; hashes of the others, 0 for hot words.
        self.prev = np.r_[name >> BITS, np.where(mark & 1, prev, -1)]
        self.word = np.r_[name & ((1 << BITS) - 1), np.where(mark & 2, word, -1)]
        self.prev_hash = np.r_[np.zeros(len(name), np.int64), np.where(mark & 1, 0, prev)]
        self.word_hash = np.r_[np.zeros(len(name), np.int64), np.where(mark & 2, 0, word)]


#: Of each sample: tables that a word is on, tables in its restaurant.
SIDES = [f"{side}{k}" for k in range(SAMPLES) for side in ("on", "inside")]
_SUMS = pa.schema([("kind", pa.string()), ("block", pa.int32()), ("word", pa.int64()), ("data", pa.list_(pa.binary())), ("chunk", pa.int64()), ("bucket", pa.int64()), ("sums", pa.list_(pa.int64())), *((s, pa.int32()) for s in SIDES)])
SUMS = "kind string, block int, word long, data array<binary>, chunk long, bucket long, sums array<long>, " + ", ".join(f"{s} int" for s in SIDES)


def _sum_rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _SUMS], schema=_SUMS)


@lean
def _seat_buckets(batches: Iterator[pa.RecordBatch], hot: int, sizes: Sizes | None, turn: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Seat all pairs; without sizes, one table for each. Sums over words: tables that they are on (as customers of the parent) and tables in their restaurants.

    last: SAMPLES samples, sums of the words that are not hot too, and the answers to the chunks.
    """
    samples = SAMPLES if last else 1
    on, inside = np.zeros((samples, hot), np.int64), np.zeros((samples, hot), np.int64)
    pairs = ones = twos = 0
    for batch in batches:
        for i, number in enumerate(batch.column("bucket").to_pylist()):
            b = Bucket(batch.column("pairs")[i].as_py())
            pairs, ones, twos = pairs + int((b.n > 0).sum()), ones + int((b.n == 1).sum()), twos + int((b.n == 2).sum())
            if sizes is None:
                drawn = [(b.n > 0).astype(np.int64)]
            else:
                s = Seating(b.n, sizes.new(b.prev, b.word), sizes.discount, np.random.default_rng([SEED, turn, number]))
                drawn = []
                for _ in range(BURN_IN):
                    s.sweep()
                for _ in range(samples):
                    s.sweep()
                    drawn.append(s.sample())
            for k, t in enumerate(drawn):
                for out, names in ((on, b.word), (inside, b.prev)):
                    use = names >= 0
                    np.add.at(out[k], names[use], t[use])
            if not last:
                continue
            rare = []  # (hash, tables on or inside) of the words that are not hot
            for side, hashes, names in ((0, b.word_hash, b.word), (1, b.prev_hash, b.prev)):
                use = np.flatnonzero((names < 0) & (b.n > 0))
                values = np.zeros((len(use), 2 * samples), np.int32)
                values[:, side::2] = np.stack([t[use] for t in drawn], 1)
                rare.append((hashes[use], values))
            word, at = np.unique(np.concatenate([h for h, _ in rare]), return_inverse=True)
            sums = np.zeros((len(word), 2 * samples), np.int32)
            np.add.at(sums, at, np.concatenate([v for _, v in rare]))
            if len(word):
                given = {"kind": pa.repeat("rare", len(word)), "word": pa.array(word)} | {s: pa.array(sums[:, i]) for i, s in enumerate(SIDES)}
                yield pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(len(word), f.type)) for f in _SUMS], schema=_SUMS)
            tables = np.stack(drawn)
            chunks, places = (batch.column(c)[i].as_py() for c in ("chunks", "places"))
            for a in range(0, len(chunks), 64):
                told = []
                for place in places[a : a + 64]:
                    at = unpacked(place)
                    several = at[b.n[at] > 1]
                    told.append([packed(b.n[at]), *(packed(t[several]) for t in tables)])
                yield _sum_rows(kind=["answer"] * len(told), chunk=chunks[a : a + 64], bucket=[number] * len(told), data=told)
    yield _sum_rows(kind=["all"], sums=[[pairs, ones, twos]])
    if pairs:
        for a in range(0, hot, BLOCK):
            yield _sum_rows(kind=["hot"], block=[a // BLOCK], data=[[packed(x[a : a + BLOCK]) for k in range(samples) for x in (on[k], inside[k])]])


@lean
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the packed arrays of each block, from rows sorted by block."""
    block, total = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([[packed(x) for x in total]], pa.list_(pa.binary()))], names=["block", "data"])
    for batch in batches:
        for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if b != block:
                if total is not None:
                    yield out()
                block, total = b, [np.int64(0)] * len(data)
            total = [t + unpacked(d) for t, d in zip(total, data, strict=True)]
    if total is not None:
        yield out()


def _hot_sums(sums: DataFrame, hot: int, samples: int) -> np.ndarray:
    """(2 * samples, hot): what `_seat_buckets` summed for hot words; at most HOT numbers each."""
    rows = sums.where("kind = 'hot'").select("block", "data").repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block int, data array<binary>").collect()
    out = np.zeros((2 * samples, hot))
    for r in rows:
        for k, d in enumerate(r["data"]):
            part = unpacked(bytes(d))
            out[k, r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out


def _parent_tables(customers: np.ndarray, above: tuple[float, float, float, float], turn: int) -> np.ndarray:
    """Tables of words in the parent, sampled."""
    discount, _, all_tables, base = above
    customers = customers.astype(np.int64)
    s = Seating(customers, np.full(len(customers), (STRENGTH + discount * all_tables) * base), discount, np.random.default_rng([SEED, turn]))
    for _ in range(BURN_IN + 1):
        s.sweep()
    return s.sample()


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


class PitmanYor:
    """The fitted model: statistics of hot words as arrays, of all others as a table, and what the buckets answer to the chunks."""

    def __init__(self, hot: HotWords, count: np.ndarray, tokens: int, words: int, discount: float, inside: np.ndarray, parent: np.ndarray, above: list[tuple[float, float, float, float]]):
        self.hot, self.count, self.tokens, self.words, self.discount = hot, count, tokens, words, discount
        #: (SAMPLES, hot): tables in the words' restaurants, probabilities in the parent.
        self.inside, self.parent, self.above = inside, parent, above

    def probability(self, n: np.ndarray, tables: np.ndarray, guests: np.ndarray, inside: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Mean over samples; n: the pair's customers; tables: its tables; guests, inside: customers and tables of its context."""
        from_here = n - self.discount * tables
        return ((from_here + (STRENGTH + self.discount * inside) * parent) / (STRENGTH + guests)).mean(0)


# scores

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@lean
def _scores(batches: Iterator[pa.RecordBatch], model: PitmanYor, buckets: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by chunk: what is known of its rare words (or no row), the buckets' answers, then its texts."""
    hot = len(model.hot)
    known, told = None, {}
    for batch in batches:
        for i, turn in enumerate(batch.column("turn").to_pylist()):
            data = batch.column("data")[i].as_py()
            if turn == 0:
                known = data
                continue
            if turn == 1:
                told[batch.column("bucket")[i].as_py()] = data
                continue
            code, ids = unpacked(data[0]), batch.column("ids")[i].as_py()
            counts, cold = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("counts", "cold"))
            pairs = Pairs(code, cold, hot, np.cumsum(counts), buckets)
            pairs.hashes = pairs.mark = pairs.name = None
            word, n, *others = (unpacked(x) for x in known or [packed(np.zeros(0, np.int64))] * (2 + len(RARE)))
            at = hot + np.searchsorted(cold.view(np.uint64), word.view(np.uint64))
            size = hot + len(cold)  # words that training doesn't hold have no row, and the probability of an unknown word
            count, inside, parent = np.zeros(size), np.zeros((SAMPLES, size)), np.empty((SAMPLES, size))
            count[:hot], count[at], inside[:, :hot], parent[:, :hot] = model.count, n, model.inside, model.parent
            for k in range(SAMPLES):
                parent[k, hot:] = in_parent(0.0, 0.0, model.above[k])
                on, inside[k, at], tables = others[3 * k : 3 * k + 3]
                parent[k, at] = in_parent(on, tables, model.above[k])
            n, several = [], [[] for _ in range(SAMPLES)]
            for b in pairs.bucket.tolist():
                data = told.pop(b)
                n.append(unpacked(data[0]))
                for k in range(SAMPLES):
                    several[k].append(unpacked(data[1 + k]))
            n = np.concatenate(n)
            seats = np.tile((n > 0).astype(float), (SAMPLES, 1))
            for k in range(SAMPLES):
                seats[k, n > 1] = np.concatenate(several[k])
            p = np.empty(len(n))
            for a in range(0, len(n), BLOCK):
                z = slice(a, a + BLOCK)
                prev, after = pairs.prev[z], pairs.word[z]
                p[pairs.order[z]] = np.log10(model.probability(n[z], seats[:, z], count[prev], inside[:, prev], parent[:, after]))
            owner = np.repeat(np.arange(len(counts)), counts)
            total = lambda x, owner=owner, m=len(counts): np.bincount(owner, weights=x, minlength=m)
            base = np.log10((count + 1) / (model.tokens + model.words + 1))
            held = ~in_training(ids)
            known, told = None, {}
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held), pa.array(counts, pa.int64()), pa.array(total(count[code] > 0).astype(np.int64)), pa.array(total(base[code])), pa.array(total(p[pairs.inverse]))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )


@lean
def _rare_parents(batches: Iterator[pa.RecordBatch], above: list[tuple[float, float, float, float]]) -> Iterator[pa.RecordBatch]:
    """Add each word's tables in the parent, sampled."""
    for batch in batches:
        columns = [batch.column("word"), batch.column("n")]
        for k in range(SAMPLES):
            columns += [batch.column(f"on{k}"), batch.column(f"inside{k}"), pa.array(_parent_tables(batch.column(f"on{k}").to_numpy(), above[k], 1000 + k))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", *RARE])


#: Of each sample: a word's customers in the parent, tables in its own restaurant, tables in the parent.
RARE = [f"{side}{k}" for k in range(SAMPLES) for side in ("on", "inside", "tables")]


@lean
def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by chunk: one row a chunk, with the columns word, n and RARE as packed arrays."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        columns = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(1, held[0].num_columns)]
        return pa.RecordBatch.from_arrays([held[0].column(0).slice(0, 1), pa.array([[packed(x.view(np.uint64)) for x in columns]], pa.list_(pa.binary()))], names=["chunk", "data"])

    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and b > a and held[0].column(0)[0].as_py() != chunk[a]:
                yield out()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield out()


def score_texts(docs: DataFrame, hot_words: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the documents whose fold isn't held out and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    base_score is the add-one unigram log10 probability, score that of the Pitman-Yor model;
    perplexity is 10 ** (-score / n_tokens). All pairs of words of all training texts are counted
    exactly. While seats are sampled, the restaurants and parent probabilities of words beyond the
    hot_words most frequent have their mean size; in the scores every word has its own. A null or empty
    text is its end alone. A null id's fold is that of the empty text. Repeated rows are counted and
    scored each on their own. An empty table gives an empty table; other columns are not read. Words
    are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    words = saved(rows.mapInArrow(_word_counts, "word long, n long, other long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("other").alias("other")), "words")
    tokens, other, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("other"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    top = words.where("n > 0").orderBy(F.desc("n"), "word").limit(min(hot_words, HOT)).select("word", "n").toArrow()
    hot, count = HotWords(top.column("word").to_numpy()), top.column("n").to_numpy()
    buckets = max(1, -(-(tokens + other) // BUCKET_ENTRIES))
    sent = spark.sparkContext.broadcast(hot)
    chunks = _by_kind(rows.mapInArrow(lambda it: _chunks(it, sent.value, buckets), CHUNKS), "chunks")
    asked = chunks.where("kind = 'pairs'").select("bucket", "chunk", "data").repartition("bucket").sortWithinPartitions("bucket", "chunk")
    asked = saved(asked.mapInArrow(_merged, MERGED), "asked")
    dropped_kind(chunks, "pairs")

    def seat(sizes: Sizes | None, turn: int, last: bool = False) -> DataFrame:
        many, given = len(hot), spark.sparkContext.broadcast(sizes)
        rows = asked if last else asked.select("bucket", "pairs")
        return _by_kind(rows.mapInArrow(lambda it: _seat_buckets(it, many, given.value, turn, last), SUMS), "seats")

    def all_of(sums: DataFrame) -> list[int]:
        return [int(x or 0) for x in sums.where("kind = 'all'").agg(*(F.sum(F.col("sums")[i]) for i in range(3))).first()]

    sums = seat(None, 0)
    pairs, ones, twos = all_of(sums)
    discount, on_inside, others = _discount(ones, twos), _hot_sums(sums, len(hot), 1), max(1, v - len(hot))
    # the parent: its customers are the tables below; at first each word has one table there
    above = (_discount(int((on_inside[0] == 1).sum()) + v - len(hot), int((on_inside[0] == 2).sum())), float(pairs), float(v), 1 / (v + 1))
    tables = (on_inside[0] > 0).astype(float)
    customers = float(pairs)
    for turn in range(1, PASSES + 2):
        rest_on, rest_inside = customers - on_inside[0].sum(), customers - on_inside[1].sum()
        sizes = Sizes(on_inside[1], max(0.0, rest_inside) / others, in_parent(on_inside[0], tables, above), float(in_parent(np.array([max(0.0, rest_on) / others]), np.ones(1), above)[0]), discount, above)
        last = turn > PASSES
        dropped(sums)
        sums = seat(sizes, turn, last)
        on_inside = _hot_sums(sums, len(hot), SAMPLES if last else 1)
        if not last:
            customers = on_inside[0].sum() + max(0.0, rest_on)  # of words that are not hot a pair has one table, nearly always
            tables = _parent_tables(on_inside[0], above, turn)
            above = (above[0], float(customers), float(tables.sum() + v - len(hot)), above[3])
    on, inside = on_inside[::2], on_inside[1::2]
    rare = sums.where("kind = 'rare'").groupBy("word").agg(*(F.sum(s).alias(s) for s in SIDES))
    # sorted, so that the same words are seated together, and alike, each time
    rare = saved(rare.join(words.where("n > 0").select("word", "n").hint("shuffle_merge"), "word").sortWithinPartitions("word"), "rare")
    dropped(asked, words)
    rest = [float(x or 0) for x in rare.agg(*(F.sum(f"on{k}") for k in range(SAMPLES))).first()]
    hot_tables = [_parent_tables(on[k], above, 100 + k) for k in range(SAMPLES)]
    aboves = [(above[0], float(on[k].sum() + rest[k]), float(hot_tables[k].sum() + v - len(hot)), above[3]) for k in range(SAMPLES)]
    model = PitmanYor(hot, count, tokens, v, discount, inside, np.stack([in_parent(on[k], hot_tables[k], aboves[k]) for k in range(SAMPLES)]), aboves)
    rare = rare.mapInArrow(lambda it: _rare_parents(it, aboves), "word long, n long, " + ", ".join(f"{c} long" for c in RARE))
    texts = chunks.where("kind = 'text'").select("chunk", "ids", "counts", "cold", "data")
    wanted = texts.select("chunk", F.explode("cold").alias("word")).join(rare.hint("shuffle_merge"), "word")
    wanted = wanted.select("chunk", "word", "n", *RARE).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_gathered, "chunk long, data array<binary>")
    answers = sums.where("kind = 'answer'").select("chunk", "bucket", "data")
    parts = [t.withColumn("turn", F.lit(i)) for i, t in enumerate((wanted, answers, texts))]
    full = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).repartition("chunk").sortWithinPartitions("chunk", "turn")
    given = spark.sparkContext.broadcast(model)
    out = full.select("turn", "bucket", "ids", "counts", "cold", "data").mapInArrow(lambda it: _scores(it, given.value, buckets), SCORES)
    out = out.withColumn("train_tokens", F.lit(int(tokens)).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def _by_kind(rows: DataFrame, name: str) -> DataFrame:
    """Saved, with a folder for each kind of row: a reader of one kind reads no other."""
    return saved(rows, name, by="kind")
