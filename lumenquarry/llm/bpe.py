"""Byte-level BPE on padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumenquarry.llm.common import id_and_text, lean, slices
from lumenquarry.llm.tokenizer import PART_CHARS, safe_cuts

#: Longest match (bytes) that goes into a matrix; a longer one is merged with a heap.
MATRIX_BYTES = 512
#: Matches whose ids a worker remembers, twice over: the last so many, and those before; cells in one matrix at most.
REMEMBERED, CELLS = 300_000, 1 << 20
BATCH_BYTES = 2 << 20
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of both joined, looked up by whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, int(len(pairs) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = np.array([(a << 20) | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joined ids, NONE where the pair doesn't join; a or b below 0 is padding."""
        keys = (a.astype(np.int64) << 20) | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at]
        out = np.where(found == keys, out, NONE)
        open_ = np.flatnonzero(((found != keys) & (found != -1) & (keys >= 0)).ravel())
        flat, keys, at = out.ravel(), keys.ravel(), at.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            flat[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return flat.reshape(out.shape)


def latin_pattern(pattern: str) -> str:
    """The pattern for texts of Latin-1 characters only, with \\p{L}, \\p{N}, \\s and \\S spelt out: the built-in engine takes half the time."""
    chars = [chr(i) for i in range(256)]
    sets = {name: "".join(re.escape(c) for c in chars if regex.match(name, c)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, i, inside = [], 0, False
    while i < len(pattern):
        name = next((n for n in sets if pattern.startswith(n, i)), None)
        if name:
            out.append(sets[name] if inside else f"[{sets[name]}]")
            i += len(name)
        elif pattern.startswith(r"\S", i):
            out.append(f"[^{sets[r'\s']}]")
            i += 2
        else:
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


class ByteBpe:
    """Encoder and decoder over a rank file; an id is its token's rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.any_split, self.latin_split = ranks, regex.compile(pattern).findall, re.compile(latin_pattern(pattern)).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.full(256, -1, np.int32)
        pairs = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, long texts in parts."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            find = self.any_split
        else:
            find = self.latin_split
        if len(text) <= PART_CHARS:
            return find(text)
        return [w for part in safe_cuts(text) for w in find(part)]

    def _merge_long(self, word: bytes) -> np.ndarray:
        ids, n = [int(self.single[b]) for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4")

    def _merge_matrix(self, words: list[bytes]) -> list[bytes]:
        """All words of one length class, together: a round merges each row's leftmost pair of least rank."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids = np.where(np.arange(width) < sizes[:, None], self.single[raw], -1)
        ranks = self.table(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(words))
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            over = best == NONE
            for size in np.unique(sizes[over]):
                some = np.flatnonzero(over & (sizes == size))
                raw, step = ids[some, :size].astype("<u4").tobytes(), 4 * int(size)
                for i, r in enumerate(row[some].tolist()):
                    out[r] = raw[i * step : (i + 1) * step]
            live = ~over
            if not live.any():
                return out
            ids, ranks, row, sizes, at, best = ids[live], ranks[live], row[live], sizes[live] - 1, at[live], best[live]
            width = int(sizes.max())
            # compaction: what stands right of the merged pair moves one place to the left
            moved = np.arange(width) + (np.arange(width) > at[:, None])
            ids = np.take_along_axis(ids, moved, 1)
            n = np.arange(len(row))
            ids[n, at] = best
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE), moved[:, : width - 1], 1)
            if width > 1:
                for k in (at - 1, at):
                    ok = np.flatnonzero((k >= 0) & (k < width - 1))
                    ranks[ok, k[ok]] = self.table(ids[ok, k[ok]], ids[ok, k[ok] + 1])

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit integers, of distinct matches."""
        out, classes = {}, {}
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[word] = rank.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                out[word] = self._merge_long(raw).tobytes()
            else:
                classes.setdefault((len(raw) + 3) // 4, []).append((word, raw))
        for group in classes.values():
            step = max(1, CELLS // len(group[0][1]))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                out.update(zip((w for w, _ in part), self._merge_matrix([raw for _, raw in part]), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        new = set().union(*split).difference(self.known)
        if new:
            old = new & self.before.keys()
            self.known.update((w, self.before[w]) for w in old)
            self.known.update(self.encode_words(list(new - old)))
        ids = self.known.__getitem__
        return [b"".join(map(ids, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _default(path: str | None) -> ByteBpe:
    import public_tokenizers as P

    return coder(path or P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@lean
def _encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    bpe = _default(path)
    for whole in batches:
        for batch in slices(whole, BATCH_BYTES):
            ids = bpe.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.frombuffer(x, "<u4") for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])


@lean
def _decoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    bpe = _default(path)
    for batch in batches:
        raw = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
        keep = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(raw, pa.binary())], names=[*keep, "decoded"])


@lean
def _digests(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    bpe = _default(path)
    for whole in batches:
        for batch in slices(whole, BATCH_BYTES):
            ids = bpe.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>. Null or empty text: no ids; a long text is encoded whole.

    Null ids and repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: _encoded(it, path), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded binary, from doc_id and ids (null or empty: no bytes).

    Null ids and repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, path), "doc_id long, decoded binary")


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256; the ids never leave the worker.

    Narrow, no shuffle. Null text counts as empty (0 tokens, digests of nothing); null ids and
    repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: _digests(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
