"""Quality of documents by supervised subword embeddings: hashed word and n-gram vectors, averaged, then a softmax."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import bounded_batches, id_and_text, lean, slices
from lumenquarry.llm.words import hashed_words

#: Folds by the id's crc32, and the one that is never learned from.
FOLDS, HELD_OUT = 4, 2
#: Labelled documents that the model is fitted on: at most so many of each label, those with the least hashed ids.
SAMPLE = 2500
#: Vectors are looked up by hash: 2**BITS of DIM numbers.
BITS, DIM = 16, 8
#: Lengths in bytes of the character n-grams, which take in the space before and after a word.
GRAMS = (2, 3, 4)
#: Words whose pattern of repeats is a feature (the n-gram of words with equal ones named alike).
PATTERN = 3
#: Passes over the sample, and the first step, which falls to 0.
EPOCHS, RATE = 8, 20.0
#: A document of at least this score is predicted to be good.
THRESHOLD = 0.7
#: Bytes of text that are hashed at a time; a longer text is read in parts that end where a word ends.
PIECE_BYTES = 1 << 19
SLICE_BYTES = 1 << 18

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_SPREAD = np.uint32(0x2C1B3C6D)
_SPACE = re.compile(rb"[ \t-\r]")


def held_out(doc_ids: list[int | None]) -> np.ndarray:
    """Whether rows are of the fold that no label is learned from; a null id counts as an empty text."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % FOLDS == HELD_OUT for d in doc_ids], bool)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _SPREAD
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) arrays of every feature, kind by kind: the end of each text, words, patterns of repeats, n-grams."""
    yield np.arange(len(texts)), np.zeros(len(texts), np.uint32)
    hashes, counts = hashed_words(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    yield owner, _bucket(hashes.astype(np.uint32))
    if len(hashes) >= PATTERN:
        inside = owner[PATTERN - 1 :] == owner[: len(owner) - PATTERN + 1]
        pattern = np.zeros(len(inside), np.uint32)
        for a in range(PATTERN):
            for b in range(a):
                pattern = pattern * np.uint32(2) + (hashes[a : a + len(inside)] == hashes[b : b + len(inside)])
        yield owner[PATTERN - 1 :][inside], _bucket((pattern[inside] + np.uint32(1)) * np.uint32(0x7FEB352D))
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    codes = np.where(space, 32, buf).astype(np.uint32) + np.uint32(1)
    ends = np.cumsum([len(t) + 1 for t in texts])  # where the space after each text is
    spaces = np.cumsum(space, dtype=np.int32)
    for n in GRAMS:
        size = max(0, len(buf) - n + 1)
        # no space inside, and not only spaces
        good = spaces[n - 2 : n - 2 + size] == spaces[:size] if n > 2 else ~(space[:size] & space[1 : 1 + size])
        at = np.flatnonzero(good)
        h = np.full(len(at), n * 0x0165667B, np.uint32)
        for k in range(n):
            h = (h ^ codes[at + k]) * _MULTIPLIERS[k % len(_MULTIPLIERS)]
            h ^= h >> np.uint32(16)
        yield np.searchsorted(ends, at + space[at]), _bucket(h)


def _pieces(text: bytes) -> list[bytes]:
    """Parts of at most twice PIECE_BYTES that end where a word ends, if there is such a place."""
    out, at = [], 0
    while len(text) - at > PIECE_BYTES:
        found = _SPACE.search(text, at + PIECE_BYTES, at + 2 * PIECE_BYTES)
        end = found.start() if found else min(len(text), at + 2 * PIECE_BYTES)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def text_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`features` of whole texts: short ones in one go, each long one by its pieces."""
    short = [t if len(t) <= PIECE_BYTES else b"" for t in texts]
    yield from features(short)
    for i, t in enumerate(texts):
        for piece in _pieces(t) if len(t) > PIECE_BYTES else ():
            for owner, bucket in features([piece]):
                yield owner + i, bucket


class SubwordModel:
    """One number a bucket: how far its vector speaks for the label 1; a text's score is the sigmoid of their mean and a constant."""

    def __init__(self, votes: np.ndarray, constant: float):
        self.votes, self.constant = votes, constant

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, seed: int = 13) -> SubwordModel:
        """Stochastic gradient descent, a document a step, on rows of (buckets, their shares of the text).

        The softmax is trained on the sample; its constant is then moved to the share of label 1 among all
        labels. Rows of one label, or none, teach nothing but that share. Deterministic.
        """
        odds = float(np.log(share / (1 - share)))
        if not len(rows) or labels.all() or not labels.any():
            return SubwordModel(np.zeros(1 << BITS, np.float32), odds)
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
        steps, done = EPOCHS * len(rows), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                rate = RATE * (1 - done / steps)
                done += 1
                buckets, weights = rows[i]
                seen = vectors[buckets]
                hidden = weights @ seen
                z = out @ hidden + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = p @ out
                out -= np.float32(rate / RATE) * p[:, None] * hidden
                bias -= np.float32(0.05 * rate / RATE) * p
                vectors[buckets] = seen - np.float32(rate) * weights[:, None] * back
        sampled = labels.mean()
        return SubwordModel(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]) + odds - float(np.log(sampled / (1 - sampled))))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for owner, bucket in text_features(texts):
            total += np.bincount(owner, weights=self.votes[bucket], minlength=len(texts))
            count += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.constant, -30, 30)))


@lean
def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for owner, bucket in text_features(batch.column("text").cast(pa.binary()).to_pylist()):
                more, n = np.unique(owner.astype(np.int64) << BITS | bucket, return_counts=True)
                pairs, back = np.unique(np.r_[pairs, more], return_inverse=True)
                times = np.bincount(back, weights=np.r_[times, n], minlength=len(pairs)).astype(np.int64)
            at = pa.array(np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (pairs & ((1 << BITS) - 1), times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "buckets", "times"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    """Fit on at most `sample` labelled documents of each label, out of the folds that aren't held out: those with the least hashed ids.

    At most 2 * sample ids are broadcast and as many sparse rows reach the driver; the share of label 1
    is counted over all labels of those folds. Labels with a null id or value are left out; of repeated
    ones the greatest counts.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("label")).where(fold != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    ranked = known.withColumn("place", F.xxhash64("doc_id"))
    picked = [(r["doc_id"], r["label"]) for label in (0, 1) for r in ranked.where(F.col("label") == label).orderBy("place", "doc_id").limit(sample).collect()]
    if not picked:
        return SubwordModel.fit([], np.zeros(0, np.int64), share)
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").mapInArrow(_feature_rows, "doc_id long, label int, buckets array<int>, times array<int>")
    got = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    buckets, times = (got.column(c).combine_chunks() for c in ("buckets", "times"))
    ends = np.cumsum(buckets.value_lengths().to_numpy())[:-1] if got.num_rows else np.zeros(0, np.int64)
    split = [np.split(x.flatten().to_numpy(), ends) for x in (buckets, times)] if got.num_rows else [[], []]
    return SubwordModel.fit([(b, (t / t.sum()).astype(np.float32)) for b, t in zip(*split)], got.column("label").to_numpy().astype(np.int64), share)


@lean
def _scored(batches: Iterator[pa.RecordBatch], model: SubwordModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            score = model.scores(batch.column("text").cast(pa.binary()).to_pylist())
            out = held_out(batch.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (probability of a good document), predicted (1 where score >= threshold).

    Whole texts are read, and nothing but texts: equal texts get equal scores. Narrow: no shuffle after
    the model is fitted. Null or empty texts have one feature, the end of a text; null ids and repeated
    rows stay, each with its own row; an empty table gives an empty table; other columns are not read.
    Without labels of both kinds every text gets the share of label 1 (one of each kind added).
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, sample, id_col, text_col))
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: _scored(it, model.value, threshold), "doc_id long, held_out boolean, score double, predicted int")
