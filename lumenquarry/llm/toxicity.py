"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquarry.llm.common import id_and_text, lean, slices
from lumenquarry.llm.words import U, _bytes_powers, mixed

#: Features: letters' runs of a text, lower-cased, and their first STEM bytes, hashed to BITS bits.
STEM, BITS = 5, 20
#: Labelled documents that the model is fitted on: so many of each class, those with the least hashed ids.
SAMPLE = 3000
#: Grades: 0 clean, 1 toxic, 2 toxic and of low quality.
GRADES = 3
#: Least distance of two cuts, and that of a cut beyond which no row of the sample is.
LEAST_GAP, OUT_OF_REACH = 0.05, 30.0
#: Value of a feature that occurs.
SCALE = 0.1
SLICE_BYTES = 1 << 18


def _letters() -> tuple[np.ndarray, np.ndarray]:
    codes = np.arange(256)
    lower = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return mixed(lower.astype(np.uint64) + U(0x9FB21C651E98DF25)), (codes >= 128) | ((lower >= 97) & (lower <= 122))


_CODE, _LETTER = _letters()


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word and stem, in turn, repeated ones too."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(_LETTER[buf], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _bytes_powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODE[buf] * up[: len(buf)], out=sums[1:])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    long = np.flatnonzero(ends - starts > STEM)
    whole = mixed((sums[ends] - sums[starts]) * down[starts])
    stem = mixed((sums[starts[long] + STEM] - sums[starts[long]]) * down[starts[long]] + U(1))
    return np.r_[owner, owner[long]], (np.r_[whole, stem] >> U(64 - BITS)).astype(np.int64)


class OrdinalModel:
    """P(grade > k | x) = sigmoid(w.x - cut[k]): one weight vector, increasing cuts. x marks which features occur."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.used = np.flatnonzero(weights)
        self.values, self.cuts = weights[self.used], cuts

    @staticmethod
    def loss(z: np.ndarray, cuts: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(loss, its derivative by z, its derivatives by the cuts) of each row: minus the log of P(grade) = P(> grade - 1) - P(> grade).

        With a and b for the two probabilities the derivative by z is a + b - 1: the slope of the logistic
        curve is p (1 - p), so the difference of slopes is that of a and b times 1 - a - b.
        """
        n, k = len(z), len(cuts)
        over = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))
        edges = np.hstack([np.ones((n, 1)), over, np.zeros((n, 1))])
        row = np.arange(n)
        above, beyond = edges[row, grades], edges[row, grades + 1]
        p = np.maximum(above - beyond, 1e-12)
        by_cut = np.zeros((n, k))
        low, high = grades > 0, grades < k
        by_cut[row[low], grades[low] - 1] += (above * (1 - above) / p)[low]
        by_cut[row[high], grades[high]] -= (beyond * (1 - beyond) / p)[high]
        return -np.log(p), above + beyond - 1, by_cut

    @staticmethod
    def fit(rows: list[np.ndarray], grades: np.ndarray, l1: float = 3e-5, rounds: int = 150) -> OrdinalModel:
        """Full-batch accelerated proximal gradient on the cumulative-link likelihood; l1 keeps the weights of chance features at 0. Deterministic.

        Rows of grade 0 and rows of the others weigh the same in all. A top grade that no row has stays out of reach.
        """
        k, top = GRADES - 1, int(grades.max()) if len(grades) else 0
        cuts = np.arange(1, k + 1) * 2.0
        if not len(rows) or not (grades > 0).any() or (grades > 0).all():
            return OrdinalModel(np.zeros(1 << BITS), np.full(k, 20.0) + np.arange(k))
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        names, column, df = np.unique(np.concatenate(rows).astype(np.int32), return_inverse=True, return_counts=True)
        column = column.astype(np.int32)  # half the driver's memory
        keep = (df >= 3)[column]
        owner, column = owner[keep], (np.cumsum(df >= 3) - 1).astype(np.int32)[column[keep]]
        names = names[df >= 3]
        weights, n = np.zeros(len(names)), len(rows)
        ahead, t = weights.copy(), 1.0
        balance = np.where(grades > 0, n / (2 * (grades > 0).sum()), n / (2 * (grades == 0).sum()))
        step, used = 40.0, cuts[:top]
        for _ in range(rounds):
            z = SCALE * np.bincount(owner, weights=ahead[column], minlength=n)
            _, by_z, by_cut = OrdinalModel.loss(z, used, grades)
            gradient = SCALE * np.bincount(column, weights=(by_z * balance)[owner], minlength=len(names)) / n
            new = ahead - step * gradient
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            used = used - np.clip(2 * (by_cut * balance[:, None]).mean(0), -0.5, 0.5)
            used = np.maximum.accumulate(np.r_[used[:1], np.maximum(used[1:], used[:-1] + LEAST_GAP)])
            t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead, weights = new + (was - 1) / t * (new - weights), new
        full = np.zeros(1 << BITS)
        full[names] = weights
        return OrdinalModel(full, np.r_[used, used[-1] + OUT_OF_REACH * np.arange(1, k - top + 1)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) of each text and k."""
        owner, feature = text_features(texts)
        mark = np.zeros(1 << BITS, bool)
        if len(owner):
            pair = np.unique(owner << BITS | feature)
            owner, feature = pair >> BITS, pair & ((1 << BITS) - 1)
        mark[self.used] = True
        hit = mark[feature]
        value = self.values[np.searchsorted(self.used, feature[hit])] if len(self.used) else np.zeros(0)
        z = SCALE * np.bincount(owner[hit], weights=value, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts, -30, 30)))


@lean
def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            owner, feature = text_features(batch.column("text").cast(pa.binary()).to_pylist())
            pair = np.unique(owner << BITS | feature)
            at = np.searchsorted(pair >> BITS, np.arange(batch.num_rows + 1))
            features = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((pair & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), features], names=["doc_id", "grade", "features"])


@lean
def _scored(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            above = model.scores(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                names=["doc_id", "expected_severity", "grade", "toxic_probability", "toxic"],
            )


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most `sample` labelled documents of each class, those with the least hashed ids.

    The sample is chosen among the labels, so at most 2 * sample ids are broadcast and as many sparse
    rows reach the driver. Labels with a null id or a null toxic are left out, repeated ids count
    once; a null quality counts as good. Without both classes the model finds everything clean.
    """
    graded = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))
    ranked = graded.withColumn("rank", F.xxhash64("doc_id"))
    chosen = [ranked.where(c).orderBy("rank", "doc_id").limit(sample).collect() for c in ("grade = 0", "grade > 0")]
    picked = [(r["doc_id"], r["grade"]) for part in chosen for r in part]
    if not picked:
        return OrdinalModel.fit([], np.zeros(0, np.int64))
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, grade int")
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").mapInArrow(_feature_rows, "doc_id long, grade int, features array<int>")
    got = rows.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    features = got.column("features").combine_chunks()
    flat, ends = features.flatten().to_numpy(), np.cumsum(features.value_lengths().to_numpy())
    return OrdinalModel.fit(np.split(flat, ends[:-1]) if len(ends) else [], got.column("grade").to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, expected_severity (0 to 2), grade, toxic_probability, toxic (probability of a grade over 0 at least 1/2).

    Whole texts are scored; null or empty texts have no features and get the least score. Null ids
    and repeated rows stay, each with its own row; an empty table gives an empty table; other columns
    are not read. A text's score depends on which words it holds, not on their order or case.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, sample, id_col, text_col))
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: _scored(it, model.value), "doc_id long, expected_severity double, grade int, toxic_probability double, toxic boolean")


@lean
def _clean(batches: Iterator[pa.RecordBatch], model: OrdinalModel, text_col: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES, text_col):
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.scores(texts)[:, 0] < 0.5))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that `toxicity` doesn't call toxic. Narrow: no shuffle.

    Null and empty texts, null ids and repeated rows stay, columns of any name come through; an empty
    table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, sample, id_col, text_col))
    return docs.mapInArrow(lambda it: _clean(it, model.value, text_col), docs.schema)
