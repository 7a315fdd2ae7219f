"""Languages of texts by character trigrams, learned from texts whose language is known."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenquarry.workers import bounded_batches

#: Trigrams that are kept of a language, the most frequent ones.
MOST_GRAMS = 8192
#: Letters that a text needs, and how much better, in log-odds a letter, the best language must be than the next.
LEAST_LETTERS, LEAST_MARGIN = 20, 0.05
#: Parts of a text that are judged on their own, and the share of them that the best language needs.
PART, PARTS_AGREE = 400, 0.7
#: Added to each count.
SMOOTHING = 0.5
#: Code points of a text that are read at a time.
PIECE = 1 << 20
COUNTS = "lang string, gram string, n long"


def _letters(text: str) -> str:
    """Lower-case composed letters, with one space for everything between."""
    low = unicodedata.normalize("NFC", text.lower())
    return "".join(c if c.isalpha() else " " for c in low)


def _codes(text: str) -> np.ndarray:
    """Code points of the letters of a text, single spaces between words and at both ends."""
    points = np.frombuffer((" " + _letters(text) + " ").encode("utf-32-le"), np.uint32)
    space = points == 32
    return points[~(space & np.r_[False, space[:-1]])]


def _key(a, b, c):
    return a << 42 | b << 21 | c


def _keys(codes: np.ndarray) -> np.ndarray:
    """Every trigram of a run of code points as a number."""
    wide = codes.astype(np.uint64)
    return wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:] if len(wide) > 2 else np.zeros(0, np.uint64)


def gram_counts(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, gram, n): occurrences of each trigram in the texts of a language, added up in each batch of rows first. Null languages and texts teach nothing.

    Batches are bounded in bytes: a task holds some thirty bytes for each letter of one.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: dict[str, list[np.ndarray]] = {}
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                codes.setdefault(name, []).extend(_codes(t[i : i + PIECE]) for i in range(0, len(t), PIECE))
            for name, parts in codes.items():
                keys, n = np.unique(np.concatenate([_keys(p) for p in parts]) if parts else np.zeros(0, np.uint64), return_counts=True)
                words = [chr(k >> 42) + chr(k >> 21 & (1 << 21) - 1) + chr(k & (1 << 21) - 1) for k in keys.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words)), pa.array(words), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    rows = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def gram_rows(counts: DataFrame, most: int = MOST_GRAMS) -> DataFrame:
    """(lang, gram, n, total): the most frequent trigrams of each language, at most `most`, and how many it has in all."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    return rows.join(F.broadcast(sums), "lang").select("lang", "gram", "n", "total")


@dataclass
class LanguageModel:
    """keys: the known trigrams, sorted; weights: a log-probability for each of them, and last for any other, in each language."""

    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(counts: DataFrame, most: int = MOST_GRAMS) -> LanguageModel:
        """From `gram_counts`: the rows of `gram_rows` come to the driver."""
        return LanguageModel.of([tuple(r) for r in gram_rows(counts, most).collect()])

    @staticmethod
    def of(rows: list[tuple[str, str, int, int]]) -> LanguageModel:
        """From rows (lang, gram, n, occurrences of all grams of the language)."""
        languages = sorted({r[0] for r in rows})
        grams = sorted({r[1] for r in rows})
        at = {g: i for i, g in enumerate(grams)}
        n, total = np.full((len(grams) + 1, len(languages)), SMOOTHING), np.ones(len(languages))
        for lang, gram, count, of_all in rows:
            n[at[gram], languages.index(lang)] += count
            total[languages.index(lang)] = of_all
        keys = np.array([_key(*map(ord, g)) for g in grams], np.uint64)
        order = np.argsort(keys)
        weights = np.log(n / (total + SMOOTHING * (len(grams) + 1))) if len(grams) else np.zeros((1, len(languages)))
        return LanguageModel(languages, keys[order], np.vstack([weights[:-1][order], weights[-1:]]).astype(np.float32))

    def of_text(self, text: str | None) -> tuple[str | None, float]:
        """(language, log-odds a letter to the next best); no language for texts that are short, mixed or like no language in particular."""
        if not text or not self.languages:
            return None, 0.0
        parts = []
        for i in range(0, len(text), PIECE):
            keys = _keys(_codes(text[i : i + PIECE]))
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            at = np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.zeros(len(keys), np.int64)
            if len(keys):
                parts.append((np.add.reduceat(self.weights[at], np.arange(0, len(keys), PART), axis=0, dtype=np.float64), len(keys)))
        letters = sum(n for _, n in parts)
        if letters < LEAST_LETTERS:
            return None, 0.0
        scores = np.vstack([p for p, _ in parts])
        whole = scores.sum(0)
        best = int(np.argmax(whole))
        margin = float((whole[best] - np.delete(whole, best).max()) / letters) if len(whole) > 1 else float("inf")
        agree = (scores.argmax(1) == best).mean()
        return (self.languages[best] if margin >= LEAST_MARGIN and agree >= PARTS_AGREE else None), margin

    def column(self, spark: SparkSession) -> Callable[[Column], Column]:
        """A function of a text column that gives its language, or null."""
        bounded_batches(spark)
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf("string")
        def language(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: sent.value.of_text(t)[0])

        return language
