"""How far the sources of a language are apart: term probabilities compared by joint histograms of counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenquarry.llm.common import bounded_batches, lean, saved

#: Documents of a language that a kept term is in, at least; what each count is raised by; the parts of one.
MIN_DOCUMENTS, SMOOTHING, SCALE = 30, 5, 1_000_000_000
#: Terms of a group that are reported.
TOP_TERMS = 50
#: Distinct (group, term) counts that a task holds before it hands them on.
HELD_COUNTS = 1 << 18
#: Terms of a block of counts, and its cells (terms times sources), at most on average.
BLOCK_TERMS, BLOCK_CELLS = 2048, 1 << 23
#: Bytes of a text that are split at a time, cut where a term ends.
PIECE_BYTES = 1 << 20
#: Runs of letters A to Z and of everything beyond ASCII, lower-cased in A to Z alone: all other bytes become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE_BYTES that end where a term ends (a longer term stays whole)."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = text.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _split(text: bytes) -> Iterator[list[bytes]]:
    for piece in _pieces(text.translate(TERM_BYTES)):
        yield piece.split()


@lean
def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0  # distinct ones in counts

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in counts.items():
            terms = pa.array(list(n), pa.binary())
            size = len(terms)
            documents = pa.array([df[t] for t in n], pa.int64())
            lists = [pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int64))), pa.array([source], pa.string()).take(pa.array(np.zeros(size, np.int64)))]
            yield pa.RecordBatch.from_arrays([*lists, terms.cast(pa.string()), pa.array(n.values(), pa.int64()), documents], names=["lang", "source", "term", "n", "df"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if (lang, source) not in counts:
                counts[lang, source] = Counter({b"": 0}), Counter()
                held += 1
            n, df = counts[lang, source]
            before, own = len(n), set()
            for terms in _split(text):
                n.update(terms)
                own.update(terms)
            df.update(own)
            held += len(n) - before
            if held > most:
                yield from handed_on()
                counts, held = {}, 0
    yield from handed_on()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = HELD_COUNTS) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term; every group has a row of the term '' with n = 0.

    Counts are added up in each task and sent once a task, dealt by (lang, term), so that a hot group or
    a frequent term is a few rows of each task.
    """
    bounded_batches(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _counted(it, held), "lang string, source string, term string, n long, df long")


def kept_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, all): the counts of terms that enough documents of the language hold, `all` those of the language; and every group's ''."""
    dealt = term_counts(docs).repartition("lang", "term")
    sums = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    whole = Window.partitionBy("lang", "term")  # a row for each source that has the term
    both = sums.withColumn("all", F.sum("n").over(whole)).withColumn("df", F.sum("df").over(whole))
    return both.where((F.col("df") >= min_documents) | (F.col("term") == "")).select("lang", "source", "term", "n", "all")


def smoothed(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)) of three columns, exactly: products have up to 31 digits. Null without terms."""
    above = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {SMOOTHING} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({above}) div CAST({total} + {SMOOTHING} * {terms} AS DECIMAL(20,0)) END")


class JointHistograms:
    """The counts of a block's terms in each source, and for two sources how often each (count, count) occurs.

    A source without a term has its count 0; f is evaluated once for each combination that occurs.
    """

    def __init__(self, n_terms: int, term: np.ndarray, source: np.ndarray, count: np.ndarray, p: np.ndarray, zero: np.ndarray):
        """term, source, count, p: the cells over 0; zero: p of the count 0, for each source."""
        self.codes, self.values = np.zeros((len(zero), n_terms), np.int32), []
        order = np.argsort(source, kind="stable")
        ends = np.searchsorted(source[order], np.arange(len(zero) + 1))
        for s in range(len(zero)):
            at = order[ends[s] : ends[s + 1]]
            _, first, code = np.unique(count[at], return_index=True, return_inverse=True)
            self.codes[s, term[at]] = code + 1
            self.values.append(np.r_[zero[s], p[at][first]])

    def tally(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code of a, code of b, terms) of every combination, that of two zeros included."""
        width = len(self.values[b])
        pair = self.codes[a].astype(np.int64) * width + self.codes[b]
        if len(self.values[a]) * width <= 4 * len(pair):
            times = np.bincount(pair)
            pair = np.flatnonzero(times)
            times = times[pair]
        else:
            pair, times = np.unique(pair, return_counts=True)
        return pair // width, pair % width, times

    def distance(self, a: int, b: int) -> int:
        x, y, times = self.tally(a, b)
        return int((np.abs(self.values[a][x] - self.values[b][y]) * times).sum())


def _pair_parts(rows: pa.Table) -> pa.Table:
    """(lang, source, other, value) of a block: rows with a term are its counts, those with '' name all sources of the language."""
    rows = rows.combine_chunks()
    head = rows.filter(pc.equal(rows.column("term"), "")).sort_by("source")
    body = rows.filter(pc.not_equal(rows.column("term"), ""))
    names = head.column("source").combine_chunks()
    source = pc.index_in(body.column("source"), value_set=names).to_numpy()
    terms = body.column("term").combine_chunks().dictionary_encode()
    histograms = JointHistograms(len(terms.dictionary), terms.indices.to_numpy(), source, body.column("n").to_numpy(), body.column("p").to_numpy(), head.column("p").to_numpy())
    first, second = np.triu_indices(len(names), 1)
    values = np.fromiter((histograms.distance(a, b) for a, b in zip(first.tolist(), second.tolist())), np.int64, len(first))
    lang = rows.column("lang").combine_chunks().take(pa.array(np.zeros(len(first), np.int64)))
    return pa.table({"lang": lang, "source": names.take(pa.array(first)), "other": names.take(pa.array(second)), "value": pa.array(values)})


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and which terms it prefers.

    Part `pair`: the sum over the kept terms of the language of |p - q| for every other source. Part
    `term`: the `top` terms of which the source has the most more than the language. Terms are runs of
    letters A to Z and of anything beyond ASCII, A to Z lower-cased; kept are those of at least
    min_documents documents of the language. Null texts and names are empty ones; a group without terms
    takes part; a language of one source has no pairs; repeated rows count each; an empty table gives
    none; other columns are not read.

    The kept counts of a language are dealt to blocks of terms by all its sources. A block tallies each
    pair's joint histogram and evaluates the difference once for each combination of counts; a pair's
    value is the sum over blocks.
    """
    plain = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counts = saved(kept_counts(plain, min_documents), "counts")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # V counts each kept term once, in the source that comes first
    own = counts.where("term <> ''").groupBy("lang", "term").agg(F.first("all").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    langs = sizes.join(own, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0))).withColumn("lang_total", F.coalesce("lang_total", F.lit(0)))
    per_block = F.least(F.greatest(F.lit(BLOCK_TERMS), F.col("sources")), F.floor(F.lit(BLOCK_CELLS) / F.col("sources")) + 1)
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / per_block)).cast("int"))
    named = saved(groups.join(langs, "lang").withColumn("zero", F.lit(0)).withColumn("p", smoothed("zero", "total", "terms")), "groups")

    body = counts.where("term <> ''").join(named.drop("p"), ["lang", "source"]).withColumn("p", smoothed("n", "total", "terms")).withColumn("q", smoothed("all", "lang_total", "terms"))
    body = body.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    head = named.select("lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.coalesce("p", F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = body.select("lang", "source", "term", "n", "p", "block").unionByName(head)
    parts = cells.groupBy("lang", "block").applyInArrow(_pair_parts, "lang string, source string, other string, value long")
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pair = sums.select("lang", F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("s"), "value")
    pair = pair.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    term = body.where("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(best)
