"""Positional postings: terms of chunks with their places, boolean and phrase matching, top-k by block bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquarry.functions.analyzer import Analyzer
from lumenquarry.operators.search import Query, bm25_weight
from lumenquarry.workers import bounded_batches

#: Rows, and positions, that a task hands on at a time; terms that it adds up before it does.
BATCH_ROWS, BATCH_PLACES, SUMMED = 1 << 15, 1 << 18, 1 << 17
#: Documents of a block: those whose id has all but the lowest bits in common.
BLOCK_BITS = 7
#: What a bound may lose by the order in which doubles are added up.
SLACK = 1e-9


def positional(chunks: DataFrame, fields: dict[str, Column], keys: tuple[str, ...] = ("file_id",), analyzer: Analyzer | None = None, only: list[str] | None = None) -> DataFrame:
    """(keys, field, term, length, tf, positions): a row for each term of a field of a chunk. Narrow: a chunk's terms are counted where it is.

    Positions count the tokens of the field from 0, those without a term too; length counts terms.
    Null fields have none. only: terms whose rows are wanted; lengths stay those of whole fields.
    """
    bounded_batches(chunks.sparkSession)
    analyzer, wanted = analyzer or Analyzer(), None if only is None else frozenset(only)
    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)
    columns = {f"_{i}": name for i, name in enumerate(fields)}
    rows = chunks.select(*keys, *(c.cast("string").alias(n) for n, c in zip(columns, fields.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, field, term, length, tf, places, held = [], [], [], [], [], [], 0

            def flushed() -> pa.RecordBatch:
                picked = [batch.column(k).take(pa.array(row, pa.int64())) for k in keys]
                return pa.RecordBatch.from_arrays([*picked, pa.array(field, pa.string()), pa.array(term, pa.string()), pa.array(length, pa.int64()), pa.array(tf, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=[*keys, "field", "term", "length", "tf", "positions"])

            for column, name in columns.items():
                for i, text in enumerate(batch.column(column).to_pylist()):
                    found, n = analyzer.positions(text or "", wanted)
                    for t, at in found.items():
                        row.append(i), field.append(name), term.append(t), length.append(n), tf.append(len(at)), places.append(at)
                    held += n if wanted is None else sum(map(len, found.values()))
                    if len(row) >= BATCH_ROWS or held >= BATCH_PLACES:
                        yield flushed()
                        row, field, term, length, tf, places, held = [], [], [], [], [], [], 0
            yield flushed()

    return rows.mapInArrow(run, f"{kinds}, field string, term string, length long, tf long, positions array<int>")


def term_counts(chunks: DataFrame, text: Column, analyzer: Analyzer | None = None) -> DataFrame:
    """(term, df, total_tf): chunks that hold a term, and its occurrences. Each task adds up its chunks' terms first; no posting moves."""
    bounded_batches(chunks.sparkSession)
    analyzer = analyzer or Analyzer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, tf = {}, {}
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64()), pa.array(tf.values(), pa.int64())], names=["term", "df", "tf"])
        for batch in batches:
            for t in batch.column(0):
                for term, n in analyzer.counts(t.as_py() or "").items():
                    df[term] = df.get(term, 0) + 1
                    tf[term] = tf.get(term, 0) + n
                if len(df) >= SUMMED:
                    yield rows()
                    df, tf = {}, {}
        yield rows()

    parts = chunks.select(text.cast("string").alias("text")).mapInArrow(run, "term string, df long, tf long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total_tf"))


# matching


@dataclass
class Clause:
    """A part of a query as terms: fields it may be in, words (None: any token), negated or not. `column`: a filter by value instead."""

    fields: tuple[str, ...]
    words: list[str | None]
    negated: bool
    column: str | None = None

    @property
    def known(self) -> list[str]:
        return [w for w in self.words if w is not None]


#: Prefixes of a query that compare a column of the file instead of terms.
VALUES = ("mime", "lang")


def analyzed(query: Query, analyzer: Analyzer, fields: tuple[str, ...] = ("body", "title", "path")) -> list[list[Clause]]:
    """The query's alternatives with their words as terms. A word without a field may be in any of them."""
    out = []
    for clauses in query.any_of:
        row = []
        for name, words, negated in clauses:
            if name in VALUES:
                row.append(Clause((), [words[0]], negated, name))
                continue
            terms = [t for w in words for t in analyzer.words(w)]
            while terms and terms[0] is None:
                terms = terms[1:]
            while terms and terms[-1] is None:
                terms = terms[:-1]
            row.append(Clause((name,) if name in fields else fields if not name else (), terms, negated))
        out.append(row)
    return out


def terms_of(clauses: list[list[Clause]]) -> list[str]:
    """What scores: the different terms of the parts that aren't negated."""
    return list(dict.fromkeys(t for row in clauses for c in row if not c.negated for t in c.known))


def is_simple(clauses: list[list[Clause]], fields: tuple[str, ...] = ("body", "title", "path")) -> bool:
    """Alternatives of single words in any field: whatever has a term matches."""
    return all(len(row) == 1 and len(row[0].words) == 1 and not row[0].negated and row[0].fields == fields for row in clauses)


def _less(n: int) -> Callable[[Column], Column]:
    return lambda x: x - F.lit(n)


def matching(hits: DataFrame, clauses: list[list[Clause]], keys: tuple[str, ...], values: dict[str, Column] | None = None) -> DataFrame:
    """The keys whose postings satisfy the query, from the postings of its terms alone.

    One aggregation: a flag for each word of a clause, and for a phrase the positions of its words in a
    field, shifted to where the phrase would begin and intersected. No text is read. A key without any
    posting of the query's terms doesn't match, whatever is negated.
    values: columns of hits that `mime:` and `lang:` compare.
    """
    flags: dict[str, tuple[str, Column]] = {}

    def flag(key: str, value: Column) -> Column:
        return F.col(flags.setdefault(key, (f"_m{len(flags)}", value))[0])

    def holds(c: Clause) -> Column:
        if c.column:
            return flag(f"value {c.column}", F.max(values[c.column] if values else F.lit(None).cast("string"))) == c.words[0]
        if not c.words or not c.fields:
            return F.lit(False)
        if len(c.words) == 1:
            return flag(f"word {c.words[0]} in {c.fields}", F.max((F.col("term") == c.words[0]) & F.col("field").isin(*c.fields)))
        out = F.lit(False)
        for f in c.fields:
            starts = None
            for i, w in enumerate(c.words):
                if w is not None:
                    places = flag(f"places {w} in {f}", F.max(F.when((F.col("term") == w) & (F.col("field") == f), F.col("positions"))))
                    begins = F.transform(places, _less(i))
                    starts = begins if starts is None else F.array_intersect(starts, begins)
            out = out | F.coalesce(F.size(starts) > 0, F.lit(False))
        return out

    keep = F.lit(False)
    for row in clauses:
        every = F.lit(True)
        for c in row:
            held = F.coalesce(holds(c), F.lit(False))
            every = every & (~held if c.negated else held)
        keep = keep | every
    if not flags:
        return hits.select(*keys).distinct().where(keep)
    return hits.groupBy(*keys).agg(*(value.alias(name) for name, value in flags.values())).where(keep).select(*keys)


# blocks


def block_of(file_id: Column) -> Column:
    return F.shiftright(file_id, BLOCK_BITS)


def block_bounds(postings: DataFrame) -> DataFrame:
    """(term, field, block, n, max_tf, min_length): what a block's postings of a term can score at most follows from the last two."""
    return postings.groupBy("term", "field", block_of(F.col("file_id")).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))


@dataclass
class Skipped:
    """What a top-k query did: blocks that hold one of its terms, and those whose postings were scored."""

    blocks: int
    scored: int


def _boost(boosts: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field"))


def top_k(postings: DataFrame, bounds: DataFrame, lengths: DataFrame, terms: list[str], boosts: dict[str, float], k: int, keys: tuple[str, ...] = ("file_id",), allowed: DataFrame | None = None, df: DataFrame | None = None, seeds: int = 1024) -> tuple[DataFrame, Skipped]:
    """The k best (keys, score) as `bm25` gives them, ties by key, scoring only blocks that can hold one of them.

    A block's bound is the sum over terms and fields of the weight of its greatest tf in its shortest
    field. The blocks of the greatest bounds are scored first; the k-th score among them is a threshold
    that blocks with a smaller bound can't reach. The blocks that are left are named in the scan's filter
    if they are few, and joined if they are many.
    allowed: the only keys (file_id) that count. df: (field, term, df) where that isn't the sum of the
    bounds' n, as with rows that are gone: bounds may be too large, never too small.
    """
    mine = bounds.where(F.col("term").isin(*terms) & F.col("field").isin(*boosts))
    df = mine.groupBy("field", "term").agg(F.sum("n").alias("df")) if df is None else df
    stats = F.broadcast(df.join(F.broadcast(lengths), "field").select("field", "term", "df", F.col("n").alias("_n"), "average"))  # at most fields times terms rows
    limit = _boost(boosts) * bm25_weight(F.col("max_tf"), F.col("df"), F.col("_n"), F.col("min_length"), F.col("average"))
    blocks = mine.join(stats, ["field", "term"]).groupBy("block").agg(F.sum(limit).alias("bound"))
    hits = postings.where(F.col("term").isin(*terms) & F.col("field").isin(*boosts)).withColumn("_block", block_of(F.col("file_id")))
    if allowed is not None:
        hits = hits.join(allowed, "file_id", "left_semi")
    weight = _boost(boosts) * bm25_weight(F.col("tf"), F.col("df"), F.col("_n"), F.col("length"), F.col("average"))

    def scored(some: DataFrame) -> DataFrame:
        return some.join(stats, ["field", "term"]).groupBy(*keys).agg(F.sum(weight).alias("score"))

    known = [(r["block"], r["bound"]) for r in blocks.orderBy(F.desc("bound"), "block").limit(seeds + 1).collect()]
    first = [b for b, _ in known[: min(k, seeds)]]
    best = []
    if len(known) > len(first):
        best = [r["score"] for r in scored(hits.where(F.col("_block").isin(*first))).orderBy(F.desc("score")).limit(k).select("score").collect()]
    threshold = best[k - 1] - SLACK if len(best) >= k else float("-inf")
    left, total = sum(b >= threshold for _, b in known), len(known)
    if total > seeds:
        total = blocks.count()
    if left <= seeds:  # those of the greatest bounds are known by name
        rest = hits.where(F.col("_block").isin(*(b for b, _ in known[:left]))) if left else hits.limit(0)
    else:
        reach = blocks.where(F.col("bound") >= threshold).select(F.col("block").alias("_block"))
        left = reach.count()
        rest = hits.join(reach, "_block", "left_semi")
    return scored(rest).orderBy(F.desc("score"), *keys).limit(k), Skipped(total, left)
