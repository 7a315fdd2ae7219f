"""Ranked retrieval: postings, BM25, boolean queries, vector search, fusion, paging."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lumenquarry.functions.globs import glob_match
from lumenquarry.functions.text import token_count, tokens
from lumenquarry.functions.vectors import dot, doubles

K1, B = 1.2, 0.75
#: Ranges of scores up to this count as ties.
TIE = 1.19e-7
#: Bytes of query vectors that are broadcast at a time.
QUERY_BYTES = 32 << 20


# postings


def postings(chunks: DataFrame, fields: dict[str, Column], keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(keys, field, term, tf, length): one row per term of a field of a chunk. Narrow up to the count, which is pre-aggregated."""
    parts = None
    for name, col in fields.items():
        one = chunks.select(*keys, F.lit(name).alias("field"), tokens(col).alias("t"))
        parts = one if parts is None else parts.unionByName(one)
    rows = parts.select(*keys, "field", F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
    return rows.groupBy(*keys, "field", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25_weight(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bm25_scan(docs: DataFrame, key: str, fields: dict[str, tuple[Column, float]], terms: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of the documents that hold any of the terms, without an index: each text is read and matched once.

    Each document's frequencies of the query's terms are counted in its text, without an array of its
    tokens. Counts and mean lengths over all documents are observed on the way; what is kept, by the
    executors, is a few numbers for each document that holds a term, which the scores are made of. The
    first step runs when this is called. Columns: key, keep, score and has_<i> for each term.
    """
    names = list(fields)
    d = docs.select(F.col(key), *(F.col(c) for c in keep), *(F.lower(fields[f][0]).alias(f"t_{f}") for f in names))
    tf = {(f, i): F.coalesce(token_count(F.col(f"t_{f}"), [t]), F.lit(0)) for f in names for i, t in enumerate(terms)}
    d = d.select(key, *keep, *(F.coalesce(token_count(F.col(f"t_{f}")), F.lit(-1)).alias(f"len_{f}") for f in names), *(c.alias(f"tf_{f}_{i}") for (f, i), c in tf.items()))
    seen = Observation()
    d = d.observe(seen, F.count(F.lit(1)).alias("n"), *(F.avg(f"len_{f}").alias(f"avg_{f}") for f in names), *(F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f, i in tf))
    has = [F.greatest(*(F.col(f"tf_{f}_{i}") for f in names), F.lit(0)) > 0 for i in range(len(terms))]
    any_ = has[0]
    for h in has[1:]:
        any_ = any_ | h
    hits = d.where(any_).persist()
    hits.count()
    known = {k: F.lit(v) for k, v in seen.get.items()}  # one row
    score = F.lit(0.0)
    for f, i in tf:
        w = bm25_weight(F.col(f"tf_{f}_{i}"), known[f"df_{f}_{i}"], known["n"], F.col(f"len_{f}"), known[f"avg_{f}"])
        score = score + F.when(F.col(f"tf_{f}_{i}") > 0, fields[f][1] * w).otherwise(0.0)
    return hits.select(key, *keep, score.alias("score"), *(h.alias(f"has_{i}") for i, h in enumerate(has)))


def bm25(index: DataFrame, lengths: DataFrame, terms: list[str], boosts: dict[str, float], keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(keys, score) from postings; lengths has (field, n, average). Reads the postings of the query's terms only."""
    hits = index.where(F.col("term").isin(*terms) & F.col("field").isin(*boosts))
    df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))  # at most fields x terms rows
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field"))
    scored = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(lengths), "field")
    weight = boost * bm25_weight(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("average"))
    return scored.groupBy(*keys).agg(F.sum(weight).alias("score"))


def field_lengths(chunks: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, n, average): one row per field."""
    row = chunks.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.size(tokens(c))).alias(f) for f, c in fields.items()))
    return row.select("n", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "average"))


def chunk_lengths(chunks: DataFrame, fields: dict[str, Column], keys: tuple[str, ...]) -> DataFrame:
    """(keys, one column for each field): tokens of each chunk's fields."""
    return chunks.select(*keys, *(F.size(tokens(c)).cast("int").alias(f) for f, c in fields.items()))


def average_lengths(lengths: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, n, average) as `field_lengths` gives it, from `chunk_lengths`: no text is read."""
    row = lengths.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f) for f in fields))
    return row.select("n", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "average"))


def ranked(scored: DataFrame, k: int, key: str = "file_id", offset: int = 0, digits: int = 6) -> DataFrame:
    """The rows offset+1 to offset+k by score, ties by key, with their rank. Keeps k rows of each partition."""
    top = scored.select(key, F.round("score", digits).alias("score")).orderBy(F.desc("score"), key).offset(offset).limit(k)
    return top.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), key)) + offset).cast("long"))


# queries


@dataclass
class Query:
    """A parsed query: alternatives of clauses; a clause is (field or '', words, negated)."""

    any_of: list[list[tuple[str, list[str], bool]]]

    @property
    def terms(self) -> list[str]:
        out: list[str] = []
        for clauses in self.any_of:
            for name, words, negated in clauses:
                if not negated and name in ("", "title", "path"):
                    out += [w for w in words if w not in out]
        return out


_PIECE = re.compile(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))')


def parse_query(text: str) -> Query:
    """White space separates alternatives, AND joins two, NOT excludes, OR is an alternative; "a b" is a phrase, field:x looks at one field."""
    any_of: list[list[tuple[str, list[str], bool]]] = []
    join = negate = False
    excluded: list[tuple[str, list[str], bool]] = []
    for name, phrase, word in _PIECE.findall(text):
        if not name and not phrase and word in ("AND", "OR", "NOT"):
            join = word == "AND" or (join and word == "NOT")
            negate = word == "NOT"
            continue
        raw = phrase or word
        words = [raw] if name in ("mime", "lang") else [w for w in re.split(r"[^\w]+|_", raw.lower()) if w]
        if words:
            clause = (name or "", words, negate)
            if negate:
                excluded.append(clause)
            elif join and any_of:
                any_of[-1].append(clause)
            else:
                any_of.append([clause])
        join = negate = False
    return Query([[*clauses, *excluded] for clauses in any_of] or ([excluded] if excluded else []))


def query_predicate(query: Query, fields: dict[str, Column]) -> Column:
    """Whether a row matches; '' is the field `body`."""

    def clause(name: str, words: list[str], negated: bool) -> Column:
        col = fields[name or "body"]
        if name in ("mime", "lang"):
            hit = col == words[0]
        elif len(words) == 1:
            hit = F.array_contains(tokens(col), words[0])
        else:
            hit = F.concat(F.lit(" "), F.array_join(tokens(col), " "), F.lit(" ")).contains(" " + " ".join(words) + " ")
        hit = F.coalesce(hit, F.lit(False))
        return ~hit if negated else hit

    out = F.lit(False)
    for clauses in query.any_of:
        all_ = F.lit(True)
        for c in clauses:
            all_ = all_ & clause(*c)
        out = out | all_
    return out


@dataclass
class Filters:
    """Restrictions of a search; they apply before ranking. Bounds are inclusive; tags are alternatives."""

    mime: str | None = None
    after_ns: int | None = None
    before_ns: int | None = None
    larger: int | None = None
    smaller: int | None = None
    path: str | None = None
    tags: list[str] = field(default_factory=list)
    lang: str | None = None

    def predicate(self, *, mime: str = "mime_type", mtime: str = "mtime_ns", size: str = "size", path: str = "path", tags: str = "tags", lang: str = "lang") -> Column:
        parts: Iterator[Column | None] = iter((
            glob_match(F.col(mime), self.mime) if self.mime else None,
            F.col(mtime) >= self.after_ns if self.after_ns is not None else None,
            F.col(mtime) <= self.before_ns if self.before_ns is not None else None,
            F.col(size) >= self.larger if self.larger is not None else None,
            F.col(size) <= self.smaller if self.smaller is not None else None,
            glob_match(F.col(path), self.path) if self.path else None,
            F.arrays_overlap(F.col(tags), F.array(*[F.lit(t) for t in self.tags])) if self.tags else None,
            F.col(lang) == self.lang if self.lang else None,
        ))
        out = F.lit(True)
        for p in parts:
            if p is not None:
                out = out & F.coalesce(p, F.lit(False))
        return out


# scores


def min_max(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `normalized`: scores to [0, 1] over all rows, or over those with equal `by`; ties and single rows give 1."""
    if by:
        w = Window.partitionBy(*by)
        low, high = F.min("score").over(w), F.max("score").over(w)
        return scored.withColumn("normalized", F.when(high - low <= TIE, 1.0).otherwise((F.col("score") - low) / (high - low)))
    bounds = scored.agg(F.min("score").alias("low"), F.max("score").alias("high"))  # one row
    d = scored.crossJoin(F.broadcast(bounds))
    return d.withColumn("normalized", F.when(d["high"] - d["low"] <= TIE, 1.0).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))).drop("low", "high")


def rrf(rank_fts: Column, rank_vec: Column, k: int = 60, fts_weight: float = 1.0) -> Column:
    return F.coalesce(fts_weight / (k + rank_fts), F.lit(0.0)) + F.coalesce(1.0 / (k + rank_vec), F.lit(0.0))


def hybrid(fts: DataFrame, vec: DataFrame, key: str = "file_id", k: int = 60, fts_weight: float = 1.0) -> DataFrame:
    """Fuse two ranked lists (key, rank, score), each of bounded length: key, both ranks and scores, score."""
    a = fts.select(key, F.col("rank").alias("rank_fts"), F.col("score").alias("score_fts"))
    b = vec.select(key, F.col("rank").alias("rank_vec"), F.col("score").alias("score_vec"))
    both = a.join(b, key, "full_outer")
    return both.withColumn("score", rrf(F.col("rank_fts"), F.col("rank_vec"), k, fts_weight))


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of greatest inner product with a query, exactly; a scan that keeps k rows of each partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return ranked(vectors.select(key, dot(doubles(F.col(vector)), q).alias("score")), k, key)


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """The k nearest of each query (query_id, q) among (vec_id, v), a stated set of queries against all rows: (query_id, vec_id, score, rank).

    The queries go to the rows in blocks of up to QUERY_BYTES, whose number is counted first. A task
    multiplies a batch of rows with the queries as matrices and hands on, for each query, only rows that
    reach the k-th score of the batch; what meets in the end is k rows of each batch. Scores are inner
    products in double precision, rounded to 6 digits, ties go to the smaller key. Vectors and queries
    that are null, hold nulls or are of another length than the block's first query take no part.
    """
    sent = queries.agg(F.sum(F.size("q") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-sent // QUERY_BYTES))
    kinds = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    found = None
    for b in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)
        rows = some.where("q is not null").select(query_key, doubles(F.col("q")).alias("q")).toArrow()
        near = vectors.where("v is not null").select(key, doubles(F.col("v")).alias("v")).mapInArrow(_batch_nearest(vectors.sparkSession.sparkContext.broadcast(rows), k, query_key, key), kinds)
        found = near if found is None else found.unionByName(near)
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    best = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w).cast("long"))
    return best.where(F.col("rank") <= k)


def _rows_of(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, places) of the lists of one length without nulls; the length is that of the first one unless given."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if width is None and len(lengths) else width or 0
    whole = lengths == width
    flat = column.filter(pa.array(whole)).flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if width else np.zeros((0, 0))
    full = np.isfinite(rows).all(axis=1)
    return rows[full], np.flatnonzero(whole)[full]


def _batch_nearest(sent: Broadcast, k: int, query_key: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        wanted, places = _rows_of(table.column("q"))
        names = table.column(query_key).combine_chunks().take(pa.array(places))
        for batch in batches:
            rows, at = _rows_of(batch.column("v"), wanted.shape[1])
            if not len(rows) or not len(wanted):
                continue
            for first in range(0, len(wanted), 256):
                scores = wanted[first : first + 256] @ rows.T
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
                q, r = np.nonzero(scores >= least[:, None] - 1e-5)  # what rounding may lift to a tie comes along
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q + first)), batch.column(key).take(pa.array(at[r])), pa.array(scores[q, r])], names=[query_key, key, "score"])

    return run
