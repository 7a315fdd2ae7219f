"""Registered queries over the shared test tables, each with its DuckDB counterpart.

`documents` stands for a file table: the id is the file, its path is source/lang/id.txt, its size the
bytes of the text. A second snapshot is derived from it by rule, so that comparisons have new,
modified, deleted and unchanged files; every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenquarry.functions import mime as M
from lumenquarry.functions import text as X
from lumenquarry.functions import vectors as V
from lumenquarry.functions.analyzer import Analyzer
from lumenquarry.functions.globs import glob_regex
from lumenquarry.operators import binary as B
from lumenquarry.operators import chunk as C
from lumenquarry.operators import extract as E
from lumenquarry.operators import ivf as I
from lumenquarry.operators import language as L
from lumenquarry.operators import manifest as N
from lumenquarry.operators import postings as P
from lumenquarry.operators import search as S
from lumenquarry.streaming.events import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW_NS, DAY_NS = 1_704_067_200_000_000_000 + 86_400_000_000_000, 86_400_000_000_000
TERMS = ["the", "license", "clown"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# derived tables, in Spark and in SQL


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        F.col("doc_id").alias("file_id"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 60_000_000_000 + 1_704_000_000_000_000_000).alias("mtime_ns"),
        "lang", "source", "text", F.lit("text/plain").alias("mime_type"),
    )


FILES = """files AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size,
  doc_id * 60000000000 + 1704000000000000000 AS mtime_ns, lang, source, text, 'text/plain' AS mime_type FROM documents)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the files that the walk finds new; states, failures and errors by rule."""
    f = files(spark, sf_dir).where("file_id % 13 <> 7")
    status = F.expr("CASE WHEN file_id % 19 = 4 THEN 2 WHEN file_id % 23 = 5 THEN 4 WHEN file_id % 29 = 6 THEN 3 WHEN file_id % 31 = 8 THEN 0 WHEN file_id % 37 = 9 THEN 5 ELSE 1 END")
    return f.select(
        "file_id", "path", "size", "mtime_ns", status.alias("status"), F.expr("CAST(CASE WHEN file_id % 19 = 4 THEN file_id % 4 WHEN file_id % 23 = 5 THEN 3 ELSE 0 END AS INT)").alias("fail_count"),
        (F.col("mtime_ns") - 1000).alias("first_seen_ns"), F.expr("CASE WHEN file_id % 23 = 5 THEN '[UNSUPPORTED] no reader' WHEN file_id % 19 = 4 THEN '[DEFERRED] read timed out' END").alias("error_msg"),
        (F.col("mtime_ns") + 5).alias("last_verified_ns"), "lang",
    )


MANIFEST = (
    FILES
    + """, manifest AS (SELECT file_id, path, size, mtime_ns,
  CASE WHEN file_id % 19 = 4 THEN 2 WHEN file_id % 23 = 5 THEN 4 WHEN file_id % 29 = 6 THEN 3 WHEN file_id % 31 = 8 THEN 0 WHEN file_id % 37 = 9 THEN 5 ELSE 1 END AS status,
  CAST(CASE WHEN file_id % 19 = 4 THEN file_id % 4 WHEN file_id % 23 = 5 THEN 3 ELSE 0 END AS INT) AS fail_count, mtime_ns - 1000 AS first_seen_ns,
  CASE WHEN file_id % 23 = 5 THEN '[UNSUPPORTED] no reader' WHEN file_id % 19 = 4 THEN '[DEFERRED] read timed out' END AS error_msg, mtime_ns + 5 AS last_verified_ns, lang
  FROM files WHERE file_id % 13 <> 7)"""
)


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the files that were deleted; some have changed."""
    f = files(spark, sf_dir).where("file_id % 17 <> 3")
    return f.select("path", F.expr("size + CASE WHEN file_id % 11 = 5 THEN 1 ELSE 0 END").alias("size"), F.expr("mtime_ns + CASE WHEN file_id % 41 = 10 THEN 1000000000 ELSE 0 END").alias("mtime_ns"))


WALK = MANIFEST + ", walk AS (SELECT path, size + CASE WHEN file_id % 11 = 5 THEN 1 ELSE 0 END AS size, mtime_ns + CASE WHEN file_id % 41 = 10 THEN 1000000000 ELSE 0 END AS mtime_ns FROM files WHERE file_id % 17 <> 3)"

DIFF = (
    WALK
    + """, diff AS (SELECT * FROM (SELECT coalesce(w.path, m.path) AS path, m.file_id, coalesce(w.size, m.size) AS size, coalesce(w.mtime_ns, m.mtime_ns) AS mtime_ns,
  CASE WHEN m.path IS NULL THEN 'new' WHEN w.path IS NULL AND m.status <> 3 THEN 'deleted' WHEN w.path IS NULL THEN NULL
       WHEN w.size <> m.size OR w.mtime_ns <> m.mtime_ns OR m.status IN (0, 2, 3) THEN 'modified' ELSE 'unchanged' END AS change
  FROM walk w FULL JOIN manifest m ON w.path = m.path) WHERE change IS NOT NULL)"""
)

TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND length(t) <= 80)"


def bm25_sql(parts: list[tuple[str, str, float]], source: str, key: str, terms: list[str], keep: str = "") -> str:
    """A CTE list that ends in scored(key, keep, score, has_<i>): the add of every field's weighted BM25."""
    toks = ", ".join(f"{TOK.format(e)} AS t_{f}" for f, e, _ in parts)
    tf = ", ".join(f"len(t_{f}) AS len_{f}, " + ", ".join(f"len(list_filter(t_{f}, lambda x: x = '{t}')) AS tf_{f}_{i}" for i, t in enumerate(terms)) for f, _, _ in parts)
    st = ", ".join(f"avg(len_{f}) AS avg_{f}, " + ", ".join(f"count(*) FILTER (tf_{f}_{i} > 0) AS df_{f}_{i}" for i in range(len(terms))) for f, _, _ in parts)
    score = " + ".join(f"CASE WHEN tf_{f}_{i} > 0 THEN {w} * ln(1 + (n - df_{f}_{i} + 0.5) / (df_{f}_{i} + 0.5)) * tf_{f}_{i} * 2.2 / (tf_{f}_{i} + 1.2 * (1 - 0.75 + 0.75 * len_{f} / avg_{f})) ELSE 0 END" for f, _, w in parts for i in range(len(terms)))
    has = ", ".join("greatest(" + ", ".join(f"tf_{f}_{i}" for f, _, _ in parts) + f", 0) > 0 AS has_{i}" for i in range(len(terms)))
    some = " OR ".join(f"tf_{f}_{i} > 0" for f, _, _ in parts for i in range(len(terms)))
    kept = f", {keep}" if keep else ""
    return f"toks AS (SELECT {key}{kept}, {toks} FROM {source}), tfs AS (SELECT {key}{kept}, {tf} FROM toks), st AS (SELECT count(*) AS n, {st} FROM tfs), scored AS (SELECT {key}{kept}, {score} AS score, {has} FROM tfs, st WHERE {some})"


def _top(source: str, key: str, k: int, offset: int = 0, more: str = "") -> str:
    return f"SELECT {key}, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, {key}) AS rank{more} FROM {source} ORDER BY rank LIMIT {k} OFFSET {offset}"


def _body() -> dict:
    return {"body": (F.col("text"), 1.0)}


# ranked retrieval


@query("WITH " + bm25_sql([("body", "text", 1.0)], "documents", "doc_id", TERMS) + " " + _top("scored", "doc_id", 20))
def fts_bm25_topk(spark, sf_dir):
    return S.ranked(S.bm25_scan(table(spark, sf_dir, "documents"), "doc_id", _body(), TERMS), 20, "doc_id")


@query(
    r"WITH pg AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS title, html FROM pages), "
    + bm25_sql([("title", "title", 2.0), ("body", "html", 1.0), ("path", "url", 0.5)], "pg", "page_id", ["the", "example", "ing"])
    + " "
    + _top("scored", "page_id", 20)
)
def fts_bm25_title_boost(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("title", E.html_title(F.col("html")))
    return S.ranked(S.bm25_scan(p, "page_id", {"title": (F.col("title"), 2.0), "body": (F.col("html"), 1.0), "path": (F.col("url"), 0.5)}, ["the", "example", "ing"]), 20, "page_id")


@query("WITH " + bm25_sql([("body", "text", 1.0)], "documents", "doc_id", ["license", "version", "clown"]) + " " + _top("(SELECT * FROM scored WHERE (has_0 AND has_1 AND NOT has_2))", "doc_id", 50))
def fts_boolean_and_or_not(spark, sf_dir):
    q = S.parse_query("license AND version NOT clown")
    terms = ["license", "version", "clown"]
    d = table(spark, sf_dir, "documents")
    d = d.withColumn("holds", S.query_predicate(q, {"body": F.col("text")}))
    scored = S.bm25_scan(d, "doc_id", _body(), terms, keep=("holds",)).where("holds")
    return S.ranked(scored.select("doc_id", "score"), 50, "doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOK.format('text')}, ' ') || ' ', ' public license ')")
def fts_phrase(spark, sf_dir):
    q = S.parse_query('"public license"')
    return table(spark, sf_dir, "documents").where(S.query_predicate(q, {"body": F.col("text")})).select("doc_id")


@query(f"SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND list_contains({TOK.format('text')}, 'pour')")
def fts_field_scoped(spark, sf_dir):
    q = S.parse_query("lang:fr AND pour")
    return table(spark, sf_dir, "documents").where(S.query_predicate(q, {"body": F.col("text"), "lang": F.col("lang")})).select("doc_id", "lang")


@query(
    f"WITH {FILES}, tagged AS (SELECT f.*, t.toxic, t.quality FROM files f LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) t ON f.file_id = t.doc_id), "
    "kept AS (SELECT * FROM tagged WHERE regexp_matches(mime_type, '^text/[^/]*$') AND mtime_ns >= 1704000000000000000 AND size >= 200 AND size <= 100000 AND regexp_matches(path, '^src[0-9]/(?:.*/)?[^/]*\\.txt$') AND lang = 'en' AND (toxic = 1 OR quality = 1)), "
    + bm25_sql([("body", "text", 1.0)], "kept", "file_id", TERMS)
    + " "
    + _top("scored", "file_id", 20)
)
def search_filtered(spark, sf_dir):
    tags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    tags = tags.select(F.col("doc_id").alias("file_id"), F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("quality") == 1, F.lit("good")))).alias("tags"))
    f = files(spark, sf_dir).join(tags, "file_id", "left")
    wanted = S.Filters(mime="text/*", after_ns=1704000000000000000, larger=200, smaller=100_000, path="src[0-9]/**/*.txt", tags=["toxic", "good"], lang="en")
    return S.ranked(S.bm25_scan(f.where(wanted.predicate()), "file_id", _body(), TERMS), 20)


@query(
    "WITH " + bm25_sql([("body", "text", 1.0)], "documents", "doc_id", TERMS) + ", t AS (SELECT count(*) AS total FROM scored), page AS (" + _top("scored", "doc_id", 10, 20) + ") SELECT doc_id, score, rank, total, total > 30 AS truncated FROM page, t"
)
def search_paginated_total(spark, sf_dir):
    scored = S.bm25_scan(table(spark, sf_dir, "documents"), "doc_id", _body(), TERMS)
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    page = S.ranked(scored, 10, "doc_id", offset=20)
    return page.select("doc_id", "score", "rank").crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > 30)


@query("WITH " + bm25_sql([("body", "text", 1.0)], "documents", "doc_id", TERMS) + ", b AS (SELECT min(score) AS low, max(score) AS high FROM scored) SELECT doc_id, round(CASE WHEN high - low <= 1.19e-7 THEN 1.0 ELSE (score - low) / (high - low) END, 6) AS normalized FROM scored, b")
def score_minmax_normalized(spark, sf_dir):
    scored = S.bm25_scan(table(spark, sf_dir, "documents"), "doc_id", _body(), TERMS).select("doc_id", "score")
    return S.min_max(scored).select("doc_id", F.round("normalized", 6).alias("normalized"))


@query(
    r"""WITH f AS (SELECT doc_id, text, list_filter([regexp_extract(lower(text), '(?:^|[^\p{L}\p{N}])(?:license|clown)(?:$|[^\p{L}\p{N}])')], lambda x: x <> '') AS m FROM documents),
p AS (SELECT doc_id, text, CASE WHEN len(m) = 0 THEN 0 ELSE instr(lower(text), m[1]) END AS pos FROM f),
s AS (SELECT doc_id, substring(text, CAST(greatest(1, pos - 60) AS BIGINT), 120) AS t FROM p)
SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(?i)(^|[^\p{L}\p{N}])(license|clown)([^\p{L}\p{N}]|$)', '\1<b>\2</b>\3', 'g'), '(?i)(^|[^\p{L}\p{N}>])(license|clown)([^\p{L}\p{N}<]|$)', '\1<b>\2</b>\3', 'g') AS snippet FROM s"""
)
def snippet_highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), ["license", "clown"]).alias("snippet"))


Q0 = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


def _vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(V.doubles(F.col("embedding")).alias("e")).first()["e"])


@query(f"WITH scored AS (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, {Q0}) " + _top("scored", "vec_id", 10))
def vector_knn_topk(spark, sf_dir):
    return S.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10)


@query("WITH v AS (SELECT vec_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 16) AS h FROM embeddings), u AS (SELECT vec_id, list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) AS h FROM v), scored AS (SELECT u.vec_id, list_inner_product(u.h, q.h) AS score FROM u, (SELECT h FROM u WHERE vec_id = 0) q) " + _top("scored", "vec_id", 10))
def vector_mrl_knn(spark, sf_dir):
    short = table(spark, sf_dir, "embeddings").select("vec_id", V.shortened(V.doubles(F.col("embedding")), 16).alias("embedding"))
    q = short.where("vec_id = 0").first()["embedding"]
    return S.knn(short, list(q), 10)


@query("WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5")
def vector_batch_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))  # the stated query set
    return S.knn_batch(q, v, 5)


def _hybrid_sql(weight: float, k: int) -> str:
    return (
        "WITH " + bm25_sql([("body", "text", 1.0)], "documents", "doc_id", TERMS) + f", fts AS ({_top('scored', 'doc_id', 50)}), vs AS (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, {Q0}), vec AS ({_top('vs', 'vec_id', 50)}), "
        f"j AS (SELECT coalesce(f.doc_id, v.vec_id) AS doc_id, f.rank AS rank_fts, v.rank AS rank_vec, f.score AS score_fts, v.score AS score_vec, coalesce({weight} / ({k} + f.rank), 0) + coalesce(1.0 / ({k} + v.rank), 0) AS score FROM fts f FULL JOIN vec v ON f.doc_id = v.vec_id) "
    )


def _fused(spark, sf_dir, weight: float) -> DataFrame:
    fts = S.ranked(S.bm25_scan(table(spark, sf_dir, "documents"), "doc_id", _body(), TERMS), 50, "doc_id")
    vec = S.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 50).withColumnRenamed("vec_id", "doc_id")
    return S.hybrid(fts, vec, "doc_id", 60, weight)


@query(_hybrid_sql(1.0, 60) + _top("j", "doc_id", 20))
def hybrid_rrf(spark, sf_dir):
    return S.ranked(_fused(spark, sf_dir, 1.0), 20, "doc_id").select("doc_id", "score", "rank")


@query(_hybrid_sql(2.0, 60) + "SELECT doc_id, rank_fts, rank_vec, score_fts, score_vec, round(score, 9) AS score FROM j")
def hybrid_rrf_weighted_explain(spark, sf_dir):
    return _fused(spark, sf_dir, 2.0).select("doc_id", "rank_fts", "rank_vec", "score_fts", "score_vec", F.round("score", 9).alias("score"))


STOP = "['" + "','".join(X.STOP_WORDS) + "']"


@query(
    f"""WITH q AS (SELECT item_id, unnest([text, regexp_extract(text, '^(\\S+\\s+\\S+)', 1), '"' || text || '"', 'mime:' || text, 'idiot']) AS query, unnest([0, 1, 2, 3, 4]) AS variant FROM benchmark), r AS (SELECT q.*, m.requested, m.no_vectors FROM q, (SELECT unnest(['auto','fts','semantic','hybrid','auto']) AS requested, unnest([false,false,true,false,true]) AS no_vectors) m)
SELECT item_id, variant, requested, no_vectors, CASE WHEN requested = 'fts' THEN 'fts' WHEN requested IN ('semantic','hybrid') AND no_vectors THEN 'fts' WHEN requested IN ('semantic','hybrid') THEN requested
WHEN no_vectors OR length(query) - length(replace(query, '"', '')) >= 2 OR contains(query, ':') OR list_has_any(regexp_split_to_array(query, '\\s+'), ['AND','OR','NOT'])
 OR (len(list_filter(regexp_split_to_array(query, '\\s+'), lambda t: t <> '')) <= 3 AND NOT list_has_any(regexp_split_to_array(lower(query), '\\s+'), {STOP})) THEN 'fts' ELSE 'hybrid' END AS mode FROM r"""
)
def mode_resolution(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    text = F.col("text")
    variants = F.array(text, F.regexp_extract(text, r"^(\S+\s+\S+)", 1), F.concat(F.lit('"'), text, F.lit('"')), F.concat(F.lit("mime:"), text), F.lit("idiot"))
    rows = b.select("item_id", F.posexplode(variants).alias("variant", "query"))
    asks = F.array(*[F.struct(F.lit(r).alias("requested"), F.lit(n).alias("no_vectors")) for r, n in (("auto", False), ("fts", False), ("semantic", True), ("hybrid", False), ("auto", True))])
    rows = rows.select("item_id", "variant", "query", F.inline(asks))
    return rows.select("item_id", "variant", "requested", "no_vectors", X.resolved_mode(F.col("query"), F.col("requested"), F.col("no_vectors")).alias("mode"))


# terms and postings


@query(f"WITH t AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t GROUP BY doc_id")
def tokenize_terms(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).where(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(f"WITH t AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf, max(tf) AS max_tf FROM p GROUP BY term")
def term_stats(spark, sf_dir):
    p = _positional(spark, sf_dir, {"body": F.col("text")}).select("term", "tf")  # counted where each text is
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"), F.max("tf").alias("max_tf"))


@query("WITH " + bm25_sql([("body", "text", 1.0)], "documents", "doc_id", TERMS) + " SELECT doc_id AS file_id, round(score, 6) AS score FROM scored")
def postings_bm25(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "file_id")
    fields = {"body": F.col("text")}
    return S.bm25(S.postings(d, fields), S.field_lengths(d, fields), TERMS, {"body": 1.0}).select("file_id", F.round("score", 6).alias("score"))


@query(f"WITH {FILES}, p AS (SELECT file_id, list_filter(regexp_split_to_array(lower(path), '[/.]'), lambda x: x <> '') AS parts FROM files), a AS (SELECT file_id, unnest(parts) AS part FROM p), t AS (SELECT file_id, part AS term FROM a UNION ALL SELECT file_id, substring(part, CAST(i AS BIGINT), 3) FROM (SELECT file_id, part, unnest(range(1, length(part) - 1)) AS i FROM a WHERE length(part) >= 3)) SELECT term, count(*) AS n, count(DISTINCT file_id) AS files FROM t GROUP BY term")
def path_tokens_trigrams(spark, sf_dir):
    t = files(spark, sf_dir).select("file_id", F.explode(X.path_terms(F.col("path"))).alias("term"))
    per = t.groupBy("term", "file_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("files"))


@query(f"SELECT doc_id, sha256(translate(lower(text), '{X.FOLD_FROM}', '{X.FOLD_TO}')) AS folded_sha256 FROM documents")
def accent_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.fold(F.lower("text")), 256).alias("folded_sha256"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256 FROM documents")
def nfc_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.nfc("text"), 256).alias("nfc_sha256"))


@query("SELECT doc_id, CASE WHEN strlen(text) >= 20 AND greatest(en, fr, de, es) > 0 THEN CASE greatest(en, fr, de, es) WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END END AS detected FROM (SELECT doc_id, text, " + ", ".join(f"len(list_filter({TOK.format('text')}, lambda x: list_contains(['" + "','".join(w.split()) + f"'], x))) AS {c}" for c, w in X.LANGUAGE_WORDS.items()) + " FROM documents)")
def lang_detect_stopwords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.language(F.col("text")).alias("detected"))


# chunks, blocks, records

WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 384.0) AS BIGINT) + 1 END)) AS ord FROM w WHERE len(w) > 0) SELECT doc_id, CAST(ord AS INT) AS chunk_ord, CAST(len(list_slice(w, ord * 384 + 1, ord * 384 + 512)) AS INT) AS n_words, sha256(array_to_string(list_slice(w, ord * 384 + 1, ord * 384 + 512), ' ')) AS text_sha256 FROM c")
def chunk_windows(spark, sf_dir):
    return C.chunk_windows(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("doc_id", "chunk_ord", "n_words", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 384.0) AS BIGINT) + 1 END AS chunks, CAST(len(w) AS BIGINT) AS words FROM w")
def chunk_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("n"))
    return d.select("doc_id", F.coalesce(F.size(C.window_starts(F.col("n"), 512, 128)), F.lit(0)).cast("long").alias("chunks"), F.col("n").cast("long").alias("words"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), o AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM l) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_ord, byte_start, byte_start + strlen(line) AS byte_end FROM o WHERE trim(regexp_replace(line, '\\s', ' ', 'g')) <> ''")
def paragraph_blocks(spark, sf_dir):
    return C.blocks(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "\n").select("doc_id", "block_ord", "byte_start", "byte_end")


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations")
def heading_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("h", F.when(F.col("role") == "user", F.col("turn")))
    return C.with_heading(c, "conv_id", "turn", "h").select("conv_id", "turn", F.col("context").alias("asked_at"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?is)<h[1-6](?:\s[^>]*)?>')) AS headings, len(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>.*?</p>')) AS paragraphs, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS title FROM pages")
def html_title_meta(spark, sf_dir):
    h = F.col("html")
    count = lambda p: F.regexp_count(h, F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", count(r"(?is)<h[1-6](?:\s[^>]*)?>").alias("headings"), count(r"(?is)<p(?:\s[^>]*)?>.*?</p>").alias("paragraphs"), E.html_title(h).alias("title"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))) AS text_sha256 FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(E.html_text(F.col("html")), 256).alias("text_sha256"))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (role = 'user') AS questions, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id")
def conversation_records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))), lambda x: x["line"])
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("role") == "user").alias("questions"), F.sha2(F.array_join(lines, "\n"), 256).alias("text_sha256"))


# kinds of files


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 'utf-8' WHEN doc_id % 3 = 1 THEN 'utf-16-le' END AS mark, sha256(text) AS text_sha256 FROM documents")
def encoding_decode(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return d.select("doc_id", raw.alias("raw")).select("doc_id", B.bom(F.col("raw")).alias("mark"), F.sha2(B.decoded("raw"), 256).alias("text_sha256"))


def _by_region(spark, sf_dir, row, whole) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(row)).alias("r")).select("n_regionkey", whole(F.col("r")).alias("text"))


@query("""SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY CAST(n_nationkey AS VARCHAR) || ',') - 1 AS INTEGER) AS record_ord,
  'key: ' || CAST(n_nationkey AS VARCHAR) || '; name: ' || n_name || ', of ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation""")
def csv_record_texts(spark, sf_dir):
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit(", of "), F.col("n_regionkey").cast("string"), F.lit('"'))
    texts = _by_region(spark, sf_dir, line, lambda r: F.concat(F.lit("key,name\n"), F.array_join(r, "\n")))
    return E.csv_records(texts, "n_regionkey", F.col("text"))


@query("""SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS record_ord,
  '{"key":' || CAST(n_nationkey AS VARCHAR) || ',"name":"' || n_name || '"}' AS text FROM nation""")
def json_record_texts(spark, sf_dir):
    texts = _by_region(spark, sf_dir, F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), F.to_json)
    return E.json_records(texts, "n_regionkey", F.col("text"))


@query("""SELECT doc_id, CAST(a // 3 AS INTEGER) AS record_ord, array_to_string(list_slice(l, a + 1, a + 3), chr(10)) AS text
  FROM (SELECT doc_id, l, unnest(range(0, len(l), 3)) AS a FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""")
def log_line_batches(spark, sf_dir):
    return E.log_batches(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 3)


@query(
    "WITH n AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['.html','.PDF','/Makefile','.tar.gz','.svg','.rs','','/CMakeLists.txt'][CAST(page_id % 8 + 1 AS INT)] AS path FROM pages), e AS (SELECT page_id, list_extract(string_split(path, '/'), -1) AS base FROM n), x AS (SELECT page_id, base, lower(regexp_extract(base, '^.+\\.([^.]+)$', 1)) AS ext FROM e), m AS (SELECT page_id, coalesce(CASE base "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.KNOWN_NAMES.items())
    + " END, CASE ext "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.EXTENSIONS.items())
    + " END, 'text/plain') AS mime, CASE ext "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.LANGUAGES.items())
    + " END AS code FROM x) SELECT page_id, mime, code, CASE WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime IN ('text/html','application/xml','image/svg+xml') THEN 'html' WHEN mime = 'application/gzip' THEN 'archive' ELSE 'plaintext' END AS extractor FROM m"
)
def mime_detect(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (".html", ".PDF", "/Makefile", ".tar.gz", ".svg", ".rs", "", "/CMakeLists.txt")])
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.element_at(names, (F.col("page_id") % 8 + 1).cast("int"))).alias("path"), F.encode("html", "UTF-8").alias("content"))
    p = p.select("page_id", M.detect(F.col("path"), F.col("content")).alias("mime"), M.code_language(F.col("path")).alias("code"))
    return p.select("page_id", "mime", "code", M.extractor(F.col("mime")).alias("extractor"))


@query("SELECT event_id, CASE substring(ltrim(props), 1, 1) WHEN '{' THEN 'object' WHEN '[' THEN 'array' END AS variant, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.json_variant(F.col("props")).alias("variant"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {FILES}, m AS (SELECT file_id, CASE file_id % 4 WHEN 0 THEN '/' || path WHEN 1 THEN '../' || path WHEN 2 THEN replace(path, '/', '\\..\\') ELSE path END AS member FROM files) SELECT file_id, starts_with(member, '/') OR contains(member, '../') OR contains(member, '..\\') AS unsafe FROM m")
def unsafe_member_paths(spark, sf_dir):
    member = F.expr("CASE file_id % 4 WHEN 0 THEN concat('/', path) WHEN 1 THEN concat('../', path) WHEN 2 THEN replace(path, '/', r'\\..\\') ELSE path END".replace(r"r'\\..\\'", "'\\\\..\\\\'"))
    return files(spark, sf_dir).select("file_id", M.unsafe_member(member).alias("unsafe"))


@query(f"WITH {FILES}, n AS (SELECT file_id, replace(path, '.txt', ['.pem','_password.txt','.txt','-secret.md','.KEY'][CAST(file_id % 5 + 1 AS INT)]) AS path FROM files) SELECT file_id, path FROM n WHERE regexp_matches(lower(list_extract(string_split(path, '/'), -1)), 'secret|credential|password|private_key') OR lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('pem','key','p12','pfx')")
def sensitive_paths(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in (".pem", "_password.txt", ".txt", "-secret.md", ".KEY")])
    p = files(spark, sf_dir).select("file_id", F.replace("path", F.lit(".txt"), F.element_at(ends, (F.col("file_id") % 5 + 1).cast("int"))).alias("path"))
    return p.where(M.sensitive(F.col("path")))


@query(f"WITH {FILES}, m AS (SELECT source AS archive_id, file_id AS ord, CASE WHEN file_id % 50 = 0 THEN 1 ELSE greatest(size // 3, 1) END AS compressed, size FROM files), w AS (SELECT *, sum(size) OVER (PARTITION BY archive_id ORDER BY ord) AS total, row_number() OVER (PARTITION BY archive_id ORDER BY ord) AS n FROM m) SELECT archive_id, ord, total <= 60000 AND n <= 25 AND NOT size // greatest(compressed, 1) > 200 AS allowed FROM w")
def archive_limits(spark, sf_dir):
    m = files(spark, sf_dir).select(F.col("source").alias("archive_id"), F.col("file_id").alias("ord"), F.expr("CASE WHEN file_id % 50 = 0 THEN 1 ELSE greatest(size div 3, 1) END").alias("compressed"), "size")
    return N.archive_limits(m, 60_000, 25, 200).select("archive_id", "ord", "allowed")


@query(f"WITH {FILES} SELECT source AS archive_id, count(*) AS member_count, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY source")
def archive_rollup(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.col("source").alias("archive_id")).agg(F.count(F.lit(1)).alias("member_count"), F.sum("size").alias("total_size"))


# the manifest


@query("SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS size FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))


DUPES = f"WITH {FILES}, g AS (SELECT sha256(text) AS content_hash, size, count(*) AS copies, min(file_id) AS first_id, (count(*) - 1) * size AS wasted_bytes FROM files WHERE size >= 1 GROUP BY sha256(text), size HAVING count(*) > 1) "


def _dupes(spark, sf_dir):
    return N.duplicates(files(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256)))


@query(DUPES + "SELECT * FROM g")
def dedup_groups(spark, sf_dir):
    return _dupes(spark, sf_dir)


@query(DUPES + "SELECT count(*) AS dup_groups, CAST(sum(copies) AS BIGINT) AS files, CAST(sum(wasted_bytes) AS BIGINT) AS wasted_bytes FROM g")
def dedup_wasted_total(spark, sf_dir):
    return _dupes(spark, sf_dir).agg(F.count(F.lit(1)).alias("dup_groups"), F.sum("copies").alias("files"), F.sum("wasted_bytes").alias("wasted_bytes"))


@query(f"WITH {DIFF} SELECT path, change, file_id, size, mtime_ns FROM diff")
def reconcile_diff(spark, sf_dir):
    return N.diff(walk(spark, sf_dir), manifest(spark, sf_dir))


@query(f"WITH {DIFF} SELECT count(*) FILTER (change = 'new') AS new_files, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change IN ('new', 'modified')) AS processed FROM diff")
def reconcile_stats(spark, sf_dir):
    return N.counts(N.diff(walk(spark, sf_dir), manifest(spark, sf_dir)))


@query(f"WITH {WALK} SELECT coalesce(m.path, w.path) AS path, CASE WHEN m.path IS NULL THEN NULL ELSE m.file_id END AS old_id, coalesce(w.size, m.size) AS size, coalesce(w.mtime_ns, m.mtime_ns) AS mtime_ns, CAST(CASE WHEN w.path IS NOT NULL THEN 0 ELSE m.status END AS INT) AS status, coalesce(m.fail_count, 0) AS fail_count, coalesce(m.first_seen_ns, {NOW_NS}) AS first_seen_ns, m.error_msg FROM manifest m FULL JOIN walk w ON m.path = w.path")
def manifest_upsert(spark, sf_dir):
    m = manifest(spark, sf_dir)
    top = m.agg(F.max("file_id").alias("top"))
    new = N.upsert(m, walk(spark, sf_dir), NOW_NS).crossJoin(F.broadcast(top))
    known = m.select("path", F.lit(True).alias("known"))
    return new.join(known, "path", "left").select("path", F.when(F.col("known"), F.col("file_id")).alias("old_id"), "size", "mtime_ns", "status", "fail_count", "first_seen_ns", "error_msg")


@query(f"WITH {MANIFEST} SELECT file_id, CAST(CASE WHEN file_id % 3 = 0 AND fail_count + 1 >= 3 THEN 4 WHEN file_id % 3 = 0 THEN 2 WHEN file_id % 3 = 1 THEN 1 ELSE status END AS INT) AS status, CAST(fail_count + CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS fail_count, CASE WHEN file_id % 3 = 0 THEN '[DEFERRED] again' WHEN file_id % 3 = 1 THEN NULL ELSE error_msg END AS error_msg, CASE WHEN file_id % 3 < 2 THEN {NOW_NS} ELSE last_verified_ns END AS last_verified_ns FROM manifest")
def status_transition(spark, sf_dir):
    m = manifest(spark, sf_dir)
    outcome = m.where("file_id % 3 < 2").select("file_id", F.expr("CASE WHEN file_id % 3 = 0 THEN 2 ELSE 1 END").alias("new_status"), F.expr("CASE WHEN file_id % 3 = 0 THEN '[DEFERRED] again' END").alias("error"))
    return N.transition(m, outcome, NOW_NS)


@query(f"WITH {MANIFEST}, c AS (SELECT m.*, CASE WHEN file_id % 7 = 1 THEN file_id - 1 WHEN file_id % 7 = 2 THEN file_id - 1 END AS parent FROM manifest m), g0 AS (SELECT file_id FROM c WHERE file_id % 7 = 0 AND status <> 3), g1 AS (SELECT file_id FROM c WHERE parent IN (SELECT file_id FROM g0)), g2 AS (SELECT file_id FROM c WHERE parent IN (SELECT file_id FROM g1)) SELECT file_id, path FROM manifest WHERE file_id NOT IN (SELECT * FROM g0 UNION SELECT * FROM g1 UNION SELECT * FROM g2)")
def deleted_cascade(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("parent_archive_id", F.expr("CASE WHEN file_id % 7 IN (1, 2) THEN file_id - 1 END"))
    gone = N.with_members(N.live(m).where("file_id % 7 = 0"), m)
    return N.without(m, gone).select("file_id", "path")


@query(f"WITH {MANIFEST}, p AS (SELECT file_id, 'fts' AS index_name, CASE WHEN file_id % 5 = 0 THEN 2 ELSE 3 END AS schema_ver FROM manifest WHERE file_id % 6 <> 1) SELECT file_id FROM manifest WHERE status = 1 AND file_id NOT IN (SELECT file_id FROM p WHERE schema_ver = 3)")
def progress_missing(spark, sf_dir):
    m = manifest(spark, sf_dir)
    p = m.where("file_id % 6 <> 1").select("file_id", F.lit("fts").alias("index_name"), F.expr("CASE WHEN file_id % 5 = 0 THEN 2 ELSE 3 END").alias("schema_ver"))
    return N.missing_progress(m, p, "fts", 3)


@query(f"WITH {FILES}, i AS (SELECT file_id, CASE WHEN file_id % 10 = 9 THEN NULL ELSE file_id // 3 END AS inode, 1 AS dev FROM files), f AS (SELECT dev, inode, min(file_id) AS first FROM i WHERE inode IS NOT NULL GROUP BY ALL) SELECT i.file_id, CASE WHEN f.first <> i.file_id THEN f.first END AS hard_link_of FROM i LEFT JOIN f ON i.dev = f.dev AND i.inode = f.inode")
def hardlink_canonical(spark, sf_dir):
    i = files(spark, sf_dir).select("file_id", F.expr("CASE WHEN file_id % 10 = 9 THEN NULL ELSE file_id div 3 END").alias("inode"), F.lit(1).alias("dev"))
    return N.hard_links(i)


@query("SELECT event_id AS run_id, event_type AS kind, user_id FROM events ORDER BY event_id DESC LIMIT 1000")
def run_retention(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("kind"), "user_id")
    return N.recent_runs(runs, 1000)


@query("SELECT user_id, max(ts) AS last_run, CASE WHEN epoch_us(TIMESTAMP '2024-01-20') - epoch_us(max(ts)) < 3600 * 1000000::BIGINT THEN 'fresh' WHEN epoch_us(TIMESTAMP '2024-01-20') - epoch_us(max(ts)) < 604800 * 1000000::BIGINT THEN 'stale' ELSE 'warn' END AS staleness FROM events GROUP BY user_id")
def staleness_class(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_run"))
    ns = F.unix_micros(F.col("last_run").cast("timestamp")) * 1000
    now = F.unix_micros(F.lit("2024-01-20").cast("timestamp")) * 1000
    return last.select("user_id", "last_run", N.staleness(ns, now).alias("staleness"))


@query(f"WITH {MANIFEST} SELECT count(*) AS total_files, count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 1) AS indexed, count(*) FILTER (status = 2) AS failed_transient, count(*) FILTER (status = 3) AS deleted, count(*) FILTER (status = 4) AS failed_permanent, count(*) FILTER (status = 5) AS skipped, CAST(sum(size) FILTER (status <> 3) AS BIGINT) AS live_bytes FROM manifest")
def index_summary(spark, sf_dir):
    return N.summary(manifest(spark, sf_dir))


@query(f"WITH {MANIFEST}, t AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) SELECT m.file_id, m.path, m.size, m.status, CASE WHEN t.toxic = 1 THEN 'toxic' END AS tag, t.quality, sha256(d.text) AS content_hash, e.vec_id IS NOT NULL AS in_vectors FROM manifest m JOIN documents d ON d.doc_id = m.file_id LEFT JOIN t ON t.doc_id = m.file_id LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = m.file_id")
def file_info(spark, sf_dir):
    t = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("file_id")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("content_hash"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.lit(True).alias("v")).distinct()
    m = manifest(spark, sf_dir).join(d, "file_id").join(t, "file_id", "left").join(e, "file_id", "left")
    return m.select("file_id", "path", "size", "status", F.when(F.col("toxic") == 1, F.lit("toxic")).alias("tag"), "quality", "content_hash", F.coalesce("v", F.lit(False)).alias("in_vectors"))


@query("SELECT doc_id AS file_id, sha256(text) AS stored, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE sha256(text || '!') END AS actual FROM documents WHERE doc_id % 97 = 0 OR doc_id % 50 = 1")
def verify_integrity(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored = d.select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("content_hash"))
    actual = d.select(F.col("doc_id").alias("file_id"), F.expr("CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 50 = 1 THEN sha2(concat(text, '!'), 256) ELSE sha2(text, 256) END").alias("content_hash"))
    return N.corrupted(stored, actual)


@query(f"WITH {FILES} SELECT file_id FROM files WHERE (file_id * 2654435761) % 1000000 < 250000")
def verify_sample(spark, sf_dir):
    return N.hash_sample(files(spark, sf_dir), 0.25).select("file_id")


DELETE_GLOB = "src1*/{en,fr}/**/*[05].txt"


@query(f"WITH {MANIFEST} SELECT file_id, path FROM manifest WHERE status <> 3 AND regexp_matches(path, '{glob_regex(DELETE_GLOB)}')")
def delete_glob_preview(spark, sf_dir):
    return N.matching(manifest(spark, sf_dir), DELETE_GLOB).select("file_id", "path")


@query("SELECT doc_id, max(toxic) = 1 AS toxic, max(quality) = 0 AS poor FROM labels GROUP BY doc_id HAVING max(toxic) = 1 OR max(quality) = 0")
def tag_or_filter(spark, sf_dir):
    t = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.max("quality").alias("q"))
    t = t.select("doc_id", F.array_compact(F.array(F.when(F.col("t") == 1, F.lit("toxic")), F.when(F.col("q") == 0, F.lit("poor")))).alias("tags"))
    hit = t.where(S.Filters(tags=["toxic", "poor"]).predicate())
    return hit.select("doc_id", F.array_contains("tags", "toxic").alias("toxic"), F.array_contains("tags", "poor").alias("poor"))


@query(f"WITH {MANIFEST} SELECT regexp_extract(error_msg, '^(\\[[A-Z]+\\])', 1) AS prefix, count(*) AS n FROM manifest WHERE error_msg IS NOT NULL GROUP BY ALL")
def error_prefix_report(spark, sf_dir):
    return N.error_report(manifest(spark, sf_dir))


@query(f"WITH {FILES} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS children, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ALL")
def directory_children(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("children"), F.sum("size").alias("bytes"))


@query(f"WITH {FILES} SELECT CAST(floor(sum(size) / 200.0) AS BIGINT) AS index_bytes, count(*) * 500 AS walk_bytes FROM files")
def disk_memory_estimates(spark, sf_dir):
    return N.estimates(files(spark, sf_dir))


@query("SELECT run_id, kind, CAST(gap_us AS BIGINT) AS gap_us FROM (SELECT event_id AS run_id, event_type AS kind, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap_us FROM events)")
def run_gaps(spark, sf_dir):
    g = N.gaps(table(spark, sf_dir, "events"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")), "event_id")
    return g.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("kind"), "gap_us")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows_hourly(spark, sf_dir):
    w = event_windows(table(spark, sf_dir, "events"), "1 hour")
    return w.select("start", "event_type", "n", F.round("total", 2).alias("total"))


# positional postings and stored vectors

PLAIN = Analyzer(fold=False, stemmed=False)
ALL_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _positional(spark, sf_dir, fields: dict, analyzer: Analyzer = PLAIN, only: list[str] | None = None) -> DataFrame:
    return P.positional(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "file_id"), fields, analyzer=analyzer, only=only)


@query(f"WITH t AS (SELECT doc_id AS file_id, ' ' || array_to_string({ALL_TOK.format('text')}, ' ') || ' ' AS t FROM documents) SELECT file_id FROM t WHERE (contains(t, ' public license ') OR contains(t, ' under the mit license ')) AND NOT contains(t, ' clown ')")
def postings_phrase(spark, sf_dir):
    """Phrases and exclusions from positions alone."""
    q = P.analyzed(S.parse_query('"public license" "under the MIT license" NOT clown'), PLAIN, ("body",))
    hits = _positional(spark, sf_dir, {"body": F.col("text")}, only=["public", "license", "under", "the", "mit", "clown"])
    return P.matching(hits, q, ("file_id",))


@query(f"WITH t AS (SELECT doc_id AS file_id, lang, {ALL_TOK.format('text')} AS w, {ALL_TOK.format('split_part(text, chr(10), 1)')} AS h FROM documents) SELECT file_id FROM t WHERE (lang = 'en' AND list_contains(h, 'the')) OR (contains(' ' || array_to_string(h, ' ') || ' ', ' de la ') AND NOT list_contains(w, 'license'))")
def postings_field_boolean(spark, sf_dir):
    """Terms and phrases of one field, joined by AND, OR and NOT, and a property of the file."""
    clauses = [P.analyzed(S.parse_query(part), PLAIN, ("body", "title"))[0] for part in ("lang:en AND title:the", 'title:"de la" AND NOT body:license')]
    hits = _positional(spark, sf_dir, {"body": F.col("text"), "title": F.element_at(F.split("text", "\n"), 1)}, only=["the", "de", "la", "license"])
    named = hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang"), "file_id")
    return P.matching(named, clauses, ("file_id",), {"lang": F.col("lang")})


@query("WITH " + bm25_sql([("body", "text", 1.0)], "documents", "doc_id", ["license", "clown", "public"]) + " " + _top("scored", "doc_id", 25))
def postings_topk_blocks(spark, sf_dir):
    """The best documents, scoring only blocks of postings whose bound reaches the threshold."""
    hits = _positional(spark, sf_dir, {"body": F.col("text")}, only=["license", "clown", "public"]).drop("positions").cache()  # read by each step, as stored postings are
    lengths = S.field_lengths(table(spark, sf_dir, "documents"), {"body": F.col("text")})
    best, _ = P.top_k(hits, P.block_bounds(hits), lengths, ["license", "clown", "public"], {"body": 1.0}, 25)
    return S.ranked(best.withColumnRenamed("file_id", "doc_id"), 25, "doc_id")


@query()
def stemmed_term_stats(spark, sf_dir):
    """Folded stems of all texts: documents and occurrences."""
    return P.term_counts(table(spark, sf_dir, "documents"), F.col("text"), Analyzer())


@query()
def language_trigrams(spark, sf_dir):
    """The language of every text by a model of the texts of three folds of four, beside the given one."""
    d = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = L.LanguageModel.fit(L.gram_counts(d.where("not held_out"), F.col("text"), F.col("lang")))
    return d.select("doc_id", "lang", "held_out", model.column(spark)(F.col("text")).alias("predicted"))


@query("WITH scored AS (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, " + Q0 + ") " + _top("scored", "vec_id", 10))
def vector_ivf_exact(spark, sf_dir):
    """The nearest rows by inverted lists, whose radii rule out the lists that can't hold one."""
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    want = [float(x) for x in v.where("vec_id = 0").first()["v"]]
    quantizer = I.trained(v, F.col("vec_id"))
    if quantizer is None:
        return S.knn(v, want, 10, vector="v")
    rows = I.encoded(v, quantizer)
    best, _ = I.search_exactly(rows, quantizer, I.radii(rows, quantizer), want, 10)
    return S.ranked(best, 10, "vec_id")
