"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenquarry.llm.ann import nearest
from lumenquarry.llm.bpe import bpe_round_trip
from lumenquarry.llm.common import documents
from lumenquarry.llm.filter_audit import filter_interactions
from lumenquarry.llm.hpylm import score_texts
from lumenquarry.llm.jaccard_join import jaccard_components
from lumenquarry.llm.matroska import media_features
from lumenquarry.llm.packing import pack_documents
from lumenquarry.llm.pii import find_pii
from lumenquarry.llm.quality import quality
from lumenquarry.llm.source_divergence import source_divergence
from lumenquarry.llm.substring_dedup import substring_dedup
from lumenquarry.llm.token_counts import token_counts
from lumenquarry.llm.toxicity import toxicity


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of up to 1024 tokens, placed in sequences. A null or empty text is a piece of one token; repeated rows are packed each. An empty table gives an empty one."""
    return pack_documents(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests. A null text is an empty one; repeated rows stay. An empty table gives an empty one."""
    return bpe_round_trip(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text without windows of 50 that a smaller id holds. A null text has no words; repeated rows stay. An empty table gives an empty one."""
    return substring_dedup(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text. A null text is an empty one; repeated rows stay. An empty table gives an empty one."""
    return token_counts(documents(spark, sf_dir))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and its component of links. A null or empty text is linked with nothing; repeated rows stay. An empty table gives an empty one."""
    return jaccard_components(documents(spark, sf_dir))


def op6_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth. Null, zero and non-finite vectors take no part. An empty table gives an empty one."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text. A null text has none; repeated rows stay. An empty table gives an empty one."""
    return find_pii(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every text. A null text gets the least score; repeated rows stay. An empty table gives an empty one."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes through a media file and back. A null text is one empty unit; repeated rows stay. An empty table gives an empty one."""
    return media_features(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every text by a model of the training folds. A null text is its end alone; repeated rows stay. An empty table gives an empty one."""
    return score_texts(documents(spark, sf_dir))


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source in all 120 orders. Null texts and sources are empty ones; repeated rows count each. An empty table gives an empty one."""
    return filter_interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of a language and the terms each prefers. Null texts, languages and sources are empty ones; repeated rows count each. An empty table gives an empty one."""
    return source_divergence(documents(spark, sf_dir))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that every text is good. A null text is an empty one; repeated rows stay. An empty table gives an empty one."""
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_byte_bpe, op3_substring_dedup, op4_token_counts, op5_ngram_jaccard_join, op6_cross_polytope_ann, op7_pii, op8_toxicity, op9_media_columns, op10_lm_scoring, op11_filter_interaction, op12_source_divergence, op13_quality)}


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (k) WHERE m < win.doc_id) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.doc_id)
SELECT r.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id FROM (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r LEFT JOIN n ON n.doc_id = r.doc_id
"""


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS m FROM w GROUP BY t),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t) AS INT) + 8 * CAST(regexp_matches(w.t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(m < w.doc_id, false) AS INT) AS fails
  FROM w JOIN least ON least.t = w.t LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, CAST(pow(2, ascii(filter_order[step]) - 65) AS INT) AS own, CAST(list_sum([0] || list_transform(range(1, step), lambda i: CAST(pow(2, ascii(filter_order[i]) - 65) AS INT))) AS INT) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
r AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (fails & (before | own) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails & before = 0 AND fails & own > 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails & before > 0 AND fails & own > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(g) FILTER (fails & before = 0 AND fails & own > 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (fails & before = 0 AND fails & own > 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, kept.term, kept.n AS all_n, coalesce(c.n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY lang, source),
p AS (SELECT cells.lang, cells.source, term, cells.n, CAST(1 + (1000000000::HUGEINT * (cells.n + 5)) // (sums.n + 5 * v.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (all_n + 5)) // (v.n + 5 * v.v) AS BIGINT) AS q
  FROM cells JOIN sums ON sums.lang = cells.lang AND sums.source = cells.source JOIN v ON v.lang = cells.lang),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, a fitted model or a hash of a media file: tests compare those with brute force."""
    return {"op3_substring_dedup": OP3_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op11_filter_interaction": OP11_SQL, "op12_source_divergence": OP12_SQL}
