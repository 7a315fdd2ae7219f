"""Tables without rows, and the most awkward rows, through every operator."""

import pytest

from lumenquarry.llm.ann import nearest
from lumenquarry.llm.bpe import bpe_round_trip
from lumenquarry.llm.hpylm import score_texts
from lumenquarry.llm.jaccard_join import jaccard_components
from lumenquarry.llm.matroska import media_features
from lumenquarry.llm.packing import pack_documents
from lumenquarry.llm.pii import find_pii
from lumenquarry.llm.quality import quality
from lumenquarry.llm.substring_dedup import substring_dedup
from lumenquarry.llm.token_counts import token_counts
from lumenquarry.llm.toxicity import toxicity


def graded(docs):
    """toxicity with labels for some of the rows, of both classes where there are any."""
    return toxicity(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic", "1 as quality", "token"))


def good(docs):
    return quality(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "token"))


OPERATORS = {f.__name__: f for f in (token_counts, bpe_round_trip, pack_documents, substring_dedup, jaccard_components, find_pii, media_features, score_texts, graded, good)}
COLUMNS = "doc_id long, text string, word string, key long, token long, anchor long, length long, n long, block long, spans string, media binary, row long"


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(spark, name):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    texts = [None, "", " \t\n", "x", "\0", "a\u0085b   c", long, long, "🙂" * 50, "the the the the the the", "1" * 5000, "A" * 5000 + "@"]
    rows = [(i // 2 if i % 5 else None, t, *[None] * 10) for i, t in enumerate(texts + texts[:3])]
    got = OPERATORS[name](spark.createDataFrame(rows, COLUMNS)).collect()
    if name == "pack_documents":
        assert sum(r.piece == 0 for r in got) == len(rows)
    else:
        assert len(got) == len(rows)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "y"), (50, [1.0, 0.0], None), (None, [1.0, 1.0], "z"), (1, None, ""), (2, [], ""), (3, [0.0, 0.0], ""), (100, [float("inf"), 1.0], ""), (4, [None, 1.0], ""), (5, [2.0, 2.0], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in nearest(table).collect())
    half = round(0.5**0.5, 12)
    assert got == [(0, 1, 50, 1.0), (0, 2, 5, half), (50, 1, 0, 1.0), (50, 2, 5, half)]
    assert nearest(table.limit(0)).count() == 0
