"""What a task holds of a table is bounded in bytes, not in rows."""

import pytest
from pyspark.sql import functions as F

import lumenquarry.operators.chunk as C
import lumenquarry.operators.language as L
import lumenquarry.operators.postings as P
from lumenquarry.functions.analyzer import Analyzer
from lumenquarry.workers import BATCH_BYTES

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
MAKERS = {
    "trigrams": lambda d: L.gram_counts(d, F.col("text"), F.lit("en")),
    "blocks": lambda d: C.blocks(d, "doc_id", F.col("text")),
    "postings": lambda d: P.positional(d, {"body": F.col("text")}, ("doc_id",)),
    "terms": lambda d: P.term_counts(d, F.col("text")),
}


@pytest.mark.parametrize("name", MAKERS)
def test_batches_are_bounded(spark, name):
    before = spark.conf.get(NAME, None)
    spark.conf.set(NAME, str(1 << 30))
    try:
        MAKERS[name](spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
        assert int(spark.conf.get(NAME)) <= BATCH_BYTES
    finally:
        spark.conf.set(NAME, before) if before else spark.conf.unset(NAME)


def test_blocks_over_several_hand_overs(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 3)
    rows = [(1, "a\n\n é b \n\n\n\nc"), (2, None), (None, "x"), (3, " \t\n\n"), (4, "\n\n".join("pqrstu"))]
    got = sorted((r.doc_id or 0, r.block_ord, r.byte_start, r.byte_end, r.text) for r in C.blocks(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", F.col("text")).collect())
    assert got[:4] == [(0, 0, 0, 1, "x"), (1, 0, 0, 1, "a"), (1, 1, 3, 9, "é b"), (1, 2, 13, 14, "c")]
    assert got[4:] == [(4, i, 3 * i, 3 * i + 1, c) for i, c in enumerate("pqrstu")]


def test_wanted_positions_and_term_counts(spark):
    a, text = Analyzer(), "The cat's cats, THE dogs. The " + "x" * 100
    every, n = a.positions(text)
    assert a.positions(text, frozenset(["the", "no"])) == ({"the": every["the"]}, n)
    assert a.counts(text) == {t: len(at) for t, at in every.items()}
    docs = spark.createDataFrame([(1, text), (2, None), (3, "cat"), (4, "dogs dog")], "file_id long, text string")
    want = P.positional(docs, {"body": F.col("text")}, analyzer=Analyzer()).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    assert sorted(map(tuple, P.term_counts(docs, F.col("text"), Analyzer()).collect())) == sorted(map(tuple, want.collect()))
