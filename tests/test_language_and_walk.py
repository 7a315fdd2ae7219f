"""Languages by trigrams, walks in parts and as streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lumenquarry.operators import language as L
from lumenquarry.queries import QUERIES
from lumenquarry.sources.files import WalkSource, walk, walk_stream


def test_languages_of_held_out_texts(spark):
    rows = [r for r in QUERIES["language_trigrams"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    known = [r for r in rows if r.predicted is not None]
    assert len(rows) > 200 and len(known) / len(rows) > 0.97 and sum(r.predicted == r.lang for r in known) / len(known) > 0.99


def test_short_and_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = L.gram_counts(docs, F.col("text"), F.col("lang")).cache()
    model = L.LanguageModel.fit(counts)
    assert model.languages == ["de", "en", "es", "fr"]
    text = {r.lang: r.text for r in docs.where("length(text) between 4000 and 9000").dropDuplicates(["lang"]).collect()}
    for lang, t in text.items():
        assert model.of_text(t)[0] == model.of_text(t.upper())[0] == lang and model.of_text(t[:20])[0] in (None, lang)
    assert model.of_text(text["de"][:3000] + text["fr"][:3000])[0] is None  # half and half
    assert [model.of_text(t)[0] for t in (None, "", "12 34 !?", "Ωμέγα και άλφα είναι γράμματα του αλφαβήτου")][:3] == [None] * 3
    long = text["en"] * 300
    assert model.of_text(long)[0] == "en"
    assert L.LanguageModel.of([]).of_text("some words that nobody has told apart") == (None, 0.0)
    one = [t for t in ["ab"] for _ in range(3)]
    tiny = L.gram_counts(spark.createDataFrame([(t, "xx") for t in one] + [(None, "yy"), ("zz", None)], "t string, l string"), F.col("t"), F.col("l"))
    assert sorted(map(tuple, tiny.collect())) == [("xx", " ab", 3), ("xx", "ab ", 3)]


@pytest.fixture
def deep(tmp_path):
    root = tmp_path / "real"
    for i in range(20):
        (root / f"only/top/d{i}/e").mkdir(parents=True)
        (root / f"only/top/d{i}/e/f.txt").write_text(str(i))
    (root / "only/top/.gitignore").write_text("d3/\n*.log\n!keep.log\n")
    (root / "only/top/d5/x.log").write_text("x")
    (root / "only/top/d5/keep.log").write_text("x")
    (root / "here.txt").write_text("1")
    os.symlink(root / "only/top/d7", root / "only/link")
    os.symlink(root / "only", root / "only/top/d8/loop")
    os.symlink("/etc", root / "out")
    return root


def test_a_tree_with_one_folder_is_many_tasks(spark, deep, tmp_path):
    spark.dataSource.register(WalkSource)
    rows = walk(spark, str(deep))
    files = {r.path for r in rows.where("not is_dir").collect()}
    want = {f"only/top/d{i}/e/f.txt" for i in range(20) if i != 3} | {"here.txt", "only/top/.gitignore", "only/top/d5/keep.log", "only/link/e/f.txt"}
    assert files == want and rows.rdd.getNumPartitions() > 10
    few = spark.read.format("walk").option("tasks", "1").load(str(deep))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, rows.collect())) and rows.groupBy("path").count().where("count > 1").count() == 0
    os.symlink(deep, tmp_path / "linked")  # a root that is itself a link
    assert {r.path for r in walk(spark, str(tmp_path / "linked")).where("not is_dir").collect()} == want


def test_a_walk_as_a_stream(spark, deep, tmp_path):
    seen = []

    def batch(rows, number):
        seen.append({r.path for r in rows.where("not is_dir").collect()})

    def run():
        q = walk_stream(spark, str(deep), 0).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run()
    assert len(set().union(*seen)) == 23
    seen.clear()
    time.sleep(0.05)
    (deep / "only/top/d9/e/f.txt").write_text("changed")
    (deep / "only/new.txt").write_text("new")
    run()
    assert set().union(*seen) == {"only/top/d9/e/f.txt", "only/new.txt"}
