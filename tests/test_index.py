import os
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenquarry.operators.embed import embedded
from lumenquarry.operators.search import Filters
from lumenquarry.plans.index import Index
from lumenquarry.plans.render import FORMATS, render
from lumenquarry.schema import RUNS, ExitCode, IndexError_
from lumenquarry.sources.catalog import Catalog
from lumenquarry.sources.files import contents, walk
from lumenquarry.streaming.events import event_windows
from lumenquarry.streaming.incremental import upsert_stream


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "docs").mkdir(parents=True)
    (root / "docs/report.md").write_text("# Report\n\nQuarterly earnings grew by ten percent.\n")
    (root / "notes.txt").write_text("blake3 is a fast hash function\n")
    (root / "skip.log").write_text("ignored")
    (root / ".gitignore").write_text("*.log\n")
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        z.writestr("in/side.txt", "hidden treasure inside")
    return root


def test_walk(spark, tree):
    os.symlink(tree, tree / "docs/loop")
    os.link(tree / "notes.txt", tree / "docs/again.txt")
    (tree / ".hidden").mkdir()
    (tree / ".hidden/x").write_text("x")
    got = {r.path: r for r in walk(spark, str(tree)).collect()}
    assert {p for p, r in got.items() if not r.is_dir} == {"docs/report.md", "docs/again.txt", "notes.txt", ".gitignore", "a.zip", ".hidden/x"}
    assert got["notes.txt"].inode == got["docs/again.txt"].inode and got["notes.txt"].size == 31 and got["docs"].is_dir
    assert "skip.log" in {r.path for r in walk(spark, str(tree), ignore_files=False).collect()}
    assert not [r for r in walk(spark, str(tree), hidden=False).collect() if r.path.startswith(".")]
    assert {r.path for r in contents(spark, str(tree / "docs")).select("path", "size").collect()} >= {"report.md", "again.txt"}


def test_life_of_an_index(spark, tree, tmp_path):
    ix = Index.create(spark, str(tmp_path / "idx"))
    with pytest.raises(IndexError_):
        Index.create(spark, str(tmp_path / "idx"))
    with pytest.raises(IndexError_) as e:
        Index.open(spark, str(tmp_path / "none"))
    assert e.value.code == ExitCode.INDEX_NOT_FOUND
    first = ix.reconcile(str(tree))
    assert (first.new_files, first.processed, first.failed) == (4, 4, 0)
    hit = ix.search("earnings")
    assert [r.path for r in hit.rows.collect()] == ["docs/report.md"] and (hit.mode, hit.total, hit.truncated) == ("fts", 1, False)
    assert "<b>earnings</b>" in hit.rows.first().snippet
    assert [r.path for r in ix.search("treasure").rows.collect()] == ["a.zip!/in/side.txt"] and ix.search("absent").total == 0
    assert [r.path for r in ix.search('"fast hash"').rows.collect()] == ["notes.txt"] and ix.search('"hash fast"').total == 0
    assert {r.path for r in ix.search("report", filters=Filters(path="docs/**")).rows.collect()} == {"docs/report.md"} and ix.search("report", filters=Filters(path="x/**")).total == 0
    for form in FORMATS:
        assert "report.md" in render(hit.rows, form)
    ix.put_vectors(ix.chunks().select("file_id", "chunk_ord", F.when(F.col("text").contains("hash"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("v")), 2)
    semantic = ix.search("anything", "semantic", vector=[1.0, 0.1])
    assert semantic.mode == "semantic" and semantic.rows.first().path == "notes.txt"
    both = ix.search("what is the hash of earnings", vector=[1.0, 0.1], explain=True)
    assert both.mode == "hybrid" and {"score_fts", "score_vec"} <= set(both.rows.columns) and both.rows.count() == 5  # a heading and a paragraph, two files, a member
    assert ix.search("anything at all is fine", "semantic").warning
    (tree / "notes.txt").write_text("blake3 is a fast hash function\nand more\n")
    os.remove(tree / "docs/report.md")
    second = ix.reconcile(str(tree))
    assert (second.new_files, second.modified, second.deleted, second.unchanged) == (0, 1, 1, 2)
    assert ix.search("earnings").total == 0 and ix.stats()["deleted"] == 1 and ix.staleness() == "fresh" and ix.refresh(str(tree)) is None
    assert ix.verify(str(tree)).count() == 0 and ix.recover().count() == 0
    (tree / "notes.txt").write_text("x" * 40)
    assert ix.verify(str(tree)).count() == 1
    ix.tag("*.txt", "mine")
    info = ix.info("notes.txt").first()
    assert info.tags == ["mine"] and info.in_fts and info.chunk_count == 1
    assert ix.delete("*.zip", dry_run=True).count() == 1 and ix.search("treasure").total == 1
    ix.delete("*.zip")
    assert ix.search("treasure").total == 0
    assert ix.compact() and ix.search("blake3").total == 1 and ix.stats()["deleted"] == 0


def test_structured_files_in_an_index(spark, tmp_path):
    import struct

    root = tmp_path / "tree"
    (root / "web").mkdir(parents=True)
    (root / "web/page.html").write_text("<html><head><title>Fine &amp; Dandy</title><meta name=\"author\" content=\"Ada\"><meta name=\"description\" content=\"Of ports\"><style>p {color: red}</style></head><body><h1>Harbours</h1><p>Ships <b>sail</b> north.</p><pre>run();</pre></body></html>")
    (root / "bare.html").write_text("<div>only a division</div>")
    (root / "read.md").write_text("# Manual\n\nIntro words.\n\n```\ncode line\n```\n\n## Setup\n- plug it in\n")
    (root / "rows.csv").write_text('name,town\nAda,"Lon,don"\nBob,Rome\n')
    (root / "data.json").write_text('[{"a": 1}, {"a": 2}]')
    (root / "plain.txt").write_text("first block é\n\nsecond block\n")
    (root / "main.py").write_text("def f():\n    return 1\n")
    (root / "pic.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 12, 34) + b"\x08\x02\0\0\0" + b"\0" * 8)
    with zipfile.ZipFile(root / "all.zip", "w") as z:
        z.writestr("in/inner.md", "# Inside\n\nburied words\n")
        z.writestr("../evil.txt", "never")
    ix = Index.create(spark, str(tmp_path / "idx"))
    ix.reconcile(str(root))
    assert ix.catalog.state()["snapshot"] == 1  # all tables in one commit
    paths = {r.path: r for r in ix.manifest().collect()}
    assert paths["all.zip!/in/inner.md"].parent_archive_id == paths["all.zip"].file_id and paths["all.zip!/in/inner.md"].mime_type == "text/markdown"
    assert paths["all.zip!/../evil.txt"].status == 4 and paths["all.zip!/../evil.txt"].error_msg.startswith("[UNSUPPORTED]")
    chunks = {}
    for r in ix.chunks().join(ix.manifest().select("file_id", "path"), "file_id").orderBy("chunk_ord").collect():
        chunks.setdefault(r.path, []).append((r.block_kind, r.text, r.byte_start, r.byte_end))
    assert [c[:2] for c in chunks["web/page.html"]] == [("heading", "Harbours"), ("paragraph", "Harbours\nShips sail north."), ("code", "Harbours\nrun();")]
    assert [c[1] for c in chunks["bare.html"]] == ["only a division"]
    assert [c[:2] for c in chunks["read.md"]] == [("heading", "Manual"), ("paragraph", "Manual\nIntro words."), ("code", "Manual\ncode line"), ("heading", "Setup"), ("list_item", "Setup\nplug it in")]
    assert [c[:2] for c in chunks["rows.csv"]] == [("record", "name: Ada; town: Lon,don"), ("record", "name: Bob; town: Rome")]
    assert [c[1] for c in chunks["data.json"]] == ['{"a":1}', '{"a":2}']
    assert chunks["plain.txt"] == [("paragraph", "first block é", 0, 14), ("paragraph", "second block", 16, 29)]
    assert chunks["main.py"] == [("code", "f\ndef f(): return 1", 0, 21)] and [c[1] for c in chunks["all.zip!/in/inner.md"]] == ["Inside", "Inside\nburied words"]
    meta = {r.path: r for r in ix.content.table("doc_meta").join(ix.manifest().select("file_id", "path"), "file_id").collect()}
    assert tuple(meta["web/page.html"])[1:4] == ("Fine & Dandy", "Ada", "Of ports") and meta["read.md"].title == "Manual"
    media = ix.content.table("media_meta").first()
    assert (media.file_id, media.codec, media.width, media.height) == (paths["pic.png"].file_id, "png", 12, 34)
    assert ix.search("color").total == 0 and ix.search("dandy").rows.first().path == "web/page.html" and ix.search("buried").total == 1
    of = lambda p: sorted(tuple(r)[:7] for r in ix.postings().where(F.col("file_id") == p.file_id).collect())
    before = of(paths["read.md"]), ix.search("sail").rows.first().score_raw
    (root / "plain.txt").write_text("another text altogether\n")
    os.remove(root / "all.zip")
    ix.reconcile(str(root))
    assert of(paths["read.md"]) == before[0] and ix.search("buried").total == 0 and ix.search("altogether").total == 1 and ix.search("second").total == 0
    fast = {r.field: (r.n, r.average) for r in ix.lengths().collect()}
    ix.reindex("fts")
    assert fast == {r.field: (r.n, r.average) for r in ix.lengths().collect()}


def letters():
    return lambda texts: [[float(t.count(c)) + 0.01 for c in "abefh"] for t in texts]


def test_vectors_by_a_model(spark, tree, tmp_path):
    ix = Index.create(spark, str(tmp_path / "idx"))
    ix.reconcile(str(tree))
    chunks = ix.chunks().count()
    assert ix.search("hash", "semantic", embedder=letters()).mode == "fts"  # no vectors yet
    assert ix.embed(letters, 4) == chunks and ix.embed(letters, 4) == 0
    rows = {(r.file_id, r.chunk_ord): r.v for r in ix.stored_vectors().collect()}
    for r in ix.chunks().collect():
        raw = letters()([r.text])[0][:4]
        size = sum(x * x for x in raw) ** 0.5
        assert rows[r.file_id, r.chunk_ord] == pytest.approx([x / size for x in raw], rel=1e-3)
    found = ix.search("what is a hash", "hybrid", embedder=letters(), explain=True, limit=2)
    assert found.mode == "hybrid" and found.total == chunks and found.truncated and found.rows.count() == 2
    (tree / "notes.txt").write_text("quite another text\n")
    ix.reconcile(str(tree))
    assert ix.vectors.table("vectors").count() == chunks - 1 and ix.embed(letters, 4) == 1


def test_embedded(spark):
    rows = spark.createDataFrame([(1, 0, "abba", "x"), (1, 0, "abba", "x"), (2, 0, None, None), (3, 1, "", "y"), (4, 0, "b" * 1_000_000, "z")], "file_id long, chunk_ord int, text string, v string")
    got = sorted((r.file_id, r.v[:2]) for r in embedded(rows, letters, batch=2).collect())
    assert got == [(1, [2.01, 2.01]), (1, [2.01, 2.01]), (2, [0.01, 0.01]), (3, [0.01, 0.01]), (4, [0.01, 1_000_000.01])]
    assert embedded(rows.limit(0), letters).collect() == []
    with pytest.raises(Exception, match="0 vectors for"):
        embedded(rows, lambda: lambda texts: []).collect()


def test_a_run_that_is_stopped(spark, tree, tmp_path):
    ix = Index.create(spark, str(tmp_path / "idx"))
    ix.reconcile(str(tree))
    (tree / "new.txt").write_text("fresh words\n")
    cut = ix.reconcile(str(tree), seconds=0)
    assert cut.cancelled and ix.search("fresh").total == 0 and ix.search("earnings").total == 1
    last = ix.catalog.table("runs", RUNS).orderBy(F.desc("run_id")).first()
    assert (last.run_id, last.timed_out, last.completed_ns) == (cut.run_id, 1, None)
    ix.cancel()  # no run: nothing happens
    seen = []
    worker = threading.Thread(target=lambda: seen.append(ix.reconcile(str(tree))))
    worker.start()
    while worker.is_alive() and not seen:
        ix.cancel()
        time.sleep(0.01)
    worker.join()
    assert seen[0].cancelled
    whole = ix.reconcile(str(tree), seconds=600)
    assert not whole.cancelled and whole.new_files == 1 and ix.search("fresh").total == 1


def test_catalog(spark, tmp_path):
    c = Catalog.create(spark, str(tmp_path / "c"), "[search]\nlimit = 3\n")
    df = spark.range(3)
    assert c.commit({"t": df}, {"k": 5}) == 1 and c.commit({"t": df.union(df)}) == 2
    assert c.table("t", df.schema).count() == 6 and c.state()["values"] == {"k": 5} and c.table("none", df.schema).count() == 0
    assert len(c.vacuum()) == 1 and c.table("t", df.schema).count() == 6
    assert c.lock() and not c.lock(0.2)
    c.unlock()
    assert c.lock()
    assert Index.open(spark, str(tmp_path / "c")).config.search.limit == 3


def test_streams(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v int, n int").schema
    c = Catalog.create(spark, str(tmp_path / "c"))
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 10), (2, 1, 20)], schema).coalesce(1).write.parquet(src)
    run = lambda: upsert_stream(spark, spark.readStream.schema(schema).parquet(src), c, "t", schema, "id", "v", str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(1, 2, 11), (3, 1, 30), (2, 0, 0)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(map(tuple, c.table("t", schema).collect())) == [(1, 2, 11), (2, 1, 20), (3, 1, 30)]


def test_event_stream_equals_the_batch(spark, tmp_path):
    events = spark.sql("select timestamp_seconds(1700000000 + id * 600) as ts, concat('k', id % 2) as event_type, cast(id as double) as value from range(50)")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "1 hour", "10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, event_windows(events).collect()))


def test_progress_of_a_stream(spark, tmp_path):
    from lumenquarry.streaming.progress import ProgressListener

    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    seen = []
    listener = ProgressListener(seen.append)
    spark.streams.addListener(listener)
    try:
        spark.readStream.schema("id long").parquet(str(tmp_path / "p")).writeStream.format("noop").queryName("steps").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 20
        while time.time() < until and not any(p.done for p in seen):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(p.rows for p in seen) == 5 and seen[-1].done
