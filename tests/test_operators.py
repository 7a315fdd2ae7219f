import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenquarry.config import Archives
from lumenquarry.operators import binary as B
from lumenquarry.operators import chunk as C
from lumenquarry.operators import extract as E
from lumenquarry.operators import manifest as N
from lumenquarry.operators import search as S
from lumenquarry.sources.archives import archive_members


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(("n", "windows"), [(0, 0), (1, 1), (512, 1), (513, 2), (896, 2), (897, 3), (1000, 3)])
def test_windows(spark, n, windows):
    d = spark.createDataFrame([(1, "word " * n)], "file_id long, text string")
    got = rows(C.chunk_windows(d, "file_id", F.col("text")), "chunk_ord")
    assert [r[1] for r in got] == list(range(windows))
    if windows:
        assert got[-1][2] + got[-1][3] == n and all(r[3] == 512 for r in got[:-1])


def test_window_overlap_is_less_than_the_window(spark):
    d = spark.createDataFrame([(1, "a b c d e")], "file_id long, text string")
    assert [r[4] for r in rows(C.chunk_windows(d, "file_id", F.col("text"), 2, 9), "chunk_ord")] == ["a b", "b c", "c d", "d e"]


def test_blocks_have_byte_offsets(spark):
    d = spark.createDataFrame([(1, "é one\n\n  \n\ntwo\n\n")], "file_id long, text string")
    text = "é one\n\n  \n\ntwo\n\n".encode()
    got = rows(C.blocks(d, "file_id", F.col("text")), "block_ord")
    assert [r[4] for r in got] == ["é one", "two"] and [text[r[2] : r[3]].decode() for r in got] == ["é one", "two"]
    assert rows(C.merged(C.blocks(d, "file_id", F.col("text")), "file_id", 3), "chunk_ord") == [(1, 0, 0, 3, "é one\n\ntwo")]
    assert len(rows(C.merged(C.blocks(d, "file_id", F.col("text")), "file_id", 2), "chunk_ord")) == 2


def test_headings_reach_down(spark):
    d = spark.createDataFrame([(1, i, h) for i, h in enumerate([None, "A", None, "B", None])], "d long, i int, h string")
    assert [r[3] for r in rows(C.with_heading(d, "d", "i", "h"), "i")] == [None, "A", "A", "B", "B"]


def test_bm25_from_scan_and_from_postings_agree(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "red red dog dog dog"), (3, "blue"), (4, None)], "file_id long, text string")
    scan = {r.file_id: r.score for r in S.bm25_scan(d, "file_id", {"body": (F.col("text"), 1.0)}, ["red", "fox"]).collect()}
    known = d.where("text is not null")
    index = S.bm25(S.postings(known, {"body": F.col("text")}), S.field_lengths(known, {"body": F.col("text")}), ["red", "fox"], {"body": 1.0})
    scan3 = {r.file_id: r.score for r in S.bm25_scan(known, "file_id", {"body": (F.col("text"), 1.0)}, ["red", "fox"]).collect()}
    assert {r.file_id: round(r.score, 12) for r in index.collect()} == {k: round(v, 12) for k, v in scan3.items()}
    assert set(scan) == {1, 2} and scan[1] > scan[2]


def test_queries(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma", "en"), (2, "alpha delta", "fr"), (3, "beta gamma delta", "en"), (4, None, None)], "id long, body string, lang string")
    fields = {"body": F.col("body"), "lang": F.col("lang")}
    hit = lambda q: [r.id for r in d.where(S.query_predicate(S.parse_query(q), fields)).orderBy("id").collect()]
    assert hit("alpha") == [1, 2] and hit("alpha beta") == [1, 2, 3] and hit("alpha AND beta") == [1] and hit("alpha OR delta") == [1, 2, 3]
    assert hit('"beta gamma"') == [1, 3] and hit('"gamma beta"') == [] and hit("delta NOT alpha") == [3] and hit("lang:fr") == [2] and hit("lang:en AND delta") == [3] and hit("") == []


def test_filters_are_inclusive_and_nulls_fail(spark):
    d = spark.createDataFrame([(1, 10, 5, "a/b.txt", ["x"], "en", "text/plain"), (2, 20, 6, "c.txt", ["y", "x"], "fr", "image/png"), (3, None, None, None, None, None, None)], "id long, size long, mtime_ns long, path string, tags array<string>, lang string, mime_type string")
    hit = lambda **f: [r.id for r in d.where(S.Filters(**f).predicate()).orderBy("id").collect()]
    assert hit() == [1, 2, 3] and hit(larger=20) == [2] and hit(smaller=10) == [1] and hit(after_ns=5, before_ns=5) == [1] and hit(mime="image/*") == [2] and hit(path="*.txt") == [2] and hit(tags=["y", "q"]) == [2] and hit(lang="en") == [1]


@pytest.mark.parametrize(("scores", "want"), [([1, 2, 3], [0, 0.5, 1]), ([5, 5, 5], [1, 1, 1]), ([42], [1]), ([], []), ([-2, 0, 2], [0, 0.5, 1])])
def test_min_max(spark, scores, want):
    d = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i long, score double")
    assert [r[2] for r in rows(S.min_max(d), "i")] == want
    assert [r[2] for r in rows(S.min_max(d.withColumn("g", F.lit(1)), ("g",)).drop("g"), "i")] == want


def test_rrf(spark):
    fts = spark.createDataFrame([(1, 1, 9.0), (2, 2, 8.0)], "file_id long, rank long, score double")
    vec = spark.createDataFrame([(1, 1, 0.9), (3, 2, 0.8)], "file_id long, rank long, score double")
    got = {r.file_id: r.score for r in S.hybrid(fts, vec).collect()}
    assert got[1] == 2 / 61 and got[2] == got[3] == 1 / 62
    assert {r.file_id: r.score for r in S.hybrid(fts, vec, fts_weight=2.0).collect()}[2] == 2 / 62
    assert [r[:2] for r in rows(S.ranked(S.hybrid(fts, vec), 2, offset=1), "rank")] == [(2, round(1 / 62, 6)), (3, round(1 / 62, 6))]


def test_knn(spark):
    d = spark.createDataFrame([(i, [i / 10, 1 - i / 10]) for i in range(10)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in S.knn(d, [1.0, 0.0], 3).orderBy("rank").collect()] == [9, 8, 7]


MANIFEST = "path string, file_id long, size long, mtime_ns long, status int, fail_count int, first_seen_ns long, error_msg string, last_verified_ns long"


def manifest(spark):
    return spark.createDataFrame([("same", 1, 5, 1, 1, 0, 7, None, 1), ("bigger", 2, 5, 1, 1, 0, 7, None, 1), ("gone", 3, 5, 1, 1, 0, 7, None, 1), ("back", 4, 5, 1, 3, 0, 7, None, 1), ("failed", 5, 5, 1, 2, 2, 7, "[DEFERRED] x", 1), ("dead", 6, 5, 1, 3, 0, 7, None, 1)], MANIFEST)


def test_reconciling(spark):
    walk = spark.createDataFrame([("same", 5, 1), ("bigger", 6, 1), ("back", 5, 1), ("failed", 5, 1), ("fresh", 1, 1), ("fresher", 1, 1)], "path string, size long, mtime_ns long")
    d = N.diff(walk, manifest(spark))
    assert {r.path: r.change for r in d.collect()} == {"same": "unchanged", "bigger": "modified", "gone": "deleted", "back": "modified", "failed": "modified", "fresh": "new", "fresher": "new"}
    assert tuple(N.counts(d).first()) == (2, 3, 1, 1, 5)
    up = {r.path: r for r in N.upsert(manifest(spark), walk, 99).collect()}
    assert sorted(up[p].file_id for p in ("fresh", "fresher")) == [7, 8] and up["fresh"].first_seen_ns == 99
    assert (up["bigger"].size, up["bigger"].status, up["bigger"].first_seen_ns) == (6, 0, 7) and up["failed"].fail_count == 2 and up["dead"].status == 3


def test_states(spark):
    outcome = spark.createDataFrame([(1, 2, "slow"), (5, 2, "slow"), (2, 1, None)], "file_id long, new_status int, error string")
    got = {r.file_id: tuple(r)[1:4] for r in N.transition(manifest(spark), outcome, 50).collect()}
    assert got[1] == (2, 1, "slow") and got[5] == (4, 3, "slow") and got[2] == (1, 0, None) and got[3] == (1, 0, None)
    ages = [0, 3600, 7200, 8 * 86400, None, -5]
    d = spark.createDataFrame([(i, None if a is None else 10**18 - a * 10**9) for i, a in enumerate(ages)], "i int, t long")
    assert [r[0] for r in d.orderBy("i").select(N.staleness(F.col("t"), F.lit(10**18))).collect()] == ["fresh", "stale", "stale", "warn", "warn", "fresh"]


def test_members_go_with_their_archives(spark):
    m = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, None)], "file_id long, parent_archive_id long")
    assert {r.file_id for r in N.with_members(m.where("file_id = 1"), m).collect()} == {1, 2, 3, 4}


def test_ledgers_links_and_duplicates(spark):
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "file_id long, status int")
    p = spark.createDataFrame([(1, "fts", 3), (2, "fts", 2)], "file_id long, index_name string, schema_ver int")
    assert [r.file_id for r in N.missing_progress(m, p, "fts", 3).collect()] == [2]
    f = spark.createDataFrame([(1, 9, 4), (2, 9, 4), (3, 9, None), (4, 8, 4)], "file_id long, inode long, dev long").withColumnRenamed("inode", "x").select("file_id", F.col("x").alias("dev"), F.col("dev").alias("inode"))
    assert dict(rows(N.hard_links(f), "file_id")) == {1: None, 2: 1, 3: None, 4: None}
    h = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 5), (4, "c", 0), (5, "c", 0)], "file_id long, content_hash string, size long")
    assert rows(N.duplicates(h), "first_id") == [("a", 5, 2, 1, 5)]
    assert rows(N.corrupted(h, h.withColumn("content_hash", F.expr("case when file_id = 3 then 'z' when file_id < 3 then content_hash end"))), "file_id") == [(3, "b", "z"), (4, "c", None), (5, "c", None)]


def test_markup(spark):
    html = '<html><head><title>A &amp; <b>B</b></title><meta name="author" content="Me"></head><body><h1>Top</h1><p class="x">One <i>two</i></p><script>var p="</p>"</script><!-- <p>no</p> --><ul><li>item</li></ul><pre>code</pre></body></html>'
    d = spark.createDataFrame([(1, html)], "id long, html string")
    h = F.col("html")
    assert tuple(d.select(E.html_title(h), E.html_meta(h, "author"), E.html_meta(h, "none"), E.html_text(h)).first()) == ("A & B", "Me", None, "A & B Top One two item code")
    assert [(r.kind, r.level, r.text) for r in E.html_blocks(d, "id", h).orderBy("block_ord").collect()][:2] == [("heading", 1, "Top"), ("paragraph", None, "One two")]
    md = spark.createDataFrame([(1, "# Title\n\ntext\n```\n# not\n```\n- item\n> said")], "id long, t string")
    assert [(r.kind, r.level, r.text) for r in E.markdown_blocks(md, "id", F.col("t")).orderBy("line_ord").collect()] == [("heading", 1, "Title"), ("paragraph", None, "text"), ("code", None, "# not"), ("list_item", None, "item"), ("quote", None, "said")]


def test_records(spark):
    one = lambda t: spark.createDataFrame([(1, t)], "id long, t string")
    got = lambda d: [r.text for r in d.orderBy("record_ord").collect()]
    assert got(E.csv_records(one('a;b\n1;"x\ny"\n2;z'), "id", F.col("t"))) == ["a: 1; b: x\ny", "a: 2; b: z"]
    assert got(E.json_records(one('[{"a":1},2]'), "id", F.col("t"))) == ['{"a":1}', "2"]
    assert got(E.json_records(one('{"a":1}\n{"a":2}\n'), "id", F.col("t"))) == ['{"a":1}', '{"a":2}']
    assert got(E.json_records(one('{"a":1,"b":"x"}'), "id", F.col("t"))) == ['{"a":"1"}', '{"b":"x"}']
    assert got(E.sql_statements(one("select 1;\n\n select 2 ; "), "id", F.col("t"))) == ["select 1", "select 2"]
    assert got(E.log_batches(one("a\nb\nc\nd\ne"), "id", F.col("t"), 2)) == ["a\nb", "c\nd", "e"]


def docx():
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Bo</w:t></w:r><w:r><w:t>dy</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("docProps/core.xml", '<c:p xmlns:c="x" xmlns:d="y"><d:title>T</d:title><d:creator>C</d:creator></c:p>')
    return out.getvalue()


def test_binary_formats(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 30, 20) + b"\x08\2\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 12
    entries = struct.pack("<HHII", 0x010F, 2, 3, int.from_bytes(b"Ab\0\0", "little")) + struct.pack("<HHII", 0x8827, 3, 1, 200)
    exif = b"\xff\xd8" + b"Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entries + b"\0" * 4
    assert B.image_size(png) == ("png", 30, 20) and B.image_size(jpeg) == ("jpeg", 6, 5) and B.image_size(b"GIF89a" + struct.pack("<HH", 7, 8)) == ("gif", 7, 8)
    assert B.exif(exif) == {"camera_make": "Ab", "iso": "200"}
    assert B.docx_paragraphs(docx()) == [("heading", 2, "Head"), ("paragraph", None, "Body")]
    d = spark.createDataFrame([(1, "image", png), (2, "docx", docx()), (3, "pdf", b"%PDF"), (4, "docx", b"junk"), (5, "plaintext", b"hi"), (6, "image", None)], "i int, x string, c binary")
    got = {r.i: r.e for r in d.select("i", B.extracted("x", "c").alias("e")).collect()}
    assert got[1].meta["width"] == "30" and got[2].text == "Head\n\nBody" and got[2].meta["title"] == "T" and got[5].text == "hi"
    assert got[3].error.startswith("[UNSUPPORTED] pdf") and got[4].error.startswith("[UNSUPPORTED]") and got[6].error is None


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/"), content)
    return out.getvalue()


def test_archives(spark):
    import gzip

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("in/a.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    nested = zipped(l1=zipped(l2=zipped(l3=zipped(l4="deep"))))
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../up.txt", "x")
        z.writestr("fine.txt", "y")
    d = spark.createDataFrame([("a.zip", zipped(d__x="one", y="two")), ("t.tar.gz", gzip.compress(tar.getvalue())), ("n.zip", nested), ("e.zip", evil.getvalue()), ("bomb.zip", zipped(z="0" * 5_000_000)), ("bad.zip", b"PK\x03\x04junk"), ("no.txt", b"plain"), ("null.zip", None)], "path string, content binary")
    got = {(r.path): r for r in archive_members(d).collect()}
    assert bytes(got["a.zip!/d/x"].content) == b"one" and bytes(got["t.tar.gz!/t.tar!/in/a.txt"].content) == b"abc"
    assert got["n.zip!/l1!/l2!/l3"].error == "[UNSUPPORTED] nested too deep" and got["e.zip!/../up.txt"].error and bytes(got["e.zip!/fine.txt"].content) == b"y"
    assert got["bomb.zip"].error and got["bad.zip"].error and not any(p.startswith(("no.txt", "null.zip")) for p in got)
    few = archive_members(d.where("path = 'a.zip'"), Archives(max_members=1)).collect()
    assert [r.error is None for r in few] == [True, False]


def test_archive_limits(spark):
    m = spark.createDataFrame([("a", i, 10, 10 if i != 2 else 5000) for i in range(5)], "archive_id string, ord long, compressed long, size long")
    assert [r.allowed for r in N.archive_limits(m, 10_000, 4, 200).orderBy("ord").collect()] == [True, True, False, True, False]


def test_long_blocks_are_cut_between_sentences(spark):
    d = spark.createDataFrame([(1, 0, "a b c. d e. f g h i j k l.")], "file_id long, block_ord int, text string")
    got = rows(C.sentence_chunks(d, "file_id", "block_ord", F.col("text"), 5, 4), "piece")
    assert [r[4] for r in got] == ["a b c. d e.", "f g h i", "j k l."] and [r[3] for r in got] == [5, 4, 3]


def test_work_and_leftovers(spark):
    w = spark.createDataFrame([("b/x", 1, 1), ("a/y", 1, 1)], "path string, size long, mtime_ns long")
    again = spark.createDataFrame([("b/x", 1, 2), ("a/y", 1, 1)], "path string, size long, mtime_ns long")
    assert [r.path for r in N.still_as_walked(w, again).collect()] == ["a/y"]
    assert [r.path for r in N.prioritized(w, ["X"]).collect()] == ["b/x", "a/y"]
    m = spark.createDataFrame([(1, None), (2, 1)], "file_id long, parent_archive_id long")
    assert [r.file_id for r in N.orphans(spark.createDataFrame([(1,), (9,)], "file_id long"), m).collect()] == [9]
    assert rows(N.tree_of_archives(m), "members") == [(1, 1)]


def test_knn_of_many_queries(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = rng.normal(size=(400, 6)).round(1)  # ties
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(900, None), (901, [1.0]), (902, [None] * 6)], "vec_id long, v array<double>").repartition(3)
    q = spark.createDataFrame([(i, rows[i].tolist()) for i in range(0, 400, 7)] + [(1000, None)], "query_id long, q array<double>")
    want = []
    for i in range(0, 400, 7):
        scores = [(-round(float(rows[i] @ r), 6), j) for j, r in enumerate(rows)]
        want += [(i, j, -s, rank) for rank, (s, j) in enumerate(sorted(scores)[:5], 1)]
    for size in (1 << 20, 2000):
        monkeypatch.setattr(S, "QUERY_BYTES", size)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in S.knn_batch(q, v, 5).collect())
        assert [(a, c) for a, _, c, _ in got] == [(a, c) for a, c, _, _ in sorted(want, key=lambda x: (x[0], x[3]))] and np.allclose([x[3] for x in got], [x[2] for x in sorted(want, key=lambda x: (x[0], x[3]))])
    assert S.knn_batch(q.limit(0), v, 5).count() == S.knn_batch(q, v.limit(0), 5).count() == 0 and S.knn_batch(q, v.where("vec_id < 3"), 5).count() == 3 * 58
