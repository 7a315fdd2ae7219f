import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenquarry import config as K
from lumenquarry.functions import globs as G
from lumenquarry.functions import mime as M
from lumenquarry.functions import text as X
from lumenquarry.functions import vectors as V
from lumenquarry.operators import binary as B
from lumenquarry.schema import ExitCode, IndexError_


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


@pytest.mark.parametrize(("text", "want"), [("2GiB", 2147483648), ("1.5KiB", 1536), ("512MB", 512000000), ("12", 12), ("1 t", 10**12)])
def test_sizes(spark, text, want):
    assert K.parse_bytes(text) == want == value(spark, K.bytes_of(F.lit(text)))


@pytest.mark.parametrize(("text", "want"), [("30", 30), ("5m", 300), ("2h", 7200), ("7d", 604800), ("2wks", 1209600)])
def test_durations(spark, text, want):
    assert K.parse_seconds(text) == want == value(spark, K.seconds_of(F.lit(text)))


def test_bad_settings(spark):
    for text in ("12zz", "", "-1"):
        with pytest.raises(IndexError_) as e:
            K.parse_bytes(text)
        assert e.value.code == ExitCode.CONFIG
        assert value(spark, K.bytes_of(F.lit(text))) is None
    with pytest.raises(IndexError_):
        K.Config.from_toml("[search]\nlimits = 1")
    with pytest.raises(IndexError_):
        K.Config.from_toml("= 1")


def test_settings_round_trip():
    c = K.Config.from_toml('[chunking]\ntarget_tokens = 100\n[extraction]\nmax_file_size = "1MiB"\n[refresh]\nthreshold = "2h"')
    assert (c.chunking.target_tokens, c.chunking.overlap_tokens, c.extraction.max_file_size, c.refresh.threshold, c.search.rrf_k) == (100, 128, 2**20, 7200, 60)
    assert K.Config.from_toml(c.to_toml()) == c


def test_tokens(spark):
    assert value(spark, X.tokens(F.lit("Hello, WORLD-2 größe " + "x" * 81))) == ["hello", "world", "2", "größe"]
    assert value(spark, X.fold(F.lit("größe café"))) == "große cafe"
    assert value(spark, X.words(F.lit(" a\u00a0b\tc "))) == ["a", "b", "c"]
    assert value(spark, X.path_terms(F.lit("Docs/q3.pdf"))) == ["docs", "q3", "pdf", "doc", "ocs", "pdf"]
    assert values(spark, [("cafe\u0301",)], "t string", X.nfc("t")) == [("café",)]


@pytest.mark.parametrize(
    ("query", "asked", "empty", "want"),
    [
        ("blake3", "auto", False, "fts"), ("what is blake3", "auto", False, "hybrid"), ('"exact phrase"', "auto", False, "fts"), ("a OR b", "auto", False, "fts"), ("mime:application/pdf", "auto", False, "fts"),
        ("one two three four", "auto", False, "hybrid"), ("one two three four", "auto", True, "fts"), ("x", "semantic", False, "semantic"), ("x", "semantic", True, "fts"), ("x", "hybrid", True, "fts"), ("one two three four", "fts", False, "fts"), ("what is it", "odd", False, "hybrid"),
    ],
)
def test_modes(spark, query, asked, empty, want):
    assert value(spark, X.resolved_mode(F.lit(query), F.lit(asked), F.lit(empty))) == want


def test_snippets(spark):
    s = value(spark, X.snippet(F.lit("a <b> & 'Blake3' is blake3x"), ["blake3"]))
    assert s == "a &lt;b&gt; &amp; &#x27;<b>Blake3</b>&#x27; is blake3x"
    assert value(spark, X.html_unescape(F.lit("&amp;lt; &lt;"))) == "&lt; <"
    assert value(spark, X.snippet(F.lit("nothing here"), ["zzz"])) == "nothing here"


def test_targets_and_paths(spark):
    assert values(spark, [("host:/a/b",), ("/a:b",), ("C:x",), ("a/b:c",)], "t string", X.host_of(F.col("t")), X.path_of(F.col("t"))) == [("host", "/a/b"), ("", "/a:b"), ("", "C:x"), ("", "a/b:c")]
    assert X.json_path(b'a"\xff\xc3\xa9\n') == 'a\\"\\u00ffé\\n'
    assert value(spark, X.member_display(X.member_path(F.lit("a.zip"), F.lit("b/c")))) == "a.zip → b/c"
    assert X.exit_code(IndexError_("", ExitCode.SCHEMA)) == 6 and X.exit_code(KeyboardInterrupt()) == 130 and X.exit_code(None) == 0 and X.exit_code(ValueError()) == 1


def test_language(spark):
    rows = [("the house and the tree are of the town",), ("le chien et le chat dans la maison pour",), ("der Hund und die Katze sind nicht da",), ("el perro y los gatos en la casa",), ("xx yy zz ww vv uu tt",), ("short",)]
    assert [r[0] for r in values(spark, rows, "t string", X.language(F.col("t")))] == ["en", "fr", "de", "es", None, None]


def test_globs(spark):
    ok = lambda g, p: value(spark, G.glob_match(F.lit(p), g))
    assert ok("invoices/**/*.pdf", "invoices/a/b/x.pdf") and ok("invoices/**/*.pdf", "invoices/x.pdf") and not ok("invoices/*.pdf", "invoices/a/x.pdf")
    assert ok("image/*", "image/png") and ok("{a,b}?.[!x]", "bq.y") and not ok("{a,b}?.[!x]", "bq.x")


def test_ignore_rules(spark):
    rules = G.IgnoreRules("*.log\nbuild/\n/top.txt\n", "!keep.log\n")
    paths = ["a.log", "x/a.log", "keep.log", "build/x/y", "src/build/z", "top.txt", "sub/top.txt", "a.txt"]
    want = [True, True, False, True, True, True, False, False]
    assert [rules.ignored(p) for p in paths] == want
    assert [r[0] for r in values(spark, [(p,) for p in paths], "p string", rules.column(F.col("p")))] == want


def test_kinds(spark):
    rows = [("masquerade.txt", b"\x89PNG\r\n\x1a\n.."), ("blob", b"a\0b"), ("README", b"text"), ("CMakeLists.txt", b"x"), ("a.tar.gz", b"x"), ("x.rs", b"fn"), ("s.svg", b"<svg"), ("v.mp4", b"x")]
    got = values(spark, rows, "p string, c binary", M.detect(F.col("p"), F.col("c")), M.extractor(M.detect(F.col("p"), F.col("c"))))
    assert got == [("image/png", "image"), ("application/octet-stream", "skip"), ("text/plain", "plaintext"), ("text/x-cmake", "plaintext"), ("application/gzip", "archive"), ("text/x-rust", "plaintext"), ("image/svg+xml", "html"), ("video/mp4", "metadata")]
    assert [r[0] for r in values(spark, [('{"a":1}',), (" [1]",), ('{"a":1}\n{"a":2}',), ("x",)], "t string", M.json_variant(F.col("t")))] == ["object", "array", "ndjson", None]
    assert [r[0] for r in values(spark, [("a.log", ""), ("b", "x\n2024-01-02T03:04:05 hi"), ("c", "x")], "p string, t string", M.is_log(F.col("p"), F.col("t")))] == [True, True, False]


def test_archive_safety(spark):
    names = ["/etc/passwd", "../../etc/passwd", "a\0b", "dir\\..\\x", "2024/Q3-report.pdf"]
    assert [r[0] for r in values(spark, [(n,) for n in names], "n string", M.unsafe_member(F.col("n")))] == [True, True, True, True, False]
    assert [r[0] for r in values(spark, [(1, 300), (1, 100), (0, 0), (10, 2009)], "c long, s long", M.ratio_exceeded(F.col("c"), F.col("s"), 200))] == [True, False, False, False]
    assert [r[0] for r in values(spark, [("a/id.PEM",), ("my_secret.txt",), ("keys/plain.txt",)], "p string", M.sensitive(F.col("p")))] == [True, True, False]


def test_vectors(spark):
    a, b = F.array(*[F.lit(float(x)) for x in (3, 4, 0)]), F.array(*[F.lit(float(x)) for x in (4, 3, 12)])
    assert value(spark, V.dot(a, b)) == 24 and abs(value(spark, V.cosine(a, b)) - 24 / 65) < 1e-12
    assert value(spark, V.shortened(b, 2)) == [0.8, 0.6]


def test_decoding(spark):
    rows = [(b"\xff\xfeh\0i\0",), (b"\xef\xbb\xbfhi",), (b"\xfe\xff\0h\0i",), ("é".encode(),), (b"caf\xe9",), (b"",)]
    got = values(spark, rows, "c binary", B.decoded("c"), B.bom(F.col("c")))
    assert got == [("hi", "utf-16-le"), ("hi", "utf-8"), ("hi", "utf-16-be"), ("é", None), ("café", None), ("", None)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab/*?.[]!{},", max_size=12), st.text(alphabet="ab/.", max_size=12))
def test_any_glob_is_a_pattern(glob, path):
    import re

    re.match(G.glob_regex(glob), path)
    assert re.match(G.glob_regex("**"), path)


def test_dates(spark):
    from lumenquarry.functions import dates as D

    now = 1_700_000_000 * 10**9
    assert D.parse_when("2w", now) == now - 14 * 86400 * 10**9 and D.parse_when("3m", now) == now - 90 * 86400 * 10**9
    assert D.parse_when("2024-05-01", now) == 1714521600 * 10**9 == D.parse_when("2024-05-01T02:00:00+02:00", now)
    with pytest.raises(IndexError_):
        D.parse_when("soon", now)
    assert value(spark, D.timestamp_of_ns(F.lit(1714521600123456789)).cast("string")) == "2024-05-01 00:00:00.123456"


def test_sentences_and_headings(spark):
    assert value(spark, X.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    assert value(spark, X.with_prefix(F.lit("H"), F.lit("t"))) == "H\nt" and value(spark, X.with_prefix(F.lit(None).cast("string"), F.lit("t"))) == "t"
    assert [r[0] for r in values(spark, [("", 2), ("x" * 30, 2), (None, 0)], "t string, p int", X.scanned(F.col("t"), F.col("p")))] == [True, False, False]
