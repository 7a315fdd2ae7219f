"""Terms, positional postings, segments, leases and stored vectors against brute force."""

import json
import os
import random
import time
import unicodedata
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lumenquarry.functions.analyzer import Analyzer, folded
from lumenquarry.functions.stem import stem
from lumenquarry.operators import ivf as I
from lumenquarry.operators import postings as P
from lumenquarry.operators import search as S
from lumenquarry.plans.index import Index
from lumenquarry.queries import QUERIES
from lumenquarry.schema import IndexError_
from lumenquarry.sources import segments as G
from lumenquarry.sources.catalog import Catalog

PLAIN = Analyzer(False, False)
KEYS = ("file_id", "chunk_ord")
# words of the published sample vocabulary, and one or more for each rule
STEMS = """consign consigned:consign consignment:consign consistency:consist consolation:consol consolatory:consolatori consolingly:consol consonant:conson conspiracy:conspiraci constable:constabl
constancy:constanc knackeries:knackeri knaves:knave knightly:knight knitting:knit knopp:knopp running:run generate:generat generously:generous communism:communism arsenal:arsenal national:nation relational:relat
happy:happi hopping:hop hoping:hope flies:fli dies:die ties:tie skies:sky dying:die agreed:agre luxuriated:luxuri bed:bed shed:shed rational:ration vileness:vile electricity:electr university:univers saying:say boy:boy
gas:gas this:this kiwis:kiwi proceed:proceed inning:inning misses:miss abilities:abil replacement:replac adoption:adopt probate:probat controlling:control rolled:roll news:news gently:gentl only:onli caresses:caress
cries:cri by:by say:say feed:feed plastered:plaster bled:bled sing:sing conflated:conflat troubled:troubl sized:size tanned:tan falling:fall fizzed:fizz filing:file conditional:condit valenci:valenc hesitanci:hesit
digitizer:digit conformabli:conform radicalli:radic vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous
formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:format formalize:formal electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin
gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit adjustment:adjust dependent:depend homologous:homolog effective:effect bowdlerize:bowdler rate:rate cease:ceas roll:roll yes:yes enjoy:enjoy"""


def test_stems():
    for pair in STEMS.split():
        word, _, want = pair.partition(":")
        assert stem(word) == (want or word), word
    rng = random.Random(5)
    for _ in range(3000):
        w = "".join(rng.choice("aeiouyxstlngdbz") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "s", "ed", "ing", "ization", "fulness", "li", "e", "ation"])
        assert 0 < len(stem(w)) <= len(w) + 1


def test_analyzer():
    a = Analyzer()
    assert a.words("Running, RUNS; the café café Straße x_y 2nd") == ["run", "run", "the", "cafe", "cafe", "strass", "x", "y", "2nd"]
    assert a.words("हिन्दी और") == ["हिन्दी", "और"] and folded("Ωμέγα") == "Ωμέγα"
    assert a.words("a " + "b" * 81 + " c") == ["a", None, "c"]
    places, n = a.positions("a " + "b" * 81 + " c a")
    assert places == {"a": [0, 3], "c": [2]} and n == 3
    assert PLAIN.words("Running café") == ["running", "café"]
    text = "Nothing here. " * 20 + "Dogs & runners. The running dog ran. " + "z " * 300 + "dog"
    assert a.snippet(text, frozenset(["run", "dog"]), 40).startswith("<b>Dogs</b> &amp; runners. The <b>running</b> <b>dog</b> ran. z")
    assert a.snippet("<i>no</i> match", frozenset(["absent"])) == "&lt;i&gt;no&lt;/i&gt; match" and a.snippet("", frozenset(["x"])) == ""


def corpus(rng, n):
    return [(i, j, " ".join(rng.choice("abcdefgh") if rng.random() < 0.5 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 50)))) for i in range(n) for j in range(rng.randrange(1, 3))]


def test_phrases_and_booleans(spark):
    rng = random.Random(6)
    rows = corpus(rng, 150) + [(900, 0, None), (901, 0, ""), (902, 0, "a " + "é" * 81 + " b"), (903, 0, "a b"), (904, 0, "A! B? c")]
    d = spark.createDataFrame([(*r, "de" if r[0] % 3 else "fr", "b a c" if r[0] % 5 else "a") for r in rows], "file_id long, chunk_ord int, text string, lang string, title string")
    hits = P.positional(d, {"body": F.col("text"), "title": F.col("title")}, KEYS, PLAIN).join(d.select(*KEYS, "lang"), list(KEYS))

    def tokens(t):
        return [w for w in PLAIN.words(t or "")]

    def found(t, words):
        return any(all(w is None or x == w for w, x in zip(words, t[i : i + len(words)])) and len(t[i : i + len(words)]) == len(words) for i in range(len(t)))

    cases = {
        '"a b"': lambda b, t, lang: found(b, ["a", "b"]) or found(t, ["a", "b"]),
        '"b a c" NOT d': lambda b, t, lang: (found(b, ["b", "a", "c"]) or found(t, ["b", "a", "c"])) and "d" not in b + t,
        'body:"a b c" AND e': lambda b, t, lang: found(b, ["a", "b", "c"]) and "e" in b + t,
        "title:c AND body:h NOT g": lambda b, t, lang: "c" in t and "h" in b and "g" not in b + t,
        f'"a {"x" * 81} b"': lambda b, t, lang: found(b, ["a", None, "b"]) or found(t, ["a", None, "b"]),
        "lang:fr AND w7": lambda b, t, lang: lang == "fr" and "w7" in b + t,
        '"a a" OR "b b"': lambda b, t, lang: found(b, ["a", "a"]) or found(b, ["b", "b"]),
        '"absent words"': lambda b, t, lang: False,
    }
    for text, holds in cases.items():
        clauses = P.analyzed(S.parse_query(text), PLAIN, ("body", "title"))
        terms = {t for row in clauses for c in row for t in c.known if not c.column}
        got = {tuple(r) for r in P.matching(hits.where(F.col("term").isin(*terms)), clauses, KEYS, {"lang": F.col("lang")}).collect()}
        assert got == {(i, j) for i, j, t in rows if holds(tokens(t), tokens("b a c" if i % 5 else "a"), "de" if i % 3 else "fr")}, text


def test_top_k_by_blocks(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["common"] * rng.randrange(1, 4) + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))] + ["rare"] * (5 if i // 128 in (3, 11) and rng.random() < 0.2 else 0))) for i in range(2500)]
    hits = P.positional(spark.createDataFrame(rows, "file_id long, text string"), {"body": F.col("text")}, analyzer=PLAIN).cache()
    lengths, bounds = S.field_lengths(spark.createDataFrame(rows, "file_id long, text string"), {"body": F.col("text")}).cache(), P.block_bounds(hits).cache()
    for terms, k, seeds in ((["rare"], 5, 1024), (["common", "rare"], 10, 1024), (["common", "rare"], 10, 4), (["common", "w3"], 40, 1024), (["none"], 3, 8)):
        best, skipped = P.top_k(hits, bounds, lengths, terms, {"body": 1.0}, k, seeds=seeds)
        want = S.bm25(hits, lengths, terms, {"body": 1.0}).orderBy(F.desc("score"), "file_id").limit(k)
        assert [(r.file_id, round(r.score, 9)) for r in best.collect()] == [(r.file_id, round(r.score, 9)) for r in want.collect()]
        if terms == ["common", "rare"]:
            assert skipped.blocks == 20 and skipped.scored <= 4
    some = spark.range(0, 2500, 2).withColumnRenamed("id", "file_id")
    best, _ = P.top_k(hits, bounds, lengths, ["common", "rare"], {"body": 1.0}, 10, allowed=some)
    assert [r.file_id for r in best.collect()] == [r.file_id for r in S.bm25(hits, lengths, ["common", "rare"], {"body": 1.0}).where("file_id % 2 = 0").orderBy(F.desc("score"), "file_id").limit(10).collect()]


def test_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "FANOUT", 3)
    schema = StructType([StructField("file_id", LongType()), StructField("v", IntegerType())])
    c = Catalog.create(spark, str(tmp_path / "c"))
    g = G.Segments(c, "t", {"rows": schema}, G.FILE)
    assert not g and g.table("rows").count() == 0
    rng, want = random.Random(1), {}
    ids_ = [*range(1, 12), 40_000, 40_001, 1 << 62, (1 << 62) + 5]
    rows = lambda: _grouped(g.table("rows").collect())
    for run in range(5):
        ids = rng.sample(ids_, 4)
        for i in ids[:3]:
            want.pop(i, None)
        want |= {i: [run, run] for i in ids[1:]}
        new = spark.createDataFrame([(i, run) for i in ids[1:] for _ in range(2)], schema)
        c.commit({}, change=g.added({"entries": spark.createDataFrame([(i,) for i in ids[1:]], G.FILE), "rows": new}, spark.createDataFrame([(i,) for i in ids], G.FILE)))
        if due := g.due():
            c.commit({}, change=g.merged(due))
            assert len(g.segments()) < 3
        assert rows() == want
    c.commit({}, change=g.removed(spark.createDataFrame([(i,) for i in list(want)[:2]], G.FILE)))
    for i in list(want)[:2]:
        del want[i]
    assert rows() == want and g.has_deletions()
    stale = g.added({"entries": spark.createDataFrame([(5,)], G.FILE)}, None)
    c.commit({}, change=g.merged())
    assert rows() == want and len(g.segments()) == 1 and not g.has_deletions()
    with pytest.raises(IndexError_):
        c.commit({}, change=stale)  # made before another commit
    assert c.vacuum() and rows() == want and len(os.listdir(tmp_path / "c/data")) == len(g.segments()[0]["paths"])


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.file_id, []).append(r.v)
    return out


def test_leases_and_crashes(spark, tmp_path):
    root = str(tmp_path / "c")
    c = Catalog.create(spark, root)
    with pytest.raises(IndexError_):
        Catalog.create(spark, root)
    assert c.lock(lease_s=2)
    c._lease[1].set()  # the writer dies: nobody renews
    other = Catalog.open(spark, root)
    assert not other.lock() and other.lock(5)
    with pytest.raises(IndexError_, match="taken over"):
        c.commit({}, {"x": 1})
    other.commit({}, {"x": 2})
    c.unlock()
    assert not Catalog.open(spark, root).lock(0.1)  # unlock() of the dead one leaves the other's lease
    other.unlock()
    assert Catalog.open(spark, root).state()["values"] == {"x": 2}
    # a crash before the rename leaves the snapshot before; of two writers of a number one fails
    open(f"{root}/tmp/half", "w").write('{"snap')
    assert c.state()["snapshot"] == 1
    second = json.dumps(c.state() | {"snapshot": 2})
    open(f"{root}/snapshots/{2:012d}.json", "w").write(second)
    late = Catalog.open(spark, root)
    late.state = lambda: json.loads(late._read(f"snapshots/{1:012d}.json"))
    with pytest.raises(IndexError_, match="has committed"):
        late.commit({}, {"x": 3})
    with c.writing(), c.writing():
        assert not Catalog.open(spark, root).lock()
    assert Catalog.open(spark, root).lock()


def written_bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_an_index_in_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lumenquarry.plans.index.HEAVY", 4)
    rng = random.Random(8)
    root = tmp_path / "tree"
    (root / "a!").mkdir(parents=True)
    words = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    for i in range(30):
        (root / f"f{i}.txt").write_text(f"alpha beta {words(400)} running")
    (root / "long.txt").write_text(" ".join(f"q{i}" for i in range(1200)))
    with zipfile.ZipFile(root / "a!/z.zip", "w") as z:
        z.writestr("m.txt", "buried cafés")
    ix = Index.create(spark, str(tmp_path / "i"))
    ix.reconcile(str(root))
    first = written_bytes(tmp_path / "i")
    assert ix.search("buried").rows.first().path == "a!/z.zip!/m.txt" and ix.search("café").total == 1
    hit = ix.search("run", limit=3)
    assert hit.total == 30 and "<b>running</b>" in hit.rows.first().snippet and hit.skipped.blocks == 1
    # a phrase from positions: no chunk text is read before the page; over window edges; a term that is too long
    found = ix.search('"alpha beta" NOT buried')
    assert found.total == 30 and ix.search('"beta alpha"').total == 0 and ix.search('path:long AND body:"q500 q501 q502"').total >= 1
    for at in (510, 1023):
        assert ix.search(f'"{" ".join(f"q{i}" for i in range(at, at + 6))}"').rows.first().path == "long.txt"
    clauses = P.analyzed(S.parse_query('"alpha beta"'), ix.analyzer)
    plan = P.matching(ix._hits({"alpha", "beta"}), clauses, KEYS)
    assert plan.count() == 30 and plan.inputFiles() and all("content-postings" in f for f in plan.inputFiles())
    # a run writes what changes
    (root / "f3.txt").write_text("gamma delta")
    (root / "new.txt").write_text("epsilon alpha")
    os.remove(root / "f4.txt")
    second = ix.reconcile(str(root))
    assert (second.new_files, second.modified, second.deleted) == (1, 1, 1)
    assert written_bytes(tmp_path / "i") - first < first / 2 and len(ix.content.segments()) == 2
    assert ix.search("alpha").total == 29 and ix.search("gamma").total == 1 and ix.search("beta").total == 28
    plain = lambda: (sorted(tuple(r)[:7] for r in ix.postings().collect()), sorted(map(tuple, ix.lengths().collect())), [(r.path, r.score_raw) for r in ix.search("alpha v7 epsilon", limit=50).rows.collect()])
    before = plain()
    ix.compact()
    assert len(ix.content.segments()) == 1 and not ix.content.has_deletions() and plain() == before
    ix.reindex("fts")
    assert plain() == before and ix.checkpoint() > 0 and plain() == before
    assert ix.configure(search={"limit": 2}).search.limit == 2 and Index.open(spark, str(tmp_path / "i")).config.search.limit == 2
    with pytest.raises(IndexError_):
        ix.configure(search={"none": 1})


def test_inverted_lists(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(60, 32)) * 2
    rows = np.concatenate([centers[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 32)) * 0.6])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, v array<double>")
    quantizer = I.trained(v, F.col("vec_id"))
    again = I.Quantizer.of(quantizer.rows())
    assert (again.centroids == quantizer.centroids).all() and (again.books == quantizer.books).all()
    index = I.encoded(v, quantizer).cache()
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("vec_id").alias("n")).collect()}
    bounds = I.radii(index, quantizer)
    assert {x: n for x, (_, n) in bounds.items()} == sizes and sum(sizes.values()) == 3000
    hits = read = 0
    for q in range(0, 3000, 250):
        want = np.argsort(-(rows @ rows[q]), kind="stable")[:10].tolist()
        best = I.search(index, quantizer, rows[q].tolist(), 10, probes=12).orderBy(F.desc("score"), "vec_id").limit(10)
        hits += len({r.vec_id for r in best.collect()} & set(want))
        read += sum(sizes.get(int(x), 0) for x in quantizer.probes(rows[q].astype(np.float32), 12))
    assert hits / 120 >= 0.95 and read / (12 * 3000) < 0.1
    exact, scored = I.search_exactly(index, quantizer, bounds, rows[5].tolist(), 10)
    assert [r.vec_id for r in exact.collect()] == np.argsort(-(rows @ rows[5]), kind="stable")[:10].tolist() and scored < 3000
    back = {r.vec_id: r.v for r in I.unpacked(index, ("vec_id",)).collect()}
    assert np.abs(np.array([back[i] for i in range(3000)]) - rows).max() < 1e-3
    assert I.trained(v.limit(10), F.col("vec_id")) is None and I.encoded(v.limit(0), quantizer).count() == 0


def test_vectors_of_an_index_are_trained(spark, tmp_path):
    rng = np.random.default_rng(10)
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_text("one\n\n" * 1500)
    (root / "b.txt").write_text("two\n\ntwo")
    ix = Index.create(spark, str(tmp_path / "i"))
    ix.reconcile(str(root))
    centers = rng.normal(size=(20, 16))
    rows = [(r.file_id, r.chunk_ord, (centers[r.chunk_ord % 20] + rng.normal(size=16) * 0.1).tolist()) for r in ix.chunks().select("file_id", "chunk_ord").collect()]
    ix.put_vectors(spark.createDataFrame(rows, "file_id long, chunk_ord int, v array<double>"), 16)
    assert ix._quantizer() is not None and ix.vectors.table("vectors").select("list").distinct().count() > 20 and len(ix.vectors.segments()) == 1
    query = rows[7][2]
    near, exact = (ix.search("x", "semantic", vector=query, limit=10, exact=e) for e in (False, True))
    assert near.total == exact.total == len(rows)
    key = lambda h: [(r.file_id, r.chunk_ord) for r in h.rows.collect()]
    assert len(set(key(near)) & set(key(exact))) >= 9
    (root / "a.txt").write_text("gone")
    ix.reconcile(str(root))
    assert ix.search("x", "semantic", vector=query).total == 2


def test_stemmed_terms_query(spark):
    got = {r.term: (r.df, r.total_tf) for r in QUERIES["stemmed_term_stats"](spark, "/root/testdata/sf0.001").collect()}
    df, tf = Counter(), Counter()
    for (text,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        terms = [t for t in Analyzer().words(unicodedata.normalize("NFC", text or "")) if t is not None]
        tf.update(terms)
        df.update(set(terms))
    assert got == {t: (df[t], tf[t]) for t in tf}


def test_time_of_a_lease_is_renewed(spark, tmp_path):
    c = Catalog.create(spark, str(tmp_path / "c"))
    assert c.lock(lease_s=0.6)
    time.sleep(1.5)
    assert not Catalog.open(spark, str(tmp_path / "c")).lock()
    c.unlock()
