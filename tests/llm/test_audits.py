"""Filter interactions, source divergence and quality against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from lumenquarry.llm import quality as Q
from lumenquarry.llm import source_divergence as D
from lumenquarry.llm.filter_audit import Bitmaps, filter_interactions, order_report, subset_counts
from lumenquarry.llm.queries import oracle_sql

DOCS = "doc_id long, text string, lang string, source string, fails int, digest binary, salt int, part string, good boolean"


def fails(rows):
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append("".join(f for f, bad in (
            ("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", re.search(r"[#$%&*|]", t)),
            ("E", doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in rows)),
        ) if bad))
    return out


def report(rows, labels):
    bad, good, toxic = fails(rows), {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    parts, out = defaultdict(list), []
    for r, f in zip(rows, bad):
        parts[r[3] or ""].append((r[0], f))
    for part, docs in parts.items():
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, kept = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                found.append(("".join(order), step, len(kept), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == f for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f))
                left = kept
        out += [(part, *x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, b"x", 2, "p", True) for r in rows], DOCS)


def test_filter_interactions(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    texts = [None, "", " \t\n", "A", "é" * 19 + "A", "é" * 20 + "A", "a|b", "x\u0085y z", " ".join(["the"] * 60), " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), " ".join(f"W{i % 33}" for i in range(50)), " ".join(f"w{i % 32}" for i in range(50)), "LONG " * 100_000]
    rows = [(i, t, "en", rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, " ".join(word() for _ in range(rng.choice([3, 55, 200]))) + rng.choice(["", " A#", "B" * 30]), "en", rng.choice("ab")) for i in range(60)]
    rows += [(200 + i, rng.choice(rows)[1], "fr", rng.choice("abc")) for i in range(60)] + [(None, "A", "en", "a"), (None, None, "en", "c"), (5, "a|b", "en", "a"), (5, "other", "en", "b"), (300, "a|b", "en", "a"), (300, "a|b", "en", "a")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in [*range(0, 320, 2), 5, 5, None]]
    marks = spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, toxic int, salt int")
    got = sorted(map(tuple, filter_interactions(table(spark, rows).repartition(5), marks).collect()))
    assert got == report(rows, labels)
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert filter_interactions(table(spark, rows).limit(0), marks).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in filter_interactions(table(spark, rows), marks.limit(0)).collect()} == {(0, 0)}


def test_bitmaps_of_many_parts():
    rng = np.random.default_rng(3)
    parts, bad, good = rng.integers(0, 400, 3000), rng.integers(0, 8, 3000), rng.random(3000) < 0.5
    maps = Bitmaps(parts, bad, 3, [good])
    for subset, (n, n_good) in maps.survivors():
        left = (bad & subset) == 0
        assert n.tolist() == [int((left & (parts == p)).sum()) for p in maps.parts] and n_good.tolist() == [int((left & good & (parts == p)).sum()) for p in maps.parts]


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", 3, True, None), ("p", 1, False, True), ("p", 0, True, True), ("q", 2, None, False)], "part string, fails int, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): r for r in order_report(subset_counts(rows, 2, ("good", "toxic")), "XY").collect()}
    first = got["p", "XY", 1]
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.good_lost, first.toxic_lost, first.shapley) == (1, 2, 0, 1, 1, 1, 3)
    second = got["p", "XY", 2]
    assert (second.kept, second.removed, second.redundant, second.unique_fails, second.shapley) == (1, 0, 1, 0, 1) and got["q", "YX", 1].removed == 1
    with pytest.raises(ValueError):
        subset_counts(rows, 8, ())


def divergence(rows, least, top):
    groups = {((r[2] or ""), (r[3] or "")) for r in rows}
    words = [((r[2] or ""), (r[3] or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {g[0] for g in groups}:
        df = Counter(t for a, _, w in words if a == lang for t in set(w))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: Counter(t for a, b, w in words if (a, b) == (lang, s) for t in w if t in kept) for a, s in groups if a == lang}
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = p(whole)
        for s, c in count.items():
            mine = p(c)
            far = [(o, sum(abs(mine[t] - v) for t, v in p(count[o]).items())) for o in count if o != s]
            out += [(lang, s, "pair", o, v, i) for i, (o, v) in enumerate(sorted(far, key=lambda x: (-x[1], x[0].encode())), 1)]
            more = sorted(((t, mine[t] - q[t]) for t in kept if c[t] and mine[t] > q[t]), key=lambda x: (-x[1], x[0].encode()))[:top]
            out += [(lang, s, "term", t, v, i) for i, (t, v) in enumerate(more, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 4])
def test_source_divergence(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_TERMS", block)
    rng = random.Random(12)
    vocabulary = ["The", "THE", "the", "été", "Été", "naïve", "İx", "Ｚ", "🙂🙂", "a1b", "x_y", "don't", "\u0085", "ß"] + [f"{c}{d}" for c in "pqrs" for d in "tuvw"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", "Z", None])) for i in range(150)]
    rows += [(200, None, "en", "none"), (201, "12 34", "en", "digits"), (202, "one source", "xx", "only"), (203, "", "yy", "a"), (204, "rare words", "yy", "b"), (None, "the the", "en", "a"), (1, "the the", "en", "a"), (1, "the the", "en", "a"), (205, "long " * 400_000, "en", "a")]
    got = sorted(map(tuple, D.source_divergence(table(spark, rows).repartition(5), 5, 7).collect()))
    assert got == divergence(rows, 5, 7)
    assert D.source_divergence(table(spark, rows).limit(0)).count() == 0


def test_counts_are_handed_on_in_parts(spark):
    rows = [(i, f"w{chr(97 + i % 26)} both {'é' * (i % 9)}", "en", f"s{i % 3}") for i in range(300)]
    total = lambda d: sorted(map(tuple, d.groupBy("lang", "source", "term").sum("n", "df").collect()))
    whole = total(D.term_counts(table(spark, rows)))
    parts = D.term_counts(table(spark, rows), held=4)
    assert total(parts) == whole and parts.count() > len(whole)


def test_smoothing_is_exact(spark):
    big = 9 * 10**15
    got = spark.createDataFrame([(big, 3 * big + 1, 10**6), (0, 0, 3), (0, 0, 0)], "c long, t long, v long").select(D.smoothed("c", "t", "v")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (big + 5) // (3 * big + 1 + 5 * 10**6), 1 + 10**9 // 3, None]


def junk(rng, label):
    words = ["".join(rng.choice("aeiourstnl") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 90))]
    if label:
        return " ".join(words)
    kind = rng.randrange(3)
    return " ".join(w + "$$" for w in words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(w for w in words[:4] for _ in range(20))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(13)
    labels = [(i, int(rng.random() < 0.8)) for i in range(900)]
    texts = {i: junk(rng, q) for i, q in labels}
    rows = [(i, t, "en", "a") for i, t in texts.items()]
    marks = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.quality(table(spark, rows), marks, sample=200).collect()}
    out = [(i, q) for i, q in labels if got[i].held_out]
    assert {i for i, _ in out} == {i for i, h in zip(texts, Q.held_out(list(texts))) if h} and 150 < len(out) < 300
    assert sum(got[i].predicted == q for i, q in out) / len(out) > 0.95 and all(r.predicted == (r.score >= 0.7) for r in got.values())
    # labels of held-out rows teach nothing
    flipped = spark.createDataFrame([(i, 1 - q if got[i].held_out else q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in Q.quality(table(spark, rows).repartition(3), flipped, sample=200).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_quality_of_awkward_rows(spark):
    long = "word " * 300_000 + "Ω" * 1_200_000
    rows = [(1, None, "", "a"), (2, "", "", "b"), (None, "text", "", "c"), (3, "text", None, None), (3, "text", "", ""), (4, long, "", ""), (5, " \t", "", ""), (6, "a", "", "")]
    marks = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 0), (6, 1), (99, 0)], "doc_id long, quality int")
    got = sorted(((r.doc_id or 0, r.score) for r in Q.quality(table(spark, rows), marks).collect()))
    assert [d for d, _ in got] == [0, 1, 2, 3, 3, 4, 5, 6] and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    assert score[0] == score[3] and score[1] == score[2] and Q.quality(table(spark, rows).limit(0), marks).count() == 0
    assert {r.score for r in Q.quality(table(spark, rows), marks.limit(0)).collect()} == {0.5}


def test_features_by_force():
    def brute(text):
        words = text.split()
        out = Counter()
        for n in Q.GRAMS:
            for w in words:
                p = b" " + w + b" "
                out[n] += len(p) - n + 1
        return out

    texts = [b"ab c", b"", b" x\t\tyz ", "été là".encode(), b"a", b"a a a a b"]
    kinds = list(Q.features(texts))
    assert kinds[0][0].tolist() == list(range(len(texts))) and np.bincount(kinds[1][0], minlength=len(texts)).tolist() == [len(t.split()) for t in texts]
    for n, (owner, _) in zip(Q.GRAMS, kinds[3:]):
        assert np.bincount(owner, minlength=len(texts)).tolist() == [brute(t)[n] for t in texts]
    one = [np.sort(b) for _, b in Q.features([texts[3]])][-len(Q.GRAMS) :]
    many = [np.sort(b[o == 3]) for o, b in kinds[3:]]
    assert all((a == b).all() for a, b in zip(one, many))


def test_registered():
    assert {"op11_filter_interaction", "op12_source_divergence"} <= set(oracle_sql())
