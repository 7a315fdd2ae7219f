import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import lumenquarry.llm.hpylm as H
import lumenquarry.llm.toxicity as X
from lumenquarry.llm import pii as P
from lumenquarry.llm.ann import CrossPolytope, nearest
from lumenquarry.llm.toxicity import drop_toxic, toxicity

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def pii_by_force(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(z) > 255 for z in m[0].split("."))) or (k == 2 and not (14 <= len(d) <= 19 and P.luhn(d))) or (k == 3 and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("ab01259@..-+ ()é") for _ in range(rng.randint(0, 40)))
        assert P.base_spans(text) == pii_by_force(text)
    assert P.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


def test_gradients_and_held_out_accuracy():
    x, y = P.labelled(5, 1)
    m = P.BiLstmCrf(3)
    _, grads = m.gradients(x, y)
    for k in m.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        was = m.p[k][at]
        m.p[k][at] = was + 1e-5
        up, _ = m.gradients(x, y)
        m.p[k][at] = was - 1e-5
        down, _ = m.gradients(x, y)
        m.p[k][at] = was
        assert abs(grads[k][at] - (up - down) / 2e-5) < 1e-4
    x, y = P.labelled(400, 99)
    tags = P.trained().decode(P.trained().emissions(x), np.full(len(x), P.WINDOW))
    assert (tags == y).mean() > 0.97


def test_long_runs_of_digits():
    assert P.base_spans("0" * 5000 + "1.2.3.4") == pii_by_force("0" * 100 + "1.2.3.4")[:0] + [(0, 1, 5007)]
    assert P.base_spans("1" * 5000 + ".2.3.4") == []


def test_pii_rows(spark):
    texts = [None, "", "no data here", "mail a.b@x.org, call (507) 555-2257 now", "ip 10.0.0.1 ip 10.0.0.999", "4111 1111 1111 1111", "é@é " + "x" * 3_000 + " q@w.de"]
    table = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(1, "", "")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in P.find_pii(table, redacted=True).collect()}
    for i, t in enumerate(texts):
        want = pii_by_force(t or "")
        assert [got[i][f"n_{k}"] for k in P.KINDS] == [sum(x == j for _, x, _ in want) for j in range(4)]
        assert all(f"{P.KINDS[k]}:{a}:{b}" in got[i].spans for a, k, b in want)
    assert got[3].spans == "email:5:14,phone:21:35" and got[3].redacted == "mail <email>, call <phone> now"
    assert got[0].spans == "" and got[2].spans == ""


BESIDE = [
    ("mentle çre. Éçan 7536784127813050 4845168114407329 èaique tre oile", ["7536784127813050", "4845168114407329"]),
    ("ramiar, 4465758382889437 4465758382889437 ójaga para", ["4465758382889437", "4465758382889437"]),
    ("Esanwh 2353820953013749 4550997810720808 thheed hand", ["4550997810720808"]),
    ("éreé. Des +1 (826) 555-4081 190.137.223.204 du anviou", ["+1 (826) 555-4081", "190.137.223.204"]),
    ("éaiépa un. +1 (843) 555-7672 170.106.47.218 Et, éan", ["+1 (843) 555-7672", "170.106.47.218"]),
]


def test_values_beside_each_other_are_found(spark):
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BESIDE)], "doc_id long, text string")
    for r in P.find_pii(table, redacted=True).collect():
        text, want = BESIDE[r.doc_id]
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in r.spans.split(","))
        assert [text[a:b] for a, b in spans] == want
        assert not any(w in r.redacted for w in want)


def test_proposals_are_cut_at_base_spans_and_separators():
    text = "4111111111111111, 4465758382889437/5500000000000004 10.0.0.1 +1 (826) 555-4081"
    base = [s for s in P.base_spans(text) if s[1] == 1]
    cut = lambda kind, a, b: [text[x:y] for x, y in P._cut(kind, text, a, b, base, 0, len(text))]
    assert cut(2, 3, 40) == ["4111111111111111", "4465758382889437", "5500000000000004"]
    assert cut(3, 55, len(text)) == ["+1 (826) 555-4081"]
    assert P._parts(3, "555-123-4567 555-123-4568") == [(0, 12), (13, 25)]
    assert P._parts(2, "1234567890123456 7") == [] and P._cut(3, "token dafbac99949115180e7", 12, 23, [], 0, 25) == []


def test_model_spans_do_not_depend_on_what_ran_before():
    texts = [t for t, _ in BESIDE]
    runs = [P.model_spans(P.trained(), texts, [P.base_spans(t) for t in texts]) for _ in range(5)]
    assert all(r == runs[0] for r in runs) and sum(map(len, runs[0])) == 7


def test_toxicity(spark):
    rng = random.Random(1)
    bad, good = ["vilest", "grubby", "odious"], [f"word{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = [rng.choice(good) for _ in range(30)]
        if i % 4 == 0:
            w[3] = rng.choice(bad)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, None), (501, ""), (None, "odious"), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i < 300] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity(docs, labels).collect()
    held = [r for r in got if r.doc_id is not None and 300 <= r.doc_id < 400]
    assert sum(r.toxic == (r.doc_id % 4 == 0) for r in held) >= 97
    assert all(0 <= r.expected_severity <= 2 for r in got) and len(got) == 404
    assert not [r for r in got if r.doc_id in (500, 501) and r.toxic]
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 290 < kept.count() < 310
    assert toxicity(docs, labels.where("toxic = 0")).where("toxic").count() == 0
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_by_force():
    """Probabilities from a sum over words written out, and a fit that no change of a weight or a cut makes better."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}word" for i in range(60)]
    texts, grades = [], rng.choice(3, 300, p=[0.6, 0.25, 0.15])
    for g in grades:
        w = list(rng.choice(vocabulary, 12)) + (["vilest"] if g and rng.random() < 0.8 else []) + (["grubbier"] if g == 2 and rng.random() < 0.7 else [])
        texts.append(" ".join(w).encode())
    features = [np.unique(X.text_features([t])[1]) for t in texts]
    model = X.OrdinalModel.fit(features, grades, rounds=2000)
    weight = dict(zip(model.used.tolist(), model.values.tolist(), strict=True))
    got = model.scores(texts)
    for t, p in zip(texts, got, strict=True):
        names = {f for w in t.decode().split() for f in X.text_features([w.encode()])[1].tolist()}
        z = X.SCALE * sum(weight.get(f, 0.0) for f in names)
        assert np.allclose(p, [1 / (1 + math.exp(c - z)) for c in model.cuts])
    assert (np.diff(model.cuts) > 0).all() and got.sum(1)[grades == 2].mean() > got.sum(1)[grades == 1].mean() > got.sum(1)[grades == 0].mean()

    balance = np.where(grades > 0, 150 / (grades > 0).sum(), 150 / (grades == 0).sum())

    def loss(weights, cuts):
        """Minus the log of P(grade), written out: the difference of two logistic curves."""
        z = np.array([X.SCALE * sum(weights.get(f, 0.0) for f in row) for row in features])
        over = [np.ones(len(z)), *(1 / (1 + np.exp(c - z)) for c in cuts), np.zeros(len(z))]
        p = np.array([over[g][i] - over[g + 1][i] for i, g in enumerate(grades)])
        return float((-np.log(p) * balance).mean()) + 3e-5 * sum(map(abs, weights.values()))

    least = loss(weight, model.cuts)
    for f in rng.choice(np.unique(np.concatenate(features)), 25).tolist():
        for step in (-1.0, 1.0):
            assert loss(weight | {f: weight.get(f, 0.0) + step}, model.cuts) > least - 2e-5
    for k in range(2):
        for step in (-0.3, 0.3):
            assert loss(weight, model.cuts + step * (np.arange(2) == k)) > least


def test_gradient_of_the_cumulative_link():
    rng = np.random.default_rng(6)
    z, grades, cuts = rng.normal(size=200) * 3, rng.integers(0, 3, 200), np.array([-0.4, 1.1])
    value, by_z, by_cut = X.OrdinalModel.loss(z, cuts, grades)
    over = lambda c: 1 / (1 + np.exp(c - z))
    assert np.allclose(value, -np.log(np.choose(grades, [1 - over(cuts[0]), over(cuts[0]) - over(cuts[1]), over(cuts[1])])))
    e = 1e-6
    assert np.allclose(by_z, (X.OrdinalModel.loss(z + e, cuts, grades)[0] - X.OrdinalModel.loss(z - e, cuts, grades)[0]) / (2 * e), atol=1e-5)
    for k in range(2):
        d = e * (np.arange(2) == k)
        assert np.allclose(by_cut[:, k], (X.OrdinalModel.loss(z, cuts + d, grades)[0] - X.OrdinalModel.loss(z, cuts - d, grades)[0]) / (2 * e), atol=1e-5)


def test_grades_that_no_row_has():
    """Without toxic rows of low quality grade 2 is out of reach; without other toxic rows both cuts nearly meet."""
    rows = [np.array([1, 2 + i % 3]) for i in range(40)] + [np.array([7, 2 + i % 3]) for i in range(20)]
    for g in (1, 2):
        model = X.OrdinalModel.fit(rows, np.array([0] * 40 + [g] * 20))
        assert (np.diff(model.cuts) > 0).all() and (model.cuts[1] - model.cuts[0] > 20) == (g == 1)


def lm_by_force(rows):
    toks = [[w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None] for _, t in rows]
    train = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2
    c = Counter(w for (d, _), t in zip(rows, toks, strict=True) if train(d) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted([(str(d), not train(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, _), t in zip(rows, toks, strict=True)])


@pytest.mark.parametrize("hot", [1 << 17, 3])
def test_lm_scores(spark, hot):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "The the", " ".join(rng.choice(["A", "b", "cc", "ddd", f"r{i}"]) for _ in range(rng.randint(1, 80)))])) for i in range(120)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, row int")
    got = H.score_texts(table, hot).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == lm_by_force(rows)
    assert all(r.score < 0 for r in got)


def test_seats_have_the_distribution_of_the_process():
    """After some sweeps the share of k tables for n customers is that of all seatings, weighed one by one."""
    new, d = 1.3, 0.4

    def seatings(n):  # sizes of tables, as customers come one after another
        out = {(): 1.0}
        for _ in range(n):
            more = Counter()
            for sizes, w in out.items():
                more[(*sizes, 1)] += w * new
                for i, size in enumerate(sizes):
                    more[(*sizes[:i], size + 1, *sizes[i + 1 :])] += w * (size - d)
            out = more
        return out

    for n in (2, 3, 5, 24):
        s = H.Seating(np.full(20_000, n), np.full(20_000, new), d, np.random.default_rng(3))
        for _ in range(6):
            s.sweep()
        tables = s.sample()
        assert (np.add.reduceat(s.size, s.at) == n).all() and ((s.size > 0) == (np.arange(len(s.size)) - np.repeat(s.at, s.room) < np.repeat(s.tables, s.room))).all()
        if n > 5:
            continue
        want, total = Counter(), 0.0
        for sizes, w in seatings(n).items():
            want[len(sizes)] += w
            total += w
        for k in range(1, n + 1):
            assert abs((tables == k).mean() - want[k] / total) < 0.015


def test_all_customers_of_frequent_words_are_seated():
    """Tables of words with many customers, in the parent too, are those of all seatings: no start of a chain is left in them."""
    rng, d = np.random.default_rng(5), 0.6
    logs = np.full(1600, -np.inf)
    logs[1] = 0.0  # log S(n, t)
    for n in range(1, 1500):
        rest = np.maximum(n - d * np.arange(1600), 1e-300)
        logs[1:] = np.logaddexp(logs[:-1], np.where(np.isfinite(logs[1:]), logs[1:] + np.log(rest[1:]), -np.inf))
    for new in (0.8, 30.0, 900.0):  # a handful of tables, tens, and hundreds
        w = logs + np.arange(1600) * np.log(new)
        w = np.exp(w - w.max())
        mean = (w * np.arange(1600)).sum() / w.sum()
        got = H.drawn(np.full(3000, 1500), np.full(3000, new), d, rng)
        assert abs(got.mean() - mean) < 5 * got.std() / 3000**0.5
    assert (H.drawn(np.array([40, 1 << 15, 3]), np.full(3, 0.5), d, rng) > 0).all() and not len(H.drawn(np.zeros(0, int), np.zeros(0), d, rng))
    # weights of up to 60 customers, by the recursion as it is written down
    weight = {1: 1.0}
    for n in range(1, 60):
        weight = {t: weight.get(t - 1, 0) * 1.3 + weight.get(t, 0) * (n - d * t) for t in range(1, n + 2)}
    mean = sum(t * w for t, w in weight.items()) / sum(weight.values())
    for turn in (1, 2):
        tables = H._parent_tables(np.full(20_000, 60), (d, 0.0, 0.5, 1.0), turn)  # a new table weighs 1 + 0.6 * 0.5
        assert abs(tables.mean() - mean) < 0.03


class PlainSampler:
    """The model as it is written down: every customer of both levels, seated one at a time."""

    def __init__(self, docs, d, above, seed):
        self.d, self.above, self.rng = d, above, random.Random(seed)
        self.below, self.root = {}, {}
        self.tokens = [(p, w) for t in docs for p, w in zip([None, *t[:-1]], t, strict=True)]
        self.v = len({w for _, w in self.tokens})

    def parent(self, w):
        mine, all_tables = self.root.get(w, []), sum(map(len, self.root.values()))
        return (sum(mine) - self.above * len(mine) + (H.STRENGTH + self.above * all_tables) / (self.v + 1)) / (H.STRENGTH + sum(map(sum, self.root.values())))

    def chance(self, p, w):
        here = self.below.get(p, {})
        mine, tables, guests = here.get(w, []), sum(map(len, here.values())), sum(map(sum, here.values()))
        return (sum(mine) - self.d * len(mine) + (H.STRENGTH + self.d * tables) * self.parent(w)) / (H.STRENGTH + guests)

    def sit(self, tables, new, d):
        at = self.rng.choices(range(len(tables) + 1), [*(x - d for x in tables), new])[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return tables[at] == 1

    def leave(self, tables):
        at = self.rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True
        return False

    def add(self, p, w):
        here = self.below.setdefault(p, {})
        if self.sit(here.setdefault(w, []), (H.STRENGTH + self.d * sum(map(len, here.values()))) * self.parent(w), self.d):
            self.sit(self.root.setdefault(w, []), (H.STRENGTH + self.above * sum(map(len, self.root.values()))) / (self.v + 1), self.above)

    def remove(self, p, w):
        if self.leave(self.below[p][w]):
            self.leave(self.root[w])


def test_lm_scores_are_those_of_a_plain_sampler(spark):
    rng = random.Random(3)
    texts = ["".join(f"{rng.choice(['to', 'of', 'the'])} {rng.choice(['house', 'tree', 'water', 'stone', f'w{rng.randint(0, 40)}'])} " for _ in range(12)) for _ in range(70)]
    toks = [[*t.split(), ""] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    pairs = Counter((p, w) for t, ok in zip(toks, train, strict=True) if ok for p, w in zip([None, *t[:-1]], t, strict=True))
    on = Counter(w for _, w in pairs)
    count = lambda c, n: sum(x == n for x in c.values())
    plain = PlainSampler([t for t, ok in zip(toks, train, strict=True) if ok], H._discount(count(pairs, 1), count(pairs, 2)), H._discount(count(on, 1), count(on, 2)), 1)
    for p, w in plain.tokens:
        plain.add(p, w)
    chances = [Counter() for _ in texts]
    for sweep in range(14):
        for p, w in plain.tokens:
            plain.remove(p, w)
            plain.add(p, w)
        for i, t in enumerate(toks if sweep >= 4 else []):
            for j, (p, w) in enumerate(zip([None, *t[:-1]], t, strict=True)):
                chances[i][j] += plain.chance(p, w) / 10
    got = H.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [sum(map(math.log10, c.values())) for c in chances]
    assert all(abs(r.score - want[r.doc_id]) < 0.03 * abs(want[r.doc_id]) for r in got)
    assert abs(sum(r.score for r in got) / sum(want) - 1) < 0.01
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert H.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lm_scoring_holds_few_bytes_a_pair():
    """One chunk, whose scores are written out below."""
    rng = np.random.default_rng(10)
    hot, cold, buckets = 20_000, np.sort(rng.integers(0, 1 << 62, 5_000)), 7
    counts = np.full(4_000, 100)
    code = rng.integers(0, hot + len(cold), counts.sum())
    code[np.cumsum(counts) - 1] = hot - 1  # the end of a text
    pairs = H.Pairs(code, cold, hot, np.cumsum(counts), buckets)
    n = (pairs.prev * 7 + pairs.word) % 4
    rows = [{"turn": 1, "bucket": b, "data": [H.packed(x), *[H.packed(x[x > 1] - 1)] * H.SAMPLES]} for b, x in zip(pairs.bucket.tolist(), np.split(n, pairs.first[1:]), strict=True)]
    rows.append({"turn": 2, "ids": list(range(len(counts))), "counts": counts.tolist(), "cold": cold.tolist(), "data": [H.packed(code)]})
    longs = pa.list_(pa.int64())
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("turn", pa.int32()), ("bucket", pa.int64()), ("ids", longs), ("counts", longs), ("cold", longs), ("data", pa.list_(pa.binary()))]))
    count, above = rng.integers(1, 90, hot), (0.5, 9e5, 4e5, 1e-5)
    model = H.PitmanYor(H.HotWords(np.arange(hot)), count, int(count.sum()), hot, 0.7, np.tile(np.minimum(count, 5.0), (H.SAMPLES, 1)), rng.random((H.SAMPLES, hot)), [above] * H.SAMPLES)
    size, rows = len(pairs.order), None
    del pairs
    tracemalloc.start()
    (got,) = H._scores(iter([batch]), model, buckets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    prev = np.r_[0, code[:-1]]
    prev[np.arange(0, len(code), 100)] = hot - 1
    n = (prev * 7 + code) % 4
    guests, inside = (np.r_[x, np.zeros(len(cold))][prev] for x in (count, model.inside[0]))
    p = sum((n - 0.7 * np.maximum(n - 1, n > 0) + (H.STRENGTH + 0.7 * inside) * np.r_[q, np.full(len(cold), H.in_parent(0.0, 0.0, above))][code]) / (H.STRENGTH + guests) for q in model.parent) / H.SAMPLES
    assert np.allclose(got.column("score").to_numpy(), np.log10(p).reshape(-1, 100).sum(1))
    assert peak < 170 * size


def test_lm_pairs_of_a_bucket_are_merged():
    rng = np.random.default_rng(11)
    hot, word = 30, np.sort(rng.integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2))
    want, asked = Counter(), {}
    for chunk in range(5):
        cold = np.sort(rng.choice(word, 20, replace=False)).view(np.int64)
        code = np.r_[rng.integers(0, hot + 20, 399), hot - 1]
        pairs = H.Pairs(code, cold, hot, np.array([400]), 3)
        for b, data in pairs.sent(np.bincount(pairs.inverse)):
            asked.setdefault(b, []).append((chunk, data))
        name = [("hot", int(c)) if c < hot else ("cold", int(cold[c - hot])) for c in code]
        want += Counter(zip([name[-1], *name[:-1]], name, strict=True))
    got = Counter()
    for told in asked.values():
        packed, places = H.merged([d for _, d in told])
        b = H.Bucket(packed)
        names = [tuple(("hot", int(x)) if x >= 0 else ("cold", int(h)) for x, h in pair) for pair in zip(zip(b.prev, b.prev_hash, strict=True), zip(b.word, b.word_hash, strict=True), strict=True)]
        assert len(set(names)) == len(names)
        got += Counter(dict(zip(names, b.n.tolist(), strict=True)))
        total = np.zeros(len(names), np.int64)
        for (_, data), place in zip(told, places, strict=True):
            np.add.at(total, H.unpacked(place), np.r_[H.unpacked(data[1]), H.unpacked(data[5])])  # in the order of the questions
        assert (total == b.n).all()
    assert got == want


def test_ratios_do_not_depend_on_the_order_of_calls():
    by_step = H._small_sums(0.6)[1][:64].copy()
    ratios, want = H.Ratios(0.6, 64), {}
    for n in range(H.EXACT, 3000):
        want[n] = by_step.copy()
        H._ratios(by_step, n, 0.6)
    for n in (2999, 1500, 1501, 2400, 1025, 2999, 1100):
        assert (ratios.walk(n) == want[n]).all()
        assert (ratios.sums(n) == np.r_[0, np.cumsum(np.log(want[n]))]).all()


def test_lm_is_a_distribution():
    rng = np.random.default_rng(4)
    n = rng.poisson(1.5, (6, 40))  # contexts, words
    n[:, n.sum(0) == 0] = 1
    tables = H.Seating(n.ravel(), np.full(n.size, 0.7), 0.6, rng).sample().reshape(n.shape)
    on = tables.sum(0)
    rooted = H._parent_tables(on, (0.5, float(on.sum()), 40.0, 1 / 41), 1)
    above = (0.5, float(on.sum()), float(rooted.sum()), 1 / 41)
    parent, unknown = H.in_parent(on, rooted, above), H.in_parent(np.zeros(1), np.zeros(1), above)
    assert abs(parent.sum() + unknown[0] - 1) < 1e-12
    model = H.PitmanYor(H.HotWords(np.arange(40)), on, 1, 40, 0.6, None, None, [above])
    for c in range(6):
        one = lambda x: np.asarray(x, float)[None]
        p = model.probability(n[c], one(tables[c]), n[c].sum(), tables[c].sum(), one(parent))
        rest = model.probability(np.zeros(1), np.zeros((1, 1)), n[c].sum(), tables[c].sum(), one(unknown))
        assert abs(p.sum() + rest[0] - 1) < 1e-12


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for high in (1, 200, 70_000, 1 << 33, 1 << 62):
        for n in (0, 1, 1000):
            a = rng.integers(0, high, n)
            assert (H.unpacked(H.packed(a)) == a).all()


def test_lm_context_is_the_word_before(spark):
    rng = random.Random(8)  # all words are of one length: only the word before tells the next
    after = {"aaa": "bbb", "bbb": "ccc", "ccc": "ddd", "ddd": "aaa"}
    rows = []
    for i in range(80):
        w = [rng.choice(list(after))]
        while len(w) < 40:
            w.append(after[w[-1]])
        rows.append((i, " ".join(w)))
    odd = [(1000 + i, " ".join(rng.choice(list(after)) for _ in range(40))) for i in range(40)]
    odd = [r for r in odd if zlib.crc32(str(r[0]).encode()) % H.FOLDS == H.HELD_OUT]
    got = H.score_texts(spark.createDataFrame(rows + odd, "doc_id long, text string")).where("held_out").collect()
    chain, mixed = [r.perplexity for r in got if r.doc_id < 1000], [r.perplexity for r in got if r.doc_id >= 1000]
    assert chain and mixed and max(chain) < 1.6 and min(mixed) > 3 * max(chain)


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[100:400] = x[7]  # a third are copies of one
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(950, None), (1000, [0.0] * 24), (1050, [float("nan")] * 24), (1100, [1.0, 2.0]), (None, x[1].tolist()), (50, x[50].tolist())]
    got = nearest(spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, score int")).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = total = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(900), -np.round(s, 12)))[:5].tolist()
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(sc - s[v]) < 1e-12 for _, v, sc in mine)
        if 100 <= q < 400:
            assert [v for _, v, _ in mine] == want
        hits, total = hits + len({v for _, v, _ in mine} & set(want)), total + 5
    assert hits >= 0.9 * total
    assert {r.query_id for r in got} == set(range(0, 900, 50))
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_scaled_copies_tie_and_few_rows_are_all_found(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=16)
    rows = [(i, (v * (1 + i * 0.37)).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(700)]
    rows += [(3000, [1.0, 0.0]), (3001, [0.0, 1.0]), (3002, [-1.0, 0.0]), (4000, [5e-200, 0.0, 0.0]), (4001, [1e200, 1e200, 0.0])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [x for _, x, _ in sorted(got[0])] == [1, 2, 3, 4, 5] and all(s == 1.0 for *_, s in got[0])
    assert [x for _, x, _ in sorted(got[350])] == [0, 1, 2, 3, 4]
    assert sorted(got[3000]) == [(1, 3001, 0.0), (2, 3002, -1.0)]
    assert [(r, x) for r, x, _ in got[4000]] == [(1, 4001)] and abs(got[4000][0][2] - 0.5**0.5) < 1e-15


def test_more_hashes_in_a_table(spark):
    """Many classes for their length: three hashes a table, the last of a few axes."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 8))
    assert len(CrossPolytope(8, len(x), 2, 1).axes) == 3
    got = {}
    for r in nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hits >= 0.9 * 5 * 60
