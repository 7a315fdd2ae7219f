import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import lumenquarry.llm.jaccard_join as J
from lumenquarry.llm.common import KeyFilter
from lumenquarry.llm.graph import components
from lumenquarry.llm.substring_dedup import substring_dedup
from lumenquarry.llm.words import hashed_words


def words(text):
    return (text or "").encode().split()


def dedup_by_force(rows, length):
    first, out = {}, []
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - length + 1 if d is not None else 0):
            x = tuple(w[i : i + length])
            first[x] = min(first.get(x, d), d)
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1 if d is not None else 0):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 200))) for _ in range(20)]
    rows = []
    for i in range(60):
        t = rng.choice(base).split()
        if t and rng.random() < 0.5:
            t[rng.randrange(len(t))] = "zz"
        rows.append((rng.choice([None, i, i % 7]), None if rng.random() < 0.05 else " ".join(t[rng.randint(0, 60) :]) + " " + "y\t" * rng.choice([0, 0, 70])))
    return rows


@pytest.mark.parametrize("length", [50, 20, 3])
def test_substring_dedup(spark, length):
    rows = passages(length)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, parts string, n_words int")
    assert sorted(map(tuple, substring_dedup(table, length).collect()), key=str) == dedup_by_force(rows, length)


def test_intervals_are_maximal_and_columns_come_along(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    table = spark.createDataFrame([(1, shared, "a"), (2, f"start {shared} end", "b"), (3, "own  text", "c")], "doc_id long, text string, parts string")
    got = {r.doc_id: r for r in substring_dedup(table, with_text=True, carry=("parts",)).collect()}
    assert [tuple(x) for x in got[2].removed] == [(1, 60)] and got[2].kept == "start end" and got[2].parts == "b"
    assert got[3].kept == "own  text" and got[1].n_removed == 0


def groups_by_force(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for j, o in Counter(j for x in s for j in holders[x] if j < i).items():
                if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted([(d, len(sets[i]), None if d is None else (least[root(i)] if sets[i] else d)) for i, (d, _) in enumerate(rows)], key=str)


def families(seed):
    rng, rows = random.Random(seed), []
    for _ in range(12):
        base = [rng.choice("abcdefgh"[: rng.choice([2, 4, 8])]) * rng.randint(1, 2) for _ in range(rng.choice([0, 2, 4, 6, 30, 60, 90]))]
        for _ in range(rng.choice([1, 2, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(["Q", "zz", "k"])
            rows.append((rng.choice([None, *range(300), *range(300)]), None if rng.random() < 0.03 else " ".join(t)))
    return rows


@pytest.mark.parametrize("small_nodes", [False, True])
def test_jaccard_components(spark, monkeypatch, small_nodes):
    if small_nodes:  # blocks of many nodes, as in a large table
        for name, value in (("NODE_SETS", 3), ("NODE_TOKENS", 300), ("ALL_PAIRS", 4)):
            monkeypatch.setattr(J, name, value)
    rows = families(5 + small_nodes)
    table = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, key int, n int")
    assert sorted(map(tuple, J.jaccard_components(table).collect()), key=str) == groups_by_force(rows)


def test_tree_join_finds_what_comparing_all_pairs_finds():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(30):
        base = [rng.integers(0, 400, 40) for _ in range(6)]
        sets = [np.unique(np.r_[base[rng.integers(6)][: rng.integers(25, 40)], rng.integers(400, 500, rng.integers(1, 12))]).astype(np.uint64) for _ in range(60)]
        parent = list(range(len(sets)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 4 * o >= 3 * (len(sets[i]) + len(sets[j]) - o):
                    parent[root(i)] = root(j)
        want = {frozenset(i for i in range(len(sets)) if root(i) == r) for r in {root(i) for i in range(len(sets))}}
        links = J.tree_join(sets, None, 3, 4)
        parent[:] = range(len(sets))
        for i, j in links:
            parent[root(i)] = root(j)
        assert {frozenset(i for i in range(len(sets)) if root(i) == r) for r in {root(i) for i in range(len(sets))}} == want


def test_tree_join_of_single_sets():
    import numpy as np

    a, b, c = (np.arange(x, x + 100, dtype=np.uint64) for x in (0, 10, 60))
    assert J.tree_join([a], [b], 3, 4) == [(0, 1)]
    assert J.tree_join([a], [c], 3, 4) == [] and J.tree_join([a], None, 3, 4) == []
    assert J.tree_join([a], [c, b], 3, 4) == [(0, 2)]


def test_linked_long_texts_in_nodes_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(J, "NODE_TOKENS", 300)  # each text fills a node
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:390])), (3, " ".join(base[:300])), (4, " ".join(f"v{i}" for i in range(400)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(table).collect())) == groups_by_force(rows)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in (200, 201, 202)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_built_to_collide_differ():
    """Polynomials modulo 2**64 give texts of the Thue-Morse sequence and its complement one value, whatever the base."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    words = [one[:n] for n in (32, 64, 1024, 2048)]
    hashes, counts = hashed_words([w.encode() for w in words] + [w.translate(str.maketrans("ab", "ba")).encode() for w in words])
    assert len(set(hashes.tolist())) == 8 and counts.tolist() == [1] * 8
    assert (hashed_words([(one.upper() + " Ab").encode()], lower=True)[0] == hashed_words([(one + " ab").encode()])[0]).all()


def test_filters_hold_their_keys(spark):
    keys = [i * 7919 - (1 << 40) for i in range(20_000)]
    f = KeyFilter.of(spark.createDataFrame([(k,) for k in keys], "key long"), "key")
    assert f.holds(np.array(keys)).all() and f.holds(np.arange(1 << 50, (1 << 50) + 20_000)).mean() < 0.05
    assert not KeyFilter.of(spark.createDataFrame([], "key long"), "key").holds(np.arange(9)).any()


def test_unlike_texts_do_not_move(spark):
    """What similar texts need moves, and a few bytes a shingle; not the texts that are like no other."""
    rng = random.Random(4)
    texts = ["".join(f"{rng.getrandbits(60):x} " for _ in range(400)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate([*texts, texts[5] + "more"])), "doc_id long, text string")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    got = {r.doc_id: r.component_id for r in J.jaccard_components(rows).collect()}
    assert got == {i: i for i in range(300)} | {300: 5}
    assert moved() - before < sum(map(len, texts)) / 4
