import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lumenquarry.llm import tokenizer
from lumenquarry.llm.bpe import _default, bpe_decode, bpe_encode, bpe_round_trip
from lumenquarry.llm.packing import pack_documents, plan_bins
from lumenquarry.llm.token_counts import token_counts
from lumenquarry.llm.tokenizer import default_encoding, safe_cuts

TEXTS = [None, "", " ", "a", "Hello  world\n\n it's 12 o'clock", "é" * 700, "<|endoftext|> x <|endoftext|>", "ab " * 3000, " \n" * 50 + "z", "x" * 2000, "größe 漢字 🙂🙂", "tab\there\r\n"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i % 9, t, "en", [1], 5) for i, t in enumerate(TEXTS + TEXTS[:4])], "doc_id long, text string, lang string, ids array<int>, n_tokens long")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_both_libraries_agree_on_every_code_point(library):
    enc = default_encoding()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        text = " ".join(f"a{chr(c)}1{chr(c)} {chr(c)}b" for c in points[i : i + 20_000])
        assert library.encode(text, add_special_tokens=False).ids == enc.encode(text, allowed_special="all")


def test_cuts_change_no_token():
    rng, enc = random.Random(1), default_encoding()
    for _ in range(200):
        text = "".join(rng.choice([" ", "  ", "\n", "a", "bc", "1", "!", "'s", "é"]) for _ in range(300))
        parts = safe_cuts(text, 40)
        assert "".join(parts) == text
        assert [t for p in parts for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_long_white_space(spark, library):
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x " + " \n" * 700_000 + "y", "q" + "\xa0" * 900_000 + "\xa0r", "\n" * 70_000 + "<|endoftext|>" + "\n" * 70_002]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in token_counts(table).orderBy("doc_id").collect()] == [len(w) for w in want]
    got = {}
    for r in pack_documents(table).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, ids in enumerate(want):
        raw = np.array([*ids, 2], "<u4").tobytes()
        assert all(zlib.crc32(raw[4 * a : 4 * (a + n)]) == c for a, n, c in got[i]) and sum(n for _, n, _ in got[i]) == len(ids) + 1


def test_runs_of_white_space_are_cut_without_a_change(library, monkeypatch):
    monkeypatch.setattr(tokenizer, "LONG_SPACE", re.compile(tokenizer.LONG_SPACE.pattern.replace("16384", "4")))
    monkeypatch.setattr(tokenizer, "PART_CHARS", 20)
    rng, enc = random.Random(4), default_encoding()
    texts = ["".join(rng.choice([" ", "    ", "\n\n", "a", "bc", "1", "!", "'s", "é", "\xa0\xa0", "\x1c", "\u3000" * 3, "<|endoftext|>"]) for _ in range(60)) for _ in range(2000)]
    for t, parts in zip(texts, tokenizer.encode_batch(enc, texts), strict=True):
        assert [i for p in parts for i in p] == library.encode(t, add_special_tokens=False).ids


def test_counts(table, library):
    got = sorted(map(tuple, token_counts(table).collect()))
    want = [(i % 9, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in enumerate(TEXTS + TEXTS[:4])]
    assert got == sorted(want)


def test_matrix_bpe_is_the_librarys(table):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    ref = tiktoken.Encoding("r", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x4E00, 0x9FFF)])) for _ in range(400)) for _ in range(30)]
    coder = _default(None)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_round_trip(table).collect()}
    for i, t in enumerate(TEXTS):
        raw = np.array(ref.encode_ordinary(t or ""), "<u4").tobytes()
        assert (i % 9, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in rows
    back = bpe_decode(bpe_encode(table)).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for t in TEXTS + TEXTS[:4])


def test_packing(spark, table, library):
    rows = pack_documents(table, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        ends = np.cumsum([0, *(n for _, n in places)])
        assert [o for o, _ in places] == ends[:-1].tolist() and ends[-1] <= 1024
    for i, t in enumerate(TEXTS + TEXTS[:4]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert any(list(r.ids) == ids[r.start : r.start + r.length] for r in rows if r.doc_id == i % 9)
    assert {tuple(r.ids) for r in rows} <= {tuple(ids[a : a + n]) for t in TEXTS for ids in [[*library.encode(t or "", add_special_tokens=False).ids, 2]] for a, n in [(0, len(ids) % 1024 or 1024), *((s, 1024) for s in range(len(ids) % 1024, len(ids), 1024))]}
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in TEXTS + TEXTS[:4])
    assert sum(r.length for r in rows) == total
    assert len(by_sequence) <= -(-total // 1024) + 1
    long = sorted((r.start, r.length) for r in rows if r.doc_id == 7 and r.length + r.start > 1024)
    assert all(n == 1024 for s, n in long if s)


def test_plan_uses_every_length_once():
    rng = random.Random(3)
    for cap in (1, 2, 7, 100):
        counts = {n: rng.randrange(0, 30) for n in range(1, cap + 1)}
        counts = {n: c for n, c in counts.items() if c}
        used = {}
        for times, lengths in plan_bins(counts, cap):
            assert sum(lengths) <= cap
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == counts
    assert plan_bins({}, 10) == []


def test_two_documents_replace_the_smallest_of_a_bin():
    # greedy: 6, then 3 (gap 1); 2 + 2 fill the widened gap of 4
    assert plan_bins({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]
