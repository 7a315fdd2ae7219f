import hashlib
import random
import struct

import pytest

from lumenquarry.llm import matroska as M


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 511, 512, 513, 4096, 70_000, 200_000])
def test_round_trip(size):
    payload = M.padded(random.Random(size).randbytes(size))
    media = M.write_media(payload)
    parsed = M.parse_media(media)
    assert M.read_track(media, parsed) == payload and len(payload) % 64 == 0 and payload
    assert len(parsed["cues"]) == len(parsed["clusters"])
    for time, track, at in parsed["cues"]:
        assert M.read_vint(media, at, True)[0] == M.CLUSTER and track == 1 and time % 1_000_000 == 0
    times = [p[1] for p in parsed["packets"]]
    assert times == sorted(times) and times == [i * 64_000_000 for i in range(len(times))]


@pytest.mark.parametrize("kind", [M.XIPH, M.EBML_LACING, M.FIXED])
def test_lacing(kind):
    rng = random.Random(kind)
    frames = [rng.randbytes(77 if kind == M.FIXED else rng.randrange(1, 1000)) for _ in range(9)]
    data = b"\x81" + struct.pack(">h", -5) + M.lace(frames, kind)
    track, time, _, ranges = M.unlace(data, 0, len(data))
    assert (track, time) == (1, -5) and [data[a:b] for a, b in ranges] == frames


def test_sizes_and_unknown_sizes():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**35):
        assert M.read_vint(M.size_bytes(n), 0)[0] == n
    block = M.element(M.SIMPLE_BLOCK, b"\x81\0\0\x80abc")
    cluster = (0x1F43B675).to_bytes(4, "big") + b"\xff" + M.element(M.CLUSTER_TIMESTAMP, b"\x07") + block
    media = M.element(M.EBML, b"") + (0x18538067).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    parsed = M.parse_media(media)
    assert [media[a:b] for _, _, a, b, _, _ in parsed["packets"]] == [b"abc", b"abc"] and [p[1] for p in parsed["packets"]] == [7_000_000] * 2


def test_columns(spark):
    texts = [None, "", "abc", "é" * 5000, "abc"]
    table = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in M.media_features(table).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i].n_bytes == len(raw) and got[i].payload_sha256 == hashlib.sha256(M.padded(raw)).hexdigest()
    assert got[2][1:] == got[4][1:]
    packets = M.packet_table(M.media_column(table).unionByName(spark.createDataFrame([(9, 1, bytearray(b"\x1a\x45\xdf\xa3\x88abc"))], "doc_id long, n_bytes long, media binary"))).collect()
    assert [p.error is not None for p in packets if p.doc_id == 9] == [True]
    assert sum(p.end - p.start for p in packets if p.doc_id == 3) == got[3].payload_bytes
    assert M.media_features(table.limit(0)).count() == 0
