"""Media columns in Matroska: a writer for one PCM track, and a parser from bytes to packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenquarry.llm.common import id_and_text, lean, slices

# Fixed values of the format: element ids
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x4282, 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION, FLAG_LACING = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383, 0x9C
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Samples a second (of 8 bits, mono), samples in a frame, frames in a block, blocks in a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 16
UNIT = 64
SLICE_BYTES = 1 << 20


# writing


def size_bytes(n: int) -> bytes:
    """n as the shortest variable-length size."""
    for length in range(1, 9):
        if n < (1 << 7 * length) - 1:
            return ((1 << 7 * length) | n).to_bytes(length, "big")
    raise ValueError(n)


def element(name: int, data: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_bytes(len(data)) + data


def _uint(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Flags, frame count and sizes, then the frames: what follows a block's track and time."""
    if kind == NO_LACING:
        return b"\x80" + frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([0x80 | kind << 1, len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_bytes(sizes[0])
        for was, n in zip(sizes[:-2], sizes[1:-1], strict=True):
            step, length = n - was, 1
            while not -(1 << 7 * length - 1) < step < 1 << 7 * length - 1:
                length += 1
            head += ((1 << 7 * length) | step + (1 << 7 * length - 1) - 1).to_bytes(length, "big")
    return head + b"".join(frames)


def write_media(payload: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    """One track of 8-bit PCM. Blocks hold LACED frames: fixed-size lacing, EBML lacing where the last frame is shorter."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    ns = 1_000_000_000 * frame // rate
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / rate)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, ns) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    body, cues = [info, element(TRACKS, element(TRACK_ENTRY, track))], []
    at = sum(map(len, body))
    for c in range(0, len(payload), frame * LACED * BLOCKS):
        time = c * 1000 // rate
        blocks = [_uint(CLUSTER_TIMESTAMP, time)]
        for b in range(c, min(len(payload), c + frame * LACED * BLOCKS), frame * LACED):
            part = payload[b : b + frame * LACED]
            frames = [part[i : i + frame] for i in range(0, len(part), frame)]
            kind = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == frame else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", b * 1000 // rate - time) + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


# parsing


class Broken(ValueError):
    """Bytes that are no whole Matroska file."""


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, place after it, length). A size of all ones reads as -1: unknown."""
    if at >= len(data) or not data[at]:
        raise Broken(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise Broken(f"cut off at {at}")
    raw = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return raw, at + length, length
    value = raw & ((1 << 7 * length) - 1)
    return (-1 if value == (1 << 7 * length) - 1 else value), at + length, length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first data byte, end) of the elements in a range; one of unknown size ends where an element of its own or a higher level begins, or with the range."""
    while at < end:
        name, body, _ = read_vint(data, at, keep_marker=True)
        size, body, _ = read_vint(data, body)
        stop = body + size
        if size < 0:
            stop, above = end, {SEGMENT} if name == SEGMENT else {CLUSTER, CUES, TRACKS, INFO, SEEK_HEAD, SEGMENT}
            inner = body
            while inner < end:
                child, after, _ = read_vint(data, inner, keep_marker=True)
                if child in above:
                    stop = inner
                    break
                n, after, _ = read_vint(data, after)
                inner = after + n if n >= 0 else end
        if stop > end:
            raise Broken(f"element {name:x} at {at} goes on beyond {end}")
        yield name, body, stop
        at = stop


def unlace(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of the frames of one block."""
    track, at, _ = read_vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        return track, time, flags, [(at, end)]
    count, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % count:
            raise Broken("frames of equal size don't fill their block")
        sizes = [(end - at) // count] * count
    else:
        sizes = []
        for i in range(count - 1):
            if kind == XIPH:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            else:
                n, at, length = read_vint(data, at)
                if i:
                    n += sizes[-1] - ((1 << 7 * length - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Broken("laced frames go beyond their block")
    ranges = []
    for n in sizes:
        ranges.append((at, at + n))
        at += n
    return track, time, flags, ranges


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0


def parse_media(data: bytes) -> dict:
    """tracks, packets (track, timestamp in ns, start, end, cluster, key), cues (time, track, position) and duration in ns of a file."""
    out: dict = {"tracks": {}, "packets": [], "cues": [], "duration": 0, "clusters": []}
    scale = 1_000_000
    for name, a, b in elements(data, 0, len(data)):
        if name != SEGMENT:
            continue
        for part, c, d in elements(data, a, b):
            if part == INFO:
                for x, e, f in elements(data, c, d):
                    if x == TIMESTAMP_SCALE:
                        scale = _number(data, e, f)
                    elif x == DURATION:
                        out["duration"] = _float(data, e, f)
            elif part == TRACKS:
                for x, e, f in elements(data, c, d):
                    if x == TRACK_ENTRY:
                        track = {"codec": "", "rate": 0.0, "frame_ns": 0}
                        for y, g, h in elements(data, e, f):
                            if y == TRACK_NUMBER:
                                track["number"] = _number(data, g, h)
                            elif y == CODEC_ID:
                                track["codec"] = data[g:h].rstrip(b"\0").decode("ascii", "replace")
                            elif y == DEFAULT_DURATION:
                                track["frame_ns"] = _number(data, g, h)
                            elif y == AUDIO:
                                for z, i, j in elements(data, g, h):
                                    if z == SAMPLING_FREQUENCY:
                                        track["rate"] = _float(data, i, j)
                        out["tracks"][track.get("number", 0)] = track
            elif part == CLUSTER:
                base, at = 0, len(out["clusters"])
                out["clusters"].append(c)
                for x, e, f in elements(data, c, d):
                    blocks = [(e, f)] if x == SIMPLE_BLOCK else [(g, h) for y, g, h in elements(data, e, f) if y == BLOCK] if x == BLOCK_GROUP else []
                    if x == CLUSTER_TIMESTAMP:
                        base = _number(data, e, f)
                    for g, h in blocks:
                        track, time, flags, ranges = unlace(data, g, h)
                        step = out["tracks"].get(track, {}).get("frame_ns", 0)
                        for i, (r, s) in enumerate(ranges):
                            out["packets"].append((track, (base + time) * scale + i * step, r, s, at, bool(flags & 0x80)))
            elif part == CUES:
                for x, e, f in elements(data, c, d):
                    if x == CUE_POINT:
                        cue = [0, 0, 0]
                        for y, g, h in elements(data, e, f):
                            if y == CUE_TIME:
                                cue[0] = _number(data, g, h) * scale
                            elif y == CUE_TRACK_POSITIONS:
                                for z, i, j in elements(data, g, h):
                                    if z == CUE_TRACK:
                                        cue[1] = _number(data, i, j)
                                    elif z == CUE_CLUSTER_POSITION:
                                        cue[2] = a + _number(data, i, j)
                        out["cues"].append(tuple(cue))
    out["duration"] = round(out["duration"] * scale)
    return out


def read_track(data: bytes, parsed: dict, track: int = 1) -> bytes:
    return b"".join(data[a:b] for t, _, a, b, _, _ in parsed["packets"] if t == track)


def padded(raw: bytes) -> bytes:
    """raw and zeros up to a positive multiple of UNIT."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


# columns


@lean
def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, SLICE_BYTES):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_media(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, zero-padded, as 8-bit samples in a Matroska file. Null text: an empty one; a long text is one file.

    Null ids and repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_written, "doc_id long, n_bytes long, media binary")


PACKETS = "track long, timestamp_ns long, start long, end long, cluster long, key boolean"


@lean
def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in slices(batch, SLICE_BYTES, "media"):
            rows = []
            for d, media in zip(one.column("doc_id").to_pylist(), one.column("media").to_pylist(), strict=True):
                try:
                    rows += [(d, None, *p) for p in parse_media(media or b"")["packets"]]
                except (Broken, IndexError, struct.error) as e:
                    rows.append((d, str(e), *[None] * 6))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "error", "track", "timestamp_ns", "start", "end", "cluster", "key"])


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of (doc_id, media): track, timestamp, byte range in the file, cluster, key. Null media: no rows; broken media: one row with an error.

    Null ids and repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    return media.select("doc_id", "media").mapInArrow(_packets, f"doc_id long, error string, {PACKETS}")


@lean
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in slices(batch, SLICE_BYTES, "media"):
            rows = []
            for media in one.column("media").to_pylist():
                parsed = parse_media(media)
                payload = read_track(media, parsed)
                samples = np.frombuffer(payload, np.uint8).astype(np.int64)
                rate = parsed["tracks"][1]["rate"]
                crossings = int(np.count_nonzero(np.diff(samples >= 128)))
                feature = f"packets={len(parsed['packets'])};clusters={len(parsed['clusters'])};cues={len(parsed['cues'])};ms={len(payload) * 1000 / rate:.3f};mean={samples.mean():.6f};rms={np.sqrt((samples**2).mean()):.6f};crossings={crossings}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [one.column("doc_id"), one.column("n_bytes"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as media, parse the stored bytes and describe what was read back.

    Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. Equal texts give equal values. Null or empty text: a payload of UNIT zeros. Null ids and
    repeated rows stay; an empty table gives an empty table; other columns are not read. No shuffle.
    """
    return media_column(docs, id_col, text_col).mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
