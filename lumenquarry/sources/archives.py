"""Members of archives as rows."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lumenquarry.config import Archives

SCHEMA = "archive string, number int, path string, member string, depth int, ord int, compressed long, size long, content binary, error string"


class LimitPassed(Exception):
    pass


def is_unsafe(member: str) -> bool:
    return member.startswith("/") or "../" in member or "..\\" in member or "\0" in member


def kind_of(raw: bytes) -> str | None:
    if raw[:4] == b"PK\x03\x04":
        return "zip"
    for magic, name in ((b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\0", "xz")):
        if raw.startswith(magic):
            return name
    return "tar" if raw[257:262] == b"ustar" else None


def _read(stream, limit: int) -> bytes:
    out = stream.read(limit + 1)
    if len(out) > limit:
        raise LimitPassed("[UNSUPPORTED] more bytes than an archive may hold")
    return out


def _members(raw: bytes, name: str, kind: str, limits: Archives) -> Iterator[tuple[str, int, bytes]]:
    """(name, compressed size, content); sizes are checked while reading, not believed."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    with z.open(info) as f:
                        yield info.filename, info.compress_size, _read(f, min(limits.max_total_size, max(1, info.compress_size) * (limits.max_ratio + 1)))
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for info in t:
                if info.isfile():
                    yield info.name, info.size, _read(t.extractfile(info), limits.max_total_size)
    else:
        opened = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[kind]
        with opened(io.BytesIO(raw)) as f:
            out = _read(f, min(limits.max_total_size, len(raw) * (limits.max_ratio + 1)))
        base = name.rpartition("/")[2]
        for end in (f".{kind}", ".tgz", ".tbz2", ".txz"):
            if base.endswith(end):
                base = base[: -len(end)] + (".tar" if end.startswith(".t") else "")
                break
        yield base, len(raw), out


def expand(path: str, raw: bytes, limits: Archives, depth: int = 1) -> Iterator[tuple]:
    """Rows of SCHEMA from `path` on: members by name, archive!/member, and those of archives among them, down to the limit of depth.

    An unsafe name, a ratio or a total beyond the limits, or broken data gives a row with an error
    and no content; members before it stay.
    """
    kind = kind_of(raw)
    if kind is None:
        return
    total = count = 0
    try:
        for i, (member, compressed, content) in enumerate(_members(raw, path, kind, limits)):
            full = f"{path}!/{member}"
            total, count = total + len(content), count + 1
            if count > limits.max_members or total > limits.max_total_size:
                raise LimitPassed("[UNSUPPORTED] more members or bytes than an archive may hold")
            if is_unsafe(member):
                yield full, member, depth, i, compressed, len(content), None, "[UNSUPPORTED] unsafe name"
            elif len(content) // max(compressed, 1) > limits.max_ratio:
                yield full, member, depth, i, compressed, len(content), None, "[UNSUPPORTED] compression ratio"
            else:
                inner = kind_of(content)
                if inner and depth >= limits.max_depth:
                    yield full, member, depth, i, compressed, len(content), None, "[UNSUPPORTED] nested too deep"
                elif inner:
                    yield from expand(full, content, limits, depth + 1)
                else:
                    yield full, member, depth, i, compressed, len(content), content, None
    except (LimitPassed, OSError, EOFError, ValueError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, RuntimeError) as e:
        text = str(e)
        yield path, None, depth, None, None, None, None, text if text.startswith("[") else f"[UNSUPPORTED] broken archive: {text}"


def archive_members(files: DataFrame, limits: Archives = Archives()) -> DataFrame:
    """SCHEMA from (path, content): narrow, an archive at a time. archive is the path of the file, number counts its rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            for path, content in f.itertuples(index=False):
                rows = [(path, i, *r) for i, r in enumerate(expand(path, bytes(content), limits))] if content is not None else []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"ord": "Int32", "compressed": "Int64", "size": "Int64"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
