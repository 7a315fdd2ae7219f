"""What built-in functions can't read: character sets, images, word-processor files. Arrow batches, errors as values."""

from __future__ import annotations

import codecs
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenquarry.functions.charsets import decoded_text
from lumenquarry.operators.pdf import read_pdf

# Byte order marks
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode_bytes(raw: bytes) -> str:
    """By the mark, as UTF-8 if it is that, else by the character set that its bytes speak for, with what isn't valid replaced."""
    for mark, name in BOMS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    return decoded_text(raw)[0]


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def bom(raw: Column) -> Column:
    """utf-8, utf-16-le, utf-16-be or null; without Python."""
    head = F.hex(F.substring(raw, 1, 3))
    return F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be")


def image_size(raw: bytes) -> tuple[str, int, int]:
    """(format, width, height) from the headers of PNG, GIF, BMP and JPEG."""
    if raw.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png", *struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8":
        return "gif", *struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM":
        w, h = struct.unpack("<ii", raw[18:26])
        return "bmp", w, abs(h)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw):
            marker, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
    raise ValueError("no known image header")


EXIF_TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0132: "taken_at", 0x9003: "taken_at", 0x8827: "iso", 0x920A: "focal_length", 0x829D: "aperture"}


def exif(raw: bytes) -> dict[str, str]:
    """Texts and numbers of a JPEG's first EXIF directories, those of EXIF_TAGS."""
    found: dict[str, str] = {}
    at = raw.find(b"Exif\0\0")
    if raw[:2] != b"\xff\xd8" or at < 0:
        return found
    tiff = raw[at + 6 :]
    order = "<" if tiff[:2] == b"II" else ">"
    todo, seen = [struct.unpack(order + "I", tiff[4:8])[0]], set()
    while todo:
        start = todo.pop()
        if start in seen or start + 2 > len(tiff):
            continue
        seen.add(start)
        for i in range(struct.unpack(order + "H", tiff[start : start + 2])[0]):
            entry = tiff[start + 2 + 12 * i : start + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, n, value = struct.unpack(order + "HHII", entry)
            if tag == 0x8769:
                todo.append(value)
            elif tag in EXIF_TAGS:
                if kind == 2:
                    data = entry[8:12] if n <= 4 else tiff[value : value + n]
                    found[EXIF_TAGS[tag]] = data[:n].rstrip(b"\0 ").decode("ascii", "replace")
                elif kind == 3:
                    found[EXIF_TAGS[tag]] = str(struct.unpack(order + "H", entry[8:10])[0])
                elif kind == 5:
                    a, b = struct.unpack(order + "II", tiff[value : value + 8])
                    found[EXIF_TAGS[tag]] = f"{a / b:g}" if b else "0"
    return found


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(raw: bytes) -> list[tuple[str, int | None, str]]:
    """(kind, level, text) of the paragraphs of a word-processor file; a style named Heading N makes a heading."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        m = re.match(r"(?i)heading\s*([1-9])", style.get(f"{_W}val", "") if style is not None else "")
        if text.strip():
            out.append(("heading", int(m[1]), text) if m else ("paragraph", None, text))
    return out


def docx_properties(raw: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "docProps/core.xml" not in z.namelist():
            return {}
        root = ElementTree.fromstring(z.read("docProps/core.xml"))
    return {e.tag.rpartition("}")[2]: e.text or "" for e in root}


EXTRACTED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
])


def _image(raw: bytes) -> tuple[str, dict[str, str]]:
    kind, w, h = image_size(raw)
    return "", {"codec": kind, "width": str(w), "height": str(h), **exif(raw)}


def _docx(raw: bytes) -> tuple[str, dict[str, str]]:
    return "\n\n".join(t for _, _, t in docx_paragraphs(raw)), docx_properties(raw)


def _text(raw: bytes) -> tuple[str, dict[str, str]]:
    return decode_bytes(raw), {}


#: By the name that functions.mime.extractor gives; add to it to read further formats.
EXTRACTORS: dict[str, Callable[[bytes], tuple[str, dict[str, str]]]] = {"image": _image, "docx": _docx, "pdf": read_pdf}


@F.pandas_udf(EXTRACTED)
def extracted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text and metadata of (extractor, content); what an extractor throws becomes the row's error."""
    for names, contents in parts:
        rows = []
        for name, raw in zip(names, contents, strict=True):
            try:
                text, meta = EXTRACTORS.get(name, _text)(bytes(raw)) if raw is not None else (None, {})
                rows.append((text, meta, None))
            except Exception as e:  # noqa: BLE001  a broken file must not end the job
                rows.append((None, {}, str(e) if str(e).startswith("[") else f"[UNSUPPORTED] {name}: {e}"))
        yield pd.DataFrame(rows, columns=["text", "meta", "error"])
