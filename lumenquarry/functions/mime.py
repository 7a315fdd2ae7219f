"""Kinds of files, from names and first bytes, and what extracts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenquarry.functions.text import basename, extension

TEXT_PROBE = 8192

# Fixed values
KNOWN_NAMES = {
    "Makefile": "text/x-makefile", "makefile": "text/x-makefile", "GNUmakefile": "text/x-makefile", "Dockerfile": "text/x-dockerfile", "CMakeLists.txt": "text/x-cmake",
    "Vagrantfile": "text/plain", "Rakefile": "text/plain", "Gemfile": "text/plain", "Procfile": "text/plain", "Jenkinsfile": "text/plain",
}
EXTENSIONS = {
    "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "xml": "application/xml", "svg": "image/svg+xml",
    "json": "application/json", "csv": "text/csv", "tsv": "text/tab-separated-values", "sql": "application/sql", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip", "bz2": "application/x-bzip2", "xz": "application/x-xz",
    "rs": "text/x-rust", "py": "text/x-python", "js": "text/javascript", "mp3": "audio/mpeg", "mp4": "video/mp4",
}
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "go": "go", "sh": "bash", "bash": "bash"}
GRAMMARS = ("rust", "python", "javascript")
ARCHIVES = ("application/zip", "application/x-tar", "application/gzip", "application/x-gzip", "application/x-bzip2", "application/x-xz", "application/x-7z-compressed", "application/vnd.rar")
MAGIC = {
    "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "25504446": "application/pdf", "504B0304": "application/zip",
    "1F8B": "application/gzip", "425A68": "application/x-bzip2", "FD377A585A00": "application/x-xz", "377ABCAF271C": "application/x-7z-compressed", "526172211A07": "application/vnd.rar",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def is_text(content: Column) -> Column:
    """No NUL in the first bytes."""
    return ~F.hex(F.substring(content, 1, TEXT_PROBE)).rlike("^(..)*00")


def known_name(path: Column) -> Column:
    return _lookup(basename(path), KNOWN_NAMES)


def code_language(path: Column) -> Column:
    return _lookup(extension(path), LANGUAGES)


def has_grammar(path: Column) -> Column:
    return F.coalesce(code_language(path).isin(*GRAMMARS), F.lit(False))


def magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for prefix, mime in reversed(MAGIC.items()):
        out = F.when(head.startswith(prefix), F.lit(mime)).otherwise(out)
    return out


def mime_of_name(path: Column) -> Column:
    return F.coalesce(known_name(path), _lookup(extension(path), EXTENSIONS))


def detect(path: Column, content: Column) -> Column:
    """First bytes, then known names, then extensions, then text or not."""
    return F.coalesce(magic(content), mime_of_name(path), F.when(is_text(content), F.lit("text/plain")).otherwise(F.lit("application/octet-stream")))


def is_archive(mime: Column) -> Column:
    return mime.isin(*ARCHIVES)


def extractor(mime: Column) -> Column:
    """The first rule that fits; what is neither text nor known is skipped, sound and film give metadata only."""
    return (
        F.when(mime == "application/pdf", "pdf")
        .when(mime.contains("wordprocessingml"), "docx")
        .when(mime == "text/markdown", "markdown")
        .when(mime.isin("text/html", "application/xhtml+xml", "application/xml", "text/xml", "image/svg+xml"), "html")
        .when(mime == "application/json", "json")
        .when(mime.isin("text/csv", "text/tab-separated-values"), "csv")
        .when(mime == "application/sql", "sql")
        .when(is_archive(mime), "archive")
        .when(mime.startswith("image/"), "image")
        .when(mime.startswith("audio/") | mime.startswith("video/"), "metadata")
        .when(mime == "application/octet-stream", "skip")
        .otherwise("plaintext")
    )


def json_variant(text: Column) -> Column:
    """object, array, ndjson (objects on lines) or null, by the first characters."""
    first = F.substring(F.ltrim(text), 1, 1)
    lines = text.rlike(r"^\s*\{[^\n]*\}\s*\n\s*\{")
    return F.when(lines, "ndjson").when(first == "{", "object").when(first == "[", "array")


LOG_LINE = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}|\S+ \S+ \S+ \[\d{2}/[A-Z][a-z]{2}/\d{4}:)"


def is_log(path: Column, text: Column) -> Column:
    """By the extension, or by a time at the start of one of the first ten lines."""
    lines = F.slice(F.split(text, "\n"), 1, 10)
    return (extension(path) == "log") | F.exists(lines, lambda line: line.rlike(LOG_LINE))


def unsafe_member(member: Column) -> Column:
    return member.startswith("/") | member.contains("../") | member.contains("..\\") | member.contains("\0")


def ratio_exceeded(compressed: Column, size: Column, limit: int) -> Column:
    """Whole-number division: 300 to 1 exceeds 200, 200.9 to 1 does not."""
    return F.floor(size / F.greatest(compressed, F.lit(1))) > limit


def sensitive(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.rlike("secret|credential|password|private_key") | extension(path).isin("pem", "key", "p12", "pfx")
