"""Declarations of source texts, and blocks that begin where declarations do: Rust, Python, JavaScript and TypeScript."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a language's strings and comments look like, in order of trial
HIDDEN = {
    "python": r'''#[^\n]*|[rRbBuUfF]{0,2}("""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\')|[rRbBuUfF]{0,2}("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')''',
    "rust": r'''//[^\n]*|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^\n]{1,9}?|[^'\\\n])\'''',
    "javascript": r'''//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/''',
}
DECLARATIONS = {
    "python": r"^(?P<pad>[ \t]*)(?:async[ \t]+)?(?P<kind>def|class)[ \t]+(?P<name>\w+)",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern(?:\s+\S+)?)\s+)*(?P<kind>fn|struct|enum|trait|union|mod|macro_rules!|impl)(?:\s*<[^{;]*?>)?\s+(?P<name>[^\s({;<!][^({;<]*?)(?=\s*[({;<]|\s+where\b)",
    "javascript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:(?P<kind>function\*?|class|interface|enum|namespace)\s+(?P<name>[\w$]+)|(?P<kind2>const|let|var)\s+(?P<name2>[\w$]+)\s*=\s*(?:async\s*)?(?:function\b|(?:\([^()]*\)|[\w$]+)\s*=>)|(?P<kind3>(?:static\s+|async\s+|get\s+|set\s+|\*\s*|#)*)(?P<name3>[\w$]+)\s*\([^;{}]*\)\s*\{)",
}
SAME = {"typescript": "javascript"}
#: Words before a bracket that begin no method.
NOT_METHODS = frozenset("if for while switch catch with function return do else".split())
_HIDDEN = {k: re.compile(v, re.S) for k, v in HIDDEN.items()}
_DECLARATIONS = {k: re.compile(v, re.M) for k, v in DECLARATIONS.items()}
_WORD = re.compile(r"\S+")


@dataclass
class Declaration:
    """kind, name and place (code points) of a declaration, with those inside it."""

    kind: str
    name: str
    start: int
    end: int
    inner: list[Declaration] = field(default_factory=list)


def plain_code(text: str, language: str) -> str:
    """The text with strings and comments blanked, line breaks kept: brackets and words that are left are code."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    if language == "rust":  # block comments nest
        out, at, depth = [], 0, 0
        for m in re.finditer(_HIDDEN["rust"].pattern + r"|(?P<open>/\*)|(?P<close>\*/)", text, re.S):
            if m["open"]:
                depth += 1
            elif m["close"]:
                depth = max(0, depth - 1)
            if m.start() < at:
                continue
            out.append(blank(text[at : m.start()]) if depth and not (m["open"] and depth == 1) else text[at : m.start()])
            out.append(blank(m[0]))
            at = m.end()
        return "".join([*out, text[at:] if not depth else blank(text[at:])])
    return _HIDDEN[language].sub(lambda m: blank(m[0]), text)


def _indented_end(lines: list[tuple[int, str, bool]], i: int, pad: int) -> int:
    """Where the block of a line ends: before the next line of code that isn't deeper, outside brackets and strings. lines: (start, code, begins inside a string)."""
    depth, last = 0, lines[i][0] + len(lines[i][1])
    for at, line, inside in lines[i:]:
        body = line.strip()
        if at > lines[i][0] and depth <= 0 and body and not inside and len(line) - len(line.lstrip()) <= pad:
            break
        depth += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        if body or inside:
            last = at + len(line)
    return last


def declarations(text: str, language: str) -> list[Declaration]:
    """The declarations of a text as a tree, by brackets or, in Python, by indentation. Unknown languages have none; broken texts have what can be told."""
    language = SAME.get(language, language)
    if language not in DECLARATIONS:
        return []
    code, found = plain_code(text, language), []
    if language == "python":
        lines, at = [], 0
        texts = [m.span() for m in _HIDDEN[language].finditer(text) if "\n" in m[0]]
        opened = [a for a, _ in texts]
        for line in code.split("\n"):
            i = bisect.bisect_left(opened, at) - 1
            lines.append((at, line, i >= 0 and at < texts[i][1]))
            at += len(line) + 1
        starts = [a for a, _, _ in lines]
        for m in _DECLARATIONS[language].finditer(code):
            i = bisect.bisect_right(starts, m.start()) - 1
            first = i
            while first and lines[first - 1][1].strip().startswith("@"):
                first -= 1
            found.append(Declaration(m["kind"], m["name"], lines[first][0], _indented_end(lines, i, len(m["pad"]))))
    else:
        closing, open_ = {}, []
        for m in re.finditer(r"[{}]", code):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                closing[open_.pop()] = m.end()
        for m in _DECLARATIONS[language].finditer(code):
            groups = m.groupdict()
            kind = groups["kind"] or groups.get("kind2") or "method"
            name = groups["name"] or groups.get("name2") or groups.get("name3")
            if kind == "method" and name in NOT_METHODS:
                continue
            stop = re.compile(r"[{;]").search(code, m.end() - (kind == "method"))
            end = len(code) if not stop else closing.get(stop.start(), len(code)) if stop[0] == "{" else stop.end()
            found.append(Declaration(kind, " ".join(name.split()), m.start() + len(m[0]) - len(m[0].lstrip()), end))
    tree: list[Declaration] = []
    path: list[Declaration] = []
    for d in sorted(found, key=lambda d: (d.start, -d.end)):
        while path and path[-1].end <= d.start:
            path.pop()
        if _is_call(d, path):
            continue
        if path:  # broken brackets
            d.end = min(d.end, path[-1].end)
        (path[-1].inner if path else tree).append(d)
        path.append(d)
    return tree


def _is_call(d: Declaration, path: list[Declaration]) -> bool:
    """Whether something that looks like a method is a call within a function."""
    return d.kind == "method" and not (path and path[-1].kind in ("class", "interface"))


def code_blocks(text: str, language: str, target: int = 512) -> Iterator[tuple[int, int, str]]:
    """(start, end, path of names) of blocks, in order: neighbours within the same declaration are joined while their words stay within target, larger declarations are opened."""

    def words(a: int, b: int) -> int:
        return sum(1 for _ in _WORD.finditer(text, a, b))

    def cut(a: int, b: int, inner: list[Declaration], names: str) -> Iterator[tuple[int, int, str]]:
        parts, at = [], a
        for d in inner:
            if min(d.end, b) <= at:
                continue
            if d.start > at:
                parts.append((at, d.start, names, None))
            parts.append((max(d.start, at), min(d.end, b), f"{names}.{d.name}" if names else d.name, d))
            at = min(d.end, b)
        if at < b:
            parts.append((at, b, names, None))
        held: list[tuple[int, int, str, Declaration | None]] = []
        size = 0

        def joined() -> Iterator[tuple[int, int, str]]:
            if held:
                named = [p for p in held if p[3] is not None]
                yield held[0][0], held[-1][1], named[0][2] if len(named) == 1 else names

        for p in parts:
            n = words(p[0], p[1])
            if held and size + n > target:
                yield from joined()
                held, size = [], 0
            if n > target and p[3] is not None and p[3].inner:
                yield from cut(p[0], p[1], p[3].inner, p[2])
            else:
                held.append(p)
                size += n
        yield from joined()

    for a, b, names in cut(0, len(text), declarations(text, language), ""):
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        if part.strip():
            yield a + left, a + len(part.rstrip()), names


def source_blocks(docs: DataFrame, key: str, text: Column, language: Column, target: int = 512) -> DataFrame:
    """(key, block_ord, context, byte_start, byte_end, text): `code_blocks` of every source text, under the path of the declaration. Narrow."""
    rows = docs.select(F.col(key), text.alias("_text"), language.alias("_language"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at = byte = 0
                for i, (a, b, names) in enumerate(code_blocks(t or "", lang or "", target)):
                    byte += len(t[at:a].encode())
                    size = len(t[a:b].encode())
                    out.append((k, i, names or None, byte, byte + size, t[a:b]))
                    at, byte = b, byte + size
            columns = list(zip(*out)) or [()] * 6
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "block_ord", "context", "byte_start", "byte_end", "text"])

    return rows.mapInArrow(run, f"`{key}` {kind}, block_ord int, context string, byte_start long, byte_end long, text string")
