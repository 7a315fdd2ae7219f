"""Path globs and ignore rules as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """`**/` any folders, `**` anything, `*` and `?` within a name, [a-z] and [!a-z] classes, {a,b} choices. Text that isn't a pattern stands for itself."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    pattern = "^" + "".join(out) + "$"
    try:
        re.compile(pattern)
    except re.PatternError:
        return "^" + re.escape(glob) + "$"
    return pattern


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


class IgnoreRules:
    """Ignore files in order of precedence: the last matching rule of a file decides, a later file over an earlier one."""

    def __init__(self, *files: str):
        self.rules: list[tuple[bool, re.Pattern]] = []
        for text in files:
            for line in text.splitlines():
                rule = line.rstrip()
                if not rule or rule.startswith("#"):
                    continue
                keep = rule.startswith("!")
                rule = rule.lstrip("!")
                folder = rule.endswith("/")
                rule = rule.rstrip("/")
                anywhere = "/" not in rule
                body = glob_regex(rule.lstrip("/"))[1:-1]
                head = "(?:.*/)?" if anywhere else ""
                self.rules.append((keep, re.compile(f"^{head}{body}(?:/.*)$" if folder else f"^{head}{body}(?:/.*)?$")))

    def ignored(self, path: str) -> bool:
        out = False
        for keep, pattern in self.rules:
            if pattern.match(path):
                out = not keep
        return out

    def column(self, path: Column) -> Column:
        out = F.lit(False)
        for keep, pattern in self.rules:
            out = F.when(path.rlike(pattern.pattern), F.lit(not keep)).otherwise(out)
        return out
