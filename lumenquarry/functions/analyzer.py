"""From texts to index terms: the same function for chunks, queries and snippets."""

from __future__ import annotations

import html
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import regex

from lumenquarry.functions.stem import stem
from lumenquarry.functions.text import LONGEST_TERM

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_TOKEN_AND_MARKS = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
#: Letters that have no decomposition into a plain letter and marks.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ħ": "h", "ı": "i"}
#: Words whose terms a task remembers.
REMEMBERED = 1 << 17


def folded(word: str) -> str:
    """Latin letters without their marks; other scripts, whose marks are letters of their own, stay."""
    if word.isascii():
        return word
    out, latin = [], False
    for c in unicodedata.normalize("NFD", word):
        if unicodedata.combining(c):
            if not latin:
                out.append(c)
        else:
            latin = c < "ɐ" or "Ḁ" <= c < "ἀ"
            out.append(LETTERS.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


@dataclass
class Analyzer:
    """Runs of letters and digits, lower-cased, composed (NFC), folded to plain Latin letters, stemmed if they are plain ASCII.

    Tokens of over LONGEST_TERM characters give no term but keep their position: in a phrase one stands
    for any single token.
    """

    fold: bool = True
    stemmed: bool = True
    _known: dict[str, str | None] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"fold": self.fold, "stemmed": self.stemmed, "_known": {}}

    def term(self, token: str) -> str | None:
        """The term of one token; None for one that is too long."""
        found = self._known.get(token, "")
        if found == "":
            word = unicodedata.normalize("NFC", token.lower())
            if len(word) > LONGEST_TERM:
                found = None
            else:
                word = folded(word) if self.fold else word
                found = stem(word) if self.stemmed and word.isascii() and word.isalpha() else word
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[token] = found
        return found

    def _pattern(self, text: str):
        """Marks after a letter belong to it, so decomposed texts give the terms of composed ones."""
        return _TOKEN if text.isascii() or not self.fold and unicodedata.is_normalized("NFC", text) else _TOKEN_AND_MARKS

    def spans(self, text: str) -> Iterator[tuple[str | None, int, int]]:
        """(term, start, end) of every token."""
        for m in self._pattern(text).finditer(text):
            yield self.term(m[0]), m.start(), m.end()

    def counts(self, text: str) -> dict[str, int]:
        """Occurrences of each term."""
        out: dict[str, int] = {}
        for token, n in Counter(self._pattern(text).findall(text)).items():
            if (term := self.term(token)) is not None:
                out[term] = out.get(term, 0) + n
        return out

    def positions(self, text: str, wanted: frozenset[str] | None = None) -> tuple[dict[str, list[int]], int]:
        """(positions of each term, or of the wanted ones, number of tokens that are terms)."""
        out: dict[str, list[int]] = {}
        tokens, long = self._pattern(text).findall(text), 0
        known, term_of = self._known, self.term
        for at, token in enumerate(tokens):
            term = known.get(token, "")
            if term == "":
                term = term_of(token)
            if term is None:
                long += 1
            elif term in out:
                out[term].append(at)
            elif wanted is None or term in wanted:
                out[term] = [at]
        return out, len(tokens) - long

    def words(self, text: str) -> list[str | None]:
        """The terms of a query's words, in order; None stands for a token that is too long."""
        return [t for t, _, _ in self.spans(text)]

    def snippet(self, text: str, terms: frozenset[str], reach: int = 120) -> str:
        """The window of about `reach` characters with most different terms, then most matches, then the first; escaped, matches in <b>.

        It begins at the start of a sentence, if one starts between the window's edge and its first match.
        """
        found = [(a, b, t) for t, a, b in self.spans(text) if t in terms]
        if not found:
            return html.escape(text[:reach])
        best, left, inside = (0, 0, 0), 0, []
        for i, (a, b, t) in enumerate(found):
            inside.append(t)
            while b - found[left][0] > reach and left < i:
                inside.pop(0)
                left += 1
            best = max(best, (len(set(inside)), len(inside), -left))
        first, last = -best[2], -best[2] + best[1] - 1
        a, b = found[first][0], found[last][1]
        spare = max(0, reach - (b - a))
        start = max(0, a - spare // 2)
        begins = [m.end() for m in regex.finditer(r"(?<=[.!?])\s+", text[max(0, start - 1) : a])]
        if begins:
            start = max(0, start - 1) + begins[0]
        while 0 < start < a and text[start - 1].isalnum() and text[start].isalnum():
            start += 1  # not inside a word
        end = min(len(text), max(b, start + reach))
        while b < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end -= 1
        out, at = [], start
        for x, y, _ in found:
            if start <= x and y <= end:
                out += [html.escape(text[at:x]), "<b>", html.escape(text[x:y]), "</b>"]
                at = y
        return "".join([*out, html.escape(text[at:end])])
