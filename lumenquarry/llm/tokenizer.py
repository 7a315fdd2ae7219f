"""The 50k byte-level vocabulary, with the special string of its .json file.

The .json file and the rank file hold one vocabulary; the rank file's library merges several times
faster, and tests compare the two on every code point and on whole documents.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import tiktoken

SPECIAL = {"<|endoftext|>": 50256}
#: Characters above which a text is encoded in parts.
PART_CHARS = 1 << 16
#: Runs of white space (as the split pattern has it) that are encoded by themselves: its engine backtracks over each character of a run, and gives up at about a million.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{16384,}")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str, special: bool) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL if special else {})


def default_encoding() -> tiktoken.Encoding:
    import public_tokenizers as P

    return encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, True)


def safe_cuts(text: str, size: int = PART_CHARS) -> list[str]:
    """Parts of about `size` characters whose tokens, joined, are those of the text.

    A cut lies before a single space between two characters that are not white space: the split
    pattern always starts a match there, and no special string holds a space. Where a run has no
    such place, the part goes on until there is one.
    """
    if len(text) <= size:
        return [text]
    parts, start, n = [], 0, len(text)
    while n - start > size:
        at = start + size
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= n:
                at = -1
                break
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                break
            at += 1
        if at < 0:
            break
        parts.append(text[start:at])
        start = at
    parts.append(text[start:])
    return parts


def parts_of(text: str, special: tuple[str, ...] = ()) -> Iterator[tuple[str, bool]]:
    """Parts of a text whose tokens, joined, are its own; True marks one that is a single match of the pattern.

    Of a run of white space the pattern takes all but the last character as one match, or the whole run
    at the end of the text or before a special string, where texts are split first; else what follows
    begins with that last character.
    """
    start = 0
    if len(text) > PART_CHARS:
        for m in LONG_SPACE.finditer(text):
            if m.start() > start:
                yield from ((p, False) for p in safe_cuts(text[start : m.start()]))
            start = m.end() if m.end() == len(text) or text.startswith(special, m.end()) else m.end() - 1
            yield text[m.start() : start], True
    if start < len(text):
        yield from ((p, False) for p in safe_cuts(text[start:] if start else text))


def encode_batch(enc: tiktoken.Encoding, texts: list[str]) -> list[list[list[int]]]:
    """Token ids of the parts of each text, encoded as one batch; a special string is its token."""
    special = tuple(enc.special_tokens_set)
    parts = [list(parts_of(t, special)) for t in texts]
    plain = iter(enc.encode_batch([p for some in parts for p, single in some if not single], num_threads=1, allowed_special="all"))
    return [[enc._encode_single_piece(p) if single else next(plain) for p, single in some] for some in parts]
