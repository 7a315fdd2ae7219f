"""The English stemmer of the Snowball project (Porter2), as a pure function of a word."""

from __future__ import annotations

import re

# The published algorithm's lists
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {
    w: w for w in "sky news howe atlas cosmos bias andes".split()
}
KEPT_AFTER_PLURALS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_PREFIX = re.compile(r"gener|commun|arsen")
_SHORT_END = re.compile(r"(?:(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", re.S)
_DOUBLE_END = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    # a y that starts the word or follows a vowel is a consonant, written Y
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = _PREFIX.match(w)
    first = prefix or _REGION.search(w)
    r1 = first.end() if first else len(w)
    second = _REGION.search(w, r1)
    r2 = second.end() if second else len(w)

    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURALS:
        return w

    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE_END.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.match(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    end = _longest(w, STEP_2)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before.endswith(tuple("cdeghkmnrt"))):
            w = before + STEP_2[end]
    end = _longest(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.match(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
