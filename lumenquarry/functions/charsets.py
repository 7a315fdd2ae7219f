"""The character set of bytes that say nothing about it, from what they would read as."""

from __future__ import annotations

import re

#: Bytes that are judged (all are checked for being valid).
JUDGED = 1 << 16
#: Of the characters beyond ASCII: the share of frequent ones that a set of two bytes, or of another script, needs; the share in words with A to Z beyond which the script is Latin.
FREQUENT_HAN, FREQUENT_KANA, HANGUL, FREQUENT_LETTERS, LATIN = 0.12, 0.15, 0.8, 0.35, 0.2
#: Letters beyond ASCII, and of them in a word on average, that speak for another script.
LEAST_LETTERS, LEAST_RUN = 6, 2

# Frequent characters of languages, and the sets that write them
HAN = {
    "gb18030": "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生",
    "big5": "的一是不了人我在有他這為之大來以個中上們到說國和地也子時道出而要於就下得可你年生",
}
SCRIPTS = {
    "windows-1251": "оеаинтслрв", "koi8-r": "оеаинтслрв", "iso8859-5": "оеаинтслрв", "cp866": "оеаинтслрв",
    "windows-1253": "αοιετσνηυρκςί", "windows-1255": "יוהלאתרבשמ", "windows-1256": "الينمروتبة", "cp874": "านรอกเงค่ยมสลวดท้ะีัิแไต",
}
LATIN_LETTERS = (
    ("windows-1252", "àâçéèêëîïôùûüœæ"), ("windows-1252", "äöüß"), ("windows-1252", "áéíóúñü¿¡"), ("windows-1252", "áâãàçéêíóôõú"), ("windows-1252", "àèéìòù"), ("windows-1252", "åäöæøé"), ("windows-1252", "áéíóúýþæðö"),
    ("windows-1250", "ąćęłńóśźż"), ("windows-1250", "áčďéěíňóřšťúůýž"), ("windows-1250", "áéíóöőúüű"), ("windows-1250", "ăâîşţ"), ("windows-1250", "čćđšž"), ("windows-1254", "çğıöşüâî"), ("windows-1257", "āčēģīķļņšūžąęėįųõäöü"),
)
MARKS = frozenset("“”‘’„–—…«»€°§·\xa0•™®©")


def _read(raw: bytes, name: str) -> str | None:
    try:
        return raw.decode(name)
    except UnicodeDecodeError:
        return None


def _share(high: str, some: str) -> float:
    return sum(map(high.count, set(some))) / len(high) if high else 0.0


def _two_bytes(raw: bytes) -> str | None:
    """The set of an East Asian language in which the bytes are valid and read as frequent characters."""
    best, name = 0.0, None
    for codec in ("euc_jp", "shift_jis", "euc_kr", *HAN):
        text = _read(raw, codec)
        if text is None:
            continue
        high = "".join(c for c in text[:JUDGED] if c > "\x7f")
        if codec == "euc_kr":
            score = sum("가" <= c <= "힣" for c in high) / max(1, len(high)) / HANGUL
        elif codec in HAN:
            score = _share(high, HAN[codec]) / FREQUENT_HAN
        else:
            score = sum("ぁ" <= c <= "ヺ" for c in high) / max(1, len(high)) / FREQUENT_KANA
        if score >= 1 and score > best:
            best, name = score, codec
    return name


def charset(raw: bytes) -> str:
    """Name of the character set; utf-8 where the bytes are that, windows-1252 where nothing speaks for another one.

    Sets of two bytes are told by their frequent characters, those of other scripts by frequent letters in
    words without A to Z, those of Latin scripts by the language all of whose letters fit best. A few
    letters are no evidence: among equals the more common set wins.
    """
    if _read(raw, "utf-8") is not None:
        return "utf-8"
    found = _two_bytes(raw)
    if found:
        return found
    part = raw[:JUDGED]
    plain = part.decode("latin-1")
    # words as runs of letters, any byte beyond ASCII counting as one
    runs = re.findall(r"[A-Za-z\x80-\xff]+", plain)
    high = sum(sum(c > "\x7f" for c in r) for r in runs)
    mixed = sum(sum(c > "\x7f" for c in r) for r in runs if re.search("[A-Za-z]", r))
    words = [r for r in runs if not r.isascii()]
    if high >= LEAST_LETTERS and high >= LEAST_RUN * len(words) and mixed / high < LATIN:
        scored = []
        for codec, letters in SCRIPTS.items():
            text = part.decode(codec, "replace")
            beyond = "".join(c for c in text.lower() if c > "\x7f" and c not in MARKS)
            odd = len(re.findall(r"(?<=[^\W\d_])[A-ZΑ-ΩА-Я](?=[^\W\d_A-ZΑ-ΩА-Я])", text)) / max(1, len(beyond))  # a capital inside a word
            scored.append((_share(beyond, letters) - odd, codec))
        score, codec = max(scored, key=lambda x: x[0])
        if score >= FREQUENT_LETTERS:
            return codec
    best, name = 0.0, "windows-1252"
    for codec, letters in LATIN_LETTERS:
        beyond = "".join(c for c in part.decode(codec, "replace").lower() if c > "\x7f" and c not in MARKS)
        score = _share(beyond, letters)
        if score > best + 1e-9:
            best, name = score, codec
    return name


def decoded_text(raw: bytes) -> tuple[str, str]:
    """(text, character set); what isn't valid in the set is replaced."""
    name = charset(raw)
    return raw.decode(name, "replace"), name
