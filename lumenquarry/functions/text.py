"""Tokens, words, snippets, query modes, display."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenquarry.schema import ExitCode

LONGEST_TERM = 80
#: What folds to plain letters: each character of the first to its place in the second.
FOLD_FROM, FOLD_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
# Words that mark a query as natural language
STOP_WORDS = "the a an is are was were in on at for to of with by from how what why when where which who".split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without those over LONGEST_TERM characters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.length(t) <= LONGEST_TERM))


def token_count(lower: Column, some: list[str] | None = None) -> Column:
    """How many tokens a lower-case text has, or how many of them are among `some`; counted in place, without an array of tokens."""
    run = "|".join(re.escape(w) for w in some) if some else rf"[\p{{L}}\p{{N}}]{{1,{LONGEST_TERM}}}+"
    return F.regexp_count(lower, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{run})(?![\p{{L}}\p{{N}}])"))


def fold(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def words(text: Column) -> Column:
    """Runs between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def path_terms(path: Column) -> Column:
    """Lower-case parts of a path and the trigrams of each part of three or more characters."""
    parts = F.filter(F.split(F.lower(path), r"[/.]"), lambda p: p != "")
    grams = F.flatten(F.transform(F.filter(parts, lambda p: F.length(p) >= 3), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))))
    return F.concat(parts, grams)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case, without its dot; '' where the name has none or only starts with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def lossy(raw: Column) -> Column:
    return F.make_valid_utf8(raw)


# snippets

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def html_escape(text: Column) -> Column:
    for plain, entity in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def html_unescape(text: Column) -> Column:
    """The ampersand comes last, so that an escaped entity stays one."""
    for plain, entity in (*ESCAPES[1:], ESCAPES[0]):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def terms_pattern(terms: list[str]) -> str:
    return r"(?i)(^|[^\p{L}\p{N}])(" + "|".join(re.escape(t) for t in terms) + r")($|[^\p{L}\p{N}])"


def snippet(text: Column, terms: list[str], reach: int = 60) -> Column:
    """The surroundings of the first match, escaped, with every matching word in <b>.

    A text without a match gives its beginning.
    """
    either = "|".join(re.escape(t) for t in terms)
    found = F.regexp_instr(F.lower(text), F.lit(rf"(^|[^\p{{L}}\p{{N}}])({either})($|[^\p{{L}}\p{{N}}])"))
    start = F.greatest(F.lit(1), found - reach)
    part = F.substr(text, start, F.lit(2 * reach))
    return F.regexp_replace(html_escape(part), rf"(?iu)(?<![\p{{L}}\p{{N}}])({either})(?![\p{{L}}\p{{N}}])", "<b>$1</b>")


def ansi_snippet(marked: Column) -> Column:
    """A marked snippet for a terminal."""
    return html_unescape(F.replace(F.replace(marked, F.lit("<b>"), F.lit("\x1b[1m")), F.lit("</b>"), F.lit("\x1b[0m")))


# query modes

MODES = ("auto", "fts", "semantic", "hybrid")


def has_phrase(query: Column) -> Column:
    return F.regexp_count(query, F.lit('"')) >= 2


def has_operators(query: Column) -> Column:
    return query.contains(":") | F.arrays_overlap(F.split(query, r"\s+"), F.array(F.lit("AND"), F.lit("OR"), F.lit("NOT")))


def has_stop_word(query: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(query), r"\s+"), F.array(*[F.lit(w) for w in STOP_WORDS]))


def resolved_mode(query: Column, requested: Column, no_vectors: Column) -> Column:
    """fts, semantic or hybrid. An unknown request counts as auto."""
    short = (F.size(F.filter(F.split(query, r"\s+"), lambda t: t != "")) <= 3) & ~has_stop_word(query)
    auto = F.when(no_vectors | has_phrase(query) | has_operators(query) | short, F.lit("fts")).otherwise(F.lit("hybrid"))
    asked = requested.isin("semantic", "hybrid")
    return F.when(requested == "fts", F.lit("fts")).when(asked & no_vectors, F.lit("fts")).when(asked, requested).otherwise(auto)


def query_prefix(query: Column) -> Column:
    return F.concat(F.lit("query: "), query)


# display and targets


def member_path(archive: Column, member: Column) -> Column:
    return F.concat(archive, F.lit("!/"), member)


def member_display(path: Column) -> Column:
    return F.replace(path, F.lit("!/"), F.lit(" → "))


def host_of(target: Column) -> Column:
    """The host of [HOST:]PATH, '' for a local path. A drive letter or a path with a slash before the colon is local."""
    return F.regexp_extract(target, r"^([^/:]{2,}):", 1)


def path_of(target: Column) -> Column:
    return F.when(host_of(target) != "", F.regexp_replace(target, r"^[^/:]{2,}:", "")).otherwise(target)


def json_path(raw: bytes) -> str:
    """Path bytes as JSON text: what isn't UTF-8 becomes \\u00xx."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                c = raw[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            if c:
                out.append({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, f"\\u{ord(c):04x}" if ord(c) < 32 else c))
                at += n
                break
        else:
            out.append(f"\\u00{raw[at]:02x}")
            at += 1
    return "".join(out)


def hyperlink(uri: str, text: str) -> str:
    return f"\x1b]8;;{uri}\x1b\\{text}\x1b]8;;\x1b\\"


def exit_code(error: BaseException | None) -> int:
    if error is None:
        return ExitCode.OK
    if isinstance(error, KeyboardInterrupt):
        return ExitCode.INTERRUPTED
    return getattr(error, "code", ExitCode.OTHER)


# language


LANGUAGE_WORDS = {
    "en": "the and of to in is that it for was on are with as this be from or by",
    "fr": "le la les de des du et un une en que qui est pour dans sur par au avec",
    "de": "der die das und ist in zu den von mit für auf ein eine nicht sich des im",
    "es": "el la los las de del y en que un una por con para no se su al lo",
}


def language(text: Column) -> Column:
    """ISO 639-1 code of the language with most of its common words in the text; null under 20 bytes or without any. Ties go to the first by code."""
    low = F.lower(text)
    score = lambda n, turn, code: F.struct(n.alias("n"), F.lit(turn).alias("turn"), code.alias("code"))
    scores = [score(token_count(low, w.split()), -i, F.lit(code)) for i, (code, w) in enumerate(sorted(LANGUAGE_WORDS.items()))]
    none = score(F.lit(0), 1, F.lit(None).cast("string"))  # the greatest where no word is there
    return F.when(F.octet_length(text) >= 20, F.greatest(none, *scores)["code"])


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def with_prefix(context: Column, text: Column) -> Column:
    """The text under its heading, where it has one."""
    return F.when(context.isNull() | (context == ""), text).otherwise(F.concat(context, F.lit("\n"), text))


def scanned(text: Column, pages: Column) -> Column:
    """Pages without a text layer: some, with under 20 characters among them."""
    return (pages >= 1) & (F.length(F.trim(F.coalesce(text, F.lit("")))) < 20)
