"""Text, headings and records out of marked-up and structured texts."""

from __future__ import annotations

import html as html_lib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """The common entities, the ampersand last."""
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


@F.pandas_udf(StringType())
def all_unescaped(text: pd.Series) -> pd.Series:
    """Every named and numbered entity."""
    return text.map(lambda t: None if t is None else html_lib.unescape(t))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(text, r"(?s)<[^>]*>", " ")), r"[ \t\r\n]+", " "))


def html_title(html: Column) -> Column:
    return _flat(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_meta(html: Column, name: str) -> Column:
    return F.nullif(unescaped(F.regexp_extract(html, rf'(?is)<meta\s+name="{name}"\s+content="([^"]*)"', 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """What a reader sees: no scripts, styles, comments or tags, entities resolved, white space joined."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    return _flat(bare)


def html_blocks(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """(key, block_ord, kind, level, text): headings, paragraphs, code and list items in order."""
    pattern = r"(?is)<(h[1-6]|p|pre|li)(?:\s[^>]*)?>(.*?)</\1>"
    whole = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    rows = pages.select(key, F.posexplode(whole).alias("block_ord", "b"))
    tag = F.lower(F.regexp_extract("b", r"(?is)^<(h[1-6]|pre|p|li)", 1))
    kind = F.when(tag.startswith("h"), "heading").when(tag == "pre", "code").when(tag == "li", "list_item").otherwise("paragraph")
    level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int"))
    return rows.select(key, "block_ord", kind.alias("kind"), level.alias("level"), _flat(F.col("b")).alias("text"))


@F.pandas_udf(ArrayType(StructType([StructField("i", IntegerType()), StructField("x", StringType()), StructField("code", BooleanType())])))
def _marked_lines(texts: pd.Series) -> pd.Series:
    """Lines that aren't blank or fences, and whether they lie between fences; time in proportion to the text."""

    def one(t: str | None) -> list[dict] | None:
        if t is None:
            return None
        code, out = False, []
        for i, x in enumerate(t.split("\n")):
            if x.lstrip(" \t\n\v\f\r").startswith("```"):
                code = not code
            elif x.strip(" "):
                out.append({"i": i, "x": x, "code": code})
        return out

    return texts.map(one)


def markdown_blocks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, line_ord, kind, level, text) of the lines that aren't blank; lines between fences are code."""
    rows = docs.select(key, F.explode(_marked_lines(text)).alias("m"))
    hashes = F.length(F.regexp_extract("m.x", r"^(#{1,6})\s", 1))
    kind = F.when(F.col("m.code"), "code").when(hashes > 0, "heading").when(F.col("m.x").rlike(r"^\s*([-*+]|\d+\.)\s"), "list_item").when(F.col("m.x").rlike(r"^\s*>"), "quote").otherwise("paragraph")
    plain = F.when(F.col("m.code"), F.col("m.x")).otherwise(F.regexp_replace("m.x", r"^\s*(#{1,6}|[-*+]|\d+\.|>)\s*", ""))
    return rows.select(key, F.col("m.i").alias("line_ord"), kind.alias("kind"), F.when(kind == "heading", hashes).alias("level"), plain.alias("text"))


def csv_delimiter(text: Column) -> Column:
    """The most frequent of comma, tab, semicolon and bar in the first line; a tie goes to the first of these."""
    line = F.substring_index(text, "\n", 1)
    found = [F.struct(F.regexp_count(line, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, (p, d) in enumerate(((",", ","), ("\t", "\t"), (";", ";"), (r"\|", "|")))]
    return F.array_max(F.array(*found))["d"]


def csv_records(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, record_ord, text): each line after the first as `name: value` pairs; quotes keep delimiters and line ends together."""
    from collections.abc import Iterator

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for f in frames:
            out = []
            for k, t, d in f.itertuples(index=False):
                rows = list(csv.reader(io.StringIO(t or ""), delimiter=d or ","))
                for i, r in enumerate(rows[1:]):
                    out.append((k, i, "; ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False))))
            yield pd.DataFrame(out, columns=[key, "record_ord", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text.alias("t"), csv_delimiter(text).alias("d")).mapInPandas(parse, f"{key} {kind}, record_ord int, text string")


def json_records(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, record_ord, text): elements of an array, members of an object as one-member objects, or lines of objects."""
    lines = F.filter(F.split(text, r"\n"), lambda x: F.trim(x) != "")
    members = F.from_json(text, "map<string,string>")
    as_objects = F.transform(F.map_entries(members), lambda e: F.to_json(F.create_map(e["key"], e["value"])))
    elements = F.from_json(text, "array<string>")
    first = F.substring(F.ltrim(text), 1, 1)
    many = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("{"))) > 1
    records = F.when((first == "{") & many, lines).when(first == "{", as_objects).when(first == "[", elements)
    return docs.select(key, F.posexplode(records).alias("record_ord", "text"))


def sql_statements(docs: DataFrame, key: str, text: Column) -> DataFrame:
    rows = docs.select(key, F.posexplode(F.filter(F.split(text, ";"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")).alias("record_ord", "text"))
    return rows.select(key, "record_ord", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def log_batches(docs: DataFrame, key: str, text: Column, lines: int = 100) -> DataFrame:
    """(key, record_ord, text): runs of so many lines."""
    all_ = F.split(text, "\n")
    at = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / lines).cast("int")), lambda i: i * lines)
    return docs.select(key, all_.alias("l"), F.posexplode(at).alias("record_ord", "a")).select(key, "record_ord", F.array_join(F.slice("l", F.col("a") + 1, F.lit(lines)), "\n").alias("text"))
