"""Settings of an index, with sizes and durations written as text."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenquarry.schema import ExitCode, IndexError_

# Units, by lower-case name
BYTE_UNITS = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "kib": 2**10, "m": 10**6, "mb": 10**6, "mib": 2**20, "g": 10**9, "gb": 10**9, "gib": 2**30, "t": 10**12, "tb": 10**12, "tib": 2**40}
SECOND_UNITS = {"": 1, "s": 1, "sec": 1, "secs": 1, "m": 60, "min": 60, "mins": 60, "h": 3600, "hr": 3600, "hrs": 3600, "d": 86400, "day": 86400, "days": 86400, "w": 604800, "wk": 604800, "wks": 604800}


def parse_bytes(text: str | int) -> int:
    """'1.5KiB' -> 1536. Fractions are allowed and cut off after multiplying."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([A-Za-z]*)\s*", str(text))
    if not m or m[2].lower() not in BYTE_UNITS:
        raise IndexError_(f"not a size: {text!r}", ExitCode.CONFIG)
    return int(float(m[1]) * BYTE_UNITS[m[2].lower()])


def parse_seconds(text: str | int) -> int:
    """'7d' -> 604800. Whole numbers only; m is minutes."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([A-Za-z]*)\s*", str(text))
    if not m or m[2].lower() not in SECOND_UNITS:
        raise IndexError_(f"not a duration: {text!r}", ExitCode.CONFIG)
    return int(m[1]) * SECOND_UNITS[m[2].lower()]


def _unit(col: Column, units: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), F.lower(F.regexp_extract(col, r"([A-Za-z]*)\s*$", 1)))


def bytes_of(col: Column) -> Column:
    """parse_bytes on a column; null where the text is no size."""
    ok = col.rlike(r"^\s*[0-9]*\.?[0-9]+\s*[A-Za-z]*\s*$")
    return F.when(ok, F.floor(F.regexp_extract(col, r"([0-9]*\.?[0-9]+)", 1).cast("double") * _unit(col, BYTE_UNITS)).cast("long"))


def seconds_of(col: Column) -> Column:
    ok = col.rlike(r"^\s*[0-9]+\s*[A-Za-z]*\s*$")
    return F.when(ok, F.regexp_extract(col, r"([0-9]+)", 1).cast("long") * _unit(col, SECOND_UNITS))


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 512
    overlap_tokens: int = 128
    min_tokens: int = 32
    hard_max: int = 8192
    heading_prefix: bool = True


@dataclass(frozen=True)
class Extraction:
    max_file_size: int = 2 * 2**30
    max_retries: int = 3


@dataclass(frozen=True)
class Refresh:
    enabled: bool = True
    threshold: int = 3600
    warn_threshold: int = 7 * 86400
    budget: int = 30
    new_only: bool = True


@dataclass(frozen=True)
class Walk:
    gitignore: bool = True
    index_ignore: bool = True
    follow_symlinks: bool = True
    hidden: bool = True


@dataclass(frozen=True)
class Search:
    limit: int = 20
    rrf_k: int = 60
    title_boost: float = 2.0
    path_boost: float = 0.5
    fts_weight: float = 1.0
    ef_search: int = 128  #: vectors that are scored after those of the probed lists are ranked by codes
    probes: int = 16  #: inverted lists that a query reads
    fold: bool = True  #: index terms without the marks of Latin letters
    stemmer: bool = True  #: index stems of English words


@dataclass(frozen=True)
class Archives:
    max_total_size: int = 8 * 2**30
    max_members: int = 100_000
    max_depth: int = 3
    max_ratio: int = 200


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    extraction: Extraction = field(default_factory=Extraction)
    refresh: Refresh = field(default_factory=Refresh)
    walk: Walk = field(default_factory=Walk)
    search: Search = field(default_factory=Search)
    archives: Archives = field(default_factory=Archives)

    def changed(self, changes: dict[str, dict[str, object]]) -> Config:
        """With other values for keys of sections; an unknown section or key is an error."""
        for section, values in changes.items():
            known = {f.name for f in fields(getattr(self, section))} if section in {f.name for f in fields(self)} else set()
            if not set(values) <= known:
                raise IndexError_(f"settings: no {section}.{', '.join(sorted(set(values) - known))}", ExitCode.CONFIG)
        return replace(self, **{section: replace(getattr(self, section), **values) for section, values in changes.items()})

    @staticmethod
    def from_toml(text: str) -> Config:
        """Every section and key has a default; an unknown key or a value of another kind is an error."""
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise IndexError_(f"settings: {e}", ExitCode.CONFIG) from e
        parts = {}
        for section in fields(Config):
            kind = section.default_factory
            values = dict(raw.get(section.name, {}))
            for f in fields(kind):
                if f.name in values and isinstance(values[f.name], str):
                    values[f.name] = (parse_bytes if "size" in f.name else parse_seconds)(values[f.name])
            try:
                parts[section.name] = kind(**values)
            except TypeError as e:
                raise IndexError_(f"settings, {section.name}: {e}", ExitCode.CONFIG) from e
        return Config(**parts)

    def to_toml(self) -> str:
        out = []
        for section in fields(self):
            out.append(f"[{section.name}]")
            value = getattr(self, section.name)
            out += [f"{f.name} = {str(v).lower() if isinstance(v := getattr(value, f.name), bool) else v}" for f in fields(value)]
        return "\n".join(out) + "\n"
