"""Log-structured tables of files: a run adds a segment, deletions are bitmaps, segments of a size are merged."""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lumenquarry.schema import IndexError_
from lumenquarry.sources.catalog import Catalog

#: So many segments of a size become one of the next size.
FANOUT = 8
#: How tables are encoded: positions grow within a row, so that their differences are stored.
OPTIONS = {"postings": {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#positions.list.element": "false"}}
#: Bytes of deletion bitmaps that a read broadcasts; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
BITMAP_BYTES = 4096
SEGMENT = "segment"
_DEAD = "segment int, bucket long, bits binary"
Written = dict[str, DataFrame]
Layout = Callable[[str, DataFrame, Written], DataFrame]
Derived = tuple[StructType, Callable[[Written], DataFrame]]


def _bit(bits: str, key: str) -> Column:
    """Whether a bitmap has a key's bit."""
    place = f"bitmap_bit_position({key})"
    byte = f"CAST(conv(hex(substring({bits}, CAST({place} div 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return F.expr(f"getbit({byte}, CAST({place} % 8 AS INT)) = 1")


class Segments:
    """Tables whose rows belong to files (file_id long), written in segments.

    A segment holds the rows of the files that one run touched, and `entries`, one row for each of those
    files. Rows of a file that a later run replaces stay where they are; the run writes, for each older
    segment and range of ids, a bitmap of the files that are gone from it. A row counts if its file's bit
    in its segment's bitmap is off. So a run writes in proportion to what it changes, merges apart: FANOUT
    segments of about one size are rewritten as one, without the rows that are gone, which makes each row
    move once a size.
    """

    def __init__(self, catalog: Catalog, group: str, schemas: dict[str, StructType], entries: StructType, partition_by: dict[str, str] | None = None, layout: Layout | None = None, derived: dict[str, Derived] | None = None):
        """layout: (table, rows, what is written already) as rows are to be written. derived: tables that follow from those of their segment; their rows belong to no file."""
        self.catalog, self.spark, self.group = catalog, catalog.spark, group
        self.derived = derived or {}
        self.schemas = schemas | {"entries": entries} | {n: d[0] for n, d in self.derived.items()}
        self.partition_by, self.layout = partition_by or {}, layout

    # state

    def _state(self, state: dict | None = None) -> dict:
        return (state or self.catalog.state())["segments"].get(self.group, {"next": 0, "segments": [], "dead": []})

    def segments(self) -> list[dict]:
        """[{id, files, paths}] of the current snapshot."""
        return self._state()["segments"]

    def __bool__(self) -> bool:
        return bool(self.segments())

    # reading

    def _schema(self, name: str) -> StructType:
        return StructType([*self.schemas[name].fields, StructField(SEGMENT, IntegerType())])

    def _all(self, name: str, segments: list[dict]) -> DataFrame:
        paths = [f"{self.catalog.root}/{s['paths'][name]}" for s in segments if name in s["paths"]]
        if not paths:
            return self.spark.createDataFrame([], self._schema(name))
        schema = self._schema(name)
        column = self.partition_by.get(name)
        if column is None:
            return self.spark.read.schema(schema).parquet(*paths)
        # folders below each path name the partition column: one read a path, which Spark prunes on its own
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _dead(self, dead: list[dict]) -> DataFrame:
        rows = self.spark.read.schema(_DEAD).parquet(*(f"{self.catalog.root}/{d['path']}" for d in dead))
        return rows.groupBy("segment", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        if not state["dead"]:
            return rows
        bits = self._dead(state["dead"]).select(F.col("segment").alias("_s"), F.col("bucket").alias("_b"), F.col("bits").alias("_bits"))
        if sum(d["bitmaps"] for d in state["dead"]) * BITMAP_BYTES <= BROADCAST_BYTES:
            bits = F.broadcast(bits)
        rows = rows.withColumn("_bucket", F.bitmap_bucket_number("file_id"))
        joined = rows.join(bits, (F.col(SEGMENT) == F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
        return joined.where(F.col("_bits").isNull() | ~_bit("_bits", "file_id")).drop("_bucket", "_s", "_b", "_bits")

    def table(self, name: str, where: Column | None = None, with_segment: bool = False) -> DataFrame:
        """The rows that count, in no order. where: a condition that is applied before the bitmaps are looked up."""
        state = self._state()
        rows = self._all(name, state["segments"])
        if where is not None:
            rows = rows.where(where)
        out = rows if name in self.derived else self._live(rows, state)
        return out if with_segment else out.select(*self.schemas[name].names)

    def has_deletions(self) -> bool:
        return bool(self._state()["dead"])

    # writing

    def _write(self, tables: dict[str, DataFrame], number: int) -> dict:
        paths, written = {}, {}

        def put(name: str, rows: DataFrame) -> None:
            folder = self.catalog.new_folder(f"{self.group}-{name}")
            write = rows.withColumn(SEGMENT, F.lit(number)).write.options(**OPTIONS.get(name, {}))
            if name in self.partition_by:
                write = write.partitionBy(self.partition_by[name])
            write.parquet(f"{self.catalog.root}/{folder}")
            paths[name] = folder
            written[name] = self.spark.read.schema(self._schema(name)).parquet(f"{self.catalog.root}/{folder}")

        for name in ["entries", *(n for n in tables if n != "entries" and n not in self.derived)]:
            put(name, self.layout(name, tables[name].select(*self.schemas[name].names), written) if self.layout else tables[name].select(*self.schemas[name].names))
        for name, (schema, follows) in self.derived.items():
            put(name, follows(written).select(*schema.names))
        return {"id": number, "files": written["entries"].count(), "paths": paths}

    def added(self, tables: dict[str, DataFrame], replaced: DataFrame | None = None) -> Callable[[dict], None]:
        """Write a segment of new rows, and bitmaps for the files in `replaced` (file_id); the result makes them current in a commit.

        tables: `entries`, one row for each file of the segment, and rows of those files.
        """
        state = self._state()
        number = state["next"]
        dead = self._buried(replaced, state) if replaced is not None and state["segments"] else None
        segment = self._write(tables, number)

        def change(full: dict) -> None:
            group = full["segments"].setdefault(self.group, {"next": 0, "segments": [], "dead": []})
            if group["next"] != number:
                raise IndexError_("another writer has added a segment")
            group["next"] = number + 1
            if segment["files"]:
                group["segments"].append(segment)
            if dead:
                group["dead"].append(dead)

        return change

    def removed(self, gone: DataFrame) -> Callable[[dict], None]:
        """Write bitmaps for files (file_id) that go without successors; the result makes them current in a commit."""
        state = self._state()
        dead = self._buried(gone, state) if state["segments"] else None

        def change(full: dict) -> None:
            if dead:
                full["segments"][self.group]["dead"].append(dead)

        return change

    def _buried(self, replaced: DataFrame, state: dict) -> dict | None:
        entries = self._live(self._all("entries", state["segments"]), state).select(SEGMENT, "file_id")
        gone = entries.join(replaced.select("file_id").distinct(), "file_id", "left_semi")
        bits = gone.groupBy(SEGMENT, F.bitmap_bucket_number("file_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("file_id")).alias("bits"))
        folder = self.catalog.new_folder(f"{self.group}-dead")
        bits.write.parquet(f"{self.catalog.root}/{folder}")
        n = self.spark.read.schema(_DEAD).parquet(f"{self.catalog.root}/{folder}").count()
        return {"path": folder, "bitmaps": n} if n else None

    # merging

    @staticmethod
    def tier(files: int) -> int:
        return int(log(max(files, 1), FANOUT) + 1e-9)

    def due(self) -> list[dict] | None:
        """The segments that are to be merged next: the smallest tier that has FANOUT of them."""
        tiers: dict[int, list[dict]] = {}
        for s in self.segments():
            tiers.setdefault(self.tier(s["files"]), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FANOUT), None)

    def merged(self, segments: list[dict] | None = None, instead: dict[str, DataFrame] | None = None) -> Callable[[dict], None] | None:
        """Rewrite segments (None: all) as one without what is gone; the result makes it current in a commit. None if there is nothing to do.

        instead: other rows for some of the tables.
        """
        state, instead = self._state(), instead or {}
        segments = state["segments"] if segments is None else segments
        if not segments or len(segments) < 2 and not state["dead"] and not instead:
            return None
        number, ids = state["next"], {s["id"] for s in segments}
        names = sorted({n for s in segments for n in s["paths"]})
        tables = {n: self._live(self._all(n, segments), state) for n in names if n not in self.derived}
        segment = self._write(tables | instead, number)
        rest = [s for s in state["segments"] if s["id"] not in ids]
        dead: list[dict] = []
        if state["dead"] and rest:  # one table of bitmaps of the segments that stay
            kept = self._dead(state["dead"]).where(F.col("segment").isin(*(s["id"] for s in rest)))
            folder = self.catalog.new_folder(f"{self.group}-dead")
            kept.write.parquet(f"{self.catalog.root}/{folder}")
            n = self.spark.read.schema(_DEAD).parquet(f"{self.catalog.root}/{folder}").count()
            dead = [{"path": folder, "bitmaps": n}] if n else []

        def change(full: dict) -> None:
            group = full["segments"][self.group]
            if group["next"] != number:
                raise IndexError_("another writer has added a segment")
            group["next"] = number + 1
            group["segments"] = [*rest, *([segment] if segment["files"] else [])]
            group["dead"] = dead

        return change

    def cleared(self) -> Callable[[dict], None]:
        """No rows at all, from the commit on that this is part of."""

        def change(full: dict) -> None:
            group = full["segments"].setdefault(self.group, {"next": 0, "segments": [], "dead": []})
            group["segments"], group["dead"] = [], []

        return change


def both(*changes: Callable[[dict], None] | None) -> Callable[[dict], None]:
    def change(full: dict) -> None:
        for c in changes:
            if c:
                c(full)

    return change


FILE = StructType([StructField("file_id", LongType())])
