"""An index over a tree of files: reconcile, search, info, maintenance."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenquarry.config import Config
from lumenquarry.functions import mime as M
from lumenquarry.functions import text as X
from lumenquarry.functions import vectors as V
from lumenquarry.functions.analyzer import Analyzer
from lumenquarry.operators import binary as B
from lumenquarry.operators import chunk as C
from lumenquarry.operators import code as D
from lumenquarry.operators import extract as E
from lumenquarry.operators import ivf as I
from lumenquarry.operators import language as L
from lumenquarry.operators import manifest as N
from lumenquarry.operators import postings as P
from lumenquarry.operators import search as S
from lumenquarry.operators.embed import Embedder, embedded
from lumenquarry.plans.stoppable import Stoppable
from lumenquarry.schema import ARCHIVE_META, BOUNDS, CHUNKS, DOC_META, ENTRIES, LANGUAGES, LENGTHS, MANIFEST, MEDIA_META, POSTINGS, PROGRESS, QUANTIZER, RUNS, SCHEMA_VERSION, TAGS, VECTORS, ExitCode, IndexError_, Status
from lumenquarry.sources.archives import archive_members
from lumenquarry.sources.catalog import Catalog
from lumenquarry.sources.files import walk, with_contents
from lumenquarry.sources.segments import FILE, Segments, Written, both

#: Chunks of a segment for each folder of its postings, and folders at most: a query reads the folder of each term.
FOLDER_CHUNKS, MOST_FOLDERS = 1 << 13, 1 << 12
#: Postings of a term in a segment from which on their blocks have stored bounds; those of fewer are bounded when they are read.
HEAVY = 1024
KEYS = ("file_id", "chunk_ord")
FIELDS = ("body", "title", "path")
#: Rows of a page, and of those before it, that are broadcast at most.
PAGE_ROWS = 10_000
#: Times as many vectors as the lists were trained for, from which on compacting trains them anew.
RETRAINED = 4
#: Ranks of each leg that a hybrid search fuses, at least.
HYBRID_DEPTH = 100
#: Members of archives have ids from here on: that of their archive and a number below it.
MEMBER_IDS, MEMBER_BITS = 1 << 62, 22


@dataclass
class Stats:
    run_id: int
    new_files: int
    modified: int
    deleted: int
    unchanged: int
    processed: int
    failed: int
    duration_ms: int
    cancelled: bool = False


@dataclass
class Hits:
    """rows: the page; total: matches in all; truncated: whether more follow the page; skipped: blocks of postings that weren't scored."""

    rows: DataFrame
    mode: str
    total: int
    truncated: bool
    warning: str | None = None
    skipped: P.Skipped | None = None


def _folder(folders: F.Column | int, term) -> F.Column:
    """The folder of a term's postings in a segment of so many folders (a power of two)."""
    n = F.lit(folders) if isinstance(folders, int) else folders
    return F.concat(n.cast("string"), F.lit("-"), F.pmod(F.xxhash64(term), n).cast("string"))


def _laid_out(name: str, rows: DataFrame, written: Written) -> DataFrame:
    """Postings in folders by term, whose number follows the segment's chunks; within one dealt by ranges of blocks, sorted by term and file."""
    if name == "vectors":
        return rows.sortWithinPartitions("list")
    if name != "postings":
        return rows
    chunks = written["entries"].agg(F.sum("chunks")).first()[0] or 0
    folders = 1
    while folders < MOST_FOLDERS and folders * FOLDER_CHUNKS < chunks:
        folders *= 2
    rows = rows.withColumn("part", _folder(folders, "term"))
    return rows.repartition("part", F.shiftright("file_id", 20)).sortWithinPartitions("part", "term", "field", *KEYS)


def _heavy_bounds(written: Written) -> DataFrame:
    """Block bounds of the terms with many postings in a segment."""
    bounds = P.block_bounds(written["postings"])
    heavy = bounds.groupBy("term", "field").agg(F.sum("n").alias("df")).where(F.col("df") >= HEAVY).drop("df")
    return bounds.join(heavy, ["term", "field"], "left_semi").sortWithinPartitions("term", "field", "block")


def _fields_of() -> dict[str, F.Column]:
    """The fields of chunks joined with their file's title and path (p)."""
    return {"body": F.col("text"), "title": F.coalesce("title", F.lit("")), "path": F.col("p")}


def _title(extractor: str, text: str, given: F.Column) -> F.Column:
    found = F.when(F.col(extractor) == "html", E.html_title(F.col(text))).when(F.col(extractor) == "markdown", F.trim(F.regexp_extract(text, r"(?m)^#\s+(.*)$", 1)))
    return F.coalesce(F.nullif(given, F.lit("")), found, F.lit(""))


def _blocks(texts: DataFrame, target: int) -> DataFrame:
    """(file_id, block_ord, kind, context, byte_start, byte_end, text) of (file_id, path, extractor, text), each text by its own reader.

    What a reader finds no block in is read as plain text. context is the nearest heading above, in
    marked-up texts, or the path of the declaration, in source texts whose blocks are declarations of up
    to `target` words; byte offsets are those of plain and source texts.
    """
    body, log = F.col("text"), (F.col("extractor") == "plaintext") & M.is_log(F.col("path"), F.col("text"))
    of = lambda name: texts.where(F.col("extractor") == name)
    shaped = lambda d, order, kind: d.select("file_id", F.col(order).alias("block_ord"), kind.alias("kind"), "text")
    marked = [shaped(E.html_blocks(of("html"), "file_id", body), "block_ord", F.col("kind")), shaped(E.markdown_blocks(of("markdown"), "file_id", body), "line_ord", F.col("kind"))]
    marked = C.with_heading(marked[0].unionByName(marked[1]).withColumn("heading", F.when(F.col("kind") == "heading", F.col("text"))), "file_id", "block_ord", "heading")
    marked = marked.withColumn("context", F.when(F.col("kind") != "heading", F.col("context"))).drop("heading")
    record = F.lit("record")
    records = shaped(E.csv_records(of("csv"), "file_id", body), "record_ord", record)
    for more in (E.json_records(of("json"), "file_id", body), E.sql_statements(of("sql"), "file_id", body), E.log_batches(texts.where(log), "file_id", body)):
        records = records.unionByName(shaped(more, "record_ord", record))
    read = marked.unionByName(records, True).where("text <> ''")
    rest = texts.where(~F.col("extractor").isin("plaintext", "docx")).join(read.select("file_id").distinct(), "file_id", "left_anti")
    bare = F.when(F.col("extractor") == "html", E.html_text(body)).otherwise(body)
    plain = texts.where(F.col("extractor").isin("plaintext", "docx") & ~F.coalesce(log, F.lit(False))).select("file_id", "path", "text").unionByName(rest.select("file_id", "path", bare.alias("text")))
    language = M.code_language(F.col("path"))
    known = F.coalesce(language.isin(*D.DECLARATIONS, *D.SAME), F.lit(False))
    declared = D.source_blocks(plain.where(known), "file_id", body, language, target).withColumn("kind", F.lit("code"))
    loose = plain.where(~known)
    code = loose.select("file_id", F.when(language.isNotNull(), "code").otherwise("paragraph").alias("kind"))
    paragraphs = C.blocks(loose, "file_id", body).join(code, "file_id")
    return read.unionByName(declared, True).unionByName(paragraphs, True).select("file_id", "block_ord", "kind", "context", "byte_start", "byte_end", "text")


class Index:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark
        self.config = Config.from_toml(catalog.settings())
        self._run: Stoppable | None = None
        self.analyzer = Analyzer(self.config.search.fold, self.config.search.stemmer)
        self.files = Segments(catalog, "files", {}, MANIFEST)
        self.content = Segments(
            catalog, "content", {"chunks": CHUNKS, "postings": POSTINGS, "doc_meta": DOC_META, "media_meta": MEDIA_META, "archive_meta": ARCHIVE_META, "progress": PROGRESS}, ENTRIES,
            partition_by={"postings": "part"}, layout=_laid_out, derived={"bounds": (BOUNDS, _heavy_bounds)},
        )
        self.vectors = Segments(catalog, "vectors", {"vectors": VECTORS}, FILE, layout=_laid_out)

    @classmethod
    def create(cls, spark: SparkSession, root: str, config: Config | None = None) -> Index:
        return cls(Catalog.create(spark, root, (config or Config()).to_toml()))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Index:
        return cls(Catalog.open(spark, root))

    # tables

    def manifest(self) -> DataFrame:
        return self.files.table("entries")

    def chunks(self) -> DataFrame:
        return self.content.table("chunks")

    def postings(self) -> DataFrame:
        return self.content.table("postings")

    def lengths(self) -> DataFrame:
        """(field, n, average): chunks and their mean number of terms."""
        return self.catalog.table("lengths", LENGTHS)

    def _measured(self, entries: DataFrame) -> DataFrame:
        row = entries.agg(F.sum("chunks").alias("n"), *(F.sum(f).alias(f) for f in FIELDS)).where("n > 0")
        return row.select("n", F.explode(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f) / F.col("n"))])).alias("field", "average"))

    # reconciling

    def changes(self, tree: str) -> DataFrame:
        """What a run would do, without doing it."""
        return N.diff(self._walked(tree), self.manifest())

    def _walked(self, tree: str) -> DataFrame:
        w = self.config.walk
        return walk(self.spark, tree, w.hidden, w.follow_symlinks, w.gitignore or w.index_ignore).where(~F.col("is_dir"))

    def reconcile(self, tree: str, kind: str = "incremental", only_new: bool = False, verify: bool = False, seconds: float | None = None) -> Stats:
        """Bring the index up to date with a tree that all executors see. kind 'full' reads every file anew.

        One writer at a time. All tables of the run become current together. A run that cancel() or its
        time (seconds) ends leaves them all as they were and is written down as such.
        """
        started = time.time_ns()
        with self.catalog.writing():
            try:
                with Stoppable(self.spark, seconds) as self._run:
                    try:
                        return self._reconcile(tree, kind, only_new, verify)
                    except Exception:  # noqa: BLE001  a cancelled job throws in several ways
                        if not self._run.stopped:
                            raise
                return self._cut_short(kind, started)
            finally:
                self._run = None

    def cancel(self) -> None:
        """End the run that another thread is in, if there is one; a run that has committed stays."""
        run = self._run
        if run:
            run.stop()

    def _cut_short(self, kind: str, started: int) -> Stats:
        took, run_id = (time.time_ns() - started) // 1_000_000, self._next_run()
        run = self.spark.createDataFrame([(run_id, started, None, kind, "metadata_diff", 0, 0, 0, 0, 0, 0, took, 1, "cancelled")], RUNS)
        self.catalog.commit({"runs": N.recent_runs(self.catalog.table("runs", RUNS).unionByName(run))})
        return Stats(run_id, 0, 0, 0, 0, 0, 0, took, cancelled=True)

    def _next_run(self) -> int:
        return 1 + (self.catalog.table("runs", RUNS).agg(F.max("run_id")).first()[0] or 0)

    def _reconcile(self, tree: str, kind: str, only_new: bool, verify: bool) -> Stats:
        started, limits = time.time_ns(), self.config.extraction
        # members of archives are rows of their own, which no walk meets
        seen, everything = self._walked(tree), self.manifest()
        old, old_members = everything.where("parent_archive_id is null"), everything.where("parent_archive_id is not null")
        change = N.diff(seen, old)
        todo = ["new"] if only_new else ["new", "modified", "unchanged"] if kind == "full" or verify else ["new", "modified"]
        merged = N.upsert(old, seen, started)
        facts = seen.select("path", "path_raw", "ctime_ns", "inode", "dev", "mode", "uid", "gid")
        carried = old.select("path", F.col("content_hash").alias("o_hash"), F.col("mime_type").alias("o_mime"), F.col("status").alias("o_status"), F.col("last_verified_ns").alias("o_verified"))
        # one walk for all steps: kept by the executors, not written, since most of it doesn't change
        rows = merged.join(change.select("path", "change"), "path").join(facts, "path", "left").join(carried, "path", "left").persist()
        counts = N.counts(rows.select("change")).first()
        work = rows.where(F.col("change").isin(*todo)).select("file_id", "path", "size", "fail_count")
        small, large = work.where(F.col("size") <= limits.max_file_size), work.where(F.col("size") > limits.max_file_size)
        read = with_contents(small, tree).unionByName(large.withColumn("content", F.lit(None).cast("binary"))).withColumn("mime_type", M.detect(F.col("path"), F.col("content")))
        read = read.withColumn("extractor", F.when(F.col("size") > limits.max_file_size, "skip").when(F.col("content").isNull(), "missing").otherwise(M.extractor(F.col("mime_type"))))
        plain = ~F.col("extractor").isin("skip", "missing", "metadata", "archive")
        read = read.withColumn("x", F.when(plain, B.extracted(F.when(plain, F.col("extractor")), F.when(plain, F.col("content")))))
        read = read.select("file_id", "path", "size", "mime_type", "extractor", F.sha2("content", 256).alias("content_hash"), "fail_count", X.nfc("x.text").alias("text"), F.col("x.meta").alias("meta"), F.col("x.error").alias("error"), F.when(F.col("extractor") == "archive", F.col("content")).alias("archive"))
        path = f"{self.catalog.root}/{self.catalog.new_folder('extracted')}"
        done = self._kept(read, path)
        members = archive_members(done.where("archive is not null").select("path", F.col("archive").alias("content")), self.config.archives)
        failed_now = F.col("error").isNotNull() | (F.col("extractor") == "missing")
        permanent = F.col("error").startswith("[") | (F.col("fail_count") + 1 >= limits.max_retries)
        state = F.when(F.col("extractor") == "skip", int(Status.SKIPPED)).when(failed_now & permanent, int(Status.FAILED_PERMANENT)).when(failed_now, int(Status.FAILED_TRANSIENT)).otherwise(int(Status.INDEXED))
        result = done.select("file_id", F.col("content_hash").alias("n_hash"), F.col("mime_type").alias("n_mime"), state.alias("n_status"), F.coalesce("error", F.when(F.col("extractor") == "missing", F.lit("[DEFERRED] not readable"))).alias("n_error"))
        full = rows.join(result, "file_id", "left")
        hit = F.col("n_status").isNotNull()
        failure = F.col("n_status").isin(int(Status.FAILED_TRANSIENT), int(Status.FAILED_PERMANENT))
        status = F.when(F.col("change") == "deleted", int(Status.DELETED)).when(hit, F.col("n_status")).when(F.col("change") == "unchanged", F.col("o_status")).otherwise(F.col("status"))
        new = full.select(
            "file_id", "path", F.coalesce("path_raw", F.encode("path", "UTF-8")).alias("path_raw"), F.xxhash64("path").alias("path_hash"), "inode", "dev", "size", "mtime_ns", "ctime_ns", "mode", "uid", "gid",
            F.when(hit, F.col("n_hash")).otherwise(F.col("o_hash")).alias("content_hash"), F.when(hit, F.col("n_mime")).otherwise(F.col("o_mime")).alias("mime_type"), status.cast("int").alias("status"),
            (F.col("fail_count") + F.when(failure, 1).otherwise(0)).cast("int").alias("fail_count"), "first_seen_ns", F.when(hit, F.lit(started)).otherwise(F.col("o_verified")).alias("last_verified_ns"),
            F.when(hit, F.col("n_error")).otherwise(F.col("error_msg")).alias("error_msg"), F.lit(None).cast("long").alias("parent_archive_id"),
        )
        links = N.hard_links(new.where(F.col("status") != int(Status.DELETED)))
        redone = rows.where(F.col("change").isin(*todo, "deleted")).select("file_id")
        replaced = redone.unionByName(old_members.join(redone.withColumnRenamed("file_id", "parent_archive_id"), "parent_archive_id", "left_semi").select("file_id"))
        inside = self._members(members, done, started)
        # of the manifest only the rows that change are written: work, deletions, and links of others that lost or found their first name
        before = old.select("file_id", F.col("hard_link_of").alias("o_link"), F.lit(True).alias("known"))
        touched = redone.withColumn("touched", F.lit(True))
        replaced = self._kept(replaced, f"{path}-replaced")
        rewritten = new.join(links, "file_id", "left").join(before, "file_id", "left").join(touched, "file_id", "left").where(F.col("touched") | F.col("known").isNull() | ~F.col("hard_link_of").eqNullSafe(F.col("o_link")))
        manifest = self._kept(rewritten.select(*MANIFEST.names).unionByName(inside.select(*MANIFEST.names)), f"{path}-manifest")
        text = done.where("text is not null and text <> ''").select("file_id", "path", "extractor", "text", _title("extractor", "text", F.col("meta")["title"]).alias("title"))
        member_text = inside.where("content is not null").withColumn("extractor", M.extractor(F.col("mime_type"))).where(~F.col("extractor").isin("skip", "metadata", "archive", "image", "pdf", "docx")).withColumn("text", X.nfc(B.decoded("content")))
        text = text.unionByName(member_text.select("file_id", "path", "extractor", "text", _title("extractor", "text", F.lit(None).cast("string")).alias("title")))
        text = self._kept(text, f"{path}-text")
        pieces = C.chunk_windows(_blocks(text, self.config.chunking.target_tokens), ("file_id", "block_ord", "kind", "context", "byte_start", "byte_end"), F.col("text"), self.config.chunking.target_tokens, self.config.chunking.overlap_tokens)
        pieces = pieces.withColumn("chunk_ord", (F.row_number().over(Window.partitionBy("file_id").orderBy("block_ord", "chunk_ord")) - 1).cast("int"))
        chunk_rows = pieces.select("file_id", "chunk_ord", "byte_start", "byte_end", F.col("kind").alias("block_kind"), X.with_prefix(F.col("context"), F.col("text")).alias("text"))
        chunk_rows = self._kept(chunk_rows, f"{path}-chunks")
        titles = text.select("file_id", "title")
        read_as = F.when(F.col("extractor") == "html", E.html_text(F.col("text"))).otherwise(F.col("text"))
        meta = done.drop("title").join(titles, "file_id", "left").select("file_id", F.nullif("title", F.lit("")).alias("title"), *(F.coalesce(F.col("meta")[n], F.when(F.col("extractor") == "html", E.html_meta(F.col("text"), tag)) if tag else F.lit(None)).alias(n) for n, tag in (("author", "author"), ("subject", "description"), ("creator", "generator"), ("producer", None))), F.col("meta")["created"].alias("created_at"), F.col("meta")["modified"].alias("modified_at"), F.col("meta")["pages"].cast("int").alias("page_count"), X.word_count(F.coalesce(read_as, F.lit(""))).alias("word_count"), self._language()(read_as).alias("lang"))
        media = done.where("extractor = 'image' and error is null").select("file_id", *(F.col("meta")[n].cast(MEDIA_META[n].dataType).alias(n) for n in MEDIA_META.names[1:]))
        rollup = members.groupBy(F.col("archive").alias("path")).agg(F.count("member").alias("member_count"), F.sum("size").alias("total_size"), F.max("error").alias("worst"))
        archives = rollup.join(done.select("path", "file_id", "mime_type"), "path").select("file_id", "member_count", "total_size", F.col("mime_type").alias("format"), F.when(F.col("worst").isNull(), "complete").otherwise("partial").alias("extraction_status"))
        indexed = result.where(F.col("n_status") == int(Status.INDEXED)).select("file_id").unionByName(inside.where(F.col("status") == int(Status.INDEXED)).select("file_id"))
        progress = indexed.select("file_id", F.lit("fts").alias("index_name"), F.lit(SCHEMA_VERSION).alias("schema_ver"), F.lit(started).alias("indexed_at_ns"))
        ended = time.time_ns()
        run_id = self._next_run()
        run = self.spark.createDataFrame([(run_id, started, ended, kind, "metadata_diff", counts.new_files + counts.modified + counts.deleted + counts.unchanged, counts.new_files, counts.modified, counts.deleted, counts.unchanged, counts.processed, (ended - started) // 1_000_000, 0, None)], RUNS)
        runs = N.recent_runs(self.catalog.table("runs", RUNS).unionByName(run))
        paths = done.select("file_id", "path").unionByName(inside.select("file_id", "path"))
        fresh = chunk_rows.join(paths.withColumnRenamed("path", "p"), "file_id").join(titles, "file_id", "left")
        postings = self._kept(self._analyzed(fresh), f"{path}-postings")
        tables = {"entries": self._entries(paths.select("file_id"), chunk_rows, postings), "chunks": chunk_rows, "postings": postings, "doc_meta": meta, "media_meta": media, "archive_meta": archives, "progress": progress}
        content = self.content.added(tables, replaced)
        files = self.files.added({"entries": manifest}, replaced.unionByName(manifest.select("file_id")))
        vectors = self.vectors.removed(replaced)  # those of texts that changed are of no use; embed() makes new ones
        lengths = self._measured(N.without(self.content.table("entries"), replaced).unionByName(tables["entries"]))
        self.catalog.commit({"runs": runs, "lengths": lengths}, {"last_reconciliation_ns": started}, both(content, files, vectors))
        self._run.done()
        self.merge()
        failed = self.manifest().where(F.col("last_verified_ns") == started).where(F.col("status").isin(int(Status.FAILED_TRANSIENT), int(Status.FAILED_PERMANENT))).count()
        rows.unpersist()
        for used in ("", "-text", "-chunks", "-postings", "-replaced", "-manifest"):
            self.catalog.delete(path + used)
        return Stats(run_id, counts.new_files, counts.modified, counts.deleted, counts.unchanged, counts.processed, failed, (time.time_ns() - started) // 1_000_000)

    def _language(self) -> Callable[[F.Column], F.Column]:
        rows = [tuple(r) for r in self.catalog.table("languages", LANGUAGES).collect()]
        return L.LanguageModel.of(rows).column(self.spark) if rows else X.language

    def learn_languages(self, docs: DataFrame, text: str = "text", lang: str = "lang") -> list[str]:
        """Tell languages apart as these texts are told apart; for texts that are read from now on. Without it, common words decide."""
        model_rows = L.gram_rows(L.gram_counts(docs, F.col(text), F.col(lang)))
        with self.catalog.writing():
            self.catalog.commit({"languages": model_rows})
        return [r["lang"] for r in self.catalog.table("languages", LANGUAGES).select("lang").distinct().orderBy("lang").collect()]

    def _kept(self, rows: DataFrame, path: str) -> DataFrame:
        """Rows of a run as a table of its own, which later steps read."""
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _analyzed(self, fresh: DataFrame) -> DataFrame:
        """Postings of chunks with their file's path (p) and title."""
        return P.positional(fresh, _fields_of(), KEYS, self.analyzer).withColumn("part", F.lit(""))

    def _entries(self, ids: DataFrame, chunks: DataFrame, postings: DataFrame) -> DataFrame:
        """A row for each file of a segment: its chunks and the terms of their fields."""
        n = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
        terms = postings.groupBy("file_id").agg(*(F.sum(F.when(F.col("field") == f, F.col("tf"))).alias(f) for f in FIELDS))
        return ids.distinct().join(n, "file_id", "left").join(terms, "file_id", "left").select("file_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("chunks", *FIELDS)))

    def merge(self) -> int:
        """Merge segments of a size while there are enough of them; returns how many merges that were."""
        n = 0
        with self.catalog.writing():
            for group in (self.files, self.content, self.vectors):
                while some := group.due():
                    self.catalog.commit({}, change=group.merged(some))
                    n += 1
        return n

    def _members(self, members: DataFrame, done: DataFrame, started: int) -> DataFrame:
        """Manifest rows, with content, of the members that archives gave; their ids come from their archive's and their number in it, above those of files."""
        parent = done.where("archive is not null").select(F.col("path").alias("archive"), F.col("file_id").alias("parent_archive_id"))
        d = members.where("member is not null").join(parent, "archive")
        low, most = F.col("number").cast("long"), 1 << MEMBER_BITS
        number = F.shiftleft("parent_archive_id", MEMBER_BITS).bitwiseOR(low)
        member_id = F.when(low < most, number).otherwise(F.xxhash64("path").bitwiseAND(F.lit(MEMBER_IDS - 1)))
        none = {n: F.lit(None).cast(MANIFEST[n].dataType) for n in MANIFEST.names}
        permanent = F.when(F.col("error").isNull(), int(Status.INDEXED)).otherwise(int(Status.FAILED_PERMANENT))
        known = {
            "file_id": member_id.bitwiseOR(F.lit(MEMBER_IDS)), "path": F.col("path"), "path_raw": F.encode("path", "UTF-8"), "path_hash": F.xxhash64("path"), "size": F.col("size"),
            "content_hash": F.sha2("content", 256), "mime_type": M.detect(F.col("path"), F.col("content")), "status": permanent.cast("int"), "fail_count": F.col("error").isNotNull().cast("int"), "first_seen_ns": F.lit(started),
            "last_verified_ns": F.lit(started), "error_msg": F.col("error"), "parent_archive_id": F.col("parent_archive_id"),
        }
        return d.select(*(known.get(n, none[n]).alias(n) for n in MANIFEST.names), "content")

    def put_vectors(self, vectors: DataFrame, dims: int = 256) -> None:
        """Vectors (file_id, chunk_ord, v) of chunks, shortened to dims and scaled; they take the place of those of the same files."""
        short = vectors.select("file_id", F.col("chunk_ord").cast("int").alias("chunk_ord"), V.shortened(V.doubles(F.col("v")), dims).alias("v"))
        with self.catalog.writing():
            self._add_vectors(short, dims, replace=True)
            self.merge()

    def _quantizer(self) -> I.Quantizer | None:
        rows = [tuple(r) for r in self.catalog.table("quantizer", QUANTIZER).collect()]
        return I.Quantizer.of(rows) if rows else None

    def stored_vectors(self) -> DataFrame:
        """(file_id, chunk_ord, v): vectors as they are stored, to 16-bit floats."""
        return I.unpacked(self.vectors.table("vectors"), KEYS)

    def _add_vectors(self, short: DataFrame, dims: int, replace: bool) -> int:
        path = f"{self.catalog.root}/{self.catalog.new_folder('fresh-vectors')}"
        rows = self._kept(short, path)
        ids, quantizer = rows.select("file_id").distinct(), self._quantizer()
        added = self.vectors.added({"entries": ids, "vectors": I.encoded(rows, quantizer).select(*VECTORS.names)}, ids if replace else None)
        self.catalog.commit({}, {"dims": dims}, added)
        if quantizer is None:
            self._train()
        n = rows.count()
        self.catalog.delete(path)
        return n

    def _train(self) -> bool:
        """Train inverted lists and codes on a sample of the stored vectors and deal all of them anew; False if they are too few."""
        rows = self.stored_vectors()
        quantizer = I.trained(rows, F.concat_ws("-", *KEYS))
        if quantizer is None:
            return False
        table = self.spark.createDataFrame(quantizer.rows(), QUANTIZER)
        n = rows.count()
        self.catalog.commit({"quantizer": table}, {"trained_on": n}, self.vectors.merged(instead={"vectors": I.encoded(rows, quantizer).select(*VECTORS.names)}))
        return True

    def embed(self, load: Callable[[], Embedder], dims: int = 256) -> int:
        """Give every chunk that has no vector one, by the model that load() gives in each task; returns how many were made."""
        with self.catalog.writing():
            old, keys = self.vectors.table("vectors"), list(KEYS)
            made = embedded(self.chunks().join(old.select(*keys), keys, "left_anti"), load)
            n = self._add_vectors(made.select(*keys, V.shortened(F.col("v"), dims).alias("v")), dims, replace=False)
            self.merge()
            return n

    # searching

    def search(self, text: str, mode: str = "auto", filters: S.Filters | None = None, limit: int | None = None, offset: int = 0, vector: list[float] | None = None, explain: bool = False, embedder: Embedder | None = None, exact: bool = False) -> Hits:
        """Chunks that match, best first. total counts the matches of either leg.

        The query's vector, or a model that gives it one (embedder), makes the semantic leg; without
        either, or without vectors of chunks, modes fall back to full text. exact: compare all vectors
        instead of those of the nearest lists.
        """
        cfg = self.config.search
        limit = cfg.limit if limit is None else limit
        empty = (vector is None and embedder is None) or not self.vectors
        row = self.spark.range(1).select(X.resolved_mode(F.lit(text), F.lit(mode), F.lit(empty)).alias("m"), X.query_prefix(F.lit(text)).alias("q")).first()
        resolved, keys, deep = row["m"], KEYS, max(1, limit + offset)
        if vector is None and resolved != "fts":
            vector = list(embedder([row["q"]])[0])
        info = self._searchable()
        # rows of deleted files are gone from the tables below, so without filters no file has to be looked up
        allowed = info.where(filters.predicate()).select("file_id") if filters else None
        clauses = P.analyzed(S.parse_query(text), self.analyzer, FIELDS)
        terms = P.terms_of(clauses)
        fts = vec = best = skipped = None
        if resolved in ("fts", "hybrid") and terms:
            boosts = {"body": 1.0, "title": cfg.title_boost, "path": cfg.path_boost}
            hits = self._hits({t for row in clauses for c in row for t in c.known if not c.column})
            some = hits if allowed is None else hits.join(allowed, "file_id", "left_semi")
            if P.is_simple(clauses, FIELDS):
                df = hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
                best, skipped = P.top_k(hits, self._bounds(terms, hits), self.lengths(), terms, boosts, max(deep, HYBRID_DEPTH if resolved == "hybrid" else 0), keys, allowed, df)
                fts = some.select(*keys).distinct()
            else:
                values = None
                if any(c.column for row in clauses for c in row):
                    some = some.join(info.select("file_id", F.col("mime_type").alias("_mime"), F.col("lang").alias("_lang")), "file_id")
                    values = {"mime": F.col("_mime"), "lang": F.col("_lang")}
                keep = P.matching(some, clauses, keys, values)
                scores = S.bm25(hits.where(F.col("term").isin(*terms)), self.lengths(), terms, boosts, keys)
                fts = best = scores.join(keep, list(keys), "left_semi")
        if resolved in ("semantic", "hybrid"):
            near, vec = self._near(vector, max(deep, HYBRID_DEPTH), allowed, exact)
        legs = [leg.select(*keys) for leg in (fts, vec) if leg is not None]
        total = (legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1]).distinct()).count() if legs else 0

        def top(d: DataFrame, n: int) -> DataFrame:
            best = d.orderBy(F.desc("score"), *keys).limit(n)
            return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *keys)))

        if fts is None and vec is None:
            scored = self.spark.createDataFrame([], "file_id long, chunk_ord int, score double, rank int, score_fts double, score_vec double")
        elif fts is not None and vec is not None:
            wide = max(deep, HYBRID_DEPTH)
            a, b = top(best, wide).select(*keys, F.col("rank").alias("ra"), F.col("score").alias("score_fts")), top(near, wide).select(*keys, F.col("rank").alias("rb"), F.col("score").alias("score_vec"))
            both = a.join(b, list(keys), "full_outer")
            scored = top(both.withColumn("score", S.rrf(F.col("ra"), F.col("rb"), cfg.rrf_k, cfg.fts_weight)), deep)
        else:
            one = best if fts is not None else near
            scored = top(one, deep).withColumn("score_fts", F.col("score") if fts is not None else F.lit(None).cast("double")).withColumn("score_vec", F.col("score") if fts is None else F.lit(None).cast("double"))
        scored = S.min_max(scored).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
        page_rows = F.broadcast(scored) if deep <= PAGE_ROWS else scored  # a page of any size joins; a small one is sent
        named = page_rows.join(info, "file_id", "left").join(self.chunks().select(*keys, "text"), list(keys), "left")
        page = named.select(
            "rank", "file_id", "chunk_ord", F.coalesce("path", F.concat(F.lit("file#"), F.col("file_id").cast("string"))).alias("path"), F.round("normalized", 6).alias("score"), F.round("score", 6).alias("score_raw"),
            *(["score_fts", "score_vec"] if explain else []), "mime_type", "size", "mtime_ns", "tags", self._snippet(terms)(F.col("text")).alias("snippet"),
        )
        warning = "no vectors: full text instead" if mode in ("semantic", "hybrid") and resolved == "fts" else None
        return Hits(page.orderBy("rank"), resolved, total, total > offset + limit, warning, skipped)

    def _near(self, vector: list[float], k: int, allowed: DataFrame | None, exact: bool) -> tuple[DataFrame, DataFrame]:
        """(keys, score) of the nearest chunks of the probed lists, and the keys of all that have a vector."""
        dims = self.catalog.state()["values"].get("dims", len(vector))
        short = self.spark.range(1).select(V.shortened(F.array(*[F.lit(float(x)) for x in vector]), min(len(vector), dims)).alias("q")).first()["q"]
        quantizer = None if exact else self._quantizer()
        restricted = lambda d: d if allowed is None else d.join(allowed, "file_id", "left_semi")
        lists = None if quantizer is None else F.col("list").isin(*(int(x) for x in quantizer.probes(np.asarray(short, np.float32), self.config.search.probes)))
        rows = restricted(self.vectors.table("vectors", lists))
        reranked = None if quantizer is None else max(1, -(-max(self.config.search.ef_search, k) // k))
        return I.search(rows, quantizer, short, k, KEYS, probes=self.config.search.probes, reranked=reranked), restricted(self.vectors.table("vectors")).select(*KEYS)

    def _hits(self, terms: set[str]) -> DataFrame:
        """Postings of terms, read from their folders of each segment, with the segment."""
        if not terms:
            return self.content.table("postings", with_segment=True).limit(0)
        sizes = [1 << i for i in range(MOST_FOLDERS.bit_length())]
        # terms are hashed here, so that the folders to read are literals
        named = self.spark.createDataFrame([(t,) for t in sorted(terms)], "t string")
        folders = [r[0] for r in named.select(F.explode(F.array(*(_folder(n, "t") for n in sizes))).alias("part")).distinct().collect()]
        return self.content.table("postings", F.col("part").isin(*folders) & F.col("term").isin(*sorted(terms)), with_segment=True)

    def _bounds(self, terms: list[str], hits: DataFrame) -> DataFrame:
        """Block bounds of terms: stored ones where a segment has many postings of a term, those of its few postings elsewhere."""
        stored = self.content.table("bounds", F.col("term").isin(*terms), with_segment=True)
        heavy = stored.select("segment", "term", "field").distinct()  # at most segments x terms x fields rows
        light = P.block_bounds(hits.join(F.broadcast(heavy), ["segment", "term", "field"], "left_anti"))
        both_ = stored.select(*BOUNDS.names).unionByName(light.select(*BOUNDS.names))
        # blocks may lie in several segments
        return both_.groupBy("term", "field", "block").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_length").alias("min_length"))

    def _snippet(self, terms: list[str]) -> Callable[[F.Column], F.Column]:
        analyzer, wanted = self.analyzer, frozenset(terms)

        @F.pandas_udf("string")
        def marked(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else analyzer.snippet(t, wanted))

        return marked

    def _searchable(self) -> DataFrame:
        tags = self.catalog.table("tags", TAGS).groupBy("file_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        lang = self.content.table("doc_meta").select("file_id", "lang")
        m = N.live(self.manifest()).select("file_id", "path", "mime_type", "size", "mtime_ns")
        return m.join(tags, "file_id", "left").join(lang, "file_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))

    # looking

    def info(self, path: str) -> DataFrame:
        """One row for a file: its manifest entry with metadata, tags, chunks and which indexes hold it."""
        m = self.manifest().where(F.col("path") == path)
        found = m.select("file_id").first()
        here = F.col("file_id") == (found["file_id"] if found else -1)  # a literal, so that scans skip what can't hold it
        per = self.content.table("entries", here).select("file_id", F.col("chunks").alias("chunk_count"))
        vec = self.vectors.table("entries", here).select("file_id").distinct().withColumn("v", F.lit(True))
        meta = self.content.table("doc_meta", here).select("file_id", "title", "author", "word_count", "lang")
        arch = self.content.table("archive_meta", here).select("file_id", "member_count", "total_size", "extraction_status")
        tags = self.catalog.table("tags", TAGS).where(here).groupBy("file_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        d = m
        for t in (per, vec, meta, arch, tags):
            d = d.join(t, "file_id", "left")
        return d.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("in_fts", F.col("chunk_count") > 0).withColumn("in_vectors", F.coalesce("v", F.lit(False))).drop("v", "path_raw")

    def stats(self) -> dict:
        values = self.catalog.state()["values"]
        last = values.get("last_reconciliation_ns")
        return N.summary(self.manifest()).first().asDict() | {"schema_version": SCHEMA_VERSION, "last_reconciliation_ns": last}

    def staleness(self, now_ns: int | None = None) -> str:
        last, r = self.catalog.state()["values"].get("last_reconciliation_ns"), self.config.refresh
        col = N.staleness(F.lit(last).cast("long"), F.lit(now_ns or time.time_ns()), r.threshold, r.warn_threshold)
        return self.spark.range(1).select(col.alias("s")).first()["s"]

    def refresh(self, tree: str) -> Stats | None:
        """Reconcile if the index is stale and no writer is at work, within refresh.budget seconds."""
        if not self.config.refresh.enabled or self.staleness() == "fresh":
            return None
        try:
            return self.reconcile(tree, "auto_refresh", only_new=self.config.refresh.new_only, seconds=self.config.refresh.budget)
        except IndexError_:
            return None

    # maintenance

    def verify(self, tree: str, sample: float = 1.0, fail_fast: bool = False) -> DataFrame:
        """(file_id, stored, actual) of files whose bytes aren't what was indexed."""
        files = N.live(self.manifest()).where("parent_archive_id is null")
        m = N.hash_sample(files, sample) if sample < 1 else files
        actual = with_contents(m.select("file_id", "path"), tree).select("file_id", F.sha2("content", 256).alias("content_hash"))
        bad = N.corrupted(m, actual)
        return bad.limit(1) if fail_fast else bad

    def delete(self, glob: str, dry_run: bool = False) -> DataFrame:
        """Mark matching files deleted and take them out of the other tables; returns what matched."""
        if dry_run:
            return N.matching(self.manifest(), glob).select("file_id", "path")
        with self.catalog.writing():
            manifest = self.manifest()
            gone = N.matching(manifest, glob).select("file_id", "path").cache()
            gone.count()
            if not gone.isEmpty():
                ids = N.with_members(gone, manifest, self.config.archives.max_depth)
                marked = manifest.join(ids, "file_id", "left_semi").withColumn("status", F.lit(int(Status.DELETED)))
                tags = N.without(self.catalog.table("tags", TAGS), ids)
                lengths = self._measured(N.without(self.content.table("entries"), ids))
                self.catalog.commit({"tags": tags, "lengths": lengths}, change=both(self.files.added({"entries": marked}, ids), self.content.removed(ids), self.vectors.removed(ids)))
        return gone

    def tag(self, glob: str, *names: str) -> None:
        with self.catalog.writing():
            rows = N.matching(self.manifest(), glob).select("file_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("tag"))
            self.catalog.commit({"tags": self.catalog.table("tags", TAGS).unionByName(rows).distinct()})

    def duplicates(self, min_size: int = 1) -> DataFrame:
        return N.duplicates(N.live(self.manifest()).where("content_hash is not null"), min_size=min_size)

    def recover(self) -> DataFrame:
        """Indexed files that the ledger doesn't know: the next run must read them again."""
        return N.missing_progress(self.manifest(), self.content.table("progress"), "fts", SCHEMA_VERSION)

    def reindex(self, target: str = "all") -> None:
        """Rebuild from the chunks ('fts'), or forget vectors ('vectors'), or both ('all')."""
        with self.catalog.writing():
            if target in ("vectors", "all"):
                self.catalog.commit({"quantizer": self.spark.createDataFrame([], QUANTIZER)}, change=self.vectors.cleared())
            if target in ("fts", "all") and self.content:
                named = self.manifest().select("file_id", F.col("path").alias("p"))
                fresh = self.chunks().join(named, "file_id").join(self.content.table("doc_meta").select("file_id", "title"), "file_id", "left")
                path = f"{self.catalog.root}/{self.catalog.new_folder('fresh-postings')}"
                postings = self._kept(self._analyzed(fresh), path)
                entries = self._entries(self.content.table("entries").select("file_id"), self.chunks(), postings)
                self.catalog.commit({"lengths": self._measured(entries)}, change=self.content.merged(instead={"postings": postings, "entries": entries}))
                self.catalog.delete(path)

    def compact(self) -> list[str]:
        """Make one segment of each group, without anything of files that are gone, then delete what no snapshot names."""
        with self.catalog.writing():
            gone = self.manifest().where(F.col("status") == int(Status.DELETED)).select("file_id")
            self.catalog.commit({}, change=self.files.removed(gone))
            self.catalog.commit({}, change=both(*(g.merged() for g in (self.files, self.content, self.vectors))))
            trained_on = self.catalog.state()["values"].get("trained_on", 0)
            if trained_on and self.vectors.table("vectors").count() >= RETRAINED * trained_on:
                self._train()
            return self.catalog.vacuum()

    def checkpoint(self) -> int:
        """Merge what is due and delete what no snapshot names; returns how many folders went."""
        with self.catalog.writing():
            self.merge()
            return len(self.catalog.vacuum())

    def configure(self, **changes: dict[str, object]) -> Config:
        """Change settings by section, as configure(search={"limit": 5}), and write them down. Terms change with the next reindex."""
        config = self.config.changed(changes)
        with self.catalog.writing():
            self.catalog.configure(config.to_toml())
        self.config = config
        return config

    def describe(self, stats: Stats) -> dict:
        return asdict(stats)


__all__ = ["ExitCode", "Hits", "Index", "Stats"]
