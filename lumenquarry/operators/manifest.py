"""The manifest: comparing snapshots, carrying rows over, states, ledgers, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenquarry.functions.globs import glob_match
from lumenquarry.schema import Status


def diff(walk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change, file_id, size, mtime_ns): new, modified, deleted or unchanged; one full outer join on the path.

    Rows whose state is pending, failed for now or deleted are work even if size and time are equal.
    A deleted row that isn't walked stays out.
    """
    w = walk.select("path", F.col("size").alias("w_size"), F.col("mtime_ns").alias("w_mtime"), F.lit(True).alias("walked"))
    m = manifest.select("path", "file_id", "size", "mtime_ns", "status", F.lit(True).alias("known"))
    both = w.join(m, "path", "full_outer")
    redo = F.col("status").isin(int(Status.PENDING), int(Status.FAILED_TRANSIENT), int(Status.DELETED))
    change = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("walked").isNull() & (F.col("status") != int(Status.DELETED)), "deleted")
        .when(F.col("walked").isNull(), None)
        .when((F.col("w_size") != F.col("size")) | (F.col("w_mtime") != F.col("mtime_ns")) | redo, "modified")
        .otherwise("unchanged")
    )
    out = both.withColumn("change", change).where("change is not null")
    return out.select("path", "change", "file_id", F.coalesce("w_size", "size").alias("size"), F.coalesce("w_mtime", "mtime_ns").alias("mtime_ns"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: new_files, modified, deleted, unchanged, processed."""
    is_ = lambda *c: F.count_if(F.col("change").isin(*c))
    return changes.agg(is_("new").alias("new_files"), is_("modified").alias("modified"), is_("deleted").alias("deleted"), is_("unchanged").alias("unchanged"), is_("new", "modified").alias("processed"))


def upsert(manifest: DataFrame, walk: DataFrame, now_ns: int) -> DataFrame:
    """The manifest after a walk: walked files take their new size and time and become pending; first_seen, failures and errors stay.

    New files get ids after the greatest one, numbered within ranges of paths: counts of the ranges
    are added up, so the numbering needs no single task.
    """
    m = manifest.select("path", "file_id", "size", "mtime_ns", "status", "fail_count", "first_seen_ns", "error_msg")
    both = m.join(walk.select("path", F.col("size").alias("w_size"), F.col("mtime_ns").alias("w_mtime")), "path", "full_outer")
    old = both.where("file_id is not null").select(
        "path", "file_id", F.coalesce("w_size", "size").alias("size"), F.coalesce("w_mtime", "mtime_ns").alias("mtime_ns"),
        F.when(F.col("w_size").isNotNull(), F.lit(0)).otherwise(F.col("status")).cast("int").alias("status"), "fail_count", "first_seen_ns", "error_msg",
    )
    fresh = both.where("file_id is null").select("path", "w_size", "w_mtime", F.pmod(F.xxhash64("path"), F.lit(256)).alias("salt"))
    ahead = fresh.groupBy("salt").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = manifest.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top"))
    number = F.row_number().over(Window.partitionBy("salt").orderBy("path"))
    fresh = fresh.withColumn("k", number).join(F.broadcast(ahead.select("salt", "before")), "salt").crossJoin(F.broadcast(top))
    new = fresh.select(
        "path", (F.col("top") + F.col("before") + F.col("k")).cast("long").alias("file_id"), F.col("w_size").alias("size"), F.col("w_mtime").alias("mtime_ns"),
        F.lit(0).cast("int").alias("status"), F.lit(0).cast("int").alias("fail_count"), F.lit(now_ns).cast("long").alias("first_seen_ns"), F.lit(None).cast("string").alias("error_msg"),
    )
    return old.unionByName(new)


def transition(manifest: DataFrame, outcome: DataFrame, now_ns: int, max_retries: int = 3) -> DataFrame:
    """Apply outcomes (file_id, new_status, error): failures add one to fail_count, and one that fails too often fails for good."""
    both = manifest.join(outcome, "file_id", "left")
    failed = F.col("new_status").isin(int(Status.FAILED_TRANSIENT), int(Status.FAILED_PERMANENT))
    fails = F.col("fail_count") + F.when(failed, 1).otherwise(0)
    status = F.when((F.col("new_status") == int(Status.FAILED_TRANSIENT)) & (fails >= max_retries), int(Status.FAILED_PERMANENT)).otherwise(F.coalesce("new_status", "status"))
    hit = F.col("new_status").isNotNull()
    return both.select(
        "file_id", status.cast("int").alias("status"), fails.cast("int").alias("fail_count"),
        F.when(hit, F.col("error")).otherwise(F.col("error_msg")).alias("error_msg"), F.when(hit, F.lit(now_ns)).otherwise(F.col("last_verified_ns")).cast("long").alias("last_verified_ns"),
    )


def oversized(status: Column, size: Column, limit: int) -> Column:
    return F.when(size > limit, int(Status.SKIPPED)).otherwise(status)


def io_error_status(error: Column) -> Column:
    return F.when(error == "ENOENT", int(Status.DELETED)).otherwise(int(Status.FAILED_TRANSIENT))


def live(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("status") != int(Status.DELETED))


def without(table: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def with_members(gone: DataFrame, manifest: DataFrame, depth: int = 3) -> DataFrame:
    """Ids that go with those that go: members of archives, down to `depth` levels."""
    out = level = gone.select("file_id").distinct()
    for _ in range(depth):
        level = manifest.join(level.withColumnRenamed("file_id", "parent_archive_id"), "parent_archive_id", "left_semi").select("file_id")
        out = out.unionByName(level)
    return out.distinct()


def missing_progress(manifest: DataFrame, progress: DataFrame, index_name: str, schema_ver: int) -> DataFrame:
    """Indexed files without a current entry of the ledger: what a crash left undone."""
    done = progress.where((F.col("index_name") == index_name) & (F.col("schema_ver") == schema_ver))
    return manifest.where(F.col("status") == int(Status.INDEXED)).select("file_id").join(done, "file_id", "left_anti")


def hard_links(files: DataFrame) -> DataFrame:
    """(file_id, hard_link_of): the least id with the same device and inode, null for that id itself and without an inode.

    A group's least id is pre-aggregated and joined back, so a group of any size is spread out.
    """
    first = files.where("inode is not null").groupBy("dev", "inode").agg(F.min("file_id").alias("first"))
    both = files.join(first, ["dev", "inode"], "left")
    return both.select("file_id", F.when(F.col("first") != F.col("file_id"), F.col("first")).alias("hard_link_of"))


def gaps(events: DataFrame, kind: str, at_us: Column, tie: str, hours: int = 1) -> DataFrame:
    """events with gap_us: the time since the event before of its kind, null for the first.

    Each kind is cut into hours, so that no kind, however frequent, is one group; what crosses an
    hour's edge comes from a table with one row for each kind and hour.
    """
    d = events.withColumn("at_us", at_us).withColumn("hour", F.floor(F.col("at_us") / (hours * 3_600_000_000)))
    ends = d.groupBy(kind, "hour").agg(F.max("at_us").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(Window.partitionBy(kind).orderBy("hour"))).select(F.col(kind).alias("kind_of"), F.col("hour").alias("hour_of"), "before")
    inside = F.lag("at_us").over(Window.partitionBy(kind, "hour").orderBy("at_us", tie))
    same = F.col(kind).eqNullSafe(F.col("kind_of")) & F.col("hour").eqNullSafe(F.col("hour_of"))
    return d.withColumn("inside", inside).join(before, same).select(*events.columns, (F.col("at_us") - F.coalesce("inside", "before")).alias("gap_us"))


def recent_runs(runs: DataFrame, keep: int = 1000) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(keep)


def staleness(last_ns: Column, now_ns: Column, threshold_s: int = 3600, warn_s: int = 7 * 86400) -> Column:
    """fresh under the threshold, stale from it on, warn from the second one on or if never; the future is fresh."""
    age = F.greatest(now_ns - last_ns, F.lit(0))
    return F.when(last_ns.isNull(), "warn").when(age < threshold_s * 10**9, "fresh").when(age < warn_s * 10**9, "stale").otherwise("warn")


def summary(manifest: DataFrame) -> DataFrame:
    """One row: files by state and bytes of the live ones."""
    is_ = lambda s: F.count_if(F.col("status") == int(s)).alias(s.name.lower())
    return manifest.agg(F.count(F.lit(1)).alias("total_files"), *(is_(s) for s in Status), F.sum(F.when(F.col("status") != int(Status.DELETED), F.col("size"))).alias("live_bytes"))


def duplicates(files: DataFrame, hash_col: str = "content_hash", min_size: int = 1) -> DataFrame:
    """(hash, size, copies, first_id, wasted_bytes) of contents held by more than one file; the files themselves join back by hash."""
    g = files.where(F.col("size") >= min_size).groupBy(hash_col, "size").agg(F.count(F.lit(1)).alias("copies"), F.min("file_id").alias("first_id"))
    return g.where("copies > 1").withColumn("wasted_bytes", (F.col("copies") - 1) * F.col("size"))


def corrupted(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """(file_id, stored, actual) where the content isn't what was stored; actual null: unreadable."""
    both = stored.select("file_id", F.col("content_hash").alias("stored")).join(actual.select("file_id", F.col("content_hash").alias("actual")), "file_id", "left")
    return both.where("stored is not null and (actual is null or stored <> actual)")


def hash_sample(files: DataFrame, fraction: float, key: str = "file_id") -> DataFrame:
    """A sample that is the same wherever it is taken: by the key's product with a constant, modulo a million (of the key's remainder: no overflow)."""
    return files.where(F.pmod(F.pmod(F.col(key), F.lit(1_000_000)) * 2654435761, F.lit(1_000_000)) < int(fraction * 1_000_000))


def matching(manifest: DataFrame, glob: str) -> DataFrame:
    return live(manifest).where(glob_match(F.col("path"), glob))


def error_report(manifest: DataFrame) -> DataFrame:
    """(prefix, n): failures by the tag in brackets that their message begins with."""
    return manifest.where("error_msg is not null").groupBy(F.regexp_extract("error_msg", r"^(\[[A-Z]+\])", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def archive_limits(members: DataFrame, max_total: int, max_members: int, max_ratio: int) -> DataFrame:
    """Adds `allowed` to (archive_id, ord, compressed, size): the members before an archive's limits are passed, unless their own ratio is too high."""
    w = Window.partitionBy("archive_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total, number = F.sum("size").over(w), F.row_number().over(Window.partitionBy("archive_id").orderBy("ord"))
    ratio = F.floor(F.col("size") / F.greatest(F.col("compressed"), F.lit(1))) > max_ratio
    return members.withColumn("allowed", (total <= max_total) & (number <= max_members) & ~ratio)


def estimates(manifest: DataFrame) -> DataFrame:
    """One row: bytes that an index and a walk of these files need, by the rules of thumb of 0.5 % of the data and 500 bytes a file."""
    return manifest.agg((F.sum("size") / 200).cast("long").alias("index_bytes"), (F.count(F.lit(1)) * 500).alias("walk_bytes"))


def still_as_walked(walked: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of the first walk whose size and time are the same in the second: what was read in between can be trusted."""
    return walked.join(again.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_semi")


def prioritized(work: DataFrame, terms: list[str]) -> DataFrame:
    """Work whose path holds a term of the query first, then by path."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.lower("path").contains(t.lower())
    return work.orderBy(hit.desc(), "path")


def orphans(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of a side table whose file isn't in the manifest any more."""
    return rows.join(manifest.select("file_id"), "file_id", "left_anti")


def tree_of_archives(manifest: DataFrame) -> DataFrame:
    """(parent_archive_id, members) of every archive that has any."""
    return manifest.where("parent_archive_id is not null").groupBy("parent_archive_id").agg(F.count(F.lit(1)).alias("members"))
