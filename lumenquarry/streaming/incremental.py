"""Files that arrive over time: each micro-batch is upserted once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumenquarry.schema import ExitCode, IndexError_
from lumenquarry.sources.catalog import Catalog


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row of greatest version; a row count of one per key and partition is kept before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_stream(spark: SparkSession, arrivals: DataFrame, catalog: Catalog, table: str, schema: StructType, key: str, version: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Apply a stream of rows to a table of the catalog, the newest version of a key winning; all that is there now, then stop.

    The number of the last batch is committed with the table: a batch that comes again after a
    failure finds its number and changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        name = f"batch:{table}"
        if catalog.state()["values"].get(name, -1) >= number:
            return
        if not catalog.lock(30):
            raise IndexError_("another writer holds the lock", ExitCode.OTHER)
        try:
            merged = latest(catalog.table(table, schema).unionByName(batch.select(*schema.names)), key, version)
            catalog.commit({table: merged}, {name: number})
            if then:
                then(batch, number)
        finally:
            catalog.unlock()

    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
