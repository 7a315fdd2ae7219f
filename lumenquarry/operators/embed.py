"""Vectors of texts by a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lumenquarry.workers import find_package

#: Texts in, a vector for each out.
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def embedded(texts: DataFrame, load: Callable[[], Embedder], keys: tuple[str, ...] = ("file_id", "chunk_ord"), text: str = "text", batch: int = 64) -> DataFrame:
    """(keys, v): the vector that a model gives each text; rows never move.

    load() runs once a task, on the executor, and gives the model, which then sees up to `batch` texts
    at a time. A null text is the empty text; repeated rows each get their vector; an empty table loads
    no model; other columns don't come along. A model that gives a wrong number of vectors ends the job.
    """
    find_package(texts.sparkSession)
    rows = texts.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("v"))
    schema = StructType([rows.schema[k] for k in keys] + [StructField("v", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            for start in range(0, b.num_rows, batch):
                part = b.slice(start, batch)
                model = model or load()
                found = [None if v is None else [float(x) for x in v] for v in model(part.column("v").to_pylist())]
                if len(found) != part.num_rows:
                    raise ValueError(f"the model gave {len(found)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(found, pa.list_(pa.float64()))], [*keys, "v"])

    return rows.mapInArrow(run, schema)
