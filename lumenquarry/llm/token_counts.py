"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumenquarry.llm.common import id_and_text, lean, slices
from lumenquarry.llm.tokenizer import default_encoding, encode_batch

#: Bytes of text that one batch of encoding holds at most (a longer text is a batch of its own, cut at safe places).
BATCH_BYTES = 1 << 20


@lean
def _lengths(batches: Iterator[pa.RecordBatch], limit: int, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    enc = default_encoding()
    for whole in batches:
        for batch in slices(whole, batch_bytes):
            ids = encode_batch(enc, batch.column("text").to_pylist())
            counts = np.fromiter((sum(map(len, parts)) for parts in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(batch.column("text")).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def token_counts(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Narrow: no shuffle, one pass over the scan's partitions; only lengths leave Python. Batches are
    balanced by bytes, and a long text is encoded in parts that end where a token must end.
    The special string of the vocabulary counts as one token wherever it stands.
    Null or empty text: 0 bytes and 0 tokens. Null ids stay. Repeated rows give repeated rows. An
    empty table gives an empty table; further columns are not read.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: _lengths(it, limit, batch_bytes), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
