"""Token counts: batches of about equal bytes go through the tokenizer inside Arrow functions, only lengths come back.

Long texts are cut at the safe boundaries `pieces` describes, so no text is encoded at a stroke
unless its white space forbids it. Null text counts as empty: 0 bytes, 0 tokens. Repeated rows
give repeated rows. Columns beyond the id and the text are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from credence.llm.pieces import TokenBook, load_tokenizer
from credence.llm.textkit import slices_by_bytes, text_bytes


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = TokenBook(load_tokenizer(tokenizer_path), keeps_spaces=True, with_ids=False)
        for batch in slices_by_bytes(batches, "text"):
            data, bounds = text_bytes(batch.column(1))
            tokens = book.counts(data, bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(bounds[1:] - bounds[:-1], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(tokens > limit, pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
