"""Splitting documents into chunks and assigning who may read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESTRICTED_LEVEL = "secret"


def split_documents(
    documents: DataFrame, size: int = 1000, overlap: int = 0, text: str = "text", order: str = "chunk_order"
) -> DataFrame:
    """One row per window of `size` characters, `overlap` of them shared with the next; the rest of the row kept.

    One regular-expression pass cuts the whole text, so the cost stays linear in its
    length; substring() per window would count characters from the start each time.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    windows = F.regexp_extract_all(
        F.col(text), F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)
    )
    # A last window that only repeats the overlap of the one before it is not a new chunk.
    fresh = F.filter(windows, lambda w, i: (i == 0) | (F.char_length(w) > overlap))
    kept = [c for c in documents.columns if c != text]
    return documents.select(*kept, F.posexplode(fresh).alias(order, "chunk_text")).withColumn(
        order, F.col(order).cast("int")
    )


def roles_for(security_level: Column) -> Column:
    return F.when(security_level == RESTRICTED_LEVEL, F.array(F.lit("risk_manager"))).otherwise(
        F.array(F.lit("analyst"), F.lit("risk_manager"))
    )
