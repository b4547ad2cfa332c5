"""Joins with keys of any number of rows, cut into blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed

#: Rows of a key in a block, about.
BLOCK = 1024


def meet(left: DataFrame, rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """left joined by key with rows, whose keys may have any number of rows.

    The rows of a key are spread over blocks by a hash of the row; a row of left is sent to each block of its key. So what comes out of one
    row of left is spread over tasks, and what is sent more than once is a small part of what comes out. Columns besides the key must differ.
    """
    rows = checkpointed(rows)
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    placed = rows.join(sizes, key).withColumn("_k", F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in rows.columns)}), _n)")).drop("_n")
    sent = left.join(sizes, key).withColumn("_k", F.explode(F.expr("sequence(0L, _n - 1)"))).drop("_n")
    return sent.join(placed, [key, "_k"]).drop("_k")
