"""Problem 5: top N items within every group, by secondary sort.

Rows are hash-partitioned by group, sorted within partitions by (group, score descending, identifier),
and streamed as Arrow batches that let the first N of each group pass. Nothing is buffered but the
identifiers emitted for the group at hand (at most N). The same pass runs once before the shuffle on the
unshuffled partitions, so of a group that holds a third of all rows each map task sends at most N rows.

Cases: rows with a null group, a null identifier, or a score that is null, not a number or outside the
range take no part. Equal scores come in order of identifier. A repeated identifier counts once, with its
highest score. Minus zero equals zero. Empty input gives no rows. Only the named columns are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_n(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, ids = None, 0, set()
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode()
            codes = code.indices.to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1), len(codes)]
            item = b.column(2).to_numpy(zero_copy_only=False)
            keep: list[int] = []
            for start, end in zip(cut[:-1], cut[1:]):
                name = code.dictionary[codes[start]].as_py()
                if name != group:
                    group, taken, ids = name, 0, set()
                at = start
                while taken < n and at < end:
                    if item[at] not in ids:
                        ids.add(item[at])
                        taken += 1
                        keep.append(at)
                    at += 1
            if keep:
                yield b.take(pa.array(keep, pa.int64()))

    return run


def top_n(df: DataFrame, group: Column, score: Column, item: Column, n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(grp string, score double, item bigint): the ``n`` highest-scoring items of each group."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(group.cast("string").alias("grp"), (score.cast("double") + F.lit(0.0)).alias("score"), item.cast("bigint").alias("item"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & ~F.isnan("score") & F.col("score").between(low, high))
    order = ["grp", F.desc("score"), "item"]
    schema = "grp string, score double, item bigint"
    local = rows.sortWithinPartitions(*order).mapInArrow(_first_n(n), schema)
    return local.repartition("grp").sortWithinPartitions(*order).mapInArrow(_first_n(n), schema)


def watch_target_form(c: Column) -> Column:
    """Watchlist name as a group: lower case, trimmed; null and blank are no group."""
    name = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name != "", name)
