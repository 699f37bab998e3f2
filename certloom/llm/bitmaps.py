"""Problem 4: distinct counts over huge identifier sets, by exact compressed bitmaps.

A store is a folder with three tables, all of them append-only:

1. ``settings``: the number of hash buckets, fixed when the store is made.
2. ``dictionary``: every identifier's dense integer within its hash bucket. Known identifiers keep their
   number, new ones of a later run continue behind the last one: numbers mean the same in all runs.
   Buckets are independent, so no task needs more than one of them and there is no global sort.
3. ``containers``: per (keys..., chunk of 32,768 integers) one bitmap, stored in the smallest of three forms:
   a list of 16-bit positions, a run list, or the plain bits.

Any union or intersection of groups, days or runs ORs or ANDs containers of equal bucket and chunk and counts
bits. ``merged`` containers are containers again: they are the mergeable partial results. The error is zero.

Cases: null and empty identifiers are not counted; null days and groups are groups of their own, named
null. Repeated identifiers count once, within a run and between runs. Empty tables give no rows, but the
grand total of nothing is 0. A run that is added again replaces itself. Only the named columns are read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.session import materialise, shared_path

#: Bits of one container, the size of Spark's own bitmap functions.
CHUNK = 32_768
#: Rows that one bucket is meant for where a store is made for a table of known size, and the fewest buckets.
ROWS_A_BUCKET, FEWEST_BUCKETS = 1 << 17, 16


def _pack(bits: bytes) -> bytes:
    """4,096 plain bytes to the smallest container: 'A' positions, 'R' runs, 'B' bits."""
    on = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")
    at = np.flatnonzero(on).astype(np.uint16)
    if not len(at):
        return b"A"
    starts = at[np.flatnonzero(np.diff(at, prepend=np.int32(-2)) != 1)]
    if 4 * len(starts) < min(2 * len(at), CHUNK // 8):
        ends = at[np.flatnonzero(np.diff(at, append=np.int32(CHUNK + 2)) != 1)]
        return b"R" + np.stack([starts, ends - starts], axis=1).astype("<u2").tobytes()
    if 2 * len(at) < CHUNK // 8:
        return b"A" + at.astype("<u2").tobytes()
    return b"B" + bytes(bits)


def _mark(box: bytes, on: np.ndarray) -> None:
    """ORs a container into ``on``, one byte a bit. Positions and runs are set as they are, without inflating."""
    kind, body = bytes(box[:1]), memoryview(box)[1:]
    if kind == b"A":
        on[np.frombuffer(body, "<u2")] = 1
    elif kind == b"B":
        np.bitwise_or(on, np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"), out=on)
    else:
        for start, more in np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64):
            on[start : start + more + 1] = 1


def _unpack(box: bytes) -> bytes:
    """Any container back to 4,096 plain bytes."""
    on = np.zeros(CHUNK, dtype=np.uint8)
    _mark(box, on)
    return np.packbits(on, bitorder="little").tobytes()


def _size(box: bytes) -> int:
    """Bits that are on."""
    kind, body = bytes(box[:1]), memoryview(box)[1:]
    if kind == b"A":
        return len(body) // 2
    if kind == b"B":
        return int(np.bitwise_count(np.frombuffer(body, np.uint8)).sum())
    return int(np.frombuffer(body, "<u2").reshape(-1, 2)[:, 1].astype(np.int64).sum()) + len(body) // 4


def _and(x: bytes, y: bytes) -> int:
    if x[:1] == b"A" == y[:1]:
        return len(np.intersect1d(np.frombuffer(x[1:], "<u2"), np.frombuffer(y[1:], "<u2"), assume_unique=True))
    if x[:1] == b"A" or y[:1] == b"A":  # positions of one looked up in the other
        few, other = (x, y) if x[:1] == b"A" else (y, x)
        on = np.zeros(CHUNK, dtype=np.uint8)
        _mark(other, on)
        return int(on[np.frombuffer(few[1:], "<u2")].sum())
    return int(np.bitwise_count(np.frombuffer(_unpack(x), np.uint8) & np.frombuffer(_unpack(y), np.uint8)).sum())


@F.pandas_udf(T.BinaryType())
def pack(bits: pd.Series) -> pd.Series:
    return bits.map(lambda b: None if b is None else _pack(b))


@F.pandas_udf(T.LongType())
def and_count(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_and(x, y) for x, y in zip(a, b)], dtype="int64")


def buckets_for(rows: int) -> int:
    """Buckets of a new store that is made for a table of so many rows."""
    return max(FEWEST_BUCKETS, -(-rows // ROWS_A_BUCKET))


class BitmapStore:
    """A folder of exact bitmaps. ``keys`` are the names of the grouping columns; a new store needs ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        if buckets is not None:
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/settings")
        self.buckets = spark.read.schema("buckets int").parquet(f"{path}/settings").first().buckets

    def _runs(self, table: str, schema: str) -> DataFrame:
        """All runs of a table; none is an empty table."""
        empty = self.spark.createDataFrame([], schema + ", run int")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema + ", run int").parquet(f"{self.path}/{table}") if there else empty

    def dictionary(self) -> DataFrame:
        """(item, bucket, pos, run)"""
        return self._runs("dictionary", "item string, bucket int, pos bigint")

    def containers(self, keys: dict[str, str] | None = None) -> DataFrame:
        """(keys..., bucket, chunk, box, run); ``keys``: types by name, read from the files if not given."""
        if keys is None:
            return self.spark.read.parquet(f"{self.path}/containers")
        return self._runs("containers", "".join(f"`{k}` {t}, " for k, t in keys.items()) + "bucket int, chunk int, box binary")

    def add(self, rows: DataFrame, item: Column, keys: dict[str, Column], run: int) -> None:
        """Adds the rows of one run: new identifiers to the dictionary, and its containers.

        One shuffle for distinct (keys, item), one by bucket, where new identifiers are numbered behind
        those of earlier runs, and one of plain numbers to build the containers.
        """
        names = list(keys)
        flat = rows.select(*(c.alias(k) for k, c in keys.items()), item.alias("item")).where("item is not null and item <> ''").distinct()
        bucket = F.pmod(F.xxhash64("item"), F.lit(self.buckets)).cast("int").alias("bucket")
        known = self.dictionary().where(F.col("run") < run).select("item", "bucket", "pos")
        nothing = [F.lit(None).cast(t).alias(k) for k, t in flat.dtypes if k in names]
        both = flat.select(*names, "item", bucket, F.lit(None).cast("bigint").alias("pos"), F.lit(True).alias("here"))
        both = both.unionByName(known.select(*nothing, "item", "bucket", "pos", F.lit(False).alias("here")))
        by = Window.partitionBy("bucket")
        told = both.withColumn("known", F.max("pos").over(Window.partitionBy("bucket", "item"))).withColumn("next", F.coalesce(F.max("pos").over(by) + 1, F.lit(0)))
        # known identifiers first, so that the rank of the others counts new ones only
        order = by.orderBy(F.col("known").isNull(), "item")
        rank = F.dense_rank().over(order) - F.sum(F.col("pos").isNotNull().cast("bigint")).over(by) - 1
        told = told.withColumn("rank", rank).where("here").withColumn("pos", F.coalesce("known", F.col("next") + F.col("rank")))
        first = F.row_number().over(Window.partitionBy("bucket", "item").orderBy(F.lit(0))) == 1
        numbered = materialise(told.select(*names, "bucket", "pos", F.when(F.col("known").isNull() & first, F.col("item")).alias("fresh")), "bitmaps")
        numbered.where("fresh is not null").select(F.col("fresh").alias("item"), "bucket", "pos").write.mode("overwrite").parquet(f"{self.path}/dictionary/run={run}")
        chunk, bit = F.floor(F.col("pos") / CHUNK).cast("int"), (F.col("pos") % CHUNK).cast("int")
        placed = numbered.select(*names, "bucket", chunk.alias("chunk"), bit.alias("bit")).repartition("bucket", "chunk")
        made = placed.groupBy(*names, "bucket", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
        made.select(*names, "bucket", "chunk", pack("bits").alias("box")).write.mode("overwrite").parquet(f"{self.path}/containers/run={run}")


def _or_groups(n_keys: int, names: list[str]):
    """ORs neighbouring containers of equal first ``n_keys`` columns, one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, now, only, count = np.zeros(CHUNK, np.uint8), None, None, 0

        def closed() -> tuple:
            box = only if count == 1 else _pack(np.packbits(on, bitorder="little").tobytes())
            return (*now, box, _size(box))

        schema = None
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(n_keys)]
            box, out = b.column(n_keys), []
            for i, own in enumerate(zip(*cols)):
                x = box[i].as_py()
                if own != now:
                    if now is not None:
                        out.append(closed())
                    if count > 1:
                        on[:] = 0
                    now, only, count = own, x, 0
                elif count == 1:
                    _mark(only, on)
                if count:
                    _mark(x, on)
                count += 1
            schema = pa.schema([*(pa.field(n, b.schema.field(k).type) for k, n in enumerate(names[:n_keys])), pa.field("box", pa.binary()), pa.field("n", pa.int64())])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(closed(), schema)], schema=schema)

    return run


def merged(boxes: DataFrame, keep: list[str]) -> DataFrame:
    """Containers (keep..., bucket, chunk, box) of the groups by ``keep`` alone, all else merged by OR, with their bits counted as ``n``."""
    names = [*keep, "bucket", "chunk"]
    types = dict(boxes.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in names) + "box binary, n bigint"
    # containers of one chunk only meet containers of the same chunk: sorted groups pass one at a time
    spread = boxes.select(*names, "box").repartition("bucket", "chunk", *keep).sortWithinPartitions(*names)
    return spread.mapInArrow(_or_groups(len(names), names), schema)


def union_counts(boxes: DataFrame, sets: list[list[str]], names: list[str]) -> DataFrame:
    """Exact distinct counts for each set of key names (the others are merged by OR and shown as null).

    ``grouping`` tells the set: the bit of each name from the left is 1 where it is merged away. Each set is
    rolled up from the smallest set before it that holds it, so the finest containers are read once.
    """
    types, done, out = dict(boxes.dtypes), [], None
    for keep in sorted(sets, key=len, reverse=True):
        source = min((d for d in done if set(keep) <= set(d[0])), key=lambda d: len(d[0]), default=(names, boxes))[1]
        own = materialise(merged(source, keep), "bitmaps")
        done.append((keep, own))
        gone = sum(1 << (len(names) - 1 - i) for i, k in enumerate(names) if k not in keep)
        one = own.groupBy(*keep).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))
        one = one.select(*(F.col(k) if k in keep else F.lit(None).cast(types[k]).alias(k) for k in names), F.lit(gone).alias("grouping"), "n_items")
        out = one if out is None else out.unionByName(one)
    return out


def intersection_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on..., n_items): exact sizes of intersections; containers of equal ``on`` and chunk are ANDed, bits counted.

    Null equals null in ``on``: such groups meet like any other. Each side has one container a group and chunk, as ``merged`` gives.
    """
    a = left.select(*on, "bucket", "chunk", F.col("box").alias("box_a"))
    b = right.select(*(F.col(k).alias(f"_{k}_b") for k in [*on, "bucket", "chunk"]), F.col("box").alias("box_b"))
    both = a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}_b")) for k in on] + [F.col(k) == F.col(f"_{k}_b") for k in ("bucket", "chunk")])
    return both.select(*on, and_count("box_a", "box_b").alias("n")).groupBy(*on).agg(F.sum("n").alias("n_items"))


def stored_containers(rows: DataFrame, item: Column, keys: dict[str, Column], buckets: int) -> DataFrame:
    """The containers of one table in a new store in the shared folder."""
    store = BitmapStore(rows.sparkSession, shared_path(rows.sparkSession, "bitmap-store"), buckets)
    store.add(rows, item, keys, 0)
    return store.containers({k: t for k, t in rows.select(*(c.alias(k) for k, c in keys.items())).dtypes}).drop("run")
