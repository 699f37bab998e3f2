"""Problem 6: messages delivered more than once, by a keyed state store of seen identifiers.

A Structured Streaming query answers every delivery: it is kept, or a copy of a kept message. Its state
store remembers, in buckets of keys, the kept identifier and delivery time of each key (on local disk in
RocksDB, with change logs in the checkpoint, so state may outgrow memory), and lets a key expire when the
event-time watermark has passed its delivery by ``RETENTION``. Offsets, state and output files are committed
together by the query's checkpoint and the file sink's log, so a restart neither loses nor repeats an answer.

Before the shuffle each Arrow batch folds the copies it holds to one row a key; their pairs pass by the
state in buckets of their own. Of a key that holds a third of all rows the store sees one row a batch.

A bucket's function decides for all its rows at once by sorting them with the remembered keys. Deliveries
that are later than the watermark and unknown to the store are marked late. Only those, and keys kept again
after they had expired, are answered by the late-arrival lookup in the history of kept messages. A key kept
twice although it had not expired means that state was lost: the lookup raises.

The watermark runs on ``clock``, the delivery time moved by ``SHIFT``, and its delay is ``SHIFT`` too: it
equals the latest delivery time, but the engine never takes a row for late and drops it unanswered.

Cases: only ``certificate_update`` rows take part. Null fields of the key equal only null. Serials and
fingerprints compare as hexadecimal numbers; keys by 128 bits of hash. A repeated msg_id counts once. Rows
without a delivery time count as delivered at the epoch. Empty tables give no rows. Only the named columns are read.
"""

import posixpath
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from certloom.functions.text import hex_form
from certloom.session import shared_path

#: How long a key is remembered after the delivery that was kept.
RETENTION = "10 days"
SHIFT = "36500 days"
FILES_A_TRIGGER = 8
#: A bucket holds about so many keys; the number of buckets is fixed for the life of a checkpoint.
KEYS_A_BUCKET = 512
FEWEST_BUCKETS = 16
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

_KEYED = "a bigint, b bigint, msg_id bigint, at timestamp"
_FOLDED = _KEYED + ", rep bigint"
_STATE = "a binary, b binary, first binary, at binary"
#: ``first`` is the kept message that ``msg_id`` is a copy of; of folded copies the one they were folded into.
_ANSWERED = "kind int, a bigint, b bigint, first bigint, msg_id bigint, at bigint, mark bigint"
KEPT, COPY, FOLDED, LATE = range(4)


def message_keys(messages: DataFrame) -> DataFrame:
    """(a, b, msg_id, at): two hashes of the four identifying fields, each told apart from null."""
    leaf = F.col("data.leaf_cert")
    fields = [hex_form(leaf["serial_number"]), hex_form(leaf["fingerprint"]), F.col("data.cert_index").cast("string"), F.col("data.update_type")]
    text = F.to_json(F.array(*fields))
    return messages.where("message_type = 'certificate_update' and msg_id is not null").select(
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.col("msg_id").cast("bigint"), F.coalesce("delivered_at", F.timestamp_seconds(F.lit(0))).alias("at")
    )


def _heads(*sorted_columns: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the copies within one batch the one with the smallest identifier stands for all; the others name it in ``rep``.

    The one that stands for all has their latest time; a repeated identifier leaves one row.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        times = batch.column(3).cast(pa.int64()).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, b, a))
        a, b, ids, times = a[order], b[order], ids[order], times[order]
        once = _heads(a, b, ids)
        head = _heads(a, b)
        lead = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
        times[head] = np.maximum.reduceat(times, np.flatnonzero(head))
        cols = [pa.array(a), pa.array(b), pa.array(ids), pa.array(times).cast(batch.column(3).type), pa.array(ids[lead])]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "msg_id", "at", "rep"]).filter(pa.array(once))


def _decide(retention_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = [np.frombuffer(x, np.int64) for x in state.get] if state.exists else [np.zeros(0, np.int64)] * 4
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            folded = rows[rows.rep != rows.msg_id]
            if len(folded):
                yield pd.DataFrame({"kind": FOLDED, "a": folded.a, "b": folded.b, "first": folded.rep, "msg_id": folded.msg_id, "at": folded["ms"], "mark": mark})
            rows = rows[rows.rep == rows.msg_id]
            if len(rows):
                held, answers = _answer(held, *(rows[c].to_numpy(np.int64) for c in ("a", "b", "msg_id", "ms")), mark, retention_ms)
                yield answers
        live = held[3] + retention_ms > mark
        if live.any():
            held = [x[live] for x in held]
            state.update(tuple(np.ascontiguousarray(x).tobytes() for x in held))
            state.setTimeoutTimestamp(int(held[3].min()) + retention_ms)
        elif state.exists:
            state.remove()

    return run


def _answer(held: list[np.ndarray], a: np.ndarray, b: np.ndarray, ids: np.ndarray, ms: np.ndarray, mark: int, retention_ms: int) -> tuple[list[np.ndarray], pd.DataFrame]:
    """Remembered keys come first in their group, then deliveries in time, then late ones; the first one leads."""
    n = len(held[0])
    a, b, ids, ms = np.concatenate([held[0], a]), np.concatenate([held[1], b]), np.concatenate([held[2], ids]), np.concatenate([held[3], ms])
    late = 2 * (ms + retention_ms <= mark) + 1
    late[:n] = 0
    order = np.lexsort((ids, late, b, a))
    a, b, ids, ms, late, old = a[order], b[order], ids[order], ms[order], late[order], order < n
    head = _heads(a, b)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    known = late[lead] < 3
    kind = np.where(~known, LATE, np.where(head, KEPT, COPY))
    new = ~old
    answers = pd.DataFrame({"kind": kind[new], "a": a[new], "b": b[new], "first": ids[lead][new], "msg_id": ids[new], "at": ms[new], "mark": mark})
    leads = head & known
    return [x[leads] for x in (a, b, ids, ms)], answers[(answers["first"] != answers["msg_id"]) | (answers["kind"] != COPY)]


def answered(stream: DataFrame, buckets: int, retention: str = RETENTION) -> DataFrame:
    """The stateful plan: a stream of messages to the stream of answers."""
    folded = message_keys(stream).mapInArrow(_fold, _FOLDED)
    bucket = F.pmod(F.xxhash64(F.when(F.col("rep") == F.col("msg_id"), F.col("a")).otherwise(F.col("msg_id"))), F.lit(buckets))
    timed = folded.select(bucket.alias("bucket"), "a", "b", "msg_id", "rep", F.unix_millis("at").alias("ms"), (F.col("at") + F.expr(f"interval {SHIFT}")).alias("clock"))
    retention_ms = int(pd.Timedelta(retention).total_seconds() * 1000)
    return timed.withWatermark("clock", SHIFT).groupBy("bucket").applyInPandasWithState(_decide(retention_ms), _ANSWERED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def run_to_end(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, buckets: int, retention: str = RETENTION, files: int = FILES_A_TRIGGER) -> DataFrame:
    """Answers all files that are there now; run again with the same folders it goes on where it ended. Returns all answers so far."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    folder, name = posixpath.split(path.rstrip("/"))
    if _is_file(spark, path):  # the stream source takes folders only
        source, path = source.option("pathGlobFilter", name), folder
    was = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        plan = answered(source.parquet(path), buckets, retention)
        query = plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(_ANSWERED).parquet(out)


def late_arrivals(answers: DataFrame, retention: str = RETENTION) -> DataFrame:
    """(msg_id, first): late deliveries, and messages kept again after their key had expired, looked up in the history of kept ones.

    A key of which every delivery was late has its smallest identifier as the first. Of the kept messages
    only keys and identifiers cross the shuffle.
    """
    by = Window.partitionBy("a", "b")
    rows = answers.where(F.col("kind").isin(KEPT, LATE))
    expired = F.lag(F.when(F.col("kind") == KEPT, F.col("at"))).over(by.orderBy("kind", "mark", "msg_id")) + int(pd.Timedelta(retention).total_seconds() * 1000)
    lost = (F.col("kind") == KEPT) & (F.col("mark") < expired)
    checked = F.when(lost, F.raise_error(F.lit("the state store lost a key that had not expired"))).otherwise(F.min(F.struct("kind", "msg_id")).over(by)["msg_id"])
    return rows.select("msg_id", checked.alias("first")).where("first <> msg_id")


def copies(answers: DataFrame, retention: str = RETENTION) -> DataFrame:
    """(kept_id, copy_id) of all answers: the kept one is the smallest identifier of its key.

    Kept messages that have no copy take part only in the late-arrival lookup.
    """
    late = late_arrivals(answers, retention)
    moved = late.select(F.col("msg_id").alias("first"), F.col("first").alias("root"))
    told = answers.where(F.col("kind") == COPY).select("first", "msg_id").join(moved, "first", "left").select("msg_id", F.coalesce("root", "first").alias("first"))
    told = told.unionByName(late)
    reps = told.select(F.col("msg_id").alias("rep"), F.col("first").alias("root"))
    folded = answers.where(F.col("kind") == FOLDED).select(F.col("first").alias("rep"), "msg_id").join(reps, "rep", "left").select("msg_id", F.coalesce("root", "rep").alias("first"))
    every = told.unionByName(folded)
    # where a smaller identifier came later, it is the kept one, and the first is a copy of it
    smaller = every.where("msg_id < first").groupBy("first").agg(F.min("msg_id").alias("root"))
    pairs = every.join(smaller, "first", "left").select(F.coalesce("root", "first").alias("kept_id"), F.col("msg_id").alias("copy_id"))
    pairs = pairs.unionByName(smaller.select(F.col("root").alias("kept_id"), F.col("first").alias("copy_id")))
    return pairs.where("kept_id <> copy_id").distinct()


def buckets_for(rows: int) -> int:
    """Buckets for so many keys alive at once."""
    return max(FEWEST_BUCKETS, -(-rows // KEYS_A_BUCKET))


def _answers_of(spark: SparkSession, path: str, retention: str, files: int) -> DataFrame:
    table, out = spark.read.parquet(path), shared_path(spark, "dedupe")
    return run_to_end(spark, path, table.schema, f"{out}/answers", f"{out}/checkpoint", buckets_for(table.count()), retention, files)


def copies_of(spark: SparkSession, path: str, retention: str = RETENTION, files: int = FILES_A_TRIGGER) -> DataFrame:
    """Runs the stream over the table at ``path`` and returns all (kept_id, copy_id)."""
    return copies(_answers_of(spark, path, retention, files), retention)


def deduplicated(spark: SparkSession, path: str, retention: str = RETENTION, files: int = FILES_A_TRIGGER) -> DataFrame:
    """The certificate messages of the table at ``path`` with all their columns, each once: copies are taken out by their identifiers."""
    gone = copies_of(spark, path, retention, files).select(F.col("copy_id").alias("msg_id"))
    rows = spark.read.parquet(path).where("message_type = 'certificate_update' and msg_id is not null")
    return rows.join(gone, "msg_id", "left_anti").dropDuplicates(["msg_id"])
