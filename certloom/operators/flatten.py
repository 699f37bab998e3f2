"""Problem 7: nested records to related flat tables, by Arrow buffers.

A list column is an array of values and an array of offsets. Children are emitted by flattening the
values, parents by the kernel that expands offsets to parent indices, and keys are carried by a vectorised
take. No row is parsed; lists of any length pass, as an Arrow batch is all that is held.

Cases: null elements give no row but keep their place, so positions are those of the original array. Null
and empty lists have no children. ``positions`` gives a parent without non-null children one row. Repeated
rows are flattened each. Empty tables give no rows. Only the named columns are read, so other columns may
have any name.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def children(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(parent index, position, value) of every non-null element of a list array."""
    values = pc.list_flatten(lists)
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    pos = np.arange(len(parent)) - np.searchsorted(parent, parent, side="left")
    there = values.is_valid().to_numpy(zero_copy_only=False)
    return parent[there], pos[there], values.filter(pa.array(there))


def _take(keys: pa.Array, at: np.ndarray) -> pa.Array:
    return keys.take(pa.array(at, pa.int64()))


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32), pa.int32())


def _flat(names: list[str], fields: list[str | None]):
    """Batches of (key, list) to (key, pos, fields of the element); None is the element itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, pos, value = children(b.column(1))
            cols = [value if f is None else pc.struct_field(value, f) for f in fields]
            yield pa.RecordBatch.from_arrays([_take(b.column(0), parent), _int(pos), *cols], names=names)

    return run


def _flat_twice(names: list[str], inner: str, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, pos, value = children(b.column(1))
            child, leaf, low = children(pc.struct_field(value, inner))
            cols = [pc.struct_field(low, f) for f in fields]
            yield pa.RecordBatch.from_arrays([_take(b.column(0), parent[child]), _int(pos[child]), _int(leaf), *cols], names=names)

    return run


def message_hosts(messages: DataFrame) -> DataFrame:
    """(msg_id, host_pos, host): ``data.leaf_cert.all_domains`` of the rows that have ``data``."""
    rows = messages.where("data is not null").select("msg_id", "data.leaf_cert.all_domains")
    return rows.mapInArrow(_flat(["msg_id", "host_pos", "host"], [None]), "msg_id bigint, host_pos int, host string")


def finding_verdicts(findings: DataFrame) -> DataFrame:
    """(finding_id, verdict_pos, domain, matched_watch_target, score)."""
    names = ["finding_id", "verdict_pos", "domain", "matched_watch_target", "score"]
    return findings.select("finding_id", "verdicts").mapInArrow(_flat(names, names[2:]), "finding_id bigint, verdict_pos int, domain string, matched_watch_target string, score double")


def verdict_reasons(findings: DataFrame) -> DataFrame:
    """(finding_id, verdict_pos, reason_pos, family, rule, points)."""
    names = ["finding_id", "verdict_pos", "reason_pos", "family", "rule", "points"]
    return findings.select("finding_id", "verdicts").mapInArrow(_flat_twice(names, "reasons", names[3:]), "finding_id bigint, verdict_pos int, reason_pos int, family string, rule string, points int")


_PLACES = "parent_id bigint, child_pos int, leaf_pos int"


def _places(inner: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            parent, pos, value = children(b.column(1))
            leaf = np.full(len(parent), -1)
            bare = np.bincount(parent, minlength=n) == 0
            if inner is not None:
                child, place, _ = children(pc.struct_field(value, inner))
                empty = np.flatnonzero(np.bincount(child, minlength=len(parent)) == 0)
                parent, pos = np.concatenate([parent[child], parent[empty]]), np.concatenate([pos[child], pos[empty]])
                leaf = np.concatenate([place, np.full(len(empty), -1)])
            none = np.flatnonzero(bare)
            minus = np.full(len(none), -1)
            cols = [_take(b.column(0), np.concatenate([parent, none])), _int(np.concatenate([pos, minus])), _int(np.concatenate([leaf, minus]))]
            yield pa.RecordBatch.from_arrays(cols, names=["parent_id", "child_pos", "leaf_pos"])

    return run


def positions(messages: DataFrame, findings: DataFrame) -> DataFrame:
    """(parent_table, parent_id, child_pos, leaf_pos) of every lowest child of both tables."""
    m = messages.where("data is not null").select("msg_id", "data.leaf_cert.all_domains").mapInArrow(_places(None), _PLACES)
    f = findings.select("finding_id", "verdicts").mapInArrow(_places("reasons"), _PLACES)
    named = lambda df, t: df.select(F.lit(t).alias("parent_table"), "parent_id", "child_pos", "leaf_pos")
    return named(m, "raw_messages").unionByName(named(f, "findings"))
