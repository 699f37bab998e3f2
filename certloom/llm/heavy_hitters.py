"""Problem 3: the most frequent items among billions, by a hierarchical count-sketch.

Every key is a 64-bit hash. For a ladder of prefix lengths of that hash a count-sketch (signed counters,
``ROWS`` independent rows, median estimate) counts how often each prefix occurs; the shortest prefix has
one exact counter each. Tasks sketch their rows in fixed memory, partial sketches are added up by block,
and the merged sketch - a constant number of bytes - is read by the driver, which descends from heavy
prefixes to heavy longer ones. A second scan counts the surviving keys exactly. If the exact counts show
that the cut was too high to be sure of the wanted items, the descent is repeated with a lower cut.

Where counts are so even that many prefixes survive, the descent runs in slices of the key space: each gives
at most about ``CANDIDATES`` prefixes to one exact scan, and the counts found so far raise the cut of the
next slices. More scans, but never more memory.

The estimates only choose what is counted; that nothing is missing is proved. No value that the second scan
left out can occur more often than its shortest prefix has rows left when the values counted below it are
taken off. Where that is less than the k-th count, the prefix is settled. Below the others longer prefixes
(``PROOF_BITS``) are counted exactly, and below those that are still open, every value is.

Cases: null and empty values are no items. Equal counts: the smaller string first. Fewer different items
than wanted: all of them. Empty tables give no rows. Repeated rows count each time.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from certloom.llm.mixing64 import mix, reduce_to
from certloom.session import materialise

#: Prefix lengths in bits; the first has exact counters.
LADDER = (12, 16, 20, 24, 28, 32)
WIDTH = 8192
ROWS = 5
#: More candidates than this go to the second scan by a join instead of a literal set.
LITERALS = 2000
#: Candidates of one exact scan, about.
CANDIDATES = 1 << 20
#: Prefix length of the proof that no item is missing: at most 2^20 counts a field.
PROOF_BITS = 20
#: So many largest counters of a row, those of heavy prefixes, are no noise.
HEAVY_COUNTERS = 64

_U = np.uint64


def _prefix(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> _U(64 - bits)


def _places(prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    z = mix(prefix, 1000 * (level + 1) + row)
    return reduce_to(z, WIDTH).astype(np.int64), np.where(z & _U(1), 1, -1)


def _new_sketch() -> dict[tuple[int, int], np.ndarray]:
    tables = {(0, 0): np.zeros(1 << LADDER[0], dtype=np.int64)}
    return tables | {(k, r): np.zeros(WIDTH, dtype=np.int64) for k in range(1, len(LADDER)) for r in range(ROWS)}


def _add(sketch: dict, h: np.ndarray, n: np.ndarray) -> None:
    sketch[0, 0] += np.bincount(_prefix(h, LADDER[0]).astype(np.int64), n, minlength=1 << LADDER[0]).astype(np.int64)
    for level in range(1, len(LADDER)):
        p = _prefix(h, LADDER[level])
        for row in range(ROWS):
            at, sign = _places(p, level, row)
            sketch[level, row] += np.bincount(at, sign * n, minlength=WIDTH).astype(np.int64)


_BLOCK = "field int, level int, row int, cells binary"


def _blocks(sketches: dict) -> Iterator[pa.RecordBatch]:
    rows = [(f, lv, r, t.tobytes()) for f, s in sorted(sketches.items()) for (lv, r), t in s.items() if t.any()]
    if rows:
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["field", "level", "row", "cells"])


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketches: dict[int, dict] = {}
    for b in batches:
        fields, hashes = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        for f in np.unique(fields):
            h, n = np.unique(hashes[fields == f].astype(np.int64).view(np.uint64), return_counts=True)
            _add(sketches.setdefault(int(f), _new_sketch()), h, n)
    yield from _blocks(sketches)


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, dict] = {}
    for b in batches:
        for f, lv, r, cells in zip(*(c.to_pylist() for c in b.columns)):
            tables = total.setdefault(f, {})
            add = np.frombuffer(cells, dtype=np.int64)
            tables[lv, r] = tables[lv, r] + add if (lv, r) in tables else add
    yield from _blocks(total)


class Sketch:
    """The merged sketch of one field on the driver: a fixed number of counters, whatever the data."""

    def __init__(self, tables: dict[tuple[int, int], np.ndarray]):
        self.tables = _new_sketch() | tables
        self.total = int(self.tables[0, 0].sum())
        self._noise: dict[int, float] = {}

    def estimate(self, prefix: np.ndarray, level: int) -> np.ndarray:
        if level == 0:
            return self.tables[0, 0][prefix.astype(np.int64)]
        each = []
        for row in range(ROWS):
            at, sign = _places(prefix, level, row)
            each.append(self.tables[level, row][at] * sign)
        return np.median(each, axis=0)

    def noise(self, level: int) -> float:
        """Typical error of an estimate: the median row's root mean square over its counters, the largest left out.

        Unlike their median it is not 0 where most counters are empty.
        """
        if level == 0:
            return 0.0
        if level not in self._noise:
            self._noise[level] = self._noise_of(level)
        return self._noise[level]

    def _noise_of(self, level: int) -> float:
        rows = [np.sort(np.abs(self.tables[level, r]))[:-HEAVY_COUNTERS].astype(np.float64) for r in range(ROWS)]
        return float(np.median([np.sqrt(np.mean(x * x)) for x in rows]))

    def first(self, cut: float) -> np.ndarray:
        """The shortest prefixes that can hold an item of ``cut`` rows, the fullest last."""
        count = self.tables[0, 0]
        some = np.flatnonzero(count >= max(cut, 1))
        return some[np.argsort(count[some], kind="stable")].astype(np.uint64)

    def _longer(self, prefix: np.ndarray, level: int, cut: float) -> np.ndarray:
        """The prefixes of ``level`` below the given ones whose estimates, with four times the noise, reach ``cut``."""
        step = LADDER[level] - LADDER[level - 1]
        out = [np.zeros(0, np.uint64)]
        for start in range(0, len(prefix), max(CANDIDATES >> step, 1)):
            some = prefix[start : start + max(CANDIDATES >> step, 1)]
            some = ((some[:, None] << _U(step)) | np.arange(1 << step, dtype=np.uint64)).ravel()
            out.append(some[self.estimate(some, level) + 4 * self.noise(level) >= cut])
        return np.concatenate(out)

    def descend(self, cut: float, first: np.ndarray) -> tuple[int, np.ndarray] | None:
        """(level, prefixes) that survive below the shortest prefixes ``first``; None if they are more than a scan takes and can be split.

        The descent ends where the noise alone reaches the cut: from there on no estimate could turn a prefix
        away, and the exact scan counts what is below. A level that does not halve the key space left is not
        returned: it would only make more prefixes of the same values.
        """
        cut = max(cut, 1)
        prefix, kept = first, (0, first)
        for level in range(1, len(LADDER)):
            if 4 * self.noise(level) >= cut:
                break
            prefix = self._longer(prefix, level, cut)
            if len(prefix) > CANDIDATES and len(first) > 1:
                return None
            if 2 * len(prefix) <= len(kept[1]) << (LADDER[level] - LADDER[kept[0]]):
                kept = level, prefix
        return kept

    def slices(self, cut: Callable[[], float]) -> Iterator[tuple[int, np.ndarray]]:
        """The survivors of the whole key space, a scan's worth at a time; ``cut`` is asked again for each slice."""
        todo = [self.first(cut())]
        while todo:
            first = todo.pop()
            first = first[self.tables[0, 0][first.astype(np.int64)] >= max(cut(), 1)]
            got = self.descend(cut(), first)
            if got is None:
                todo += [first[: len(first) // 2], first[len(first) // 2 :]]
            elif len(got[1]):
                yield got

    def first_cut(self, k: int) -> float:
        """A cut below the k-th largest count: halved from the largest prefix until k survivors lie clearly above it."""
        cut = float(self.tables[0, 0].max())
        while cut > 1:
            got = self.descend(cut, self.first(cut))
            if got is None:
                return cut
            est = self.estimate(got[1], got[0])
            if len(est) >= k and np.sort(est)[-k] >= cut:
                return cut
            cut /= 2
        return 1.0


def build_sketches(items: DataFrame) -> dict[int, Sketch]:
    """``items``: (field int, h bigint). One merged sketch a field."""
    parts = items.mapInArrow(_sketch_rows, _BLOCK)
    merged = parts.repartition("field", "level", "row").mapInArrow(_merge_blocks, _BLOCK)
    tables: dict[int, dict] = {}
    for f, lv, r, cells in merged.collect():  # 26 blocks a field of 64 KB at most
        tables.setdefault(f, {})[lv, r] = np.frombuffer(bytes(cells), dtype=np.int64)
    return {f: Sketch(t) for f, t in tables.items()}


def _below(items: DataFrame, wanted: dict[int, tuple[int, np.ndarray]], inside: bool = True) -> DataFrame:
    """The rows whose hash prefix is a candidate of their field, or, if not ``inside``, all others."""
    spark = items.sparkSession
    if inside:
        items = items.where(F.col("field").isin(list(wanted)))
    prefix = F.lit(None).cast("bigint")
    for f, (level, _) in wanted.items():
        prefix = F.when(F.col("field") == f, F.shiftrightunsigned("h", 64 - LADDER[level])).otherwise(prefix)
    if sum(len(ps) for _, ps in wanted.values()) <= LITERALS:
        hit = F.lit(False)
        for f, (_, ps) in wanted.items():
            hit = hit | ((F.col("field") == f) & F.coalesce(prefix.isin([int(p) for p in ps]), F.lit(False)))
        return items.where(hit if inside else ~hit)
    # some CANDIDATES rows a field at most
    pairs = pa.table({"field": pa.array(np.concatenate([np.full(len(ps), f) for f, (_, ps) in wanted.items()]), pa.int32()), "prefix": pa.array(np.concatenate([ps.astype(np.int64) for _, ps in wanted.values()]))})
    return items.withColumn("prefix", prefix).join(spark.createDataFrame(pairs), ["field", "prefix"], "left_semi" if inside else "left_anti").drop("prefix")


def _exact(rows: DataFrame) -> DataFrame:
    """Exact counts of all values of the rows."""
    return rows.groupBy("field", "value").agg(F.count("*").alias("n"), F.first("h").alias("h"))


def _first(exact: DataFrame, k: dict[int, int]) -> dict[int, list]:
    """The k most frequent values of each field, in order."""
    by_count = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    top = exact.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= max(k.values())).collect()
    return {f: sorted((r for r in top if r.field == f and r["rank"] <= n), key=lambda r: r["rank"]) for f, n in k.items()}


def _open_prefixes(sketches: dict[int, Sketch], exact: DataFrame, bars: dict[int, int]) -> dict[int, tuple[int, np.ndarray]]:
    """Shortest prefixes below which at least ``bars`` rows of a field are not counted yet: a value may be missing there."""
    left = {f: sketches[f].tables[0, 0].copy() for f in bars}
    by = exact.where(F.col("field").isin(list(bars))).groupBy("field", F.shiftrightunsigned("h", 64 - LADDER[0]).alias("p"))
    for r in by.agg(F.sum("n").alias("n")).collect():  # 2^12 rows a field at most
        left[r.field][r.p] -= r.n
    return {f: (0, np.flatnonzero(x >= bars[f]).astype(np.uint64)) for f, x in left.items() if (x >= bars[f]).any()}


def _missing(rows: DataFrame, counted: list[dict[int, tuple[int, np.ndarray]]], still_open: dict[int, tuple[int, np.ndarray]], bars: dict[int, int]) -> DataFrame:
    """Exact counts of the values not counted yet that can reach ``bars``: all below open prefixes of ``PROOF_BITS``."""
    rest = _below(rows, still_open)
    for wanted in counted:
        rest = _below(rest, wanted, inside=False)
    # field and prefix in one number: the broadcast table, 2^20 rows a field at most, is one of plain longs
    place = F.shiftleft(F.col("field").cast("bigint"), PROOF_BITS).bitwiseOR(F.shiftrightunsigned("h", 64 - PROOF_BITS))
    rest = rest.withColumn("place", place)
    bar = F.lit(None).cast("bigint")
    for f in still_open:
        bar = F.when(F.shiftright("place", PROOF_BITS) == f, bars[f]).otherwise(bar)
    places = rest.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") >= bar).select("place")
    return _exact(rest.join(F.broadcast(places), "place", "left_semi"))


def most_frequent(items: DataFrame, k: dict[int, int]) -> DataFrame:
    """``items``: (field int, value string), nulls and empty values meaning no item.

    ``k``: how many items are wanted of each field. Returns (field, value, n_exact, n_estimated, rank).
    """
    spark = items.sparkSession
    rows = items.where("value is not null and value <> ''").withColumn("h", F.xxhash64("value"))
    sketches = build_sketches(rows.select("field", "h"))
    open_cuts = {f: sketches[f].first_cut(n) for f, n in k.items() if f in sketches and n > 0}
    out: list[tuple] = []
    while open_cuts:
        wanted_k = {f: k[f] for f in open_cuts}
        bars = dict(open_cuts)  # raised to the k-th count as soon as k items of that many rows are counted
        slices = {f: sketches[f].slices(lambda f=f: bars[f]) for f in open_cuts}
        counted, exact, top = [], None, {f: [] for f in open_cuts}
        while wanted := {f: one for f, rest in slices.items() if (one := next(rest, None)) is not None}:
            some = materialise(_exact(_below(rows, wanted)), "counts")
            counted.append(wanted)
            exact = some if exact is None else exact.unionByName(some)
            for f, found in _first(some, wanted_k).items():
                top[f] = sorted([*top[f], *found], key=lambda r: (-r.n, r.value))[: k[f]]
                if len(top[f]) == k[f]:
                    bars[f] = max(bars[f], top[f][-1].n)
        again: dict[int, float] = {}
        for f, cut in open_cuts.items():
            if cut > 1 and (len(top[f]) < k[f] or top[f][-1].n < cut):
                again[f] = float(top[f][-1].n) if len(top[f]) == k[f] else max(1.0, cut / 2)
        sure = {f: top[f][-1].n if len(top[f]) == k[f] else 1 for f in open_cuts if f not in again}
        if sure and exact is not None and (still_open := _open_prefixes(sketches, exact, sure)):
            top |= _first(exact.unionByName(_missing(rows, counted, still_open, sure)), {f: k[f] for f in still_open})
        for f in sure:
            for rank, r in enumerate(top[f], 1):
                p = np.array([r.h], dtype=np.int64).view(np.uint64) >> _U(64 - LADDER[-1])
                out.append((f, r.value, r.n, int(sketches[f].estimate(p, len(LADDER) - 1)[0]), rank))
        open_cuts = again
    return spark.createDataFrame(out, "field int, value string, n_exact bigint, n_estimated bigint, rank int")
