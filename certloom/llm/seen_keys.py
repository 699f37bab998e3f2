"""Problem 1: has this key been seen before?

Keys arrive in batches ("generations"). A sealed generation is kept only as immutable peeling filters in a
stored table, about five bytes a key instead of the key: one filter for each range of 64-bit key hashes,
ranges being so narrow that no filter holds many more than ``KEYS_A_FILTER`` keys. A key of the current batch is

1. compared exactly, as text, with the keys of its own batch (one partially aggregated first place a key,
   so a key that holds a third of all rows crosses the shuffle once a map task), and
2. where it is the first of its batch, probed in the filters of all earlier generations: keys and filters
   are shuffled by ranges of the hash and sorted, so a task holds one filter of each generation at a time.

``answer_batch`` does this for one batch and seals it; earlier keys are not read again. ``seen`` does it for
a whole table, whose event_ids are cut into generations of doubling length, so their number is the
logarithm of the table's size.

No filter has false negatives, so a "new" answer is always right. A "seen" is wrong where fingerprints or
hashes meet by chance. ``error_rates`` finds all wrong answers by an exact audit of the keys themselves and
reports them beside the predicted rate: both chances, compounded over the filters probed.

Cases: null, and text that is empty after clean-up, is no key. Rows that repeat an event_id are one row
delivered again: none of them is earlier than another. Empty tables give no rows. Extra columns are ignored.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certloom.functions.text import hex_form, host_form
from certloom.llm.peeling import PeelingFilter
from certloom.session import materialise, parallelism, shared_path

#: The first generation spans so many event_ids, the next one twice as many, and so on.
FIRST_SPAN = 4096
KEYS_A_FILTER = 1 << 17
#: Fewer keys than this are not worth a filter of their own.
FEWEST_KEYS = 1 << 12
FINGERPRINT_BITS = 32

_FILTERS = "generation int, width int, prefix bigint, n bigint, third bigint, seed int, bits int, slots binary"
_ANSWERS = "generation int, event_id bigint, pos int, hit int, probes int"


def _keys_of_events():
    """An array of (pos, key) of each event: pos -1 is the serial, 0.. the places in ``domains``."""
    one = lambda pos, key: F.struct(pos.alias("pos"), key.alias("key"))
    serial = F.array(one(F.lit(-1), hex_form(F.col("serial_number"))))
    hosts = F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda d, i: one(i, host_form(d)))
    return F.filter(F.concat(serial, hosts), lambda k: k["key"] != "")


def _field(pos):
    return F.when(pos == -1, "serial_number").otherwise("domains")


def event_keys(events: DataFrame, *more) -> DataFrame:
    """(event_id, more..., pos, key_field, key) of every key."""
    rows = events.where("event_id is not null").select("event_id", *more, F.explode(_keys_of_events()).alias("k"))
    return rows.select(*rows.columns[:-1], "k.pos", _field(F.col("k.pos")).alias("key_field"), "k.key")


def earlier_key_forms(earlier: DataFrame) -> DataFrame:
    """(key_field, key) of the keys met before the arrivals; unknown fields are left out."""
    v = F.col("key_value")
    form = F.when(F.col("key_field") == "serial_number", hex_form(v)).when(F.col("key_field") == "domains", host_form(v))
    return earlier.select("key_field", form.alias("key")).where("key is not null and key <> ''")


def _earlier_places(earlier: DataFrame) -> DataFrame:
    return earlier_key_forms(earlier).select(F.lit(0).alias("generation"), "key_field", "key", F.lit(-1).cast("long").alias("event_id"), F.lit(-1).alias("pos"))


def first_places(keys: DataFrame) -> DataFrame:
    """(generation, key_field, key, h, event_id, pos): the first place of each key in each generation, compared exactly."""
    at = F.min(F.struct("event_id", "pos")).alias("at")
    rows = keys.groupBy("generation", "key_field", "key").agg(at)
    return rows.select("generation", "key_field", "key", F.xxhash64("key_field", "key").alias("h"), "at.event_id", "at.pos")


# Sealing


def _sealer(bits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            gens, prefixes, hashes = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for start, end in _runs(gens, prefixes):
                own = (int(gens[start]), int(prefixes[start]))
                if now is not None and own != now:
                    yield _sealed(now, held, bits, width)
                    held = []
                now = own
                held.append(hashes[start:end])
        if now is not None:
            yield _sealed(now, held, bits, width)

    return run


def _sealed(own: tuple[int, int], held: list[np.ndarray], bits: int, width: int) -> pa.RecordBatch:
    f = PeelingFilter(np.concatenate(held).astype(np.int64).view(np.uint64), bits)
    row = (own[0], width, own[1], f.n, f.third, f.seed, bits, f.slots.astype(f"<u{bits // 8}").tobytes())
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in _FILTERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(row, fields)], names=[name for name, _ in fields])


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    if not len(columns[0]):
        return []
    changed = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    cut = [0, *(np.flatnonzero(changed) + 1), len(columns[0])]
    return list(zip(cut[:-1], cut[1:]))


def seal(firsts: DataFrame, path: str, batch: int, bits: int = FINGERPRINT_BITS) -> None:
    """Builds the filters of all generations of ``firsts`` (generation, h) and stores them under the batch's number.

    A batch that is sealed again replaces itself. ``firsts`` is read twice and should be a stored table.
    """
    spark = firsts.sparkSession
    most = firsts.groupBy("generation").count().agg(F.max("count")).first()[0] or 0
    slots = math.ceil(math.log2(parallelism(spark))) + 2  # enough ranges to spread them evenly
    width = max(1, math.ceil(math.log2(max(most / KEYS_A_FILTER, 1))), min(slots, math.ceil(math.log2(max(most / FEWEST_KEYS, 1)))))
    ranged = firsts.select("generation", F.shiftright("h", 64 - width).alias("prefix"), "h")
    spread = ranged.repartition(parallelism(spark), "generation", "prefix").sortWithinPartitions("generation", "prefix")
    spread.mapInArrow(_sealer(bits, width), _FILTERS).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def open_filters(spark: SparkSession, path: str) -> DataFrame:
    """The stored filters, one row for each generation and range of hashes."""
    return spark.read.schema(_FILTERS + ", batch int").parquet(path).drop("batch")


# Probing


def _prober(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: dict[int, tuple[PeelingFilter, int]] = {}
    for b in batches:
        col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
        is_key, at, gens = (col[c].to_numpy(zero_copy_only=False) for c in ("kind", "at", "generation"))
        hit = np.full(len(at), -1, dtype=np.int32)
        probes = np.zeros(len(at), dtype=np.int32)
        for start, end in _runs(is_key):
            if not is_key[start]:
                for i in range(start, end):
                    f = PeelingFilter.opened(*(col[c][i].as_py() for c in ("n", "third", "seed", "bits")), col["slots"][i].as_buffer())
                    opened[int(gens[i])] = f, col["last"][i].as_py()
                continue
            h, own = at[start:end], gens[start:end]
            keys = h.astype(np.int64).view(np.uint64)
            for g in sorted(opened):
                f, last = opened[g]
                if last < h[0]:
                    del opened[g]
                    continue
                asked = (own > g) & (h <= last)
                probes[start:end] += asked
                left = np.flatnonzero(asked & (hit[start:end] < 0))  # the oldest generation that answers stays
                hit[start + left[f.contains(keys[left])]] = g
        some = np.flatnonzero(is_key)
        if len(some):
            take = pa.array(some)
            cols = [*(col[c].take(take) for c in ("generation", "event_id", "pos")), pa.array(hit[some]), pa.array(probes[some])]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _ANSWERS.split(", ")])


def probe(firsts: DataFrame, filters: DataFrame) -> DataFrame:
    """Answers each first place by the filters of earlier generations: ``hit`` -1 is new, else the generation that says seen.

    Both sides are spread by ranges of the hash, the coarsest that a filter has (or as many as there are
    task slots; a filter of a wider range goes to each part of it), and sorted, filters before their keys.
    """
    spark = firsts.sparkSession
    widths = [r.width for r in filters.select("width").distinct().collect()]  # as many as there are sizes of generations
    route = max(min(widths, default=1), min(max(widths, default=1), math.ceil(math.log2(parallelism(spark))) + 2))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    routes = F.expr(f"if(width >= {route}, array(shiftright(prefix, width - {route})), sequence(shiftleft(prefix, {route} - width), shiftleft(prefix, {route} - width) + shiftleft(1L, {route} - width) - 1))")
    start, last = F.expr("shiftleft(prefix, 64 - width)"), F.expr("shiftleft(prefix, 64 - width) + shiftrightunsigned(-1L, width)")
    sealed = filters.withColumn("route", F.explode(routes)).select(
        "route", F.greatest(start, F.shiftleft("route", 64 - route)).alias("at"), F.lit(0).alias("kind"), "generation",
        *none("bigint", "event_id"), *none("int", "pos"), last.alias("last"), "n", "third", "seed", "bits", "slots",
    )
    keys = firsts.select(
        F.shiftright("h", 64 - route).alias("route"), F.col("h").alias("at"), F.lit(1).alias("kind"), "generation", "event_id", "pos",
        *none("bigint", "last", "n", "third"), *none("int", "seed", "bits"), *none("binary", "slots"),
    )
    spread = sealed.unionByName(keys).repartition(parallelism(spark), "route").sortWithinPartitions("at", "kind")
    return spread.mapInArrow(_prober, _ANSWERS)


# Answers


def _seen_places(events: DataFrame, new: DataFrame) -> DataFrame:
    """(event_id, key_field, key_pos) of all keys of the events but those at the ``new`` places (event_id, pos).

    All places of a key in its batch but the first are seen by the exact comparison. The join is by the
    unique event_id: no key is hot.
    """
    places = events.where("event_id is not null").select("event_id", F.transform(_keys_of_events(), lambda k: k["pos"]).alias("places"))
    fresh = new.groupBy("event_id").agg(F.collect_list("pos").alias("fresh"))
    left = F.array_except("places", F.coalesce("fresh", F.array().cast("array<int>")))
    rows = places.join(fresh, "event_id", "left").select("event_id", F.explode(left).alias("key_pos"))
    return rows.select("event_id", _field(F.col("key_pos")).alias("key_field"), "key_pos")


def seal_earlier(earlier: DataFrame, path: str, bits: int = FINGERPRINT_BITS) -> None:
    """Seals the keys known before the arrivals as generation 0 of a new store."""
    seal(materialise(first_places(_earlier_places(earlier)).select("generation", "h"), "seen-keys"), path, 0, bits)


def answer_batch(events: DataFrame, path: str, batch: int, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(event_id, key_field, key_pos) of the keys of one batch that were seen before; then seals the batch in the store.

    Batches are numbered from 1 in order of arrival. Only the batch and the stored filters are read. A batch
    that is answered again gives the same rows: it is probed in the filters of smaller numbers only.
    """
    spark = events.sparkSession
    firsts = first_places(event_keys(events, F.lit(batch).alias("generation"))).drop("key_field", "key")
    firsts = materialise(firsts, "seen-keys")
    answers = materialise(probe(firsts, open_filters(spark, path).where(F.col("generation") < batch)), "seen-answers")
    seal(firsts, path, batch, bits)
    return _seen_places(events, answers.where("hit < 0"))


def _generations(events: DataFrame, span: int):
    """The generation of an event_id: 1 up to the first ``span`` of them, then each twice as long as the one before."""
    lo = events.agg(F.min("event_id")).first()[0] or 0
    return (F.floor(F.log2((F.col("event_id") - F.lit(lo)) / F.lit(span) + 1)) + 1).cast("int").alias("generation")


def _answered(events: DataFrame, earlier: DataFrame, span: int, bits: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """(first places with the columns ``more``, answers): all but the last generation sealed, all events' keys probed."""
    spark, path = events.sparkSession, shared_path(events.sparkSession, "seen-filters")
    keys = event_keys(events, _generations(events, span)).unionByName(_earlier_places(earlier))
    firsts = materialise(first_places(keys).select("generation", "h", "event_id", "pos", *more), "seen-keys")
    last = firsts.agg(F.max("generation")).first()[0] or 0
    seal(firsts.where(F.col("generation") < last).select("generation", "h"), path, 0, bits)
    return firsts, probe(firsts.where("generation > 0"), open_filters(spark, path))


def seen(events: DataFrame, earlier: DataFrame, span: int = FIRST_SPAN, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """(event_id, key_field, key_pos) of every key of the table that was seen before."""
    _, answers = _answered(events, earlier, span, bits)
    return _seen_places(events, answers.where("hit < 0").select("event_id", "pos"))


def error_rates(events: DataFrame, earlier: DataFrame, span: int = FIRST_SPAN, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """One row per generation of arrivals: keys probed, answers "seen", wrong ones, and measured and predicted error rates.

    Wrong answers are found by an exact comparison of the keys of all generations. The predicted rate, for
    keys that are new, is 1 - (1 - 2**-bits)**filters for the fingerprints, and the keys before / 2**64 for
    equal hashes.
    """
    firsts, answers = _answered(events, earlier, span, bits, "key_field", "key")
    answers = materialise(answers, "seen-answers")
    truly_new = firsts.groupBy("key_field", "key").agg(F.min(F.struct("generation", "event_id", "pos")).alias("at")).select("at.event_id", "at.pos")
    wrong = answers.where("hit >= 0").join(truly_new, ["event_id", "pos"], "left_semi").groupBy("generation").agg(F.count("*").alias("n_wrong"))
    per = answers.groupBy("generation").agg(F.count("*").alias("n_keys"), F.count_if(F.col("hit") >= 0).alias("n_seen"), F.max("probes").alias("n_filters"))
    sizes = firsts.groupBy("generation").agg(F.count("*").alias("size"))
    before = sizes.select("generation", (F.sum("size").over(Window.orderBy("generation")) - F.col("size")).alias("n_before"))  # one row a generation
    new = F.col("n_keys") - F.col("n_seen") + F.col("n_wrong")
    by_print = -F.expm1(F.col("n_filters") * F.log1p(F.lit(-(2.0**-bits))))
    return (
        per.join(wrong, "generation", "left")
        .join(before, "generation")
        .withColumn("n_wrong", F.coalesce("n_wrong", F.lit(0)))
        .withColumn("measured_rate", F.when(new > 0, F.col("n_wrong") / new).otherwise(0.0))
        .withColumn("predicted_rate", by_print + F.col("n_before") * F.lit(2.0**-64))
    )
