"""Problem 2: per-key results although a few keys hold most records, by two-stage salted aggregation.

Heavy keys are found by a frequent-items pass whose answer is bounded (at most 1/support keys a column,
no key above the support is missed). Their rows get a salt; partial results per (key, salt) are computed
first and merged per key then. Light keys keep salt 0 and are merged from one partial result.

The salt is a hash of ``salt_on``, not a random number: a task that runs again after an executor was lost
salts alike, and values that are equal in ``salt_on`` share a salt, so even exact distinct counts of that
expression add up over the salts.

Cases: null is a group of its own in the aggregate (callers drop it where it is no key). Values that are
empty after clean-up form the key ''. Empty tables give no rows. Rows are never dropped or sampled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.functions.text import label_form
from certloom.session import parallelism

#: Keys held by at least this share of the rows are salted (the frequent-items pass may name lighter ones too).
SUPPORT = 0.02


def heavy_values(df: DataFrame, column: str, support: float = SUPPORT) -> list:
    """Every value of ``column`` held by more than ``support`` of the rows, and perhaps others; at most 1/support."""
    rows = df.where(F.col(column).isNotNull()).select(column)
    got = rows.freqItems([column], support).first()
    return sorted(x for x in (got[0] or []) if x is not None) if got else []


def salted_aggregate(df: DataFrame, key: str, partial: dict[str, Column], merge: dict[str, Column], salt_on: Column, heavy: list | None = None, salts: int | None = None) -> DataFrame:
    """``partial``: results per (key, salt); ``merge``: final results from columns of those names.

    ``heavy``: the keys to salt; looked up by ``heavy_values`` where not given.
    """
    heavy = heavy_values(df, key) if heavy is None else heavy
    n = salts or 4 * parallelism(df.sparkSession)
    spread = F.pmod(F.xxhash64(salt_on), F.lit(n)).cast("int")
    salt = F.when(F.col(key).isin(heavy), spread).otherwise(F.lit(0)) if heavy else F.lit(0)
    first = df.withColumn("_salt", salt).groupBy(key, "_salt").agg(*(c.alias(k) for k, c in partial.items()))
    return first.groupBy(key).agg(*(c.alias(k) for k, c in merge.items()))


def field_counts(events: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(key_field, key_value, n_rows) of each field, values in their label form, null included.

    All fields are read in one pass as rows (field=value), after one pass that finds the heavy ones.
    """
    key = lambda i, f: F.concat(F.lit(str(i)), F.coalesce(F.concat(F.lit("="), label_form(F.col(f))), F.lit("")))
    rows = events.select("event_id", F.explode(F.array(*(key(i, f) for i, f in enumerate(fields)))).alias("key"))
    heavy = heavy_values(rows, "key", SUPPORT / len(fields))
    counts = salted_aggregate(rows, "key", {"n": F.count("*")}, {"n_rows": F.sum("n")}, F.col("event_id"), heavy)
    place = F.instr("key", "=")
    names = F.create_map(*(x for i, f in enumerate(fields) for x in (F.lit(str(i)), F.lit(f))))
    field = F.when(place > 0, F.substring_index("key", "=", 1)).otherwise(F.col("key"))
    value = F.when(place > 0, F.expr("substring(key, instr(key, '=') + 1)"))
    return counts.select(names[field].alias("key_field"), value.alias("key_value"), "n_rows")


def frequent_values(events: DataFrame, fields: tuple[str, ...], share: float) -> DataFrame:
    """(key_field, key_value) held by at least ``share`` of all rows; null is no key but its rows count."""
    total = events.count()  # from the files' footers
    return field_counts(events, fields).where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.lit(total))).select("key_field", "key_value")


def field_profile(events: DataFrame, field: str, distinct: Column) -> DataFrame:
    """Complete per-key results: rows, precertificates, hosts, first and last sight, exact different ``distinct`` values."""
    rows = events.select(label_form(F.col(field)).alias("key_value"), distinct.alias("v"), "is_precert", F.coalesce(F.array_size("domains"), F.lit(0)).alias("hosts"), "seen_at")
    partial = {
        "a": F.count("*"), "b": F.count_if("is_precert"), "c": F.sum("hosts"),
        "d": F.min("seen_at"), "e": F.max("seen_at"), "f": F.count_distinct("v"),
    }
    merge = {
        "n_rows": F.sum("a"), "n_precerts": F.sum("b"), "n_hosts": F.sum("c"),
        "first_seen": F.min("d"), "last_seen": F.max("e"), "n_distinct": F.sum("f"),
    }
    return salted_aggregate(rows, "key_value", partial, merge, F.col("v")).where("key_value is not null")
