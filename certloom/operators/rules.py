"""The fourteen rules as columns over the parts of a name (see ``functions.psl.with_names``).

Every rule is null-free. R-03 and E-01 read the columns ``is_typo`` and ``is_mixed`` that ``detect`` adds,
as they need a join and a Python stage.
"""

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions.psl import tokens
from certloom.operators.context import FAMILY_RULES, DetectContext
from certloom.session import parallelism

#: Tokens that look like a top-level domain inside a label.
TLD_LIKE = ("com", "net", "org", "info", "biz", "co", "io", "gov", "edu")
#: Thresholds.
TYPO_DISTANCE, SHORT_BRAND, SHORT_DISTANCE, SHORTEST_CORE = 2, 5, 1, 3
MOST_REGISTRABLE, LEAST_HYPHENS, LEAST_LABELS, LEAST_DIGITS = 40, 3, 4, 3
PUNYCODE = "xn--"


#: Sets up to this size are literals of the plan; larger ones are constant arrays of small buckets.
FEW = 32
#: Larger sets than this are joined as tables (see ``with_members``) and not carried by the plan.
IN_PLAN = 200_000
_BETWEEN, _AROUND = "\x01", "\x02"


def _among(c: Column, values) -> Column:
    """Exact membership in a set of up to ``IN_PLAN`` values, without one plan node an element and in constant time.

    The set is one constant: an array of buckets by the values' CRC, half of them empty or of one value.
    """
    values = sorted(v for v in values or () if v is not None)
    odd = [v for v in values if _BETWEEN in v or _AROUND in v]
    if len(values) <= FEW or odd:
        plain = [v for v in values if v not in set(odd)]
        return (c.isin(values) if values else F.lit(False)) if len(values) <= FEW else c.isin(odd) | _among(c, plain)
    n = 1 << (2 * len(values) - 1).bit_length()
    buckets = [""] * n
    for v in values:
        at = zlib.crc32(v.encode()) % n
        buckets[at] = (buckets[at] or _AROUND) + v + _AROUND
    table = F.split(F.lit(_BETWEEN.join(buckets)), _BETWEEN)
    bucket = F.get(table, F.crc32(c).bitwiseAND(n - 1).cast("int"))
    return F.when(~F.contains(c, F.lit(_AROUND)), F.contains(bucket, F.concat(F.lit(_AROUND), c, F.lit(_AROUND)))).otherwise(F.lit(False) & c.isNotNull())


def value_table(spark: SparkSession, values, name: str) -> DataFrame:
    return spark.createDataFrame(pa.table({name: pa.array(sorted(v for v in values if v is not None), pa.string())}))


def with_members(names: DataFrame, into: str, what: Column, values) -> DataFrame:
    """Adds array column ``into``: those elements of the array ``what`` of a name that are in a set of any size.

    Different names are expanded and joined with the set as a table; only names that hold some element are
    joined back. What is broadcast is left to the sizes that Spark sees.
    """
    held = names.select("fqdn", what.alias("_all")).where(F.size("_all") > 0).distinct().select("fqdn", F.explode("_all").alias("_one"))
    held = held.join(value_table(names.sparkSession, values, "_one"), "_one", "left_semi")
    return names.join(held.groupBy("fqdn").agg(F.collect_set("_one").alias(into)), "fqdn", "left").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def digit_runs_of(fqdn: Column) -> Column:
    return F.regexp_extract_all(fqdn, F.lit(r"\p{Nd}{3,}"), F.lit(0))


def with_large_sets(names: DataFrame, ctx: DetectContext) -> DataFrame:
    """Adds what the rules need of sets that are too large for the plan; other sets add nothing."""
    if len(ctx.brands) > IN_PLAN:
        names = with_members(names, "brand_tokens", tokens(F.col("fqdn")), ctx.brands)
    if len(ctx.digit_exceptions) > IN_PLAN:
        names = with_members(names, "known_runs", digit_runs_of(F.col("fqdn")), ctx.digit_exceptions)
    return names


def _is_brand(c: Column, ctx: DetectContext) -> Column:
    return F.array_contains("brand_tokens", c) if len(ctx.brands) > IN_PLAN else _among(c, ctx.brands)


def _is_known_run(c: Column, ctx: DetectContext) -> Column:
    return F.array_contains("known_runs", c) if len(ctx.digit_exceptions) > IN_PLAN else _among(c, ctx.digit_exceptions)


def _any_token(name: Column, values) -> Column:
    return F.exists(tokens(name), lambda t: _among(t, values)) if values else F.lit(False)


def _neighbours(name: Column, left: Callable[[Column], Column], right: Callable[[Column], Column]) -> Column:
    """``left`` holds of some token and ``right`` of the next one."""
    t = tokens(name)
    pairs = F.transform(t, lambda x, i: left(x) & F.coalesce(right(F.get(t, i + 1)), F.lit(False)))
    return F.array_contains(pairs, True)


def predicates(ctx: DetectContext) -> dict[str, Column]:
    """The rules as columns of names with ``is_typo``, ``is_mixed`` and, for large sets, the columns of ``with_large_sets``."""
    fqdn, core, sub = F.col("fqdn"), F.col("core"), F.col("subdomain")
    no, brand = F.lit(False), lambda t: _is_brand(t, ctx)
    auth = lambda t: _among(t, ctx.terms.get("R-04"))
    outside = F.exists(F.array_except(tokens(sub), tokens(core)), brand)
    return {
        "R-01": (sub != "") & outside if ctx.brands else no,
        "R-02": _neighbours(core, brand, lambda t: t.isin(*TLD_LIKE)) if ctx.brands else no,
        "R-03": F.col("is_typo"),
        "R-04": _neighbours(core, brand, auth) | _neighbours(core, auth, brand) if ctx.brands and ctx.terms.get("R-04") else no,
        "L-01": _any_token(fqdn, ctx.terms.get("L-01")),
        "L-02": _any_token(fqdn, ctx.terms.get("L-02")),
        "L-03": (sub != "www") & F.array_contains(tokens(core), "www"),
        "L-04": _any_token(fqdn, ctx.terms.get("L-04")),
        "E-01": F.col("is_mixed"),
        "E-02": F.startswith(fqdn, F.lit(PUNYCODE)) | F.contains(fqdn, F.lit("." + PUNYCODE)),
        "M-01": F.length(fqdn) - F.length(F.replace(fqdn, F.lit("-"), F.lit(""))) >= LEAST_HYPHENS,
        "M-02": F.length("registrable") > MOST_REGISTRABLE,
        "M-03": F.col("n_labels") >= LEAST_LABELS,
        "M-04": F.exists(digit_runs_of(fqdn), lambda r: ~_is_known_run(r, ctx)),
    }


def family_rule(ctx: DetectContext, family: str) -> Column:
    """The first enabled matching rule of a family, or null. Later branches are not evaluated."""
    said = predicates(ctx)
    out = None
    for rule in FAMILY_RULES[family]:
        if ctx.on(rule):
            out = F.when(said[rule], rule) if out is None else out.when(said[rule], rule)
    return F.lit(None).cast("string") if out is None else out


def reasons(ctx: DetectContext) -> Column:
    """array<struct<family, rule, points>> from the columns named like the families; weak hits need another family."""
    one = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("family"), F.col(f).alias("rule"), F.lit(0).alias("points")))
    strong = [one(f) for f in FAMILY_RULES if f != "morphological"]
    weak = one("morphological")
    if ctx.reinforced:
        others = F.coalesce(*(F.col(f) for f in FAMILY_RULES if f != "morphological"))
        weak = F.when(others.isNotNull(), weak)
    return F.array_compact(F.array(*strong, weak))


# R-03: edit distance to a brand


def typo_limit(brand_length: Column) -> Column:
    return F.when(brand_length <= SHORT_BRAND, SHORT_DISTANCE).otherwise(TYPO_DISTANCE)


def _pieces(length: int) -> list[tuple[int, int]]:
    """(start, size) of the limit + 1 pieces that a brand of this length is cut into, starts from 1."""
    n = (SHORT_DISTANCE if length <= SHORT_BRAND else TYPO_DISTANCE) + 1
    small, rest = divmod(length, n)
    out, start = [], 1
    for k in range(n):
        size = small + (k >= n - rest)
        out.append((start, size))
        start += size
    return out


def typo_cores(cores: DataFrame, brands: frozenset[str]) -> DataFrame:
    """The distinct values of column ``core`` that are within the edit limit of some brand and no brand themselves.

    Within ``limit`` edits one of ``limit + 1`` pieces of the brand stands unchanged in the core, moved by
    at most ``limit`` places. Cores are expanded by a small probe plan (by length), equi-joined with the
    brands' pieces, and verified by the bounded edit distance: no nested loop over brands.
    The probe plan is bounded by the lengths of names and broadcast. The pieces, three a brand, are broadcast
    up to ``IN_PLAN`` brands; beyond, Spark chooses by their size.
    """
    spark = cores.sparkSession
    usable = sorted(b for b in brands if b)
    rows = cores.select("core").where(F.length("core") > SHORTEST_CORE).distinct()
    if len(brands) > IN_PLAN:
        rows = rows.join(value_table(spark, brands, "core"), "core", "left_anti")
    else:
        rows = rows.where(~_among(F.col("core"), brands))
    rows = rows.repartition(parallelism(spark))  # narrow, but each row is expanded some 75 times below
    if not usable:
        return rows.where("false")
    lengths = sorted({len(b) for b in usable})
    plan = [
        (core_length, length, k, at, size)
        for length in lengths
        for limit in [SHORT_DISTANCE if length <= SHORT_BRAND else TYPO_DISTANCE]
        for core_length in range(max(length - limit, SHORTEST_CORE + 1), length + limit + 1)
        for k, (start, size) in enumerate(_pieces(length))
        for at in range(max(1, start - limit), min(core_length - size + 1, start + limit) + 1)
    ]
    pieces = [(len(b), k, b[s - 1 : s - 1 + n], b) for b in usable for k, (s, n) in enumerate(_pieces(len(b)))]
    plan_df = spark.createDataFrame(plan or [(0, 0, 0, 1, 0)], "core_length int, length int, k int, at int, size int")
    columns = list(zip(*pieces))
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
    piece_df = spark.createDataFrame(pa.table({n: pa.array(c, t) for n, c, t in zip(("length", "k", "piece", "brand"), columns, kinds)}))
    probes = rows.withColumn("core_length", F.length("core")).join(F.broadcast(plan_df), "core_length")
    probes = probes.withColumn("piece", F.col("core").substr(F.col("at"), F.col("size")))
    near = probes.join(F.broadcast(piece_df) if len(brands) <= IN_PLAN else piece_df, ["length", "k", "piece"])
    limit = typo_limit(F.col("length"))
    close = F.when(F.col("length") <= SHORT_BRAND, F.levenshtein("core", "brand", SHORT_DISTANCE)).otherwise(F.levenshtein("core", "brand", TYPO_DISTANCE))
    return near.where(close.between(1, limit)).select("core").distinct()


# E-01: scripts within a label


def mixes_scripts(label: str) -> bool:
    """Whether the letters of a label, decoded from Punycode, have names of more than one first word."""
    if label.startswith(PUNYCODE):
        try:
            label = label.encode("ascii").decode("idna")
        except UnicodeError:
            pass
    if label.isascii():
        return False
    return len({unicodedata.name(c, "").split(" ", 1)[0] for c in label if c.isalpha()} - {""}) > 1


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flags = [any(map(mixes_scripts, n.split("."))) for n in b.column(0).to_pylist()]
        yield b.filter(pa.array(flags, pa.bool_()))


def can_mix(fqdn: Column) -> Column:
    """Only names that are not ASCII, or hold Punycode, can mix scripts: no others go through Python."""
    return fqdn.rlike(r"[^\x00-\x7F]|(^|\.)xn--")


def mixed_names(names: DataFrame) -> DataFrame:
    """Those of the names in column ``fqdn`` that have a label of mixed scripts."""
    return names.select("fqdn").mapInArrow(_mixed, "fqdn string")
