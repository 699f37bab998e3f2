"""Detection: certificates to hosts that may impersonate a watched brand."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certloom.functions.psl import with_fqdn, with_names
from certloom.operators.context import FAMILY_RULES, DetectContext
from certloom.operators.rules import SHORTEST_CORE, can_mix, family_rule, mixed_names, reasons, typo_cores, with_large_sets
from certloom.session import materialise, widen

#: Names near a brand and names of mixed scripts are broadcast up to this many, some 20 MB. Beyond, both sides
#: are shuffled, and hot names are split by adaptive execution.
BROADCAST_ROWS = 200_000


def is_wildcard(host: Column) -> Column:
    """Some dot-separated label is exactly an asterisk."""
    return F.contains(F.concat(F.lit("."), host, F.lit(".")), F.lit(".*."))


def strip_wildcards(events: DataFrame) -> DataFrame:
    """Drops wildcard hosts, and certificates without any host left."""
    kept = F.filter("domains", lambda d: ~is_wildcard(d))
    return events.withColumn("domains", kept).where(F.size("domains") > 0)


def explode_hosts(events: DataFrame) -> DataFrame:
    """One row per host in order, repeated ones too: all columns but ``domains``, and ``pos``, ``domain``."""
    rest = [c for c in events.columns if c != "domains"]
    return events.select(*(F.col(f"`{c}`") for c in rest), F.posexplode("domains").alias("pos", "domain")).where("domain is not null")


def named_hosts(events: DataFrame, ctx: DetectContext) -> DataFrame:
    """Hosts with the parts of their names, allowlisted ones left out before any rule is evaluated."""
    return with_names(explode_hosts(events), "domain", ctx.suffixes, ctx.allowlist).where("not is_allowed")


def _special_names(events: DataFrame, ctx: DetectContext) -> DataFrame:
    """(typo, name): labels within the edit limit of a brand, and whole names of mixed scripts, as a stored table.

    Both are looked for among the different labels and odd names of all hosts, before any name is split: the
    core of a name is one of its labels.
    """
    fqdn = F.col("fqdn")
    names = with_fqdn(explode_hosts(events.select("domains")), "domain")
    none = F.array().cast("array<struct<typo:boolean,name:string>>")
    one = lambda typo, name: F.struct(F.lit(typo).alias("typo"), name.alias("name"))
    typos, mixes = ctx.on("R-03") and bool(ctx.brands), ctx.on("E-01")
    labels = F.transform(F.filter(F.split(fqdn, r"\."), lambda x: F.length(x) > SHORTEST_CORE), lambda x: one(True, x)) if typos else none
    odd = F.when(can_mix(fqdn), F.array(one(False, fqdn))).otherwise(none) if mixes else none
    tried = materialise(names.select(F.explode(F.concat(labels, odd)).alias("n")).select("n.*").distinct(), "names")
    found = [mixed_names(tried.where("not typo").select(F.col("name").alias("fqdn"))).select(F.lit(False).alias("typo"), F.col("fqdn").alias("name"))] if mixes else []
    if typos:
        found.append(typo_cores(tried.where("typo").select(F.col("name").alias("core")), ctx.brands).select(F.lit(True).alias("typo"), F.col("core").alias("name")))
    return materialise(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "names")


def with_rule_inputs(events: DataFrame, ctx: DetectContext) -> DataFrame:
    """``named_hosts`` with ``is_mixed`` and ``is_typo``, the inputs of rules that are no plain expressions."""
    names = with_large_sets(named_hosts(events, ctx), ctx)
    typos, mixes = ctx.on("R-03") and bool(ctx.brands), ctx.on("E-01")
    special = _special_names(events, ctx) if typos or mixes else None
    few = special is not None and special.count() <= BROADCAST_ROWS  # from the files' footers
    for flag, wanted, typo, key in (("is_typo", typos, "typo", "core"), ("is_mixed", mixes, "not typo", "fqdn")):
        if wanted:
            hits = special.where(typo).select(F.col("name").alias(key), F.lit(True).alias(flag))
            names = names.join(F.broadcast(hits) if few else hits, key, "left")
        names = names.withColumn(flag, F.coalesce(flag, F.lit(False)) if wanted else F.lit(False))
    return names


def detect(events: DataFrame, ctx: DetectContext, skip_wildcards: bool = True) -> DataFrame:
    """One row per host with at least one reason: the event's columns, ``pos``, ``domain``, ``reasons``.

    The same function serves batch reads and the micro-batches of a stream.
    """
    events = widen(strip_wildcards(events) if skip_wildcards else events)
    rest = [c for c in events.columns if c != "domains"]
    names = with_rule_inputs(events, ctx)
    for f in FAMILY_RULES:
        names = names.withColumn(f, family_rule(ctx, f))
    found = names.where(F.coalesce(*FAMILY_RULES).isNotNull()).withColumn("reasons", reasons(ctx))
    return found.where(F.size("reasons") > 0).select(*rest, "pos", "domain", "reasons")


def detection_records(found: DataFrame) -> DataFrame:
    """The output layout of detections."""
    return found.select(
        detected_at().alias("detected_at"), "source", "serial_number", "domain",
        F.array_distinct(F.transform("reasons", lambda r: r["family"])).alias("families"),
        F.transform("reasons", lambda r: r["rule"]).alias("rules"),
    )


def raw_records(events: DataFrame) -> DataFrame:
    """The output layout of certificates without detection."""
    return events.select(detected_at().alias("detected_at"), "source", "serial_number", "domains")


def detected_at() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
