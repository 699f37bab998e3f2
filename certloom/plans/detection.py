"""Queries of the detection engine's operators over cert_events, watchlist, raw_messages, events and part.

Every query runs over the whole of its tables.
"""

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certloom.functions.psl import load_rules, tokens, with_names
from certloom.functions.text import strip_blanks
from certloom.operators import kpis, rules, watchlist
from certloom.operators.context import FAMILY_RULES, RULES, DetectContext, context_of_table
from certloom.operators.detect import detect, detection_records, explode_hosts, named_hosts, raw_records, strip_wildcards, with_rule_inputs
from certloom.session import table
from certloom.sources import messages

ALL = frozenset(RULES)
#: What SQL can check: such queries are named ``..._without_e01`` and stand beside the full ones.
WITHOUT_E01 = ALL - {"E-01"}
DAY = 86_400
LANDMARKS = {"1 day": DAY, "5 days": 5 * DAY, "10 days": 10 * DAY}
WATCH_BUDGET = 500
#: Domains for the watchlist builder: one for each part, by its key.
RANK_TEMPLATES = ("{}-bank.de", "{}hosting.com", "bank{}.co.uk", "{}pharma.fr", "{}-insurance.us", "{}.com", "news{}clinic.net", "assur{}.it")


def _context(spark: SparkSession, d: str, on: frozenset[str] | None = None) -> DetectContext:
    return context_of_table(table(spark, d, "watchlist"), rules=on)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cert_events").select("event_id", "source", "serial_number", "seen_at", "is_precert", "domains")


def _hosts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "cert_events").select("event_id", *more, "domains")


#: Names made from each brand of the watchlist, for rules that no host of the small tables meets.
DERIVED = ("{}-com-x.net", "{}q.com", "{}-login.org", "www-{}.info", "{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}.com")


def _with_derived(spark: SparkSession, d: str) -> DataFrame:
    """All hosts, and names derived from the watchlist: imitations of each brand and hosts below its legitimate domains.

    Derived events have ids -1, -2, ... in the order of the brands' names.
    """
    w = table(spark, d, "watchlist").where("name is not null")
    brand = F.lower(strip_blanks(F.col("name")))
    number = F.row_number().over(Window.orderBy("name")).cast("bigint")  # a table of a few thousand brands
    below = F.transform(F.coalesce("legitimate_domains", F.array().cast("array<string>")), lambda x: F.concat(F.lit("shop."), x))
    made = F.array(*(_filled(t, brand) for t in DERIVED))
    return _hosts(spark, d).unionByName(w.select((-number).alias("event_id"), F.concat(made, below).alias("domains")))


def _filled(template: str, brand: Column) -> Column:
    parts = template.replace("{0}", "{}").split("{}")
    return F.concat(F.lit(parts[0]), *(x for p in parts[1:] for x in (brand, F.lit(p))))


def src_parse(spark, d):
    events = messages.to_events(table(spark, d, "raw_messages"), "msg_id")
    for c in ("validity_not_before", "validity_not_after"):  # microseconds since the epoch compare alike everywhere
        events = events.withColumn(c, F.unix_micros(c))
    return events.withColumn("domains", F.concat_ws("|", F.transform("domains", lambda x: F.coalesce(x, F.lit("\\N")))))


def src_invalid(spark, d):
    return messages.invalid_messages(table(spark, d, "raw_messages")).select("msg_id")


def wildcard_filter(spark, d):
    return strip_wildcards(_hosts(spark, d)).select("event_id", F.concat_ws("|", "domains").alias("domains"))


def san_explode(spark, d):
    return explode_hosts(_hosts(spark, d))


def names_split(spark, d):
    return with_names(explode_hosts(_hosts(spark, d)), "domain", load_rules()).select(
        "event_id", "pos", "fqdn", F.col("n_labels").cast("int").alias("n_labels"), "suffix", "registrable", "subdomain"
    )


def psl_suffix(spark, d):
    names = with_names(explode_hosts(_hosts(spark, d)), "domain", load_rules())
    return names.groupBy("suffix").agg(F.count("*").alias("n"))


def registrable_core(spark, d):
    names = with_names(explode_hosts(_hosts(spark, d)), "domain", load_rules())
    return names.groupBy("core").agg(F.count("*").alias("n"))


def tokenize(spark, d):
    names = with_names(explode_hosts(_hosts(spark, d)), "domain", load_rules())
    return names.select(F.explode(tokens(F.col("fqdn"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def allowlist_anti(spark, d):
    return named_hosts(_with_derived(spark, d), _context(spark, d)).select("event_id", "pos", "domain")


def _one_rule(rule: str, spark: SparkSession, d: str) -> DataFrame:
    ctx = _context(spark, d, frozenset({rule}))
    names = with_rule_inputs(_with_derived(spark, d), ctx)
    return names.where(rules.predicates(ctx)[rule]).select("event_id", "pos", "domain")


def _one_family(family: str, on: frozenset[str], spark: SparkSession, d: str) -> DataFrame:
    """The first matching rule of a family."""
    ctx = _context(spark, d, frozenset(FAMILY_RULES[family]) & on)
    names = with_rule_inputs(_with_derived(spark, d), ctx).withColumn("rule", rules.family_rule(ctx, family))
    return names.where("rule is not null").select("event_id", "pos", "rule")


def m04_exceptions(spark, d):
    """Digit runs of the legitimate domains."""
    runs = table(spark, d, "watchlist").select(F.explode("legitimate_domains").alias("domain"))
    runs = runs.select(F.explode(F.regexp_extract_all("domain", F.lit(r"\p{Nd}{3,}"), F.lit(0))).alias("run"))
    return runs.distinct()


def _flat(found: DataFrame) -> DataFrame:
    return found.select("event_id", "pos", "domain", F.concat_ws(",", F.transform("reasons", lambda r: r["rule"])).alias("rules"))


def detect_full(spark, d):
    return _flat(detect(_hosts(spark, d), _context(spark, d)))


def detect_without_e01(spark, d):
    return _flat(detect(_hosts(spark, d), _context(spark, d, WITHOUT_E01)))


def reinforcement_gate(spark, d, on=ALL):
    """Weak hits that came through because another family matched."""
    found = _flat(detect(_hosts(spark, d), _context(spark, d, on)))
    return found.where(F.col("rules").rlike("M-0")).select("event_id", "pos", "rules")


def rule_toggles_morph_only(spark, d):
    return _flat(detect(_hosts(spark, d), _context(spark, d, frozenset({"M-03"}))))


def records_of_detections(spark, d, on=ALL):
    found = detect(_hosts(spark, d, "source", "serial_number"), _context(spark, d, on))
    out = detection_records(found).drop("detected_at")
    return out.withColumn("families", F.concat_ws(",", "families")).withColumn("rules", F.concat_ws(",", "rules"))


def records_raw(spark, d):
    events = strip_wildcards(_hosts(spark, d, "source", "serial_number"))
    return raw_records(events).select("source", "serial_number", F.concat_ws("|", "domains").alias("domains"))


def kpi_totals(spark, d):
    return kpis.feed_totals(_events(spark, d))


def kpi_unique_domains(spark, d):
    return kpis.distinct_hosts(_events(spark, d))


def kpi_by_source_topk(spark, d):
    return kpis.top_sources(_events(spark, d), 15).withColumn("percent", F.round("percent", 6))


def kpi_landmarks(spark, d):
    return kpis.landmarks(_events(spark, d), "seen_at", LANDMARKS).withColumn("certs_per_second", F.round("certs_per_second", 9))


def kpi_detection_without_lists(spark, d, on=ALL):
    """Detection figures of a bounded run that knows no brands and no terms."""
    events = strip_wildcards(_hosts(spark, d))
    found = detect(events, DetectContext(rules=on, suffixes=load_rules()), skip_wildcards=False)
    return kpis.detection_totals(events, found).withColumn("percent_of_domains", F.round("percent_of_domains", 6))


def metrics_totals(spark, d, on=ALL):
    events = strip_wildcards(_hosts(spark, d))
    found = detect(events, _context(spark, d, on), skip_wildcards=False)
    return kpis.detection_totals(events, found).withColumn("percent_of_domains", F.round("percent_of_domains", 6))


def _metrics_by(what: str, on: frozenset[str], spark: SparkSession, d: str) -> DataFrame:
    return kpis.reasons_by(detect(_hosts(spark, d), _context(spark, d, on)), what).withColumn("percent", F.round("percent", 6))


def metrics_interval_delta(spark, d):
    return kpis.interval_deltas(_events(spark, d), "seen_at", "1 day").withColumn("start", F.unix_micros("start"))


def events_by_interval(spark, d):
    """Stream events per hour and type."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    slug = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "")
    domain = None
    for k, t in enumerate(RANK_TEMPLATES):
        one = F.concat(F.lit(t.split("{}")[0]), slug, F.col("p_partkey").cast("string"), F.lit(t.split("{}")[1]))
        domain = F.when(F.col("p_partkey") % len(RANK_TEMPLATES) == k, one) if domain is None else domain.when(F.col("p_partkey") % len(RANK_TEMPLATES) == k, one)
    www = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("www."), domain)).otherwise(domain)
    return table(spark, d, "part").select((F.col("p_partkey") + 1).cast("int").alias("rank"), www.alias("domain"))


def wl_split_domain(spark, d):
    return watchlist.with_split(_ranking(spark, d)).select("rank", "label", "registrable", "tld")


def wl_region(spark, d):
    return watchlist.with_split(_ranking(spark, d)).select("rank", watchlist.region_of(F.col("tld")).alias("region"))


def wl_sector(spark, d):
    return watchlist.with_split(_ranking(spark, d)).select("rank", watchlist.sector_of(F.col("label")).alias("sector"))


def wl_candidates(spark, d):
    return watchlist.candidates(_ranking(spark, d), spark.createDataFrame([("bankredwidget2.co.uk",)], "registrable string"))


def wl_dedup(spark, d):
    return watchlist.first_per_registrable(watchlist.candidates(_ranking(spark, d))).select("rank", "registrable", "domain")


def wl_budget(spark, d):
    """The extension up to a budget: the limit is the feature."""
    rows = watchlist.first_per_registrable(watchlist.candidates(_ranking(spark, d)))
    return watchlist.budget_by_rank(rows, WATCH_BUDGET).select("rank", "domain", "sector")


def wl_sector_counts(spark, d):
    return watchlist.sector_counts(watchlist.candidates(_ranking(spark, d)))


def queries() -> dict:
    named = [
        src_parse, src_invalid, wildcard_filter, san_explode, names_split, psl_suffix, registrable_core, tokenize, allowlist_anti,
        m04_exceptions, reinforcement_gate, rule_toggles_morph_only, detect_full, detect_without_e01, records_of_detections, records_raw,
        kpi_totals, kpi_unique_domains, kpi_by_source_topk, kpi_landmarks, kpi_detection_without_lists, metrics_totals,
        metrics_interval_delta, events_by_interval, wl_split_domain, wl_region, wl_sector, wl_candidates, wl_dedup, wl_budget,
        wl_sector_counts,
    ]
    out = {f.__name__: f for f in named}
    out |= {f"rule_{r.lower().replace('-', '')}": partial(_one_rule, r) for r in RULES}
    out |= {f"family_{f}": partial(_one_family, f, ALL) for f in FAMILY_RULES}
    out |= {f"metrics_by_{w}": partial(_metrics_by, w, ALL) for w in ("rule", "family")}
    out |= {f"metrics_by_{w}_without_e01": partial(_metrics_by, w, WITHOUT_E01) for w in ("rule", "family")}
    out |= {f"{f.__name__}_without_e01": partial(f, on=WITHOUT_E01) for f in (reinforcement_gate, records_of_detections, kpi_detection_without_lists, metrics_totals)}
    return out | {"family_encoding_without_e01": partial(_one_family, "encoding", WITHOUT_E01)}
