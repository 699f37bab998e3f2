"""Queries of the general data problems (uneven keys, repeated deliveries, nested records) and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions.text import hex_form
from certloom.operators import flatten, salted
from certloom.session import table
from certloom.streaming import dedupe

FIELDS = ("source", "issuer_organisation")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return salted.frequent_values(table(spark, d, "cert_events"), FIELDS, 0.05)


def _profiled(spark: SparkSession, d: str, field: str) -> DataFrame:
    """Times as microseconds since the epoch, which compare alike everywhere."""
    rows = salted.field_profile(table(spark, d, "cert_events"), field, hex_form(F.col("serial_number")))
    return rows.withColumn("first_seen", F.unix_micros("first_seen")).withColumn("last_seen", F.unix_micros("last_seen"))


def p2_source_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(spark, d, "source")


def p2_organisation_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(spark, d, "issuer_organisation")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.copies_of(spark, f"{d}/raw_messages.parquet")


def p6_messages(spark: SparkSession, d: str) -> DataFrame:
    """The deduplicated messages; of their columns some flat ones are shown."""
    kept = dedupe.deduplicated(spark, f"{d}/raw_messages.parquet")
    leaf = F.col("data.leaf_cert")
    return kept.select("msg_id", "batch_id", F.col("data.update_type").alias("update_type"), leaf["serial_number"].alias("serial_number"), F.array_size(leaf["all_domains"]).alias("n_hosts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.positions(table(spark, d, "raw_messages"), table(spark, d, "findings"))


def p7_message_hosts(spark: SparkSession, d: str) -> DataFrame:
    return flatten.message_hosts(table(spark, d, "raw_messages"))


def p7_finding_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return flatten.finding_verdicts(table(spark, d, "findings"))


def p7_verdict_reasons(spark: SparkSession, d: str) -> DataFrame:
    return flatten.verdict_reasons(table(spark, d, "findings"))


def queries() -> dict:
    named = [p2_found, p2_source_profile, p2_organisation_profile, p6_found, p6_messages, p7_found, p7_message_hosts, p7_finding_verdicts, p7_verdict_reasons]
    return {f.__name__: f for f in named}


def _label(c: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '[\s\p{{Z}}]+', ' ', 'g')"


def _hex(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(upper({c}), '[^0-9A-F]', '', 'g'), '^0+(.)', '\1'), '')"


_P2 = f"""
with k as (
  select 'source' as key_field, {_label("source")} as key_value from cert_events
  union all select 'issuer_organisation', {_label("issuer_organisation")} from cert_events
)
select key_field, key_value from k where key_value is not null
group by all having count(*) >= 0.05 * (select count(*) from cert_events)
"""


def _profile(field: str) -> str:
    return f"""
select {_label(field)} as key_value, count(*) as n_rows, count(*) filter (is_precert) as n_precerts,
  cast(sum(coalesce(len(domains), 0)) as bigint) as n_hosts, epoch_us(min(seen_at)) as first_seen, epoch_us(max(seen_at)) as last_seen,
  count(distinct {_hex("serial_number")}) as n_distinct
from cert_events where {field} is not null group by 1
"""


_KEPT = f"""
with k as (
  select msg_id, batch_id, data, data.update_type as u, data.cert_index as c, {_hex("data.leaf_cert.serial_number")} as s, {_hex("data.leaf_cert.fingerprint")} as f
  from raw_messages where message_type = 'certificate_update'
),
g as (select *, min(msg_id) over (partition by u, c, s, f) as kept_id from k)
"""
_P6 = _KEPT + "select distinct kept_id, msg_id as copy_id from g where kept_id <> msg_id"
_P6_MESSAGES = (
    _KEPT
    + """
select msg_id, batch_id, data.update_type as update_type, data.leaf_cert.serial_number as serial_number, cast(len(data.leaf_cert.all_domains) as integer) as n_hosts
from g where kept_id = msg_id
"""
)

_PLACES = """
with m as (select msg_id, data.leaf_cert.all_domains as a from raw_messages where data is not null),
mx as (select msg_id, unnest(a) as host, generate_subscripts(a, 1) - 1 as p from m where len(a) > 0),
mg as (select * from mx where host is not null),
f as (select finding_id, verdicts as v from findings),
fx as (select finding_id, unnest(v) as x, generate_subscripts(v, 1) - 1 as p from f where len(v) > 0),
fg as (select * from fx where x is not null),
fr as (select finding_id, p, unnest(x.reasons) as r, generate_subscripts(x.reasons, 1) - 1 as q from fg where len(x.reasons) > 0),
frg as (select * from fr where r is not null)
"""

_P7 = (
    _PLACES
    + """
select 'raw_messages' as parent_table, msg_id as parent_id, cast(p as integer) as child_pos, cast(-1 as integer) as leaf_pos from mg
union all select 'raw_messages', msg_id, -1, -1 from m anti join mg using (msg_id)
union all select 'findings', finding_id, p, q from frg
union all select 'findings', finding_id, p, -1 from fg anti join frg using (finding_id, p)
union all select 'findings', finding_id, -1, -1 from f anti join fg using (finding_id)
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p2_source_profile": _profile("source"),
        "p2_organisation_profile": _profile("issuer_organisation"),
        "p6_found": _P6,
        "p6_messages": _P6_MESSAGES,
        "p7_found": _P7,
        "p7_message_hosts": _PLACES + "select msg_id, cast(p as integer) as host_pos, host from mg",
        "p7_finding_verdicts": _PLACES + "select finding_id, cast(p as integer) as verdict_pos, x.domain as domain, x.matched_watch_target as matched_watch_target, x.score as score from fg",
        "p7_verdict_reasons": _PLACES
        + 'select finding_id, cast(p as integer) as verdict_pos, cast(q as integer) as reason_pos, r.family as family, r.rule as "rule", r.points as points from frg',
    }
