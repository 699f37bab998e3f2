"""DuckDB SQL of the detection queries. E-01 needs Punycode and character names, which SQL lacks: no SQL for it."""

from certloom.functions.psl import load_rules
from certloom.operators import watchlist as w
from certloom.operators.context import SHARED_HOSTING, TERMS
from certloom.operators.rules import TLD_LIKE
from certloom.plans.detection import DERIVED, LANDMARKS, RANK_TEMPLATES, WATCH_BUDGET

#: Queries with E-01 have no SQL; their SQL is that of the reduced query beside them, ``..._without_e01``.
_REDUCED = {
    "family_encoding", "metrics_by_rule", "metrics_by_family", "records_of_detections", "reinforcement_gate", "metrics_totals", "kpi_detection_without_lists",
}

_BLANKS = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"


def _list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def _set(kind: dict) -> str:
    names = ",".join(sorted(x for s in kind.values() for x in s))
    return f"select unnest(string_split('{names}', ',')) as rule"


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[.-]+'), lambda t: t <> '')"


def _derived() -> str:
    """The events of ``detection._with_derived`` beside cert_events."""
    brand = f"lower(regexp_replace(name, {_BLANKS}, '', 'g'))"
    made = ", ".join("'" + t.replace("{0}", "{}").replace("{}", f"' || {brand} || '") + "'" for t in DERIVED)
    return f"""(
  select event_id, source, serial_number, domains from cert_events
  union all
  select -row_number() over (order by name), null, null, list_concat([{made}], list_transform(coalesce(legitimate_domains, []), lambda x: 'shop.' || x))
  from watchlist where name is not null
)"""


def _hosts(skip: bool, events: str = "cert_events") -> str:
    keep = "where domain is not null" + (" and not list_contains(string_split(domain, '.'), '*')" if skip else "")
    return f"""
raw as (select event_id, source, serial_number, unnest(domains) as domain, generate_subscripts(domains, 1) - 1 as place from {events}),
h as (select event_id, source, serial_number, domain, row_number() over (partition by event_id order by place) - 1 as pos from raw {keep})"""


def _names(skip: bool = False, events: str = "cert_events", typos: bool = True) -> str:
    """``typos``: whether R-03 is asked for; else its pairs of names and brands are not compared."""
    r = load_rules()
    return f"""
with {_hosts(skip, events)},
plain as ({_set(r.plain)}), wild as ({_set(r.wild)}), exempt as ({_set(r.exempt)}),
d as (select distinct domain from h),
f as (select domain, lower(rtrim(regexp_replace(domain, {_BLANKS}, '', 'g'), '.')) as fqdn from d),
l as (select *, string_split(fqdn, '.') as ls, case when fqdn = '' then 0 else len(string_split(fqdn, '.')) end as n from f),
c as (select domain, n, ls, unnest(range(1, n + 1)) as k from l where n > 0),
c2 as (select *, array_to_string(ls[n - k + 1:n], '.') as cand, array_to_string(ls[n - k + 2:n], '.') as parent from c),
m as (
  select domain, max(case when p.rule is not null or v.rule is not null then k end) as hit, max(case when e.rule is not null then k - 1 end) as ex
  from c2 left join plain p on cand = p.rule left join wild v on parent = v.rule and k > 1 left join exempt e on cand = e.rule group by domain
),
s as (select l.*, coalesce(ex, hit, 0) as size from l left join m using (domain)),
legit as (select distinct unnest(legitimate_domains) as a from watchlist union select unnest({_list(SHARED_HOSTING)})),
allowed as (select distinct domain from c2 join legit on cand = a),
names as (
  select domain, fqdn, cast(n as integer) as n_labels,
    case when size > 0 then array_to_string(ls[n - size + 1:n], '.') else '' end as suffix,
    case when size > 0 and n > size and ls[n - size] <> '' then array_to_string(ls[n - size:n], '.') else '' end as registrable,
    case when size > 0 and n > size + 1 then array_to_string(ls[1:n - size - 1], '.')
      when size = 0 and n > 1 and not regexp_full_match(fqdn, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') then array_to_string(ls[1:n - 1], '.') else '' end as subdomain,
    case when size > 0 and n > size then ls[n - size] else '' end as core,
    domain in (select domain from allowed) as is_allowed
  from s
),
b as (select distinct lower(regexp_replace(name, {_BLANKS}, '', 'g')) as brand from watchlist where name is not null),
bl as (select list(brand) as brands from b),
ex as (select distinct unnest(regexp_extract_all(a, '[0-9]+')) as run from legit),
exl as (select coalesce(list(run), []) as runs from ex where len(run) >= 3),
cores as (select distinct core from names where len(core) between 4 and (select max(len(brand)) + 2 from b) and core not in (select brand from b){'' if typos else ' and false'}),
typo as (
  select distinct core from cores, b
  where abs(len(core) - len(brand)) <= case when len(brand) <= 5 then 1 else 2 end
    and levenshtein(core, brand) between 1 and case when len(brand) <= 5 then 1 else 2 end
),
t as (select names.*, {_tok("fqdn")} as tf, {_tok("core")} as tc, {_tok("subdomain")} as ts from names where not is_allowed),
p as (
  select t.*,
    subdomain <> '' and list_has_any(list_filter(ts, lambda x: not list_contains(tc, x)), brands) as r01,
    len(list_filter(range(1, len(tc)), lambda i: list_contains(brands, tc[i]) and list_contains({_list(TLD_LIKE)}, tc[i + 1]))) > 0 as r02,
    core in (select core from typo) as r03,
    len(list_filter(range(1, len(tc)), lambda i: (list_contains(brands, tc[i]) and list_contains({_list(TERMS["R-04"])}, tc[i + 1]))
      or (list_contains({_list(TERMS["R-04"])}, tc[i]) and list_contains(brands, tc[i + 1])))) > 0 as r04,
    list_has_any(tf, {_list(TERMS["L-01"])}) as l01, list_has_any(tf, {_list(TERMS["L-02"])}) as l02,
    subdomain <> 'www' and list_contains(tc, 'www') as l03, list_has_any(tf, {_list(TERMS["L-04"])}) as l04,
    len(list_filter(string_split(fqdn, '.'), lambda x: starts_with(x, 'xn--'))) > 0 as e02,
    len(fqdn) - len(replace(fqdn, '-', '')) >= 3 as m01, len(registrable) > 40 as m02, n_labels >= 4 as m03,
    len(list_filter(regexp_extract_all(fqdn, '\\p{{Nd}}+'), lambda r: len(r) >= 3 and not list_contains(runs, r))) > 0 as m04
  from t, bl, exl
),
fam as (
  select *, case when r01 then 'R-01' when r02 then 'R-02' when r03 then 'R-03' when r04 then 'R-04' end as referential,
    case when l01 then 'L-01' when l02 then 'L-02' when l03 then 'L-03' when l04 then 'L-04' end as lexical,
    case when e02 then 'E-02' end as encoding,
    case when m01 then 'M-01' when m02 then 'M-02' when m03 then 'M-03' when m04 then 'M-04' end as morphological
  from p
),
found as (
  select event_id, source, serial_number, cast(pos as integer) as pos, h.domain as domain,
    list_filter([referential, lexical, encoding, case when coalesce(referential, lexical, encoding) is not null then morphological end], lambda x: x is not null) as rs
  from h join fam on h.domain = fam.domain where coalesce(referential, lexical, encoding) is not null
)
"""


_FAMILY = "case left(x, 1) when 'R' then 'referential' when 'L' then 'lexical' when 'E' then 'encoding' else 'morphological' end"


def _totals(reasons: str, skip: bool = True) -> str:
    return f"""
, hits as (select cast({reasons} as bigint) as n_reasons, count(*) as n_hosts_found from found),
fed as (select count(distinct event_id) as n_certs, count(*) as n_domains from h)
select n_certs, n_domains, n_hosts_found, n_reasons, round(100.0 * n_reasons / n_domains, 6) as percent_of_domains from fed, hits
"""


def _rank() -> str:
    slug = "regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')"
    whens = " ".join(f"when {k} then '{t.split('{}')[0]}' || {slug} || cast(p_partkey as varchar) || '{t.split('{}')[1]}'" for k, t in enumerate(RANK_TEMPLATES))
    has = lambda xs: " or ".join(f"contains(label, '{x}')" for x in xs)
    sector = ""
    for s in w.SECTORS:
        p = w.SECTOR_PIECES[s]
        tests = [f"contains(label, '{x}')" for x in p["contains"]] + [f"starts_with(label, '{x}')" for x in p["prefix"]] + [f"ends_with(label, '{x}')" for x in p["suffix"]]
        tests += [f"contains(label, '-{x}') or contains(label, '{x}-')" for x in (*p["prefix"], *p["suffix"])]
        sector += f" when {' or '.join(tests)} then '{s}'"
    return f"""
with k0 as (select cast(p_partkey + 1 as integer) as rank, p_partkey, case p_partkey % {len(RANK_TEMPLATES)} {whens} end as d0 from part),
k as (select rank, case when p_partkey % 3 = 0 then 'www.' || d0 else d0 end as domain from k0),
k1 as (select *, string_split(domain, '.') as ls, len(string_split(domain, '.')) as n from k),
k2 as (select *, case when n >= 3 and list_contains({_list(w.TWO_LABEL_SUFFIXES)}, array_to_string(ls[n - 1:n], '.')) then 3 when n >= 2 then 2 else 1 end as z from k1),
sp as (select rank, domain, ls[n - z + 1] as label, array_to_string(ls[n - z + 1:n], '.') as registrable, case when n >= 2 then ls[n] else '' end as tld from k2),
cl as (
  select *, case when tld = 'us' then 'us' when list_contains({_list(w.EU_TLDS)}, tld) then 'eu' when list_contains({_list(w.GLOBAL_TLDS)}, tld) then 'global' end as region,
    case{sector} end as sector from sp
),
ok as (
  select rank, domain, label, registrable, region, sector from cl
  where domain <> '' and not list_contains({_list(w.DENIED)}, domain) and len(label) >= 3 and region is not null and sector is not null
    and not ({has((*w.NEGATIVE, *w.FOREIGN))})
),
fst as (select *, row_number() over (partition by registrable order by rank, domain) as nth from ok)
"""


_PARSE = """
select msg_id, m.leaf_cert.serial_number as serial_number, m.leaf_cert.signature_algorithm as signature_algo,
  nullif(m.leaf_cert.issuer.C, '') as issuer_country, nullif(m.leaf_cert.issuer.O, '') as issuer_organisation,
  coalesce(m.leaf_cert.issuer.CN, '') as issuer_common_name,
  cast(round(m.leaf_cert.not_before * 1000000) as bigint) as validity_not_before,
  cast(round(m.leaf_cert.not_after * 1000000) as bigint) as validity_not_after,
  array_to_string(list_transform(m.leaf_cert.all_domains, lambda x: coalesce(x, '\\N')), '|') as domains,
  coalesce(m.source.name, 'unknown') as source, m.cert_index as cert_index, coalesce(m.update_type = 'PrecertLogEntry', false) as is_precert
from (select msg_id, message_type, data as m from raw_messages)
where message_type = 'certificate_update' and m.leaf_cert.serial_number is not null and m.leaf_cert.signature_algorithm is not null
  and m.leaf_cert.all_domains is not null and m.leaf_cert.not_before is not null and m.leaf_cert.not_after is not null
"""

_INVALID = """
select msg_id from (select msg_id, message_type, data as m from raw_messages)
where message_type = 'certificate_update' and not coalesce(m.leaf_cert.serial_number is not null and m.leaf_cert.signature_algorithm is not null
  and m.leaf_cert.all_domains is not null and m.leaf_cert.not_before is not null and m.leaf_cert.not_after is not null, false)
"""

_STRIPPED = """
with s as (select *, list_filter(domains, lambda x: not list_contains(string_split(x, '.'), '*')) as kept from cert_events)
"""


def _landmarks() -> str:
    spans = ", ".join(f"('{k}', {v})" for k, v in LANDMARKS.items())
    return f"""
with c(checkpoint, s) as (values {spans}),
a as (select domains, epoch_us(seen_at) / 1e6 - (select min(epoch_us(seen_at)) / 1e6 from cert_events) as age from cert_events where seen_at is not null),
x as (select checkpoint, s, domains from c join a on age <= s),
u as (select checkpoint, count(distinct d) as n_unique from (select checkpoint, unnest(domains) as d from x) group by 1)
select x.checkpoint as checkpoint, count(*) as n_certs, cast(sum(coalesce(len(domains), 0)) as bigint) as n_domains, coalesce(any_value(n_unique), 0) as n_unique,
  round(count(*) / any_value(s), 9) as certs_per_second
from x left join u on x.checkpoint = u.checkpoint group by x.checkpoint
"""


def oracle_sql() -> dict[str, str]:
    all_names, kept, more = _names(typos=False), _names(skip=True), _names(events=_derived(), typos=False)
    typos = _names(events=_derived())
    rank = _rank()
    out = {
        "src_parse": _PARSE,
        "src_invalid": _INVALID,
        "wildcard_filter": _STRIPPED + "select event_id, array_to_string(kept, '|') as domains from s where len(kept) > 0",
        "san_explode": f"with {_hosts(False)} select event_id, cast(pos as integer) as pos, domain from h",
        "names_split": all_names + "select event_id, cast(pos as integer) as pos, fqdn, n_labels, suffix, registrable, subdomain from h join names using (domain)",
        "psl_suffix": all_names + "select suffix, count(*) as n from h join names using (domain) group by 1",
        "registrable_core": all_names + "select core, count(*) as n from h join names using (domain) group by 1",
        "tokenize": all_names + f"select token, count(*) as n from (select unnest({_tok('fqdn')}) as token from h join names using (domain)) group by 1",
        "allowlist_anti": more + "select event_id, cast(pos as integer) as pos, domain from h join names using (domain) where not is_allowed",
        "m04_exceptions": "select distinct run from (select unnest(regexp_extract_all(d, '[0-9]+')) as run from (select unnest(legitimate_domains) as d from watchlist)) where len(run) >= 3",
        "detect_without_e01": kept + "select event_id, pos, domain, array_to_string(rs, ',') as rules from found",
        "reinforcement_gate": kept + "select event_id, pos, array_to_string(rs, ',') as rules from found where array_to_string(rs, ',') like '%M-0%'",
        "rule_toggles_morph_only": kept + "select event_id, cast(pos as integer) as pos, domain, 'M-03' as rules from h join p using (domain) where m03",
        "records_of_detections": kept
        + f"select source, serial_number, domain, array_to_string(list_transform(rs, lambda x: {_FAMILY}), ',') as families, array_to_string(rs, ',') as rules from found",
        "records_raw": _STRIPPED + "select source, serial_number, array_to_string(kept, '|') as domains from s where len(kept) > 0",
        "kpi_totals": "select count(*) as n_certs, cast(coalesce(sum(len(domains)), 0) as bigint) as n_domains from cert_events",
        "kpi_unique_domains": "select count(distinct d) as n_unique from (select unnest(domains) as d from cert_events)",
        "kpi_by_source_topk": "select source, count(*) as n_certs, round(100.0 * count(*) / (select count(*) from cert_events), 6) as percent from cert_events group by 1 order by 2 desc, 1 limit 15",
        "kpi_landmarks": _landmarks(),
        "metrics_totals": kept + _totals("coalesce(sum(len(rs)), 0)"),
        "metrics_by_rule": kept + "select \"rule\", count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from (select unnest(rs) as \"rule\" from found) group by 1",
        "metrics_by_family": kept
        + f"select family, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from (select {_FAMILY} as family from (select unnest(rs) as x from found)) group by 1",
        "metrics_interval_delta": """with b as (select date_trunc('day', seen_at) as start, cast(sum(coalesce(len(domains), 0)) as bigint) as n_domains from cert_events where seen_at is not null group by 1)
select epoch_us(start) as start, n_domains, cast(sum(n_domains) over (order by start) as bigint) as n_so_far from b""",
        "events_by_interval": "select strftime(ts, '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by all",
        "wl_split_domain": rank + "select rank, label, registrable, tld from sp",
        "wl_region": rank + "select rank, region from cl",
        "wl_sector": rank + "select rank, sector from cl",
        "wl_candidates": rank + "select * from ok where registrable <> 'bankredwidget2.co.uk'",
        "wl_dedup": rank + "select rank, registrable, domain from fst where nth = 1",
        "wl_budget": rank + f"select rank, domain, sector from fst where nth = 1 order by rank, domain limit {WATCH_BUDGET}",
        "wl_sector_counts": rank + "select sector, count(*) as n from ok group by 1",
    }
    for rule in ("r01", "r02", "r03", "r04", "l01", "l02", "l03", "l04", "e02", "m01", "m02", "m03", "m04"):
        out[f"rule_{rule}"] = (typos if rule == "r03" else more) + f"select event_id, cast(pos as integer) as pos, domain from h join p using (domain) where {rule}"
    for family in ("referential", "lexical", "encoding", "morphological"):
        out[f"family_{family}"] = (typos if family == "referential" else more) + f'select event_id, cast(pos as integer) as pos, {family} as "rule" from h join fam using (domain) where {family} is not null'
    no_lists = f"""
, q as (select names.*, subdomain <> 'www' and list_contains({_tok("core")}, 'www') as l03, len(list_filter(string_split(fqdn, '.'), lambda x: starts_with(x, 'xn--'))) > 0 as e02,
  len(fqdn) - len(replace(fqdn, '-', '')) >= 3 or len(registrable) > 40 or n_labels >= 4 or len(list_filter(regexp_extract_all(fqdn, '\\p{{Nd}}+'), lambda r: len(r) >= 3)) > 0 as weak from names),
hits as (select cast(coalesce(sum(cast(l03 as integer) + cast(e02 as integer) + cast(weak as integer)), 0) as bigint) as n_reasons, count(*) as n_hosts_found from h join q using (domain) where l03 or e02),
fed as (select count(distinct event_id) as n_certs, count(*) as n_domains from h)
select n_certs, n_domains, n_hosts_found, n_reasons, round(100.0 * n_reasons / n_domains, 6) as percent_of_domains from fed, hits
"""
    out["kpi_detection_without_lists"] = kept + no_lists
    return {f"{q}_without_e01" if q in _REDUCED else q: sql for q, sql in out.items()}
