"""DuckDB SQL of the training-data queries that SQL can express; the others are tested against brute force."""

import unicodedata

from certloom.llm import glyphs, leakage

_BLANKS = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"


def _host(c: str) -> str:
    return f"lower(rtrim(regexp_replace({c}, {_BLANKS}, '', 'g'), '.'))"


def _hex(c: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(upper({c}), '[^0-9A-F]', '', 'g'), '^0+(.)', '\1'), '')"


def _label(c: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({c}, {_BLANKS}, '', 'g')), '[\s\p{{Z}}]+', ' ', 'g')"


_P1 = f"""
with h as (select event_id, unnest(domains) as v, generate_subscripts(domains, 1) - 1 as pos from cert_events),
k as (
  select event_id, 'serial_number' as key_field, -1 as pos, {_hex("serial_number")} as key from cert_events
  union all select event_id, 'domains', pos, {_host("v")} from h
  union all select -1, key_field, -1, case when key_field = 'serial_number' then {_hex("key_value")} else {_host("key_value")} end from earlier_keys
),
n as (select *, row_number() over (partition by key_field, key order by event_id, pos) as nth from k where key is not null and key <> '')
select cast(event_id as bigint) as event_id, key_field, cast(pos as integer) as key_pos from n where nth > 1 and event_id >= 0
"""

_P3 = f"""
with h as (select unnest(domains) as v from cert_events),
c as (
  select 'domains' as key_field, {_host("v")} as key_value, count(*) as n, 20 as k from h group by all
  union all
  select 'issuer_common_name', regexp_replace(issuer_common_name, {_BLANKS}, '', 'g'), count(*), 10 from cert_events group by all
),
r as (select *, row_number() over (partition by key_field order by n desc, key_value) as rank from c where key_value is not null and key_value <> '')
"""

_SETS = f"""
with h as (select cast(seen_at as date) as day, {_label("source")} as source, unnest(domains) as v from cert_events),
f as (select day, source, {_host("v")} as host from h)
"""

_P4 = (
    _SETS
    + """
select cast(day as varchar) as day, source, cast(grouping(f.day, f.source) as integer) as grouping, count(distinct host) as n_hosts, 0 as error_bound
from f where host is not null and host <> '' group by grouping sets ((f.day, f.source), (f.day), (f.source), ())
"""
)

_P4_RETURN = (
    _SETS
    + """
, s as (select distinct day, source, host from f where host is not null and host <> '')
select cast(a.day as varchar) as day, a.source as source, count(*) as n_hosts from s a join s b on a.source = b.source and a.host = b.host and b.day = a.day + 1 group by a.day, a.source
"""
)

_P5 = f"""
with v as (
  select distinct lower(regexp_replace(matched_watch_target, {_BLANKS}, '', 'g')) as watch_target, verdict_id, score
  from domain_verdicts where matched_watch_target is not null and score >= 0 and score <= 1 and not isnan(score)
),
r as (select *, row_number() over (partition by watch_target order by score desc, verdict_id) as n from v where watch_target <> '')
"""


_P9 = f"""
with t as (select {_label("source")} as source, target_share, max_repeats, case when target_share > 0 then target_share else 0 end as share,
  case when max_repeats is null then 1 when max_repeats > 0 then max_repeats else 0 end as most from mix_targets),
n as (
  select doc_id, {_label("source")} as source, greatest(coalesce(n_chars, 0), 0) as n_chars,
    cast('0x' || substr(md5(cast(doc_id as varchar) || ':0'), 1, 15) as bigint) as key
  from documents where doc_id is not null and text is not null
),
k as (select n.* from n semi join t on n.source = t.source),
a as (select t.*, coalesce((select sum(n_chars) from k where k.source = t.source), 0)::bigint as available_chars from t),
w as (select coalesce(floor(min(available_chars * most / share)), 0) as total from a where available_chars > 0 and most > 0 and share > 0),
b as (select a.*, cast(least(floor(share * total + 1e-6), available_chars * most) as bigint) as budget_chars from a, w),
e as (select *, case when available_chars > 0 then budget_chars // available_chars else 0 end as epochs,
  case when available_chars > 0 then budget_chars % available_chars else 0 end as rest from b),
p as (select k.*, sum(n_chars) over (partition by source order by key, doc_id rows unbounded preceding) as upto from k),
r as (select p.*, epochs + case when rest > 0 and upto <= rest then 1 else 0 end as repeats from p join e using (source))
"""

_P9_SHARES = (
    _P9
    + """
, m as (select source, sum(n_chars * repeats) as mixed from r group by source),
z as (select e.*, coalesce(mixed, 0) as mixed_chars from e left join m using (source))
select source, target_share, max_repeats, available_chars, budget_chars, cast(mixed_chars as bigint) as mixed_chars,
  round(case when sum(mixed_chars) over () > 0 then mixed_chars / sum(mixed_chars) over () else 0.0 end, 9) as share_reached from z
"""
)


def _form(c: str) -> str:
    """The one form of problem 10: mapped code point by code point, then composed by the engine."""
    t = glyphs.tables()
    one, gone, more = {}, [], {}
    for cp in map(int, t.moved.nonzero()[0]):
        to = unicodedata.normalize("NFC", "".join(map(chr, t.parts[t.start[cp] : t.start[cp] + int(t.length[cp])])))
        if to == chr(cp) or to == unicodedata.normalize("NFC", chr(cp)):
            continue  # the composition alone does it
        if not to:
            gone.append(chr(cp))
        elif len(to) == 1:
            one[chr(cp)] = to
        else:
            more[chr(cp)] = to
    q = lambda s: "'" + s.replace("'", "''") + "'"
    gone = [g for g in gone if g != "\0"]  # a text of SQL cannot hold it
    sql = f"translate({c}, {q(''.join(one) + ''.join(gone))}, {q(''.join(one.values()))})"
    for a, b in more.items():
        sql = f"replace({sql}, {q(a)}, {q(b)})"
    return f"nfc_normalize({sql})"


def _p8() -> str:
    n = leakage.MIN_WORDS
    grams = f"""select id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) as g"""
    return f"""
with t as (
  select 0 as kind, doc_id as id, text as x from documents where doc_id is not null and text is not null
  union all select 1, item_id, item_text from eval_items where item_id is not null and item_text is not null
),
w as (select kind, id, regexp_extract_all(lower({_form("x")}), '[\\p{{L}}\\p{{N}}]+') as w from t),
i as ({grams} from w where kind = 1 and len(w) >= {n}),
d as ({grams} from w where kind = 0 and len(w) >= {n})
select distinct d.id as doc_id, i.id as item_id from d join i using (g)
"""


def _p10() -> str:
    return f"with f as (select doc_id, text, {_form('text')} as form from documents where doc_id is not null and text is not null)"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p3_found": _P3 + "select key_field, key_value from r where rank <= k",
        "p3_heavy_counts": _P3 + "select key_field, cast(rank as integer) as rank, key_value, n as n_exact from r where rank <= k",
        "p4_distinct_hosts": _P4,
        "p4_returning_hosts": _P4_RETURN,
        "p8_found": _p8(),
        "p10_found": _p10() + " select a.doc_id as doc_id_a, b.doc_id as doc_id_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text",
        "p10_classes": _p10()
        + """, c as (select form, min(doc_id) as class_id, count(distinct text) as n_texts, count(*) as n_docs from f group by form)
select doc_id, class_id, n_texts, n_docs from f join c using (form)""",
        "p10_forms": _p10() + " select doc_id, form from f",
        "p9_mix_chars": _P9 + "select doc_id, source, cast(unnest(range(1, repeats + 1)) as integer) as epoch, n_chars from r where repeats > 0",
        "p9_shares_chars": _P9_SHARES,
        "p5_found": _P5 + "select watch_target, verdict_id from r where n <= 5",
        "p5_top_scores": _P5 + "select watch_target, verdict_id, score from r where n <= 5",
    }
