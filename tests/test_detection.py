"""Rule, name and pipeline cases, table-driven over one DataFrame each."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from certloom.functions.psl import parse_rules, with_names
from certloom.operators import context as contexts
from certloom.operators import kpis, rules
from certloom.operators.context import RULES, DetectContext, default_terms, make_context, read_rules, read_terms, read_watchlist
from certloom.operators.detect import detect, detection_records, strip_wildcards
from certloom.plans import detection

#: A small list in the public format: the suffixes that the cases need.
LIST = "com\nnet\ninfo\norg\nio\nxyz\njp\nck\nuk\nco.uk\npages.dev\n*.kawasaki.jp\n!city.kawasaki.jp\n*.ck\n!www.ck\n// note\nрф\n"
SUFFIXES = parse_rules(LIST)


def found(spark, cases, ctx, skip=True):
    events = spark.createDataFrame([(i, c if isinstance(c, list) else [c]) for i, c in enumerate(cases)], "id int, domains array<string>")
    rows = detect(events, ctx, skip).select("id", "pos", F.transform("reasons", lambda r: r["rule"]).alias("rules")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.pos):
        out.setdefault(r.id, []).append(list(r.rules))
    return [out.get(i, []) for i in range(len(cases))]


def context(brands=(), terms=None, only=None, allow=(), digits=()):
    return DetectContext(frozenset(brands), frozenset(allow), frozenset(digits), terms or {}, only and frozenset(only), SUFFIXES)


def test_names(spark):
    cases = {
        "login.micro.foo.co.uk": ("foo.co.uk", "co.uk", "login.micro", "foo", 5),
        "beargummy.pages.dev": ("beargummy.pages.dev", "pages.dev", "", "beargummy", 3),
        "co.uk": ("", "co.uk", "", "", 2),
        "a.b.example": ("", "", "a.b", "", 3),
        "localhost": ("", "", "", "", 1),
        "192.168.1.10": ("", "", "", "", 4),
        "x.y.kawasaki.jp": ("x.y.kawasaki.jp", "y.kawasaki.jp", "", "x", 4),
        "a.city.kawasaki.jp": ("city.kawasaki.jp", "kawasaki.jp", "a", "city", 4),
        "www.ck": ("www.ck", "ck", "", "www", 2),
        "foo.ck": ("", "foo.ck", "", "", 2),
        "a.foo.ck": ("a.foo.ck", "foo.ck", "", "a", 3),
        " Www.Example.COM.. ": ("example.com", "com", "www", "example", 3),
        "": ("", "", "", "", 0),
        "xn--e1afmkfd.xn--p1ai": ("xn--e1afmkfd.xn--p1ai", "xn--p1ai", "", "xn--e1afmkfd", 2),
    }
    df = spark.createDataFrame([(c,) for c in cases], "d string")
    got = {r.d: (r.registrable, r.suffix, r.subdomain, r.core, r.n_labels) for r in with_names(df, "d", SUFFIXES).collect()}
    assert got == cases


@pytest.mark.parametrize("big", [False, True])
def test_referential(spark, big):
    # with many brands the sets go through the bit table instead of a literal list
    more = {f"zzbrand{i:04}zz" for i in range(500)} if big else set()
    ctx = context({"microsoft", "paypal", "amazon", "axa", *more}, {"R-04": frozenset({"login"})}, ["R-01", "R-02", "R-03", "R-04"])
    cases = {
        "microsoft.login-example.com": ["R-01"], "microsoft.microsoft-help.com": [], "microsoft.com": [], "paypal-com-login.info": ["R-02"],
        "com-paypal-login.info": ["R-04"], "micros0ft.com": ["R-03"], "arnazon.net": ["R-03"], "mmiiccrroosoft.com": [], "axaa.com": ["R-03"],
        "data.com": [], "paypal-login.net": ["R-04"], "login-paypal.net": ["R-04"], "paypal.arnazon.net": ["R-01"], "micorsoft.com": ["R-03"],
        "paypal.xyz": [], "mymicrosoft.com": ["R-03"], "paypal-com-login.example": ["R-01"],
    }
    got = found(spark, list(cases), ctx)
    assert dict(zip(cases, [r[0] if r else [] for r in got])) == cases


def test_typo_cores_equal_brute_force(spark):
    import random

    r = random.Random(3)
    brands = frozenset("".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60))
    cores = ["".join(r.choice("abc") for _ in range(r.randint(1, 11))) for _ in range(400)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {c for c in cores if len(c) > 3 and c not in brands and any(1 <= distance(c, b) <= (1 if len(b) <= 5 else 2) for b in brands)}
    got = rules.typo_cores(spark.createDataFrame([(c,) for c in cores], "core string"), brands).collect()
    assert {x.core for x in got} == want and len(got) == len(want)


def test_lexical_encoding_morphological(spark):
    terms = {"L-01": frozenset({"mfa"}), "L-02": frozenset({"invoice"}), "L-04": frozenset({"login"})}
    cases = {
        "mfa-example.com": ["L-01"], "invoice-example.com": ["L-02"], "login-example.com": ["L-04"], "www-example-login.com": ["L-03"],
        "www.example.com": [], "www.www-x.com": [], "mfa-login-example.com": ["L-01"], "xn--pypal-4ve.com": ["E-01", "M-01"],
        "xn--80ak6aa92e.com": ["E-02"], "pаypal.com": ["E-01"], "日本カ.jp": ["E-01"], "xn--a.com": ["E-02"], "wxn--x.com": [],
    }
    got = found(spark, list(cases), context(terms=terms))
    assert dict(zip(cases, [r[0] if r else [] for r in got])) == cases
    weak = {
        "a-b-c.com": [], "a-b-c-d.com": ["M-01"], "a" * 36 + ".com": [], "a" * 37 + ".com": ["M-02"], "a.b.com": [], "a.b.c.com": ["M-03"],
        "ab12.com": [], "ab123.com": ["M-04"], "office365.com": [], "office365-auth-92834.net": ["M-04"], "x3654.com": ["M-04"],
    }
    got = found(spark, list(weak), context(only=["M-01", "M-02", "M-03", "M-04"], digits={"365"}))
    assert dict(zip(weak, [r[0] if r else [] for r in got])) == weak


def test_pipeline(spark):
    brands = [("chase", ["chase.com"]), (" Microsoft ", ["microsoft.com", "office365.com"])]
    ctx = make_context(brands, suffixes=SUFFIXES)
    assert ctx.digit_exceptions == {"365"} and "microsoft" in ctx.brands
    cases = [
        "x-a-b-c-d.com", "microsoft.secure-a-b-c-d.com", "chase.secure-login-verify-my.example.com", "chase.a.b.c.example.com",
        "chase.secure-login.data.azure-api.net", "sub.microsoft.com", ["*.foo.com"], ["login-x.com", "login-x.com", "w*.login.com"],
    ]
    got = found(spark, cases, ctx)
    assert got[:1] + got[2:7] == [[], [["R-01", "L-04", "M-01"]], [["R-01", "M-03"]], [], [], []]
    assert got[1][0][0] == "R-01" and got[1][0][-1] == "M-01"
    assert got[7] == [["L-04"]] * 3  # repeats stay; w*.login.com is no wildcard
    only = make_context(brands, rules=frozenset({"M-03"}), suffixes=SUFFIXES)
    assert found(spark, cases[2:4], only) == [[["M-03"]], [["M-03"]]]


def test_records_and_metrics(spark):
    events = spark.createDataFrame(
        [("s1", "A", ["login-a-b-c.com", "*.x.com"]), ("s2", None, []), ("s3", "A", None), ("s4", "B", ["plain.com", None, "otp-x.net"])],
        "serial_number string, source string, domains array<string>",
    )
    assert [r.serial_number for r in strip_wildcards(events).orderBy("serial_number").collect()] == ["s1", "s4"]
    ctx = context(terms=default_terms())
    hits = detect(events, ctx)
    rows = {r.domain: (r.source, r.families, r.rules) for r in detection_records(hits).collect()}
    assert rows == {"login-a-b-c.com": ("A", ["lexical", "morphological"], ["L-04", "M-01"]), "otp-x.net": ("B", ["lexical"], ["L-01"])}
    total = kpis.detection_totals(events, hits).first()
    assert (total.n_certs, total.n_domains, total.n_hosts_found, total.n_reasons) == (4, 5, 2, 3)
    assert {r.family: r.n for r in kpis.reasons_by(hits, "family").collect()} == {"lexical": 2, "morphological": 1}
    assert [kpis.duration_text(s) for s in (2e-6, 0.004, 3.5, None)] == ["2us", "4.0ms", "3.50s", "-"]


def test_configuration_files(tmp_path):
    assert read_rules(tmp_path / "none.yml") == frozenset(RULES) and read_watchlist(tmp_path / "none") == [] and read_terms(tmp_path / "none") == {}
    (tmp_path / "r.yml").write_text("rules:\n  R-01: true\n  M-01: false\n")
    assert read_rules(tmp_path / "r.yml") == {"R-01"}
    (tmp_path / "bad.yml").write_text("rules:\n  X-01: true\n")
    with pytest.raises(ValueError):
        read_rules(tmp_path / "bad.yml")
    (tmp_path / "t.yml").write_text("terms:\n  l-01: [' MFA ', otp]\n")
    assert read_terms(tmp_path / "t.yml") == {"L-01": {"mfa", "otp"}}


#: Hosts of a small feed, and the rules each has to be found by: scripts mixed under and outside xn--.
FEED = {
    "xn--pypal-4ve.com": ["E-01", "M-01"], "xn--80ak6aa92e.com": ["E-02"], "pаypal.com": ["E-01"], "login-pаypal.com": ["L-04", "E-01"],
    "a.b.pаypal.com": ["E-01", "M-03"], "plain.com": [], "a-b-c-d.com": [], "*.xn--pypal-4ve.com": [],
}


def test_queries_run_with_all_rules(spark, tmp_path):
    events = [(i, "log", str(i), [d]) for i, d in enumerate(FEED)]
    spark.createDataFrame(events, "event_id bigint, source string, serial_number string, domains array<string>").write.parquet(str(tmp_path / "cert_events.parquet"))
    spark.createDataFrame([("zzbrandzz", ["zzbrandzz.org"])], "name string, legitimate_domains array<string>").write.parquet(str(tmp_path / "watchlist.parquet"))
    run = lambda q: detection.queries()[q](spark, str(tmp_path)).collect()
    place = {d: i for i, d in enumerate(FEED)}
    family = lambda rs: {"L": "lexical", "E": "encoding", "M": "morphological"}[rs[0]]
    hits = {d: rs for d, rs in FEED.items() if rs}
    said = [r for rs in hits.values() for r in rs]
    encoding = {(place[d], r) for d, rs in hits.items() for r in rs if r[0] == "E"} | {(place["*.xn--pypal-4ve.com"], "E-01")}  # wildcards stay in this query
    assert {(x.event_id, x["rule"]) for x in run("family_encoding")} == encoding
    assert {(x.domain, x.families, x.rules) for x in run("records_of_detections")} == {(d, ",".join(map(family, rs)), ",".join(rs)) for d, rs in hits.items()}
    assert {(x.event_id, x.rules) for x in run("reinforcement_gate")} == {(place[d], ",".join(rs)) for d, rs in hits.items() if rs[-1][0] == "M"}
    assert {x["rule"]: x.n for x in run("metrics_by_rule")} == Counter(said)
    assert {x.family: x.n for x in run("metrics_by_family")} == Counter(map(family, said))
    [total] = run("metrics_totals")
    assert (total.n_hosts_found, total.n_reasons) == (len(hits), len(said))
    [plain] = run("kpi_detection_without_lists")  # no terms: L-04 is not there
    assert (plain.n_hosts_found, plain.n_reasons) == (len(hits), len(said) - 1)
    assert {x["rule"]: x.n for x in run("metrics_by_rule_without_e01")} == {"E-02": 2, "L-04": 1, "M-01": 1}


def test_watchlist_is_read_whole(spark):
    rows = [(f" Brand{i} " if k else f"BRAND{i}", [f"b{i}.com", None]) for i in range(10) for k in range(5)] + [(None, ["no.com"]), ("brand0", None)]
    table = spark.createDataFrame(rows, "name string, legitimate_domains array<string>")
    ctx = contexts.context_of_table(table, suffixes=SUFFIXES)
    assert ctx.brands == {f"brand{i}" for i in range(10)} and ctx.allowlist == {f"b{i}.com" for i in range(10)} | set(contexts.SHARED_HOSTING)


def test_large_sets_are_joined(spark, monkeypatch):
    # the same cases with all sets joined as tables instead of carried by the plan
    monkeypatch.setattr(rules, "IN_PLAN", 0)
    monkeypatch.setattr("certloom.functions.psl.MOST_FACTS", 0)
    test_referential(spark, False)
    test_pipeline(spark)
    ctx = context(only=["M-04"], digits={"365"})
    assert found(spark, ["office365.com", "office365-92834.net", "x3654.com"], ctx) == [[], [["M-04"]], [["M-04"]]]


def test_deep_allowlisted_names(spark):
    deep = "a.b.c.d.e.f.g.login.com"
    ctx = context(terms={"L-04": frozenset({"login"})}, allow={deep, "login-ok.com"})
    assert found(spark, [deep, "x." + deep, "b.c.d.e.f.g.login.com", "login-ok.com", "login-no.com"], ctx) == [[], [], [["L-04", "M-03"]], [], [["L-04"]]]


def test_membership_in_constants(spark):
    import random

    r = random.Random(5)
    values = {"".join(r.choice("ab\n\x01\x02é") for _ in range(r.randint(0, 6))) for _ in range(300)}
    tried = sorted(values)[::2] + ["".join(r.choice("ab\n\x01\x02é") for _ in range(r.randint(0, 6))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(x,) for x in tried], "x string")
    for some in (values, set(sorted(values)[:5]), {v for v in values if "\x01" not in v and "\x02" not in v}, set()):
        got = df.select("x", rules._among(F.col("x"), some).alias("y")).collect()
        assert all(bool(g.y) == (g.x in some) for g in got)
