import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from certloom import cli
from certloom.operators import watchlist
from certloom.operators.context import make_context, read_watchlist
from certloom.sources import live, messages
from certloom.streaming import detection, feed_figures, tail
from tests.test_detection import SUFFIXES


def message(**leaf):
    cert = {"serial_number": "01", "signature_algorithm": "rsa", "not_before": 1731000000.5, "not_after": 1738776000, "all_domains": ["login-x.com", "*.y.com"]} | leaf
    return {"message_type": "certificate_update", "data": {"update_type": "PrecertLogEntry", "leaf_cert": {k: v for k, v in cert.items() if v is not None}}}


def test_replay(spark, tmp_path):
    full = message(issuer={"C": "", "O": "Org", "CN": None})
    full["data"] |= {"cert_index": 7, "source": {"name": "log"}}
    lines = [json.dumps(full), "", json.dumps({"message_type": "heartbeat"}), json.dumps(message(serial_number=None)), json.dumps(message())]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    read = messages.read_messages(spark, str(tmp_path / "c.jsonl"))
    a, b = messages.to_events(read).orderBy(F.desc("cert_index")).collect()
    assert (a.issuer_country, a.issuer_organisation, a.issuer_common_name, a.source, a.cert_index, a.is_precert) == (None, "Org", "", "log", 7, True)
    assert (b.issuer_common_name, b.source, b.cert_index) == ("", "unknown", None) and a.domains == ["login-x.com", "*.y.com"]
    assert messages.invalid_messages(read).count() == 1
    with pytest.raises(Exception, match="required field"):
        messages.to_events(read, strict=True).collect()
    (tmp_path / "bad.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        messages.read_messages(spark, str(tmp_path / "bad.jsonl")).collect()


def test_stream_writes_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(message()) + "\n{broken\n")
    ctx = make_context([], suffixes=SUFFIXES)
    for _ in range(2):
        events = messages.to_events(messages.stream_messages(spark, str(tmp_path / "in")))
        detection.start(events, str(tmp_path / "out"), str(tmp_path / "ck"), ctx).awaitTermination()
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.domain, r.rules) for r in rows] == [("login-x.com", ["L-04"])]


class ClosedByServer(Exception):
    """Like the client library's errors, none of Python's own."""


def test_live_feed_reconnects_and_drops_malformed_frames():
    script = iter(["connect", '{"a": 1}', "{bad", OSError("lost"), ClosedByServer("refused"), "connect", '{"b": 2}'])
    pauses = []

    def receive():
        step = next(script)
        if isinstance(step, Exception):
            raise step
        return step

    def connect(url, idle):
        step = next(script)
        if isinstance(step, Exception):
            raise step
        return receive

    feed = live.Feed("ws://x", 1, connect, pauses.append, (*live._lost(), ClosedByServer))
    assert list(feed.frames(2, 5)) == ['{"a": 1}', '{"b": 2}']
    assert pauses == [1.0, 2.0] and feed.backoff.pause == 1.0
    back = live.Backoff()
    assert [back.next() for _ in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_errors_of_the_client_library_are_waited_out(monkeypatch):
    import sys
    import types

    module = types.ModuleType("websockets.exceptions")
    module.WebSocketException = ClosedByServer
    monkeypatch.setitem(sys.modules, "websockets", types.ModuleType("websockets"))
    monkeypatch.setitem(sys.modules, "websockets.exceptions", module)
    assert ClosedByServer in live._lost() and ClosedByServer in live.Feed("ws://x").lost


def test_runs_add_to_one_output(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(message()))
    ctx = make_context([], suffixes=SUFFIXES)
    events = messages.to_events(messages.stream_messages(spark, str(tmp_path / "in")))
    shared = tmp_path / "shared"
    before = set(shared.glob("*")) if shared.exists() else set()
    for checkpoint in ("one", "two"):  # two runs from fresh checkpoints
        detection.start(events, str(tmp_path / "out"), str(tmp_path / checkpoint), ctx).awaitTermination()
    assert [r.domain for r in spark.read.json(str(tmp_path / "out")).collect()] == ["login-x.com"] * 2
    assert (set(shared.glob("*")) if shared.exists() else set()) == before

    # two replays by command line add too; a dash is standard output; terms and suffixes are read from the analysts' files
    run = cli.RunConfig(source="fixtures", detection=True, fixtures_path=str(tmp_path / "f.jsonl"), watchlist="none", rules_config="none", output=str(tmp_path / "o"))
    (tmp_path / "f.jsonl").write_text(json.dumps(message(all_domains=["login-x.com", "chase.secure-login.data.azure-api.net", "zap-x.com"])) + "\n")
    monkeypatch.setattr(cli, "TERMS_FILE", str(tmp_path / "t.yml"))
    monkeypatch.setattr(cli, "SHARED_HOSTING_FILE", str(tmp_path / "s.yml"))
    assert cli.watch(run, spark) == 0  # no terms file: no terms
    (tmp_path / "t.yml").write_text("terms:\n  l-01: [zap]\n  l-04: [login]\n")
    assert cli.watch(run, spark) == 3
    (tmp_path / "s.yml").write_text("suffixes: [azure-api.net]\n")
    assert cli.watch(run, spark) == 2
    assert spark.read.json(str(tmp_path / "o")).count() == 5
    run.output = "-"
    assert cli.watch(run, spark) == 2
    assert '"domain":"zap-x.com"' in capsys.readouterr().out and not (tmp_path / "-").exists()


def test_intermediate_tables_are_deleted(spark, tmp_path):
    from certloom import session

    with session.intermediates(spark):
        path = session.materialise(spark.range(3).toDF("x"), "t").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_feed_figures_at_landmarks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(message()) for _ in range(3)))
    shown = []
    feed_figures.at_landmarks(messages.to_events(messages.stream_messages(spark, str(tmp_path / "in"))), (10.0, 0.0), 5, shown.append)
    assert len(shown) == 2 and "certificates 0" in shown[0] and "certificates 3" in shown[1] and "hosts 6, 2 different" in shown[1] and "unknown" in shown[1]


def test_command_line(spark, tmp_path, capsys):
    assert cli.load_config(tmp_path / "none").detection is False
    (tmp_path / "c.yml").write_text("source: fixtures\ndetection: true\nmetrics_interval: 2.0\n")
    run = cli.settings(["watch", "--config", str(tmp_path / "c.yml"), "--no-skip-wildcards", "--output", str(tmp_path / "o")])
    assert (run.source, run.detection, run.skip_wildcards, run.metrics_interval) == ("fixtures", True, False, 2.0)
    with pytest.raises(SystemExit):
        cli.settings(["watch", "--source", "nowhere", "--config", "none"])
    (tmp_path / "f.jsonl").write_text(json.dumps(message()) + "\n")
    run.fixtures_path, run.watchlist, run.rules_config = str(tmp_path / "f.jsonl"), str(tmp_path / "none"), str(tmp_path / "none")
    assert cli.watch(run, spark) == 1
    run.output, run.metrics = None, True
    assert cli.watch(run, spark) == 1
    assert "done: 1 detection(s)" in capsys.readouterr().err


def test_watchlist_builder(spark):
    seed = {"banking": {"us": {" Chase ": ["chase.com"]}, "eu": {"mybank": ["mybank.co.uk"]}}}
    ranking = ["x.mybank.co.uk", "foo-bank.de", "foo-bank.com", "www.foo-bank.de", "banknews.com", "bank.us", "ab.de", "clinicone.ru", "clinicone.fr", "paypalobjects.com", "mybank.de", "foo-bank.fr", "hosting.uk"]
    df = spark.createDataFrame(list(enumerate(ranking, 1)), "rank int, domain string")
    entries = lambda most: watchlist.build(spark, seed, df, most).orderBy("tier", "place", "rank").collect()
    assert [(e["name"], e["sector"], e["region"], e["legitimate_domains"]) for e in entries(100)] == [
        ("chase", "banking", "us", ["chase.com"]), ("mybank", "banking", "eu", ["mybank.co.uk"]), ("foo-bank", "banking", "eu", ["foo-bank.de"]),
        ("foo-bank-com", "banking", "global", ["foo-bank.com"]), ("bank", "banking", "us", ["bank.us"]), ("clinicone", "health", "eu", ["clinicone.fr"]),
        ("mybank-de", "banking", "eu", ["mybank.de"]), ("foo-bank-fr", "banking", "eu", ["foo-bank.fr"]), ("hosting", "it_services", "eu", ["hosting.uk"]),
    ]
    assert len(entries(4)) == 4
    with pytest.raises(ValueError):
        watchlist.build(spark, seed, df, 1)
    with pytest.raises(ValueError, match="twice"):
        watchlist.core_brands(spark, {"banking": {"us": {"A": ["a.com"]}, "eu": {" a": []}}})


def test_names_in_rank_order_equal_one_pass(spark):
    r = random.Random(11)
    pieces = ["foo", "bar", "foo-bar", "foo-com", "bar-de", "foo-bar-com", "foo-com-de", "bar-de-com"]
    rows = {f"{r.choice(pieces)}.{r.choice(['com', 'de', 'com.de', 'de.com'])}": i for i in range(60)}
    rows = [(rank, d, d.split(".")[0], d, "eu", "banking") for d, rank in rows.items()]
    held, want = {"bar"}, {}
    for _, d, label, reg, *_ in sorted(rows):
        for name in (label, reg.replace(".", "-")):
            if name not in held:
                held.add(name)
                want[d] = name
                break
    df = spark.createDataFrame(rows, "rank int, domain string, label string, registrable string, region string, sector string")
    got = {x.domain: x.name for x in watchlist.with_names(df, spark.createDataFrame([("bar",)], "name string")).collect()}
    assert got == want and len(want) < len(rows) and any(n == d.replace(".", "-") for d, n in want.items())


def test_sector_patterns_equal_their_definition(spark):
    r = random.Random(4)
    pieces = [t for p in watchlist.SECTOR_PIECES.values() for ts in p.values() for t in ts]
    labels = ["".join(r.choice([r.choice(pieces), "-", "x", "a"]) for _ in range(r.randint(1, 4))) for _ in range(500)]

    def plain(label):
        for s in watchlist.SECTORS:
            p = watchlist.SECTOR_PIECES[s]
            seg = lambda t: f"-{t}" in label or f"{t}-" in label
            if any(t in label for t in p["contains"]) or any(label.startswith(t) or seg(t) for t in p["prefix"]) or any(label.endswith(t) or seg(t) for t in p["suffix"]):
                return s
        return None

    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", watchlist.sector_of(F.col("x")).alias("s")).collect()
    assert all(g.s == plain(g.x) for g in got)


def test_other_commands(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("\n".join(json.dumps(m) for m in (message(), message(all_domains=["login-x.com", "xn--80ak6aa92e.com"]))))
    text = cli.kpis(spark, str(tmp_path / "f.jsonl"), 3)
    assert "certs:   2" in text and "4 total, 3 unique" in text and "unknown" in text and "detections without lists: 1 " in text
    (tmp_path / "seed.yml").write_text("banking:\n  us:\n    chase: [chase.com]\n")
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("top.csv", "1,foo-bank.de\n2,x.com\n3\n4, Klinik.fr\n")
    counts = cli.build_watchlist(spark, str(tmp_path / "seed.yml"), str(tmp_path / "r.zip"), str(tmp_path / "w.yml"))
    assert counts == {"banking": 2, "health": 1, "insurance": 0, "it_services": 0}
    assert [n for n, _ in read_watchlist(tmp_path / "w.yml")] == ["chase", "foo-bank", "klinik"]


def test_tail(spark, tmp_path):
    (tmp_path / "o/batch=0").mkdir(parents=True)
    detection_line = {"detected_at": "2026-01-02T03:04:05.000000+00:00", "source": "log", "serial_number": "1", "domain": "a.com", "families": ["lexical"], "rules": ["L-04", "M-01"]}
    raw = {"detected_at": "2026-01-02T03:04:06.000000+00:00", "source": "log", "serial_number": "1", "domains": ["a.com", "b.com"]}
    (tmp_path / "o/batch=0/p.json").write_text(json.dumps(detection_line) + "\n{bad\n" + json.dumps(raw) + "\n")
    for start, n in ((True, 2), (False, 0)):
        lines = []
        tail.follow(spark, str(tmp_path / "o"), lines.append, start, {"availableNow": True}).awaitTermination()
        assert len(lines) == n
        if lines:
            assert lines[0].startswith("03:04:05  L-04,M-01") and "a.com, b.com" in lines[1]


def test_incomplete_messages_are_reported(spark, tmp_path, monkeypatch, capsys):
    lines = [json.dumps(m) for m in (message(), message(all_domains=None), message(serial_number=None), {"message_type": "heartbeat"})]
    (tmp_path / "f.jsonl").write_text("\n".join(lines))
    text = cli.kpis(spark, str(tmp_path / "f.jsonl"), 3)
    assert "certs:   1" in text and "incomplete certificate messages put aside: 2" in text
    aside, got = {}, []
    write = detection.message_writer(lambda events, n: got.append((n, events.count())), aside)
    for n in (0, 1, 1):  # the last one is run again
        write(messages.read_messages(spark, str(tmp_path / "f.jsonl")), n)
    assert aside == {0: 2, 1: 2} and got == [(0, 1), (1, 1), (1, 1)]

    # the live watch from end to end, over a feed that ends
    monkeypatch.setattr(messages, "parse_frames", lambda frames: messages.stream_messages(spark, str(tmp_path / "in")))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines))
    waits = iter([False])

    def wait(self, timeout=None):
        self.processAllAvailable()
        if next(waits, None) is None:
            raise KeyboardInterrupt
        return False

    monkeypatch.setattr("pyspark.sql.streaming.StreamingQuery.awaitTermination", wait)
    assert cli.watch(cli.RunConfig(watchlist=str(tmp_path / "none"), output=str(tmp_path / "o")), spark) == 1
    assert "incomplete certificate messages put aside: 2" in capsys.readouterr().err
