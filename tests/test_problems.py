"""Uneven keys, nested records and repeated deliveries: against brute force on small dirty tables."""

import os
import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from certloom.functions.text import hex_form, host_form, label_form
from certloom.operators import flatten, salted
from certloom.streaming import dedupe


def test_forms(spark):
    df = spark.createDataFrame([(" Ab.Com.. ", "  A   b ", "00:aB 0c"), ("x.y ", "", ":"), (None, None, None), ("\t*.A.com.", "É", "0")], "h string, l string, x string")
    got = df.select(host_form(F.col("h")), label_form(F.col("l")), hex_form(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("ab.com", "a b", "AB0C"), ("x.y", "", None), (None, None, None), ("*.a.com", "é", "0")]


EVENT = "event_id bigint, source string, issuer_organisation string, key_value string, _salt int, n int"


def test_salted_equals_plain(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["Hot", " hot", "HOT "] * 5 + ["a", "b", None, ""]), r.choice(["X  y", "x y", None]), "clash", 1, 2) for i in range(3000)]
    df = spark.createDataFrame(rows, EVENT)
    got = {(x.key_field, x.key_value): x.n_rows for x in salted.field_counts(df, ("source", "issuer_organisation")).collect()}
    form = lambda s: None if s is None else " ".join(s.lower().split())
    want = Counter(("source", form(x[1])) for x in rows) + Counter(("issuer_organisation", form(x[2])) for x in rows)
    assert got == want
    heavy = {tuple(x) for x in salted.frequent_values(df, ("source", "issuer_organisation"), 0.05).collect()}
    assert heavy == {k for k, n in want.items() if n >= 150 and k[1] is not None}
    none = spark.createDataFrame([], EVENT)
    assert salted.frequent_values(none, ("source",), 0.05).collect() == []
    one = salted.salted_aggregate(df.withColumn("k", label_form(F.col("source"))), "k", {"d": F.count_distinct("event_id")}, {"n": F.sum("d")}, F.col("event_id"))
    assert {x.k: x.n for x in one.collect()} == Counter(form(x[1]) for x in rows)


MESSAGE = "msg_id bigint, message_type string, delivered_at timestamp, data struct<update_type: string, cert_index: bigint, leaf_cert: struct<serial_number: string, all_domains: array<string>, fingerprint: string>>, parent_id int"
FINDING = "finding_id bigint, verdicts array<struct<domain: string, matched_watch_target: string, score: double, reasons: array<struct<family: string, rule: string, points: int>>>>, leaf_pos string"


def test_flatten(spark):
    messages = spark.createDataFrame(
        [
            (1, "x", None, ("u", 1, ("s", ["a", None, "b"], "f")), 0), (2, "x", None, ("u", 1, ("s", [], None)), 0), (3, "x", None, ("u", 1, ("s", None, None)), 0),
            (4, "x", None, None, 0), (5, "x", None, ("u", 1, None), 0), (6, None, None, ("u", 1, ("s", [None], "f")), 0), (7, "x", None, ("u", 1, ("s", ["q"] * 9000, "f")), 0),
        ],
        MESSAGE,
    )
    reason = ("f", "r", 1)
    findings = spark.createDataFrame(
        [(1, [("d", "t", 0.5, [reason, None, reason]), None, ("e", None, None, [])], "z"), (2, None, "z"), (3, [], "z"), (4, [None], "z"), (5, [("d", None, 1.0, None), ("d", None, 1.0, [None])], "z"), (5, [("d", None, 1.0, [reason])], "z")],
        FINDING,
    )
    got = Counter(tuple(r) for r in flatten.positions(messages, findings).collect())
    m = "raw_messages"
    want = Counter([(m, 1, 0, -1), (m, 1, 2, -1), *((m, k, -1, -1) for k in (2, 3, 5, 6)), *((m, 7, i, -1) for i in range(9000))])
    f = "findings"
    want += Counter([(f, 1, 0, 0), (f, 1, 0, 2), (f, 1, 2, -1), (f, 2, -1, -1), (f, 3, -1, -1), (f, 4, -1, -1), (f, 5, 0, -1), (f, 5, 1, -1), (f, 5, 0, 0)])
    assert got == want
    assert sorted(tuple(r) for r in flatten.message_hosts(messages.where("msg_id = 1")).collect()) == [(1, 0, "a"), (1, 2, "b")]
    assert Counter(tuple(r) for r in flatten.verdict_reasons(findings).collect()) == Counter([(1, 0, 0, "f", "r", 1), (1, 0, 2, "f", "r", 1), (5, 0, 0, "f", "r", 1)])
    assert flatten.finding_verdicts(findings).count() == 5
    assert flatten.positions(messages.limit(0), findings.limit(0)).collect() == []


@pytest.mark.parametrize("watermark", ["10 days", "1 second"])
def test_deduplication(spark, tmp_path, watermark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        key = (r.choice(["0a:0B", "A0B", "a0b", "7", None]), r.choice([1, 2, None]), r.choice(["u", "v"]), r.choice(["ff", None]))
        hot = i % 3 == 0
        data = ("u", 1, ("AA", None, "bb")) if hot else (key[2], key[1], (key[0], None, key[3]))
        rows.append((i if i % 50 else i + 1000, "heartbeat" if i % 20 == 7 else "certificate_update", None if i % 90 == 1 else f"2026-01-{1 + i % 28:02} 00:00:00", data, 0))
    df = spark.createDataFrame(rows, MESSAGE.replace("delivered_at timestamp", "delivered_at string")).withColumn("delivered_at", F.to_timestamp("delivered_at"))
    df.repartition(5).write.parquet(str(tmp_path / "m"))
    got = [tuple(x) for x in dedupe.copies_of(spark, str(tmp_path / "m"), watermark, 2).collect()]
    number = lambda s: None if s is None else s.replace(":", "").upper().lstrip("0")
    groups = defaultdict(list)
    for i, kind, _, d, _ in rows:
        if kind == "certificate_update":
            groups[d[0], d[1], number(d[2][0]), number(d[2][2])].append(i)
    assert len(got) == len(set(got)) and set(got) == {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    kept = [r.msg_id for r in dedupe.deduplicated(spark, str(tmp_path / "m"), watermark, 2).collect()]
    assert sorted(kept) == sorted(min(g) for g in groups.values())


def test_deduplication_of_nothing_and_restart(spark, tmp_path):
    empty = spark.createDataFrame([], MESSAGE)
    empty.coalesce(1).write.parquet(str(tmp_path / "e"))
    assert dedupe.copies_of(spark, str(tmp_path / "e")).collect() == []
    row = lambda i, s: (i, "certificate_update", datetime(2026, 1, i), ("u", 1, (s, None, "f")), 0)
    at, out, ck = str(tmp_path / "m"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([row(1, "a"), row(2, "b")], MESSAGE).write.parquet(at)
    for more in ([row(3, "a")], [row(4, "c")]):
        dedupe.run_to_end(spark, at, empty.schema, out, ck, 4)
        spark.createDataFrame(more, MESSAGE).write.mode("append").parquet(at)
    answers = dedupe.run_to_end(spark, at, empty.schema, out, ck, 4)
    assert sorted(r.msg_id for r in answers.where(F.col("kind") == dedupe.KEPT).collect()) == [1, 2, 4]
    assert [tuple(r) for r in dedupe.copies(answers).collect()] == [(1, 3)]


def _deliveries(spark, tmp_path, times):
    """One key delivered at the given days, one file each in this order; another key moves the watermark along."""
    at = str(tmp_path / "m")
    for i, day in enumerate(times):
        rows = [(2 * i, "certificate_update", datetime(2026, 1, day), ("u", 1, ("aa", None, "f")), 0), (2 * i + 1, "certificate_update", datetime(2026, 1, day), ("u", 1, (f"{min(day, 4):x}{i if day > 3 else 0}1", None, "f")), 0)]
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(f"{tmp_path}/one{i}")
        [part] = (tmp_path / f"one{i}").glob("*.parquet")
        (tmp_path / "m").mkdir(exist_ok=True)
        part.rename(tmp_path / f"m/{i}.parquet")
        os.utime(tmp_path / f"m/{i}.parquet", (10**9 + 100 * i, 10**9 + 100 * i))  # files come in the order of their times
    return at


def _run(spark, at, tmp_path, retention="10 days"):
    return dedupe.run_to_end(spark, at, spark.read.parquet(at).schema, str(tmp_path / "out"), str(tmp_path / "ck"), 4, retention, 1)


def test_expired_and_late_deliveries_are_looked_up(spark, tmp_path):
    # 0 is known for ten days: 2 and 4 find it, 6 is kept again and mended by the lookup; 5 and 9 are too late to be known
    at = _deliveries(spark, tmp_path, [1, 20, 2, 21, 2])
    answers = _run(spark, at, tmp_path)
    kinds = {r.msg_id: r.kind for r in answers.collect()}
    assert [kinds[i] for i in (0, 2, 4, 6, 8)] == [dedupe.KEPT, dedupe.COPY, dedupe.COPY, dedupe.KEPT, dedupe.COPY]
    assert kinds[5] == kinds[9] == dedupe.LATE and kinds[7] == dedupe.KEPT
    assert {tuple(r) for r in dedupe.copies(answers).collect()} == {(0, 2), (0, 4), (0, 6), (0, 8), (5, 9)}


def test_a_lost_state_store_is_noticed(spark, tmp_path, monkeypatch):
    real = dedupe._answer
    forget = _forgetful(real)
    monkeypatch.setattr(dedupe, "_answer", forget)
    monkeypatch.setattr(dedupe, "_decide", _with(dedupe._decide, forget))
    answers = _run(spark, _deliveries(spark, tmp_path, [1, 2, 3]), tmp_path)
    with pytest.raises(Exception, match="lost a key"):
        dedupe.copies(answers).collect()


def _forgetful(answer):
    return lambda held, *more: answer([x[:0] for x in held], *more)


def _with(decide, answer):
    """The bucket's function with another ``_answer``; workers import the module afresh, so it goes along by value."""

    def made(retention_ms):
        def run(key, frames, state):
            dedupe._answer = answer
            return decide(retention_ms)(key, frames, state)

        return run

    return made
