"""Training-data operators against brute force, on small dirty tables with nulls, ties, repeats and clashing columns."""

import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from certloom.llm import bitmaps, fm_index, glyphs, heavy_hitters, leakage, mixing, queries, seen_keys, topn
from certloom.llm.fm_index import FMIndex
from certloom.llm.peeling import PeelingFilter

EVENT = "event_id bigint, serial_number string, domains array<string>, h string, pos int, key string"
EARLIER = "key_field string, key_value string, h int"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.sampled_from([8, 16, 32]))
def test_peeling_filter_has_no_false_negatives(keys, bits):
    f = PeelingFilter(np.array(keys, dtype=np.uint64), bits)
    assert f.contains(np.array(keys, dtype=np.uint64)).all()


def test_peeling_filter_error_rate():
    r = np.random.default_rng(1)
    f = PeelingFilter(r.integers(0, 2**63, 20000, dtype=np.uint64), 8)
    rate = f.contains(r.integers(0, 2**63, 200000, dtype=np.uint64)).mean()
    assert abs(rate - f.false_positive_rate) < 0.001 and f.nbytes < 1.3 * f.n


@pytest.mark.parametrize("bits", [8, 32])
def test_seen_keys(spark, bits):
    r = random.Random(bits)
    host = lambda: r.choice(["hot.com", " HOT.com. ", f"h{r.randint(0, 900)}.net", None, " ", f"H{r.randint(0, 900)}.net."])
    rows = [(i, r.choice([f"{r.randint(0, 400):x}", f"00:{r.randint(16, 255):x}", None, "zz"]), [host() for _ in range(r.randint(0, 4))] if i % 9 else None, "c", 1, "c") for i in range(1500)]
    early = [(r.choice(["serial_number", "domains", "other", None]), r.choice([host(), f"{r.randint(0, 99):X}"]), 1) for _ in range(300)]
    events, earlier = spark.createDataFrame(rows, EVENT), spark.createDataFrame(early, EARLIER)
    form = lambda d: d.strip().rstrip(".").lower()
    num = lambda s: re.sub("[^0-9A-F]", "", s.upper()).lstrip("0") or ("0" if re.search("0", s) else None)
    known = {(f, (num if f == "serial_number" else form)(v)) for f, v, _ in early if f in ("serial_number", "domains") and v is not None}
    want = set()
    for i, s, ds, *_ in rows:
        for p, (f, v) in enumerate([("serial_number", num(s) if s else None), *(("domains", form(x) if x else None) for x in ds or [])], -1):
            if v:
                if (f, v) in known:
                    want.add((i, f, p))
                known.add((f, v))
    got = [tuple(x) for x in seen_keys.seen(events, earlier, span=100, bits=bits).collect()]
    assert len(got) == len(set(got)) and want <= set(got)  # no "new" answer is wrong
    rates = {x.generation: x for x in seen_keys.error_rates(events, earlier, 100, bits).collect()}
    assert set(rates) == {1, 2, 3, 4} and all(x.measured_rate <= 20 * x.predicted_rate + 0.02 for x in rates.values())
    assert sum(x.n_wrong for x in rates.values()) == len(set(got) - want) and (bits == 8 or set(got) == want)
    assert rates[4].n_filters == 4 and rates[4].predicted_rate >= 4 * 2**-bits * 0.9
    assert seen_keys.seen(events.limit(0), earlier).collect() == [] and seen_keys.seen(events.limit(0), earlier.limit(0)).collect() == []
    assert seen_keys.error_rates(events.limit(0), earlier.limit(0)).collect() == []


def _batches(spark, tmp_path):
    """Three batches of events, in the last of which every key is there before; the store holds the earlier keys."""
    rows = [(i, f"{i % 700:x}", [f"h{i % 500}.net"]) for i in range(1500)]
    events = spark.createDataFrame(rows, "event_id bigint, serial_number string, domains array<string>")
    seen_keys.seal_earlier(spark.createDataFrame([("domains", f"H{i}.net.") for i in range(0, 500, 2)], "key_field string, key_value string"), str(tmp_path / "store"))
    return [events.where(f"event_id between {500 * k} and {500 * k + 499}") for k in range(3)], str(tmp_path / "store")


def _expected(first: int, last: int):
    return {(i, "domains", 0) for i in range(first, last) if i >= 500 or i % 2 == 0} | {(i, "serial_number", -1) for i in range(first, last) if i >= 700}


def test_seen_keys_by_batches_read_only_filters(spark, tmp_path):
    batches, store = _batches(spark, tmp_path)
    for k, batch in enumerate(batches):
        for _ in range(2):  # a batch that is answered again gives the same rows
            got = [tuple(x) for x in seen_keys.answer_batch(batch, store, k + 1).collect()]
            assert len(got) == len(set(got)) and set(got) == _expected(500 * k, 500 * k + 500)
    stored = seen_keys.open_filters(spark, store)
    assert {r.generation for r in stored.select("generation").distinct().collect()} == {0, 1, 2, 3}
    fine = stored.where("generation = 0").agg(F.sum("n")).first()[0]
    assert fine == 250


@pytest.mark.parametrize("answer", [True, False])
def test_seen_keys_rest_on_the_filters(spark, monkeypatch, answer):
    # filters that always say the same give wrong rows: nothing beside them decides
    events = spark.createDataFrame([(i, f"{i % 700:x}", [f"h{i % 500}.net"]) for i in range(1500)], "event_id bigint, serial_number string, domains array<string>")
    earlier = spark.createDataFrame([("domains", "h1.net")], "key_field string, key_value string")
    right = {tuple(x) for x in seen_keys.seen(events, earlier, span=100).collect()}
    monkeypatch.setattr(seen_keys, "_prober", _constant(seen_keys._prober, 0 if answer else -1))
    assert {tuple(x) for x in seen_keys.seen(events, earlier, span=100).collect()} != right


def _constant(prober, hit):
    def run(batches):
        for b in prober(batches):
            yield b.set_column(3, "hit", pa.array(np.full(b.num_rows, hit), pa.int32()))

    return run


def test_filters_of_wider_and_narrower_ranges(spark, tmp_path, monkeypatch):
    keys = lambda lo, hi, g: spark.range(lo, hi).select(F.lit(g).alias("generation"), F.xxhash64("id").alias("h"), F.col("id").alias("event_id"), F.lit(0).alias("pos"))
    at = str(tmp_path / "store")
    for g, fewest in ((0, 1 << 20), (1, 10), (2, 100)):
        monkeypatch.setattr(seen_keys, "FEWEST_KEYS", fewest)
        monkeypatch.setattr(seen_keys, "KEYS_A_FILTER", fewest)
        seal = keys(1000 * g, 1000 * g + 1000, g)
        seen_keys.seal(seal, at, g)
    filters = seen_keys.open_filters(spark, at)
    assert len({r.width for r in filters.collect()}) == 3
    got = {r.event_id: r.hit for r in seen_keys.probe(keys(0, 4000, 9), filters).collect()}
    assert got == {i: i // 1000 if i < 3000 else -1 for i in range(4000)}


@pytest.mark.parametrize("kind", ["skewed", "even", "few"])
def test_heavy_hitters(spark, kind):
    r = random.Random(3)
    if kind == "skewed":
        values = [f"v{int(r.paretovariate(0.8))}" for _ in range(20000)]
    elif kind == "even":  # counts too even for a sketch: all ties
        values = [f"v{i % 3000}" for i in range(6000)]
    else:
        values = ["a", "b", "a", "", None]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "field int, value string")
    got = {(x.field, x["rank"]): (x.value, x.n_exact) for x in heavy_hitters.most_frequent(df, {0: 10, 1: 3}).collect()}
    want = {}
    for f, k in ((0, 10), (1, 3)):
        top = sorted(Counter(v for i, v in enumerate(values) if i % 2 == f and v).items(), key=lambda x: (-x[1], x[0]))[:k]
        want |= {(f, n): x for n, x in enumerate(top, 1)}
    assert got == want
    assert heavy_hitters.most_frequent(df.limit(0), {0: 5}).collect() == []


def _repeated(spark, seed):
    """2,000 values a field of close counts, and the rows of the ten most frequent ones. Most counters of a sketch stay empty."""
    r = random.Random(seed)
    counts = {f"s{seed}v{i}": r.randint(100, 200) for i in range(2000)}
    df = spark.createDataFrame([(0, v, n) for v, n in counts.items()], "field int, value string, n int").repartition(4)
    return df.select("field", F.explode(F.array_repeat("value", F.col("n"))).alias("value")), sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]


@pytest.mark.parametrize("seed", [2, 29])
def test_heavy_hitters_of_sparse_tables(spark, seed):
    df, want = _repeated(spark, seed)
    assert [(x.value, x.n_exact) for x in heavy_hitters.most_frequent(df, {0: 10}).orderBy("rank").collect()] == want


def test_heavy_hitters_in_slices(spark, monkeypatch):
    r = random.Random(3)
    counts = {f"v{i}": r.randint(1000, 1300) for i in range(150)}
    df = spark.createDataFrame(list(counts.items()), "value string, n int").repartition(4).select(F.lit(0).alias("field"), F.explode(F.array_repeat("value", F.col("n"))).alias("value"))
    scans, exact = [], heavy_hitters._exact
    monkeypatch.setattr(heavy_hitters, "CANDIDATES", 16)  # fewer than the values: the key space is searched in slices
    monkeypatch.setattr(heavy_hitters, "_exact", lambda rows: scans.append(1) or exact(rows))
    got = [(x.value, x.n_exact) for x in heavy_hitters.most_frequent(df, {0: 10}).orderBy("rank").collect()]
    assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10] and len(scans) > 1


@pytest.mark.parametrize("literals", [heavy_hitters.LITERALS, 0])
def test_heavy_hitters_do_not_rest_on_estimates(spark, monkeypatch, literals):
    df, want = _repeated(spark, 2)
    descend = heavy_hitters.Sketch.descend
    monkeypatch.setattr(heavy_hitters, "LITERALS", literals)
    monkeypatch.setattr(heavy_hitters.Sketch, "descend", lambda self, *x: (lambda level, prefix: (level, prefix[::2]))(*descend(self, *x)))  # half of them lost
    assert [(x.value, x.n_exact) for x in heavy_hitters.most_frequent(df, {0: 10}).orderBy("rank").collect()] == want


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, bitmaps.CHUNK - 1), max_size=400), st.integers(0, 9000), st.integers(0, 3))
def test_containers_round_trip(at, width, step):
    on = np.zeros(bitmaps.CHUNK, np.uint8)
    on[list(at)] = 1
    on[100 : 100 + width : step + 1] = 1
    bits = np.packbits(on, bitorder="little").tobytes()
    box = bitmaps._pack(bits)
    assert bitmaps._unpack(box) == bits and len(box) <= len(bits) + 1
    assert bitmaps._and(box, box) == bitmaps._size(box) == int(on.sum())
    few = bitmaps._pack(np.packbits(np.arange(bitmaps.CHUNK) % 999 == 0, bitorder='little').tobytes())
    assert bitmaps._and(box, few) == bitmaps._and(few, box) == int(on[::999].sum())


def test_bitmap_counts(spark):
    r = random.Random(5)
    rows = [(r.choice(["d1", "d2", None]), r.choice("ABC"), r.choice([f"h{r.randint(0, 300)}", "hot", None, ""]), 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, "day string, grp string, host string, bucket int")
    boxes = bitmaps.stored_containers(df, F.col("host"), {"day": F.col("day"), "grp": F.col("grp")}, buckets=3)
    got = {(x.day, x.grp, x.grouping): x.n_items for x in bitmaps.union_counts(boxes, [["day", "grp"], ["day"], ["grp"], []], ["day", "grp"]).collect()}
    sets = defaultdict(set)
    for d, g, h, _ in rows:
        if h:
            for key in ((d, g, 0), (d, None, 1), (None, g, 2), (None, None, 3)):
                sets[key].add(h)
    assert got == {k: len(v) for k, v in sets.items()}
    both = bitmaps.intersection_counts(boxes.where("day = 'd1'").drop("day"), boxes.where("day = 'd2'").drop("day"), ["grp"])
    assert {x.grp: x.n_items for x in both.collect()} == {g: len(sets["d1", g, 0] & sets["d2", g, 0]) for g in "ABC"}
    none = bitmaps.stored_containers(df.limit(0), F.col("host"), {"day": F.col("day")}, 3)
    assert [tuple(x) for x in bitmaps.union_counts(none, [["day"], []], ["day"]).collect()] == [(None, 1, 0)]
    assert bitmaps.union_counts(none, [["day"]], ["day"]).collect() == []


def test_bitmaps_merge_over_runs(spark, tmp_path):
    r = random.Random(7)
    runs = [[(f"d{k}", r.choice(["A", None]), f"h{r.randint(0, 200 + 300 * k)}") for _ in range(900)] for k in range(3)]
    keys = {"day": F.col("day"), "grp": F.col("grp")}
    bitmaps.BitmapStore(spark, str(tmp_path / "s"), 3)
    for k, rows in [*enumerate(runs), (2, runs[2])]:  # the last run is added again
        store = bitmaps.BitmapStore(spark, str(tmp_path / "s"))  # opened anew, as by another session
        assert store.buckets == 3
        store.add(spark.createDataFrame(rows, "day string, grp string, host string"), F.col("host"), keys, k)
    numbers = [(x.bucket, x.pos) for x in store.dictionary().collect()]
    assert len(numbers) == len(set(numbers)) == len({h for rows in runs for *_, h in rows})
    for b in range(3):
        assert sorted(p for x, p in numbers if x == b) == list(range(sum(x == b for x, _ in numbers)))  # dense over all runs
    boxes = store.containers({"day": "string", "grp": "string"})
    got = {(x.day, x.grp, x.grouping): x.n_items for x in bitmaps.union_counts(boxes, [["day", "grp"], ["grp"], []], ["day", "grp"]).collect()}
    sets = defaultdict(set)
    for rows in runs:
        for d, g, h in rows:
            for key in ((d, g, 0), (None, g, 2), (None, None, 3)):
                sets[key].add(h)
    assert got == {k: len(v) for k, v in sets.items()}
    both = bitmaps.intersection_counts(*(bitmaps.merged(boxes.where(f"day = 'd{k}'"), ["grp"]) for k in (0, 2)), ["grp"])
    assert {x.grp: x.n_items for x in both.collect()} == {g: len(sets["d0", g, 0] & sets["d2", g, 0]) for g in ("A", None)}


def test_intersections_of_null_groups(spark, tmp_path):
    rows = [("d1", None, "x"), ("d1", None, "y"), ("d2", None, "x"), ("d1", "A", "x"), ("d2", "A", "x"), ("d2", "A", "y"), (None, None, "x"), (None, "A", "x")]
    df = spark.createDataFrame(rows, "day string, grp string, host string")
    boxes = bitmaps.stored_containers(df, F.col("host"), {"day": F.col("day"), "grp": F.col("grp")}, buckets=3)
    one = lambda day: boxes.where(F.col("day").eqNullSafe(F.lit(day)))
    assert {tuple(x) for x in bitmaps.intersection_counts(one("d1").drop("day"), one("d2").drop("day"), ["grp"]).collect()} == {(None, 1), ("A", 1)}
    assert {tuple(x) for x in bitmaps.intersection_counts(one(None), one(None), ["day", "grp"]).collect()} == {(None, None, 1), (None, "A", 1)}
    days = {"d1": "2026-01-01 10:00:00", "d2": "2026-01-02 10:00:00"}
    events = spark.createDataFrame([(days.get(d), g, [h]) for d, g, h in rows], "seen_at string, source string, domains array<string>")
    events.withColumn("seen_at", F.col("seen_at").cast("timestamp")).write.parquet(str(tmp_path / "cert_events.parquet"))
    assert {tuple(x) for x in queries.p4_returning_hosts(spark, str(tmp_path)).collect()} == {("2026-01-01", None, 1), ("2026-01-01", "a", 1)}


def test_top_n(spark):
    r = random.Random(6)
    score = lambda: r.choice([None, float("nan"), -0.1, 1.1, -0.0, 0.0, 1.0, 0.5, round(r.random(), 2)])
    rows = [(i, r.choice([" Hot", "hot", "HOT "] * 3 + ["a", "b ", None, "  "]), score(), "x", 0) for i in range(4000)]
    rows += rows[:300] + [(None, "a", 0.9, "x", 0)]
    df = spark.createDataFrame(rows, "verdict_id bigint, t string, score double, grp string, item int").repartition(7)
    got = [tuple(x) for x in topn.top_n(df, topn.watch_target_form(F.col("t")), F.col("score"), F.col("verdict_id"), 5).collect()]
    best = defaultdict(set)
    for i, t, s, *_ in rows:
        if t and t.strip() and s is not None and 0 <= s <= 1 and i is not None:
            best[t.strip().lower()].add((-s, i))
    want = {(t, -s, i) for t, xs in best.items() for s, i in sorted(xs)[:5]}
    assert len(got) == len(want) and set(got) == want
    assert topn.top_n(df.limit(0), F.col("t"), F.col("score"), F.col("verdict_id"), 5).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 4), st.integers(1, 4))
def test_fm_index_equals_scan(tokens, length, sample):
    t = np.array([*tokens, 0])
    index = FMIndex.of(t, 3, sample)
    phrases = np.array(np.meshgrid(*[[1, 2, 3]] * length)).T.reshape(-1, length)
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(t) - length + 1) if (t[i : i + length] == p).all()]


def folded(s):
    """The one form, character by character with the standard library."""
    letters = {ord(a): b for a, b in (glyphs.LOOK_ALIKES | glyphs.SECOND_CODES).items()}
    out = []
    for ch in s:
        cat = unicodedata.category(ch)
        if any(a <= ord(ch) <= b for a, b in glyphs._UNSEEN) or (cat in ("Cf", "Cc") and ch not in glyphs._BREAKS and ch != "\t" and not 0x600 <= ord(ch) <= 0x605):
            continue
        if cat == "Zs" or ch == "\t":
            out.append(" ")
            continue
        said = unicodedata.decomposition(ch)
        if said.startswith(("<wide>", "<narrow>", "<noBreak>")):
            ch = "".join(chr(int(x, 16)) for x in said.split()[1:])
        out.append("".join(letters.get(ord(c), c) for c in unicodedata.normalize("NFD", ch)))
    return unicodedata.normalize("NFC", "".join(out))


ODD = "abcAOe ΑοаеіїйёЁΆΩΩKÅµμ̧̣́̈̊ͅ​­﻿⁠ 　 \t\nＡｂｶﾞガかがハパﾊﾟW각한하ấḍ̇漢豈²₂"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ODD, max_size=25) | st.text(max_size=8), max_size=8))
def test_visual_form_equals_standard_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert glyphs.canonical_texts(pa.array([*texts, None], pa.string()), glyphs.tables()) == [*map(folded, texts), None]


def test_visual_pairs(spark):
    base = "Ein schöner Text A"
    texts = [base, base, "Ein schöner Text A", "Ein schöner Text А", "EIN schöner Text A", "Ein schoner Text A", "Ein  schöner Text A", "Ein schöner​ Text Ａ", None, "", "​", "", "x²", "x2", "x" * 300_000 + "́"]
    df = spark.createDataFrame([(i, t, "c", i) for i, t in enumerate(texts)] + [(None, base, "c", 0)], "doc_id bigint, text string, form string, form_key int")
    got = [tuple(x) for x in glyphs.visual_pairs(df).collect()]
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and folded(a) == folded(b)}
    assert len(got) == len(want) and set(got) == want and (0, 2) in want and (9, 10) in want
    classes = {x.doc_id: (x.class_id, x.n_texts, x.n_docs) for x in glyphs.visual_classes(df).collect()}
    assert classes[7] == (0, 4, 5) and classes[4] == (4, 1, 1) and 8 not in classes
    assert {x.doc_id: x.form for x in glyphs.visual_form(df).where("doc_id is not null").collect()}[3] == base
    assert glyphs.visual_pairs(df.limit(0)).collect() == []


def test_big_forms_are_split(spark, monkeypatch):
    monkeypatch.setattr(glyphs, "DOCS_A_LIST", 7)
    texts = ["hot text", "hot\u00a0text", "hоt text"] * 40 + ["cold", "ｃold", "other"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id bigint, text string").repartition(5)
    got = [tuple(x) for x in glyphs.visual_pairs(df).collect()]
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a != b and folded(a) == folded(b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 4000


def test_look_alike_letters_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "l0l"), (2, "lOl"), (3, "аа"), (4, "aa")], "doc_id bigint, text string")
    mine = spark.createDataFrame([("0", "O"), ("1", "l"), (None, "x")], "letter string, drawn_like string")
    assert {tuple(x) for x in glyphs.visual_pairs(df, mine).collect()} == {(1, 2)} and {tuple(x) for x in glyphs.visual_pairs(df).collect()} == {(3, 4)}
    with pytest.raises(ValueError):
        glyphs.visual_form(df, spark.createDataFrame([("0", "O"), ("0", "Q")], "letter string, drawn_like string"))


def test_leakage(spark):
    r = random.Random(8)
    vocab = ["alpha", "beta", "gamma", "delta", "straße", "d’or", "42", "x₃", "Ωhm"]
    sentence = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, sentence(r.choice([5, 11, 12, 30]))) for i in range(25)] + [(90, None), (91, "")]
    items.append((92, items[0][1] + " " + sentence(30)))
    docs = []
    for i in range(150):
        parts = [sentence(r.randint(0, 20)), "foreign"]
        if i % 3 == 0:
            t = r.choice(items)[1] or ""
            w = t.split()
            a = r.randint(0, max(0, len(w) - 11))
            parts.append(r.choice([str.upper, str, lambda s: s.replace("a", "а"), lambda s: s.replace(" ", ",\n")])(" ".join(w[a : a + 14])))
        docs.append((i, " ".join(parts), "c", 1))
    docs += [(500, None, "c", 1), (501, "", "c", 1), (502, ("word " * 60000) + items[-1][1], "c", 1), (503, docs[3][1], "c", 1), (None, docs[0][1], "c", 1)]
    words = lambda s: re.findall(r"[^\W_]+", folded(s).lower())
    windows = defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - 11):
            windows[tuple(w[k : k + 12])].add(i)
    want = set()
    for i, t, *_ in docs:
        w = words(t or "")
        for k in range(len(w) - 11):
            want |= {(i, x) for x in windows.get(tuple(w[k : k + 12]), ()) if i is not None}
    dd = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, word_from int").repartition(3)
    ii = spark.createDataFrame(items, "item_id bigint, item_text string")
    got = [tuple(x) for x in leakage.leaked_items(dd, ii).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    text = dict((d[0], d[1]) for d in docs)
    for s in leakage.leaked_spans(dd, ii).collect():
        inside = words(text[s.doc_id][s.char_from : s.char_to])
        assert inside == words(text[s.doc_id])[s.word_from : s.word_to] and len(inside) >= 12
    assert leakage.leaked_items(dd.limit(0), ii).collect() == [] and leakage.leaked_items(dd, ii.limit(0)).collect() == []


def test_suffix_order_of_wide_alphabets():
    r = np.random.default_rng(4)
    for n, most in ((5000, 3), (5000, 2**31 - 2), (60000, 40000)):
        t = r.integers(0, most, n)
        t[-1] = 0
        t = np.concatenate([t, t])  # every suffix is tied for long
        key = lambda i: tuple((x, i + k) if x == 0 else (x, 0) for k, x in enumerate(t[i:].tolist()))
        some = fm_index.suffix_order(t)
        assert sorted(some.tolist()) == list(range(len(t)))
        assert all(key(a) < key(b) for a, b in zip(some[:-1:797], some[1::797]))
    assert (fm_index._sorted_runs(t, t[::-1], 30)[0] == np.lexsort((t[::-1], t))).all()


def test_leakage_index_is_stored_and_holds_every_word(spark, tmp_path, monkeypatch):
    phrase = lambda tag: " ".join(f"w{tag}x{k}" for k in range(15))
    texts = [f"some other words {phrase(i)} and more" for i in range(8)] + ["İstanbul " * 12, "istanbul " * 12, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    leakage.build_index(docs, str(tmp_path / "index"), shard_words=40)
    shards = leakage.open_index(spark, str(tmp_path / "index"))
    rows = shards.collect()
    held = sum(int(np.frombuffer(r.counts, "<u4")[1:].sum()) for r in rows)
    assert held == sum(len(re.findall(r"\w+", t or "")) for t in texts) and len(rows) > 2
    del docs  # from here on only the index is read
    items = lambda *tags: spark.createDataFrame([(i, phrase(i)) for i in tags], "item_id bigint, item_text string")
    assert {tuple(x) for x in leakage.find_items(shards, items(0, 1, 2)).collect()} == {(i, i) for i in range(3)}
    monkeypatch.setattr(leakage, "ITEM_CHARS", 100)  # several blocks of items
    assert {tuple(x) for x in leakage.find_items(shards, items(3, 4, 5, 6, 7, 9)).collect()} == {(i, i) for i in range(3, 8)}
    assert {tuple(x) for x in leakage.find_spans(shards, items(5)).collect()} == {(5, 5, 3, 18, 17, 17 + len(phrase(5)))}
    assert [tuple(x) for x in leakage.find_items(shards, spark.createDataFrame([(1, "İSTANBUL " * 12)], "item_id bigint, item_text string")).collect()] == [(8, 1)]
    more = spark.createDataFrame([(20, "x " + phrase(1))], "doc_id bigint, text string")
    leakage.build_index(more, str(tmp_path / "index"), mode="append")
    assert {tuple(x) for x in leakage.find_items(leakage.open_index(spark, str(tmp_path / "index")), items(1)).collect()} == {(1, 1), (20, 1)}


def test_mixing(spark):
    r = random.Random(9)
    docs = [(i, " ".join(["token"] * r.randint(0, 40)), r.choice(["Big", "big ", "BIG", "small", None, "other"]), 1) for i in range(600)]
    docs += [(1000, None, "big", 1), (1001, "long " * 20000, "big", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("BIG", 0.3, 1), ("small", 0.6, 4), ("empty", 0.1, 8)], "source string, target_share double, max_repeats int")
    count = {i: len(mixing._encoder(mixing.TOKENIZER).encode_ordinary(t)) for i, t, *_ in docs if t is not None}
    has = defaultdict(int)
    for i, t, s, _ in docs:
        if t is not None and s:
            has[s.strip().lower()] += count[i]
    total = int(min(has["big"] / 0.3, has["small"] * 4 / 0.6))
    rows = mixing.mixed_corpus(df, targets).collect()
    assert len({(x.doc_id, x.epoch) for x in rows}) == len(rows) and all(x.n_tokens == count[x.doc_id] for x in rows)
    for s, share, cap in (("big", 0.3, 1), ("small", 0.6, 4)):
        took = [x for x in rows if x.source == s]
        assert max(x.epoch for x in took) <= cap
        budget, largest = share * total, max(x.n_tokens for x in took)
        assert budget - max(largest, 20001) - 1 <= sum(x.n_tokens for x in took) <= budget + 1
    assert {x.source for x in rows} == {"big", "small"}
    shares = {x.source: x for x in mixing.shares_reached(df, targets).collect()}
    assert shares["empty"].share_reached == 0 and abs(sum(x.share_reached for x in shares.values()) - 1) < 1e-9
    assert shares["small"].mixed_tokens == sum(x.n_tokens for x in rows if x.source == "small")
    again = mixing.mixed_corpus(df.repartition(5), targets).collect()
    assert {tuple(x) for x in again} == {tuple(x) for x in rows}
    assert mixing.mixed_corpus(df.limit(0), targets).collect() == [] and mixing.mixed_corpus(df, targets.limit(0)).collect() == []
    assert len(mixing.shares_reached(df.limit(0), targets).collect()) == 3


def test_mixing_targets_without_share_or_repeats(spark):
    docs = [(i, " ".join(["token"] * 20), s) for i, s in enumerate(["big", "small", "off", "once", "plain", "none"] * 20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = [("big", 0.5, 1), ("small", 0.3, 2), ("off", 0.1, 0), ("once", 0.1, None), ("plain", None, 1), ("none", 0.0, 1), (None, 0.2, 1), ("absent", 0.2, None)]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    took = Counter()
    for x in mixing.mixed_corpus(df, targets).collect():
        took[x.source] += x.n_tokens
        assert x.epoch <= {"big": 1, "small": 2, "once": 1}[x.source]
    each = sum(len(mixing._encoder(mixing.TOKENIZER).encode_ordinary(t)) for _, t, s in docs if s == "big")
    assert took["big"] == each and 0.9 * 0.6 * each < took["small"] <= 0.6 * each and 0 < took["once"] <= 0.2 * each
    shares = {x.source: x for x in mixing.shares_reached(df, targets).collect()}
    assert set(shares) == {s for s, *_ in rows}  # every target has its row
    assert {s for s, x in shares.items() if x.share_reached > 0} == {"big", "small", "once"}
    assert {s: x.mixed_tokens for s, x in shares.items() if x.mixed_tokens} == took
    assert (shares["off"].max_repeats, shares["once"].max_repeats, shares["plain"].target_share, shares["plain"].available_tokens) == (0, 1, None, each)


def test_mixing_whole_epochs_keep_the_cap(spark):
    # 50 empty and 5 short texts of one source, and a budget of exactly two epochs of it
    docs = [(i, "", "small") for i in range(50)] + [(100 + i, "one two three", "small") for i in range(5)] + [(200 + i, "one two three", "big") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("n_chars", F.length("text"))
    targets = spark.createDataFrame([("small", 0.25, 2), ("big", 0.75, 1)], "source string, target_share double, max_repeats int")
    for size in (None, "n_chars"):
        took = Counter(x.doc_id for x in mixing.mixed_corpus(df, targets, size=size).collect())
        assert {took[i] for i, _, s in docs if s == "small"} == {2} and {took[i] for i, _, s in docs if s == "big"} == {1}
        shares = {x.source: x for x in mixing.shares_reached(df, targets, size=size).collect()}
        assert all(abs(x.share_reached - x.target_share) < 1e-9 and x.most_repeats <= x.max_repeats for x in shares.values())
