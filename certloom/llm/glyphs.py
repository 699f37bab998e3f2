"""Problem 10: one form for text that looks the same but is made of different characters.

Within each Arrow batch, text is exploded to positioned code points (an array), joined with the broadcast
decomposition and look-alike mappings, combining marks are put in order of their class, composed again, and
the texts are rebuilt. The mappings are made on the driver: decompositions by rule from its Unicode
database, look-alike letters from a table (letter, drawn_like) that callers can replace. Their size is
bounded by the number of code points (10 MB), whatever the data.

What becomes equal: marks that print nothing (dropped), kinds of blanks (each one plain space; line breaks
stay), full-width and half-width forms, no-break variants, composed and separate accents in any order,
second codes of one sign, and letters of Latin, Greek and Cyrillic drawn alike. Case, accents, raised and
lowered digits, punctuation and line breaks stay different.

Cases: a null text has no form and takes no part; an empty text and one of invisible marks share the empty
form. Very long texts are handled whole. Ties: the smallest doc_id names a class. Empty tables give no rows.
"""

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm.codepoints import blocks, explode, implode
from certloom.session import materialise

#: Letters of Greek and Cyrillic and the letter they are drawn like; the default table.
LOOK_ALIKES = {
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ү": "Y", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ӕ": "Æ", "Ә": "Ə",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ѵ": "v", "ӏ": "l", "ӕ": "æ", "ә": "ə",
    # Cyrillic capitals drawn like Greek ones
    "Г": "Γ", "П": "Π", "Ф": "Φ",
}

#: Second codes of one sign that have no canonical decomposition.
SECOND_CODES = {"µ": "μ", "∆": "Δ", "∑": "Σ", "∏": "Π", "Đ": "Ð", "Ɖ": "Ð"}

#: Documents of one form that are joined in one part, about.
DOCS_A_LIST = 1000

_SIZE = 0x110000
_BREAKS = frozenset("\n\r\x0b\x0c\x85  ")
#: Marks that print nothing besides the format characters (category Cf) and controls.
_UNSEEN = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]


class Tables:
    """Mapping tables over all code points, with the given look-alike letters.

    ``start``/``length`` point into ``parts``: the folded full decomposition of each code point.
    ``risky`` marks code points whose texts need the full treatment; a text without any is its own form.
    """

    def __init__(self, look_alikes: dict[str, str]) -> None:
        fold: dict[int, str] = {ord(a): b for a, b in (look_alikes | SECOND_CODES).items()}
        self.ccc = np.zeros(_SIZE, dtype=np.uint8)
        changed: dict[int, str] = {}
        pairs: dict[int, int] = {}
        unseen = {c for a, b in _UNSEEN for c in range(a, b + 1)}
        for cp in range(_SIZE):
            if 0xD800 <= cp <= 0xDFFF:
                continue
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Co"):
                if cp in unseen:
                    changed[cp] = ""
                continue
            if cp in unseen or (cat in ("Cf", "Cc") and ch not in _BREAKS and ch != "\t" and not 0x600 <= cp <= 0x605):
                changed[cp] = ""
                continue
            if cat == "Zs" or ch == "\t":
                if cp != 0x20:
                    changed[cp] = " "
                continue
            if cls := unicodedata.combining(ch):
                self.ccc[cp] = cls
            said = unicodedata.decomposition(ch)
            if said.startswith(("<wide>", "<narrow>", "<noBreak>")):
                base = "".join(chr(int(x, 16)) for x in said.split()[1:])
            else:
                base = ch
            full = "".join(fold.get(ord(c), c) for c in unicodedata.normalize("NFD", base))
            full = "".join(unicodedata.normalize("NFD", c) for c in full)
            if full != ch:
                changed[cp] = full
            nfd = unicodedata.normalize("NFD", ch)
            if said and said[0] != "<" and len(said.split()) == 2 and unicodedata.normalize("NFC", nfd) == ch:
                a, b = (int(x, 16) for x in said.split())
                pairs[a << 21 | b] = cp
        for i in range(0xAC00, 0xD7A4):  # Hangul syllables by their arithmetic
            k = i - 0xAC00
            lv = 0xAC00 + k // 28 * 28
            key = (0x1100 + k // 588) << 21 | (0x1161 + k % 588 // 28) if i == lv else lv << 21 | (0x11A7 + k % 28)
            pairs[key] = i
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], dtype=np.uint32)
        self.second = np.zeros(_SIZE, dtype=bool)
        self.second[self.pair_keys & 0x1FFFFF] = True
        order = sorted(changed)
        self.length = np.ones(_SIZE, dtype=np.uint8)
        self.start = np.zeros(_SIZE, dtype=np.int32)
        parts: list[int] = []
        self.risky = (self.ccc > 0) | self.second
        for cp in order:
            self.start[cp], self.length[cp] = len(parts), len(changed[cp])
            parts += map(ord, changed[cp])
            # a letter that only falls apart and composes to itself again is its own form
            self.risky[cp] |= unicodedata.normalize("NFC", changed[cp]) != chr(cp)
        self.moved = np.zeros(_SIZE, dtype=bool)
        self.moved[order] = True
        self.parts = np.array(parts or [0], dtype=np.uint32)


@cache
def tables() -> Tables:
    """The mappings with the default look-alike letters."""
    return Tables(LOOK_ALIKES)


def shared_tables(spark: SparkSession, look_alikes: DataFrame | None = None):
    """The broadcast mappings. ``look_alikes``: (letter, drawn_like), single characters, each letter once."""
    if look_alikes is None:
        return spark.sparkContext.broadcast(tables())
    pairs = look_alikes.select("letter", "drawn_like").where("letter is not null and drawn_like is not null").distinct().limit(_SIZE + 1).collect()
    given = {r.letter: r.drawn_like for r in pairs}
    if len(given) != len(pairs) or any(len(a) != 1 or len(b) != 1 for a, b in given.items()):
        raise ValueError("look-alike letters must be single characters, each with one letter it is drawn like")
    return spark.sparkContext.broadcast(Tables(given))


def canonical(cps: np.ndarray, bounds: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The one form of all texts of a block, again as (code points, bounds)."""
    return canonical_places(cps, bounds, t)[:2]


def canonical_places(cps: np.ndarray, bounds: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Also the place in ``cps`` that each code point of the form came from; None where nothing changed."""
    risky = t.risky[cps]
    if not risky.any():
        return cps, bounds, None
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(n), sizes)
    touched = np.bincount(doc[risky], minlength=n) > 0
    mask = touched[doc]
    part, part_doc, part_from = _treat(cps[mask], doc[mask], t)
    new_sizes = np.where(touched, np.bincount(part_doc, minlength=n), sizes)
    new_bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(new_sizes)])
    out = np.empty(new_bounds[-1], dtype=np.uint32)
    came = np.empty(new_bounds[-1], dtype=np.int64)
    into = np.repeat(touched, new_sizes)
    out[into], came[into] = part, np.flatnonzero(mask)[part_from]
    out[~into], came[~into] = cps[~mask], np.flatnonzero(~mask)
    return out, new_bounds, came


def _treat(cps: np.ndarray, doc: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # join with the mappings: each code point becomes 0 to 4 others at its place
    moved = t.moved[cps]
    size = t.length[cps].astype(np.int64)
    at = np.repeat(np.arange(len(cps)), size)
    first = np.cumsum(size) - size
    within = np.arange(len(at)) - first[at]
    out = np.where(moved[at], t.parts[t.start[cps[at]] + within * moved[at]], cps[at])
    doc = doc[at]
    ccc = t.ccc[out]
    # order combining marks by class within each run of marks
    marks = np.flatnonzero(ccc)
    if len(marks):
        run = np.cumsum(np.concatenate([[True], (np.diff(marks) != 1) | (np.diff(doc[marks]) != 0)]))
        order = np.lexsort((ccc[marks], run))
        out[marks], at[marks] = out[marks][order], at[marks][order]
        ccc = t.ccc[out]
    keep = _compose(out, doc, ccc, t)
    return out[keep], doc[keep], at[keep]


def _compose(out: np.ndarray, doc: np.ndarray, ccc: np.ndarray, t: Tables) -> np.ndarray:
    """Composes in place; returns which places stay.

    A cluster runs from a starter that never is a second part to the next one. Its possible second parts
    are taken one after another, side by side over all clusters.
    """
    n = len(out)
    alive = np.ones(n, dtype=bool)
    second = t.second[out]
    cand = np.flatnonzero(second)
    if not len(cand):
        return alive
    root = (ccc == 0) & ~second
    root[0] = True
    root[1:] |= doc[1:] != doc[:-1]
    head = np.maximum.accumulate(np.where(root, np.arange(n), 0))
    cand = cand[head[cand] < cand]
    own = head[cand]
    idx = np.arange(len(cand))
    rank = idx - np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), idx, 0)) if len(cand) else idx
    order = np.argsort(rank, kind="stable")
    ends = np.cumsum(np.bincount(rank)) if len(rank) else []
    now = np.arange(n)  # the starter that marks of a cluster may join, by its root
    last = np.arange(n)  # the last place of a cluster that stays, by its root
    start = 0
    for end in ends:
        c = cand[order[start:end]]
        r = own[order[start:end]]
        start = end
        h = now[r]
        prev = np.where(alive[c - 1], c - 1, last[r])
        free = (prev == h) | ((ccc[prev] < ccc[c]) & (ccc[c] > 0))
        key = out[h].astype(np.int64) << 21 | out[c].astype(np.int64)
        at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = (t.pair_keys[at] == key) & free & (ccc[h] == 0)
        out[h[hit]] = t.pair_to[at[hit]]
        alive[c[hit]] = False
        last[r] = np.where(hit, prev, c)
        stands = ~hit & (ccc[c] == 0)
        now[r[stands]] = c[stands]
    return alive


def canonical_texts(texts: pa.Array, t: Tables) -> list[str | None]:
    """The one form of each text of an array; null stays null."""
    out: list[str | None] = []
    for a, b in blocks(texts):
        part = texts.slice(a, b - a)
        out += [s if ok else None for s, ok in zip(implode(*canonical(*explode(part), t)), part.is_valid().to_pylist())]
    return out


def _forms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(canonical_texts(b.column(1), shared.value), pa.string())], names=["doc_id", "form"])

    return run


def _prints(shared):
    digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form, raw = [], []
            texts = b.column(1)
            for lo, hi in blocks(texts):
                cps, bounds = explode(texts.slice(lo, hi - lo))
                new, new_bounds = canonical(cps, bounds, shared.value)
                raw += [digest(cps[x:y].tobytes()) for x, y in zip(bounds[:-1], bounds[1:])]
                form += raw[lo:] if new is cps else [digest(new[x:y].tobytes()) for x, y in zip(new_bounds[:-1], new_bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "form_key", "text_key"])

    return run


def visual_form(docs: DataFrame, look_alikes: DataFrame | None = None) -> DataFrame:
    """(doc_id, form): every text in its one form, ready for any comparison."""
    shared = shared_tables(docs.sparkSession, look_alikes)
    return docs.select("doc_id", "text").where("text is not null").mapInArrow(_forms(shared), "doc_id bigint, form string")


def form_keys(docs: DataFrame, look_alikes: DataFrame | None = None) -> DataFrame:
    """(doc_id, form_key, text_key): 128-bit digests of the form and of the text as written, as a stored narrow table."""
    shared = shared_tables(docs.sparkSession, look_alikes)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null")
    return materialise(rows.mapInArrow(_prints(shared), "doc_id bigint, form_key binary, text_key binary"), "forms")


def visual_classes(docs: DataFrame, look_alikes: DataFrame | None = None) -> DataFrame:
    """(doc_id, class_id, n_texts, n_docs): one row per document; class_id is the smallest doc_id of its form.

    ``n_texts`` counts the different ways of writing the form.
    """
    keys = form_keys(docs, look_alikes)
    written = keys.groupBy("form_key", "text_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"))
    classes = written.groupBy("form_key").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    return keys.join(classes, "form_key").select("doc_id", "class_id", "n_texts", "n_docs")


def visual_pairs(docs: DataFrame, look_alikes: DataFrame | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b): every pair of documents that look the same and are written differently, each once.

    Only documents of forms with at least two writings are joined, as lists of the documents of one writing;
    lists of one writing never meet. A form that many documents have is split into parts of about
    ``DOCS_A_LIST`` documents: each list of a part meets the lists of other writings in a task of its own.
    """
    keys = form_keys(docs, look_alikes)
    written = keys.groupBy("form_key", "text_key").agg(F.count("*").alias("n_docs"))
    mixed = written.groupBy("form_key").agg(F.count("*").alias("n_texts"), F.sum("n_docs").alias("n_docs")).where("n_texts > 1")
    mixed = mixed.select("form_key", F.ceil(F.col("n_docs") / DOCS_A_LIST).cast("int").alias("parts"))
    some = keys.join(mixed, "form_key").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    lists = some.groupBy("form_key", "text_key", "parts", "part").agg(F.collect_set("doc_id").alias("ids"))
    a = lists.select("form_key", "part", F.col("text_key").alias("key_a"), F.col("ids").alias("ids_a"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    b = lists.select("form_key", every.alias("part"), F.col("text_key").alias("key_b"), F.col("ids").alias("ids_b"))
    met = a.join(b, ["form_key", "part"]).where("key_a < key_b").select(F.explode("ids_a").alias("x"), "ids_b").select("x", F.explode("ids_b").alias("y"))
    return met.where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
