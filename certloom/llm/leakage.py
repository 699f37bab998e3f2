"""Problem 8: evaluation texts leaking into training text.

``build_index`` turns documents into words in the one form of problem 10 (lower case), numbers all words of
a shard, and stores an FM-index of the whole shard: every word of every document, whatever will be
searched. ``find_spans`` opens stored shards and searches every phrase of ``MIN_WORDS`` consecutive item
words backwards, all phrases at once; hits are located by sampled positions, and overlapping hits of one
document and item are merged to removal spans. The index does not depend on the items: later test sets are
searched in it without reading the documents again, and new documents add shards.

Words are compared by 64-bit hashes. The corpus is never shuffled; only found spans leave a task. Items go
to the tasks in blocks of bounded size; more blocks mean more passes over the index, not over the corpus.

Cases: null and empty documents hold nothing. An item with fewer than ``MIN_WORDS`` words never leaks; a
null item text is no item. Copies of documents are each reported. Items that share a phrase are all
reported. Very long texts are handled whole (a text longer than a shard is a shard). Empty tables on
either side give no rows. Extra columns are ignored.
"""

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm.codepoints import blocks, explode
from certloom.llm.fm_index import FMIndex
from certloom.llm.glyphs import Tables, canonical_places, shared_tables, tables
from certloom.llm.mixing64 import mix
from certloom.session import shared_path

MIN_WORDS = 12
#: Test items go to the tasks as a broadcast of at most about so many characters, one block after another.
ITEM_CHARS = 8_000_000
#: A shard's index is sealed at about so many words.
SHARD_WORDS = 1 << 20
#: Shards a file, so that a batch of the columnar reader stays small.
SHARDS_A_FILE = 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SHARD = (
    "n bigint, levels int, planes binary, counts binary, kept binary, position binary, "
    "vocab binary, doc_ids binary, doc_from binary, gap_type string, gaps binary, sizes binary"
)
_SPANS = "doc_id bigint, item_id bigint, word_from int, word_to int, char_from int, char_to int"
_PAIRS = "doc_id bigint, item_id bigint"


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(is letter or digit, code of the lower-case form) of every code point; longer forms have codes of their own."""
    word = np.zeros(0x110000, dtype=bool)
    low = np.arange(0x110000, dtype=np.uint32)
    longer: dict[str, int] = {}
    for cp in range(0x110000):
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LN":
            word[cp] = True
            form = ch.lower()
            low[cp] = ord(form) if len(form) == 1 else longer.setdefault(form, 0x110000 + len(longer))
    return word, low


@cache
def _char_codes() -> np.ndarray:
    return mix(_letters()[1].astype(np.uint64), 99)


def words(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word; texts end words."""
    is_word = _letters()[0][cps]
    edge = is_word.copy()
    edge[1:] &= ~is_word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(cps))]
    edge[inner] |= is_word[inner]
    start = np.flatnonzero(edge)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    chars = np.flatnonzero(is_word)
    first = np.searchsorted(chars, start)
    size = np.diff(np.concatenate([first, [len(chars)]]))
    offset = np.arange(len(chars)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), _BASE, dtype=np.uint64), dtype=np.uint64)
        h = np.add.reduceat(_char_codes()[cps[chars]] * power[offset], first)
    return start, start + size, h


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the shortest signed type."""
    lo, hi = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


class _Shard:
    """Words gathered for one index, with the place each one came from."""

    def __init__(self, places: bool, mappings: Tables) -> None:
        self.places, self.mappings = places, mappings
        self._clear()

    def _clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray, cps: np.ndarray, bounds: np.ndarray) -> None:
        form, form_bounds, came = canonical_places(cps, bounds, self.mappings)
        start, end, h = words(form, form_bounds)
        per = np.diff(np.searchsorted(start, form_bounds))
        some = per > 0
        self.hashes.append(h)
        self.docs.append(ids[some])
        self.sizes.append(per[some])
        self.n += len(h)
        if self.places:
            base = np.repeat(bounds[:-1], per)
            self.starts.append((start if came is None else came[start]) - base)
            self.ends.append((end - 1 if came is None else came[end - 1]) + 1 - base)

    def sealed(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        coded = pa.array(np.concatenate(self.hashes)).dictionary_encode()
        found = coded.dictionary.to_numpy()
        order = np.argsort(found)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(1, len(order) + 1, dtype=np.int32)
        docs, sizes = np.concatenate(self.docs), np.concatenate(self.sizes)
        tokens = np.zeros(self.n + len(docs), np.int32)  # one separator behind each text
        tokens[np.arange(self.n) + np.repeat(np.arange(len(docs)), sizes)] = number[coded.indices.to_numpy()]
        row = FMIndex.parts(tokens, len(order))
        first = np.cumsum(sizes + 1) - sizes - 1
        row |= {"vocab": found[order].astype("<u8").tobytes(), "doc_ids": docs.astype("<i8").tobytes(), "doc_from": first.astype("<u4").tobytes(), "gap_type": None, "gaps": None, "sizes": None}
        if self.places:
            start, end = np.concatenate(self.starts), np.concatenate(self.ends)
            head = np.cumsum(sizes) - sizes
            last = np.concatenate([[0], end[:-1]])
            last[head] = 0
            both = _narrow(np.stack([start - last, end - start]))
            row |= {"gap_type": both.dtype.str, "gaps": both[0].tobytes(), "sizes": both[1].tobytes()}
        self._clear()
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
        fields = [f.split() for f in _SHARD.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([row[name]], kinds[kind]) for name, kind in fields], names=_names(_SHARD))


def _index(places: bool, shard_words: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(places, shared.value)
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            for lo, hi in blocks(texts):
                shard.add(ids[lo:hi], *explode(texts.slice(lo, hi - lo)))
                if shard.n >= shard_words:
                    yield from shard.sealed()
        yield from shard.sealed()

    return run


def build_index(docs: DataFrame, path: str, mode: str = "overwrite", places: bool = True, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Indexes every word of every text and stores the shards at ``path``; ``mode`` "append" adds new documents.

    ``places``: whether to keep the places of the words in the text as written, which only ``find_spans`` needs.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    texts.mapInArrow(_index(places, shard_words, shared_tables(docs.sparkSession)), _SHARD).write.mode(mode).option("maxRecordsPerFile", SHARDS_A_FILE).parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored shards, one row each."""
    return spark.read.schema(_SHARD).parquet(path)


class Phrases:
    """What the tasks need of a block of test items: the words' hashes, the phrases as their numbers, the items of each."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        ids = [i for i, _ in items]
        form, bounds, _ = canonical_places(*explode(pa.array([t for _, t in items], pa.string())), tables())
        start, _, h = words(form, bounds)
        self.vocab, number = np.unique(h, return_inverse=True)
        first = np.searchsorted(start, bounds)
        rows, owner = [np.zeros((0, min_words), np.int64)], [np.zeros(0, np.int64)]
        for item, a, b in zip(ids, first[:-1], first[1:]):
            if b - a >= min_words:
                rows.append(np.lib.stride_tricks.sliding_window_view(number[a:b], min_words))
                owner.append(np.full(len(rows[-1]), item, dtype=np.int64))
        self.phrases, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)], axis=1), axis=0)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(self.phrases) + 1))

    def numbered(self, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which phrases can occur, those in the word numbers of a shard): the others hold a word that it lacks."""
        at = np.minimum(np.searchsorted(vocab, self.vocab), len(vocab) - 1)
        number = np.where(vocab[at] == self.vocab, at + 1, 0)
        rows = number[self.phrases]
        some = np.flatnonzero((rows > 0).all(axis=1))
        return some, rows[some]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _hits(row: dict, p: Phrases) -> tuple[np.ndarray, ...] | None:
    """(document, item, word) of all occurrences of phrases in a shard, in this order."""
    some, phrases = p.numbered(np.frombuffer(row["vocab"], "<u8"))
    if not len(some):
        return None
    index = FMIndex(*(row[k] for k in ("n", "levels", "planes", "counts", "kept", "position")))
    lo, hi = index.search(phrases)
    n = hi - lo
    if not n.any():
        return None
    pos = index.locate(_ranges(lo, n))
    phrase = np.repeat(some, n)
    m = p.items_from[phrase + 1] - p.items_from[phrase]
    item = p.items[_ranges(p.items_from[phrase], m)]
    pos = np.repeat(pos, m)
    doc_from = np.frombuffer(row["doc_from"], "<u4").astype(np.int64)
    doc = np.searchsorted(doc_from, pos, side="right") - 1
    order = np.lexsort((pos, item, doc))
    return doc[order], item[order], (pos - doc_from[doc])[order]


def _search_pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                if (found := _hits(row, shared.value)) is not None:
                    doc, item, _ = found
                    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
                    ids = np.frombuffer(row["doc_ids"], "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc[first]]), pa.array(item[first])], names=_names(_PAIRS))

    return run


def _search_spans(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                p = shared.value
                if (found := _hits(row, p)) is None:
                    continue
                doc, item, w = found
                cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (w[1:] > w[:-1] + p.min_words)])
                a = np.flatnonzero(cut)
                word_to = w[np.concatenate([a[1:] - 1, [len(w) - 1]])] + p.min_words
                doc, item, word_from = doc[a], item[a], w[a]
                gaps, sizes = (np.frombuffer(row[k], row["gap_type"]).astype(np.int64) for k in ("gaps", "sizes"))
                ends = np.cumsum(gaps + sizes)
                head = np.frombuffer(row["doc_from"], "<u4").astype(np.int64) - np.arange(len(row["doc_ids"]) // 8)  # first word of each text
                base = np.where(head > 0, ends[head - 1], 0)[doc]
                char_from = ends[head[doc] + word_from] - sizes[head[doc] + word_from] - base
                char_to = ends[head[doc] + word_to - 1] - base
                ids = np.frombuffer(row["doc_ids"], "<i8")[doc]
                cols = [ids, item, *(x.astype(np.int32) for x in (word_from, word_to, char_from, char_to))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_names(_SPANS))

    return run


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dictionaries; byte strings stay in the batch's memory."""
    for i in range(b.num_rows):
        yield {name: x.as_buffer() if pa.types.is_binary((x := b.column(k)[i]).type) and x.is_valid else x.as_py() for k, name in enumerate(b.schema.names)}


def _find(index: DataFrame, items: DataFrame, min_words: int, search, columns: list[str], out: str) -> DataFrame:
    spark = index.sparkSession
    known = items.where("item_id is not null and item_text is not null").select(F.col("item_id").cast("bigint"), "item_text")
    chars = known.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks_of_items = max(1, -(-chars // ITEM_CHARS))
    found = None
    for k in range(blocks_of_items):
        part = known if blocks_of_items == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks_of_items)) == k)
        shared = spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.collect()], min_words))
        one = index.select(*columns).mapInArrow(search(shared), out)
        found = one if found is None else found.unionByName(one)
    return found


_OPENED = _names(_SHARD)[:9]


def find_spans(index: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, word_from, word_to, char_from, char_to): the merged removal spans in a stored index.

    ``char_*`` count code points of the text as written; ends are exclusive.
    """
    return _find(index, items, min_words, _search_spans, _names(_SHARD), _SPANS)


def find_items(index: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id), each once, of a stored index."""
    return _find(index, items, min_words, _search_pairs, _OPENED, _PAIRS).distinct()


def leaked_spans(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``find_spans`` in an index of ``docs`` that is stored in the shared folder."""
    return find_spans(build_index(docs, shared_path(docs.sparkSession, "leak-index")), items, min_words)


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``find_items`` in an index of ``docs`` that is stored in the shared folder."""
    return find_items(build_index(docs, shared_path(docs.sparkSession, "leak-index"), places=False), items, min_words)
