"""Problem 9: mixing sources to target weights.

1. Tokens of every text are counted once with a public tokenizer and stored as a narrow table (or another
   size of the documents is taken, such as their characters).
2. Each document gets a hash-random key (of MD5, which any engine can compute alike); equal ranges of the key ("bins") put the documents of a source
   in random order without a sort over the whole source.
3. Token sums per bin are added up over the bins of a source, and a running sum within each bin gives
   every document its exact prefix sum of tokens.
4. A source's budget is whole epochs plus the documents whose prefix sum fits into the rest.

The total defaults to the largest one at which every source that has any tokens can fill its share within
its cap on repeats; a source without rows reaches 0 and is reported so. ``max_repeats`` is how many times
a document may appear in all; where it is null, once. A source that may not appear (``max_repeats`` 0 or less)
or has no share (null, 0 or less) takes nothing and does not bound the total; it is reported with share 0.

Cases: documents with null text or a source not in the targets take no part; sources are compared in lower
case with blanks trimmed and reduced. Empty texts hold no tokens. Equal keys are ordered by doc_id. No
share is overrun: the cut leaves out the document that would pass the budget, and the ones behind it. A
budget of whole epochs takes every document, empty ones too, just as often. Empty tables give no rows
(shares: one row a target).
"""

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from certloom.functions.text import label_form
from certloom.session import materialise

#: A rank file of a public byte-level tokenizer, and the pattern it splits text with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Equal ranges of the random key of ``KEY_BITS``; a source's bins are sorted independently.
BIN_BITS, KEY_BITS = 12, 60


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens), sources in their one form."""
    rows = docs.select(F.col("doc_id").cast("bigint"), label_form(F.col("source")).alias("source"), "text")
    rows = rows.where("doc_id is not null and source is not null and text is not null")
    return rows.mapInArrow(_count(tokenizer), "doc_id bigint, source string, n_tokens bigint")


def given_sizes(docs: DataFrame, size: str) -> DataFrame:
    """(doc_id, source, n_tokens) where column ``size`` of the documents is what is mixed; null and less than 0 count as 0."""
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("bigint"), label_form(F.col("source")).alias("source"), n.alias("n_tokens"))
    return rows.where("doc_id is not null and source is not null")


def _counted(docs: DataFrame, targets: DataFrame, tokenizer: str, size: str | None) -> tuple[DataFrame, list[Row]]:
    """The stored counts of the targets' documents, and the targets with the tokens they have."""
    wanted = targets.select(label_form(F.col("source")).alias("source"), "target_share", "max_repeats")
    names = [r.source for r in wanted.where("source is not null").select("source").distinct().collect()]  # the settings: as many rows as sources
    known = docs.where(label_form(F.col("source")).isin(names)) if names else docs.limit(0)
    counted = materialise(token_counts(known, tokenizer) if size is None else given_sizes(known, size), "tokens")
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    return counted, wanted.join(sums, "source", "left").fillna({"available_tokens": 0}).orderBy("source").collect()


def _most(target: Row) -> int:
    """How often a document of a target may appear: once where nothing is said."""
    return 1 if target.max_repeats is None else max(target.max_repeats, 0)


def _budgets(plan: list[Row], total_tokens: int | None) -> list[tuple[str, float, int, int, int, int, int]]:
    """(source, share, repeats, available, budget, epochs, rest) of each target."""
    plan = [(r, r.target_share if r.target_share and r.target_share > 0 else 0.0, _most(r)) for r in plan]
    able = [r.available_tokens * most / share for r, share, most in plan if r.available_tokens and most and share]
    total = total_tokens if total_tokens is not None else int(min(able, default=0))
    out = []
    for r, share, most in plan:
        budget = min(int(share * total + 1e-6), r.available_tokens * most)
        epochs = budget // r.available_tokens if r.available_tokens else 0
        out.append((r.source, r.target_share, most, r.available_tokens, budget, epochs, budget - epochs * r.available_tokens))
    return out


_BUDGET = "source string, target_share double, max_repeats int, available_tokens bigint, budget_tokens bigint, epochs int, rest bigint"


def _repeats(counted: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """Adds how often each document is taken: whole epochs and, by its prefix sum, one more."""
    digest = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    key = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")
    keyed = counted.withColumn("key", key).withColumn("bin", F.shiftright("key", KEY_BITS - BIN_BITS))
    sums = keyed.groupBy("source", "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    before = F.sum("bin_tokens").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_tokens")
    starts = sums.select("source", "bin", before.alias("start")).join(budgets.select("source", "epochs", "rest"), "source")
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    prefix = keyed.withColumn("within", within).join(starts, ["source", "bin"])
    return prefix.withColumn("repeats", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("start") + F.col("within") <= F.col("rest")), 1).otherwise(0)).where("repeats > 0")


def mixed_corpus(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 0, size: str | None = None) -> DataFrame:
    """(doc_id, source, epoch, n_tokens): one row for each time a document is taken, epochs from 1.

    ``size``: a column of the documents to be mixed by instead of tokens; ``n_tokens`` then holds it.
    """
    counted, plan = _counted(docs, targets, tokenizer, size)
    budgets = docs.sparkSession.createDataFrame(_budgets(plan, total_tokens), _BUDGET)
    taken = _repeats(counted, budgets, seed)
    return taken.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("epoch"), "n_tokens")


def shares_reached(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 0, size: str | None = None) -> DataFrame:
    """One row a target: what it has, its budget, what the corpus took, and the share of the corpus reached."""
    counted, plan = _counted(docs, targets, tokenizer, size)
    budgets = docs.sparkSession.createDataFrame(_budgets(plan, total_tokens), _BUDGET)
    took = _repeats(counted, budgets, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    per = budgets.join(took, "source", "left").fillna({"mixed_tokens": 0, "most_repeats": 0})
    everything = F.sum("mixed_tokens").over(Window.partitionBy())  # over one row a target
    share = F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0)
    return per.select("source", "target_share", "max_repeats", "available_tokens", "budget_tokens", "mixed_tokens", "most_repeats", share.alias("share_reached"))
