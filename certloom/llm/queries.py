"""The queries of the training-data problems, over whole tables with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.functions.text import host_form, label_form, strip_blanks
from certloom.llm import bitmaps, glyphs, heavy_hitters, leakage, mixing, seen_keys, topn
from certloom.session import table

TOP_HOSTS = 20
TOP_NAMES = 10
TOP_VERDICTS = 5
_FIELDS = {0: "domains", 1: "issuer_common_name"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.seen(table(spark, d, "cert_events"), table(spark, d, "earlier_keys"))


def p1_error_rates(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.error_rates(table(spark, d, "cert_events"), table(spark, d, "earlier_keys"))


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "cert_events")
    hosts = events.select(F.lit(0).alias("field"), F.explode("domains").alias("v")).select("field", host_form(F.col("v")).alias("value"))
    names = events.select(F.lit(1).alias("field"), strip_blanks(F.col("issuer_common_name")).alias("value"))
    top = heavy_hitters.most_frequent(hosts.unionByName(names), {0: TOP_HOSTS, 1: TOP_NAMES})
    return top.withColumn("key_field", F.when(F.col("field") == 0, _FIELDS[0]).otherwise(_FIELDS[1]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("key_field", F.col("value").alias("key_value"))


def p3_heavy_counts(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("key_field", "rank", F.col("value").alias("key_value"), "n_exact")


def p3_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's estimates beside the exact counts."""
    return _frequent(spark, d).select("key_field", F.col("value").alias("key_value"), "n_exact", "n_estimated")


def _host_sets(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "cert_events")
    hosts = events.select("seen_at", "source", F.explode("domains").alias("host"))
    keys = {"day": F.to_date("seen_at"), "source": label_form(F.col("source"))}
    return bitmaps.stored_containers(hosts, host_form(F.col("host")), keys, bitmaps.buckets_for(events.count()))


def p4_distinct_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Different hosts per day, per source, per combination of both, and in all; ``error_bound`` is 0, as counts are exact."""
    counts = bitmaps.union_counts(_host_sets(spark, d), [["day", "source"], ["day"], ["source"], []], ["day", "source"])
    return counts.select(F.col("day").cast("string").alias("day"), "source", "grouping", F.col("n_items").alias("n_hosts"), F.lit(0).alias("error_bound"))


def p4_returning_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of a source that came on a day and again on the next. A null source is one of its own; a null day has no next."""
    boxes = _host_sets(spark, d).where("day is not null")
    after = boxes.withColumn("day", F.date_sub("day", 1))
    return bitmaps.intersection_counts(boxes, after, ["day", "source"]).where("n_items > 0").select(F.col("day").cast("string").alias("day"), "source", F.col("n_items").alias("n_hosts"))


def _top_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "domain_verdicts")
    return topn.top_n(v, topn.watch_target_form(F.col("matched_watch_target")), F.col("score"), F.col("verdict_id"), TOP_VERDICTS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _top_verdicts(spark, d).select(F.col("grp").alias("watch_target"), F.col("item").alias("verdict_id"))


def p5_top_scores(spark: SparkSession, d: str) -> DataFrame:
    return _top_verdicts(spark, d).select(F.col("grp").alias("watch_target"), F.col("item").alias("verdict_id"), "score")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_corpus(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_reached(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix_chars(spark: SparkSession, d: str) -> DataFrame:
    """The same mixture by characters instead of tokens."""
    mixed = mixing.mixed_corpus(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="n_chars")
    return mixed.select("doc_id", "source", "epoch", F.col("n_tokens").alias("n_chars"))


def p9_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    shares = mixing.shares_reached(table(spark, d, "documents"), table(spark, d, "mix_targets"), size="n_chars")
    share = F.round("share_reached", 9).alias("share_reached")
    return shares.select("source", "target_share", "max_repeats", F.col("available_tokens").alias("available_chars"), F.col("budget_tokens").alias("budget_chars"), F.col("mixed_tokens").alias("mixed_chars"), share)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.visual_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.visual_classes(table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.visual_form(table(spark, d, "documents"))


def queries() -> dict:
    named = [
        p1_found, p1_error_rates, p3_found, p3_heavy_counts, p3_estimates, p4_distinct_hosts, p4_returning_hosts, p5_found, p5_top_scores,
        p8_found, p8_spans, p9_mix, p9_shares, p9_mix_chars, p9_shares_chars, p10_found, p10_classes, p10_forms,
    ]
    return {f.__name__: f for f in named}
