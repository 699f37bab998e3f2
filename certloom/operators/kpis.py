"""Feed and detection figures: totals, rates, top sources, landmark windows, shares by rule and family."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hosts() -> Column:
    return F.coalesce(F.array_size("domains"), F.lit(0))


def per_second(n: Column, span: Column) -> Column:
    """A rate; 0 over an empty span."""
    return F.when(span > 0, n / span).otherwise(F.lit(0.0))


def duration_text(seconds: float | None) -> str:
    """us below a millisecond, ms below a second, else s; unknown is a dash."""
    if seconds is None:
        return "-"
    if seconds < 1e-3:
        return f"{seconds * 1e6:.0f}us"
    return f"{seconds * 1e3:.1f}ms" if seconds < 1 else f"{seconds:.2f}s"


def feed_totals(events: DataFrame) -> DataFrame:
    """Certificates and hosts."""
    return events.agg(F.count("*").alias("n_certs"), F.coalesce(F.sum(_hosts()), F.lit(0)).alias("n_domains"))


def distinct_hosts(events: DataFrame) -> DataFrame:
    """Exact number of different hosts as written. One shuffle of partially aggregated hosts."""
    return events.select(F.explode("domains").alias("d")).agg(F.count_distinct("d").alias("n_unique"))


def top_sources(events: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` sources with most certificates and their share of all; equal counts by name."""
    total = events.count()
    by = events.groupBy("source").agg(F.count("*").alias("n_certs"))
    share = F.lit(100.0) * F.col("n_certs") / F.lit(max(total, 1))
    return by.orderBy(F.desc("n_certs"), F.asc_nulls_first("source")).limit(n).withColumn("percent", share)


def landmarks(events: DataFrame, time: str, checkpoints: dict[str, int]) -> DataFrame:
    """Cumulative figures at fixed spans (seconds) after the first event: a row for each checkpoint.

    Each event is expanded to the checkpoints it falls under, which is a fixed small number.
    """
    start = events.agg(F.min(time)).first()[0]
    if start is None:
        return events.sparkSession.createDataFrame([], "checkpoint string, n_certs bigint, n_domains bigint, n_unique bigint, certs_per_second double")
    age = F.col(time).cast("double") - F.lit(start).cast("double")
    under = F.array_compact(F.array(*(F.when(age <= s, F.lit(k)) for k, s in checkpoints.items())))
    spans = F.create_map(*(x for k, s in checkpoints.items() for x in (F.lit(k), F.lit(s))))
    rows = events.where(F.col(time).isNotNull()).select(F.explode(under).alias("checkpoint"), "domains")
    certs = rows.groupBy("checkpoint").agg(F.count("*").alias("n_certs"), F.sum(_hosts()).alias("n_domains"))
    hosts = rows.select("checkpoint", F.explode("domains").alias("d")).groupBy("checkpoint").agg(F.count_distinct("d").alias("n_unique"))
    both = certs.join(hosts, "checkpoint", "left").fillna({"n_unique": 0})
    return both.withColumn("certs_per_second", F.col("n_certs") / spans[F.col("checkpoint")])


def reasons_by(found: DataFrame, what: str) -> DataFrame:
    """Counts of reasons by ``rule`` or ``family`` with their share of all reasons."""
    by = found.select(F.explode("reasons").alias("r")).groupBy(F.col(f"r.{what}").alias(what)).agg(F.count("*").alias("n"))
    # over at most fourteen groups
    return by.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


def detection_totals(events: DataFrame, found: DataFrame) -> DataFrame:
    """Certificates, hosts, hosts with a detection, reasons, and reasons in percent of hosts (may pass 100)."""
    hits = found.agg(F.count("*").alias("n_hosts_found"), F.coalesce(F.sum(F.size("reasons")), F.lit(0)).cast("bigint").alias("n_reasons"))
    both = feed_totals(events).crossJoin(hits)  # one row each
    rate = F.when(F.col("n_domains") > 0, F.lit(100.0) * F.col("n_reasons") / F.col("n_domains")).otherwise(0.0)
    return both.withColumn("percent_of_domains", rate)


def interval_deltas(events: DataFrame, time: str, width: str) -> DataFrame:
    """Hosts per tumbling interval and cumulative up to its end."""
    by = events.where(F.col(time).isNotNull()).groupBy(F.window(time, width).alias("w")).agg(F.sum(_hosts()).alias("n_domains"))
    so_far = F.sum("n_domains").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    # over the intervals, not the events
    return by.select(F.col("w.start").alias("start"), "n_domains").withColumn("n_so_far", so_far)


def snapshot(totals: dict, by_family: list[tuple[str, int]], by_rule: list[tuple[str, int]], elapsed: float, window: float, window_domains: int, analysis: tuple[float, float | None, float | None] = (0.0, None, None)) -> str:
    """A block of text with the figures of a run; lists are in the order of their counts.

    ``analysis``: seconds of analysis, and the shortest and longest a certificate.
    """
    rate = lambda n, s: n / s if s > 0 else 0.0
    certs, domains, reasons = totals["n_certs"], totals["n_domains"], totals["n_reasons"]
    percent = lambda n: 100 * n / reasons if reasons else 0.0
    lines = [
        f"== detection after {elapsed:.0f} s",
        f"certificates {certs} ({rate(certs, elapsed):.1f} a second, {60 * rate(certs, elapsed):.0f} a minute)",
        f"hosts {domains} ({rate(domains, elapsed):.1f} a second, {60 * rate(domains, elapsed):.0f} a minute; last {window:.0f} s: {window_domains}, {rate(window_domains, window):.1f} a second)",
        f"reasons {reasons} ({60 * rate(reasons, elapsed):.1f} a minute, {100 * reasons / domains if domains else 0:.2f} % of hosts)",
    ]
    took, shortest, longest = analysis
    lines.append(f"analysis {duration_text(took)} (average a host {duration_text(rate(took, domains))}; a certificate {duration_text(shortest)} to {duration_text(longest)})")
    for title, rows in (("by family", by_family), ("by rule", by_rule)):
        lines += [title, *(f"  {name:<14} {n:>8} {percent(n):5.1f} %" for name, n in rows)]
    return "\n".join(lines)
