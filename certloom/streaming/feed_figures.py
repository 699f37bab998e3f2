"""Figures of a live feed at fixed times after its start: cumulative, with exact numbers of different hosts.

Hosts and sources of each micro-batch are written to the shared folder and read at each landmark, so that
nothing grows in the memory of a process. The tables are deleted at the end.
"""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from certloom.operators import kpis
from certloom.session import intermediates, shared_path


def text_of(events: DataFrame, elapsed: float, top: int) -> str:
    """The figures of a table of (source, domains) as text."""
    fed, unique = kpis.feed_totals(events).first(), kpis.distinct_hosts(events).first()
    rate = lambda n: n / elapsed if elapsed > 0 else 0.0
    lines = [f"== feed after {elapsed:.0f} s", f"certificates {fed.n_certs} ({rate(fed.n_certs):.2f} a second)", f"hosts {fed.n_domains}, {unique.n_unique} different"]
    return "\n".join(lines + [f"  {r.source or '?':<45} {r.n_certs:>8} {r.percent:5.1f} %" for r in kpis.top_sources(events, top).collect()])


def at_landmarks(events: DataFrame, at: tuple[float, ...], top: int = 15, show: Callable[[str], None] = print, clock: Callable[[], float] = time.monotonic) -> None:
    """Shows the figures of a stream of events once each time of ``at`` (seconds) has passed, then stops."""
    spark = events.sparkSession
    with intermediates(spark):
        folder = shared_path(spark, "feed")
        fields = events.select("source", "domains")

        def write(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/events/batch={n}")

        spark.createDataFrame([], fields.schema).write.parquet(f"{folder}/events/batch=-1")  # a feed may be silent
        began = clock()
        query: StreamingQuery = fields.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="1 second").start()
        try:
            for mark in sorted(at):
                while (left := mark - (clock() - began)) > 0 and not query.awaitTermination(max(0.01, min(left, 1.0))):
                    pass
                show(text_of(spark.read.schema(fields.schema).parquet(f"{folder}/events"), clock() - began, top))
        finally:
            query.stop()
