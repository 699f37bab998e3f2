"""The batch detection inside a stream: each micro-batch goes through the same plan and is written once.

A micro-batch overwrites its own folder (``run=<run>/batch=<id>``), so a batch that is run again after a
failure replaces its output instead of adding to it. A run is named after its checkpoint: another run into
the same folder adds to what is there. Intermediate tables of a micro-batch are deleted at its end.
"""

import hashlib
import logging
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from certloom.operators import kpis
from certloom.operators.context import DetectContext
from certloom.operators.detect import detect, detection_records, raw_records, strip_wildcards
from certloom.session import intermediates
from certloom.sources import messages

log = logging.getLogger(__name__)


class RunningFigures:
    """Figures of a run over its micro-batches, for snapshots; the counts per batch are aggregates of a few rows."""

    def __init__(self) -> None:
        self.totals = {"n_certs": 0, "n_domains": 0, "n_found": 0, "n_reasons": 0}
        self.by_rule: dict[str, int] = {}
        self.by_family: dict[str, int] = {}
        self.marked = 0
        self.seconds = 0.0
        self.fastest: float | None = None
        self.slowest: float | None = None

    def add(self, events: DataFrame, found: DataFrame) -> None:
        """Counts a micro-batch. Its certificates are analysed together, so each one's time is their mean."""
        began = time.monotonic()
        certs = self._count(events, found)
        took = time.monotonic() - began
        self.seconds += took
        if certs:
            each = took / certs
            self.fastest = each if self.fastest is None else min(self.fastest, each)
            self.slowest = each if self.slowest is None else max(self.slowest, each)

    def _count(self, events: DataFrame, found: DataFrame) -> int:
        fed = kpis.feed_totals(events).first()
        self.totals["n_certs"] += fed.n_certs
        self.totals["n_domains"] += fed.n_domains
        reasons = found.select(F.posexplode("reasons").alias("place", "r")).groupBy("r.family", "r.rule")
        for r in reasons.agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("hosts")).collect():
            self.by_rule[r["rule"]] = self.by_rule.get(r["rule"], 0) + r.n
            self.by_family[r["family"]] = self.by_family.get(r["family"], 0) + r.n
            self.totals["n_reasons"] += r.n
            self.totals["n_found"] += r.hosts
        return fed.n_certs

    def snapshot(self, elapsed: float, window: float) -> str:
        """Text of the figures so far; the mark of the interval moves on."""
        ranked = lambda d: sorted(d.items(), key=lambda x: (-x[1], x[0]))
        new = self.totals["n_domains"] - self.marked
        self.marked = self.totals["n_domains"]
        return kpis.snapshot(self.totals, ranked(self.by_family), ranked(self.by_rule), elapsed, window, new, (self.seconds, self.fastest, self.slowest))


def batch_writer(out: str | None, run: str, ctx: DetectContext | None, skip_wildcards: bool = True, figures: RunningFigures | None = None, counted: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: detect and write records, or write certificates as they are if ``ctx`` is None.

    With ``figures`` no records are written. ``out`` None or "-" prints JSON lines to standard output.
    """

    def one(events: DataFrame, batch: int) -> None:
        events = strip_wildcards(events) if skip_wildcards else events
        if ctx is None:
            records = raw_records(events)
        else:
            found = detect(events, ctx, skip_wildcards=False)
            if figures is not None:
                figures.add(events, found)
                return
            records = detection_records(found)
        n = 0
        if out is None or out == "-":
            for n, r in enumerate(records.toJSON().toLocalIterator(), 1):
                print(r, file=sys.stdout, flush=True)
        else:
            to = f"{out}/run={run}/batch={batch}"
            records.write.mode("overwrite").option("ignoreNullFields", "false").json(to)
            n = records.sparkSession.read.schema(records.schema).json(to).count()
        if counted is not None:
            counted.append(n)

    def write(events: DataFrame, batch: int) -> None:
        with intermediates(events.sparkSession):
            one(events, batch)

    return write


def message_writer(write: Callable[[DataFrame, int], None], aside: dict[int, int]) -> Callable[[DataFrame, int], None]:
    """What a micro-batch of messages does: ``write`` gets its events; ``aside`` how many messages are incomplete, by batch."""

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.persist()  # a batch of the feed is bounded; it is read more than once
        try:
            if lacking := messages.invalid_messages(batch).count():
                aside[n] = lacking  # a batch that is run again counts once
                log.warning("batch %d: %d incomplete certificate message(s) put aside", n, lacking)
            write(messages.to_events(batch), n)
        finally:
            batch.unpersist()

    return run


def run_name(checkpoint: str) -> str:
    """The name of the run that goes on from a checkpoint, however often it is started."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def start(events: DataFrame, out: str | None, checkpoint: str, ctx: DetectContext | None, skip_wildcards: bool = True, trigger: dict | None = None, figures: RunningFigures | None = None) -> StreamingQuery:
    """Starts the query over a stream of certificate events."""
    writer = events.writeStream.foreachBatch(batch_writer(out, run_name(checkpoint), ctx, skip_wildcards, figures)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
