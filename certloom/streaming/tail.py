"""Following the output of a run: new records of a growing folder as lines of text."""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORD = "detected_at string, source string, serial_number string, domain string, families array<string>, rules array<string>, domains array<string>"


def record_line() -> Column:
    """One line a record, in the layout of detections where it has rules, else in that of certificates."""
    head = F.concat(F.substring("detected_at", 12, 8), F.lit("  "))
    detection = F.concat(head, F.rpad(F.array_join("rules", ","), 20, " "), F.lit(" "), F.col("domain"), F.lit("  ["), F.array_join("families", ", "), F.lit("]  "), F.col("source"))
    certificate = F.concat(head, F.array_join("domains", ", "), F.lit("  "), F.coalesce("source", F.lit("?")))
    return F.when(F.col("rules").isNotNull(), detection).otherwise(certificate)


def rendered(records: DataFrame) -> DataFrame:
    """(line): records that are malformed or hold nothing to show are left out."""
    return records.select(record_line().alias("line")).where("line is not null")


def follow(spark: SparkSession, folder: str, show: Callable[[str], None] = print, from_start: bool = False, trigger: dict | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Shows new records as they come; without ``from_start`` only those of files written from now on.

    The stream source reads finished files, so a half-written line is never shown.
    """
    records = spark.readStream.schema(RECORD).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(folder)
    if not from_start:
        records = records.where(F.col("_metadata.file_modification_time") >= F.timestamp_seconds(F.lit(time.time())))

    def each(batch: DataFrame, _: int) -> None:
        for r in rendered(batch).toLocalIterator():
            show(r.line)

    fields = records.select("detected_at", "source", "serial_number", "domain", "families", "rules", "domains")
    writer = fields.writeStream.foreachBatch(each).trigger(**(trigger or {"processingTime": "500 milliseconds"}))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
