"""Feed messages (JSON Lines) and their mapping to certificate events.

Cases: messages of other types and blank lines are skipped. A malformed line fails a replay (FAILFAST) and
is dropped from a live feed. A message without a required field is put aside by ``invalid_messages`` and
counted, where ``strict`` mapping raises instead. Missing, null or empty issuer country and organisation
are null; a missing common name is the empty text; a missing source or source name is "unknown".
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CERTIFICATE = "certificate_update"
PRECERT = "PrecertLogEntry"

#: What is read of a message; keys that are not declared are not parsed.
MESSAGE = """
message_type string,
data struct<
  update_type: string, cert_index: bigint, seen: double,
  source: struct<url: string, name: string>,
  leaf_cert: struct<
    serial_number: string, signature_algorithm: string, not_before: double, not_after: double,
    all_domains: array<string>, issuer: struct<C: string, O: string, CN: string>, fingerprint: string>>
"""

_REQUIRED = ("serial_number", "signature_algorithm", "all_domains", "not_before", "not_after")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Replay of JSON Lines; a malformed line fails the job."""
    return spark.read.schema(MESSAGE).option("mode", "FAILFAST").json(path)


def stream_messages(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """New JSON Lines files of a folder as a stream; malformed lines are dropped."""
    return spark.readStream.schema(MESSAGE).options(**options).option("mode", "DROPMALFORMED").json(folder)


def parse_frames(frames: DataFrame, column: str = "value") -> DataFrame:
    """Text frames of a live feed to messages; frames that are no JSON are dropped."""
    got = frames.select(F.from_json(F.col(column), MESSAGE).alias("m"))
    return got.select("m.*").where(F.col("message_type").isNotNull())


def _complete() -> Column:
    leaf = F.col("data.leaf_cert")
    ok = leaf.isNotNull()
    for f in _REQUIRED:
        ok = ok & leaf[f].isNotNull()
    return F.coalesce(ok, F.lit(False))


def invalid_messages(messages: DataFrame) -> DataFrame:
    """Certificate messages that lack a required field."""
    return messages.where((F.col("message_type") == CERTIFICATE) & ~_complete())


def to_events(messages: DataFrame, *keep: str, strict: bool = False) -> DataFrame:
    """Certificate events, with the columns ``keep`` in front. Incomplete messages raise if ``strict``, else are left out."""
    rows = messages.where(F.col("message_type") == CERTIFICATE)
    leaf = F.col("data.leaf_cert")
    serial = leaf["serial_number"]
    if strict:
        serial = F.when(_complete(), serial).otherwise(F.raise_error(F.lit("a certificate message lacks a required field")))
    else:
        rows = rows.where(_complete())
    return rows.select(
        *keep,
        serial.alias("serial_number"),
        leaf["signature_algorithm"].alias("signature_algo"),
        F.nullif(leaf["issuer"]["C"], F.lit("")).alias("issuer_country"),
        F.nullif(leaf["issuer"]["O"], F.lit("")).alias("issuer_organisation"),
        F.coalesce(leaf["issuer"]["CN"], F.lit("")).alias("issuer_common_name"),
        F.timestamp_seconds(leaf["not_before"]).alias("validity_not_before"),
        F.timestamp_seconds(leaf["not_after"]).alias("validity_not_after"),
        leaf["all_domains"].alias("domains"),
        F.coalesce("data.source.name", F.lit("unknown")).alias("source"),
        F.col("data.cert_index").alias("cert_index"),
        F.coalesce(F.col("data.update_type") == PRECERT, F.lit(False)).alias("is_precert"),
    )
