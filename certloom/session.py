"""Session, table and checkpoint helpers that behave alike on a cluster and in tests."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "certloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here counts on; ``conf`` overrides them (dots as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all tasks run on this machine."""
    at = spark.conf.get(CHECKPOINT_CONF, None)
    if not at and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    return (at or "file://" + os.path.join(tempfile.gettempdir(), "certloom-shared")).rstrip("/")


#: Innermost last: the intermediate tables made since ``intermediates`` was entered.
_made: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that are made within; results must be written or collected before its end."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a compressed table in the shared folder.

    For narrow intermediate rows that are read more than once: a lost executor costs no
    recomputation of the Python stages behind them, and the copy is columnar and compressed,
    unlike ``checkpoint()``. ``intermediates`` deletes such tables.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def widen(df: DataFrame) -> DataFrame:
    """Spreads rows over all task slots where the input has fewer splits than those (a few small files).

    Inputs of any size have more splits than slots and pass as they are: no shuffle is added to them.
    """
    if df.isStreaming:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
