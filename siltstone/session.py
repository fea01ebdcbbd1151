"""Session settings and the shared work folder.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` so that they outlive any executor.
A private temporary folder is used only for a local master where nothing is configured.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# A frame within these bounds is small: it may be broadcast, or handled by one task.
SMALL_ROWS = 100_000
SMALL_BYTES = 64 * 1024 * 1024


def build_session(app_name: str, conf: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings every job relies on; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def catalog_conf(name: str, *, uri: str, warehouse: str, credential: str | None = None,
                 scope: str | None = None, token_uri: str | None = None) -> dict[str, str]:
    """Spark conf that defines one Iceberg REST catalog. Secrets are arguments, never constants."""
    prefix = f"spark.sql.catalog.{name}"
    conf = {
        prefix: "org.apache.iceberg.spark.SparkCatalog",
        f"{prefix}.type": "rest",
        f"{prefix}.uri": uri,
        f"{prefix}.warehouse": warehouse,
        "spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions",
    }
    optional = {"credential": credential, "scope": scope, "oauth2-server-uri": token_uri}
    conf.update({f"{prefix}.{key}": value for key, value in optional.items() if value is not None})
    return conf


def work_root(spark: SparkSession) -> str:
    """The shared folder of this application."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siltstone-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/siltstone-{context.applicationId}"


# Namespaces that point into the work folder, by application.
_namespaces: dict[str, list[str]] = {}


def clear_work(spark: SparkSession) -> None:
    """Drop this application's work namespaces and remove its folder; for the end of a job, when no frame or table in it
    is needed any more."""
    for name in _namespaces.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP NAMESPACE IF EXISTS {name} CASCADE")
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def fresh_namespace(spark: SparkSession, label: str) -> str:
    """A new, empty namespace of the session catalog kept in the shared folder."""
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    place = quoted(fresh_dir(spark, name))
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name} LOCATION {place}")
    _namespaces.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Settled:
    """A frame written to the shared folder, with its measured rows and bytes."""

    frame: DataFrame
    rows: int
    size: int

    def narrowed(self, frame: DataFrame) -> Settled:
        """``frame`` is derived from this one with no more rows and no wider ones."""
        return Settled(frame, self.rows, self.size)


def row_bytes(df: DataFrame) -> Column:
    """Width of a row: the length of text, the JSON length of nested values, eight for anything else."""
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        value = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            width = width + F.octet_length(F.to_json(F.struct(value)))
        else:
            width = width + 8
    return width


def size_aggregates(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("size")]


# Removes the shuffle files of a statement when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Statements run inside leave no shuffle files. Only for frames that are written and read back: what is run again from
    its lineage would have to shuffle anew."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def settle(df: DataFrame, label: str = "settled") -> Settled:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and the write itself counts the rows. What was
    shuffled for it is removed from the disks.

    A frame of at most ``SMALL_ROWS`` rows and ``SMALL_BYTES`` bytes is read as one partition, so that what follows on
    such frames alone, like the rounds of a closure, needs no exchange.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    seen = Observation()
    with shuffles_removed(spark):
        df.observe(seen, *size_aggregates(df)).write.parquet(path)
    rows, size = seen.get["rows"], seen.get["size"]
    frame = spark.read.schema(df.schema).parquet(path)
    return Settled(frame.coalesce(1) if rows <= SMALL_ROWS and size <= SMALL_BYTES else frame, rows, size)
