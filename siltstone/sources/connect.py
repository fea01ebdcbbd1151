"""Kafka and JDBC readers. Only option tables: their connectors are added by the cluster and not tested here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kafka_options(servers: str, topic: str, starting: str = "earliest", group: str | None = None,
                  per_trigger: int | None = None) -> dict[str, str]:
    """Stream options; ``starting`` is earliest or latest and counts only for a new checkpoint."""
    if starting not in ("earliest", "latest"):
        raise ValueError(f"starting must be earliest or latest, not {starting!r}")
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if group:
        options["kafka.group.id"] = group
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return options


def kafka_messages(spark: SparkSession, **options: str) -> DataFrame:
    """Streaming ``(value)`` text of a topic; keyword arguments are those of ``kafka_options``."""
    return (spark.readStream.format("kafka").options(**kafka_options(**options)).load()
            .selectExpr("CAST(value AS STRING) AS value"))


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    """Write options: all replicas acknowledge, three retries, one request in flight."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3",
            "kafka.max.in.flight.requests.per.connection": "1"}


def file_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(value)`` lines of the text files under ``path``."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def relational(spark: SparkSession, url: str, table: str, user: str, password: str, key: str | None = None,
               bounds: tuple[int, int] | None = None, partitions: int = 1) -> DataFrame:
    """A database table by JDBC; a numeric ``key`` with ``bounds`` splits the read over ``partitions`` tasks."""
    options = {"url": url, "dbtable": table, "user": user, "password": password, "fetchsize": "10000"}
    if key and bounds:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                    "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()
