"""Table lifecycle. Parquet tables by default, Iceberg where a catalog is configured (``fmt="iceberg"``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.names import quote_name
from siltstone.operators import versioned
from siltstone.session import quoted

PARQUET = "parquet"
ICEBERG = "iceberg"


class AbsentTable(LookupError):
    """A table that was asked for does not exist."""


def ensure_namespace(spark: SparkSession, namespace: str) -> None:
    """Create the namespace if needed; fail if it is still absent."""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")
    if not spark.catalog.databaseExists(namespace):
        raise LookupError(f"namespace {namespace} could not be created")


def namespaces(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    return spark.sql(f"SHOW NAMESPACES IN {catalog}" if catalog else "SHOW NAMESPACES")


def _properties(fmt: str, properties: dict[str, str] | None) -> str:
    merged = {**({"format-version": "2"} if fmt == ICEBERG else {}), **(properties or {})}
    listed = ", ".join(f"{quoted(key)}={quoted(value)}" for key, value in merged.items())
    return f"TBLPROPERTIES ({listed})" if listed else ""


def create_from(df: DataFrame, table: str, fmt: str = PARQUET, properties: dict[str, str] | None = None) -> None:
    """Drop the table if it exists, then create it from ``df``."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        drop(spark, table)
    spark.sql(f"CREATE TABLE {table} USING {fmt} {_properties(fmt, properties)} AS SELECT * FROM {{rows}}", rows=df)


def create_declared(spark: SparkSession, table: str, columns: str, partition_by: str | None = None,
                    fmt: str = PARQUET, properties: dict[str, str] | None = None) -> None:
    """Create a table with a declared schema unless it exists."""
    partitioned = f"PARTITIONED BY ({partition_by})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {fmt} {partitioned} "
              f"{_properties(fmt, properties)}")
    if not spark.catalog.tableExists(table):
        raise LookupError(f"table {table} could not be created")


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [column.name for column in spark.catalog.listColumns(table) if column.isPartition]


def append(df: DataFrame, table: str, replace_partitions: bool = False) -> None:
    """Append by column name in table order.

    Rows are first gathered by partition column with a rebalance, which keeps files few and splits a partition
    value that holds too much for one task. ``replace_partitions`` overwrites the partitions present in ``df``, so
    that a repeated load leaves no duplicates; the default appends.
    """
    spark = df.sparkSession
    if versioned.is_versioned(spark, table):
        versioned.append(df, table)
        return
    target = spark.table(table)
    rows = df.select(*[F.col(quote_name(c)) for c in target.columns])
    parts = partition_columns(spark, table)
    if parts:
        rows = rows.hint("rebalance", *[F.col(quote_name(p)) for p in parts])
    if replace_partitions and parts:
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table, overwrite=True))
    else:
        rows.write.insertInto(table)


def append_or_create(df: DataFrame, table: str, fmt: str = PARQUET) -> None:
    """Append, creating the table on first write."""
    if df.sparkSession.catalog.tableExists(table):
        append(df, table)
    else:
        df.write.format(fmt).mode("append").saveAsTable(table)


def replace_from(df: DataFrame, table: str, fmt: str = PARQUET) -> None:
    """Create or replace the table with ``df``, which may read the table itself; readers find the old rows or the new.

    Iceberg replaces in one commit. For Parquet the table becomes a versioned one, see ``versioned``.
    """
    if fmt == ICEBERG:
        df.sparkSession.sql(f"CREATE OR REPLACE TABLE {table} USING iceberg {_properties(fmt, None)} "
                            "AS SELECT * FROM {rows}", rows=df)
    else:
        versioned.replace(df, table)


def type_text(kind: T.DataType) -> str:
    """A type as SQL text, with the names inside structs quoted."""
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"{quote_name(f.name)}: {type_text(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{type_text(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{type_text(kind.keyType)}, {type_text(kind.valueType)}>"
    return kind.simpleString()


def declaration(schema: T.StructType) -> str:
    """The columns of a schema as SQL text."""
    return ", ".join(f"{quote_name(f.name)} {type_text(f.dataType)}" for f in schema.fields)


def drop(spark: SparkSession, table: str) -> None:
    """Drop the table, with all versions of a versioned one; an absent table is an error."""
    if not spark.catalog.tableExists(table):
        raise AbsentTable(f"table {table} not found")
    if versioned.is_versioned(spark, table):
        versioned.drop(spark, table)
    else:
        spark.sql(f"DROP TABLE {table}")


def listing(frames: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count, columns)`` of named frames, as one plan."""
    if not frames:
        raise ValueError("no tables to list")
    rows = [df.agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(name).alias("table_name"), "row_count",
                    F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
            for name, df in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def list_tables(spark: SparkSession, namespace: str) -> DataFrame:
    """Catalog listing of a namespace: the tables' names come from the catalog, the counts of versioned tables from their
    ledger and all others from one Spark job."""
    known = versioned.ledger(spark, namespace)
    listed = {r["table_name"] for r in known.collect()}
    names = [t.name for t in spark.catalog.listTables(namespace) if not t.isTemporary and t.name not in listed]
    if not names:
        return known
    return known.unionByName(listing({name: spark.table(f"{namespace}.{quote_name(name)}") for name in names}))


def readiness(spark: SparkSession, namespace: str, table: str) -> DataFrame:
    """The listing row of ``table`` with its endpoint; an absent table is an error, an empty one is ready."""
    if not spark.catalog.tableExists(f"{namespace}.{table}"):
        raise AbsentTable(f"table {table} not found in {namespace}")
    name = f"{namespace}.{table}"
    found = (versioned.ledger(spark, namespace).where(F.col("table_name") == table) if versioned.is_versioned(spark, name)
             else listing({table: spark.table(name)}))
    return (found.withColumn("api_endpoint", F.lit(f"/api/data/{table}")))
