"""Versioned tables: a view over the folders of one version, with a ledger of what they hold.

The rows of a table lie in folders below ``<namespace>/<name>.versions``, where numbered manifests say which folders make up
which version and how many rows each has. The table itself is a view over the folders of the newest version. A replacement
or an append writes a new folder, commits the manifest and then switches the view by one statement, so that readers find
the version before or the new one, never none, also where columns change. Old versions are kept for a while for readers
that have begun on them, and go with the next expiry.

The ledger is counted while the rows are written and held against the row counts in the files. Listings and gates are
answered from it without a look at the data; ``audit`` compares it with a scan. Measures, sums of the writer's choice, and
counts by a column are kept in the same way.
"""

from __future__ import annotations

import time
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.names import quote_name
from siltstone.operators.versions import Conflict, Store

SUFFIX = ".versions"
KEPT_VERSIONS = 2
KEPT_SECONDS = 600
MOST_FOLDERS = 16

_LISTING = "table_name string, row_count bigint, columns array<string>"


def _space(spark: SparkSession, namespace: str) -> str:
    return spark.catalog.getDatabase(namespace).locationUri.rstrip("/")


def _split(spark: SparkSession, table: str) -> tuple[str, str]:
    namespace, _, name = table.rpartition(".")
    return namespace or spark.catalog.currentDatabase(), name.strip("`")


def store_of(spark: SparkSession, table: str) -> Store:
    namespace, name = _split(spark, table)
    return Store(spark, f"{_space(spark, namespace)}/{name}{SUFFIX}")


def is_versioned(spark: SparkSession, table: str) -> bool:
    """Is the table a view that this module made?"""
    return (spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType == "VIEW"
            and store_of(spark, table).current() is not None)


def _written(store: Store, rows: DataFrame, measures: dict[str, Column], by: str | None) -> dict[str, Any]:
    """A new folder of rows and its ledger."""
    path, seen, spark = store.fresh(), Observation(), store.spark
    totals = [F.sum(c.cast("decimal(38,6)")).cast("string").alias(n) for n, c in measures.items()]
    rows.observe(seen, F.count(F.lit(1)).alias("rows of the folder"), *totals).write.parquet(path)
    # Row counts of Parquet files are read from their footers. A repeated task may have been observed twice.
    stored = spark.read.schema(rows.schema).parquet(path)
    count, found = stored.count(), seen.get
    if found["rows of the folder"] != count:
        found = stored.agg(*totals).first().asDict() if totals else {}
    entry = {"path": path, "rows": count, "measures": {n: found[n] for n in measures}}
    if by is not None:
        entry["counts"] = store.fresh()
        stored.groupBy(F.col(quote_name(by)).alias("value")).agg(F.count(F.lit(1)).alias("rows")).write.parquet(entry["counts"])
    return entry


def _scan(entry: dict[str, Any], schema: T.StructType) -> str:
    """The rows of a folder as SQL; columns that it lacks are NULL."""
    held = {n.lower() for n in entry["columns"]}
    columns = [quote_name(f.name) if f.name.lower() in held else
               f"CAST(NULL AS {_type(f.dataType)}) AS {quote_name(f.name)}" for f in schema.fields]
    return f"SELECT {', '.join(columns)} FROM parquet.{quote_name(entry['path'])}"


def _type(kind: T.DataType) -> str:
    from siltstone.operators.tables import type_text
    return type_text(kind)


def _publish(spark: SparkSession, table: str, document: dict[str, Any]) -> None:
    """Point the view at the folders of a version, in one statement."""
    schema = T.StructType.fromJson(document["schema"])
    body = " UNION ALL ".join(_scan(entry, schema) for entry in document["folders"])
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS {body}")


def _commit(spark: SparkSession, table: str, store: Store, document: dict[str, Any], before: int | None) -> None:
    store.commit({**document, "written": time.time()}, before)
    _publish(spark, table, document)
    _expire(store)


def _expire(store: Store) -> list[str]:
    """Remove versions that are neither among the last nor recent."""
    recent = [v for v in store.versions() if time.time() - (store.read(v) or {"written": 0}).get("written", 0) < KEPT_SECONDS]
    return store.expire(max(KEPT_VERSIONS, len(recent)))


def replace(df: DataFrame, table: str, measures: dict[str, Column] | None = None, by: str | None = None) -> None:
    """Create the table, or replace it, with ``df``, which may read the table itself.

    ``measures`` are columns whose sums the ledger keeps, ``by`` a column whose values it counts. A plain table of that
    name is dropped first; only then is there a moment without it.
    """
    spark, store = df.sparkSession, store_of(df.sparkSession, table)
    before = store.current()
    entry = {**_written(store, df, measures or {}, by), "columns": df.columns}
    if spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType != "VIEW":
        spark.sql(f"DROP TABLE {table}")
    _commit(spark, table, store, {"schema": df.schema.jsonValue(), "folders": [entry], "by": by}, before[0] if before else None)


def append(df: DataFrame, table: str, measures: dict[str, Column] | None = None) -> None:
    """Add rows by column name; columns that the table lacks are added to it, NULL in earlier rows.

    A table of many folders is gathered into fewer: the smaller ones are written into one. Measures must be those that the
    table was made with.
    """
    spark, store = df.sparkSession, store_of(df.sparkSession, table)
    found = store.current()
    if found is None:
        raise LookupError(f"{table} is not a versioned table")
    before, document = found
    folders, by = document["folders"], document["by"]
    if set(measures or {}) != set(folders[0]["measures"]):
        raise ValueError(f"{table} keeps the measures {sorted(folders[0]['measures'])}")
    held = T.StructType.fromJson(document["schema"])
    known = {f.name.lower(): f for f in held.fields}
    for f in df.schema.fields:
        if f.name.lower() in known and known[f.name.lower()].dataType != f.dataType:
            raise TypeError(f"column {f.name} of {table} is {known[f.name.lower()].dataType.simpleString()}")
    schema = T.StructType(held.fields + [f for f in df.schema.fields if f.name.lower() not in known])
    entry = {**_written(store, df, measures or {}, by), "columns": df.columns}
    document = {**document, "schema": schema.jsonValue(), "folders": [*folders, entry]}
    if len(document["folders"]) > MOST_FOLDERS:
        document["folders"] = _gathered(store, document, schema)
    _commit(spark, table, store, document, before)


def _gathered(store: Store, document: dict[str, Any], schema: T.StructType) -> list[dict[str, Any]]:
    """The folders with the smaller half of them written into one; ledgers add up."""
    ordered = sorted(document["folders"], key=lambda e: e["rows"])
    small, large = ordered[: MOST_FOLDERS // 2 + 1], ordered[MOST_FOLDERS // 2 + 1:]
    rows = store.spark.sql(" UNION ALL ".join(_scan(e, schema) for e in small))
    entry = {**_written(store, rows, {}, document["by"]), "columns": schema.names}
    entry["measures"] = {n: _added([e["measures"][n] for e in small]) for n in small[0]["measures"]}
    return [*large, entry]


def _added(parts: list[str | None]) -> str | None:
    held = [Decimal(p) for p in parts if p is not None]
    return str(sum(held)) if held else None


def drop(spark: SparkSession, table: str) -> None:
    """Drop the table with all its versions."""
    store = store_of(spark, table)
    spark.sql(f"DROP VIEW IF EXISTS {table}")
    store.drop()


def refresh(spark: SparkSession, table: str) -> None:
    """Point the view at the newest version, for a writer that died between the commit and the switch."""
    found = store_of(spark, table).current()
    if found is None:
        raise LookupError(f"{table} is not a versioned table")
    _publish(spark, table, found[1])


def expire(spark: SparkSession, namespace: str) -> list[str]:
    """Remove outlived versions of all tables of a namespace, and everything of tables that are gone; what was removed."""
    home = Store(spark, _space(spark, namespace))
    tables, removed = {t.name.lower() for t in spark.catalog.listTables(namespace)}, []
    for folder in home._names(""):
        if folder.endswith(SUFFIX):
            store = Store(spark, f"{home.root}/{folder}")
            if folder.removesuffix(SUFFIX).lower() in tables:
                removed += _expire(store)
            else:
                store.drop()
                removed.append(folder)
    return removed


# -- the ledger ---------------------------------------------------------------------------------------------------------

def ledger(spark: SparkSession, namespace: str) -> DataFrame:
    """``(table_name, row_count, columns)`` of the versioned tables of a namespace, without a look at their rows."""
    rows = []
    for name in sorted(t.name for t in spark.catalog.listTables(namespace) if t.tableType == "VIEW"):
        found = store_of(spark, f"{namespace}.{quote_name(name)}").current()
        if found is not None:
            document = found[1]
            rows.append((name, sum(e["rows"] for e in document["folders"]), [f["name"] for f in document["schema"]["fields"]]))
    return spark.createDataFrame(rows, _LISTING)


def measured(spark: SparkSession, table: str) -> dict[str, Decimal | None]:
    """The sums that the ledger keeps of a table."""
    found = store_of(spark, table).current()
    if found is None:
        raise LookupError(f"{table} is not a versioned table")
    folders = found[1]["folders"]
    sums = {n: _added([e["measures"][n] for e in folders]) for n in folders[0]["measures"]}
    return {n: None if v is None else Decimal(v) for n, v in sums.items()}


def counts_by(spark: SparkSession, table: str) -> DataFrame:
    """``(value, rows)`` of the column that the ledger counts."""
    found = store_of(spark, table).current()
    if found is None or found[1]["by"] is None:
        raise LookupError(f"{table} keeps no counts by a column")
    parts = spark.read.parquet(*[e["counts"] for e in found[1]["folders"]])
    return parts.groupBy("value").agg(F.sum("rows").alias("rows"))


def audit(spark: SparkSession, namespace: str) -> DataFrame:
    """``(table_name, ledger_rows, scanned_rows, agrees)`` of the versioned tables of a namespace."""
    held = ledger(spark, namespace).withColumnRenamed("row_count", "ledger_rows")
    names = [r["table_name"] for r in held.collect()]
    if not names:
        return spark.createDataFrame([], "table_name string, ledger_rows bigint, scanned_rows bigint, agrees boolean")
    from siltstone.operators.tables import listing
    scanned = listing({n: spark.table(f"{namespace}.{quote_name(n)}") for n in names})
    both = held.select("table_name", "ledger_rows").join(scanned.select("table_name", F.col("row_count").alias("scanned_rows")),
                                                         "table_name")
    return both.withColumn("agrees", F.col("ledger_rows") == F.col("scanned_rows"))


__all__ = ["Conflict", "append", "audit", "counts_by", "drop", "expire", "is_versioned", "ledger", "measured", "refresh",
           "replace", "store_of"]
