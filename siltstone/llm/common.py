"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import fresh_dir

# Fixed value: the characters between words, as a regular expression class.
SPACES = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, pieces: int, most: int = 8) -> DataFrame:
    """Rows that each stand for a piece of work, dealt over tasks: one to a task while the cluster has room, and at most
    ``most`` beyond. The rows are small, so that Spark, left to itself, would put them all into one task."""
    room = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(pieces, max(room, -(-pieces // most)))))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def column(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def word_array(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_SPACE + "+")).cast("bigint")


def symbol_count(text: Column, symbols: str) -> Column:
    """How many characters of the text are in the class ``symbols``; texts with none are only scanned for one."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain.rlike(symbols), F.regexp_count(plain, F.lit(symbols))).otherwise(0).cast("bigint")


def shared_files(uri: str):
    """The file system and path of a folder that all executors share, for files that Spark has no writer for."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])
