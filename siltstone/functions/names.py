"""Identifier clean-up, for Python strings (headers) and for columns of names."""

from __future__ import annotations

import posixpath

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]"
COLUMN_PREFIX = "col_"
TABLE_PREFIX = "table_"


def clean_name(name: str, prefix: str) -> str:
    """Lower case, blanks to ``_``, only letters, digits and ``_``; ``prefix`` if no letter comes first."""
    kept = regex.sub(NOT_WORD, "", name.lower().replace(" ", "_"))
    return prefix + kept if kept and not regex.match(r"\p{L}", kept) else kept


def clean_column_name(name: str) -> str:
    return clean_name(name, COLUMN_PREFIX)


def clean_table_name(name: str) -> str:
    return clean_name(name, TABLE_PREFIX)


def table_name_for(filename: str, table_name: str | None = None) -> str:
    """Cleaned ``table_name``, or the file's stem where none is given."""
    chosen = table_name if table_name and table_name.strip() else posixpath.splitext(filename)[0]
    return clean_table_name(chosen)


def clean_name_column(value: Column, prefix: str) -> Column:
    """The same rule as a column expression."""
    kept = F.regexp_replace(F.translate(F.lower(value), " ", "_"), NOT_WORD, "")
    bare = (kept == "") | kept.rlike(r"^\p{L}")
    return F.when(bare, kept).otherwise(F.concat(F.lit(prefix), kept))


def clean_headers(df: DataFrame) -> DataFrame:
    """Rename every column by the rule; two headers with one cleaned name are an error."""
    names = [clean_column_name(name) for name in df.columns]
    if "" in names:
        raise ValueError("a header has no letter or digit")
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"headers collide after clean-up: {', '.join(repeated)}")
    return df.toDF(*names)


def quote_name(name: str) -> str:
    """A column name as SQL text, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever its case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
