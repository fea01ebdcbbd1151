"""Keeping grant tables: updates with a change stamp, single grants and revocations, rule checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.access import OBJECT_TYPES, PRIVILEGES
from siltstone.session import settle


def merge_updates(current: DataFrame, updates: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """``current`` with the rows of ``updates`` written over it by ``key``; new keys are added. A key that occurs twice on
    either side fails the job.

    ``updated_at`` of every updated row becomes ``now`` and that of untouched rows stays, also where the values are
    the same as before; ``created_at`` is kept from the first version.
    """
    now = F.current_timestamp() if now is None else now
    values = [c for c in current.columns if c not in (key, "created_at", "updated_at")]
    fresh = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_changed"))
    joined = current.withColumn("_known", F.lit(True)).join(fresh, key, "full_outer")
    stamp = now.cast(current.schema["updated_at"].dataType)
    changed = F.col("_changed").isNotNull()
    built = {c: F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in values}
    built["created_at"] = F.when(F.col("_known").isNotNull(), F.col("created_at")).otherwise(stamp)
    built["updated_at"] = F.when(changed, stamp).otherwise(F.col("updated_at"))
    rows = joined.select(*[built[c].alias(c) if c in built else F.col(c) for c in current.columns])
    # The join has put equal keys together, so counting them moves nothing.
    times = F.count(F.lit(1)).over(W.partitionBy(key))
    message = F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))
    checked = rows.withColumn("_times", times)
    once = F.when(F.col("_times") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.where(once).drop("_times")


def grant(tuples: DataFrame, added: DataFrame) -> DataFrame:
    """Add relationship tuples to a set of tuples; one already there stays single. Only the added ones are compared."""
    fresh = added.select(*tuples.columns).distinct().join(tuples, tuples.columns, "left_anti")
    return tuples.unionByName(fresh)


def revoke(tuples: DataFrame, removed: DataFrame) -> DataFrame:
    """``tuples`` without those of ``removed``."""
    return tuples.join(removed.select(*tuples.columns), tuples.columns, "left_anti")


def grant_violations(relation: DataFrame) -> DataFrame:
    """``(rule, violations)`` for the rules of the grant table, zero rows included.

    Keys with NULL ``columns`` never repeat: two table-wide grants are no conflict.
    """
    relation = settle(relation, "grant-rows").frame
    unknown = F.array_except("actions", F.array(*[F.lit(p) for p in PRIVILEGES]))
    row_rules = {
        "actions_empty": F.coalesce(F.size("actions"), F.lit(0)) <= 0,
        "actions_unknown": F.coalesce(F.size(unknown), F.lit(0)) > 0,
        "object_type_unknown": ~F.coalesce(F.col("object_type").isin(*OBJECT_TYPES), F.lit(False)),
    }
    counts = relation.agg(*[F.count(F.when(rule, 1)).alias(name) for name, rule in row_rules.items()])
    by_rule = counts.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(name) for name in row_rules]), F.array(*[F.col(name) for name in row_rules])))
        .alias("rule", "violations"))
    repeated = repeated_keys(relation, ["user_id", "object_id", "object_type", "columns"], "grant_repeated")
    return by_rule.unionByName(repeated)


def repeated_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """``(rule, violations)``: how many key values, none of them NULL, occur more than once.

    Keys of text or nested values are compared by a 256-bit digest, so that only digests are shuffled.
    """
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    plain = all(isinstance(df.schema[k].dataType, (T.NumericType, T.DatetimeType, T.BooleanType)) for k in keys)
    by = [F.col(k) for k in keys] if plain else [F.sha2(F.to_json(F.struct(*keys)), 256).alias("digest")]
    return (df.where(present).groupBy(*by).count().where("count > 1")
            .agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """``(key, child_rows)`` of child keys without a parent. Child rows are counted per key before the join."""
    counted = (child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key"))
               .agg(F.count(F.lit(1)).alias("child_rows")))
    known = parent.select(F.col(parent_key).alias("key")).distinct()
    return counted.join(known, "key", "left_anti")
