"""An index of privilege grants: objects numbered in path order, and per user and list of privileges a bitmap of the
objects held.

A grant on a container is the interval of all that lies in it, a grant on a table one bit; the grants of a user share words
(see ``intervals``). A request becomes the number of the object it asks about, or of the deepest known object around it, and
is answered by words of that user: no names are compared, and a container is never multiplied by what it holds. Grants that
name columns keep their own sets, one per list of columns.

What users hold at many places (``held``) is found user by user: distinct places are numbered once, a user and two numbers
travel for each place asked, and words and places meet in the order of one sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.names import free_names, quote_name
from siltstone.operators import access
from siltstone.operators.intervals import BITS, Labels, holds, path_labels, probe, range_words
from siltstone.operators.joins import lookup_join
from siltstone.session import Settled, settle

# Bits of a place's number that tell apart what is asked about at one object.
RANK_BITS = 28


@dataclass(frozen=True)
class EntitlementIndex:
    """``words(user_id, privileges, columns, level, word, bits)`` over ``places``; ``columns`` is NULL for whole objects."""

    places: Labels
    words: Settled

    def numbers(self, requests: DataFrame, depth: str) -> DataFrame:
        """``requests(catalog, schema, table, <depth>)`` with ``at``: the number of the object named down to ``depth``, or of
        the deepest known one around it; requests in unknown catalogs are dropped."""
        tree, found = self.places.tree, requests
        for level, names in enumerate((["catalog"], ["catalog", "schema"], ["catalog", "schema", "table"]), 1):
            lower = [c for c in access.PLACE if c not in names]
            known = tree.frame.where(" AND ".join([f"`{c}` = ''" for c in lower] + [f"`{names[-1]}` <> ''"]))
            here = known.select(*names, F.col("low").alias(f"_at{level}"))
            found = lookup_join(found, tree.narrowed(here), names, "inner" if level == 1 else "left")
        at = F.when(F.col(depth) >= 2, F.coalesce(F.when(F.col(depth) >= 3, F.col("_at3")), F.col("_at2"), F.col("_at1")))
        return found.withColumn("at", at.otherwise(F.col("_at1"))).drop("_at1", "_at2", "_at3")

    def coverage(self, requests: DataFrame) -> DataFrame:
        """What ``access.coverage`` finds for ``requests(key, user_id, operation, resource)``, from the index."""
        res = F.col("resource")
        rules = access._rules(requests.sparkSession)
        own = F.when(res["level"] == "table", 3).when(res["level"] == "schema", 2).otherwise(1)
        named = F.when(res["catalog"].isNull(), 0).when(res["schema"].isNull(), 1).when(res["table"].isNull(), 2).otherwise(3)
        asked = requests.join(F.broadcast(rules), "operation").select(
            "key", "user_id", "_wanted", "_fixed", res["columns"].isNull().alias("_free"), named.alias("_named"),
            F.coalesce("_fixed", own).alias("_depth"),
            *[F.coalesce(res[c], F.lit("")).alias(c) for c in access.PLACE])
        users = self.words.frame.select("user_id").distinct()
        none = F.lit(None).cast("array<string>").alias("columns")
        somewhere = lookup_join(asked.where("_fixed = 0").select("key", "user_id").distinct(), users, ["user_id"], "left_semi")
        placed = self.numbers(asked.where("_depth BETWEEN 1 AND _named"), "_depth").drop(*access.PLACE)
        hits = probe(placed, self.words, ["user_id"], self.places.levels).where(
            (F.col("_wanted") == access.ANY) | F.array_contains("privileges", "ALL")
            | F.array_contains("privileges", F.col("_wanted")))
        whole = F.col("columns").isNull() | (F.col("_depth") < 3) | F.col("_free")
        rows = hits.select("key", whole.alias("whole"), F.when(~whole, F.col("columns")).alias("columns")).unionByName(
            somewhere.select("key", F.lit(True).alias("whole"), none))
        return rows.groupBy("key").agg(F.bool_or("whole").alias("whole"),
                                       F.array_distinct(F.flatten(F.collect_set("columns"))).alias("covered"))

    def decide(self, requests: DataFrame) -> DataFrame:
        """``access.decide`` from the index: ``requests(user_id, operation, resource)`` plus ``allowed``."""
        key, = free_names(requests, "key")
        asked = access.looked_up(F.col("resource"))
        keyed = requests.withColumn(key, access.request_key(F.col("user_id"), F.col("operation"), asked))
        open_to_all = access.always_allowed(F.col("operation"), F.col("resource"))
        once = settle(keyed.where(~open_to_all).select(F.col(key).alias("key"), "user_id", "operation", asked.alias("resource"))
                      .distinct(), "requests")
        found = self.coverage(once.frame).withColumnRenamed("key", key)
        joined = lookup_join(keyed.where(~open_to_all), found, [key], "left")
        missing = F.array_except(F.col("resource")["columns"], F.col("covered"))
        decided = joined.withColumn("allowed", F.coalesce(F.col("whole") | (F.size(missing) == 0), F.lit(False)))
        names = [F.col(quote_name(c)) for c in requests.columns]
        return decided.select(*names, "allowed").unionByName(
            requests.where(open_to_all).select(*names, F.lit(True).alias("allowed")))

    def held(self, user_places: DataFrame) -> DataFrame:
        """``user_places(user_id, catalog, schema, table)``, '' below their level, with the sorted ``privileges`` that the
        user holds there, whole or for some columns; places where none is held are absent.

        ``user_places`` is read twice, first for its distinct places. What a user asks and holds is sorted in one task; words
        above the lowest level are met as a list, as few containers of 64 and more objects are granted to one user.
        """
        names = [c for c in user_places.columns if c.lower() != "user_id"]
        depth = F.when(F.col("table") != "", 3).when(F.col("schema") != "", 2).otherwise(1).alias("_depth")
        quoted = [F.col(quote_name(c)) for c in names]
        placed = self.numbers(user_places.select(*quoted).distinct().select("*", depth), "_depth")
        # A place is the number of its object and, from 1, its own among the places there, in one column.
        rank = F.row_number().over(W.partitionBy("at").orderBy(*quoted))
        spots = settle(placed.select((F.shiftleft(F.col("at").cast("bigint"), RANK_BITS) + rank).alias("_spot"),
                                     *[c.alias(f"_name{i}") for i, c in enumerate(quoted)]), "spots")
        # Names that are NULL are places too, inside what is known around them.
        same = reduce(Column.__and__, [c.eqNullSafe(F.col(f"_name{i}")) for i, c in enumerate(quoted)])
        asked = lookup_join(user_places.where("user_id IS NOT NULL"), spots, same).select("user_id", "_spot")
        sets = self.words.frame.where("user_id IS NOT NULL").select(
            "user_id", F.call_function("shiftleft", "word", F.lit(RANK_BITS + BITS)).alias("_spot"),
            *[F.col(c).alias(f"_{c}") for c in ("level", "bits", "privileges")])
        word = F.shiftright("_spot", RANK_BITS + BITS)
        rows = asked.unionByName(sets, allowMissingColumns=True).repartition("user_id").withColumn(
            "_word", F.when(F.col("_level").isNull() | (F.col("_level") == 0), word))
        # One sort by user, word and place serves both windows; words of higher levels come first, and words before places.
        of_user = W.partitionBy("user_id").orderBy("_word", "_spot")
        of_word = W.partitionBy("user_id", "_word").orderBy("_spot")
        everything = (W.unboundedPreceding, W.unboundedFollowing)
        high = F.when(F.col("_level") > 0, F.struct(F.col("_level").alias("level"), word.alias("word"), "_bits", "_privileges"))
        low = F.when(F.col("_level") == 0, F.struct("_bits", "_privileges"))
        met = rows.withColumn("_high", F.collect_list(high).over(of_user.rowsBetween(*everything))).withColumns(
            {"_low": F.collect_list(low).over(of_word.rowsBetween(*everything)), "_last": F.lag("_spot").over(of_word)})
        at = F.shiftright("_spot", RANK_BITS)
        given = F.concat(F.filter("_low", lambda s: holds(F.lit(0), word, s["_bits"], at))["_privileges"],
                         F.filter("_high", lambda s: holds(s["level"], s["word"], s["_bits"], at))["_privileges"])
        found = met.where("_level IS NULL AND NOT _spot <=> _last").select("user_id", "_spot", given.alias("_given")).where(
            F.size("_given") > 0)
        privileges = F.array_sort(F.array_compact(F.array_distinct(F.flatten("_given")))).alias("privileges")
        back = {c: F.col(f"_name{i}").alias(c) for i, c in enumerate(names)}
        return lookup_join(found.select("user_id", "_spot", privileges), spots, ["_spot"]).select(
            *[back.get(c, F.col(quote_name(c))) for c in user_places.columns], "privileges")


def index(relation: DataFrame, objects: DataFrame) -> EntitlementIndex:
    """The index of grant rows over ``access.objects``; grants on objects that do not exist give nothing.

    Several lists of columns on one object add up when they are asked for, as grants do.
    """
    places = path_labels(objects, access.PLACE)
    named = access.named_grants(relation, objects)
    grants = named.where(F.size("actions") > 0).select(
        "user_id", *access.PLACE, F.array_sort(F.array_distinct("actions")).alias("privileges"), F.array_sort("columns").alias("columns"))
    spans = lookup_join(grants, places.tree, access.PLACE).select("user_id", "privileges", "columns", "low", "high")
    return EntitlementIndex(places, settle(range_words(spans, ["user_id", "privileges", "columns"], places.levels), "words"))
