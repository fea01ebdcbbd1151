"""Privilege grants, access requests and their decisions, in bulk.

A grant gives a user privileges on a catalog, schema or table, for all columns or some. It holds for the named
object and everything inside. Requests look up the grants of their own object and of the objects around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.names import free_names, quote_name
from siltstone.operators.joins import lookup_join
from siltstone.session import settle

# Object types, privileges.
OBJECT_TYPES = ("catalog", "schema", "table")
PRIVILEGES = (
    "SELECT_TABLE", "INSERT_TABLE", "UPDATE_TABLE", "DELETE_TABLE", "CREATE_TABLE", "DROP_TABLE", "SHOW_TABLES",
    "CREATE_SCHEMA", "DROP_SCHEMA", "ALTER_SCHEMA", "SHOW_SCHEMAS", "CREATE_CATALOG", "DROP_CATALOG",
    "SHOW_CATALOGS", "SHOW_COLUMNS", "ACCESS_CATALOG", "ACCESS_SCHEMA", "ALL",
)

# ANY asks for some privilege, whichever; the level says which object is checked: the catalog, the schema, or the
# narrowest object the request names ("resource"). "anywhere" asks about the user alone.
ANY = "ANY"

# Operation, privilege, level. Several rows for one operation are alternatives.
OPERATIONS = (
    ("AccessCatalog", "ACCESS_CATALOG", "catalog"),
    ("CreateCatalog", "CREATE_CATALOG", "catalog"),
    ("DropCatalog", "DROP_CATALOG", "catalog"),
    ("FilterCatalogs", ANY, "catalog"),
    ("ShowCatalogs", ANY, "anywhere"),
    ("ShowSchemas", "SHOW_SCHEMAS", "catalog"),
    ("CreateSchema", "CREATE_SCHEMA", "schema"),
    ("DropSchema", "DROP_SCHEMA", "schema"),
    ("RenameSchema", "DROP_SCHEMA", "schema"),
    ("SetSchemaAuthorization", "DROP_SCHEMA", "schema"),
    ("FilterSchemas", ANY, "schema"),
    ("FilterSchemas", "SHOW_SCHEMAS", "catalog"),
    ("ShowTables", "SHOW_TABLES", "schema"),
    ("CreateTable", "CREATE_TABLE", "schema"),
    ("DropTable", "DROP_TABLE", "resource"),
    ("RenameTable", "DROP_TABLE", "resource"),
    ("SetTableAuthorization", "DROP_TABLE", "resource"),
    ("SetTableComment", "UPDATE_TABLE", "resource"),
    ("SetViewComment", "UPDATE_TABLE", "resource"),
    ("AddColumn", "UPDATE_TABLE", "resource"),
    ("DropColumn", "UPDATE_TABLE", "resource"),
    ("RenameColumn", "UPDATE_TABLE", "resource"),
    ("SetColumnComment", "UPDATE_TABLE", "resource"),
    ("UpdateTableColumns", "UPDATE_TABLE", "resource"),
    ("RefreshMaterializedView", "UPDATE_TABLE", "resource"),
    ("SelectFromColumns", "SELECT_TABLE", "resource"),
    ("InsertIntoTable", "INSERT_TABLE", "resource"),
    ("DeleteFromTable", "DELETE_TABLE", "resource"),
    ("TruncateTable", "DELETE_TABLE", "resource"),
    ("ShowColumns", "SHOW_COLUMNS", "resource"),
    ("FilterColumns", "SELECT_TABLE", "resource"),
    ("FilterColumns", "SHOW_COLUMNS", "resource"),
    ("FilterTables", ANY, "resource"),
    ("FilterTables", ANY, "schema"),
    ("FilterTables", "SHOW_TABLES", "schema"),
    ("CreateView", "CREATE_TABLE", "resource"),
    ("CreateMaterializedView", "CREATE_TABLE", "resource"),
    ("DropView", "DROP_TABLE", "resource"),
    ("DropMaterializedView", "DROP_TABLE", "resource"),
    ("RenameView", "DROP_TABLE", "resource"),
)

# What is allowed whoever asks.
OPEN_OPERATION = "ExecuteQuery"
OPEN_CATALOG = "system"
OPEN_SCHEMA = "information_schema"

# The shapes a resource may come in.
RESOURCE_SCHEMA = """
    catalog STRUCT<name: STRING, catalogName: STRING>, catalogName STRING,
    schema STRUCT<catalogName: STRING, schemaName: STRING>, schemaName STRING,
    table STRUCT<catalogName: STRING, schemaName: STRING, tableName: STRING,
                 columns: ARRAY<STRING>, column: STRING>,
    tableName STRING, columns ARRAY<STRING>
"""

PLACE = ["catalog", "schema", "table"]


def parse_resource(resource: Column) -> Column:
    """Resource JSON text as one struct over all shapes."""
    return F.from_json(resource, RESOURCE_SCHEMA)


def normalise_resource(resource: Column) -> Column:
    """``struct(level, catalog, schema, table, columns)`` from a parsed resource; the first shape present wins.

    A name that the level needs but the resource lacks stays NULL and matches no grant.
    """
    get = resource.getField
    has_table = get("table").isNotNull() | get("tableName").isNotNull()
    has_schema = get("schema").isNotNull() | get("schemaName").isNotNull()
    one_column = get("table").getField("column")
    return F.struct(
        F.when(has_table, "table").when(has_schema, "schema").otherwise("catalog").alias("level"),
        F.coalesce(get("catalog").getField("name"), get("catalog").getField("catalogName"), get("catalogName"),
                   get("schema").getField("catalogName"), get("table").getField("catalogName")).alias("catalog"),
        F.coalesce(get("schema").getField("schemaName"), get("table").getField("schemaName"),
                   get("schemaName")).alias("schema"),
        F.coalesce(get("table").getField("tableName"), get("tableName")).alias("table"),
        F.coalesce(get("table").getField("columns"), F.when(one_column.isNotNull(), F.array(one_column)),
                   get("columns")).alias("columns"),
    )


def with_resource(df: DataFrame, text: str) -> DataFrame:
    """Replace the JSON column ``text`` by the normalised struct ``resource``.

    The one-element explodes keep the parsed and the normalised struct as columns; inlined into every later use, the
    parse would run once per field.
    """
    parsed = df.withColumn("_parsed", F.explode(F.array(parse_resource(F.col(text))))).drop(text)
    return parsed.withColumn("resource", F.explode(F.array(normalise_resource(F.col("_parsed"))))).drop("_parsed")


def objects(catalogs: DataFrame, schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """``(object_type, object_id, catalog, schema, table)`` of all three levels; '' below the object's level."""
    none = F.lit("")
    cats = catalogs.select("catalog_id", F.col("catalog_name").alias("catalog"))
    named = schemas.select("schema_id", F.col("schema_name").alias("schema"), "catalog_id").join(cats, "catalog_id")
    inside = named.select("schema_id", "schema", "catalog")
    deep = lookup_join(tables.select("table_id", F.col("table_name").alias("table"), "schema_id"),
                       inside, ["schema_id"])
    return (cats.select(F.lit("catalog").alias("object_type"), F.col("catalog_id").cast("bigint").alias("object_id"),
                        "catalog", none.alias("schema"), none.alias("table"))
            .unionByName(named.select(F.lit("schema").alias("object_type"),
                                      F.col("schema_id").cast("bigint").alias("object_id"),
                                      "catalog", "schema", none.alias("table")))
            .unionByName(deep.select(F.lit("table").alias("object_type"),
                                     F.col("table_id").cast("bigint").alias("object_id"),
                                     "catalog", "schema", "table")))


def named_grants(relation: DataFrame, named: DataFrame) -> DataFrame:
    """Grant rows with the names of their objects. A grant on an object that does not exist gives nothing."""
    rows = relation.withColumn("object_id", F.col("object_id").cast("bigint"))
    return lookup_join(rows, settle(named, "objects"), ["object_type", "object_id"])


def held_grants(grants: DataFrame) -> DataFrame:
    """One row per (user, object) with ``held``: the distinct ``struct(actions, columns)`` of the grants there.

    Nothing is unnested before grouping, and repeated grants collapse on the map side.
    """
    return (grants.where(F.size("actions") > 0).select("user_id", *PLACE, F.struct("actions", "columns").alias("grant"))
            .groupBy("user_id", *PLACE).agg(F.collect_set("grant").alias("held")))


def _columns_of(held: Column) -> Column:
    """All column names that grants list, each once."""
    return F.array_distinct(F.flatten(F.transform(held, lambda h: F.array_compact(F.coalesce(
        h["columns"], F.array().cast("array<string>"))))))


def privilege_lookup(grants: DataFrame) -> DataFrame:
    """One row per (user, object, privilege): ``whole`` if some grant covers all columns, and the columns named."""
    named = F.explode(F.array_distinct(F.flatten(F.transform("held", lambda h: h["actions"])))).alias("privilege")
    giving = F.filter("held", lambda h: F.exists(h["actions"], lambda a: a.eqNullSafe(F.col("privilege"))))
    return (held_grants(grants).select("user_id", *PLACE, "held", named)
            .select("user_id", *PLACE, "privilege", F.exists(giving, lambda h: h["columns"].isNull()).alias("whole"),
                    _columns_of(giving).alias("columns")))


def request_key(user: Column, operation: Column, resource: Column) -> Column:
    """A 128-bit digest of a request, by which its parts meet: one short column instead of nested ones."""
    part = lambda text: F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    columns = F.coalesce(F.to_json(resource["columns"], {"ignoreNullFields": "false"}), F.lit("-"))
    whole = F.concat(*map(part, (user, operation, *(resource[c] for c in ("level", *PLACE)))), columns)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def looked_up(resource: Column) -> Column:
    """What a request looks up: its resource with the names of its columns left out, as all columns of an object meet the
    same grants. Whether any were named stays."""
    return resource.withField("columns", F.slice(resource["columns"], 1, 0))


# Levels by depth: a check at one depth also meets the grants at the depths above it.
DEPTHS = {"catalog": 1, "schema": 2, "table": 3}


def always_allowed(operation: Column, resource: Column) -> Column:
    return F.coalesce((operation == OPEN_OPERATION) | (resource["catalog"] == OPEN_CATALOG)
                      | (resource["schema"] == OPEN_SCHEMA), F.lit(False))


def _rules(spark: SparkSession) -> DataFrame:
    """``OPERATIONS`` as rows; ``_fixed`` is the depth checked, 0 for the user alone, NULL for the request's own."""
    rows = [(name, wanted, None if level == "resource" else DEPTHS.get(level, 0)) for name, wanted, level in OPERATIONS]
    return spark.createDataFrame(rows, "operation string, _wanted string, _fixed int")


def _answers(actions: Column, wanted: Column) -> Column:
    """Whether a grant of these actions has one of the privileges wanted."""
    met = F.arrays_overlap(actions, F.array_union(wanted, F.array(F.lit("ALL"))))
    return (F.size(wanted) > 0) & (F.array_contains(wanted, ANY) | F.coalesce(met, F.lit(False)))


def coverage(requests: DataFrame, grants: DataFrame, kept: list[str]) -> DataFrame:
    """What ``grants`` give to each of ``requests(user_id, operation, resource)``: the columns ``kept``, ``whole``, and the
    ``covered`` columns, which are NULL where no grant answers.

    A request meets the grants of its user level by level, those on its catalog, its schema and its table, one row at
    each; rows are neither unnested nor grouped. A grant that answers a check of a schema or catalog, or a request that
    names no columns, gives all. Column grants add up.
    """
    rules = _rules(requests.sparkSession).groupBy("operation").agg(
        F.collect_list(F.struct("_wanted", "_fixed")).alias("_rules"), F.bool_or(F.coalesce("_fixed", F.lit(-1)) == 0).alias("_anywhere"))
    res = F.col("resource")
    own = F.when(res["level"] == "table", 3).when(res["level"] == "schema", 2).otherwise(1)
    named = (F.when(res["catalog"].isNull(), 0).when(res["schema"].isNull(), 1).when(res["table"].isNull(), 2)
             .otherwise(3))
    # Checks that a request's names reach, as (privilege, depth).
    checks = F.filter(F.transform("_rules", lambda r: F.struct(r["_wanted"].alias("w"), F.coalesce(r["_fixed"], own).alias("d"))),
                      lambda c: (c["d"] > 0) & (c["d"] <= named))
    asked = requests.join(F.broadcast(rules), "operation").select(
        *dict.fromkeys([*kept, "user_id"]), "_anywhere", *[res[c].alias(f"_{c}") for c in PLACE],
        res["columns"].isNull().alias("_free"), checks.alias("_checks"))
    given = grants.where(F.size("actions") > 0)
    users = given.select("user_id").distinct().withColumn("_whole", F.lit(True))
    rows = asked.where(~F.col("_anywhere")).withColumn("_whole", F.lit(None).cast("boolean")).unionByName(
        lookup_join(asked.where("_anywhere"), users, ["user_id"], "left")).drop("_anywhere")
    rows = rows.withColumns({"_whole": F.coalesce("_whole", F.lit(False)), "_hit": F.lit(False),
                             "_covered": F.array().cast("array<string>")})
    levels = ((given.where("schema = '' AND table = ''"), 1), (given.where("schema <> '' AND table = ''"), 2),
              (given.where("table <> ''"), 3))
    for some, depth in levels:
        names = PLACE[:depth]
        found = held_grants(some).select("user_id", *[F.col(c).alias(f"_{c}") for c in names], "held")
        # Grants on containers are few beside those on tables: their size is measured, as they may be broadcast.
        rows = lookup_join(rows, settle(found, "container-grants") if depth < 3 else found,
                           ["user_id", *[f"_{c}" for c in names]], "left")
        here = F.filter("_checks", lambda c: c["d"] >= depth)
        wide = F.transform(F.filter(here, lambda c: (c["d"] < 3) | F.col("_free")), lambda c: c["w"])
        narrow = F.transform(F.filter(here, lambda c: (c["d"] == 3) & ~F.col("_free")), lambda c: c["w"])
        rows = rows.withColumns({"_wide": wide, "_narrow": narrow})
        listed = F.filter("held", lambda h: _answers(h["actions"], F.col("_narrow")))
        gives_all = F.exists("held", lambda h: _answers(h["actions"], F.col("_wide")))
        rows = rows.withColumn("_listed", listed).withColumns({
            "_whole": F.col("_whole") | F.coalesce(gives_all | F.exists("_listed", lambda h: h["columns"].isNull()), F.lit(False)),
            "_hit": F.col("_hit") | F.coalesce(F.size("_listed") > 0, F.lit(False)),
            "_covered": F.when(F.size("_listed") > 0, F.concat("_covered", _columns_of(F.col("_listed")))).otherwise(F.col("_covered")),
        }).drop("held", "_wide", "_narrow", "_listed")
    return rows.select(*kept, F.col("_whole").alias("whole"),
                       F.when(F.col("_whole") | F.col("_hit"), F.array_distinct("_covered")).alias("covered"))


def _found(requests: DataFrame, grants: DataFrame, key: str) -> DataFrame:
    """What the grants give to the requests that are not allowed anyway, each looked up once: ``key`` as named, ``whole``
    and ``covered``."""
    closed = requests.where(~always_allowed(F.col("operation"), F.col("resource"))).select(
        key, "user_id", "operation", looked_up(F.col("resource")).alias("resource"))
    # The key stands for all of them; grouping by all needs no sort.
    return coverage(settle(closed.distinct(), "requests").frame, grants, [key])


def decide(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``requests(user_id, operation, resource)`` plus the Boolean ``allowed``; ``resource`` is a normalised struct.

    Requests that differ in their columns only are looked up once. A request is allowed by an always-allow rule, or by any grant of the user that
    covers the object checked, has the privilege asked for (or ALL) and covers the columns asked for.
    """
    key, = free_names(requests, "key")
    keyed = requests.withColumn(key, request_key(F.col("user_id"), F.col("operation"), looked_up(F.col("resource"))))
    # What is allowed anyway never meets the grants, however often it is asked.
    open_to_all = always_allowed(F.col("operation"), F.col("resource"))
    joined = lookup_join(keyed.where(~open_to_all), _found(keyed, grants, key), [key], "left")
    missing = F.array_except(F.col("resource")["columns"], F.col("covered"))
    decided = joined.withColumn("allowed", F.coalesce(F.col("whole") | (F.size(missing) == 0), F.lit(False)))
    free = requests.where(open_to_all).withColumn("allowed", F.lit(True))
    names = [F.col(quote_name(c)) for c in requests.columns]
    return decided.select(*names, "allowed").unionByName(free.select(*names, "allowed"))


# What a grant has and a check wants as bits of a number: any privilege at all, ALL, and each that some operation asks for.
_SOME, _ALL = 1, 2


def _bit(privilege: str) -> int:
    """The bit of a privilege that an operation asks for."""
    return 4 << sorted({wanted for _, wanted, _ in OPERATIONS} - {ANY, "ALL"}).index(privilege)


def _given_bits(actions: Column) -> Column:
    """The privileges of a grant that has some."""
    has = lambda name, bit: F.when(F.array_contains(actions, name), bit).otherwise(0)
    asked = sorted({wanted for _, wanted, _ in OPERATIONS} - {ANY, "ALL"})
    return reduce(Column.bitwiseOR, [has(name, _bit(name)) for name in asked], has("ALL", _ALL)).bitwiseOR(F.lit(_SOME))


def _wanted_bits(operation: Column, level: str) -> Column:
    """The privileges of which an operation's checks at ``level`` want one; 0 where it has no such check."""
    rows: dict[str, int] = {}
    for name, wanted, checked in OPERATIONS:
        if checked == level:
            rows[name] = rows.get(name, 0) | (_SOME if wanted == ANY else _ALL if wanted == "ALL" else _bit(wanted) | _ALL)
    return reduce(lambda chain, item: chain.when(operation == item[0], item[1]), rows.items(), F.when(F.lit(False), 0)).otherwise(0)


def _asked_parts(batches: DataFrame) -> DataFrame:
    """``batches`` as ``(batch_id, user_id, operation, _open, _parts)``: the indices of resources that are allowed anyway,
    and the others by the places they name. Resources that lie around each other, like a table, its schema and its catalog
    or the columns of a table, are one part, whose place is the deepest; others are parts of their own."""
    per_column = ((F.col("operation") == "FilterColumns") & (F.size("resources") == 1)
                  & (F.size(F.get("resources", F.lit(0))["columns"]) > 0))
    first = F.get("resources", F.lit(0))
    single = F.transform(first["columns"], lambda c: first.withField("columns", F.array(c)))
    resources = F.coalesce(F.when(per_column, single).otherwise(F.col("resources")), F.array())
    own = lambda r: F.when(r["level"] == "table", 3).when(r["level"] == "schema", 2).otherwise(1)
    named = lambda r: (F.when(r["catalog"].isNull(), 0).when(r["schema"].isNull(), 1)
                       .when(r["table"].isNull(), 2).otherwise(3))
    entry = lambda r, i: F.struct(i.alias("index"), always_allowed(F.col("operation"), r).alias("open"), own(r).alias("own"),
                                  named(r).alias("named"), *[F.coalesce(r[c], F.lit("")).alias(c) for c in PLACE],
                                  r["columns"].alias("columns"))
    place = lambda e: F.struct(*[e[c].alias(c) for c in PLACE])
    code = lambda e: F.shiftleft(e["index"].cast("bigint"), 4).bitwiseOR(e["own"] * 4 + e["named"])
    around = lambda e: reduce(Column.__and__, [(e["named"] < depth) | (e[c] == F.col("_deepest")[c])
                                               for depth, c in enumerate(PLACE, 1)])
    rows = (batches.select("batch_id", "user_id", "operation", resources.alias("_resources"))
            .withColumn("_entries", F.transform("_resources", entry)).drop("_resources")
            .withColumns({"_open": F.transform(F.filter("_entries", lambda e: e["open"]), lambda e: e["index"]),
                          "_closed": F.filter("_entries", lambda e: ~e["open"])}).drop("_entries")
            .withColumn("_deepest", F.array_max(F.transform("_closed", place))))
    # An entry is its index, level and names in one number; lists of columns are kept where some entry has one.
    some = F.exists("_closed", lambda e: e["columns"].isNotNull())
    one = F.array(F.struct(*[F.col("_deepest")[c].alias(c) for c in PLACE], F.transform("_closed", code).alias("codes"),
                           F.when(some, F.transform("_closed", lambda e: e["columns"])).alias("lists")))
    each = F.transform("_closed", lambda e: F.struct(*[e[c].alias(c) for c in PLACE], F.array(code(e)).alias("codes"),
                                                     F.when(e["columns"].isNotNull(), F.array(e["columns"])).alias("lists")))
    parts = F.when((F.size("_closed") > 0) & F.forall("_closed", around), one).otherwise(each)
    return rows.select("batch_id", "user_id", "operation", "_open", parts.alias("_parts"))


def allowed_indices(batches: DataFrame, grants: DataFrame) -> DataFrame:
    """``batches(batch_id, user_id, operation, resources)`` to ``(batch_id, indices)``, zero-based and sorted.

    A ``FilterColumns`` batch with one table and several columns is decided column by column. Batches with nothing
    allowed keep an empty list. A list is no longer than the resource list it came with.

    Batches and grants travel once, by user and catalog, and meet in the order of one sort: a grant comes before all that
    is asked in its catalog, in its schema or on its table.
    """
    # Operations that any grant of the user allows look for one.
    free = F.coalesce(F.col("operation").isin(sorted({name for name, _, level in OPERATIONS if level == "anywhere"})), F.lit(False))
    users = grants.where(F.size("actions") > 0).select("user_id").distinct().withColumn("_some", F.lit(True))
    asked = _asked_parts(batches.where(~free)).withColumn("_some", F.lit(False)).unionByName(
        lookup_join(_asked_parts(batches.where(free)), users, ["user_id"], "left").withColumn("_some", F.coalesce("_some", F.lit(False))))
    # Batches with nothing left to ask are spread by their ids, under no user, and so meet no grant.
    met, first = F.col("_p").isNotNull(), F.coalesce("_part", F.lit(0)) == 0
    ask = asked.select("*", F.posexplode_outer("_parts").alias("_part", "_p")).select(
        F.when(met, F.col("user_id")).alias("user_id"), F.when(met, F.col("_p.catalog")).otherwise(F.xxhash64("batch_id").cast("string")).alias("catalog"),
        "_p.schema", "_p.table", F.struct("batch_id", "operation", "_some", first.alias("first"), "_p.codes", "_p.lists",
                                          F.when(first & (F.size("_open") > 0), F.col("_open")).alias("open")).alias("_ask"))
    given = grants.where((F.size("actions") > 0) & reduce(Column.__and__, [F.col(c).isNotNull() for c in ("user_id", *PLACE)]))
    rows = ask.unionByName(given.select("user_id", *PLACE, F.struct(_given_bits(F.col("actions")).alias("bits"), "columns").alias("_give")),
                           allowMissingColumns=True).repartition("user_id", "catalog")
    none = F.lit(0)
    levels = ((F.col("schema") == "") & (F.col("table") == ""), (F.col("schema") != "") & (F.col("table") == ""), F.col("table") != "")
    for depth, here in enumerate(levels, 1):
        # Grants come first, and those on containers before what is inside.
        before = (W.partitionBy("user_id", *PLACE[:depth]).orderBy(*PLACE[depth:], F.col("_ask").isNotNull())
                  .rowsBetween(W.unboundedPreceding, W.currentRow))
        give = F.when(here, F.col("_give"))
        rows = rows.withColumns({
            f"_any{depth}": F.coalesce(F.bit_or(give["bits"]).over(before), none),
            f"_whole{depth}": F.coalesce(F.bit_or(F.when(give["columns"].isNull(), give["bits"])).over(before), none),
            f"_named{depth}": F.collect_set(F.when(give["columns"].isNotNull(), give)).over(before)})
    want = {level: _wanted_bits(F.col("_ask.operation"), level) for level in ("resource", *DEPTHS)}
    decided = rows.where("_ask IS NOT NULL").select(
        "_ask.*", "_any1", "_any2", "_any3", *[w.alias(f"_{k}") for k, w in want.items()],
        F.col("_whole1").bitwiseOR(F.col("_whole2")).bitwiseOR(F.col("_whole3")).alias("_whole"),
        F.concat("_named1", "_named2", "_named3").alias("_named"))
    allowed = F.transform(F.filter("codes", _entry_allowed), lambda e: F.shiftright(e, 4).cast("int"))
    no = F.array().cast("array<int>")
    # A batch without an id keeps an empty list; those of one id share theirs.
    of_batch = W.partitionBy("batch_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = F.collect_list(F.when(F.col("batch_id").isNotNull(), F.col("indices"))).over(of_batch)
    return (decided.select("batch_id", "first", F.concat(F.coalesce("open", no), F.coalesce(allowed, no)).alias("indices"))
            .withColumn("_found", found).where("first").select("batch_id", F.array_sort(F.array_distinct(F.flatten("_found"))).alias("indices")))


def _entry_allowed(code: Column, at: Column) -> Column:
    """Whether what the grants around and on a place give, see ``allowed_indices``, allows an entry asked there. A grant that
    answers a check of a schema or catalog, or an entry that names no columns, gives all; column grants add up."""
    own, named, columns = F.shiftright(code, 2).bitwiseAND(F.lit(3)), code.bitwiseAND(F.lit(3)), F.get("lists", at)
    checks = [F.when(named >= depth, F.when(own == depth, F.col("_resource")).otherwise(0).bitwiseOR(F.col(f"_{level}")))
              .otherwise(0) for level, depth in DEPTHS.items()]
    free = columns.isNull()
    wide = [F.when(free, checks[2]).otherwise(0)]
    for check in (checks[1], checks[0]):
        wide.insert(0, wide[0].bitwiseOR(check))
    gives_all = reduce(Column.bitwiseOR, [F.col(f"_any{depth}").bitwiseAND(w) for depth, w in enumerate(wide, 1)])
    narrow = F.when(free, 0).otherwise(checks[2])
    listed = F.filter("_named", lambda g: g["bits"].bitwiseAND(narrow) != 0)
    covered = F.flatten(F.transform(listed, lambda g: g["columns"]))
    return (F.col("_some") | (gives_all.bitwiseOR(F.col("_whole").bitwiseAND(narrow)) != 0)
            | (F.exists("_named", lambda g: g["bits"].bitwiseAND(narrow) != 0)
               & F.forall(columns, lambda c: F.coalesce(F.array_contains(covered, c), F.lit(False)))))


def column_decisions(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """One row per requested column: ``(request_id, user_id, index, column, allowed)``. The grants of a table are
    looked up once for all columns of a request."""
    rows = requests.select("request_id", "user_id", F.lit("FilterColumns").alias("operation"), "resource",
                           F.col("resource")["columns"].alias("columns"))
    open_to_all = always_allowed(F.col("operation"), F.col("resource"))
    kept = ["request_id", "user_id", "columns"]
    found = coverage(rows.where(~open_to_all), grants, kept)
    free = rows.where(open_to_all).select(*kept, F.lit(True).alias("whole"), F.array().cast("array<string>").alias("covered"))
    allowed = F.col("whole") | F.coalesce(F.array_contains("covered", F.col("column")), F.lit(False))
    return (found.unionByName(free).select("*", F.posexplode("columns").alias("index", "column"))
            .select("request_id", "user_id", "index", "column", allowed.alias("allowed")))
