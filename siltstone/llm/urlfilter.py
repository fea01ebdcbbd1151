"""URL verdicts from a list of canonical URL prefixes, through a blocked Bloom filter and an exact join.

Every listed entry is a host and the beginning of a path; it fits its host, all subdomains and all paths that begin so.
A url therefore has few canonical keys that could be listed: each end of its host at a dot, with each beginning of its
path that is as long as some listed path. The filter keeps 256 bits a block, eight of them set by each entry; a
key is looked up in its one block. Only keys that pass go to the hash join with the list, which removes those that passed
by chance. The longest entry decides.

Filter and list are ordinary frames that Spark joins by their size: small ones are broadcast by its own threshold, large
ones are shuffled. Listed path lengths are gathered on the driver: at most ``PATH_LENGTHS`` of them, else it is an error.

Defined results: a null url, or one without ``://``, has an empty host and path; such a url fits no entry that has a host;
rows are never merged, equal urls and ids included; an empty list lets everything pass to the default; entries listed
twice with different verdicts block. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import column, written

BITS_PER_ENTRY = 16
BLOCK_BITS = 256
PATH_LENGTHS = 4096

# The rules of the contract, as (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))

# Hosts of no rule whose pages are not wanted; their entries decide where no rule does.
LISTED = tuple((f"{name}.example.{top}", "/", "block") for top in ("org", "net", "com")
               for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"))

# Odd multipliers, one for each 32-bit word of a block.
SALTS = (0x47b6137b, 0x44974d91, 0x8824ad5b, 0xa2b7289d, 0x705495c7, 0x2df1424b, 0x9efc4947, 0x5c6bfb31)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def entries(spark: SparkSession, rows: tuple[tuple[str, str, str], ...], rank: int) -> DataFrame:
    """A list as a frame: key, length, verdict, and its rank among lists (a higher one decides first)."""
    return spark.createDataFrame([(h + p, len(h + p), len(p), v, rank) for h, p, v in rows],
                                 "key string, size int, path_size int, verdict string, rank int")


def _word(low: Column, number: int) -> Column:
    """The bit that an entry sets in one 32-bit word of its block, as a number from 0 to 31."""
    return F.call_function("shiftright", (low * F.lit(SALTS[number])).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(27)).cast("int")


def _masks(key: Column, blocks: int) -> list[Column]:
    """The block of a key, and its bits there as four longs of two words each."""
    code = F.xxhash64(key)
    low = code.bitwiseAND(F.lit(0x7FFFFFFF))
    one = F.lit(1).cast("bigint")
    longs = [F.call_function("shiftleft", one, _word(low, 2 * k)).bitwiseOR(
        F.call_function("shiftleft", one, _word(low, 2 * k + 1) + 32)).alias(f"m{k}") for k in range(4)]
    block = F.pmod(F.call_function("shiftrightunsigned", code, F.lit(31)), F.lit(blocks).cast("bigint"))
    return [block.alias("block"), *longs]


def block_count(listed: int) -> int:
    return max(1, -(-listed * BITS_PER_ENTRY // BLOCK_BITS))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: per block that is not empty, its 256 bits as four longs."""
    bits = listed.select(*_masks(F.col("key"), blocks))
    return bits.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(4)])


def candidate_keys(host: Column, path: Column, lengths: list[int], labels_listed: int) -> Column:
    """Every canonical key of a url that a list with these path lengths, and hosts of at most so many labels, could hold,
    each once."""
    ends = host_ends(host, F.lit(labels_listed))
    starts = F.array_compact(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    return F.array_distinct(F.flatten(F.transform(ends, lambda h: F.transform(starts, lambda p: F.concat(h, p)))))


def host_ends(host: Column, labels_listed: Column) -> Column:
    """The ends of a host at its dots, of at most so many labels, each once."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - labels_listed + 1)
    return F.array_distinct(F.transform(F.sequence(first, F.size(labels)),
                                        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))))


def keys_by_host(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``(row, key)`` of every key that the list could hold, by the lengths of the paths listed for each host."""
    named = listed.select(F.expr("left(key, size - path_size)").alias("end"), "path_size").distinct()
    most = named.agg(F.max(F.size(F.split("end", r"\.")))).first()[0]
    lengths = named.groupBy("end").agg(F.collect_set("path_size").alias("sizes"))
    ends = rows.select("row", "path", F.explode(host_ends(F.col("host"), F.lit(most))).alias("end"))
    fits = F.filter("sizes", lambda n: n <= F.char_length("path"))
    tried = ends.join(lengths, "end").select("row", "end", "path", F.explode(fits).alias("n"))
    return tried.select("row", F.concat("end", F.expr("left(path, n)")).alias("key"))


def judged(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url",
           default: str = "allow") -> DataFrame:
    """Per row its key, host, path, the deciding entry of rank 1 as ``rule``, and the verdict.

    Entries of rank 1 are rules and decide before entries of rank 0; where nothing fits, ``default`` does.
    """
    listed = written(listed.groupBy("key", "size", "path_size", "rank").agg(F.max("verdict").alias("verdict")), "listed")
    labels = F.size(F.split(F.expr("left(key, size - path_size)"), r"\."))
    shape = (listed.groupBy("path_size").agg(F.max(labels).alias("labels"))
             .limit(PATH_LENGTHS + 1).collect())
    lengths = sorted(r["path_size"] for r in shape)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), column(key).alias("page"),
                        host_of(column(url)).alias("host"), path_of(column(url)).alias("path"))
    rows = written(rows, "urls")
    blocks = block_count(listed.count())
    words = written(bloom(listed, blocks), "bloom")
    keys = (candidate_keys(F.col("host"), F.col("path"), lengths, max(r["labels"] for r in shape)) if lengths else
            F.array().cast("array<string>"))
    many = len(lengths) > PATH_LENGTHS
    tried = keys_by_host(rows, listed) if many else rows.select("row", F.explode(keys).alias("key"))
    probes = tried.select("row", "key", *_masks(F.col("key"), blocks)).join(words, "block")
    passed = probes.where(" AND ".join(f"w{k} & m{k} = m{k}" for k in range(4))).select("row", "key")
    exact = passed.join(listed, "key")
    best = exact.groupBy("row").agg(F.max(F.struct("rank", "size", "verdict", "key")).alias("best"))
    return rows.join(best, "row", "left").select(
        F.col("page").alias(key), "host", "path", F.when(F.col("best.rank") == 1, F.col("best.key")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
