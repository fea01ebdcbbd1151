"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints within ``bits`` differing bits agree in at least one of ``bits + 1`` blocks. For each block the distinct
fingerprints are turned so that it leads, and sorted by Gray rank: those that share it stand together, and form a
group whose root pattern is the block. Inside a group the sorted fingerprints are cut into nodes; a node factors out the
bits that all below it share, as a mask and a pattern, up to one root per group, however small. Pairs of nodes are compared from the
top, adding up the bits in which their shared patterns differ; a pair beyond ``bits`` is dropped with all below it.

Only distinct fingerprints are compared, so copies cost nothing, and a group hands on a star for each of its parts, never
its pairs. Groups beyond ``GROUP_ROWS`` fingerprints are divided once more by the remaining blocks, and what is still too
large is dealt as pairs of tiles, so that no task holds a whole group; nothing is capped.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like any other; texts
with fewer words than a shingle have one shingle, the whole. Null ids take part but never name a component unless all
of its ids are null. Equal rows share a component. Other columns are ignored, or carried by ``one_of_each``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import column, free_name, written
from siltstone.llm.components import components

SHINGLE = 3
BITS = 2
SEED = 42
GROUP_ROWS = 20_000
LEAF = 4
FAN = 8
PAIRS = 1 << 14  # pairs of nodes compared at a time
HASHES_AT_ONCE = 1 << 16

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one whole text, unsigned."""
    import xxhash
    words = [w for w in _SPACE.split((text or "").encode("utf-8", "surrogatepass").translate(_UPPER)) if w]
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist() if len(words) >= shingle else [len(joined)]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[at:at + HASHES_AT_ONCE], stops[at:at + HASHES_AT_ONCE], strict=True)],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def with_fingerprint(df: DataFrame, name: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of its text as a signed long."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return df.select("*", F.pandas_udf(run, T.LongType())(column(text)).alias(name))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of 64-bit codes in Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent``, fully compressed, after linking a[i] with b[i]."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _find(parent)


def _levels(number: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Nodes of all groups from the leaves up to one root for each: per node the mask of the bits that all below it share,
    their pattern, and its first child and how many it has."""
    every, group, low, high, width = [], number, codes, codes, LEAF
    while True:
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        inside = np.arange(len(group)) - np.repeat(heads, np.diff(np.r_[heads, len(group)]))
        cuts = np.flatnonzero(inside % width == 0)
        counts = np.diff(np.r_[cuts, len(group)])
        low, high, group = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts), group[cuts]
        every.append((~(low ^ high), low, cuts, counts))
        if len(cuts) == len(heads):
            return every
        width = FAN


def index_links(number: np.ndarray, codes: np.ndarray, bits: int, left: np.ndarray | None = None) -> np.ndarray:
    """Per code the place of the first code of its part. ``codes`` stand by the ``number`` of their group, and in Gray order
    inside; all groups are searched at once, each from its root.

    ``left`` marks codes of one tile: then only pairs with one end there and one outside are looked for.
    """
    parent = np.arange(len(codes))
    levels = _levels(number, codes) if len(codes) else []

    def descend(depth: int, a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        mask, pattern, first, count = levels[depth]
        step = np.arange(FAN if depth else LEAF)
        for at in range(0, len(a), PAIRS):
            x, y = a[at:at + PAIRS], b[at:at + PAIRS]
            near = popcount((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= bits
            x, y = x[near], y[near]
            fits = (np.repeat(step < count[x][:, None], len(step), axis=1)
                    & np.tile(step < count[y][:, None], (1, len(step)))).ravel()
            p = np.repeat(first[x][:, None] + step, len(step), axis=1).ravel()[fits]
            q = np.tile(first[y][:, None] + step, (1, len(step))).ravel()[fits]
            if depth:
                once = p <= q
                descend(depth - 1, p[once], q[once])
                continue
            once = p < q
            if left is not None:
                once &= left[p] != left[q]
            p, q = p[once], q[once]
            near = popcount(codes[p] ^ codes[q]) <= bits
            parent = _union(parent, p[near], q[near])

    if levels:
        roots = np.arange(len(levels[-1][0]))
        descend(len(levels) - 1, roots, roots)
    return parent


def linked(codes: np.ndarray, bits: int, left: np.ndarray | None = None) -> np.ndarray:
    """``index_links`` of one group."""
    return index_links(np.zeros(len(codes), dtype=np.int64), codes, bits, left)


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """``width`` bits cut into ``parts`` blocks: (shift, mask)."""
    cuts = [width * k // parts for k in range(parts + 1)]
    return [(low, (1 << (high - low)) - 1) for low, high in zip(cuts, cuts[1:], strict=False)]


def _keyed(codes: DataFrame, blocks: list[tuple[int, int]], keep: str | None = None) -> DataFrame:
    """Each code once per block, with the block's number and value, beside the columns of ``keep``."""
    kinds = [F.struct(F.lit(k).alias("block"), F.call_function("shiftrightunsigned", F.col("code"), F.lit(shift))
                      .bitwiseAND(F.lit(mask)).alias("value")) for k, (shift, mask) in enumerate(blocks)]
    return codes.select("*", F.explode(F.array(*kinds)).alias("k")).select(
        "code", F.xxhash64(*([keep] if keep else []), "k.block", "k.value").alias("group"), "k.block")


def _stars(rows: DataFrame, bits: int, tiled: bool = False) -> DataFrame:
    """Edges (a, b) that connect the codes of each group that lie within ``bits`` of each other, through others too."""
    blocks = _blocks(64, bits + 1)

    def turn(codes: np.ndarray, block: int) -> np.ndarray:
        up = 64 - (blocks[block][0] + blocks[block][1].bit_length())
        return codes if not up else (codes << np.uint64(up)) | (codes >> np.uint64(64 - up))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        codes = frame["code"].to_numpy().view(np.uint64)
        order = np.argsort(gray_rank(turn(codes, int(frame["block"].iloc[0]))), kind="stable")
        codes = codes[order]
        left = None
        if tiled and frame["same"].iloc[0] == 0:
            left = (frame["tile"].to_numpy() == frame["tile"].min())[order]
        parent = linked(codes, bits, left)
        moved = np.flatnonzero(parent != np.arange(len(codes)))
        return pd.DataFrame({"a": codes[moved].view(np.int64), "b": codes[parent[moved]].view(np.int64)})

    keys = ["group", "pair"] if tiled else ["group"]
    return rows.groupBy(*keys).applyInPandas(run, "a long, b long")


def _small_stars(rows: DataFrame, bits: int, most: int) -> DataFrame:
    """As ``_stars`` for groups of at most ``most`` rows, without a Python call per group.

    Rows are dealt by group; the groups of a batch are put in Gray order and searched at once, each through its own tree.
    """
    parts = _blocks(64, bits + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame["group"].iloc[-1] if len(frame) else None
            open_rows = (frame["group"] == last).to_numpy()
            held = frame[open_rows]
            yield from search(frame[~open_rows])
        if held is not None:
            yield from search(held)

    def search(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(frame):
            return
        groups, codes = frame["group"].to_numpy(), frame["code"].to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[cuts, len(groups)])
        blocks, turned = frame["block"].to_numpy(), codes.copy()
        for block, (shift, mask) in enumerate(parts):
            up = np.uint64(64 - (shift + mask.bit_length()))
            own = blocks == block
            if up:
                turned[own] = (codes[own] << up) | (codes[own] >> (np.uint64(64) - up))
        number = np.repeat(np.arange(len(cuts)), sizes)
        codes = codes[np.lexsort((gray_rank(turned), number))]
        parent = index_links(number, codes, bits)
        moved = np.flatnonzero(parent != np.arange(len(codes)))
        if len(moved):
            yield pd.DataFrame({"a": codes[moved].view(np.int64), "b": codes[parent[moved]].view(np.int64)})

    dealt = rows.repartition(F.col("group")).sortWithinPartitions("group")
    return dealt.select("group", "block", "code").mapInPandas(run, "a long, b long")


def links(codes: DataFrame, bits: int = BITS, most: int = GROUP_ROWS) -> DataFrame:
    """Edges among distinct ``code`` longs; following them reaches just what links of ``bits`` or fewer bits reach."""
    blocks = _blocks(64, bits + 1)
    keyed = _keyed(codes.select("code"), blocks)
    counts = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
    large = written(counts.where(F.col("rows") > most).select("group"), "largegroups")
    if large.isEmpty():
        return _small_stars(keyed, bits, most)
    edges = _small_stars(keyed.join(large, "group", "left_anti"), bits, most)
    divided = []
    for k, (shift, mask) in enumerate(blocks):
        inside = keyed.where(F.col("block") == k).join(large, "group", "left_semi")
        others = [(low, m) for j, other in enumerate(blocks) if j != k
                  for low, m in [other]]
        rest = [(low + a, m) for low, wide in others for a, m in _blocks(wide.bit_length(), 2)]
        again = _keyed(inside.select("code", F.col("group").alias("outer")), rest, "outer")
        divided.append(again.select("code", "group", F.lit(k).alias("block")))
    deep = divided[0]
    for more in divided[1:]:
        deep = deep.union(more)
    deep = written(deep, "deepgroups")
    sizes = deep.groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
    edges = edges.union(_small_stars(deep.join(sizes.where(F.col("rows") > most), "group", "left_anti"), bits, most))
    huge = sizes.where(F.col("rows") > most).select("group", F.ceil(F.col("rows") / most).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("code"), F.col("tiles")).cast("int")
    dealt = deep.join(huge, "group").select("code", "group", "block", tile.alias("tile"), "tiles")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = dealt.select("*", other).select(
        "code", "group", "block", "tile", (F.col("tile") == F.col("other")).cast("int").alias("same"),
        (F.least("tile", "other").cast("bigint") * F.col("tiles") + F.greatest("tile", "other")).alias("pair"))
    return edges.union(_stars(pairs, bits, tiled=True))


def clusters(df: DataFrame, key: str, code: str, bits: int = BITS) -> DataFrame:
    """Per distinct fingerprint its component and the smallest key in it: ``code``, ``root``, ``component_id``."""
    own = written(df.groupBy(column(code).alias("code")).agg(F.min(column(key)).alias("least")), "codes")
    found = components(links(own, bits)).select(F.col("node").alias("code"), "root")
    rooted = own.join(found, "code", "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    linked_only = rooted.where("root IS NOT NULL")
    least = linked_only.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked_only.join(least, "root").select("code", "root", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    bits: int = BITS) -> DataFrame:
    """Per row its key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key it is linked to."""
    narrow = df.select(column(key).alias("key_"), column(text).alias("text_"))
    coded = written(with_fingerprint(narrow, "code", "text_", shingle).select("key_", "code"), "fingerprints")
    found = clusters(coded, "key_", "code", bits)
    return coded.join(found, "code").select(
        F.col("key_").alias(key), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                bits: int = BITS) -> DataFrame:
    """``df`` with one row of each component: that with the smallest key, the first of equal ones."""
    row, code = free_name(df, "_row"), free_name(df, "_code")
    numbered = with_fingerprint(df.select("*", F.monotonically_increasing_id().alias(row)), code, text, shingle)
    stored = written(numbered, "dedup")
    narrow = stored.select(column(row).alias("row_"), column(key).alias("key_"), column(code).alias("code"))
    found = clusters(narrow, "key_", "code", bits)
    order = F.struct(F.col("key_").isNull(), "key_", "row_")
    best = (narrow.groupBy("code").agg(F.min(order).alias("best"))
            .join(found, "code").groupBy("root").agg(F.min("best").alias("best")))
    stay = best.select(F.col("best.row_").alias(row))
    return stored.join(stay, row, "left_semi").select(*[column(c) for c in df.columns])
