"""Fill-in-the-middle rewriting, cut at units (a word with the blanks before it) found through an indexable skip list.

The links of a skip list over the units of a text say how many units and how many code points they pass. The lowest lane
has a link per unit; each lane above joins ``SPAN`` links of the lane below. A cut rank is reached from the top lane by
following links while the units passed do not exceed the rank, then going down a lane; the code points passed on the way
are the place of the cut. Spark does the rest: random numbers from a digest of seed and id, the form, and the pieces.

Defined results: a null text counts as empty; an empty text, a text that holds a sentinel and a text that the draw leaves
out stay as they are (form ``plain``, no piece widths). A text of blanks alone is one unit. A null id is drawn as if it
were an empty text. Equal rows get equal results. Only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50
SPM_SHARE = 80
SPAN = 16
ROWS = 64  # texts put into one array at a time

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_widths(texts: list[bytes]) -> list[np.ndarray]:
    """Code points of each unit of each UTF-8 text, in order."""
    # A line end after each text closes its last unit; it is taken off again.
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    space, lead = _SPACE[data], (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    out, low = [], 0
    for text in texts:
        high = low + len(text)
        cuts = ends[np.searchsorted(ends, low, side="right"):np.searchsorted(ends, high, side="right")]
        if low < high and (not len(cuts) or cuts[-1] != high):
            cuts = np.append(cuts, high)
        out.append(np.diff(points[np.concatenate([[low], cuts])]))
        low = high + 1
    return out


class SkipList:
    """Units of one text under express lanes; a link holds the units and the code points it passes."""

    def __init__(self, widths: np.ndarray, span: int = SPAN):
        self.span = span
        self.lanes = [(np.ones(len(widths), dtype=np.int64), widths.astype(np.int64))]
        while len(self.lanes[-1][0]) > span:
            units, points = self.lanes[-1]
            heads = np.arange(0, len(units), span)
            self.lanes.append((np.add.reduceat(units, heads), np.add.reduceat(points, heads)))
        self.units = len(widths)

    def place(self, rank: int) -> int:
        """Code points before the unit ``rank`` (from 0); for ``rank`` equal to ``units``, all of them."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        passed = place = at = 0
        for units, points in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed, place, at = passed + units[at], place + points[at], at + 1
            at *= self.span
        return int(place)


_CUT = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "low", "high")])


@F.pandas_udf(_CUT)
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Units of a text and the places of its two cuts."""
    for texts, first, second in batches:
        rows = []
        for at in range(0, len(texts), ROWS):
            widths = unit_widths([t.encode() for t in texts[at:at + ROWS]])
            for w, a, b in zip(widths, first[at:at + ROWS], second[at:at + ROWS], strict=True):
                units = SkipList(w)
                ranks = sorted((a % (len(w) + 1), b % (len(w) + 1)))
                rows.append((len(w), *map(units.place, ranks)))
        yield pd.DataFrame(rows, columns=["n", "low", "high"], dtype="int64")


def transformed(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
                spm_share: int = SPM_SHARE) -> DataFrame:
    """Columns ``key``, ``text``, ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and
    ``output``. ``rate`` per cent of texts are rewritten, ``spm_share`` per cent of these with the suffix first."""
    plain = F.coalesce(column(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column(key).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest_", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    drawn = df.select(column(key).alias("key_"), plain.alias("text_"), digest.alias("digest_")).select(
        "key_", "text_", *(d.alias(f"h{i}") for i, d in enumerate(draws, 1)))
    cut = drawn.withColumn("cut", _cuts("text_", "h1", "h2"))
    kept = (F.col("text_") == "") | F.col("text_").rlike("<[PSM]>") | (F.col("h3") % 100 >= rate)
    form = F.when(kept, "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm")
    formed = cut.select("key_", "text_", "cut.*", form.alias("form"))
    head = F.expr("substring(text_, 1, int(low))")
    middle = F.expr("substring(text_, int(low) + 1, int(high - low))")
    tail = F.expr("substring(text_, int(high) + 1)")
    output = (F.when(F.col("form") == "plain", F.col("text_"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), middle)))
    changed = F.col("form") != "plain"
    return formed.select(F.col("key_").alias(key), F.col("text_").alias(text), "n", "form",
                         F.when(changed, F.col("low")).alias("prefix_chars"),
                         F.when(changed, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from; the pieces hold no sentinel, so each is found by its own."""
    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, end, 1), start, -1)

    # Each sentinel stands once: what follows the last start and precedes the first end is the piece.
    psm = F.concat(between(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
