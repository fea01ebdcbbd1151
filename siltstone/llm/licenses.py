"""Licence scan by canonical digests of entire texts.

A text is put into a canonical form: lower case, copyright lines dropped, punctuation and white space reduced to single
blanks, equivalent spellings replaced. Its SHA-256 is joined with the digests of known licences in the same form. What is
looked up is every entire unit: the document as a whole, each of its paragraphs, each of its lines, and each run of
consecutive lines, over paragraphs too, that begins with the first words of a known licence and has as many words as one
that begins so. A notice or a full licence is thus found as part of a longer document, however its lines are wrapped; it
has to begin and end with a line. No text is compared with another, and no pairs arise.

The list of known licences is a frame like any other; Spark broadcasts it by its own threshold or shuffles it. First words
and numbers of words, a few for each licence, reach the driver. Documents leave only digests to the join. Runs are found
by a pandas UDF over canonical lines, which counts words and makes digests; the rest is DataFrame expressions.

Defined results: null and empty texts match nothing, and neither does a unit whose canonical form is empty; rows with equal
ids are reported together; a licence listed under two names is reported under both, and one that lies within another is
reported too. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import license_list
from siltstone.llm.common import column, written

HEAD = 3  # words by which a run that may be a licence is recognised
BLANK_LINE = r"^[\x20\x09\x0B-\x0D]*$"

# Equivalent spellings, as whole words of the canonical form.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
             ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("c", "copyright"),
             ("v2", "version 2"), ("v3", "version 3"))

# Spellings of one word as two, which may stand on two lines.
SPLIT = {tuple(written.split()): meant for written, meant in SPELLINGS if " " in written}

COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*$"

# Notices and short licences, as their authors word them; ``license_list`` has whole texts and all others.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted.",
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without "
             "royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without "
             "any warranty.",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text; equal for texts that differ in case, punctuation, spacing, copyright or spelling."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for written, meant in SPELLINGS:
        words = F.replace(words, F.lit(f" {written} "), F.lit(f" {meant} "))
    return F.trim(words)


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """Known licences, of the registered list if no other is given: ``license``, ``digest``, first words, count of words."""
    rows = sorted({*NOTICES.items(), *license_list.rows()}) if texts is None else list(texts.items())
    listed = spark.createDataFrame(rows, "license string, text string")
    forms = listed.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return forms.select("license", F.sha2("form", 256).alias("digest"), F.substring_index("form", " ", HEAD).alias("head"),
                        F.size(F.split("form", " ")).alias("words")).distinct()


def run_digests(forms: list[str | None], heads: dict[str, list[int]], firsts: set[str]) -> list[str]:
    """Digests of the runs of two lines or more that may be a licence, given the canonical lines; null for a blank line.

    A run that is a whole paragraph or the whole text is left out, since those are looked up anyway.
    """
    if not any(f and f.partition(" ")[0] in firsts for f in forms):
        return []
    words: list[str] = []
    starts, ends, paragraphs = [], {}, [[0, -1]]
    line = 0
    for form in forms:
        if form is None:
            paragraphs.append([line, line - 1])
        elif form:
            own = form.split(" ")
            joined = SPLIT.get((words[-1], own[0])) if words else None
            if joined:
                # A word over two lines: neither ends or begins a run there.
                ends.pop(len(words), None)
                words[-1], own = joined, own[1:]
            else:
                starts.append((len(words), line))
            words += own
            ends[len(words)] = paragraphs[-1][1] = line
            line += 1
    elsewhere = {(0, line - 1), *map(tuple, paragraphs)}
    found = []
    for at, first in starts:
        if words[at] in firsts:
            for width in range(1, HEAD + 1):
                for count in heads.get(" ".join(words[at:at + width]), ()) if at + width <= len(words) else ():
                    last = ends.get(at + count, first)
                    if last != first and (first, last) not in elsewhere:
                        found.append(hashlib.sha256(" ".join(words[at:at + count]).encode()).hexdigest())
    return found


def scan(df: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document and licence found: whether the whole text is it, how many lines are, how many paragraphs or other runs
    of lines are, and the digest."""
    licenses = written(licenses, "licenses")
    heads: dict[str, list[int]] = {}
    for r in licenses.select("head", "words").distinct().collect():
        heads.setdefault(r["head"], []).append(r["words"])
    firsts = {h.partition(" ")[0] for h in heads}
    body = F.coalesce(column(text), F.lit(""))

    # Digests are made before the rows are unnested: each once, and no text is copied into a row of its own.
    def units(parts: Column, kind: str, digest=lambda p: F.sha2(canonical(p), 256)) -> Column:
        return F.transform(parts, lambda p: F.struct(F.lit(kind).alias("kind"), digest(p).alias("digest")))

    def runs(lines: pd.Series) -> pd.Series:
        return pd.Series([run_digests(list(x), heads, firsts) for x in lines], dtype=object)

    lines, paragraphs = F.split(body, "\n"), F.split(body, r"\n[\x20\x09\x0B-\x0D]*\n")
    forms = F.transform(lines, lambda x: F.when(~x.rlike(BLANK_LINE), canonical(x)))
    own = F.concat(units(F.array(body), "text"), units(F.filter(paragraphs, lambda p: p.contains("\n")), "paragraph"),
                   units(lines, "line"))
    found = F.pandas_udf(runs, T.ArrayType(T.StringType()))(forms)
    every = F.concat(own, units(found, "paragraph", lambda digest: digest))
    spread = df.select(column(key).alias("key_"), F.explode(every).alias("u"))
    hits = spread.select("key_", "u.kind", "u.digest").join(licenses.select("license", "digest"), "digest")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return hits.groupBy("key_", "license", "digest").agg(
        (count("text") > 0).alias("whole_text"), count("paragraph").alias("paragraphs"), count("line").alias("lines")
    ).select(F.col("key_").alias(key), "license", "digest", "whole_text", "paragraphs", "lines")
