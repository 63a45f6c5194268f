"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines, sentences, paragraphs, the leading comment block and the whole text are compared with templates, from statements of
a line to whole licences, and stretches of a template's length wherever they stand. What cannot reach the threshold by an upper bound of its cosine is left out
before scoring; each distinct unit is scored once. Directories, not files, look for their nearest licensed ancestor.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillkeep.llm.common import stored, table
from stillkeep.llm.license_texts import FULL_TEXTS
from stillkeep.storage import shuffled

# Short statements by which well-known licences are named in headers and licence files; whole texts and notices follow.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "All-Rights-Reserved": "Copyright. All rights reserved",
    "All-Rights-Reserved-text": "All rights reserved",
    **FULL_TEXTS,
}
#: Names that say the licence where they stand alone; in running text they are only mentioned.
NAMES = {
    "Apache-2.0-name": "Apache-2.0",
    "GPL-2.0-name": "GPL v2",
    "GPL-3.0-name": "GPL v3",
    "CC-BY-4.0-name": "CC BY 4.0",
    "CC-BY-SA-4.0-name": "CC BY-SA 4.0",
    "CC-BY-NC-4.0-name": "CC BY-NC 4.0",
}
#: A stretch without borders of its own, inside a longer sentence, counts from this cosine on.
INSIDE = 0.9
FOUND = [("own", T.LongType()), ("words", T.LongType()), ("unit", T.StringType()), ("need", T.DoubleType()), ("first", T.LongType()), ("end", T.LongType())]
_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_COMMENT = re.compile(r"\s*(#|//|/\*|\*|--|;|%|<!--|\"\"\"|'''|\.\.|REM\b|$)")
_SENTENCE_END = re.compile(r"[.!?][\"')\]*/]*$")


def tokens(text: str) -> list[str]:
    """Lower-case runs of letters, digits and dots inside numbers."""
    return _TOKEN.findall(text.lower())


def units(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text and the stretches of them that are compared: lines, sentences, paragraphs, leading comment, all.

    A line without a letter or digit ends a paragraph. A sentence may go over several lines; it ends at .!? unless the
    next word starts in lower case or with a digit.
    """
    words: list[str] = []
    spans: set[tuple[int, int]] = set()
    paragraphs, begun, leading = [], 0, True
    for line in text.split("\n"):
        at = len(words)
        if leading and not _COMMENT.match(line):
            leading = False
            spans.add((0, at))
        own = line.split()
        words += own
        if any(c.isalnum() for c in line):
            spans.add((at, len(words)))
        else:
            paragraphs.append((begun, at))
            begun = len(words)
    paragraphs.append((begun, len(words)))
    for first, end in paragraphs:
        at = first
        real = [k for k in range(first, end) if any(c.isalnum() for c in words[k])]
        for k, after in zip(real, real[1:], strict=False):
            if _SENTENCE_END.search(words[k]):
                start = words[after].lstrip("\"'([*")[:1]
                if not (start.islower() or start.isdigit()):
                    spans.add((at, k + 1))
                    at = k + 1
        spans.add((at, end))
    spans |= {*paragraphs, (0, len(words))}
    return words, sorted(x for x in spans if x[0] < x[1])


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many lines each token occurs; the number of lines with a token stands at ''."""
    for batch in batches:
        df: Counter[str] = Counter()
        for text in batch.column(0):
            for line in (text.as_py() or "").lower().split("\n"):
                own = set(_TOKEN.findall(line))
                if own:
                    df.update(own)
                    df[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64())], ["token", "df"])


def _finder(idf: dict[str, float], threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Emits each unit whose cosine to a template may reach the threshold: tokens outside the templates weigh 1 at least."""
    vectors, sizes = {}, {}
    for name, text in (TEMPLATES | NAMES).items():
        own = Counter(tokens(text))
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items()))
        vectors[name] = {t: n * idf[t] / norm for t, n in own.items()}
        if name in TEMPLATES:
            sizes[name] = sum(own.values())

    def bound(own: list[str], names: list[str]) -> float:
        tf = Counter(own)
        norm = math.sqrt(sum((n * idf.get(t, 1.0)) ** 2 for t, n in tf.items()))
        return max((sum(tf[t] * idf[t] * w for t, w in vectors[x].items() if t in tf) for x in names), default=0.0) / norm if norm else 0.0

    def candidates(text: str) -> Iterator[tuple[int, str, float, int, int]]:
        known = idf.keys() & set(tokens(text))
        # by Cauchy-Schwarz a cosine is at most the length of the part of the template that the text holds
        share = {x: math.sqrt(sum(w * w for t, w in v.items() if t in known)) for x, v in vectors.items()} if known else {}
        names = [x for x, v in share.items() if v >= threshold - 1e-6]
        if not names:
            return
        words, spans = units(text)
        by_word = [tokens(w) for w in words]
        for a, b in spans:
            own = [t for k in range(a, b) for t in by_word[k]]
            if not known.isdisjoint(own) and bound(own, names) >= threshold - 1e-6:
                yield len(words), " ".join(own), threshold, a, b
        flat = [(t, k) for k, own in enumerate(by_word) for t in own]
        alone, inside = [t for t, _ in flat], max(INSIDE, threshold)
        for x in names:
            if x not in sizes or share[x] < inside - 1e-6:
                continue
            vector, size = vectors[x], sizes[x]
            held = [vector.get(t, 0.0) ** 2 for t in alone]
            for at in range(len(alone) - size + 1):
                if held[at] and sum(held[at : at + size]) >= inside * inside - 1e-6:
                    own = alone[at : at + size]
                    if bound(own, [x]) >= inside - 1e-6:
                        yield len(words), " ".join(own), inside, flat[at][1], flat[at + size - 1][1] + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column("text")):
                for one in candidates(text.as_py()):
                    rows.append(k)
                    found.append(one)
            keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "path", "own")]
            columns = list(zip(*found, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "path", "own", "words", "unit", "need", "first", "end"])

    return find


SALTS = 16  # parts of a token, a unit or a directory that a large share of rows has


def salted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def spread(rows: DataFrame) -> DataFrame:
    """The small side of a join with ``salted`` rows."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def scored_units(distinct: DataFrame, df: DataFrame, total: int, template: DataFrame) -> DataFrame:
    """The best template of each unit. distinct: (unit), its tokens with a space between. Returns unit, template, score."""
    idf = lambda df: F.log((1.0 + total) / (1.0 + df)) + 1.0
    words = distinct.select("unit", F.explode(F.split("unit", " ")).alias("token")).groupBy("unit", "token").agg(F.count(F.lit(1)).alias("tf"))
    wanted = spread(df.join(shuffled(words.select("token").distinct()), "token", "left_semi"))
    weighted = salted(words, "unit").join(shuffled(wanted), ["token", "salt"]).select("unit", "token", (F.col("tf") * idf(F.col("df"))).alias("w"))
    norm = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        weighted.join(F.broadcast(template), "token")  # a fixed table of a few hundred rows
        .groupBy("unit", "template")
        .agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
        .join(shuffled(norm), "unit")
        .select("unit", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    )
    best = F.min(F.struct(-F.col("score"), F.col("template"))).alias("best")
    return dots.groupBy("unit").agg(best).select("unit", "best.template", (-F.col("best.col1")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def license_scan(files: DataFrame, threshold: float = 0.6, cover: float = 0.5) -> DataFrame:
    """The licence of each file. files: (doc_id, path, text), paths starting with a slash.

    Returns one row per input row: doc_id, path, own_license and own_score (the best unit of the
    text at ``threshold`` or more, or stretch inside one at INSIDE or more; of equal scores the first by name; idf over all
    lines with a token), is_license_file (named LICENSE, LICENCE or COPYING, or what was found makes up ``cover`` of
    the words), license, inherited_from (the directory, if not its own).
    A directory's licence is the commonest of its licence files, of equals the first by name. A file without one of
    its own takes that of the nearest directory upwards, its own directory first. A null or empty text has no
    licence of its own; a null path inherits nothing; repeated rows give a row each. Other columns are not read.
    """
    spark = files.sparkSession
    base = files.select("doc_id", "path", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = stored(base.select("text").mapInArrow(_line_counts, "token string, df bigint").groupBy("token").agg(F.sum("df").alias("df")), "token_lines")
    vocabulary = sorted({t for text in (TEMPLATES | NAMES).values() for t in tokens(text)})
    counts = {r["token"]: r["df"] for r in df.where(F.col("token").isin(["", *vocabulary])).collect()}  # the templates' tokens only
    total = counts.get("", 0)
    idf = {t: math.log((1.0 + total) / (1.0 + counts.get(t, 0))) + 1.0 for t in vocabulary}
    weights = []
    for name, text in (TEMPLATES | NAMES).items():
        tf = Counter(tokens(text))
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in tf.items()))
        weights += [(name, t, n * idf[t] / length) for t, n in tf.items()]
    template = spark.createDataFrame(weights, "template string, token string, tw double")
    shape = T.StructType([*base.schema.fields[:2], *(T.StructField(c, t) for c, t in FOUND)])
    heads = stored(base.select("doc_id", "path", F.xxhash64("text").alias("own"), "text").mapInArrow(_finder(idf, threshold), shape), "headers")
    scores = stored(scored_units(heads.select("unit").distinct(), df, total, template).where(F.col("score") >= threshold), "scores")
    hits = salted(heads, "doc_id", "path").join(shuffled(spread(scores)), ["unit", "salt"]).drop("salt").where(F.col("score") >= F.col("need"))
    named = F.coalesce(F.upper(F.regexp_extract("path", r"([^/]*)$", 1)).rlike(r"^(LICEN[CS]E|COPYING)([.-].*)?$"), F.lit(False))
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", F.col("end") - 1)))))  # hits may overlap
    own = stored(
        hits.groupBy("doc_id", "path", "own", "words")
        .agg(F.min(F.struct(-F.col("score"), F.col("template"))).alias("best"), covered.alias("covered"))
        .select(
            "doc_id",
            "path",
            "own",
            F.regexp_replace("best.template", "-(text|name|full)$", "").alias("own_license"),
            (-F.col("best.col1")).alias("own_score"),
            (named | (F.col("covered") >= cover * F.col("words"))).alias("is_license_file"),
        ),
        "own_licenses",
    )
    votes = own.where("is_license_file").groupBy(directory(F.col("path")).alias("dir"), "own_license").count()
    chosen = votes.groupBy("dir").agg(F.min(F.struct(-F.col("count"), F.col("own_license"))).alias("best"))
    chosen = chosen.select("dir", F.col("best.own_license").alias("dir_license"))
    places = base.select(directory(F.col("path")).alias("dir")).where("dir IS NOT NULL").distinct()
    parts = F.split("dir", "/")
    above = places.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    above = above.withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = (
        salted(above, "dir")  # all directories have the root above them
        .join(shuffled(spread(chosen.withColumnRenamed("dir", "ancestor"))), ["ancestor", "salt"])
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("near"))
        .select("dir", "near.ancestor", "near.dir_license")
    )
    # equal (doc_id, path, text) rows share one row of `own`
    rows = base.select("doc_id", "path", F.xxhash64("text").alias("own"), directory(F.col("path")).alias("dir"))
    same = rows["doc_id"].eqNullSafe(own["doc_id"]) & rows["path"].eqNullSafe(own["path"]) & (rows["own"] == own["own"])
    joined = rows.join(shuffled(own), same, "left").select(rows["doc_id"], rows["path"], rows["dir"], "own_license", "own_score", "is_license_file")
    return joined.join(shuffled(nearest), "dir", "left").select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull() & F.col("dir_license").isNotNull(), F.when(F.col("ancestor") == "", "/").otherwise(F.col("ancestor"))).alias("inherited_from"),
    )


def files_of(docs: DataFrame) -> DataFrame:
    """``documents`` as a file tree: /source/lang/block/doc_id.txt, with blocks of 100 neighbouring ids."""
    block = F.floor(F.col("doc_id") / 100).cast("string")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", F.concat(F.lit("/"), F.concat_ws("/", "source", "lang", block, name)).alias("path"), "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(files_of(table(spark, sf_dir, "documents")))
