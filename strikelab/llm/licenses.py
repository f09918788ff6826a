"""Licence scans, in DataFrame functions only: TF-IDF cosine of lines to notices and of whole texts to licences, then inheritance from the nearest directory."""

from __future__ import annotations

import math
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A line with at least this cosine to a template is a notice of its licence.
LEAST = 0.6
#: A text is a licence file if its notices hold at least one word in so many.
FILE_SHARE = 2
#: A text with at least this cosine to a whole licence is a file of it.
WHOLE_LEAST = 0.8
#: A notice is wrapped over so many lines at most.
JOINED = 8

# Licence and wording of its notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
_BREAK = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> set[str]:
    return set("".join(c if c.isalnum() else " " for c in text.lower()).split())


VOCABULARY = sorted({t for _, text in TEMPLATES for t in _terms(text)})


def whole_licences() -> dict[str, dict[str, int]]:
    """How often each term occurs in the licence, for each text of `licence_texts`."""
    out = {}
    for at in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda p: p.name):
        terms = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in at.read_text("utf-8").translate(str.maketrans(_CAPITALS, _SMALL))).split()
        out[at.name.removesuffix(".txt")] = {t: terms.count(t) for t in sorted(set(terms))}
    return out


def units(docs: DataFrame) -> DataFrame:
    """doc_id, path, line, known (the line's distinct terms that templates use), others (how many it has besides) for each line with a term."""
    lines = docs.select("doc_id", "path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    terms = F.array_distinct(F.array_remove(F.split(F.translate("text", _CAPITALS, _SMALL), _BREAK), ""))
    lines = lines.select("doc_id", "path", "line", terms.alias("terms"))
    return lines.select("doc_id", "path", "line", F.size("terms").alias("n"), F.array_intersect("terms", F.array(*map(F.lit, VOCABULARY))).alias("known")).where("n > 0").select("doc_id", "path", "line", "known", (F.col("n") - F.size("known")).alias("others"))


def joined(lines: DataFrame, least: float = LEAST) -> DataFrame:
    """lines (of units) and runs of up to JOINED of them: doc_id, path, line, last, known, others.

    Of a run, known are the distinct terms that templates use, and others those of its lines added up.
    """
    # others <= c known holds for a run only if it holds for one of its lines.
    can = F.col("others") <= (1 / least**2 - 1) * F.size("known") + 1e-6
    text = Window.partitionBy("doc_id", "path")
    runs = lines.withColumn("can", F.max(can).over(text)).where("can")
    after = F.collect_list(F.struct("line", "known", "others")).over(text.orderBy("line").rowsBetween(0, JOINED - 1))
    runs = runs.select("doc_id", "path", "line", after.alias("r")).where("size(r) > 1")
    runs = runs.select("doc_id", "path", "line", F.explode(F.expr("transform(sequence(2, size(r)), k -> slice(r, 1, k))")).alias("r"))
    runs = runs.select("doc_id", "path", "line", F.expr("element_at(r, -1).line").alias("last"), F.array_distinct(F.flatten("r.known")).alias("known"), F.expr("aggregate(r.others, 0, (a, x) -> a + x)").alias("others"))
    return lines.select("doc_id", "path", "line", F.col("line").alias("last"), "known", "others").unionByName(runs)


def whole_files(docs: DataFrame, least: float = WHOLE_LEAST) -> DataFrame:
    """doc_id, path, whole_licence, whole_score of each row of docs whose text has at least this cosine to a whole licence.

    A text's vector has each of its terms, its count times the idf over the texts (and 1, so that a single text has
    weights too). Of equals the last by name.
    """
    licences = whole_licences()
    vocabulary = sorted({t for counts in licences.values() for t in counts})
    array = lambda terms: F.split(F.lit(" ".join(terms)), " ")
    all_terms = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), _CAPITALS, _SMALL), _BREAK), "")
    texts = docs.select("doc_id", "path", all_terms.alias("terms"))
    known = texts.where("size(terms) > 0").select(F.explode(F.concat(F.array_intersect("terms", array(vocabulary)), F.array(F.lit("")))).alias("t"))
    # One row for each term of the licences: bounded by them.
    df = {r["t"]: r["count"] for r in known.groupBy("t").count().collect()}
    n = df.get("", 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    new = math.log(1 + n) + 1
    weights, needed = [], set()
    for k, (name, counts) in enumerate(licences.items()):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))
        unit = {t: c * idf[t] / norm for t, c in counts.items()}
        weights += [(k, name, t, w) for t, w in unit.items()]
        # The cosine is at most the norm of the licence's part that the text shares, so it cannot do without all of these.
        lost = 0.0
        for t in sorted(unit, key=lambda t: (df.get(t, 0), -unit[t], t)):
            if lost > 1 - least**2 + 1e-6:
                break
            lost += unit[t] ** 2
            needed.add(t)
    spark = docs.sparkSession
    weights = spark.createDataFrame(weights, "k int, name string, t string, w double")
    plain = spark.createDataFrame(list(idf.items()), "t string, idf double")
    can = texts.where(F.arrays_overlap("terms", array(sorted(needed)))).select(F.expr("uuid()").alias("id"), "doc_id", "path", "terms")
    can = stored(can, "licence-texts")
    counts = can.select("id", F.explode("terms").alias("t")).groupBy("id", "t").agg(F.count("*").alias("c"))
    counts = stored(counts.join(F.broadcast(plain), "t", "left").select("id", "t", (F.col("c") * F.coalesce("idf", F.lit(new))).alias("x")), "licence-counts")
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counts.join(F.broadcast(weights), "t").groupBy("id", "k", "name").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    best = dots.join(norms, "id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 4)).where(F.col("score") >= least).groupBy("id").agg(F.max(F.struct("score", "name")).alias("best"))
    return can.join(best, "id").groupBy("doc_id", "path").agg(F.max("best").alias("b")).select("doc_id", "path", F.col("b.name").alias("whole_licence"), F.col("b.score").alias("whole_score"))


def directory(path: Column) -> Column:
    """The path up to its last slash; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def licence_scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, path, own_licence, own_score, is_licence_file, licence, licence_from for each row of docs (doc_id, path, text).

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; a line's vector has the idf of each
    of its distinct terms, counted over all lines of docs (a term that no template uses has the idf of a new term); own is
    the licence of the best line with a cosine of `least` or more, of equals the last by name, or of a run of lines (a
    wrapped notice) where that is better. A text near a whole licence (`whole_files`) is a file of that licence, whatever
    its lines say; so is a text with one term in FILE_SHARE or more in lines that hold a notice. A document without an own licence gets that of the nearest directory
    above it with licence files (most files, of equals the first by name), with licence_from that directory; with an own
    licence, licence_from is its path. Null texts have no licence of their own; null paths are files at the top. Documents
    that share id and path count as one text with all their lines. No rows: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    lines = stored(units(docs), "licence-lines")
    # One row for each term of the templates: bounded by them.
    counts = lines.select(F.explode(F.concat("known", F.array(F.lit("")))).alias("t")).groupBy("t").count().collect()
    df = {r["t"]: r["count"] for r in counts}
    n = df.get("", 0)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1e-9 for t in VOCABULARY}
    new = math.log(1 + n) + 1e-9
    spark = docs.sparkSession
    weights = []
    for k, (name, text) in enumerate(TEMPLATES):
        terms = sorted(_terms(text))
        norm = math.sqrt(sum(idf[t] ** 2 for t in terms))
        weights += [(k, name, t, idf[t], idf[t] / norm) for t in terms]
    weights = spark.createDataFrame(weights, "k int, name string, t string, idf double, w double")
    plain = spark.createDataFrame([(t, idf[t]) for t in VOCABULARY], "t string, idf double")
    # No idf is above a new term's, so lines with more other terms than this are below `least` for any template.
    few = joined(lines, least).where(F.col("others") <= (1 / least**2 - 1) * F.size("known") + 1e-6).select("doc_id", "path", "line", "last", "others", F.explode("known").alias("t"))
    few = stored(few, "licence-terms")
    key = ["doc_id", "path", "line", "last"]
    norms = few.join(F.broadcast(plain), "t").groupBy(*key).agg(F.sum(F.col("idf") * F.col("idf")).alias("known2"), F.first("others").alias("others"))
    dots = few.join(F.broadcast(weights), "t").groupBy(*key, "k", "name").agg(F.sum(F.col("w") * F.col("idf")).alias("dot"))
    b = norms.select(*(F.col(c).alias(f"_{c}") for c in key), "known2", "others")
    same = lambda *names: reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))
    scored = dots.join(b, same(*key))
    scored = scored.withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("known2") + F.col("others") * F.lit(new * new)), 4)).where(F.col("score") >= least)
    # A run counts where it is better than each line of the text; of a template's runs the best, of equals the longest.
    line = F.col("line") == F.col("last")
    single = F.max(F.when(line, F.col("score"))).over(Window.partitionBy("doc_id", "path"))
    place = F.row_number().over(Window.partitionBy("doc_id", "path", "k", line).orderBy(F.desc("score"), F.col("line") - F.col("last"), "line"))
    notices = scored.withColumn("single", single).withColumn("place", place).where(line | (F.col("place") == 1) & (F.col("single").isNull() | (F.col("score") > F.col("single"))))
    notices = stored(notices.groupBy(*key).agg(F.max(F.struct("score", "name")).alias("best")), "licence-notices")
    best = notices.groupBy("doc_id", "path").agg(F.max("best").alias("best"))
    held = notices.select("doc_id", "path", F.explode(F.sequence("line", "last")).alias("line")).distinct()
    held = held.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "path", "line")))
    known = lines.join(held, same("doc_id", "path", "line"), "left").groupBy("doc_id", "path").agg(F.sum(F.when(F.col("_line").isNotNull(), F.size("known") + F.col("others"))).alias("in_notices"), F.sum(F.size("known") + F.col("others")).alias("terms"))
    known = known.where("in_notices > 0").select(F.col("doc_id").alias("_doc_id"), F.col("path").alias("_path"), "in_notices", "terms")
    own = best.join(known, same("doc_id", "path")).select("doc_id", "path", F.col("best.name").alias("own_licence"), F.col("best.score").alias("own_score"), (F.col("in_notices") * FILE_SHARE >= F.col("terms")).alias("is_licence_file"))
    whole = whole_files(docs).select(F.col("doc_id").alias("_doc_id"), F.col("path").alias("_path"), "whole_licence", "whole_score")
    own = own.join(whole, same("doc_id", "path"), "full")
    own = own.select(
        F.coalesce("doc_id", "_doc_id").alias("doc_id"), F.coalesce("path", "_path").alias("path"), F.coalesce("whole_licence", "own_licence").alias("own_licence"),
        F.coalesce("whole_score", "own_score").alias("own_score"), (F.col("whole_licence").isNotNull() | F.coalesce("is_licence_file", F.lit(False))).alias("is_licence_file"),
    )
    own = stored(own, "licence-own")

    by_directory = own.where("is_licence_file").groupBy(directory(F.col("path")).alias("at"), "own_licence").agg(F.count("*").alias("files"))
    by_directory = by_directory.groupBy("at").agg(F.min(F.struct((-F.col("files")).alias("f"), F.col("own_licence").alias("name"))).alias("m")).select("at", F.col("m.name").alias("name"))
    folders = docs.select(directory(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("at")).distinct()
    nearest = above.join(by_directory, "at").groupBy("folder").agg(F.max(F.struct(F.length("at").alias("l"), "at", "name")).alias("m")).select("folder", F.col("m.at").alias("at"), F.col("m.name").alias("name"))

    rows = docs.select("doc_id", "path", directory(F.col("path")).alias("folder"))
    found = own.select(F.col("doc_id").alias("_d"), F.col("path").alias("_p"), "own_licence", "own_score", "is_licence_file")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("path") == F.col("_p")), "left").join(nearest, "folder", "left")
    return rows.select(
        "doc_id", "path", "own_licence", "own_score", F.coalesce("is_licence_file", F.lit(False)).alias("is_licence_file"),
        F.coalesce("own_licence", "name").alias("licence"), F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("at")).alias("licence_from"),
    )


def oracle(documents: str, least: float = LEAST) -> str:
    """The same in SQL over `documents`, a query that gives doc_id, path and text."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    vocabulary = "[" + ", ".join(map(quoted, VOCABULARY)) + "]"
    pairs = ", ".join(f"({k}, {quoted(name)}, {quoted(t)})" for k, (name, text) in enumerate(TEMPLATES) for t in sorted(_terms(text)))
    directory_of = lambda c: f"regexp_replace({c}, '/?[^/]*$', '')"
    return f"""
WITH docs AS ({documents}),
l AS (SELECT doc_id, path, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM docs),
w AS (SELECT doc_id, path, line, list_distinct(list_filter(string_split_regex(translate(text, '{_CAPITALS}', '{_SMALL}'), '{_BREAK}'), lambda x: x <> '')) AS terms FROM l),
u AS (SELECT doc_id, path, line, list_intersect(terms, {vocabulary}) AS known, len(terms) AS n FROM w WHERE len(terms) > 0),
n AS (SELECT count(*) AS n FROM u),
idf AS (SELECT t, ln((1 + (SELECT n FROM n)) / (1 + coalesce(df, 0))) + 1e-9 AS idf FROM (SELECT unnest({vocabulary}) AS t) LEFT JOIN (SELECT unnest(known) AS t, count(*) AS df FROM u GROUP BY 1) USING (t)),
tp AS (SELECT k, name, t, idf / sqrt(sum(idf * idf) OVER (PARTITION BY k)) AS w FROM (VALUES {pairs}) AS v(k, name, t) JOIN idf USING (t)),
e AS (SELECT doc_id, path, line, n, unnest(known) AS t FROM u),
norm AS (SELECT doc_id, path, line, n, sqrt(sum(idf * idf) + (n - count(*)) * (ln(1 + (SELECT n FROM n)) + 1e-9) ** 2) AS norm FROM e JOIN idf USING (t) GROUP BY doc_id, path, line, n),
sc AS (SELECT doc_id, path, line, norm.n, k, name, round(sum(w * idf) / any_value(norm), 4) AS score FROM e JOIN idf USING (t) JOIN tp USING (t) JOIN norm USING (doc_id, path, line) GROUP BY ALL),
no AS (SELECT doc_id, path, line, n, max({{'score': score, 'name': name}}) AS best FROM sc WHERE score >= {least} GROUP BY ALL),
sz AS (SELECT doc_id, path, sum(n) AS terms FROM u GROUP BY ALL),
own AS (SELECT doc_id, path, best.name AS own_licence, best.score AS own_score, m * {FILE_SHARE} >= terms AS is_licence_file FROM (SELECT doc_id, path, max(best) AS best, sum(n) AS m FROM no GROUP BY ALL) JOIN sz USING (doc_id, path)),
dir AS (SELECT at_, m.name AS name FROM (SELECT at_, min({{'f': -files, 'name': own_licence}}) AS m FROM (SELECT {directory_of("path")} AS at_, own_licence, count(*) AS files FROM own WHERE is_licence_file GROUP BY ALL) GROUP BY at_)),
r AS (SELECT doc_id, path, {directory_of("path")} AS folder FROM docs),
ne AS (SELECT folder, max({{'l': length(at_), 'at_': at_, 'name': name}}) AS m FROM (SELECT DISTINCT folder FROM r) JOIN dir ON at_ = '' OR folder = at_ OR starts_with(folder, at_ || '/') GROUP BY folder)
SELECT doc_id, path, own_licence, own_score, coalesce(is_licence_file, false) AS is_licence_file, coalesce(own_licence, m.name) AS licence, CASE WHEN own_licence IS NOT NULL THEN path ELSE m.at_ END AS licence_from
FROM r LEFT JOIN own USING (doc_id, path) LEFT JOIN ne USING (folder)
"""
