"""License scans: sparse TF-IDF cosine to templates, then inheritance by directory.

Terms are lower-case runs of ASCII letters and digits. The space is the templates'
vocabulary; a term's weight is ln((1 + documents) / (1 + documents with it)) + 1,
counted over all documents.

Headers: a text is cut into sentences, twice: line by line, and with wrapped lines joined
(comment marks at line starts removed, blank lines kept). A sentence is a header if its
cosine to a notice template reaches ``header_least``.

Licence files: every ``STEP`` words a window of ``WINDOW`` words of the whole text is
compared with the openings of licences. A text with a window at ``file_least`` or above holds
that licence; it is a licence file if it is not much longer than the licence itself
(``LONGER`` times its words and ``MARGIN`` more), so that a full, dated or
signed copy counts, and else the licence is its header (a source file that begins with it).

Only sentences and windows with an anchor are scored. Anchors are the heaviest terms, as
many as needed so that any text without one has a cosine below the threshold to every
template (the rest of a template holds too little of its length): leaving the
others out loses nothing.

A document without a header of its own takes the licence of the nearest directory above
it that has a licence file: its ancestor directories join the table of such directories.

Everything is DataFrame expressions. Defined cases: a null text counts as empty and
has no licence; a null path has no directory; ties go to the template listed first; of
several licence files in a directory the best, then the smallest id, speaks for it;
repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipfold.llm.common import column, once, write_scratch

HEADER_LEAST = 0.75
FILE_LEAST = 0.75
WINDOW, STEP = 64, 16
LONGER, MARGIN = 1.5, 100

# Licence names, and public notices and openings of licence files.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
                "later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                "later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
                 "option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                 "any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                 "any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
FILES = (
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("ISC", "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   'REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, '
                   'reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the '
                   "copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is "
                "permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble "
                "The licenses for most software are designed to take away your freedom to share and change it."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is "
                "permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble "
                "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, "
                 "Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is "
                 "not allowed. This is the first released version of the Lesser GPL."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
                 "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
                 "allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version "
                 "3 of the GNU General Public License."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
                 "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
                 "allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds "
                 "of works."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that '
                'creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination '
                "of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                     "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the "
                     "name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                  "for any purpose, commercial or non-commercial, and by any means."),
)
#: Words of the licences themselves.
FILE_WORDS = {"MIT": 170, "ISC": 130, "Apache-2.0": 1600, "GPL-2.0": 3000, "GPL-3.0": 5700, "LGPL-2.1": 4400, "LGPL-3.0": 1250,
              "AGPL-3.0": 5600, "MPL-2.0": 2450, "BSD-3-Clause": 230, "Unlicense": 210}


def templates(notices=NOTICES, files=FILES) -> list[tuple[int, str, str, dict[str, int]]]:
    """(number, kind, licence, term counts): notices, their SPDX lines by rule, and files."""
    import re

    names = list(dict.fromkeys(n for n, _ in (*notices, *files)))  # each has its SPDX line
    rows = [*(("header", n, t) for n, t in notices), *(("header", n, f"SPDX-License-Identifier: {n}") for n in names),
            *(("file", n, t) for n, t in files)]
    out = []
    for k, (kind, name, text) in enumerate(rows):
        counts: dict[str, int] = {}
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            counts[w] = counts.get(w, 0) + 1
        out.append((k, kind, name, counts))
    return out


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def _weights(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], int]:
    """Term weights from the number of all documents that hold each."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = docs.select(F.explode(F.array_intersect(terms(F.col("text")), known)).alias("term"))
    n = docs.count()
    df = {r["term"]: r["count"] for r in held.groupBy("term").count().collect()}  # one row a vocabulary term
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}, n


def anchors(weights: dict[str, float], rows: list, least: float) -> list[str]:
    """Heaviest terms such that without them no text reaches ``least`` with any template."""
    ranked = sorted(weights, key=lambda w: (-weights[w], w))
    chosen: list[str] = []
    for w in [None, *ranked]:
        if w is not None:
            chosen.append(w)
        held = set(chosen)
        if all(sum((c * weights[t]) ** 2 for t, c in counts.items() if t not in held)
               < least ** 2 * sum((c * weights[t]) ** 2 for t, c in counts.items()) for _, _, _, counts in rows):
            break
    return chosen


def _cosines(units: DataFrame, spark: SparkSession, rows: list, weights: dict[str, float], least: float) -> DataFrame:
    """(unit, number, licence, score) of each unit's best template at or above ``least``.

    ``units`` has (unit, words). The template table has a fixed size, so it is broadcast.
    """
    table = []
    for number, _, name, counts in rows:
        norm = math.sqrt(sum((c * weights[t]) ** 2 for t, c in counts.items()))
        table += [(number, name, t, c * weights[t] / norm, weights[t]) for t, c in counts.items()]
    table = spark.createDataFrame(table, "number int, licence string, term string, share double, weight double")
    known = F.map_from_entries(F.array(*[F.struct(F.lit(t), F.lit(w)) for t, w in sorted(weights.items())]))
    counts = write_scratch(
        units.select("unit", F.explode("words").alias("term")).groupBy("unit", "term")
        .agg(F.count(F.lit(1)).alias("tf")).withColumn("w", F.col("tf") * F.element_at(known, F.col("term")))
        .where("w is not null"), "licence-counts")
    norms = counts.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (counts.join(F.broadcast(table), "term").groupBy("unit", "number", "licence")
            .agg(F.sum(F.col("w") * F.col("share")).alias("dot")))
    scored = (dots.join(norms, "unit").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
              .where(F.col("score") >= least))
    best = scored.groupBy("unit").agg(F.max(F.struct("score", -F.col("number"), "licence")).alias("b"))
    return best.select("unit", F.col("b.licence").alias("licence"), F.col("b.score").alias("score"))


def _parent(path: Column) -> Column:
    """The directory of a path; null at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def unwrapped(text: Column) -> Column:
    """The text with wrapped lines joined: a line's end and the comment marks that begin the
    next line become a space; blank lines stay."""
    return F.regexp_replace(text, r"[ \t]*\r?\n[ \t]*(?:(?:[/#*;%!>|-]+|REM|dnl)[ \t]+)?(?=[^\s/#*;%!>|-])", " ")


def license_scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text",
                 header_least: float = HEADER_LEAST, file_least: float = FILE_LEAST) -> DataFrame:
    """One row per input row: id, path, header, header_score, file_licence, file_score,
    inherited, inherited_from, licence."""
    spark = docs.sparkSession
    d = docs.select(column(docs, id_col).alias("id"), path.cast("string").alias("path"),
                    F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    rows = templates()
    weights, _ = _weights(d, sorted({t for r in rows for t in r[3]}))
    headers, files = ([r for r in rows if r[1] == kind] for kind in ("header", "file"))

    # One pass over the texts keeps those that a sentence or a window can match with.
    mark, file_mark = (F.array(*[F.lit(t) for t in anchors(weights, some, least)])
                       for some, least in ((headers, header_least), (files, file_least)))
    facts = once(terms(F.col("text")), lambda ws: F.struct(
        F.size(ws).alias("n"), F.arrays_overlap(ws, mark).alias("lines"), F.arrays_overlap(ws, file_mark).alias("whole")))
    some = d.withColumn("facts", facts).select(
        "id", "path", F.monotonically_increasing_id().alias("rid"), "text", "facts.n", "facts.lines", "facts.whole")
    kept = write_scratch(some.withColumn("text", F.when(F.col("lines") | F.col("whole"), F.col("text"))), "licence-texts")

    sentences = lambda text: F.transform(F.split(text, r"(?<=[.!?])[ \t]+|\n+"), terms)
    joined = F.when(F.contains("text", F.lit("\n")), sentences(unwrapped(F.col("text")))).otherwise(F.array())
    lines = (kept.where("lines").select("rid", F.posexplode(F.concat(sentences(F.col("text")), joined)).alias("pos", "words"))
             .where(F.arrays_overlap("words", mark)))
    header = (_cosines(lines.select(F.struct("rid", "pos").alias("unit"), "words"), spark, headers, weights, header_least)
              .groupBy(F.col("unit.rid").alias("rid"))
              .agg(F.max(F.struct("score", -F.col("unit.pos"), "licence")).alias("h"))
              .select("rid", F.col("h.licence").alias("noticed"), F.col("h.score").alias("notice_score")))
    starts = F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)), F.lit(STEP))
    windows = (kept.where("whole").select("rid", terms(F.col("text")).alias("all"), F.explode(starts).alias("at"))
               .select("rid", "at", F.slice("all", F.col("at"), F.lit(WINDOW)).alias("words")).where(F.arrays_overlap("words", file_mark)))
    file = (_cosines(windows.select(F.struct("rid", "at").alias("unit"), "words"), spark, files, weights, file_least)
            .groupBy(F.col("unit.rid").alias("rid")).agg(F.max(F.struct("score", -F.col("unit.at"), "licence")).alias("f"))
            .select("rid", F.col("f.licence").alias("held"), F.col("f.score").alias("held_score")))
    words = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in FILE_WORDS.items()]))
    is_file = F.col("n") <= F.element_at(words, F.col("held")) * LONGER + MARGIN
    own = F.when(~is_file & (F.col("noticed").isNull() | (F.col("held_score") > F.col("notice_score"))), F.col("held"))
    found = write_scratch(
        kept.select("rid", "id", "path", "n").join(header, "rid", "left").join(file, "rid", "left")
        .select("rid", "id", "path", F.coalesce(own, "noticed").alias("header"),
                F.when(own.isNotNull(), F.col("held_score")).otherwise(F.col("notice_score")).alias("header_score"),
                F.when(is_file, F.col("held")).alias("file_licence"), F.when(is_file, F.col("held_score")).alias("file_score"))
        .withColumn("own_dir", F.when(F.col("path").isNotNull(), F.coalesce(_parent(F.col("path")), F.lit("")))), "licence-found")

    # Directories that have a licence file, one row each, and every distinct directory's ancestors.
    best = F.max(F.struct("file_score", F.col("id").isNotNull().alias("known"), (-F.col("id").cast("long")).alias("least"),
                          (-F.col("rid")).alias("row"), "file_licence"))
    dirs = (found.where("file_licence is not null and own_dir is not null").groupBy(F.col("own_dir").alias("dir"))
            .agg(best.alias("b")).select("dir", F.col("b.file_licence").alias("licence")))
    parts = F.filter(F.split("own_dir", "/", -1), lambda _, i: (i > 0) | (F.col("own_dir") != ""))
    above = (found.where("header is null and file_licence is null and own_dir is not null").select("own_dir").distinct()
             .select("own_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
                 n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))).alias("a"))
             .select("own_dir", "a.depth", "a.dir"))
    near = (above.join(dirs, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "licence")).alias("i"))
            .select("own_dir", F.col("i.licence").alias("inherited"), F.col("i.dir").alias("inherited_from")))
    bare = F.col("header").isNull() & F.col("file_licence").isNull()
    out = found.join(near, "own_dir", "left")
    return (out.select("id", "path", "header", "header_score", "file_licence", "file_score",
                       F.when(bare, F.col("inherited")).alias("inherited"), F.when(bare, F.col("inherited_from")).alias("inherited_from"))
            .select(F.col("id").alias(id_col), "path", "header", "header_score", "file_licence", "file_score", "inherited",
                    "inherited_from", F.coalesce("file_licence", "header", "inherited").alias("licence")))
