"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only.  Templates are notices, standard headers and the bodies of short
licenses.  A text's windows are laid around its anchor words (``ANCHORS``): for each template
that has the anchor, as many words as the template has, so placed that its first such anchor
falls on the text's; so a window reaches back as well as on, over any number of lines, and
comment marks do not count.  A window's vector has one dimension for each word of the
templates, weighted by its count times its inverse document frequency over all files; every
other word counts as a word of its own that no file has yet.  A window is compared with its
template, and a file takes the template of its best window if the cosine is at least
``least``; a mere notice of rights (``Proprietary``) only where no license reaches that.  An SPDX tag
names the license itself, with a cosine of 1, before all windows; the first tag of a text counts.

A template of which a text has lost or changed every anchor word is not found there.

A file is a license file if it is named like one or half of its words are in
its best window or tag.  Files without a license of their own take that of the nearest
directory above them that has a license file (the best one there).  Directories are
resolved first, each against its own ancestors, and files join their directory.

Defined results: a null or empty text has no license of its own; a null path
lies in the root; ties between templates go to the smaller name, between license files to
the better cosine, then the smaller path; repeated rows are scanned each and get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import sheltered, without, written

#: What an anchor word holds; every template has one.
ANCHORS = ("licen", "copyright", "reserved", "domain", "warrant", "redistribut")
TAG = r"SPDX-License-Identifier:\s*\(?([A-Za-z0-9.+-]+(?:\s+(?:AND|OR|WITH)\s+[A-Za-z0-9.+-]+)*)"
#: Names of license files, as the beginning of the last part of a path in lower case.
NAMES = ("license", "licence", "copying", "unlicense")
#: Directories whose license may be broadcast.
FEW = 20_000

#: Notices as their publishers word them (fixed values), by license.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def anchored(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for a in ANCHORS:
        found = found | F.contains(low, F.lit(a))
    return found


def anchor_of(word: Column) -> Column:
    """The first of ``ANCHORS`` that a word holds, or null."""
    out = F
    for a in ANCHORS:
        out = out.when(F.contains(word, F.lit(a)), a)
    return out


def _templates(df: DataFrame) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, license string, t string")
    return rows.select("template", "license", words(F.col("t")).alias("w"))


def _template_words(df: DataFrame) -> DataFrame:
    rows = _templates(df).select("template", "license", F.explode("w").alias("word"))
    return rows.groupBy("template", "license", "word").agg(F.count("*").alias("tf"))


def _alignments(df: DataFrame) -> DataFrame:
    """anchor, template, its number of words and the place of its first such anchor."""
    rows = _templates(df).select("template", F.size("w").alias("size"), F.posexplode("w").alias("offset", "word"))
    rows = rows.withColumn("anchor", anchor_of(F.col("word"))).where("anchor is not null")
    return rows.groupBy("anchor", "template", "size").agg(F.min("offset").alias("offset"))


def idf(files: DataFrame, text: str) -> DataFrame:
    """word and idf of every template word, over all files; a few hundred rows."""
    vocabulary = _template_words(files).select("word").distinct()
    n = files.agg(F.count("*").alias("n"))
    seen = files.select(F.explode(F.array_distinct(words(F.coalesce(text, F.lit(""))))).alias("word"))
    df = seen.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    both = vocabulary.join(df, "word", "left").crossJoin(F.broadcast(n))  # n is one row
    return both.select("word", F.log((1.0 + F.col("n")) / (1.0 + F.coalesce("df", F.lit(0)))).alias("idf"), F.log(1.0 + F.col("n")).alias("idf_new"))


def _windows(files: DataFrame, text: str) -> DataFrame:
    """scan_row, n_words (of the text), place of the anchor, template and words w of each window."""
    aligned = F.broadcast(_alignments(files))
    reach = max(len(t.split()) for _, t in TEMPLATES) * 2  # a word of a template may be cut into two
    rows = files.where(anchored(F.col(text))).select("scan_row", words(F.col(text)).alias("w"))
    # an anchor takes its surroundings along, not the whole text
    around = lambda i: F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach))
    at = F.transform("w", lambda x, i: F.when(anchor_of(x).isNotNull(), F.struct(i.alias("place"), anchor_of(x).alias("anchor"), around(i).alias("near"))))
    rows = rows.select("scan_row", F.size("w").alias("n_words"), F.explode(F.filter(at, lambda x: x.isNotNull())).alias("a")).select("scan_row", "n_words", "a.*")
    start = F.least("place", F.lit(reach)) - F.col("offset")
    cut = F.slice("near", F.greatest(start, F.lit(0)) + 1, F.col("size") + F.least(start, F.lit(0)))
    return rows.join(aligned, "anchor").select("scan_row", "n_words", "place", "template", cut.alias("w"))


def _tagged(files: DataFrame, text: str) -> DataFrame:
    """scan_row, license, cosine and share of the files with an SPDX tag."""
    tag = F.regexp_extract(text, TAG, 1)
    rows = files.where(F.contains(text, F.lit("SPDX-License-Identifier:"))).select("scan_row", tag.alias("license"), F.size(words(F.col(text))).alias("n_words"))
    share = (F.size(words(F.col("license"))) + 3) / F.col("n_words")
    return rows.where("license <> ''").select("scan_row", "license", F.lit(1.0).alias("cosine"), share.alias("share"))


def _scored(files: DataFrame, text: str) -> DataFrame:
    """The cosine of every window with its template."""
    weights = F.broadcast(idf(files, text))
    templates = _template_words(files).join(weights, "word").select("template", "license", "word", (F.col("tf") * F.col("idf")).alias("t"))
    size = templates.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_norm"))
    sizes = F.broadcast(templates.select("template", "license").distinct().join(size, "template"))
    templates = F.broadcast(templates.select("template", "word", "t"))  # a row for each word of each template
    keys = ["scan_row", "place", "template"]
    counted = _windows(files, text).select(*keys, "n_words", F.size("w").alias("n"), F.explode("w").alias("word"))
    counted = counted.groupBy(*keys, "n_words", "n", "word").agg(F.count("*").alias("tf")).join(weights, "word", "left").join(templates, ["template", "word"], "left")
    new = counted.join(F.broadcast(weights.select(F.max("idf_new").alias("most"))))  # one row
    part = F.col("tf") * F.coalesce("idf", "most")
    sums = new.groupBy(*keys, "n_words", "n").agg(F.sqrt(F.sum(part * part)).alias("norm"), F.sum(F.col("tf") * F.col("idf") * F.col("t")).alias("dot"))
    cosine = F.round(F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * F.col("t_norm")), 6)
    return sums.join(sizes, "template").withColumn("cosine", F.when((F.col("norm") > 0) & (F.col("t_norm") > 0), cosine).otherwise(0.0))


def _best(files: DataFrame, text: str, least: float) -> DataFrame:
    """scan_row, license, cosine and share (of the file's words) of each file's tag or best window."""
    scored = _scored(files, text).where(F.col("cosine") >= least)
    order = F.struct(F.col("license") == "Proprietary", -F.col("cosine"), "license", -F.col("n"), "place")
    best = scored.groupBy("scan_row").agg(F.min_by(F.struct("license", "cosine", (F.col("n") / F.col("n_words")).alias("share")), order).alias("b"))
    found = best.select("scan_row", "b.*", F.lit(1).alias("rank")).unionByName(_tagged(files, text).withColumn("rank", F.lit(0)))
    return found.groupBy("scan_row").agg(F.min_by(F.struct("license", "cosine", "share"), F.struct("rank", "license")).alias("b")).select("scan_row", "b.*")


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, with their depth; the root has depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))


@sheltered
def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", least: float = 0.7) -> DataFrame:
    """Files with own_license, cosine, license and inherited_from (the license file's path)."""
    added = ("own_license", "cosine", "license", "inherited_from", "scan_row", "scan_dir", "share")
    files = without(files, *added)
    clean = F.array_join(F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != ""), "/")
    keyed = files.withColumn("scan_row", F.xxhash64(path, text)).withColumn("scan_dir", parent(clean)).withColumn("scan_path", clean)
    distinct = keyed.select("scan_row", text)
    best = written(_best(distinct.where(F.col(text).isNotNull()), text, least), "licenses")
    rows = keyed.drop(text).select("scan_row", "scan_dir", "scan_path").join(best.dropDuplicates(["scan_row"]), "scan_row")
    name = F.lower(F.element_at(F.split("scan_path", "/"), -1))
    named = F.lit(False)
    for n in NAMES:
        named = named | name.startswith(n)
    order = F.struct(-F.col("cosine"), "scan_path")
    holders = rows.where(named | (F.col("share") >= 0.5)).groupBy("scan_dir").agg(F.min_by(F.struct("license", "scan_path"), order).alias("l"))
    directories = keyed.select("scan_dir").distinct().select("scan_dir", F.explode(ancestors(F.col("scan_dir"))).alias("a"))
    reached = directories.join(holders.withColumnRenamed("scan_dir", "above"), F.col("a.above") == F.col("above"))
    resolved = written(reached.groupBy("scan_dir").agg(F.max_by("l", "a.depth").alias("from_dir")), "license-dirs")
    if resolved.count() <= FEW:
        resolved = F.broadcast(resolved)
    out = keyed.join(best.select("scan_row", F.col("license").alias("own_license"), "cosine").dropDuplicates(["scan_row"]), "scan_row", "left").join(resolved, "scan_dir", "left")
    own = F.col("own_license").isNotNull()
    out = out.withColumn("license", F.coalesce("own_license", "from_dir.license"))
    return out.withColumn("inherited_from", F.when(~own, F.col("from_dir.scan_path"))).drop("scan_row", "scan_dir", "scan_path", "from_dir")
