"""License scans: notices and licence files are held against templates, directories hand licences down; DataFrame functions only.

Units of a file with a cue word are its lines with one, its paragraphs of
several lines with one (lines without a letter or digit, as blank comment lines
are, part them), and the whole text. A unit and the templates, short notices,
file headers, titles and whole licences, are sparse TF-IDF vectors over words;
the best cosine at or above the threshold names the licence. A licence file is
one of which the whole text is a template's, or one that is named as such and
has a licence. A file without a notice takes the licence of the nearest
ancestor directory that holds a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm.common import stage_table

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def _gnu(name: str, version: str) -> str:
    """The header that the GNU licences ask for."""
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Notices, file headers, titles and whole licences by SPDX identifier, as they are commonly written (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _MIT[0]),
    ("MIT", " ".join(("The MIT License (MIT) Copyright (c)", *_MIT))),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", " ".join(("Copyright (c) All rights reserved.", *_BSD))),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", " ".join(("Copyright (c) All rights reserved.", *_BSD[:3], _BSD[4]))),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", _ISC),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
CUES = r"(?i)licen[cs]e|spdx|permission is hereby|permission to use|redistribution and use|copyright|public domain"
#: Between paragraphs: a line without a letter or digit.
PARTING = r"\n[^A-Za-z0-9\n]*\n"
#: Names of licence files.
NAMED = r"(?i)(^|/)((un)?licen[cs]e|copying)[^/]*$"
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


def _weight(n: int) -> Column:
    """Inverse document frequency over the templates; words of no template weigh most."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1.0


def _templates(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """(word, df) and (word, template, license, weight / norm), both of the templates' size."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, body string")
    words = rows.select("template", "license", F.explode(_words(F.col("body"))).alias("word"))
    df = words.groupBy("word").agg(F.countDistinct("template").alias("df"))
    tf = words.groupBy("template", "license", "word").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(df), "word")
    weighted = tf.withColumn("w", F.col("tf") * _weight(len(templates)))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return df, weighted.join(F.broadcast(norms), "template").select("word", "template", "license", (F.col("w") / F.col("norm")).alias("share"))


def match_units(units: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """(unit columns, ``license``, ``score``): the best template of each unit of (file, unit, body), if it reaches ``threshold``.

    The templates are broadcast; their number is fixed by the parameter. Of
    equal scores (to nine places) the first licence in alphabetical order counts.
    """
    spark = units.sparkSession
    df, shares = _templates(spark, templates)
    tf = units.select("file", "unit", F.explode(_words(F.col("body"))).alias("word")).groupBy("file", "unit", "word").agg(F.count(F.lit(1)).alias("tf"))
    weighted = tf.join(F.broadcast(df), "word", "left").withColumn("w", F.col("tf") * _weight(len(templates)))
    # one row a word and template, and one a word for the norm, so words are counted once; partial sums before the shuffle
    every = F.array(F.struct(F.lit(None).cast("int").alias("template"), F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("share")))
    each = weighted.join(F.broadcast(shares.groupBy("word").agg(F.collect_list(F.struct("template", "license", "share")).alias("in"))), "word", "left")
    rows = each.select("file", "unit", "w", F.explode(F.concat(every, F.coalesce("in", F.slice(every, 1, 0)))).alias("t"))
    sums = rows.groupBy("file", "unit", "t.template", "t.license").agg(F.sum(F.col("w") * F.col("t")["share"]).alias("dot"), F.sum(F.when(F.col("t")["template"].isNull(), F.col("w") * F.col("w"))).alias("square"))
    norms = sums.where("template IS NULL").select("file", "unit", F.sqrt("square").alias("norm"))
    scored = sums.where("template IS NOT NULL").join(norms, ["file", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")
    return scored.groupBy("file", "unit").agg(best).select("file", "unit", F.col("best")["license"].alias("license"), (-F.col("best")["s"]).alias("score"))


def license_scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.75, cues: str = CUES) -> DataFrame:
    """One row for each file: ``doc_id``, ``path``, ``own_license``, ``own_score``, ``is_license_file``, ``license`` and ``inherited_from``.

    Whole texts are scanned. Null and empty texts have no licence of their own;
    a null path has no directory and inherits nothing. A directory's licence
    file is the one with the best score, of equal ones that with the smallest
    path; that of the empty directory, the top, is handed to all. Rows that
    repeat an id share its result. An empty table gives an empty result; other
    columns are dropped.
    """
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    with_cue = rows.where(F.col("doc_id").isNotNull() & F.col("text").rlike(cues)).select(F.col("doc_id").alias("file"), "path", "text")
    numbered = lambda parts, number: F.transform(parts, lambda x, i: F.struct(number(i).alias("unit"), x.alias("body")))
    lines = F.filter(numbered(F.split("text", "\n", -1), lambda i: i), lambda u: u["body"].rlike(cues))
    paragraphs = F.filter(numbered(F.split("text", PARTING, -1), lambda i: -2 - i), lambda u: u["body"].rlike(cues) & u["body"].contains("\n"))
    whole = F.array(F.struct(F.lit(-1).alias("unit"), F.col("text").alias("body")))
    units = with_cue.select("file", F.explode(F.concat(whole, lines, paragraphs)).alias("u")).select("file", "u.unit", "u.body")
    found = match_units(units.distinct(), templates=templates, threshold=threshold)
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")
    own = found.groupBy("file").agg(best, F.max((F.col("unit") == -1).cast("int")).alias("whole"))
    own = stage_table(own.select(F.col("file").alias("doc_id"), F.col("best")["license"].alias("own_license"), (-F.col("best")["s"]).alias("own_score"), (F.col("whole") == 1).alias("whole")), "licences")
    named = F.coalesce(F.col("path").rlike(NAMED), F.lit(False))
    labelled = rows.select("doc_id", "path").join(own, "doc_id", "left").withColumn("is_license_file", F.col("own_license").isNotNull() & (F.coalesce("whole", F.lit(False)) | named))
    # directories with a licence file; grouped by one key more than they are joined by, so a hot directory can be split
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    keeps = labelled.where("is_license_file AND path IS NOT NULL").groupBy(parent.alias("dir"), F.pmod(F.xxhash64(parent), F.lit(2)).alias("h")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own_license").alias("handed"))).alias("k"))
    keeps = stage_table(keeps.select("dir", F.col("k")["handed"].alias("handed")), "directories")
    top = keeps.where("dir = ''").select("handed").first()
    bare = labelled.where("own_license IS NULL AND path IS NOT NULL").select("doc_id", "path").distinct().select("doc_id", "path", F.split(parent, "/", -1).alias("parts"))
    above = bare.select("doc_id", "path", F.explode(F.transform("parts", lambda x, i: F.struct((i + 1).alias("depth"), F.array_join(F.slice("parts", F.lit(1), i + 1), "/").alias("dir")))).alias("a")).select("doc_id", "path", F.col("a")["depth"].alias("depth"), F.col("a")["dir"].alias("dir"))
    nearest = above.where("dir <> ''").join(keeps, "dir").groupBy("doc_id", "path").agg(F.max(F.struct("depth", "dir", "handed")).alias("n")).select("doc_id", "path", F.col("n")["handed"].alias("handed"), F.col("n")["dir"].alias("inherited_from"))
    out = labelled.join(nearest, ["doc_id", "path"], "left")
    # the top is above every path: one value, not a key that all files share
    of_top = F.lit(None if top is None else top["handed"]).cast("string")
    by_top = F.col("own_license").isNull() & F.col("handed").isNull() & F.col("path").isNotNull() & of_top.isNotNull()
    return out.select("doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "is_license_file", F.coalesce("own_license", "handed", F.when(by_top, of_top)).alias("license"), F.when(by_top, F.lit("")).otherwise(F.col("inherited_from")).alias("inherited_from"))
