"""License scans (operator 8), DataFrame functions only.

Documents are read in windows of twice a template's words that begin every half
of its words, so a run of up to one and a half times a template's length, as
inserted words stretch it, lies whole in one of them. Only windows are signed
that hold enough places at which some template of that size has the shingle: a
window that contains three quarters of a template holds as many. They get a
MinHash signature of BANDS bands. A template of which three quarters are in a
window of twice its length has a Jaccard similarity of 1/3 with it (1/6 for the
shortest); a band has two rows where that makes a miss less likely than MISS and
one row where it doesn't, so the bands miss at most that share. Retrieved
templates are verified by exact containment of their shingles in the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, words, written

SHINGLE = 5
CONTAINED = 0.75
#: Bands of a signature, and the largest probability that a template with CONTAINED of its shingles in a window meets it in none.
BANDS, MISS = 96, 1e-4

# Notices and bodies of well-known licences, as their publishers word them.
NOTICES = {
    "Apache-2.0-limits": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause-body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0-body": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC-body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "MIT-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-body": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-body": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "license string, text string")


def plain(text: Column) -> Column:
    """Lower case without punctuation at the ends of words."""
    return F.regexp_replace(F.lower(text), r"[.,;:!?|()\"'*]+(?=[\x20\x09-\x0D]|$)", "")


def rows_of_band(size: int, shingle: int, contained: float, bands: int) -> int:
    """Two rows if a template of so many words is then missed at most with probability MISS, else one."""
    t, w = max(1, size - shingle + 1), max(1, 2 * size - shingle + 1)
    jaccard = contained * t / (w + (1 - contained) * t)
    return 2 if (1 - jaccard**2) ** bands <= MISS else 1


def signature(h: Column, bands: int, rows: Column) -> Column:
    """For each band the smallest of one or two seeded hashes of the shingles."""

    def least(seed: Column) -> Column:
        return F.array_min(F.transform(h, lambda x: F.xxhash64(x, seed)))

    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda k: F.when(rows == 1, least(k)).otherwise(F.xxhash64(least(k), least(-k))))


def license_scan(docs: DataFrame, forms: DataFrame, contained: float = CONTAINED, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, license, containment, start) for each document and template with a window that contains it.

    ``docs`` has doc_id and text, ``forms`` license and text. The window with the
    highest containment is returned, the first of equal ones; start is its first
    word. Templates of fewer words than a shingle are sought as one run of that
    many words. Null and blank texts contain nothing. Rows that repeat doc_id
    and text give one result; doc_id may be null; other columns are ignored.
    """
    docs = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    form = forms.select("license", words(plain(F.col("text"))).alias("w")).where(F.size("w") > 0)
    form = form.select("license", F.size("w").alias("m"), F.least(F.size("w"), F.lit(shingle)).alias("g"), "w")
    # a template's runs of g words, g being the shingle size or all of a shorter template
    form = form.select("license", "m", "g", F.array_distinct(_runs("w", "g")).alias("t"))
    form = written(form, "forms")
    sizes = sorted({(r["g"], r["m"]) for r in form.select("g", "m").distinct().collect()})
    two = [m for g, m in sizes if rows_of_band(m, g, contained, bands) == 2]
    rows = F.when(F.col("m").isin(two), 2).otherwise(1)
    by_size = F.array(*(F.lit(g) for g in sorted({g for g, _ in sizes})))
    texts = docs.select("row", words(plain(F.col("text"))).alias("w"))
    each = texts.select("row", F.explode(F.transform(by_size, lambda g: F.struct(g.alias("g"), _runs("w", g).alias("h")))).alias("e"))
    places = each.select("row", F.col("e.g").alias("g"), F.posexplode("e.h").alias("p", "x"))
    # how many places a window has to hold at least, by size of a template
    least = form.groupBy("g", "m").agg(F.min(F.ceil(F.size("t") * contained - 1e-6)).alias("least"))
    known = form.select("g", "m", F.explode("t").alias("x")).distinct().join(small(least, len(sizes)), ["g", "m"])  # a row for each of a template's shingles
    hits = places.join(small(known, known.count()), ["g", "x"])
    step = F.greatest(F.floor(F.col("m") / 2), F.lit(1))
    j = F.sequence(F.greatest(F.ceil((F.col("p") + F.col("g") - 2 * F.col("m")) / step), F.lit(0)), F.floor(F.col("p") / step))
    asked = hits.select("row", "g", "m", "least", F.explode(j).alias("j")).groupBy("row", "g", "m", "least", "j").agg(F.count("*").alias("n"))
    asked = written(asked.where("n >= least").select("row", "g", "m", "j"), "windows")

    wanted = asked.select("row").distinct()
    chosen = docs.join(small(wanted, wanted.count()), "row", "left_semi").dropDuplicates(["row"]).select("row", "doc_id", words(plain(F.col("text"))).alias("w"))
    start = F.col("j") * step
    piece = F.slice("w", (start + 1).cast("int"), (F.col("m") * 2).cast("int"))
    cut = chosen.join(asked, "row").select("row", "doc_id", "g", "m", start.alias("start"), piece.alias("v"))
    cut = written(cut.select("row", "doc_id", "g", "m", "start", F.array_distinct(_runs("v", "g")).alias("h")).withColumn("window", F.xxhash64("h")), "cut")

    distinct = cut.groupBy("g", "m", "window").agg(F.first("h").alias("h"))
    a = distinct.select("g", "m", "window", F.posexplode(signature(F.col("h"), bands, rows)).alias("band", "value"))
    b = form.select("license", "g", "m", F.posexplode(signature(F.col("t"), bands, rows)).alias("band", "value"))
    pairs = a.join(b, ["g", "m", "band", "value"]).select("g", "m", "window", "license").distinct()
    share = F.size(F.array_intersect("h", "t")) / F.size("t")
    sized = pairs.join(distinct, ["g", "m", "window"]).join(form.select("license", "t"), "license").withColumn("containment", share)
    sure = sized.where(F.col("containment") >= contained).select("g", "m", "window", "license", "containment")
    found = cut.select("row", "doc_id", "g", "m", "start", "window").join(sure, ["g", "m", "window"])
    best = found.groupBy("row", "doc_id", "license").agg(F.min(F.struct((-F.col("containment")).alias("c"), "start")).alias("best"))
    return best.select("doc_id", "license", (-F.col("best.c")).alias("containment"), F.col("best.start").cast("long").alias("start"))


def _runs(w: str, g: Column | str) -> Column:
    """Hashes of all runs of g words of the array column w; none if it is shorter."""
    g = F.col(g) if isinstance(g, str) else g
    at = F.col(w)
    run = F.transform(at, lambda x, i: F.xxhash64(x, *(F.when(F.lit(k) < g, F.get(at, i + k)) for k in range(1, SHINGLE)), g))
    return F.when(F.size(at) >= g, F.slice(run, F.lit(1), F.greatest(F.size(at) - g + 1, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
