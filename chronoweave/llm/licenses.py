"""License scan: sparse TF-IDF cosine of headers and license files to templates, then inheritance from the nearest
ancestor directory that holds a license file."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.kernels import materialize
from chronoweave.llm.common import bounded_batches, fresh_name, query, table, whole_text, without

#: (license, notice): opening sentences and usual short notices of public licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("All-Rights-Reserved", "All rights reserved."),
    ("All-Rights-Reserved", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
)
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: (license, whole text) of the short licenses.
WHOLE = (
    ("MIT", f"""MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_3} {_BSD_END}"),
    ("ISC", """ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law. {_WARRANTY} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to"""),
)
#: (license, title) that the whole text of a long license begins with.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)
TEMPLATES += WHOLE
SPDX = {"mit": "MIT", "apache-2.0": "Apache-2.0", "isc": "ISC", "unlicense": "Unlicense", "mpl-2.0": "MPL-2.0", "cc0-1.0": "CC0-1.0", "epl-2.0": "EPL-2.0"}
TRIGGER = r"(?i)licen[cs]e|copyright|spdx-|permission is hereby|redistribut|all rights reserved|creative commons|public domain|mozilla public"
HEADER_COSINE, FILE_COSINE = 0.75, 0.9
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"

_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)")
_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_TRIGGER = re.compile(TRIGGER)
_COMMENT = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+|--+|;+|<!--|%+|\"\"\")\s?|\s*(?:\*/|-->)\s*$")


def terms(text: str) -> Counter:
    found = _TERM.findall(text.lower())
    return Counter(found + [f"{x} {y}" for x, y in zip(found, found[1:])])


@lru_cache(maxsize=1)
def index():
    """(idf, postings): term to [(template, weight)], weights of a template have norm 1. idf over the templates."""
    counts = [terms(t) for _, t in TEMPLATES]
    df = Counter(term for c in counts for term in c)
    idf = {term: math.log((1 + len(counts)) / (1 + n)) + 1 for term, n in df.items()}
    postings = defaultdict(list)
    for k, c in enumerate(counts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        for t, n in c.items():
            postings[t].append((k, n * idf[t] / norm))
    return idf, dict(postings), math.log(1 + len(counts)) + 1


def cosine(text: str) -> tuple[str | None, float]:
    """The most similar license; equal ones go to the first template."""
    idf, postings, unseen = index()
    score, norm = [0.0] * len(TEMPLATES), 0.0
    for term, n in terms(text).items():
        w = n * idf.get(term, unseen)
        norm += w * w
        for k, v in postings.get(term, ()):
            score[k] += w * v
    best = max(range(len(score)), key=lambda k: (score[k], -k))
    return (TEMPLATES[best][0], score[best] / math.sqrt(norm)) if norm and score[best] > 0 else (None, 0.0)


def notices(text: str):
    """Pieces that may be a header: lines, sentences and runs of neighbouring lines with a telling word."""
    lines = [_COMMENT.sub("", line).strip() for line in text.split("\n")]
    hits = [i for i, line in enumerate(lines) if _TRIGGER.search(line)]
    for i in hits:
        yield lines[i]
        parts = _SENTENCE.split(lines[i])
        if len(parts) > 1:
            yield from (p for p in parts if _TRIGGER.search(p))
        # a header wrapped over short lines
        if len(lines[i]) < 200:
            lo, hi = i, i + 1
            while lo > 0 and i - lo < 4 and lines[lo - 1] and len(lines[lo - 1]) < 200:
                lo -= 1
                yield " ".join(lines[lo:hi])
            while hi < len(lines) and hi - i < 8 and lines[hi] and len(lines[hi]) < 200:
                hi += 1
                yield " ".join(lines[i:hi])


@lru_cache(maxsize=1)
def openings():
    """First three words of a template to the lengths, in words, of the templates that open so."""
    out = defaultdict(set)
    for _, t in TEMPLATES:
        found = _TERM.findall(t.lower())
        out[tuple(found[:3])].add(len(found))
    return {k: sorted(v) for k, v in out.items()}


def opened(found: list[str]):
    """Stretches of the text's words that open like a template, as long as it: however the lines are wrapped."""
    lengths = openings()
    for i in range(len(found) - 2):
        for n in lengths.get((found[i], found[i + 1], found[i + 2]), ()):
            yield " ".join(found[i : i + n])


def declared(text: str) -> tuple[str | None, float, bool]:
    """(license, cosine, whether the whole text is one) of a text of any length; an SPDX tag decides at once.

    A text that holds a clause of its own of the BSD-3 license is that, whatever else of the BSD licenses it holds.
    """
    found = _TERM.findall(text.lower())
    scores: dict[str, float] = {}
    name, score = cosine(text)
    whole = score >= FILE_COSINE
    if whole:
        scores[name] = score
    for name, title in TITLES:
        opening = _TERM.findall(title.lower())
        if found[: len(opening)] == opening:
            return name, 1.0, True
    if not whole and (tag := _SPDX.search(text)):
        return SPDX.get(tag[1].lower(), tag[1]), 1.0, False
    pieces = dict.fromkeys(opened(found) if whole else [*notices(text), *opened(found)])
    for piece in pieces:
        name, s = cosine(piece)
        if s >= HEADER_COSINE and s > scores.get(name, 0.0) and (not whole or name == "BSD-3-Clause"):
            scores[name] = s
    if not scores:
        return None, 0.0, False
    best = "BSD-3-Clause" if "BSD-3-Clause" in scores and max(scores, key=scores.get) == "BSD-2-Clause" else max(scores, key=scores.get)
    return best, scores[best] if not whole else score, whole


RESULTS = ["license", "license_score", "license_from", "license_directory"]


def parent(path: Column) -> Column:
    """Directory of a path; the root is the empty text."""
    return F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"(^|/)[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and those above it, nearest first."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(df: DataFrame, path: str = "path", text: str = "text", max_directories: int = 1_000_000) -> DataFrame:
    """`df` with `license`, `license_score` and `license_from` (file, header, inherited or none).

    A row is a license file by its name or when its whole text resembles a template. A row without a notice of its own
    takes the license of the nearest ancestor directory with a license file; of several files in one directory the best
    score counts, then the first license by name. Null and empty texts have no notice, a null path inherits nothing.
    Repeated rows are rows of their own. Columns named like the results are replaced.
    """
    return inherited(with_declared(df, path, text), max_directories)


def with_declared(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """`df` with `license`, `license_score`, `license_from` (file, header or none) of each text, and `license_directory`."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("whole", T.BooleanType())])

    @F.pandas_udf(schema)
    def own(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([declared(t) if t and _TRIGGER.search(t) else (None, 0.0, False) for t in texts], columns=["name", "score", "whole"])

    kept, got = without(df, RESULTS), fresh_name(df, "own")
    given = df.select(*[F.col(f"`{c}`") for c in kept.columns], own.asNondeterministic()(whole_text(text)).alias(got))
    file_name = F.rlike(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"([^/]*)$", 1), F.lit(FILE_NAME))
    name = F.col(f"{got}.name")
    is_file = name.isNotNull() & (F.col(f"{got}.whole") | file_name) & F.col(path).isNotNull()
    directory = F.array_join(F.filter(F.split(parent(F.col(path)), "/"), lambda p: p != ""), "/")
    results = (name, F.col(f"{got}.score"), F.when(is_file, "file").when(name.isNotNull(), "header").otherwise("none"), directory)
    return given.select(*[F.col(f"`{c}`") for c in kept.columns], *[c.alias(n) for c, n in zip(results, RESULTS)])


def inherited(df: DataFrame, max_directories: int = 1_000_000) -> DataFrame:
    """What with_declared() gave, rows without a notice filled from the nearest ancestor directory with a license file."""
    near_column = fresh_name(df, "near")
    file = F.col("license_from") == "file"
    light = materialize(df.select("license_directory", file.alias("file"), F.col("license").alias("name"), F.col("license_score").alias("score")).groupBy("license_directory").agg(
        F.max("file").alias("has"), F.min(F.when(F.col("file"), F.struct((-F.col("score")).alias("order"), "name", "score"))).alias("best")))
    holders = light.where("has").select(F.col("license_directory").alias("up"), "best")
    near = light.where(F.col("license_directory").isNotNull()).select("license_directory", F.posexplode(ancestors(F.col("license_directory"))).alias("steps", "up")).join(holders, "up")
    near = materialize(near.groupBy("license_directory").agg(F.min_by("best", "steps").alias(near_column)))
    if near.count() <= max_directories:
        near = F.broadcast(near)
    done = df.join(near, "license_directory", "left")
    mine, theirs = F.col("license").isNotNull(), F.col(near_column)
    filled = {
        "license": F.coalesce("license", theirs["name"]),
        "license_score": F.round(F.when(mine, F.col("license_score")).otherwise(F.coalesce(theirs["score"], F.lit(0.0))), 6),
        "license_from": F.when(mine, F.col("license_from")).when(theirs.isNotNull(), "inherited").otherwise("none"),
    }
    return done.select(*[F.col(f"`{c}`") for c in df.columns if c not in RESULTS], *[c.alias(n) for n, c in filled.items()])


@query()
def op8_license_scan(spark, sf_dir):
    """Documents have no path of their own: source and language stand for the directories."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string")).alias("path"))
    # the texts are read once; what is inherited needs their results only
    light = materialize(with_declared(docs).drop("text"))
    return inherited(light).select("doc_id", "path", "license", "license_score", "license_from")
