"""License scans: TF-IDF cosine to templates, and inheritance by directories (operator 5, DataFrame functions only).

Units are the sentences of a text's lines, wherever they stand, and the whole text.
A unit's terms are weighed by how rare they are among all documents; terms outside
every template count as if no document had them, so foreign words lower a likeness. A
sentence whose cosine to a template's sentence reaches 0.6 names that license, and so
does a whole text whose cosine to a license's own text does; of a whole text every
term counts once, however often it is repeated. What a whole text is outranks what its sentences name: a
license's text may name other licenses and versions, and those that share most of their
words are told apart by the others.

Only units with a telling term are looked at: of each template its heaviest terms,
as many as it takes for the rest of it to be below a cosine of 0.6 to any unit
(without terms that hold a share q of a template's squared norm no unit gets above the
root of 1 - q). A whole text is looked at if it holds as many terms of a license's text
as the heaviest ones take to have 0.36 of that squared norm, and as 0.36 of its own
terms outside all templates, of which each weighs most. So no likeness is lost, however common a term is.

A document that is at least half license text is a licence file and speaks for its
directory. Documents without a license of their own take that of the nearest
directory above them that has a licence file: directories are joined to the
directories they lie in, then documents to their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

LEAST, FILE_SHARE = 0.6, 0.5
UNITS = r"\n|(?<=[.!?])\s+"
TERMS = r"[^a-z0-9]+"

# License identifiers and sentences by which texts name them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "either version 3 of the License, or (at your option) any later version"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "either version 2 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# Whole texts of short licenses; those of long ones are files of the folder license_texts, named by their license.
SHORT_TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.""",
}
WHOLE = -1  #: the unit that is a whole text


def read_texts(folder: str | Path = Path(__file__).with_name("license_texts")) -> dict[str, str]:
    """License texts by name, from the files NAME.txt of a folder of the driver."""
    return {p.stem: p.read_text() for p in sorted(Path(folder).glob("*.txt"))}


TEXTS = SHORT_TEXTS | read_texts()


def _terms(text: str) -> list[str]:
    return [t for t in re.split(TERMS, text.lower()) if t]


def _split(column):
    return F.filter(F.split(F.lower(column), TERMS), lambda t: t != "")


def _array(values):
    return F.array(*map(F.lit, values))


def term_counts(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents in all, and those that contain each term of the templates' vocabulary (a bounded number)."""
    hits = docs.select(F.array_intersect(_split(store.whole_text(docs, text)), _array(vocabulary)).alias("hits"))
    rows = hits.select(F.explode(F.concat(F.col("hits"), F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()
    counts = {r.term: r["count"] for r in rows}
    return counts.pop("", 0), counts


def _weights(total: int, counts: dict[str, int], vocabulary: list[str]) -> tuple[dict[str, float], float]:
    rarity = lambda n: math.log((total + 1) / (n + 1)) + 1
    return {t: rarity(counts.get(t, 0)) for t in vocabulary}, rarity(0)


def _telling(weights: dict[str, float]) -> set[str]:
    """The fewest heaviest terms of a template without which no unit's cosine to it reaches LEAST."""
    total, missing, out = sum(w * w for w in weights.values()), 0.0, set()
    for t in sorted(weights, key=lambda t: (-weights[t], t)):
        if missing > (1 - LEAST**2 + 1e-6) * total:
            break
        missing += weights[t] ** 2
        out.add(t)
    return out


def _fewest(weights: dict[str, float]) -> int:
    """How many terms of a license's text a text has to hold at least for a cosine of LEAST."""
    total, held, n = sum(w * w for w in weights.values()), 0.0, 0
    for w in sorted(weights.values(), reverse=True):
        if held >= (LEAST**2 - 1e-6) * total:
            break
        held += w * w
        n += 1
    return n


def own_licenses(
    docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "path", templates: dict[str, list[str]] = TEMPLATES, texts: dict[str, str] = TEXTS
) -> DataFrame:
    """(rid, key, path, license, similarity, n_units, share) of every row: the license whose text it is, else the best of its sentences', null if there is none.

    Null texts count as empty. n_units counts license units, share is their part of
    the text's code points, 1 if the whole text is one. Rows are told apart by rid; other
    columns are not read.
    """
    spark = docs.sparkSession
    known = [(name, s, False) for name, all_ in templates.items() for s in all_] + [(name, s, True) for name, s in texts.items()]
    sentences = [(i, name, _terms(s), whole) for i, (name, s, whole) in enumerate(known)]
    vocabulary = sorted({t for _, _, terms, _ in sentences for t in terms})
    total, counts = term_counts(docs, text, vocabulary)
    rarity, unknown = _weights(total, counts, vocabulary)

    entries, telling, enough = [], set(), F.lit(False)
    for i, name, terms, whole in sentences:
        weights = {t: (1 if whole else n) * rarity[t] for t, n in Counter(terms).items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        entries += [(t, i, name, whole, w * rarity[t] / norm) for t, w in weights.items()]
        if whole:
            held = F.size(F.array_intersect("hits", _array(sorted(weights))))
            enough |= (held >= _fewest(weights)) & (held >= (LEAST**2 - 1e-6) * F.col("foreign"))
        else:
            telling |= _telling(weights)
    table = spark.createDataFrame(entries, "term string, template int, license string, whole boolean, part double")
    idf = spark.createDataFrame(list(rarity.items()), "term string, idf double")

    telling = _array(sorted(telling))
    value = store.whole_text(docs, text)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.col(path).alias("path"), value.alias("text"))
    rows = rows.withColumn("terms", F.array_distinct(_split(F.col("text")))).withColumn("hits", F.array_intersect("terms", _array(vocabulary)))
    rows = rows.withColumn("foreign", F.size("terms") - F.size("hits"))
    found = F.filter(F.split(F.col("text"), UNITS), lambda u: F.arrays_overlap(_split(u), telling))
    units = F.when(F.arrays_overlap("hits", telling), found).otherwise(F.array().cast("array<string>"))
    rows = rows.select("rid", "key", "path", F.char_length("text").alias("n"), units.alias("units"), F.when(enough, F.col("text")).alias("whole"))
    rows = store.materialize(rows, "license-units")

    units = rows.select("rid", F.posexplode("units").alias("unit", "text")).unionByName(rows.filter("whole is not null").select("rid", F.lit(WHOLE).alias("unit"), F.col("whole").alias("text")))
    terms = units.select("rid", "unit", F.explode(_split(F.col("text"))).alias("term")).groupBy("rid", "unit", "term").agg(F.count("*").alias("tf"))
    times = F.when(F.col("unit") == WHOLE, 1.0).otherwise(F.col("tf").cast("double"))
    terms = store.materialize(terms.withColumn("tf", times), "license-terms")
    weight = F.col("tf") * F.coalesce("idf", F.lit(unknown))
    norms = terms.join(F.broadcast(idf), "term", "left").groupBy("rid", "unit").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    met = terms.join(F.broadcast(table), "term").filter((F.col("unit") == WHOLE) == F.col("whole"))
    dots = met.groupBy("rid", "unit", "template", "license").agg(F.sum(F.col("tf") * F.col("part")).alias("dot"))
    near = dots.join(norms, ["rid", "unit"]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("similarity") >= LEAST)
    best = F.max(F.struct("similarity", (-F.col("template")).alias("order"), "license")).alias("best")
    lengths = units.select("rid", "unit", F.char_length("text").alias("chars"))
    by_unit = near.groupBy("rid", "unit").agg(best).join(lengths, ["rid", "unit"])
    by_unit = by_unit.withColumn("best", F.struct((F.col("unit") == WHOLE).alias("whole"), "best.*"))
    by_row = by_unit.groupBy("rid").agg(F.max("best").alias("best"), F.count("*").alias("n_units"), F.sum("chars").alias("chars"))
    return rows.drop("units", "whole").join(by_row, "rid", "left").select(
        "rid", "key", "path", F.col("best.license").alias("license"), F.col("best.similarity").alias("similarity"),
        F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"), F.coalesce(F.least(F.col("chars") / F.greatest("n", F.lit(1)), F.lit(1.0)), F.lit(0.0)).alias("share"),
    )


def directory(path):
    """What lies before the last slash; empty for a path without one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _ancestors(path):
    """A directory and those above it, nearest last, from the root on (the empty path)."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), up))


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = "path", templates: dict[str, list[str]] = TEMPLATES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """One row per row of docs: key, license, similarity, origin (own, inherited or none), from_directory, n_units.

    Of several licence files of a directory the one with the highest similarity
    speaks, then the one with the least license name. Rows without a path inherit nothing.
    """
    rows = store.materialize(own_licenses(docs, text, key, path, templates, texts).withColumn("dir", directory(F.col("path"))), "licenses")
    files = rows.filter((F.col("share") >= FILE_SHARE) & F.col("license").isNotNull() & F.col("dir").isNotNull())
    w = Window.partitionBy("from_directory").orderBy(F.desc("_s"), "_license")
    speaking = files.groupBy(F.col("dir").alias("from_directory"), F.col("license").alias("_license")).agg(F.max("similarity").alias("_s"))
    speaking = speaking.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_s")
    dirs = rows.filter("dir is not null").select("dir").distinct().select("dir", F.posexplode(_ancestors(F.col("dir"))).alias("depth", "from_directory"))
    nearest = dirs.join(speaking, "from_directory").groupBy("dir").agg(F.max(F.struct("depth", "from_directory", "_license")).alias("up"))
    nearest = store.materialize(nearest, "inherited")
    own = F.col("license").isNotNull()
    return rows.join(nearest, "dir", "left").select(
        F.col("key").alias(key), F.coalesce("license", "up._license").alias("license"), "similarity",
        F.when(own, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("up.from_directory")).alias("from_directory"), "n_units",
    )


def op5_license_scan(spark, sf_dir):
    """documents has no paths; they are made from source and id: source/thousands/hundreds/id."""
    docs = store.documents(spark, sf_dir, "doc_id", "text", "source")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("doc_id div 1000"), F.expr("doc_id div 100 % 10"), "doc_id")
    return license_scan(docs.withColumn("path", path))
