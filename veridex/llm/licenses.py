"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Templates and documents are five-word shingles over words as in decontamination; a template of fewer
words is one shingle of all of them. For a template of m
shingles, windows of m + s - 1 shingles begin at every s-th, with s a quarter of m (1 at least), so each
place of the template lies whole in some window. A window and a template that share the containment c
have a Jaccard similarity of at least c*m / (m + s - 1 + (1 - c)*m), over 0.55 at c = 0.8; with ``bands``
of one value each they collide in one of 10 with probability over 1 - 0.45^10 = 0.9996.

A band of one value collides if the template's least shingle under that band's permutation is in the
window and no other of the window comes before it. So it is enough to look up those shingles, a few for
each template, and to take the minimum of just the windows around the places where one occurs: the same
collisions as from signatures of all windows, without computing those that cannot collide. Windows
that collide in any band are verified by the exact share of the template's shingles in them.

DataFrame and SQL functions only. Templates are broadcast; they are a list in the driver and bounded by
``MAX_TEMPLATE_WORDS``. A shingle is looked up by its longest word, so hashes are taken around such words
only; places where one stands carry the shingles around them, so the work is linear in a text's length. Only collisions and one
row per document are shuffled.

Defined results: null texts, and those shorter than a template, don't match it. A template without a
word is an error. Repeated rows and equal or null keys are judged row by row. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridex.llm.decontaminate import SHINGLE, _shingle, item_words_sql, places_sql
from veridex.llm.decontaminate import _shingles as shingles_sql

MAX_TEMPLATE_WORDS = 200_000

#: Notices by which public licenses are known.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "all-rights-reserved": "All rights reserved.",
}


def _hashes(k: int) -> str:
    return shingles_sql("w", k)


def template_bands(spark, templates: Mapping[str, str], bands: int) -> DataFrame:
    """(license, k, sh, m, step, width, salt, hash, spelled): each template's distinct shingles of k words, and
    its least one under each band's permutation, which is the 64-bit hash turned by a salt."""
    words = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    t = words.select("license", F.expr(item_words_sql("text")).alias("w")).withColumn("k", F.expr(f"least({SHINGLE}, size(w))"))
    per_k = " ".join(f"WHEN {k} THEN {_hashes(k)}" for k in range(1, SHINGLE))
    t = t.select("license", "k", "w", F.expr(f"CASE k {per_k} ELSE {_hashes(SHINGLE)} END").alias("every"), F.expr("size(w) - k + 1").alias("places")).withColumn("sh", F.array_distinct("every"))
    t = t.withColumn("m", F.size("sh")).withColumn("step", F.expr("greatest(1, cast(places div 4 AS int))")).withColumn("width", F.expr("places + step - 1"))
    t = t.withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands)))).withColumn("salt", F.xxhash64(F.lit("band"), "band"))
    return t.withColumn("hash", F.expr("array_min(transform(sh, x -> xxhash64(x, salt)))")).withColumn("hash", F.expr("filter(sh, x -> xxhash64(x, salt) = hash)[0]")).withColumn("spelled", F.expr("slice(w, cast(array_position(every, hash) AS int), k)"))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", containment_percent: int = 80, bands: int = 10) -> DataFrame:
    """One row per document: key and matches, an array of (license, containment, start, words): of each
    license found the window that holds most of it, the first of such, in words of the document."""
    if sum(len(t.split()) for t in templates.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates are too many to broadcast")
    spark = docs.sparkSession
    bands_of = template_bands(spark, templates, bands).collect()
    if len({r["license"] for r in bands_of if r["k"] > 0}) < len(templates):
        raise ValueError("a template has no word")
    # one row for each shingle looked up: which templates and bands have it as their least
    schema = "license string, k int, sh array<bigint>, m int, step int, width int, salt bigint, hash bigint"
    probe = spark.createDataFrame([tuple(r[c] for c in ("license", "k", "sh", "m", "step", "width", "salt", "hash")) for r in bands_of], schema)
    probe = probe.groupBy("license", "k", "sh", "m", "step", "width", "hash").agg(F.collect_list("salt").alias("salts")).select("license", F.col("k").alias("pk"), "sh", "m", "step", "width", F.col("hash").alias("ph"), "salts")
    none = spark.range(1).selectExpr("cast(null AS string) AS license", "0 AS pk", "cast(null AS array<bigint>) AS sh", "0 AS m", "1 AS step", "1 AS width", "0L AS ph", "cast(null AS array<bigint>) AS salts")
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), F.expr(item_words_sql(f"`{text}`")).alias("w"))
    # a place with the shingles of every window that may hold it
    own = "array(named_struct('k', 0, 'pos', -1, 'low', 0, 'hash', 0L, 'ctx', cast(array() AS array<bigint>)))"
    ks = sorted({r["k"] for r in bands_of})
    reach = {k: max(r["width"] + r["step"] for r in bands_of if r["k"] == k) for k in ks}
    places = places_sql({k: {(tuple(r["spelled"]), r["hash"]) for r in bands_of if r["k"] == k} for k in ks}, lambda x: (-len(x), x))
    around = "CASE x.k " + " ".join(f"WHEN {k} THEN transform(sequence(greatest(x.pos - {reach[k]}, 0), least(x.pos + {reach[k]}, size(w) - {k})), j -> {_shingle('w', 'j', k)})" for k in ks) + " END"
    low = "greatest(x.pos - CASE x.k " + " ".join(f"WHEN {k} THEN {reach[k]}" for k in ks) + " END, 0)"
    places = f"transform({places}, x -> named_struct('k', x.k, 'pos', x.pos, 'low', {low}, 'hash', x.hash, 'ctx', {around}))"
    at = d.select("rid", "key", F.expr("size(w)").alias("n"), F.expr(f"concat({own}, {places})").alias("places")).select("rid", "key", "n", F.expr("inline(places)"))
    met = at.join(F.broadcast(probe.unionByName(none)), (F.col("hash") == F.col("ph")) & (F.col("k") == F.col("pk")))
    # starts of the windows around the place, those where a band collides, and how much of the template each holds
    starts = "filter(transform(sequence(0, cast((width - 1) div step AS int)), j -> (cast(pos div step AS int) - j) * step), b -> b >= 0 AND b + width > pos)"
    least = "array_min(transform(slice(ctx, b - low + 1, width), x -> xxhash64(x, salt))) = xxhash64(hash, salt)"
    hits = f"""filter(transform(filter({starts}, b -> exists(salts, salt -> {least})),
        b -> named_struct('held', size(array_intersect(sh, slice(ctx, b - low + 1, width))), 'start', b)), x -> 100 * x.held >= {containment_percent} * m)"""
    met = met.select("rid", "key", "license", "m", "width", "k", "n", F.expr(f"if(k = 0, null, {hits})").alias("hits")).where("k = 0 OR size(hits) > 0")
    best = F.expr("aggregate(hits, cast(null AS struct<held: int, start: int>), (a, x) -> if(a IS NULL OR x.held > a.held OR (x.held = a.held AND x.start < a.start), x, a))")
    met = met.withColumn("best", best)
    one = met.groupBy("rid", "license").agg(F.first("key").alias("key"), F.max(F.expr("if(best IS NULL, null, struct(best.held AS held, -best.start AS back, m AS m, width AS width, n AS n, k AS k))")).alias("x"))
    found = F.expr("if(x IS NULL, null, named_struct('license', license, 'containment', x.held / cast(x.m AS double), 'start', -x.back, 'words', least(x.width + x.k - 1, x.n + x.back)))")
    g = one.groupBy("rid").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(found)).alias("matches"))
    return g.select(F.col("key").alias(key), "matches")
