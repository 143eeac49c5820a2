"""License scans by MinHash bands over overlapping text windows (native).

Texts and templates are shingled into five words. A template is cut into chunks of 2 to the power s shingles, the
largest power that it holds and at most ``CHUNK``, the last one ending where the template ends. On each scale s the
windows of a text are twice as long as the chunks and overlap by half, so that a chunk lies whole in one of them. The
signature of a window or chunk is, for each of ``BANDS`` hash functions, the least hash of its shingles; a band is
``ROWS`` of them. With ROWS = 1 a chunk and a window of Jaccard similarity j share a band with probability
1 - (1 - j)^BANDS: more than 0.9999 for a chunk that is there whole (j = 1/2), and 0.999 for one that has lost a third
of its shingles (j = 1/4), where a notice as a whole, with CONTAINED = 0.8, loses a fifth.

Signatures are built by doubling: the least hashes of a block of 2^(s + 1) shingles are those of its two halves. Long
texts are taken in overlapping segments, so that no array grows with a text. Bands that agree name a template and a
window; near it the shingles, as words and not as hashes, are compared with the template's: the template is found
where at least ``CONTAINED`` of them are there.

Only texts with an anchor word go so far: a template's anchors are in so many of its shingles that a text without them
has too few of the template's shingles. The bands of the templates are joined to those of the texts; they are
broadcast where there are at most ``SMALL``, as of the table here. Then the only shuffle is of the windows found.

A template of fewer than five words has no shingle: it is found wherever a text has just these words in a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.llm.scratch import saved
from basaltine.llm.words import where_computed, whole

SHINGLE, CHUNK, ROWS, BANDS, CONTAINED = 5, 32, 1, 24, 0.8
#: Band keys of templates up to which their tables are broadcast; beyond it both sides of the joins are shuffled.
SMALL = 500_000
#: Words of a text that are searched together, beside what they overlap by.
SEGMENT = 2048
#: Words for this scan: letters and digits, with inner dots, hyphens and apostrophes.
TOKEN = r"[\p{L}\p{N}]+(?:[.'-][\p{L}\p{N}]+)*"
#: The notices that public licenses ask for, whole short licenses, and the bare line of works under none.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
    "all-rights-reserved-line": "All rights reserved.",
    "mit-license": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-license": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def shingles(words: Column, as_hash: bool = True) -> Column:
    """The hashes of all runs of five words, or the runs themselves."""
    make = F.xxhash64 if as_hash else (lambda *w: F.concat_ws(" ", *w))
    each = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: make(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>" if as_hash else "array<string>"))


def collision(similarity: float, rows: int = ROWS, bands: int = BANDS) -> float:
    """The probability that two sets of a Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def _hashed(hashes: Column) -> Column:
    """Of each shingle, its value under every hash function."""
    return F.transform(hashes, lambda h: F.array(*[F.xxhash64(h, F.lit(j)) for j in range(ROWS * BANDS)]))


def _least(a: Column, b: Column) -> Column:
    return F.zip_with(a, F.coalesce(b, a), lambda x, y: F.least(x, y))


def _doubled(blocks: Column):
    return lambda i: _least(F.get(blocks, 2 * i), F.get(blocks, 2 * i + 1))


def _bands(signature: Column, scale: int) -> Column:
    """The keys of a signature's bands on a scale."""
    return F.array(*[F.xxhash64(F.lit(scale), F.lit(k), *[F.get(signature, k * ROWS + r) for r in range(ROWS)]) for k in range(BANDS)])


def template_chunks(words: list[str]) -> list[tuple[int, int]]:
    """(scale, first shingle) of a template's chunks."""
    m = len(words) - SHINGLE + 1
    scale = min(m, CHUNK).bit_length() - 1
    size = 1 << scale
    return [(scale, at) for at in sorted({*range(0, m - size + 1, size), m - size})]


def template_bands(spark: SparkSession, words: dict[str, list[str]]) -> DataFrame:
    """key, license: the bands of the templates' chunks, each once."""
    rows = [(name, scale, w[at : at + (1 << scale) + SHINGLE - 1]) for name, w in words.items() for scale, at in template_chunks(w)]
    chunks = spark.createDataFrame(rows, "license string, scale int, w array<string>")
    least = F.aggregate(_hashed(shingles(F.col("w"))), F.lit(None).cast("array<bigint>"), lambda a, x: _least(x, a))
    signed = chunks.select("license", "scale", least.alias("s"))
    keys = F.coalesce(*[F.when(F.col("scale") == k, _bands(F.col("s"), k)) for k in range(CHUNK.bit_length())])
    return signed.select(F.explode(keys).alias("key"), "license").distinct()


def window_bands(segments: DataFrame, scales: list[int]) -> DataFrame:
    """segments (row, start, w) to row, start, first, size, key: the bands of every window, by its first shingle.

    The windows of a scale are pairs of neighbouring blocks; blocks of the next scale are pairs of them, too.
    """
    levels = segments.select("row", "start", _hashed(shingles(F.col("w"))).alias("b0"))
    for k in range(max(scales)):
        b = F.col(f"b{k}")
        halves = F.sequence(F.lit(0), F.floor((F.size(b) - 1) / 2).cast("int"))
        doubled = F.when(F.size(b) > 0, F.transform(halves, _doubled(b))).otherwise(F.array().cast("array<array<bigint>>"))
        levels = levels.select("*", doubled.alias(f"b{k + 1}"))

    def windows(k: int) -> Column:
        b = F.col(f"b{k}")
        return F.transform(b, lambda x, i: F.struct((i * (1 << k)).alias("first"), F.lit(2 << k).alias("size"), _bands(_least(x, F.get(b, i + 1)), k).alias("keys")))

    every = levels.select("row", "start", F.explode(F.concat(*[windows(k) for k in scales])).alias("x")).select("row", "start", "x.*")
    return every.select("row", "start", "first", "size", F.explode("keys").alias("key"))


def anchors(words: dict[str, list[str]], contained: float = CONTAINED) -> list[str]:
    """Words of which a text has one if it has ``contained`` of some template's shingles (or a shorter template).

    Such a text lacks at most 1 - contained of the shingles, so it has one of any set of more. The template's words are
    taken by length, as longer words are rarer, until they are in more shingles than a text may lack.
    """
    chosen: set[str] = set()
    for w in words.values():
        left = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}
        lacks = len(left) * (1 - contained) + 1e-9
        total = len(left)
        for word in sorted(set(w), key=lambda x: (-len(x), x)):
            if total - len(left) > lacks or not left:
                break
            chosen.add(word)
            left = {s for s in left if word not in s}
    return sorted(chosen)


def short_places(words: Column, notice: list[str]) -> Column:
    """Where a text has all words of a short template in a row."""
    here = F.sequence(F.lit(0), F.size(words) - len(notice))

    def same(i: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.get(words, i + k) == w for k, w in enumerate(notice)])

    return F.when(F.size(words) >= len(notice), F.filter(here, same)).otherwise(F.array().cast("array<int>"))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """One row per document and template found in it: doc_id, license, containment, first_word, places.

    ``containment`` is the largest share of the template's shingles at one place, ``first_word`` the first word of the
    first place and ``places`` how many there are. Null and empty texts and those shorter than every template give no
    rows, nor does an empty table; repeated rows give their rows each. Other columns are not read. A template has at
    least one word, else ValueError; one of fewer than five is found only as a whole, with containment 1.
    """
    spark = docs.sparkSession
    named = spark.createDataFrame(list(templates.items()), "license string, notice string")
    words = {r["license"]: r["w"] for r in named.select("license", tokens(F.col("notice")).alias("w")).collect()}  # the table of templates
    if not all(words.values()):
        raise ValueError("a template has no words")
    segments = saved(text_segments(docs, words, contained, doc_id, text))
    short = {k: w for k, w in words.items() if len(w) < SHINGLE}
    long = {k: w for k, w in words.items() if len(w) >= SHINGLE}
    found = ([long_places(segments, long, contained)] if long else []) + ([short_found(segments, short)] if short else [])
    places = reduce(DataFrame.unionByName, found)
    # a place in the overlap of two segments is found twice
    return places.groupBy("row", "doc_id", "license").agg(
        F.max("share").alias("containment"), F.min("first").alias("first_word"), F.countDistinct("first").alias("places")
    ).drop("row")


def _slack(shingles_: int) -> int:
    return max(2, shingles_ // 4)


def text_segments(docs: DataFrame, words: dict[str, list[str]], contained: float = CONTAINED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, start, w: the words of the texts that have an anchor, in segments that overlap.

    Wherever a template may be found, that place and the slack around it lie in one segment.
    """
    longest = max(map(len, words.values()))
    overlap = longest + 2 * _slack(longest) + SHINGLE
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), tokens(whole(text)).alias("w"))
    some = where_computed(base, F.arrays_overlap("w", F.array(*map(F.lit, anchors(words, contained)))))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(SEGMENT))
    parts = F.transform(starts, lambda at: F.struct(at.cast("long").alias("start"), F.slice("w", at + 1, F.lit(SEGMENT + overlap)).alias("w")))
    return some.select("row", "doc_id", F.explode(parts).alias("x")).select("row", "doc_id", "x.*")


def short_found(segments: DataFrame, short: dict[str, list[str]]) -> DataFrame:
    """row, doc_id, license, share, first: where the segments have the words of short templates."""
    each = F.array(*[F.struct(F.lit(k).alias("license"), short_places(F.col("w"), w).alias("at")) for k, w in short.items()])
    spots = segments.select("row", "doc_id", "start", F.explode(each).alias("x")).select("row", "doc_id", "start", "x.license", F.explode("x.at").alias("at"))
    return spots.select("row", "doc_id", "license", F.lit(1.0).alias("share"), (F.col("start") + F.col("at")).alias("first"))


def long_places(segments: DataFrame, words: dict[str, list[str]], contained: float) -> DataFrame:
    """row, doc_id, license, share, first: where windows retrieve a template, and how much of it is there."""
    spark = segments.sparkSession
    scales = sorted({scale for w in words.values() for scale, _ in template_chunks(w)})
    few = sum(len(template_chunks(w)) * BANDS for w in words.values()) <= SMALL
    sized = F.broadcast if few else (lambda df: df)
    met = window_bands(segments, scales).join(sized(template_bands(spark, words)), "key").select("row", "start", "license", "first", "size").distinct()
    shapes = spark.createDataFrame([(k, [" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)], _slack(len(w) - SHINGLE + 1)) for k, w in words.items()], "license string, shingles array<string>, slack int")
    # the windows of a segment that retrieve a template: as many as the segment has at most
    asked = met.groupBy("row", "start", "license").agg(F.collect_list(F.struct("first", "size")).alias("windows"))
    near = segments.join(asked, ["row", "start"]).join(sized(shapes), "license")
    near = near.select("row", "doc_id", "start", "license", "shingles", "slack", "windows", shingles(F.col("w"), False).alias("here"))
    m, slack = F.size("shingles"), F.col("slack")
    # every shingle of the template that a window's surroundings have tells where the template would begin
    close = F.filter(
        F.sequence(F.lit(0), F.size("here") - 1),
        lambda i: F.exists("windows", lambda w: (i >= w["first"] - m - slack) & (i < w["first"] + w["size"] + m + slack)) & F.array_contains("shingles", F.get(F.col("here"), i)),
    )
    offsets = lambda i: F.filter(F.sequence(F.lit(0), m - 1), lambda o: F.get(F.col("shingles"), o) == F.get(F.col("here"), i))
    begins = F.array_distinct(F.flatten(F.transform(close, lambda i: F.transform(offsets(i), lambda o: i - o))))
    at = near.select("row", "doc_id", "start", "license", "shingles", "slack", "here", F.explode(begins).alias("at"))
    begin = F.greatest(F.col("at") - slack, F.lit(0))
    place = F.slice("here", begin + 1, F.col("at") + m + slack - begin)
    wanted = F.array_distinct("shingles")
    share = F.size(F.array_intersect(wanted, place)) / F.size(wanted)
    scored = where_computed(at.select("row", "doc_id", "license", F.greatest(F.col("start") + F.col("at"), F.lit(0)).alias("first"), share.alias("share")), F.col("share") >= contained)
    return scored.select("row", "doc_id", "license", "share", "first")
