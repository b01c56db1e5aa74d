"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import BROADCAST_IDS, let, table, written

#: Words of a shingle.
WIDTH = 5
#: Shingles of a window and the step between a document's windows. Templates of fewer shingles than a window and a
#: step have each shingle as a window of its own.
WINDOW, STEP = 16, 8
#: Bands of one value each: a window that has half of its shingles in common with a template's window is
#: retrieved with probability 1 - 0.5 ** 12 = 0.9998, one with 80 % with 1 - 4e-9.
BANDS = 12
#: Rows of the template index that are sent to every task at most; a larger index is joined by a shuffle.
INDEX_ROWS = 200_000
#: Shingles of a text that one row holds when places are checked.
BLOCK = 256

# Notices and license texts as their owners publish them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Affero General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "bsd-3-clause-condition": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions"
    ),
    "cc0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
        "rights to this software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of `width` words, in order; fewer words have none."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(F.size(h) < width, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        ),
    )


def salt(band: int) -> int:
    """A fixed 63-bit number for each band; its XOR reorders the hashes."""
    x = (band + 1) * 0x9E3779B97F4A7C15 % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    return (x ^ (x >> 27)) >> 1


def keyed(windows: DataFrame, singles: int) -> DataFrame:
    """(..., start, window) to (..., at, key): the window's band keys, and its first `singles` shingles as their own.

    A band's key is the least of the window's reordered hashes. The salts are rows of a generator, so that the generated
    code holds one band only; a window of one shingle has the shingle itself for a signature.
    """
    salts = F.array(*[F.lit(salt(b)) for b in range(BANDS)], *[F.lit(0)] * singles)
    rows = windows.select("*", F.posexplode(salts).alias("band", "salt"))
    least = F.least(*[F.get("window", F.lit(k)).bitwiseXOR(F.col("salt")) for k in range(WINDOW)])
    own = F.col("band") - BANDS
    key = F.when(own < 0, F.xxhash64("band", least)).otherwise(F.get("window", F.greatest(own, F.lit(0))))
    rows = rows.select(*[c for c in windows.columns if c not in ("start", "window")], (F.col("start") + F.greatest(own, F.lit(0))).alias("at"), key.alias("key"))
    return rows.where("key is not null")


def at_starts(hashes: Column, starts: Column, size: int) -> Column:
    """Structs of each start and the `size` shingles from there: rows of these are short, whatever the text's length."""
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(hashes, i + 1, size).alias("window")))


def index(templates: DataFrame) -> DataFrame:
    """(template_id, text) to (key, template_id, offset, needed): the band keys of every window of the templates."""
    rows = templates.select("template_id", shingle_hashes(tokens(F.col("text"))).alias("h"))
    rows = rows.where(F.size("h") > 0).select("template_id", "h", F.array_distinct("h").alias("needed"))
    n = F.size("h")
    short = rows.where(n < WINDOW + STEP).select("template_id", "needed", F.posexplode("h").alias("offset", "key"))
    long = rows.where(n >= WINDOW + STEP)
    windows = F.inline(at_starts(F.col("h"), F.sequence(F.lit(0), n - WINDOW), WINDOW))
    long = keyed(long.select("template_id", "needed", windows), 0).withColumnRenamed("at", "offset")
    return short.select("key", "template_id", "offset", "needed").unionByName(long.select("key", "template_id", "offset", "needed"))


def retrieved(rows: DataFrame, ix: DataFrame, small: bool) -> DataFrame:
    """(doc_id, h) to (doc_id, template_id, begin, size): the places of texts where a window retrieves a template.

    A retrieved template is laid at the place that the window's offset in it says, with a quarter of its length (and a
    window) to spare on either side. Places of overlapping windows are put on a grid of STEP and come once.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.lit(STEP))
    windows = keyed(rows.select("doc_id", F.inline(at_starts(F.col("h"), starts, WINDOW))), STEP)
    keys = ix.select("key", "template_id", "offset", F.size("needed").alias("n"))
    hits = windows.join(F.broadcast(keys) if small else keys, "key")
    spare = (F.col("n") / 4).cast("int") + WINDOW
    begin = F.greatest(F.floor((F.col("at") - F.col("offset") - spare) / STEP) * STEP, F.lit(0)).cast("int")
    return hits.select("doc_id", "template_id", begin.alias("begin"), (F.col("n") + 2 * spare + STEP).alias("size")).distinct()


def scan(docs: DataFrame, templates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, text) by (template_id, text) to (doc_id, template_id, containment, position), best place of each.

    Every window of every whole text is looked up. Containment is the share of the template's distinct shingles that
    stand at a retrieved place; pairs of at least the threshold are returned, position is where the first of these
    shingles stands at the first best place. Texts are laid out in blocks of BLOCK shingles for this, so that no row
    holds more than a block or a place. Rows with the same doc_id count as one document; a null id is one too. Null and
    empty texts, and templates of fewer words than a shingle, match nothing; equal templates each match; empty tables
    give no rows. Extra columns are not looked at.
    """
    ix = written(index(templates.select("template_id", "text")))
    small = ix.limit(INDEX_ROWS + 1).count() <= INDEX_ROWS
    rows = docs.select("doc_id", shingle_hashes(tokens(F.col("text"))).alias("h"))
    places = written(retrieved(rows, ix, small))
    # The blocks of hit documents, met by the blocks that each place covers.
    ids = places.select("doc_id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = ids.select(F.col("doc_id").alias("_id"))
    hit = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    hit = hit.select("doc_id", shingle_hashes(tokens(F.col("text"))).alias("h"))
    blocks = F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.lit(BLOCK))
    hit = hit.select("doc_id", F.inline(at_starts(F.col("h"), blocks, BLOCK)))
    hit = hit.select(F.col("doc_id").alias("_id"), (F.col("start") / BLOCK).cast("int").alias("_block"), "window")
    covered = F.sequence((F.col("begin") / BLOCK).cast("int"), ((F.col("begin") + F.col("size") - 1) / BLOCK).cast("int"))
    covered = places.withColumn("block", F.explode(covered))
    parts = covered.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block")))
    needed = ix.select("template_id", "needed").distinct()
    parts = parts.join(F.broadcast(needed) if small else needed, "template_id")
    # What of each block belongs to the place, and which of the template's shingles are there.
    skip = F.greatest(F.col("begin") - F.col("block") * BLOCK, F.lit(0))
    end = F.least(F.col("begin") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))
    own = F.slice("window", skip + 1, F.greatest(end - skip, F.lit(0)))
    first = F.array_position(F.transform(own, lambda x: F.array_contains("needed", x)), True) - 1
    parts = parts.select(
        "doc_id", "template_id", "begin", F.size("needed").alias("n"), F.explode(F.array_intersect("needed", own)).alias("x"),
        (F.col("block") * BLOCK + skip + first).alias("position"),
    )
    found = parts.groupBy("doc_id", "template_id", "begin", "n", "x").agg(F.min("position").alias("position"))
    found = found.groupBy("doc_id", "template_id", "begin", "n").agg(F.count("*").alias("both"), F.min("position").alias("position"))
    found = found.withColumn("containment", F.col("both") / F.col("n")).where(F.col("containment") >= threshold)
    best = found.groupBy("doc_id", "template_id").agg(F.max(F.struct("containment", (-F.col("position")).alias("p"))).alias("best"))
    return best.select("doc_id", "template_id", F.col("best.containment").alias("containment"), (-F.col("best.p")).cast("int").alias("position"))


def known_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("template_id"), F.lit(v).alias("text")) for k, v in TEMPLATES.items()])
    return spark.range(1).select(F.inline(rows))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), known_templates(spark))
    return found.select("doc_id", "template_id", F.round("containment", 6).alias("containment"), "position")
