"""Operator 1: license scans, in DataFrame functions only.

Templates are cut into pieces of at most ``PIECE`` shingles (of five words; a template of fewer words is one shingle of
all, compared with the texts' runs of as many words).
Texts are read in overlapping windows as long as a piece, a quarter of that apart. A window's MinHash signature has ``BANDS`` bands of
one row: the least value of its shingles under each of as many hash functions. A window as similar as 0.5 to a piece (a piece's worth of
shingles kept to 0.75, and a shift of up to an eighth) meets it in a band with a chance of 1 - 0.5 ** 8 > 0.996, and several
windows overlap each occurrence. Retrieved pieces are verified: the share of the template piece's distinct shingles that occur about
the window must be 0.75 or more on average over all pieces of the template (0 for a piece not retrieved); a license is reported with the
largest such average of its templates. A whole license counts as several templates if its parts are told apart (its opening, the rest).

A band of one row holds a single shingle, so a window can only meet a piece in a band if it holds the piece's least shingle
of that band: windows are evaluated where one of those shingles (seeds) occurs, which is the same result as evaluating all. The distinct seeds are
tested as a literal set in blocks of at most about ``BLOCK`` (more templates make more blocks, each its own pass).

Templates that share an opening share seeds, so a seed may stand for very many pieces. What a window must show depends on the seed's band and the piece's size
only: windows are tested once for each such shape, and only those that pass meet the seed's pieces, one row a piece. Both tables are joined as rows: by
broadcast while their rows are few (``FEW``, which bounds their bytes), else by a shuffle that deals each seed and piece over ``SALTS`` tasks.

Texts are cut into chunks of ``CHUNK`` words, each with the words about it that windows at its edges reach into; a place where a seed occurs
carries only the shingles about it. So a row's size follows neither the text's length nor the number of its licenses.

Words are runs of letters and digits, lower-cased (ASCII). Null and empty texts match nothing; repeated rows are reported each; an empty
template table gives no rows. The result has one row for each document row and license found.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stow

SHINGLE, PIECE, BANDS, SHARE, BLOCK, CHUNK = 5, 64, 8, 0.75, 10_000, 2048
#: Rows of a broadcast table: of a few numbers, or of PIECE hashes.
FEW, SALTS = 50_000, 16
#: Shingles on either side of a seed that its windows, and what is about them, may reach.
REACH = PIECE + 2 * (PIECE // 4)
#: Well-known license notices, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]
#: Notices of fewer words than a shingle.
SHORT = [("LicenseRef-All-Rights-Reserved", "All rights reserved.")]
#: What follows the openings above, and (in files by SPDX name) whole texts.
REST = [
    ("MIT", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
]
TEXTS = Path(__file__).with_name("license_texts")


def templates(spark: SparkSession) -> DataFrame:
    whole = [(f.stem, f.read_text()) for f in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame(TEMPLATES + SHORT + REST + whole, "license string, text string")


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def shingles(w: Column, n: int = SHINGLE) -> Column:
    """Hashes of the runs of ``n`` words of an array."""
    at = lambda i, k: F.get(w, i + k)
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(at(i, k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def least_of_band(hashes: Column, band: int) -> Column:
    """The shingle with the least value under a band's hash function."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("x"), h.alias("h"))))["h"]


def pieces(table: DataFrame) -> DataFrame:
    """(license, template, piece, size, pieces, n, hashes, bands): bands[i] is the shingle of n words that the piece has in band i."""
    cut = table.where("license is not null and text is not null").dropDuplicates(["license", "text"]).select("license", F.xxhash64("license", "text").alias("template"), F.explode(F.array(words(F.col("text")))).alias("w"))  # a generator: see _verify
    h = shingles(F.col("w"))
    for n in range(1, SHINGLE):
        h = F.when(F.size("w") == n, shingles(F.col("w"), n)).otherwise(h)
    cut = cut.withColumn("n", F.least(F.lit(SHINGLE), F.size("w"))).withColumn("h", h).where(F.size("h") > 0)
    cut = cut.withColumn("pieces", F.ceil(F.size("h") / PIECE).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn("size", F.ceil(F.size("h") / F.col("pieces")).cast("int")).withColumn("hashes", F.slice("h", F.col("piece") * F.col("size") + 1, F.col("size"))).where(F.size("hashes") > 0)
    return cut.select("license", "template", "piece", F.size("hashes").alias("size"), "pieces", "n", F.array_distinct("hashes").alias("hashes"), F.array(*(least_of_band(F.col("hashes"), b) for b in range(BANDS))).alias("bands"))


def scan(docs: DataFrame, table: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, license, share, first_word, n_windows): a row for each row of ``docs`` and license found."""
    made = stow(pieces(table), "pieces")
    seeds = made.select("template", "piece", "size", "n", F.posexplode("bands").alias("band", "seed"))
    distinct = seeds.select("n", "seed").distinct()
    blocks = max(1, -(-distinct.count() // BLOCK))
    docs = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(column).alias("text"))
    places = [_places(docs, distinct.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == b)) for b in range(blocks)]
    every = places[0]
    for p in places[1:]:
        every = every.union(p)
    return _verify(every, seeds, made, key)


def _chunks(w: Column) -> Column:
    """array<struct<first, last, base, w>>: seeds are looked for at the words first .. last - 1; ``w`` begins at word ``base``."""
    side = REACH + SHINGLE
    base = lambda first: F.greatest(F.lit(0), first - side)
    cut = lambda first: F.struct(first.alias("first"), (first + CHUNK).alias("last"), base(first).alias("base"), F.slice(w, base(first) + 1, F.lit(CHUNK + 2 * side)).alias("w"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 1), F.lit(CHUNK)), cut)


def _places(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, row, i, seed, at, about): where a seed occurs, at shingle i, and the shingles about it from ``at`` on."""
    wanted: dict[int, list[int]] = {SHINGLE: [0]}
    for r in seeds.collect():  # about BLOCK values
        wanted.setdefault(r["n"], []).append(r["seed"])
    own = docs.select("key", "row", words(F.col("text")).alias("w"))
    own = own.select("key", "row", F.explode(_chunks(F.col("w"))).alias("c")).select("key", "row", "c.first", "c.last", "c.base", F.col("c.w").alias("w"))
    own = own.select("key", "row", "first", "last", "base", *(shingles(F.col("w"), n).alias(f"h{n}") for n in wanted))
    kind = "struct<i:int,seed:bigint,at:int,about:array<bigint>>"
    nothing, none = F.array().cast("array<bigint>"), F.lit(None).cast(kind)

    def of_size(n: int) -> Column:
        begin = lambda i: F.greatest(F.lit(0), i - REACH)
        about = lambda i: F.slice(f"h{SHINGLE}", begin(i) + 1, F.lit(2 * REACH + 1)) if n == SHINGLE else nothing
        place = lambda h, i: F.struct((i + F.col("base")).alias("i"), h.alias("seed"), (begin(i) + F.col("base")).alias("at"), about(i).alias("about")).cast(kind)
        inside = lambda i: (i + F.col("base") >= F.col("first")) & (i + F.col("base") < F.col("last"))
        return F.filter(F.transform(f"h{n}", lambda h, i: F.when(h.isin(wanted[n]) & inside(i), place(h, i)).otherwise(none)), lambda x: x.isNotNull())

    own = own.withColumn("at", F.concat(*(of_size(n) for n in wanted))).select("key", "row", "at")
    # explode_outer, and a filter on its output: a filter on the arrays would be pushed below the projections that make them,
    # and split the text anew for each of its words
    return own.select("key", "row", F.explode_outer("at").alias("a")).where("a is not null").select("key", "row", "a.*")


def _meet(places: DataFrame, table: DataFrame, on: list[str], few: bool) -> DataFrame:
    """``places`` joined to a table of templates' rows: by broadcast if they are few, else each row of the table in every salt."""
    if few:
        return places.join(F.broadcast(table), on)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return places.withColumn("salt", F.pmod(F.xxhash64("row", "begin"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def _verify(places: DataFrame, seeds: DataFrame, made: DataFrame, key: str) -> DataFrame:
    few = seeds.limit(FEW + 1).count() <= FEW
    shapes = seeds.select("seed", "band", "size", "n").distinct()
    found = _meet(places.withColumn("begin", F.col("i")), shapes, ["seed"], few).drop("begin")
    step = F.greatest(F.lit(1), F.floor(F.col("size") / 4)).cast("int")
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("size") + 1) / step)).cast("int"), F.floor(F.col("i") / step).cast("int")
    found = found.withColumn("step", step).withColumn("g", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("begin", F.col("g") * F.col("step"))
    window = F.slice("about", F.col("begin") - F.col("at") + 1, F.col("size"))
    least = F.array_min(F.transform(window, lambda h: F.struct(F.xxhash64(h, F.col("band")).alias("x"), h.alias("h"))))["h"]
    short = F.col("n") < SHINGLE  # its seed is all of it
    about = F.slice("about", F.greatest(F.lit(0), F.col("begin") - F.col("step")) - F.col("at") + 1, F.col("size") + 2 * F.col("step"))
    met = found.where(short | (least == F.col("seed"))).select("key", "row", "seed", "band", "size", "n", "begin", about.alias("about"))
    met = _meet(met, seeds, ["seed", "band", "size", "n"], few)
    met = _meet(met, made.select("license", "template", "piece", "pieces", "hashes"), ["template", "piece"], few)
    share = F.when(short, 1.0).otherwise(F.size(F.array_intersect("hashes", "about")) / F.size("hashes"))
    met = met.select("key", "row", "begin", "license", "template", "piece", "pieces", share.alias("share")).where((F.col("pieces") > 1) | (F.col("share") >= SHARE))
    good = F.when(F.col("share") >= SHARE, F.col("begin"))  # of a piece without such a window, its best one counts
    best = met.groupBy("row", "key", "license", "template", "pieces", "piece").agg(F.max("share").alias("share"), F.coalesce(F.min(good), F.min_by("begin", F.struct(-F.col("share"), "begin"))).alias("begin"), F.greatest(F.lit(1), F.countDistinct(good)).alias("windows"))
    whole = best.groupBy("row", "key", "license", "template", "pieces").agg(F.sum("share").alias("total"), F.min("begin").alias("begin"), F.sum("windows").alias("windows")).where(F.col("total") >= SHARE * F.col("pieces"))
    return whole.groupBy("row", "key", "license").agg(F.max(F.col("total") / F.col("pieces")).alias("share"), F.min("begin").cast("long").alias("first_word"), F.sum("windows").cast("long").alias("n_windows")).select(F.col("key").alias(key), "license", F.round("share", 6).alias("share"), "first_word", "n_windows")


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs, templates(docs.sparkSession))
