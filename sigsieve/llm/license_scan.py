"""License scan: MinHash bands over overlapping windows find templates, exact shingle containment verifies them.

Templates fall into classes by their number of distinct 5-word shingles, n in [2**c, 2**(c+1)); for each class a text is
cut into windows of 4 * 2**c shingles at half that stride, so a passage as long as a template of the class lies inside
one window, and a window that holds 0.8 of a template has a Jaccard similarity of at least 0.19 with it.  With one row
to a band, `bands` minima find it with probability 1 - 0.81**bands: above 0.999998 at 64.  Texts and windows that share
no shingle with any template can't share a minimum with one either, so they are left before the minima are taken.
Found pairs are checked by the exact share of the template's shingles that the document holds.  A template of fewer than
five words is one shingle, its whole sequence of words, and found by exact lookup of the document's runs of as many words.

DataFrame functions only; templates are a small table of the caller, sent to all tasks, and refused above a stated size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Wordings of public licences, by identifier and family.
TEMPLATES = [
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT-text", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-notice", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-text", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC-text", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0-notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "cc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "cc", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "cc", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0-notice", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-notice", "cc", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
]
#: Notices of fewer than K words.
SHORT_TEMPLATES = [
    ("All-rights-reserved", "reserved", "All rights reserved."),
    ("Some-rights-reserved", "reserved", "Some rights reserved."),
    ("No-rights-reserved", "reserved", "No rights reserved."),
]
K = 5


def _hashes(k: int) -> str:
    """Hashes of every run of k words of w, in order."""
    each = ", ".join(f"w[i + {j}]" for j in range(k))
    return f"if(size(w) < {k}, cast(array() as array<bigint>), transform(sequence(0, size(w) - {k}), i -> xxhash64({each})))"


def _runs(k: int) -> str:
    """Distinct runs of k words of _w."""
    return f"if(size(_w) < {k}, array(), array_distinct(transform(sequence(0, size(_w) - {k}), i -> concat_ws(' ', slice(_w, i + 1, {k})))))"


def _worded(df: DataFrame, sizes: tuple[int, ...] = ()) -> DataFrame:
    """_w: words (lower-cased runs of a-z and 0-9); _s: hash of every shingle, in order; _t: hashes of the runs of `sizes` words.

    transform(array(x), w -> ...)[0] binds w once; a plain reference would be split again for every shingle wherever
    the optimizer pulls the columns into a filter."""
    words = "filter(split(lower(coalesce(text, '')), '[^a-z0-9]+'), x -> x <> '')"
    df = df.withColumn("_w", F.expr(words)).withColumn("_s", F.expr(f"transform(array({words}), w -> {_hashes(K)})[0]"))
    short = ", ".join(map(_hashes, sizes))
    return df.withColumn("_t", F.expr(f"transform(array({words}), w -> concat({short}))[0]")) if sizes else df


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(license, family, t_words, t_class, t_shingles, t_hashes) of every template with a word; t_words is K, or less where the
    template has fewer words and is one shingle."""
    rows = spark.createDataFrame([(a, b, c) for a, b, c in (TEMPLATES + SHORT_TEMPLATES if templates is None else templates)], "license string, family string, text string")
    rows = _worded(rows).where("size(_w) > 0").withColumn("t_words", F.expr(f"least(size(_w), {K})"))
    rows = rows.withColumn("t_shingles", F.expr(f"if(t_words < {K}, array(concat_ws(' ', _w)), {_runs(K)})"))
    short = F.expr("case t_words " + " ".join(f"when {k} then transform(array(_w), w -> {_hashes(k)})[0]" for k in range(1, K)) + " end")
    rows = rows.withColumn("t_hashes", F.when(F.col("t_words") < K, short).otherwise(F.array_distinct("_s")))
    return rows.withColumn("t_class", F.expr("cast(floor(log2(size(t_hashes))) as int)")).select("license", "family", "t_words", "t_class", "t_shingles", "t_hashes")


def matches(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = 0.8, bands: int = 64, max_shingles: int = 20_000) -> DataFrame:
    """(doc_id, license, family, n_shared, n_template, containment): the templates of which a document holds the share `least`.

    A template held in part is left out only if another of its family is held to a larger share and has all the
    shingles that speak for it (GPL-2.0's line holds 7 of the 8 shingles of GPL-3.0's).

    Null and empty texts match nothing; a template of fewer than K words is held whole or not at all;
    repeated rows of one doc_id give one row with the largest share.  Texts of
    one doc_id are scanned apart.  A template list of more than max_shingles shingles is refused.  Only doc_id and text are read.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    known = table.select("t_words", "t_class", F.explode("t_hashes").alias("h")).distinct().limit(max_shingles + 1).collect()
    if len(known) > max_shingles:
        raise ValueError(f"templates of more than {max_shingles} shingles; scan with parts of them")
    every, classes = sorted({r.h for r in known if r.t_words == K}), sorted({r.t_class for r in known if r.t_words == K})
    brief, sizes = sorted({r.h for r in known if r.t_words < K}), tuple(sorted({r.t_words for r in known if r.t_words < K}))
    spec = "doc_id bigint, license string, family string, n_shared bigint, n_template bigint, containment double"
    if not known:
        return spark.createDataFrame([], spec)
    rows = _worded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), sizes)
    overlap = lambda column, hashes: F.arrays_overlap(column, F.lit(hashes)) if hashes else F.lit(False)
    rows = rows.withColumn("_long", overlap("_s", every)).withColumn("_brief", overlap("_t", brief)).where("_long or _brief")
    rows = rows.select("doc_id", F.xxhash64("text").alias("_h"), "_w", "_s", "_long", "_brief").dropDuplicates(["doc_id", "_h"])
    rows = cut(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))  # few rows, much work on each
    held = None
    if every:
        cuts = "flatten(transform(array({}), c -> transform(sequence(0, greatest(size(_s) - 1, 0), shiftleft(2, c)), a -> named_struct('c', c, 'win', slice(_s, a + 1, shiftleft(4, c))))))".format(", ".join(map(str, classes)))
        windows = rows.where("_long").select("doc_id", "_h", F.explode(F.expr(cuts)).alias("x")).select("doc_id", "_h", "x.c", "x.win").where(F.arrays_overlap("win", F.lit(every)))
        minima = f"transform(sequence(1, {bands}), i -> array_min(transform({{}}, h -> xxhash64(h, i))))"
        signed = windows.select("doc_id", "_h", "c", F.posexplode(F.expr(minima.format("win"))).alias("band", "low"))
        long = table.where(F.col("t_words") == K)
        bands_of = long.select("license", F.col("t_class").alias("c"), F.posexplode(F.expr(minima.format("t_hashes"))).alias("band", "low"))
        pairs = signed.join(F.broadcast(bands_of), ["c", "band", "low"]).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), "license").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))
        held = rows.withColumn("_held", F.expr(_runs(K))).join(pairs, same).join(F.broadcast(long.select("license", "family", "t_shingles")), "license")
        held = held.select("doc_id", "_h", "license", "family", F.array_intersect("_held", "t_shingles").alias("_own"), F.size("t_shingles").cast("bigint").alias("n_template"))
    if brief:
        short = table.where(F.col("t_words") < K).select("license", "family", F.col("t_shingles")[0].alias("_run"))
        known_runs = F.lit(sorted({r._run for r in short.collect()}))
        found = rows.where("_brief").withColumn("_runs", F.expr(f"concat({', '.join(map(_runs, sizes))})"))
        found = found.select("doc_id", "_h", F.explode(F.array_intersect("_runs", known_runs)).alias("_run")).join(F.broadcast(short), "_run")
        found = found.select("doc_id", "_h", "license", "family", F.array("_run").alias("_own"), F.lit(1).cast("bigint").alias("n_template"))
        held = held.unionAll(found) if held is not None else found
    held = held.withColumn("n_shared", F.size("_own").cast("bigint"))
    held = held.withColumn("containment", F.col("n_shared") / F.col("n_template")).where(F.col("n_shared") >= least * F.col("n_template"))
    hits = held.groupBy("doc_id", "_h", "family").agg(F.collect_list(F.struct("license", "n_shared", "n_template", "containment", "_own")).alias("_all"))
    confused = "exists(_all, y -> y.containment > x.containment and size(array_except(x._own, y._own)) = 0)"
    hits = hits.withColumn("_x", F.explode(F.expr(f"filter(_all, x -> x.containment = 1 or not {confused})"))).select("doc_id", "family", "_x.*")
    hits = hits.groupBy("doc_id", "license", "family").agg(F.max("n_shared").alias("n_shared"), F.max("n_template").alias("n_template"), F.max("containment").alias("containment"))
    return hits.select("doc_id", "license", "family", "n_shared", "n_template", "containment")
