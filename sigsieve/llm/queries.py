"""Registered queries of this package, one for each operator: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, embedding_dedup, hard_negatives, html_extract, language_id, license_scan, mixing, periodic_runs, simhash_dedup, substring_dedup, suffix_dedup
from .common import table


def op1_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.learn(spark))


def op2_license_scan(spark, sf_dir):
    return license_scan.matches(table(spark, sf_dir, "documents"))


def op3_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra)))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~language_id.held_out() & F.col("doc_id").isNotNull()))
    return language_id.identify(docs, model).withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark, sf_dir):
    rows = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=2, seed=42)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    rows = rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.hard_negatives(rows, "vec_id % 100 = 0", positives=5, negatives=10, least_pct=30, most_pct=90)


def op12_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path), path))


def with_periods(docs):
    """docs with h = crc32(decimal doc_id), g = h div 10: where h % 10 = 0, the n words from a = g % n on repeat with
    period 1 + (n - a) div (3 + g % 8).  Empty texts and rows without doc_id stay."""
    words = r"transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w -> if(size(w) = 0, text, array_join(transform(sequence(0, size(w) - 1), i -> {word}), ' ')))[0]"
    start = "cast(_g % size(w) as int)"
    word = f"if(i < {start}, w[i], w[{start} + (i - {start}) % (1 + cast((size(w) - {start}) div (3 + _g % 8) as int))])"
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("_h")).withColumn("_g", F.expr("_h div 10"))
    return rows.select("doc_id", F.expr(f"if(_h % 10 = 0, {words.format(word=word)}, text)").alias("text"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_license_scan": op2_license_scan,
    "op3_chat_format": op3_chat_format,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_source_mix": op10_source_mix,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = r"regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+')"

SQL = {
    "op2_license_scan": r"""
WITH t(license, family, text) AS (VALUES
  ('MIT', 'mit', 'Released under the MIT License.'),
  ('MIT-text', 'mit', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
  ('Apache-2.0', 'apache', 'Licensed under the Apache License, Version 2.0.'),
  ('Apache-2.0-notice', 'apache', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
  ('GPL-3.0', 'gpl', 'This work is licensed under the GNU General Public License, version 3.'),
  ('GPL-2.0', 'gpl', 'This work is licensed under the GNU General Public License, version 2.'),
  ('GPL-notice', 'gpl', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
  ('BSD-text', 'bsd', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
  ('ISC-text', 'isc', 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
  ('MPL-2.0-notice', 'mpl', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.'),
  ('CC-BY-NC-4.0', 'cc', 'Licensed under CC BY-NC 4.0.'),
  ('CC-BY-4.0', 'cc', 'Licensed under CC BY 4.0.'),
  ('CC-BY-SA-4.0', 'cc', 'Licensed under CC BY-SA 4.0.'),
  ('CC-BY-4.0-notice', 'cc', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
  ('CC0-notice', 'cc', 'To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.'),
  ('All-rights-reserved', 'reserved', 'All rights reserved.'),
  ('Some-rights-reserved', 'reserved', 'Some rights reserved.'),
  ('No-rights-reserved', 'reserved', 'No rights reserved.')),
tw AS (SELECT license, family, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM t),
tk AS (SELECT license, family, w, least(len(w), 5) AS k FROM tw),
ts AS (SELECT DISTINCT license, family, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tk)),
tn AS (SELECT license, count(*) AS n_template FROM ts GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ts))),
own AS (SELECT doc_id, license, family, list(s) AS own, count(*) AS n_shared FROM ds JOIN ts USING (k, s) GROUP BY ALL),
held AS (SELECT *, n_shared / n_template AS containment FROM own JOIN tn USING (license) WHERE n_shared >= 0.8 * n_template)
SELECT doc_id, license, family, n_shared, n_template, containment FROM held x
WHERE containment = 1 OR NOT EXISTS (
  SELECT 1 FROM held y
  WHERE y.doc_id = x.doc_id AND y.family = x.family AND y.containment > x.containment AND list_has_all(y.own, x.own))""",
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS shown FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(shown) + 17) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""",
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.good AND b.good AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS root, vec_id AS u FROM v UNION SELECT r.root, l.w FROM r JOIN l ON r.u = l.u),
c AS (SELECT u AS vec_id, min(root) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op7_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, i, md5(b[i:i + 399]) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
isle AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS k FROM (
  SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT rid, min(i) AS a, max(i) + 400 AS z FROM isle GROUP BY rid, k),
cuts AS (SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM span GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE list_reduce(
    list_transform(list_zip(list_prepend(1, z), list_append(a, octet_length(b) + 1)), lambda s: b[s[1]:s[2] - 1]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN cuts USING (rid)""",
    "op9_decontaminate": f"""
WITH iw AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
sh AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM iw WHERE k > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM sh GROUP BY item_id),
dw AS (SELECT doc_id, k, {_WORDS} AS w FROM documents, (SELECT DISTINCT k FROM sh)),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN sh USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op10_source_mix": mixing.mix_sql("docs AS (SELECT doc_id, text, source FROM documents)"),
}
