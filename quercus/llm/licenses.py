"""Operator 12: license scans by diagonal voting. DataFrame expressions only.

All rolling k-grams of words of all texts are joined by hash with the places where templates (license notices) have them. A hit votes for its
diagonal: its place in the text less that in the template. Votes are counted per text, template and diagonal; diagonals at most GAP words apart
are merged, as words put in or left out of a notice shift what follows. A merged span is verified: its k-grams are those of the template
word by word (not only by hash), and it has to cover SHARE of the template's words and DENSITY of its own. A span that lies within another
verified span loses to it, so that a notice isn't labelled by the shorter one that it contains.

Phrases are looked for in the same pass. Texts never leave their task: a row for each text, with its votes, is all that is shuffled, added
up before. A row is known by its place in the input, so the input should be a stored table, which gives the same rows when a task runs again.

Cases: a null or empty text, or one without words, has no words: zeros, null places, empty labels. Equal rows give equal rows, each its own.
Texts of any length are scanned whole, in blocks of words. A template shorter than k words can't vote and is an error. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 4
#: Words between neighbouring diagonals, and what a span must cover of its template and of itself.
GAP, SHARE, DENSITY = 4, 0.6, 0.5
#: Words of a text that are made into rows at once.
BLOCK = 4096
#: Words of all templates together; their k-grams are sent to all tasks.
TEMPLATE_WORDS = 200_000
#: Phrases that are labels by themselves.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The usual notices of public licenses.
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case.

    lower() is the quicker way. It changes other letters too, but words end at the same places and the only other letter that it
    makes an ASCII one of is the Kelvin sign, so that phrases and templates in ASCII are found in the same places."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_extract_all(F.when(F.contains(text, F.lit("K")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text)), F.lit(WORD), F.lit(0))


def _zipped(part: Column, n: int) -> Column:
    """Each word with the n-1 that follow it (null after the end)."""
    return F.arrays_zip(*[(part if i == 0 else F.slice(part, i + 1, BLOCK + n)).alias(f"w{i}") for i in range(n)])


def _equal(gram: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for i, w in enumerate(words):
        out = out & (gram[f"w{i}"] == w)
    return out


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> tuple[DataFrame, DataFrame]:
    """(hash, at: tid, tpos and gram) of all templates' k-grams, and (tid, label, length)."""
    given = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "tid int, label string, text string").select("tid", "label", words_of(F.col("text")).alias("words"))
    facts = given.select("tid", "label", F.size("words").alias("length"))
    total, least = facts.agg(F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.min("length"), F.lit(k))).first()
    if least < k or total > TEMPLATE_WORDS:
        raise ValueError(f"templates need at least {k} words each and at most {TEMPLATE_WORDS} together")
    grams = given.select("tid", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k))).alias("tpos", "gram"))
    at = F.collect_list(F.struct("tid", "tpos", F.concat_ws(" ", "gram").alias("gram")))
    return grams.groupBy(F.xxhash64(*[F.col("gram")[i] for i in range(k)]).alias("hash")).agg(at.alias("at")), facts


def votes(docs: DataFrame, id_col: str, text_col: str, grams: DataFrame, phrases: dict[str, str], k: int) -> DataFrame:
    """Per row, template and diagonal: the template's places that were hit, and the span. Each row's own facts have tid -1."""
    width = max([k, *(len(p.split(" ")) for p in phrases)])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    n = F.size("words")
    parts = rows.select("row", "id", n.alias("n"), F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK)), lambda s: F.slice("words", s + 1, BLOCK + width - 1)).alias("parts"))
    parts = parts.select("row", "id", "n", F.posexplode("parts").alias("part", "words"))
    each = parts.select("row", "id", "n", "part", F.posexplode_outer(_zipped(F.col("words"), width)).alias("pos", "g"))
    each = each.where(F.col("pos").isNull() | (F.col("pos") < BLOCK))
    base = F.coalesce(*[F.when(_equal(F.col("g"), p.split(" ")), F.lit(label)) for p, label in phrases.items()], F.lit(None).cast("string"))
    own = [F.col("g")[f"w{i}"] for i in range(k)]
    each = each.select("row", "id", "n", (F.col("part") * BLOCK + F.coalesce("pos", F.lit(0))).alias("place"), base.alias("base"), F.when(own[-1].isNotNull(), F.xxhash64(*own)).alias("hash"), F.when(own[-1].isNotNull(), F.concat_ws(" ", *own)).alias("gram"))
    found = each.join(F.broadcast(grams), "hash", "left").where((F.col("place") == 0) | F.col("base").isNotNull() | F.col("at").isNotNull())
    itself = F.when((F.col("place") == 0) | F.col("base").isNotNull(), F.array(F.struct(F.lit(-1).alias("tid"), F.lit(None).cast("int").alias("tpos")))).otherwise(F.array().cast("array<struct<tid:int,tpos:int>>"))
    hits = F.when(F.col("at").isNotNull(), F.transform(F.filter("at", lambda x: x["gram"] == F.col("gram")), lambda x: F.struct(x["tid"].alias("tid"), x["tpos"].alias("tpos")))).otherwise(F.array().cast("array<struct<tid:int,tpos:int>>"))
    entry = found.select("row", "id", "n", "place", "base", F.explode(F.concat(itself, hits)).alias("e")).select("row", "id", "n", "place", "base", "e.tid", "e.tpos")
    entry = entry.withColumn("diagonal", F.coalesce(F.col("place") - F.col("tpos"), F.lit(0)))
    is_base = (F.col("tid") == -1) & F.col("base").isNotNull()
    return entry.groupBy("row", "tid", "diagonal").agg(
        F.first("id").alias("id"), F.max("n").alias("n"), F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("place"))).alias("first_word"),
        F.max(F.when(is_base, F.col("place"))).alias("last_word"), F.collect_set(F.when(is_base, F.col("base"))).alias("base"),
        F.collect_set("tpos").alias("places"), F.min("place").alias("start"), (F.max("place") + k).alias("end"),
    )


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K, gap: int = GAP, share: float = SHARE, density: float = DENSITY) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest covered share of a template, 1 where a phrase stands), spans."""
    grams, facts = template_grams(docs.sparkSession, templates, k)
    by_diagonal = votes(docs, id_col, text_col, grams, phrases, k)
    along = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > gap).cast("int")
    merged = by_diagonal.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("cluster", F.sum("apart").over(along))
    # A set of the template's places is no longer than the template, however many diagonals a cluster has.
    merged = merged.select("*", F.explode_outer("places").alias("place")).groupBy("row", "tid", "cluster").agg(
        F.first("id").alias("id"), F.max("n").alias("n"), F.max("n_base").alias("n_base"), F.max("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.first("base").alias("base"), F.array_sort(F.collect_set("place")).alias("places"), F.min("start").alias("start"), F.max("end").alias("end"),
    )
    after = F.concat(F.slice("places", 2, TEMPLATE_WORDS), F.array(F.element_at("places", -1) + k))
    covered = F.aggregate(F.zip_with("places", after, lambda a, b: F.least(b - a, F.lit(k))), F.lit(0), lambda s, x: s + x)
    is_span = F.col("tid") >= 0
    spans = merged.join(F.broadcast(facts), "tid", "left").withColumn("covered", F.when(is_span, covered))
    verified = is_span & (F.col("covered") >= share * F.col("length")) & (F.col("covered") >= density * (F.col("end") - F.col("start")))
    spans = spans.withColumn("verified", F.coalesce(verified, F.lit(False)))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("covered"), "tid", "cluster").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.max(F.when(F.col("verified"), F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    kept = F.col("verified") & ~F.col("within")
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("label").alias("label"), (F.col("covered") / F.col("length")).alias("share"))
    per_row = spans.withColumn("within", within).groupBy("row").agg(
        F.first("id").alias("id"), F.max("n").alias("n"), F.max("n_base").alias("n_base"), F.max("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.flatten(F.collect_list(F.when(~is_span, F.col("base")))).alias("base"), F.collect_set(F.when(kept, F.col("label"))).alias("own"),
        F.max(F.col("covered") / F.col("length")).alias("best"), F.array_sort(F.collect_list(F.when(kept, span))).alias("spans"),
    )
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return per_row.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), F.col("n_base").cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.concat("base", "own")).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans",
    )


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op12_licenses": op12_licenses}

_VALUES = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(TEMPLATES))
_SPLIT = f"regexp_extract_all(translate(coalesce({{}}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = {
    "op12_licenses": f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_SPLIT.format('text')} AS w FROM documents),
t AS MATERIALIZED (SELECT tid, label, {_SPLIT.format('x')} AS w FROM (VALUES {_VALUES}) AS v(tid, label, x)),
p AS (SELECT doc_id, pos, concat_ws(' ', w0, w1) AS two, concat_ws(' ', w0, w1, w2, w3) AS four, w3 FROM
  (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS w0, unnest(w[2:]) AS w1, unnest(w[3:]) AS w2, unnest(w[4:]) AS w3 FROM d)),
b AS (SELECT doc_id, pos, CASE WHEN four = 'gnu general public license' THEN 'gpl' WHEN two = 'apache license' THEN 'apache' WHEN two = 'cc by' THEN 'cc-by' WHEN two = 'mit license' THEN 'mit' END AS label FROM p),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM b WHERE label IS NOT NULL GROUP BY doc_id),
tg AS (SELECT tid, i - 1 AS tpos, array_to_string(w[i:i+3], ' ') AS four FROM (SELECT tid, w, unnest(range(1, len(w) - 2)) AS i FROM t)),
hit AS MATERIALIZED (SELECT doc_id, tid, pos, tpos, pos - tpos AS diag FROM p JOIN tg USING (four) WHERE w3 IS NOT NULL),
step AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tid ORDER BY diag) > 4 THEN 1 ELSE 0 END AS s FROM hit),
cl AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS c FROM step),
word AS (SELECT doc_id, tid, c, count(DISTINCT x) AS covered FROM (SELECT doc_id, tid, c, unnest(range(tpos, tpos + 4)) AS x FROM cl) GROUP BY ALL),
span AS MATERIALIZED (SELECT doc_id, tid, c, min(pos) AS a, max(pos) + 4 AS z FROM cl GROUP BY ALL),
f AS MATERIALIZED (SELECT s.*, w.covered, t.label, w.covered / len(t.w) AS share, w.covered >= 0.6 * len(t.w) AND w.covered >= 0.5 * (s.z - s.a) AS good FROM span AS s JOIN word AS w USING (doc_id, tid, c) JOIN t USING (tid)),
own AS (SELECT doc_id, max(share) AS best, list(DISTINCT label) FILTER (WHERE good AND NOT inside) AS labels FROM (
  SELECT f.*, EXISTS (SELECT 1 FROM f AS g WHERE g.doc_id = f.doc_id AND g.good AND g.z >= f.z AND (g.a, -g.z, -g.covered, g.tid, g.c) < (f.a, -f.z, -f.covered, f.tid, f.c)) AS inside FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, base.first_word, base.last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)"""
}
