"""License scan by diagonal voting, in DataFrame operations only.

All rolling windows of K words of all documents are joined, by hash and then word for word, to the
windows of a fixed table of license texts. A hit at word i of a document and word j of a text votes for
the diagonal i - j; diagonals of one text that lie close together (words were added or left out) are
merged, and a merged span counts where it covers enough of the text and is not much longer. What a
diagonal covers is a set of bits by place in the text, so hits are summed up where the document is read
and a diagonal is one row, however many documents hold the same license.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import stored, utf8

#: Words: runs of a-z, digits and all that is not ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and of the longest text (bits of LANES longs).
K, LANES = 4, 4
#: Diagonals of one text up to SLACK apart, but no more than a quarter of its length, are one span.
SLACK = 8
#: A span counts with at least this share of the longer one of text and span covered.
LEAST = 0.7

#: Phrases that name a license.
PHRASES = (("apache", "apache license"), ("cc-by", "cc by"), ("gpl", "gnu general public license"), ("mit", "mit license"))

#: License texts and notices, as published, at most 64 * LANES words each.
TEXTS = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + u) for u in range(K)]


def template_windows(spark: SparkSession, texts=TEXTS) -> DataFrame:
    """gh (hash), g0 to g3 (the words) and ``places``: all (t, j, m, bits) of a window in the texts. Its size is fixed by ``texts``."""
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(text).alias("text")) for t, (_, text) in enumerate(texts)])
    read = spark.range(1).select(F.inline(rows)).withColumn("w", _words(F.col("text"))).withColumn("m", F.size("w"))
    placed = read.select("t", "w", "m", F.explode(F.sequence(F.lit(0), F.col("m") - K)).alias("j"))

    def lane(q: int) -> Column:
        out = F.lit(0).cast("long")
        for u in range(K):
            place = F.col("j") + u
            out = out.bitwiseOR(F.when(F.floor(place / 64) == q, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")))
        return out

    at = F.struct("t", "j", "m", *[lane(q).alias(f"b{q}") for q in range(LANES)])
    words = [c.alias(f"g{u}") for u, c in enumerate(_window(F.col("w"), F.col("j")))]
    return placed.select(*words, at.alias("at")).groupBy(*[f"g{u}" for u in range(K)]).agg(F.array_sort(F.collect_list("at")).alias("places")).withColumn(
        "gh", F.xxhash64(*[f"g{u}" for u in range(K)])
    )


def _phrase_at(words: Column, i: Column, phrases) -> Column:
    """The number of the phrase that starts at word i, or null. No two start with the same word."""
    out = F.lit(None).cast("int")
    for k, (_, phrase) in enumerate(phrases):
        own = [F.get(words, i + u) == w for u, w in enumerate(phrase.split())]
        test = own[0]
        for c in own[1:]:
            test = test & c
        out = F.when(test, k).otherwise(out)
    return out


def diagonals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts=TEXTS, phrases=PHRASES) -> DataFrame:
    """One pass over the texts. Rows by (rid, t, o): t -1 has what the document itself says (doc_id, n_words, phrases),
    others the votes of text t on the diagonal o.

    A document is read by one task, so its votes are summed up there: what is shuffled is one row for each
    document and one for each diagonal.
    """
    spark = docs.sparkSession
    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), _words(utf8(text_col)).alias("w"))
    n = F.size("w")
    placed = read.select("rid", "doc_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(-1), n - 1)).alias("i"))
    i, w = F.col("i"), F.col("w")
    said = F.when(i >= 0, _phrase_at(w, i, phrases))
    own = placed.select(
        "rid", "doc_id", "n", "i", said.alias("phrase"), *[c.alias(f"w{u}") for u, c in enumerate(_window(w, i))]
    ).withColumn("h", F.xxhash64(*[f"w{u}" for u in range(K)]))
    windows = F.broadcast(template_windows(spark, texts))  # of fixed size: as long as TEXTS
    hit = own.join(windows, [F.col("h") == F.col("gh"), *[F.col(f"w{u}") == F.col(f"g{u}") for u in range(K)]], "left")
    none = F.struct(*[F.lit(-1).alias(c) for c in ("t", "j", "m")], *[F.lit(0).cast("long").alias(f"b{q}") for q in range(LANES)])
    voiced = F.array_compact(F.concat(F.array(F.when((i == -1) | F.col("phrase").isNotNull(), none)), F.coalesce(F.when(i >= 0, F.col("places")), F.array().cast(windows.schema["places"].dataType))))
    rows = hit.where((i == -1) | F.col("phrase").isNotNull() | F.col("places").isNotNull()).select("rid", "doc_id", "n", "i", "phrase", F.explode(voiced).alias("at")).select(
        "rid", "doc_id", "n", "i", "phrase", "at.*"
    )
    here = F.when(F.col("t") == -1, F.col("phrase"))
    return rows.withColumn("o", F.when(F.col("t") >= 0, i - F.col("j")).otherwise(0)).groupBy("rid", "t", "o").agg(
        F.max("doc_id").alias("doc_id"), F.max("n").alias("n_words"), F.count(here).alias("n_base"),
        F.min(F.when(here.isNotNull(), i)).alias("first_word"), F.max(F.when(here.isNotNull(), i)).alias("last_word"),
        F.bit_or(F.coalesce(F.call_function("shiftleft", F.lit(1), here), F.lit(0))).alias("said"),
        F.max("m").alias("m"), F.count("*").alias("votes"), F.min("i").alias("lo"), F.max("i").alias("hi"), *[F.bit_or(f"b{q}").alias(f"b{q}") for q in range(LANES)],
    )


def license_spans(voted: DataFrame, least: float = LEAST, texts=TEXTS) -> DataFrame:
    """(rid, t, label, start, end, votes, score): the merged spans that are verified, from ``diagonals``.

    ``score`` is the share of the longer one of text and span whose words stand in both, in place.
    """
    order = Window.partitionBy("rid", "t").orderBy("o")
    slack = F.least(F.lit(SLACK), F.floor(F.col("m") / 4))
    apart = F.coalesce(F.col("o") - F.lag("o").over(order) > slack, F.lit(False)).cast("int")
    merged = voted.where("t >= 0").withColumn("apart", apart).withColumn("span", F.sum("apart").over(order)).groupBy("rid", "t", "m", "span").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("start"), (F.max("hi") + K).alias("end"), *[F.bit_or(f"b{q}").alias(f"b{q}") for q in range(LANES)]
    )
    covered = sum((F.bit_count(f"b{q}") for q in range(1, LANES)), F.bit_count("b0"))
    score = covered / F.greatest(F.col("m"), F.col("end") - F.col("start"))
    label = F.element_at(F.array(*[F.lit(name) for name, _ in texts]), F.col("t") + 1)
    return merged.select("rid", "t", label.alias("label"), "start", "end", "votes", score.alias("score")).where(F.col("score") >= least)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, texts=TEXTS, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a phrase stands, else that of the best span, 0 without one. A null or empty text
    has no words, no labels ('') and score 0. Rows are judged one by one: null and repeated ids do not
    matter. Texts are read whole, whatever their length; a license that occurs often in a text is found
    at each place. Columns other than the two, whatever their names, are not read. An empty table gives no
    rows. Outside ASCII, letters are lower-cased as well, which changes no phrase and no count.
    """
    if too_long := [t for t, (_, text) in enumerate(texts) if not K <= len(text.split()) <= 64 * LANES // 2]:
        raise ValueError(f"texts {too_long} are not of {K} to {32 * LANES} words")
    voted = stored(diagonals(docs, id_col, text_col, texts, phrases), "license-diagonals")
    found = license_spans(voted, least, texts).groupBy("rid").agg(F.array_sort(F.collect_set("label")).alias("found"), F.max("score").alias("best"))
    base = F.array_compact(F.array(*[F.when(F.getbit("said", F.lit(k)) == 1, name) for k, (name, _) in enumerate(phrases)]))
    none = F.array().cast("array<string>")
    return voted.where("t = -1").join(found, "rid", "left").withColumn("base", F.array_sort(F.array_distinct(base))).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same by joins of windows as text, without bits and hashes.
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT r, i - 1 AS i, array_to_string(w[i : i + {K - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d WHERE len(w) >= {K})),
raw AS (SELECT * FROM (VALUES {", ".join(f"({t}, {_quoted(name)}, {_quoted(text)})" for t, (name, text) in enumerate(TEXTS))}) AS v(t, label, body)),
tw AS (SELECT t, label, regexp_extract_all(lower(body), '{WORD}') AS w FROM raw),
tg AS (SELECT t, label, len(w) AS m, j - 1 AS j, array_to_string(w[j : j + {K - 1}], ' ') AS x FROM (SELECT t, label, w, unnest(range(1, len(w) - {K - 2})) AS j FROM tw)),
hit AS (SELECT r, t, label, m, i, j, i - j AS o FROM g JOIN tg USING (x)),
dg AS (SELECT DISTINCT r, t, m, o FROM hit),
ap AS (SELECT r, t, o, (o - lag(o) OVER (PARTITION BY r, t ORDER BY o) > least({SLACK}, m // 4))::INT AS a FROM dg),
sp AS (SELECT r, t, o, coalesce(sum(a) OVER (PARTITION BY r, t ORDER BY o ROWS UNBOUNDED PRECEDING), 0) AS span FROM ap),
cov AS (SELECT r, t, label, m, span, count(DISTINCT j + u) AS covered, max(i) + {K} - min(i) AS wide
        FROM hit JOIN sp USING (r, t, o), (SELECT unnest(range({K})) AS u) GROUP BY ALL),
ok AS (SELECT r, label, covered::DOUBLE / greatest(m, wide) AS score FROM cov WHERE covered::DOUBLE / greatest(m, wide) >= {LEAST}),
ph AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(name)}, {len(phrase.split())}, {_quoted(phrase)})" for name, phrase in PHRASES)}) AS p(label, k, phrase)),
bs AS (SELECT r, label, i - 1 AS i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), ph WHERE array_to_string(w[i : i + k - 1], ' ') = phrase),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base FROM bs GROUP BY r),
f AS (SELECT r, list(label) AS found, max(score) AS best FROM ok GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""
