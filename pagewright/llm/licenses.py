"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a text is hashed and joined to the positions at which license templates have it. A hit
at word d of the text and word t of a template votes for the diagonal d - t, on which the template would start.
Votes are added up by diagonal, neighbouring diagonals (words put in or left out) are merged, and a span counts
when it holds enough of the template's k-grams, counted by position. Each vote is checked against the words themselves, so a
hash collision can't vote. Templates may be whole licenses: their positions are broadcast if they are few, and otherwise
joined by a shuffle.

Edge cases: null text counts as empty; texts without a word give zero words, null positions, empty labels and score
0; rows that repeat are each returned; rows with a null id are kept; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Characters between words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (label, words): places where they stand consecutively. Fixed by the query's contract.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: (label, words) of notices that needn't be whole. Openings of well-known public licenses.
NOTICES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0-text", "the person who associated a work with this deed has dedicated the work to the public domain"),
]
#: (label, words) of whole licenses.
LICENSES = [
    ("mit-license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
]
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Neighbouring diagonals at most so far apart are merged; least share of a notice's k-grams that must be found.
SLACK, LEAST_COVER = 3, 0.5
#: k-grams of all templates together up to which they are broadcast.
MOST_GRAMS = 20_000


def grams(templates: list[tuple[str, str]], k: int) -> list[tuple[int, int, int, list[str]]]:
    """(template, its number of k-grams, position, words) of every k-gram."""
    out = []
    for t, (_, text) in enumerate(templates):
        ws = text.split()
        if len(ws) < k:
            raise ValueError(f"a template needs at least {k} words: {text}")
        out += [(t, len(ws) - k + 1, i, ws[i : i + k]) for i in range(len(ws) - k + 1)]
    return out


def _lookup(spark: SparkSession, templates, k: int, base: bool) -> DataFrame:
    rows = grams(templates, k)
    table = spark.createDataFrame([(*r, base, templates[r[0]][0]) for r in rows], "t int, n int, at int, gram array<string>, base boolean, label string")
    hits = F.collect_list(F.struct("base", "t", "n", "at", "gram", "label"))
    found = table.groupBy(F.xxhash64(*[F.col("gram")[i] for i in range(k)]).alias(f"h{k}_")).agg(hits.alias(f"hits{k}"))
    return F.broadcast(found) if len(rows) <= MOST_GRAMS else found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES + LICENSES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row for each row of docs.

    score: the largest share of a template's k-grams found on merged diagonals; 1 where a phrase stands whole.
    """
    spark = docs.sparkSession
    # Two characters become ASCII letters when lowered and must not; ASCII letters alone are lower-cased then.
    text = F.lower(F.replace(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("K"), F.lit("")), F.lit("İ"), F.lit("")))
    told = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("fp"), F.array_remove(F.split(text, BREAK), "").alias("ws"))
    # Position -1 stands for the text itself and stays in any case.
    at = told.select("doc_id", "fp", "ws", F.size("ws").alias("n"), F.explode(F.sequence(F.lit(-1), F.greatest(F.size("ws") - PHRASE_GRAM, F.lit(-1)))).alias("i"))
    word = lambda j: F.get("ws", F.col("i") + j)
    # Places without a k-gram get a key of their own, so that they don't meet in one task where the join shuffles.
    hashed = lambda k: F.when((F.col("i") >= 0) & (F.col("i") + k <= F.col("n")), F.xxhash64(*[word(j) for j in range(k)])).otherwise(F.xxhash64(F.lit(-1), "doc_id", "i"))
    hits = at.withColumns({f"h{k}": hashed(k) for k in (PHRASE_GRAM, NOTICE_GRAM)})
    for k, templates, base in ((PHRASE_GRAM, phrases, True), (NOTICE_GRAM, notices, False)):
        hits = hits.join(_lookup(spark, templates, k, base), F.col(f"h{k}") == F.col(f"h{k}_"), "left")
    both = [F.coalesce(f"hits{k}", F.array().cast("array<struct<base:boolean,t:int,n:int,at:int,gram:array<string>,label:string>>")) for k in (PHRASE_GRAM, NOTICE_GRAM)]
    votes = (
        hits.where((F.col("i") < 0) | F.col(f"hits{PHRASE_GRAM}").isNotNull() | F.col(f"hits{NOTICE_GRAM}").isNotNull())
        .select("doc_id", "fp", "n", "i", "ws", F.explode_outer(F.concat(*both)).alias("hit"))
        .where((F.col("i") < 0) | (F.slice("ws", F.col("i") + 1, F.size("hit.gram")) == F.col("hit.gram")))
        .select("doc_id", "fp", F.col("n").alias("n_words"), "hit.base", "hit.t", "hit.n", "hit.label", (F.col("i") - F.col("hit.at")).alias("diagonal"), F.col("hit.at").alias("at"))
    )
    key = ["doc_id", "fp", "n_words"]
    by_diagonal = votes.groupBy(*key, "base", "t", "n", "label", "diagonal").agg(F.collect_set("at").alias("places"), F.count("*").alias("rows"))
    # A phrase must stand whole on one diagonal; diagonals of a notice that lie close are one span.
    order = W.partitionBy(*key, "base", "t").orderBy("diagonal")
    spans = (
        by_diagonal.withColumn("opens", F.when(F.col("base") | F.col("t").isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK) | F.lag("diagonal").over(order).isNull(), 1).otherwise(0))
        .withColumn("span", F.sum("opens").over(order))
        .groupBy(*key, "base", "t", "n", "label", "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"), F.min("diagonal").alias("start"), F.sum("rows").alias("rows"))
        .withColumn("cover", F.col("found") / F.col("n"))
    )
    phrase, notice = F.col("base") & (F.col("cover") == 1), ~F.col("base") & (F.col("cover") >= LEAST_COVER)
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    found = spans.groupBy(*key).agg(
        F.sum(F.when(phrase, 1).otherwise(0)).alias("n_base"),
        F.min(F.when(phrase, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("start"))).cast("long").alias("last_word"),
        joined(phrase).alias("base_labels"),
        joined(phrase | notice).alias("labels"),
        F.coalesce(F.max(F.when(phrase | notice, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("t").isNull(), F.col("rows"))).alias("copies"),
    )
    # Rows with the same id and text were counted together.
    return found.select("doc_id", F.col("n_words").cast("long"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values(templates, base: bool) -> str:
    k = PHRASE_GRAM if base else NOTICE_GRAM
    return ", ".join(f"({'true' if base else 'false'}, {k}, '{label}', {t}, string_split('{text}', ' '))" for t, (label, text) in enumerate(templates))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}'), lambda x: x <> '') AS ws FROM documents),
t(base, k, label, t, tw) AS (VALUES {_values(PHRASES, True)}, {_values(NOTICES + LICENSES, False)}),
g AS (SELECT base, k, label, t, len(tw) - k + 1 AS n, unnest(range(len(tw) - k + 1)) AS pos, tw FROM t),
gram AS (SELECT base, k, label, t, n, pos, array_to_string(tw[pos + 1 : pos + k], ' ') AS gram FROM g),
p AS (SELECT r, ws, unnest(range(len(ws))) AS i FROM d),
w AS (SELECT r, i, 2 AS k, array_to_string(ws[i + 1 : i + 2], ' ') AS gram FROM p WHERE i + 2 <= len(ws)
  UNION ALL SELECT r, i, 4, array_to_string(ws[i + 1 : i + 4], ' ') FROM p WHERE i + 4 <= len(ws)),
v AS (SELECT DISTINCT r, base, t, n, label, i - pos AS diagonal, pos FROM w JOIN gram USING (k, gram)),
o AS (SELECT DISTINCT r, base, t, diagonal FROM v),
s AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER x > {SLACK}, true) THEN 1 ELSE 0 END AS opens FROM o WINDOW x AS (PARTITION BY r, base, t ORDER BY diagonal)),
q AS (SELECT r, base, t, diagonal, sum(opens) OVER (PARTITION BY r, base, t ORDER BY diagonal) AS span FROM s),
c AS (SELECT v.r, v.base, v.label, v.n, span, min(v.diagonal) AS start, count(DISTINCT pos) / v.n AS cover FROM v JOIN q ON v.r = q.r AND v.base = q.base AND v.t = q.t AND v.diagonal = q.diagonal GROUP BY v.r, v.base, v.t, v.label, v.n, span),
k AS (SELECT * FROM c WHERE CASE WHEN base THEN cover = 1 ELSE cover >= {LEAST_COVER} END)
SELECT d.doc_id, CAST(len(any_value(ws)) AS BIGINT) AS n_words, CAST(count(*) FILTER (base) AS BIGINT) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(cover), 0.0) AS score
FROM d LEFT JOIN k USING (r) GROUP BY d.r, d.doc_id
"""
