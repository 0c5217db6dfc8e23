"""License scans by diagonal voting: word trigrams of documents vote for offsets of license texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm.common import lower_ascii, table
from roostline.llm.decontamination import WORD, words
from roostline.session import staged

GRAM = 3
# Votes whose offsets differ by this many words at most belong to one occurrence: so many words may be put in or left out.
SHIFT = 5
# The part of a template's words that an occurrence must cover.
COVERED = 0.8

# Phrases that settle a license by themselves.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Passages of license texts and notices. What stands in brackets must be there whatever else is covered.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version [2 0] the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation"),
    ("gpl-2", "under the gnu general public license [version 2]"),
    ("gpl-3", "under the gnu general public license [version 3]"),
    ("lgpl-3", "under the gnu [lesser] general public license [version 3]"),
    ("agpl-3", "under the gnu [affero] general public license [version 3]"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v [2 0] if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons [attribution 4 0] international license"),
    ("cc-by-sa", "this work is licensed under a creative commons [attribution sharealike 4 0] international license"),
    ("cc-by-nc", "this work is licensed under a creative commons [attribution noncommercial 4 0] international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]


def _needed(text: str) -> list[int]:
    """Places of the words in brackets."""
    out, inside = [], False
    for i, word in enumerate(text.split()):
        inside = inside or word.startswith("[")
        if inside:
            out.append(i)
        inside = inside and not word.endswith("]")
    return out


def _rows() -> list[tuple[str, bool, str, list[int]]]:
    """(label, is a base phrase, words, places that must be covered) of each template; its number is its place here."""
    base = [(label, True, text, list(range(len(text.split())))) for label, text in BASE]
    return base + [(label, False, re.sub(r"[\[\]]", "", text), _needed(text)) for label, text in TEMPLATES]


def _grams(some_words: Column) -> Column:
    """One 64-bit name for each three consecutive words. Word hashes are bound to a lambda variable and computed once."""

    def names(h: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)])
        return F.when(F.size(h) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), one))

    return F.transform(F.array(F.transform(some_words, lambda w: F.xxhash64(w))), names)[0]


def template_grams(spark: SparkSession) -> DataFrame:
    """One row per trigram of each template: name, gram (its words), template, tpos, and the template's label, base, size, needs."""
    each = [
        F.struct(
            F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text"),
            F.array(*[F.lit(n) for n in needs]).cast("array<int>").alias("needs"),
        )
        for i, (label, base, text, needs) in enumerate(_rows())
    ]
    known = spark.range(1).select(F.inline(F.array(*each))).withColumn("w", words(F.col("text")))
    cut = known.select("template", "label", "base", "needs", "w", F.posexplode(_grams(F.col("w"))).alias("tpos", "name"))
    gram = F.array_join(F.slice("w", F.col("tpos") + 1, F.lit(GRAM)), " ")
    return cut.select("name", gram.alias("gram"), "template", "tpos", "label", "base", F.size("w").alias("size"), "needs")


KEY = ["no_id", "id", "one", "two"]


def _key() -> list[Column]:
    """What tells documents apart: the id and 128 bits of hashes of the text; rows that agree in both are one document."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    hashes = [F.xxhash64(F.lit(seed), text).alias(name) for seed, name in ((1, "one"), (2, "two"))]
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), *hashes]


def votes(docs: DataFrame) -> DataFrame:
    """For each document, template and diagonal (word offset of the document less that of the template): the trigrams that agree."""
    known = F.broadcast(template_grams(docs.sparkSession))  # a few hundred rows, a constant
    keyed = docs.select(*_key(), words(F.col("text")).alias("_w")).withColumn("_names", _grams(F.col("_w")))
    # The outer form: with the inner one the optimizer would compute the names once more, as a filter.
    each = keyed.select(*KEY, "_w", F.posexplode_outer("_names").alias("at", "name"))
    hit = each.join(known, "name").where(F.array_join(F.slice("_w", F.col("at") + 1, F.lit(GRAM)), " ") == F.col("gram"))
    diagonal = (F.col("at") - F.col("tpos")).alias("diagonal")
    kept = ["template", "label", "base", "size", "needs"]
    return hit.select(*KEY, *kept, diagonal, "tpos").groupBy(*KEY, *kept, "diagonal").agg(F.collect_set("tpos").alias("seen"))


def _places(seen: Column) -> Column:
    """Word places of the template that some trigrams cover."""
    return F.array_distinct(F.flatten(F.transform(seen, lambda p: F.sequence(p, p + (GRAM - 1)))))


def occurrences(voted: DataFrame) -> DataFrame:
    """Occurrences of templates: document key, label, base, start, end (words of the document) and coverage (0 to 1).

    Diagonals of one document and template that are at most ``SHIFT`` apart are merged. ``coverage`` is the part of the
    template's words that stand in the document in trigrams of the merged diagonals; whether an occurrence counts
    (``whole``) also depends on the words that must be there.
    """
    own = [*KEY, "template"]
    order = Window.partitionBy(*own).orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal", 1).over(order) > SHIFT).cast("int")
    grouped = voted.withColumn("part", F.sum(F.coalesce(fresh, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    covered = _places(F.col("seen"))
    ends = {"start": F.min(F.col("diagonal") + F.array_min("seen")), "end": F.max(F.col("diagonal") + F.array_max("seen") + GRAM)}
    merged = grouped.groupBy(*own, "label", "base", "size", "needs", "part").agg(
        F.array_distinct(F.flatten(F.collect_list(covered))).alias("covered"), *[c.alias(n) for n, c in ends.items()]
    )
    coverage = F.size("covered") / F.col("size")
    whole = (coverage >= COVERED) & (F.size(F.array_except("needs", "covered")) == 0)
    return merged.select(*KEY, "label", "base", "start", "end", coverage.alias("coverage"), whole.alias("whole"))


def license_spans(docs: DataFrame) -> DataFrame:
    """Every occurrence of a license in ``docs`` (doc_id, text): doc_id, label, start, end (words from 0, end excluded), coverage."""
    found = occurrences(votes(docs)).where("whole")
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "label", "start", "end", "coverage")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are lower-cased runs of letters and digits. Base places are those where all words of a base phrase stand
    consecutively: diagonals with all its trigrams. ``labels`` adds those of the templates that are covered to 0.8;
    ``score`` is the best coverage of any template, 0 without any. Whole texts are read. Null and empty texts have no
    words and no labels; rows equal in id and text get equal results; an empty table gives no rows; other columns
    of ``docs`` are not looked at.
    """
    voted = staged(votes(docs), "license-votes")
    place = voted.where(F.col("base") & (F.size("seen") == F.col("size") - (GRAM - 1)))
    base = place.groupBy(*KEY).agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("bigint").alias("first_word"), F.max("diagonal").cast("bigint").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    own = occurrences(voted).groupBy(*KEY).agg(F.max("coverage").alias("score"), F.collect_set(F.when(F.col("whole"), F.col("label"))).alias("set"))
    found = own.join(base, KEY, "left")
    count = F.coalesce(F.regexp_count(lower_ascii(F.col("text")), F.lit(WORD)), F.lit(0)).cast("bigint")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_key(), count.alias("n_words"))
    none = F.array().cast("array<string>")
    listed = lambda *sets: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(s, none) for s in sets]))), ",")
    return slim.join(found, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        listed(F.col("base_set")).alias("base_labels"), listed(F.col("base_set"), F.col("set")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return report(table(spark, folder, "documents").select("doc_id", "text"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH template(template, label, base, w, needs) AS (
  VALUES {", ".join(f"({i}, '{label}', {base}, string_split('{text}', ' '), {needs}::INT[])" for i, (label, base, text, needs) in enumerate(_rows()))}),
tgram AS (SELECT template, label, base, len(w) AS size, needs, i - 1 AS tpos, array_to_string(w[i:i + 2], ' ') AS gram
          FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM template)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
spot AS (SELECT rid, i - 1 AS place, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM doc)),
vote AS (SELECT rid, template, label, base, size, needs, place - tpos AS diagonal, list(DISTINCT tpos) AS seen FROM spot JOIN tgram USING (gram) GROUP BY ALL),
fresh AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {SHIFT} THEN 0 ELSE 1 END AS f FROM vote),
part AS (SELECT *, sum(f) OVER (PARTITION BY rid, template ORDER BY diagonal) AS part FROM fresh),
covered AS (SELECT rid, template, label, size, needs, part, list(DISTINCT p) AS c
            FROM (SELECT rid, template, label, size, needs, part, s + k AS p
                  FROM (SELECT rid, template, label, size, needs, part, unnest(seen) AS s FROM part), (VALUES (0), (1), (2)) AS t(k))
            GROUP BY ALL),
found AS (SELECT rid, label, len(c) / size AS coverage, len(c) / size >= {COVERED} AND list_has_all(c, needs) AS whole FROM covered),
own AS (SELECT rid, max(coverage) AS score, list(DISTINCT label) FILTER (WHERE whole) AS labels FROM found GROUP BY rid),
base AS (SELECT rid, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS labels
         FROM vote WHERE base AND len(seen) = size - 2 GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(own.labels, []))), ',') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM doc LEFT JOIN own USING (rid) LEFT JOIN base USING (rid)
"""
