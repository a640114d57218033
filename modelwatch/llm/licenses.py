"""License scan by diagonal voting.

All rolling word k-gram hashes of a document that any template has are joined to the template positions. Each match
votes for a diagonal (document position less template position); neighbouring diagonals of a template are merged,
which bridges inserted or lost words, and a merged span counts if its matched words cover enough of the template.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from modelwatch.llm.common import append_columns, stored
from modelwatch.llm.words import HashSet, fold, gram_hashes, word_hashes

#: Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wordings of public licence notices, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Words of a k-gram; diagonals this close are one span; share of the template that a span must cover.
GRAM, SLACK, COVER = 3, 2, 0.8

_BASE = [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()),
         StructField("last_word", LongType()), StructField("base", ArrayType(StringType()))]
_GRAMS = StructField("grams", ArrayType(StructType([StructField("pos", IntegerType()), StructField("hash", LongType()),
                                                     StructField("gram", StringType())])))


def _scan(templates: tuple):
    wanted = HashSet(np.concatenate([np.empty(0, np.uint64), *(gram_hashes(word_hashes(fold(t.encode())), GRAM)
                                                               for _, t in templates)]))
    phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES]

    def work(texts: list[bytes]) -> list[list]:
        out: list[list] = [[] for _ in range(6)]
        for text in texts:
            words = fold(text)
            line = b" " + b" ".join(words) + b" "
            starts, labels = [], []
            for phrase, label in phrases:
                at = line.find(phrase)
                if at >= 0:
                    labels.append(label)
                done, count = 0, 0
                while at >= 0:
                    count += line.count(b" ", done, at)  # spaces before a word's own: its number
                    done = at
                    starts.append(count)
                    at = line.find(phrase, at + 1)
            hashes = gram_hashes(word_hashes(words), GRAM)
            grams = [(int(p), int(hashes[p].view(np.int64)), b" ".join(words[p:p + GRAM]).decode("utf-8", "replace"))
                     for p in wanted.positions(hashes)]
            for column, value in zip(out, (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                                           sorted(set(labels)), grams)):
                column.append(value)
        return out

    return work


def _template_grams(spark, templates: tuple) -> DataFrame:
    rows = []
    for i, (label, text) in enumerate(templates):
        words = fold(text.encode())
        for p, h in enumerate(gram_hashes(word_hashes(words), GRAM).view(np.int64).tolist()):
            rows.append((i, label, len(words), p, h, b" ".join(words[p:p + GRAM]).decode()))
    return spark.createDataFrame(rows, "template int, label string, length int, at int, hash long, gram string")


def spans(scanned: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(row, template, label, first, last, cover): merged spans of words, from rows (row, grams) of scanned documents.

    The template table is a parameter (a few hundred rows), so it is broadcast.
    """
    table = F.broadcast(_template_grams(scanned.sparkSession, templates))
    votes = (scanned.select("row", F.explode("grams").alias("g")).select("row", "g.*").join(table, ["hash", "gram"])
             .groupBy("row", "template", "label", "length", (F.col("pos") - F.col("at")).alias("diagonal"))
             .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("ats")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int")
    merged = (votes.withColumn("new", F.coalesce(apart, F.lit(0)))
              .withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("row", "template", "label", "length", "span")
              .agg(F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"),
                   F.flatten(F.collect_list("ats")).alias("ats")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + GRAM - 1)))))
    return merged.select("row", "template", "label", "first", "last", (covered / F.col("length")).alias("cover"))


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 with a base phrase, else the largest cover of a template by a span (0 without a match); spans
    that cover at least ``COVER`` add their label. Null texts are empty (no words, empty labels, score 0); ties cannot
    differ (labels are sorted sets); repeated rows and null doc_ids stay rows of their own; an empty table gives no rows.
    """
    scanned = stored(append_columns(docs, partial(_scan, templates), [*_BASE, _GRAMS], keep=["doc_id"])
                     .withColumn("row", F.monotonically_increasing_id()), "licenses")
    verdict = spans(scanned.where(F.size("grams") > 0), templates).groupBy("row").agg(
        F.collect_set(F.when(F.col("cover") >= COVER, F.col("label"))).alias("more"), F.max("cover").alias("cover"))
    none = F.array().cast("array<string>")
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return scanned.drop("grams").join(verdict, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        labels.alias("labels"), score.alias("score"))


def sql(templates: tuple = TEMPLATES) -> str:
    """DuckDB twin of ``scan``."""
    fold = ("regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    grams = f"list_transform(range(1, greatest(len(w) - {GRAM - 2}, 1)), lambda i: {{'p': i - 1, 'g': array_to_string(w[i:i + {GRAM - 1}], ' ')}})"
    texts = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(templates))
    phrases = ", ".join(f"({phrase.split()}, '{label}')" for phrase, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {fold.format('text')} AS w FROM documents),
t AS (SELECT template, label, {fold.format('body')} AS w FROM (VALUES {texts}) v(template, label, body)),
tg AS (SELECT template, label, n, g.p AS place, g.g AS g FROM (SELECT template, label, len(w) AS n, unnest({grams}) AS g FROM t)),
dg AS (SELECT rn, g.p AS p, g.g AS g FROM (SELECT rn, unnest({grams}) AS g FROM d)),
votes AS (SELECT rn, template, label, n, p - place AS diagonal, list(place) AS ats FROM dg JOIN tg USING (g) GROUP BY ALL),
marked AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rn, template ORDER BY diagonal) > {SLACK}, false) AS fresh FROM votes),
spans AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rn, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
cover AS (SELECT rn, label, len(list_distinct(flatten(list_transform(flatten(list(ats)), lambda a: range(a, a + {GRAM}))))) / n::DOUBLE AS c
          FROM spans GROUP BY rn, template, label, n, span),
found AS (SELECT rn, list(DISTINCT label) FILTER (WHERE c >= {COVER}) AS more, max(c) AS c FROM cover GROUP BY rn),
base AS (SELECT rn, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels
         FROM (SELECT rn, x.p - 1 AS p, label FROM (SELECT rn, w, label, words, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'p': i}})) AS x
                                                     FROM d, (VALUES {phrases}) ph(words, label) WHERE list_contains(w, 'license'))
               WHERE w[x.p:x.p + len(words) - 1] = words) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (rn) LEFT JOIN found USING (rn)
"""
