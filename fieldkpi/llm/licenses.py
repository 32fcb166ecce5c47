"""License scan: diagonal voting of word k-grams against template texts.

Texts are cut into words, all rolling k-word hashes are joined to the positions of the
same k words in the templates, and every hit votes for its diagonal (position in the
text less position in the template). Votes are counted per text, template and diagonal
before anything is shuffled; diagonals a few words apart (words put in or left out) are
one span. A hit counts only if its k words equal the template's, not merely their hash,
and a span holds if enough of the template's words are covered so, its telling phrase
among them.

Votes are keyed by two 64-bit hashes of the text, so copies of one text vote once: a
text that is a third of all rows is one group of one text's votes. A diagonal's votes
are a set of template positions, at most as many as the template has words.

Cases: a null or empty text has no words, no labels and score 0; texts of any length
are scanned whole; rows without id or with a shared id are judged by their own text;
equal rows get equal results; an empty table gives an empty result; extra columns, of
any name, are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldkpi.llm.common import lower_ascii, text_or_empty

GRAM = 4
GAP = 4  # words put in or left out between neighbouring diagonals of one span
LEAST_SHARE = 0.6
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license by themselves.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)


class Template(NamedTuple):
    label: str
    telling: str  # words that must be covered
    text: str


# Fixed texts: the usual notices and first paragraphs of public licenses.
TEMPLATES = (
    Template("mit", "mit license", "released under the MIT License"),
    Template(
        "mit",
        "permission is hereby granted free of charge",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions",
    ),
    Template("apache", "apache license", "licensed under the Apache License, Version 2.0"),
    Template(
        "apache",
        "you may not use this file except in compliance",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at",
    ),
    Template(
        "gpl",
        "gnu general public license",
        "this work is licensed under the GNU General Public License, version 3",
    ),
    Template(
        "gpl",
        "gnu general public license",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    Template(
        "lgpl",
        "gnu lesser general public license",
        "This library is free software; you can redistribute it and/or modify it under the "
        "terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    Template(
        "agpl",
        "gnu affero general public license",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    Template(
        "mpl",
        "mozilla public license",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    Template(
        "isc",
        "for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ),
    Template(
        "unlicense",
        "free and unencumbered software",
        "This is free and unencumbered software released into the public domain",
    ),
    Template("cc-by-nc", "cc by nc", "licensed under CC BY-NC 4.0"),
    Template(
        "cc-by-sa",
        "creative commons attribution sharealike",
        "this work is licensed under the Creative Commons Attribution-ShareAlike 4.0 "
        "International License",
    ),
)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), APART), "")


def rolling_grams(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """``columns`` with ``pos, gram, tuple``: each k words in a row of ``words`` and their
    hash. The array is slid against itself, so all is compiled; no step runs per word."""
    n = F.size("words") - (k - 1)
    slid = F.arrays_zip(*[F.slice("words", j + 1, n).alias(f"w{j}") for j in range(k)])
    cut = rows.where(F.size("words") >= k).select(*columns, F.posexplode(slid).alias("pos", "tuple"))
    return cut.withColumn("gram", F.xxhash64(*[F.col("tuple")[f"w{j}"] for j in range(k)]))


def template_grams(
    spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES, k: int = GRAM
) -> DataFrame:
    """Rows ``template, tpos, gram, ttuple``: one per k words of each template."""
    given = F.array(
        *[
            F.struct(F.lit(i).alias("template"), F.lit(t.text).alias("text"))
            for i, t in enumerate(templates)
        ]
    )
    cut = spark.range(1).select(F.inline(given))
    cut = cut.select("template", words_of(F.col("text")).alias("words"))
    return rolling_grams(cut, k, "template").select(
        "template", F.col("pos").alias("tpos"), "gram", F.col("tuple").alias("ttuple")
    )


def _template_facts(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """Rows ``template, label, length, telling``: ``telling`` holds the positions that must
    be covered."""
    facts = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("template"),
                        F.lit(t.label).alias("label"),
                        F.lit(t.text).alias("text"),
                        F.lit(t.telling).alias("phrase"),
                    )
                    for i, t in enumerate(templates)
                ]
            )
        )
    )
    facts = facts.select(
        "template", "label", words_of(F.col("text")).alias("w"), words_of(F.col("phrase")).alias("p")
    )
    at = F.filter(
        F.sequence(F.lit(0), F.size("w") - F.size("p")),
        lambda i: F.slice(F.col("w"), i + 1, F.size("p")) == F.col("p"),
    )[0]
    return facts.select(
        "template",
        "label",
        F.size("w").alias("length"),
        F.sequence(at, at + F.size("p") - 1).alias("telling"),
    )


def document_words(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, k1, k2, words``, one per document; the keys are hashes of the text."""
    text = text_or_empty()
    keyed = docs.select(
        "doc_id",
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second key"), text).alias("k2"),
        words_of(text).alias("words"),
    )
    # A generator between keeps the cutting into words out of later expressions.
    return keyed.select("doc_id", "k1", "k2", F.explode(F.array("words")).alias("words"))


def license_spans(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = GRAM
) -> DataFrame:
    """Rows ``k1, k2, template, label, first_word, last_word, share, diagonals``: spans of
    the different texts in which a template is verified. A span that reaches over more than
    twice the template's words is judged by its best diagonal alone."""
    spark = docs.sparkSession
    grams = rolling_grams(document_words(docs), k, "k1", "k2")
    # Both sides of the product of positions are hashes that agree; the templates are
    # fixed text, so their grams are of known size.
    hits = (
        grams.join(F.broadcast(template_grams(spark, templates, k)), "gram")
        .where(F.col("tuple") == F.col("ttuple"))
        .select("k1", "k2", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos")
    )
    votes = hits.groupBy("k1", "k2", "template", "diagonal").agg(
        F.collect_set("tpos").alias("at")
    )
    along = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    before = F.lag("diagonal").over(along)
    chained = votes.withColumn(
        "new", F.when(F.col("diagonal") - before <= GAP, 0).otherwise(1)
    ).withColumn("span", F.sum("new").over(along))

    def covered(at: Column) -> Column:
        return F.array_distinct(
            F.flatten(F.transform(at, lambda t: F.sequence(t, t + k - 1)))
        )

    spans = (
        chained.groupBy("k1", "k2", "template", "span")
        .agg(
            F.min(F.col("diagonal") + F.array_min("at")).alias("first_word"),
            F.max(F.col("diagonal") + F.array_max("at") + k - 1).alias("last_word"),
            F.array_distinct(F.flatten(F.collect_set("at"))).alias("all"),
            F.max_by("at", F.struct(F.size("at"), -F.col("diagonal"))).alias("best"),
            F.count(F.lit(1)).alias("diagonals"),
        )
        .join(F.broadcast(_template_facts(spark, templates)), "template")
    )
    tight = F.col("last_word") - F.col("first_word") < 2 * F.col("length")
    judged = spans.withColumn("words", covered(F.when(tight, F.col("all")).otherwise(F.col("best"))))
    return (
        judged.withColumn("share", F.size("words") / F.col("length"))
        .where(F.col("share") >= LEAST_SHARE)
        .where(F.size(F.array_except("telling", "words")) == 0)
        .select("k1", "k2", "template", "label", "first_word", "last_word", "share", "diagonals")
    )


def _phrase_starts(words: Column, phrase: str, ends: Column) -> Column:
    """Of the places where a phrase's last word stands, the starts of the whole phrase."""
    parts = phrase.split(" ")
    n = len(parts)
    wanted = F.array(*[F.lit(p) for p in parts])
    starts = F.transform(ends, lambda i: i - (n - 1))
    return F.filter(
        starts,
        lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, n) == wanted),
    )


def license_report(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    k: int = GRAM,
) -> DataFrame:
    """Rows ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``,
    one per document. The score is 1 where a phrase stands, else the largest verified
    share of a template."""
    words = F.col("words")
    rows = document_words(docs)
    lasts = sorted({p.rsplit(" ", 1)[-1] for p, _ in phrases})
    for i, last in enumerate(lasts):
        marked = F.transform(words, lambda w, at: F.when(w == last, at))
        rows = rows.withColumn(f"ends{i}", F.filter(marked, lambda at: at.isNotNull()))
    rows = rows.select(
        "doc_id",
        "k1",
        "k2",
        F.size("words").cast("long").alias("n_words"),
        *[
            _phrase_starts(words, p, F.col(f"ends{lasts.index(p.rsplit(' ', 1)[-1])}")).alias(f"at{i}")
            for i, (p, _) in enumerate(phrases)
        ],
    )
    places = F.flatten(F.array(*[F.col(f"at{i}") for i in range(len(phrases))]))
    named = F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(t)) for i, (_, t) in enumerate(phrases)])
    rows = rows.select(
        "doc_id",
        "k1",
        "k2",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(named))).alias("base"),
    )
    found = (
        license_spans(docs, templates, k)
        .groupBy("k1", "k2")
        .agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    )
    both = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0))
        .otherwise(F.coalesce("share", F.lit(0.0)))
        .alias("score"),
    )
