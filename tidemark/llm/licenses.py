"""License scan by diagonal voting.

All rolling word k-gram hashes of a document are joined to the positions of the same k-gram in the templates. A hit votes for its diagonal, word position
in the document less position in the template; a license text that stands in the document shows as a diagonal with many votes. Neighbouring
diagonals, which a left out or added word makes, are merged up to a stated drift, and a merged span is verified by the share of the template that it covers. As
a span is no longer than its template and the drift, what it covers is dense.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import with_shingles

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``phrase``: every place where all words stand consecutively counts, and nothing else does."""

    label: str
    text: str
    phrase: bool = False


# Phrases that must be found, and opening words of public license notices.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by", "this work is licensed under a creative commons attribution international license"),
    Template("cc-by-nc", "licensed under cc by nc"),
)


def positions(docs: DataFrame, templates: tuple[Template, ...], k: int) -> DataFrame:
    """(template, hash, place): where each k-gram stands in the templates. Its size is that of the templates, which are code."""
    rows = docs.sparkSession.createDataFrame([(i, t.text) for i, t in enumerate(templates)], "template int, text string")
    return with_shingles(rows, "text", k, "__words", "__grams", GAP).select("template", F.posexplode("__grams").alias("__place", "__gram"))


def spans(docs: DataFrame, templates: tuple[Template, ...], key: str = "doc_id", text: str = "text", k: int = 2, slack: int = 3, least: float = 0.8) -> DataFrame:
    """One row per verified span: ``__row``, key, ``n_words``, ``template``, ``first``, ``last`` (words from 0), ``coverage``; a row without span for each other document.

    ``__row`` tells rows of the input apart, so null and repeated keys stay rows of their own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    words = with_shingles(rows, "__text", k, "__words", "__grams", GAP)
    grams = words.select("__row", "__key", F.size("__words").cast("long").alias("__n"), F.posexplode_outer("__grams").alias("__pos", "__gram"))
    hits = grams.join(F.broadcast(positions(docs, templates, k)), "__gram", "left").filter(F.col("template").isNotNull() | (F.coalesce("__pos", F.lit(0)) == 0))
    votes = hits.groupBy("__row", "__key", "__n", "template", (F.col("__pos") - F.col("__place")).alias("__diagonal")).agg(
        F.collect_set("__place").alias("__places"), F.min("__pos").alias("__first"), F.max("__pos").alias("__last"))
    exact = F.col("template").isin([i for i, t in enumerate(templates) if t.phrase])
    # A span takes in the diagonals up to ``slack`` beside its first one, so it never drifts further than that and is never longer than its template and ``slack`` words.
    of_one = Window.partitionBy("__row", "template").orderBy("__diagonal")
    near = of_one.rangeBetween(0, slack)

    def merged(one: Column, many: Column) -> Column:
        return F.when(exact, one).otherwise(many)

    size = F.element_at(F.array(*[F.lit(max(1, len(t.text.split()) - k + 1)) for t in templates]), F.col("template") + 1)
    grown = votes.withColumns({"__covered": merged(F.size("__places"), F.size(F.array_distinct(F.flatten(F.collect_list("__places").over(near))))),
                               "first": merged(F.col("__first"), F.min("__first").over(near)), "last": merged(F.col("__last"), F.max("__last").over(near)) + (k - 1)})
    # Of spans that begin on neighbouring diagonals the one that covers most stays, of equals the first.
    before, after = (F.coalesce(F.max("__covered").over(of_one.rangeBetween(*w)), F.lit(0)) for w in ((-slack, -1), (1, slack)))
    best = exact | F.col("template").isNull() | ((F.col("__covered") > before) & (F.col("__covered") >= after)) if slack else F.lit(True)
    groups = grown.withColumn("__best", best).filter("__best").withColumn("coverage", F.col("__covered") / size)
    good = F.col("coverage") >= F.when(exact, F.lit(1.0)).otherwise(F.lit(least))
    return groups.select("__row", F.col("__key").alias(key), F.col("__n").alias("n_words"), "template", "first", "last", "coverage", F.coalesce(good, F.lit(False)).alias("verified"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES, k: int = 2, slack: int = 3, least: float = 0.8) -> DataFrame:
    """One row per input row: words, places of the base phrases, labels, score (the largest share of a template that one span covers, if half or more).

    A null text is an empty one: no words, no labels, score 0. Columns of the input other than key and text are not read.
    """
    templates = (*phrases, *notices)
    found = spans(docs, templates, key, text, k, slack, least)
    base = F.col("verified") & (F.col("template") < len(phrases))
    name = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)

    def labels(which):
        return F.array_join(F.sort_array(F.collect_set(F.when(which, name))), ",")

    out = found.groupBy("__row", key, "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("verified")).alias("labels"), F.max(F.when(F.col("verified") | (~F.col("template").isin(list(range(len(phrases)))) & (F.col("coverage") >= 0.5)), F.col("coverage"))).alias("score"))
    return out.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("n_words", F.col("n_words").cast("long")).drop("__row")
