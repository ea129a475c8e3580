"""Licence scans by diagonal voting, with DataFrame functions only.

All rolling word k-grams of a document are joined by hash to their positions in licence
templates. A hit at word ``at`` of the document and ``t`` of a template votes for the
diagonal ``at - t``; a copied template piles its votes on one diagonal, an inserted or
lost word moves the rest to a neighbour. Votes are summed by diagonal, neighbouring
diagonals merged to spans, and a span stands if the template words it covers, verified
word by word, are enough of the template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.decontamination import gram_hashes, let, row_name, words
from hushframe.llm.tables import staged

GRAM = 3  # words; shorter phrases are one gram
NEIGHBOUR = 3  # words that may be inserted or lost between merged diagonals
COVERED = 0.9  # of a template's words, for a span to stand

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms "
    "of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "free and unencumbered software released into the public domain": "unlicense",
}
RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _templates(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """``tid, base, label, size, t, k, gram, hash``: each gram of each template."""
    rows = [(True, p, label) for p, label in phrases.items()]
    rows += [(False, p, label) for p, label in templates.items()]
    values = F.array(*[
        F.struct(F.lit(i).alias("tid"), F.lit(b).alias("base"), F.lit(x).alias("label"), F.split(F.lit(p), " ").alias("w"))
        for i, (b, p, x) in enumerate(rows)
    ])
    k = F.least(F.size("w"), F.lit(GRAM))
    by_size = F.when(F.size("w") >= 3, gram_hashes(F.col("w"), 3)).when(
        F.size("w") == 2, gram_hashes(F.col("w"), 2)
    ).otherwise(gram_hashes(F.col("w"), 1))
    return (
        spark.range(1)
        .select(F.inline(values))
        .select("tid", "base", "label", "w", F.size("w").alias("size"), k.alias("k"), F.posexplode(by_size).alias("t", "hash"))
        .withColumn("gram", F.array_join(F.slice("w", F.col("t") + 1, F.col("k")), " "))
        .drop("w")
    )


def _hits(docs: DataFrame, grams: DataFrame, short_heads: dict[int, list[str]]) -> DataFrame:
    """``doc, at, hash``: the places of documents whose gram hash a template has.

    The grams of ``GRAM`` words come first in one array; behind them, for phrases that are
    shorter, the hashes of places that begin with the first word of one, else null.
    """

    def beginning(w, k: int, heads: list[str]):
        starts = F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(0)))

        def hashed(x, i):
            return F.when(x.isin(heads), F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))

        return F.transform(starts, hashed)

    def all_grams(w):
        parts = [gram_hashes(w, GRAM)] + [beginning(w, k, h) for k, h in sorted(short_heads.items())]
        return F.struct(F.size(w).alias("n"), F.concat(*parts).alias("h"))

    read = docs.select("doc", F.inline(F.array(let(words("text"), all_grams))))
    places = read.select("doc", "n", F.posexplode("h").alias("p", "hash"))
    # Where the array's part for the grams of k words begins.
    at = F.col("p")
    begin = F.greatest(F.col("n") - (GRAM - 1), F.lit(0))
    for k in sorted(short_heads):
        width = F.greatest(F.col("n") - (k - 1), F.lit(0))
        at = F.when(F.col("p") >= begin, F.col("p") - begin).otherwise(at)
        begin = begin + width
    hashes = grams.select("hash").distinct()
    return places.join(hashes, "hash", "left_semi").select("doc", at.alias("at"), "hash")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are the
    least and greatest start (null without one). ``labels`` adds those of templates with
    a standing span to those of phrases; both are sorted arrays. ``score`` is the largest
    covered part of a template, 1 for a phrase, 0 for none. Null texts have no words;
    repeated rows each give their row; null ids are kept; an empty table gives an empty
    result. Other columns are not read.
    """
    if len(phrases) + len(templates) > 10_000:
        raise ValueError("templates are sent to every task: 10,000 at most")
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_name(id_col, text_col).alias("doc"))
    grams = _templates(spark, phrases, templates)
    short: dict[int, list[str]] = {}
    for p in [*phrases, *templates]:
        w = p.split(" ")
        if len(w) < GRAM:
            short.setdefault(len(w), []).append(w[0])
    # At most a few grams a template: bounded by the check above.
    hits = staged(_hits(named, F.broadcast(grams), short), "hits")
    verified = staged(_verified(named, hits, F.broadcast(grams)), "votes")

    base = (
        verified.where("base")
        .groupBy("doc")
        .agg(
            F.count("*").alias("n_base"), F.min("at").cast("long").alias("first_word"),
            F.max("at").cast("long").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_labels"),
        )
    )
    spans = _spans(verified.where("not base"))
    stands = F.when(F.col("covered") >= COVERED, F.col("label"))
    more = spans.groupBy("doc").agg(F.collect_set(stands).alias("more"), F.max("covered").alias("most"))
    found = staged(base.join(more, "doc", "full"), "labels")
    none = F.array().cast("array<string>")
    pieces = F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    based = F.coalesce("base_labels", none)
    return (
        named.select("id", "doc", F.size(F.array_remove(pieces, "")).cast("long").alias("n_words"))
        .join(found, "doc", "left")
        .select(
            F.col("id").alias(id_col), "n_words",
            F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
            based.alias("base_labels"),
            F.array_sort(F.array_union(based, F.coalesce("more", none))).alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
        )
    )


def _verified(docs: DataFrame, hits: DataFrame, grams: DataFrame) -> DataFrame:
    """``doc, at, tid, base, label, size, t, k``: hits whose words are the template's."""
    places = hits.groupBy("doc").agg(F.collect_set(F.struct("at", "hash")).alias("places"))
    met = docs.join(places, "doc").select("doc", F.explode(F.array(words("text"))).alias("w"), "places")
    written = F.transform(
        "places",
        lambda p: F.struct(
            p["at"].alias("at"), p["hash"].alias("hash"),
            F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.array_join(F.slice(F.col("w"), p["at"] + 1, k), " ")).alias("text"),
        ),
    )
    return (
        met.select("doc", F.inline(written))
        .join(grams, "hash")
        .where(F.element_at("text", F.col("k")) == F.col("gram"))
        .select("doc", "at", "tid", "base", "label", "size", "t", "k")
        .distinct()  # equal rows have the same votes
    )


def _spans(votes: DataFrame) -> DataFrame:
    """``doc, label, first, last, covered``: merged neighbouring diagonals."""
    diagonals = votes.withColumn("diagonal", F.col("at") - F.col("t")).groupBy("doc", "tid", "diagonal").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.min("at").alias("first"),
        F.max(F.col("at") + F.col("k")).alias("last"),
        F.array_distinct(F.flatten(F.collect_list(F.sequence("t", F.col("t") + F.col("k") - 1)))).alias("words"),
    )
    gap = "diagonal - lag(diagonal) over (partition by doc, tid order by diagonal)"
    begins = diagonals.withColumn("begins", F.coalesce((F.expr(gap) > NEIGHBOUR).cast("int"), F.lit(1)))
    number = F.expr("sum(begins) over (partition by doc, tid order by diagonal)")
    return (
        begins.withColumn("span", number)
        .groupBy("doc", "tid", "span")
        .agg(
            F.first("label").alias("label"), F.first("size").alias("size"), F.min("first").alias("first"),
            F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"),
        )
        .select("doc", "label", "first", "last", (F.size("words") / F.col("size")).alias("covered"))
    )
