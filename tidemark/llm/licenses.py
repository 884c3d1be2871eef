"""License scans by diagonal voting: word k-grams met with template positions, aggregated by offset diagonal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import stage

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
NEIGHBOUR = 3  # diagonals this near are merged: words put in or left out
COVER = 0.6  # share of a template's k-grams that a span must hold to count

# The base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices of public licenses, in the words of the licenses.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)


def words_of(text: Column) -> Column:
    """Words of the whole text after lower-casing A-Z; none for null."""
    cut = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), *LOWER), SEPARATORS, -1)
    return F.array_remove(cut, "")


def _grams(words: Column, k: int) -> Column:
    """Array of the k words from each place on; null where fewer are left."""
    return F.arrays_zip(*[F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{i}") for i in range(k)])


def template_grams(spark: SparkSession, phrases: tuple = PHRASES, notices: tuple = NOTICES, k: int = K) -> DataFrame:
    """(template, base, label, n_template, gram, at, hash): one row for each k-gram of each template; a few hundred rows."""
    rows = []
    for t, (text, label, base) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words at least: {text}")
        rows += [(t, base, label, len(words), " ".join(words[i:i + k]), i) for i in range(len(words) - k + 1)]
    frame = spark.createDataFrame(rows, "template int, base boolean, label string, n_template int, gram string, at int")
    return frame.withColumn("hash", F.xxhash64("gram"))


def gram_votes(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, k: int = K) -> DataFrame:
    """(row, doc_id, n_words, template, base, label, n_grams, place, at, diagonal) of every vote.

    A word k-gram whose hash and words equal those of a template position votes for the diagonal, its place
    in the text less its place in the template. Each row of docs also has one row here without a vote (its
    first place), so one pass over the texts serves both. Only votes and these rows are ever shuffled.
    """
    read = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        words_of(F.col("text")).alias("words"),
    )
    placed = read.select(
        "row", "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.posexplode_outer(_grams(F.col("words"), k)).alias("place", "g"),
    )
    gram = F.when(F.col(f"g.w{k - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"g.w{i}") for i in range(k)]))
    grams = placed.select("row", "doc_id", "n_words", F.coalesce("place", F.lit(0)).alias("place"), gram.alias("words"))
    templates = F.broadcast(template_grams(docs.sparkSession, phrases, notices, k))  # as many rows as the templates have words
    met = grams.join(templates, (F.xxhash64("words") == F.col("hash")) & (F.col("words") == F.col("gram")), "left")
    return met.where("at is not null or place = 0").select(
        "row", "doc_id", "n_words", "template", "base", "label", (F.col("n_template") - k + 1).alias("n_grams"),
        "place", "at", (F.col("place") - F.col("at")).alias("diagonal"),
    )


def license_spans(votes: DataFrame, k: int = K, neighbour: int = NEIGHBOUR, cover: float = COVER) -> DataFrame:
    """(row, template, base, label, start, stop, score): the verified spans, words from 0, stop exclusive.

    Votes of a template on diagonals at most `neighbour` apart (words put in or left out), and at most a
    template's length apart in the text, are one span. It counts when it holds `cover` of the template's
    k-grams; score is that share. A base phrase counts only on a single diagonal with all its k-grams,
    that is, where its words stand consecutively.
    """
    votes = votes.where("template is not null")
    diagonals = votes.groupBy("row", "template", "base", "label", "n_grams", "diagonal").agg(
        F.collect_set("at").alias("ats"), F.min("place").alias("start"), (F.max("place") + k).alias("stop")
    )  # a set of places in a template: as long as the template at most
    exact = diagonals.where("base").where(F.size("ats") == F.col("n_grams")).select(
        "row", "template", "base", "label", "start", "stop", F.lit(1.0).alias("score")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > neighbour, F.lit(True))
    runs = diagonals.where("not base").withColumn("run", F.sum(new.cast("int")).over(order))
    merged = runs.groupBy("row", "template", "base", "label", "n_grams", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("start").alias("start"), F.max("stop").alias("stop")
    )
    score = F.size("ats") / F.col("n_grams")
    near = merged.where(score >= cover).select("row", "template", "base", "label", "start", "stop", score.alias("score"))
    return exact.unionByName(near)


def license_scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES, k: int = K,
                 neighbour: int = NEIGHBOUR, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs (doc_id, text).

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest of
    their starts (null without any), labels are distinct, sorted and comma-joined ('' without any), score is
    the best share of a template's k-grams that a span holds, 0 without a span.

    Null and empty texts have no words and no labels. Repeated rows are scanned each; a null doc_id stays
    null. Other columns of docs are not read. No rows in, no rows out.
    """
    votes = stage(gram_votes(docs, phrases, notices, k), "license-votes")
    spans = license_spans(votes, k, neighbour, cover).groupBy("row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    rows = votes.select("row", "doc_id", "n_words").distinct()
    return rows.join(spans, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
