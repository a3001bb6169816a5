"""Licence scan: phrase places, and an exact containment join of text blocks with licence templates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE = r"[\t\n\x0B\f\r ]"
BLOCK_END = rf"\n{SPACE}*\n|(?<=[.!?]){SPACE}+"  # a block is a sentence of a paragraph, over its line ends; it holds all that a line of it holds

#: Phrases of consecutive words and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices by which a text declares its licence.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def phrase_places(words: str, phrase: str) -> str:
    """SQL for the ascending starts (from 0) of a phrase among the words of an array column."""
    parts = phrase.split()
    same = " AND ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(parts))
    return f"CASE WHEN size({words}) >= {len(parts)} THEN filter(sequence(0, size({words}) - {len(parts)}), i -> {same}) ELSE array() END"


def template_sets(docs: DataFrame, templates: Iterable[tuple[str, str]], text_col: str, threshold: float) -> DataFrame:
    """`(template, label, n, need, window, token, seen, at, in_prefix)`: each template's distinct tokens, rarest in the corpus first.

    Frequencies are counted over all words of all texts (only of tokens that a template has), ties by token: one global order for templates and
    blocks. A block that holds `need` = ceil(threshold x n) of n tokens must hold one of the n - need + 1 first: the prefix.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, label, text) for k, (label, text) in enumerate(templates)], "template int, label string, text string")
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), 0)
    window = (F.size(words) + F.ceil(F.size(words) / 4)).cast("int")
    tokens = table.select("template", "label", window.alias("window"), F.explode(F.array_distinct(words)).alias("token"))
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), BETWEEN)).alias("token"))
    counts = words.join(F.broadcast(tokens.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    each = Window.partitionBy("template")
    return (
        tokens.join(counts, "token", "left").na.fill(0, ["seen"])
        .withColumn("n", F.count("*").over(each))
        .withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9)).cast("long"))
        .withColumn("at", F.row_number().over(each.orderBy("seen", "token")) - 1)
        .withColumn("in_prefix", F.col("at") <= F.col("n") - F.col("need"))
        .select("template", "label", "n", "need", "window", "token", "seen", "at", "in_prefix")
    )


def contained(blocks: DataFrame, sets: list, threshold: float, together: bool = False) -> DataFrame:
    """`blocks(block)` -> `(block, labels, containment)` for every block that holds a template's tokens to the threshold, anywhere or `together`.

    `sets` are the rows of `template_sets`. A block keeps its template tokens in the global order. Those meet the templates' prefix tokens; a pair goes on
    if the block has enough of them (length filter) and if, after the first token that both share, both have enough left (positional filter: what
    follows in the shorter rest bounds the overlap). The pair is then verified: the block, or some run of `window` words of it, must hold `need` tokens.
    """
    spark = blocks.sparkSession
    order = {token: k for k, (_, token) in enumerate(sorted({(r["seen"], r["token"]) for r in sets}))}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    index = spark.createDataFrame([(order[r["token"]], r["template"], r["at"], r["n"], r["need"]) for r in sets if r["in_prefix"]], "token int, template int, at long, n long, need long")
    whole: dict[int, dict] = {}
    for r in sets:
        whole.setdefault(r["template"], {"label": r["label"], "window": r["window"], "tokens": []})["tokens"].append(r["token"])
    full = spark.createDataFrame([(k, v["label"], v["window"], v["tokens"]) for k, v in whole.items()], "template int, label string, window int, wanted array<string>")
    words = F.regexp_extract_all("block", F.lit(WORD), 0)
    ordered = blocks.select("block", F.array_sort(F.array_compact(F.transform(F.array_distinct(words), lambda w: F.try_element_at(place, w)))).alias("held"))
    met = ordered.select("block", F.size("held").alias("size"), F.posexplode("held").alias("pos", "token")).join(F.broadcast(index), "token")  # the templates given
    left = 1 + F.least(F.col("n") - F.col("at"), F.col("size") - F.col("pos")) - 1
    pairs = met.where(F.col("size") >= F.col("need")).groupBy("block", "template", "n", "need").agg(F.max(left).alias("most")).where("most >= need")
    run = "transform(filter(sequence(0, size(words) - 1), i -> array_contains(wanted, words[i])), i -> size(array_intersect(slice(words, i + 1, window), wanted)))"
    checked = pairs.join(F.broadcast(full), "template").withColumn("words", words).withColumn("held", F.array_max(F.expr(run)) if together else F.size(F.array_intersect("words", "wanted")))
    return (
        checked.where("held >= need")
        .groupBy("block")
        .agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max(F.col("held") / F.col("n")).alias("containment"))
    )


def scan(docs: DataFrame, phrases: Iterable[tuple[str, str]] = PHRASES, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, n_words, places, phrase_labels, labels, score)` per row, in DataFrame functions only.

    `places` are the ascending word positions of all phrases, `labels` those of the phrases and of every template that a block (a sentence, over
    line ends, or a paragraph without) of the text contains to the threshold, its words within a run a quarter longer than the template; `score` is 1 with a phrase, else the largest containment, else 0. A null text is empty; repeated
    rows each keep a row; null ids stay; other columns are not read. Words are counted in every text; word lists
    and blocks are made only of texts that hold the last word of a phrase or a prefix token of a template. Equal
    blocks are compared once, however many documents share one. The texts are read twice: for the templates' token
    frequencies, and for everything else. An empty table gives no row.
    """
    phrases, templates = list(phrases), list(templates)
    sets = template_sets(docs, templates, text_col, threshold).collect()  # the templates' own tokens
    tokens = sorted({r["token"] for r in sets if r["in_prefix"]})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    asked = sorted({p.split()[-1] for p, _ in phrases})
    some = lambda words: F.greatest(*[low.contains(w) for w in words], F.lit(False), F.lit(False))

    split = F.filter(F.split(ascii_lower(F.col("text")), BLOCK_END), lambda b: F.greatest(*[b.contains(t) for t in tokens], F.lit(False), F.lit(False)))
    marked = rows.withColumn("n_words", F.size(F.array_remove(F.split("text", BETWEEN_ANY_CASE), "")).cast("long")).withColumn("blocks", F.when(some(tokens), split).otherwise(F.array().cast("array<string>")))
    worded = marked.withColumn("words", F.when(some(asked), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), 0)).otherwise(F.array().cast("array<string>")))
    placed = worded.select(
        "doc_id", "n_words", "blocks", F.xxhash64("text").alias("text_hash"),
        *[F.expr(phrase_places("words", p)).cast("array<long>").alias(f"p{k}") for k, (p, _) in enumerate(phrases)],
    )
    named = F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())
    based = placed.select(
        "doc_id", "n_words", "blocks", "text_hash",
        F.array_sort(F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])).alias("places"),
        F.array_sort(F.array_distinct(named)).alias("phrase_labels"),
    )
    based = cut_lineage(based)
    held = based.where(F.size("blocks") > 0).select("doc_id", "text_hash", F.explode(F.array_distinct("blocks")).alias("block"))
    labelled = held.join(cut_lineage(contained(held.select("block").distinct(), sets, threshold, together=True)), "block")  # a block of very many texts is a join Spark can split
    per_doc = labelled.groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("found"), F.max("containment").alias("containment"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    return based.join(per_doc, same, "left").select(
        "doc_id", "n_words", "places", "phrase_labels",
        F.array_sort(F.array_union("phrase_labels", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
