"""License scans by diagonal voting, with DataFrame operations only.

Every run of ``K`` words of every text is joined to the places it has in the
license templates (a fixed table in this module).  A run at word p that is at
word t of a template votes for the diagonal p - t.  Votes are added up by
diagonal; neighbouring diagonals, as words added or left out make them, are
merged into one span; a span counts if enough of the template's runs are in it.
The join compares the words themselves after their hashes, so every vote is
verified.  A phrase stands at a place exactly if all its runs vote for one
diagonal.

Only votes and one row per document are shuffled.  A document's rows are held
under its id and a hash of its text.

Defined results: a null text has no words; texts of fewer than ``K`` words have
no runs; rows that repeat id and text repeat the result; null ids are ids like
any other; an empty table gives an empty result; other columns are left out, whatever
their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Neighbouring diagonals, and words between two votes, that one span may have.
DRIFT, GAP = 2, 6
#: Copies of a row that are made at once.
LOT = 10_000
#: Least share of a template's runs in a span that earns its label.
LEAST = 0.75

# Phrases that count wherever their words stand in a row.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Wordings of public licenses.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters outside words; all become blanks.
_APART = "".join(chr(c) for c in range(128) if not re.match("[0-9A-Za-z]", chr(c)))


def template_rows() -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, is a phrase, its number of runs, place of the run, its words)."""
    out = []
    for k, (label, text, phrase) in enumerate([(a, b, True) for a, b in PHRASES] + [(a, b, False) for a, b in TEMPLATES]):
        ws = re.findall("[0-9a-z]+", text.lower())
        runs = len(ws) - K + 1
        out += [(k, label, phrase, runs, t, " ".join(ws[t : t + K])) for t in range(runs)]
    return out


def words(text: Column) -> Column:
    """Words of a text, ASCII letters lower-cased; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _APART, _UPPER.lower() + " " * len(_APART))
    return F.array_remove(F.split(spaced, " "), "")


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(template_rows(), "template int, label string, phrase boolean, runs int, t int, run string")
    # The row under hash 0 meets the one row of each document that carries its number of words.
    rows = rows.withColumn("hash", F.xxhash64("run")).unionByName(spark.createDataFrame([(-1, "", False, 0, 0, "", 0)], "template int, label string, phrase boolean, runs int, t int, run string, hash long"))
    return F.broadcast(rows)  # a fixed table of a few hundred short rows


def votes(docs: DataFrame) -> DataFrame:
    """Votes of ``docs(doc_id, text)``: (doc_id, text_hash, template, label, phrase, runs,
    t, p); template -1 stands for the document itself and has its number of words as p."""
    split = docs.select("doc_id", F.xxhash64(F.lit(1), "text").alias("text_hash"), words(F.col("text")).alias("w"))
    run = lambda w, i: F.concat_ws(" ", w, *(F.get(F.col("w"), i + j) for j in range(1, K)))
    runs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - (K - 1), F.lit(0))), run)
    total = F.array(F.concat(F.lit("\x00"), F.size("w").cast("string")))
    rows = split.select("doc_id", "text_hash", F.posexplode(F.concat(total, runs)).alias("p", "words"))
    rows = rows.withColumn("hash", F.when(F.col("p") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("words")))
    met = rows.join(_templates(docs.sparkSession), "hash").where((F.col("template") < 0) | (F.col("words") == F.col("run")))
    p = F.when(F.col("template") < 0, F.substring("words", 2, 20).cast("long")).otherwise(F.col("p") - 1)
    return met.select("doc_id", "text_hash", "template", "label", "phrase", "runs", "t", p.cast("long").alias("p"))


def spans(votes: DataFrame) -> DataFrame:
    """Merged spans: (doc_id, text_hash, template, label, phrase, n, first, last, score, copies).

    A phrase's span is one diagonal.  ``n`` is the number of words for template -1; there
    ``copies`` is how often the row was in the table."""
    key = ["doc_id", "text_hash", "template"]
    info = [F.first(c).alias(c) for c in ("label", "phrase", "runs")]
    lines = votes.groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal")).agg(*info, F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("t").alias("ts"), F.count("*").alias("copies"))
    order = Window.partitionBy(*key).orderBy("first", "diagonal")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    drift = F.abs(F.col("diagonal") - F.lag("diagonal").over(order))
    apart = F.col("phrase") | reached.isNull() | (drift > DRIFT) | (F.col("first") - reached > GAP)
    lines = lines.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.size(F.array_distinct(F.flatten(F.collect_list("ts"))))
    merged = lines.groupBy(*key, "span").agg(*info, F.min("first").alias("first"), F.max("last").alias("last"), seen.alias("seen"), F.max("copies").alias("copies"))
    return merged.withColumn("score", F.when(F.col("runs") > 0, F.col("seen") / F.col("runs")).otherwise(F.lit(0.0)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row for each document: n_words, n_base, first_word, last_word, base_labels, labels, score,
    and ``spans``, the accepted (label, first word, end, score)."""
    found = spans(votes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    own = F.col("template") < 0
    base = F.col("phrase") & (F.col("score") >= 1)
    good = base | (~own & ~F.col("phrase") & (F.col("score") >= least))
    span = F.struct("label", "first", (F.col("last") + K).alias("end"), "score")
    by_doc = found.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(own, F.col("first"))).alias("n_words"),
        F.max(F.when(own, F.col("copies"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base | (~own & ~F.col("phrase")), F.col("score"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(good, span))).alias("spans"),
    )
    # A row for each copy, in two steps, so that no array is as long as there are copies.
    rows = by_doc.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LOT))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(LOT).cast("long"), F.col("copies") - F.col("lot") * LOT))))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def oracle(table: str = "documents") -> str:
    """The digest of ``scan`` (without spans) as SQL for DuckDB."""
    rows = ", ".join(f"({k}, '{a}', {str(p).lower()}, {n}, {t}, '{w}')" for k, a, p, n, t, w in template_rows())
    return f"""with t(template, label, phrase, runs, t, run) as (values {rows}),
    w as (select row_number() over () as uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}),
    g as (select uid, p - 1 as p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as run from (select uid, w, unnest(range(1, len(w) - 1)) as p from w)),
    lines as (select uid, template, label, phrase, runs, p - t as diagonal, min(p) as first, max(p) as last, list(distinct t) as ts from g join t using (run) group by all),
    reached as (select *, max(last) over (o rows between unbounded preceding and 1 preceding) as reached, abs(diagonal - lag(diagonal) over o) as drift from lines window o as (partition by uid, template order by first, diagonal)),
    spans as (select *, sum(case when phrase or reached is null or drift > {DRIFT} or first - reached > {GAP} then 1 else 0 end) over (partition by uid, template order by first, diagonal rows unbounded preceding) as span from reached),
    merged as (select uid, template, label, phrase, min(first) as first, len(list_distinct(flatten(list(ts)))) / any_value(runs) as score from spans group by uid, template, label, phrase, span),
    found as (select uid, count(*) filter (phrase and score >= 1) as n_base, min(first) filter (phrase and score >= 1) as first_word, max(first) filter (phrase and score >= 1) as last_word,
      string_agg(distinct label, ',' order by label) filter (phrase and score >= 1) as base_labels,
      string_agg(distinct label, ',' order by label) filter (case when phrase then score >= 1 else score >= {LEAST} end) as labels,
      max(score) filter (not phrase or score >= 1) as score from merged group by uid)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
      coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(cast(score as double), 0.0) as score from w left join found using (uid)"""
