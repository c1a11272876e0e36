"""Licence scans: an exact set-similarity join of text blocks with licence templates.

A template is a short licence notice, as a set of tokens. Its blocks are the windows of a
text of as many words as the notice has and some SLACK, wherever lines end. All blocks
are found that contain at least THRESHOLD of the template's tokens, need of t.

Tokens are ordered by how often the whole corpus has them, rarest first. A block that shares
enough tokens with a template shares one of its t - need + 1 rarest (prefix), so only words
near one of these can be in such a block; it has need words of the template or more (length),
and its rarest shared token is among those, as too few would be left behind it (position).
The overlap of what passes is counted in full. A whole text that has fewer than need tokens
of a template has no such block and is not looked at again.

Beside that, phrases are found by their words in a row, whatever lies between the words.

DataFrame functions only: no Python runs on the executors. Texts are read and split once;
those that may have a match are kept with their words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripmill.llm import common

THRESHOLD = 0.75
# Words that a block may have beyond those of the notice: a part of them, and at least two.
SLACK, LEAST_SLACK = 0.25, 2
# What a word is, and phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Opening words of public licence notices. Kinds whose notices differ in
# one word (CC BY-NC and BY-SA) meet the threshold of each other and share a label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-4.0": "licensed under cc by nc 4 0",
    "cc-4.0-text": "licensed under a creative commons attribution 4 0 international license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "lgpl-2.1": "this library is licensed under the gnu lesser general public license version 2 1",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def _anywhere(phrase: str) -> str:
    """A pattern that a text with the phrase's words in a row matches in any case."""
    return "(?i)" + r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(phrase.split())


def _starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand in a row, counted in words."""
    wanted = phrase.split()

    def here(word: Column, at: Column) -> Column:
        following = [F.get(words, at + i) == F.lit(each) for i, each in enumerate(wanted) if i]
        hit = reduce(lambda a, b: a & b, following, word == F.lit(wanted[0]))
        return F.when(hit, at)

    return F.filter(F.transform(words, here), lambda at: at.isNotNull())


class Template(NamedTuple):
    label: str
    tokens: list[str]
    #: Distinct tokens that a block must share, and words that it has.
    need: int
    words: int


def parsed(templates: dict[str, str], threshold: float) -> list[Template]:
    out = []
    for label, text in sorted(templates.items()):
        words = text.split()
        tokens = sorted(set(words))
        slack = max(LEAST_SLACK, math.ceil(SLACK * len(words)))
        out.append(Template(label, tokens, math.ceil(threshold * len(tokens) - 1e-9), len(words) + slack))
    return out


def _array(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def read(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """The one pass over the texts. Per row a mark, n_words, the known tokens it has, the
    labels of templates that it may contain (likely), its text if there are any, and where
    phrases start, an array by label, null where the text does not have the phrase."""
    lowered = docs.select(
        F.monotonically_increasing_id().alias("mark"),
        F.col("doc_id").cast("long").alias("doc_id"),
        common.ascii_lower(F.coalesce("text", F.lit(""))).alias("text"),
    )
    known = sorted({token for each in templates for token in each.tokens} | {w for phrase in PHRASES for w in phrase.split()})
    split = lowered.withColumn("words", F.split("text", SEPARATORS)).withColumn(
        "tokens", F.array_intersect("words", _array(known))
    )
    blank = (F.get("words", F.lit(0)) == "").cast("int")
    last = F.when(F.size("words") > 1, (F.element_at("words", -1) == "").cast("int")).otherwise(0)
    likely = [
        F.when(F.size(F.array_intersect("tokens", _array(each.tokens))) >= each.need, F.lit(each.label))
        for each in templates
    ]
    may_have = F.col("text").rlike("|".join(map(_anywhere, PHRASES)))
    in_full = F.when(may_have, F.filter("words", lambda word: word != ""))
    listed = split.withColumn("likely", F.array_compact(F.array(*likely))).select(
        "mark", "doc_id", (F.size("words") - blank - last).cast("long").alias("n_words"), "tokens", "likely",
        F.when(F.size("likely") > 0, F.col("text")).alias("text"),
        in_full.alias("in_full"),
    )
    return common.cut(
        listed.select(
            "mark", "doc_id", "n_words", "tokens", "likely", "text",
            *(_starts(F.col("in_full"), phrase).alias(f"at_{label}") for phrase, label in PHRASES.items()),
        )
    )


def token_order(texts: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' tokens, those that the fewest texts have first."""
    counts = texts.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # As many rows as there are known tokens.
    seen = {row.token: row.n for row in counts.collect()}
    return sorted({token for each in templates for token in each.tokens}, key=lambda token: (seen.get(token, 0), token))


def containments(texts: DataFrame, templates: list[Template]) -> DataFrame:
    """(mark, label, containment) of all texts (mark, text, tokens, likely) with a block that
    contains enough of a template's tokens, the most that one contains."""
    rank = {token: i for i, token in enumerate(token_order(texts, templates))}
    rows = []
    for each in templates:
        ranks = sorted(rank[token] for token in each.tokens)
        # The last of the rarest tokens, one of which every match shares.
        prefix = ranks[len(ranks) - each.need]
        rows += [(token, each.label, rank[token], prefix, each.need, each.words, len(ranks)) for token in each.tokens]
    index = texts.sparkSession.createDataFrame(
        rows, "token string, label string, rank int, prefix int, need int, words int, size int"
    )
    # A row per word of a template in a text that may contain it. The index has as many rows
    # as the templates have tokens.
    places = (
        texts.where(F.size("likely") > 0)
        .select("mark", "likely", F.posexplode(F.split("text", SEPARATORS)).alias("at", "token"))
        .join(F.broadcast(index), "token")
        .where(F.array_contains("likely", F.col("label")))
        .drop("likely", "token")
    )
    row = Window.partitionBy("mark", "label").orderBy("at")
    rare = F.when(F.col("rank") <= F.col("prefix"), F.col("at"))
    near = places.withColumns(
        {
            "before": F.last(rare, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)),
            "behind": F.first(rare, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).where((F.col("at") - F.col("before") < F.col("words")) | (F.col("behind") - F.col("at") < F.col("words")))
    longest = max(each.words for each in templates)
    frame = row.rangeBetween(0, longest - 1)
    blocks = near.withColumn("following", F.collect_list(F.struct("at", "rank")).over(frame)).withColumn(
        "ranks", F.expr("transform(filter(following, x -> x.at < at + words), x -> x.rank)")
    )
    passed = blocks.where((F.size("ranks") >= F.col("need")) & (F.array_min("ranks") <= F.col("prefix")))
    return (
        passed.withColumn("overlap", F.size(F.array_distinct("ranks")))
        .where("overlap >= need")
        .groupBy("mark", "label")
        .agg(F.max(F.col("overlap") / F.col("size")).alias("containment"))
    )


def _joined(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the highest containment, 1 with a phrase, else 0).

    A null text counts as empty: no words, no labels, score 0. Repeated rows are scanned
    alike, one row each, with or without doc_id. A very long text is scanned whole, its
    blocks a window at a time. Columns but doc_id and text are not read; no rows give none.
    """
    wanted = parsed(templates, threshold)
    texts = read(docs, wanted)
    every = F.concat(*(F.coalesce(f"at_{label}", F.array().cast("array<int>")) for label in PHRASES.values()))
    base = texts.select(
        "mark", "doc_id", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_compact(
            F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in PHRASES.values()))
        ).alias("base_list"),
    )
    found = (
        containments(texts, wanted)
        .groupBy("mark")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    )
    no_labels = F.array().cast("array<string>")
    return base.join(found, "mark", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        _joined(F.col("base_list")).alias("base_labels"),
        _joined(F.concat("base_list", F.coalesce("found", no_labels))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
