"""License scan with DataFrame functions only.

Phrases are counted where their words stand consecutively. Templates (sentences of license notices) are found by
an exact set-similarity join between template and text blocks. The blocks of a template are the windows of
consecutive words in a text that begin with a word of any template and are ``SLACK`` longer than the template, so
line breaks play no part and a long paragraph is no bag of words. A block matches if it holds at least ``threshold`` of the template's distinct words,
among them all its required words, and none that point to another license. Templates of fewer than
``EXACT_BELOW`` words match word for word.

Template words are ordered by how many texts hold them, rarest first. A matching block must hold one of a
template's first ``n - need + 1`` words (prefix filter). Each place of such a word is looked at with the words
around it: only words not before it in the order count, as a block with an earlier one is met at that one's place
(positional filter), and enough of them must be near (length filter). Survivors are compared window by window, so
nothing is lost. Texts are worked through in segments of ``SEGMENT`` words with a margin, so the rows stay small
however long a text is and however often it repeats a word.

Defined results: a null text is empty; an empty text has no words, no places and no labels. Rows with a null or
repeated id are scanned each. A very long text is scanned whole. An empty table gives no rows. Only id and text
are read.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

# Phrases with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

class Template(NamedTuple):
    """A sentence, its label, words that must stand in the block and words that must not."""

    words: str
    label: str
    required: str = ""
    without: str = ""


# Usual sentences of license notices.
TEMPLATES = (
    Template(
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        "gpl", "gnu", "lesser affero library",
    ),
    Template("this work is licensed under the gnu general public license version 3", "gpl", "gnu general public", "lesser affero"),
    Template("released under the gpl license", "gpl"),
    Template(
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
        "general public license as published by the free software foundation",
        "lgpl", "gnu lesser",
    ),
    Template(
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
        "general public license as published by the free software foundation",
        "agpl", "gnu affero",
    ),
    Template("licensed under the apache license version 2 0", "apache", "apache"),
    Template("released under the apache license", "apache"),
    Template(
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind",
        "apache",
    ),
    Template(
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction",
        "mit",
    ),
    Template(
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
        "mit", "permission substantial",
    ),
    Template("released under the mit license", "mit"),
    Template("licensed under the mit license", "mit"),
    Template(
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc", "permission fee",
    ),
    Template(
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
        "bsd", "redistribution",
    ),
    Template("released under the bsd license", "bsd"),
    Template(
        "this work is licensed under a creative commons attribution 4 0 international license",
        "cc-by", "creative commons attribution", "sharealike noncommercial noderivatives noderivs",
    ),
    Template(
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        "cc-by-sa", "creative commons sharealike", "noncommercial",
    ),
    Template(
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "cc-by-nc", "creative commons noncommercial",
    ),
    Template(
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to "
        "this work",
        "cc0", "waived",
    ),
    Template(
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mpl", "mozilla",
    ),
    Template(
        "this program and the accompanying materials are made available under the terms of the eclipse public "
        "license",
        "epl", "eclipse",
    ),
    Template("this is free and unencumbered software released into the public domain", "public-domain", "public domain"),
    Template("all rights reserved", "all-rights-reserved"),
)

THRESHOLD = 0.8
#: Words that a block has beyond the template's own number, as a share of it.
SLACK = 0.2
#: Templates of fewer words match word for word only.
EXACT_BELOW = 8
#: Words of a text that are looked at together.
SEGMENT = 256
#: What separates words: ASCII characters that are neither digits nor letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spread_words(text: Column) -> Column:
    """Lower-cased words, each between two blanks of its own; '' if there are none."""
    plain = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, "  "))
    return F.when(plain == "", F.lit("")).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _count(text: Column, part: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def scan_phrases(docs: DataFrame, keep: dict[str, Column], text: Column, phrases=PHRASES) -> DataFrame:
    """``keep``, ``n_words``, ``n_base``, ``first_word``, ``last_word`` and ``base_found`` (label array) per row."""
    df = docs.select(*(c.alias(k) for k, c in keep.items()), _spread_words(F.coalesce(text.cast("string"), F.lit(""))).alias("_w"))
    words = F.col("_w")
    n_words = _count(words, " ") / 2
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        part = " " + phrase.replace(" ", "  ") + " "
        held = F.contains(words, F.lit(part))
        before = F.substring(words, F.lit(1), F.locate(part, words) - 1)
        after = F.substring(F.reverse(words), F.lit(1), F.locate(part[::-1], F.reverse(words)) - 1)
        counts.append(F.when(held, _count(words, part)).otherwise(0))
        firsts.append(F.when(held, _count(before, " ") / 2))
        lasts.append(F.when(held, n_words - _count(after, " ") / 2 - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    total = counts[0]
    for count in counts[1:]:
        total = total + count
    return df.select(
        *keep,
        n_words.cast("long").alias("n_words"),
        total.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*labels))).alias("base_found"),
    )


class _Rule(NamedTuple):
    """A template as the join needs it."""

    number: int
    label: str
    sequence: list[str]  # its words in their own order
    words: list[str]  # its distinct words, rarest first
    need: int  # distinct words that a block must hold
    window: int  # words of a block
    required: list[str]
    without: list[str]


def needed(n: int, threshold: float) -> int:
    """Words that a block must share with a template of ``n`` distinct words."""
    return max(1, ceil(round(threshold * n, 9)))


def window_words(n: int) -> int:
    """Words of the blocks of a template of ``n`` words."""
    return n if n < EXACT_BELOW else n + ceil(round(SLACK * n, 9))


def _rules(templates, threshold: float, rank: dict[str, int]) -> list[_Rule]:
    rules = []
    for number, (text, label, required, without) in enumerate(templates):
        sequence = text.split()
        words = sorted(set(sequence), key=rank.__getitem__)
        need = len(words) if len(sequence) < EXACT_BELOW else needed(len(words), threshold)
        window = window_words(len(sequence))
        rules.append(_Rule(number, label, sequence, words, need, window, required.split(), without.split()))
    return rules


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def text_segments(rows: DataFrame, keys: list[str], margin: int) -> DataFrame:
    """``keys``, ``first`` and ``words``: stretches of ``SEGMENT`` words of ``_w`` with a margin on both sides.

    ``first`` is the number of words before the stretch's own ones. An empty word, as splitting leaves it before
    a leading separator, is a word here; it belongs to no template.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(SEGMENT))
    parts = F.transform(
        starts,
        lambda s: F.struct(
            F.least(s, F.lit(margin)).alias("first"),
            F.slice("_w", F.greatest(s - margin, F.lit(0)) + 1, F.lit(SEGMENT + margin) + F.least(s, F.lit(margin))).alias("words"),
        ),
    )
    return rows.select(*keys, F.inline(parts))


def match_templates(
    docs: DataFrame, keys: dict[str, Column], text: Column, templates=TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """All matches: ``keys``, ``label`` and ``containment`` per text, template and place of a starting word.

    The word order is learned from all texts; what reaches the driver is one count per template word.
    """
    templates = [Template(*t) for t in templates]
    vocabulary = sorted({w for t in templates for part in (t.words, t.required, t.without) for w in part.split()})
    known = F.array(*map(F.lit, vocabulary))
    texts = docs.select(*(c.alias(k) for k, c in keys.items()), _words(text.cast("string")).alias("_w"))
    counted = dict(
        (r.word, r.n)
        for r in texts.select(F.explode(F.array_intersect("_w", known)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    )
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    rules = _rules(templates, threshold, rank)
    starting = []  # one row per template and word that can be the rarest one of a matching block
    for rule in rules:
        for place, word in enumerate(rule.words[: len(rule.words) - rule.need + 1]):
            exact = len(rule.sequence) < EXACT_BELOW
            offsets = [i for i, w in enumerate(rule.sequence) if w == word]
            starting.append(
                (word, rule.label, rule.words[place:], len(rule.words), rule.need, rule.window, rule.required, rule.without,
                 rule.sequence if exact else None, offsets)
            )
    starters = sorted({row[0] for row in starting})
    prefix = F.broadcast(  # as many rows as the templates have starting words
        docs.sparkSession.createDataFrame(
            starting,
            "word string, label string, later array<string>, n int, need int, window int, required array<string>, "
            "without array<string>, sequence array<string>, offsets array<int>",
        )
    )
    margin = max(rule.window for rule in rules)
    begins = F.array(*map(F.lit, starters))
    segments = text_segments(texts.where(F.arrays_overlap("_w", begins)), list(keys), margin).where(F.arrays_overlap("words", begins))
    # The template words of a segment with their places; the starting ones among its own words are the anchors.
    placed = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    local = segments.select(*keys, "first", F.filter(placed, lambda x: F.array_contains(known, x["w"])).alias("near"))
    own = F.filter(
        "near",
        lambda x: (x["at"] >= F.col("first")) & (x["at"] < F.col("first") + SEGMENT) & F.array_contains(begins, x["w"]),
    )
    anchors = local.select(*keys, "near", F.inline(own).alias("at", "word"))
    around = F.filter("near", lambda x: (x["at"] > F.col("at") - F.col("window")) & (x["at"] < F.col("at") + F.col("window")))
    joined = anchors.join(prefix, "word").select(
        *keys, "label", "at", "word", "later", "n", "need", "window", "required", "without", "sequence", "offsets", around.alias("near")
    )
    later = F.filter("near", lambda x: F.array_contains(F.col("later"), x["w"]))
    close = joined.withColumn("counting", later).where(F.size(F.array_distinct(F.col("counting")["w"])) >= F.col("need"))
    exact = F.exists(
        "offsets",
        lambda o: F.filter("near", lambda x: (x["at"] >= F.col("at") - o) & (x["at"] < F.col("at") - o + F.size("sequence")))["w"]
        == F.col("sequence"),
    )

    def held(start: Column, words: str) -> Column:
        inside = F.filter(words, lambda x: (x["at"] >= start) & (x["at"] < start + F.col("window")))
        return F.array_distinct(F.transform(inside, lambda x: x["w"]))

    def best(start: Column) -> Column:
        words = held(start, "near")
        allowed = (F.size(F.array_except("required", words)) == 0) & ~F.arrays_overlap("without", words)
        return F.when(allowed, F.size(held(start, "counting"))).otherwise(0)

    # All blocks that hold the anchor.
    windows = F.transform(F.filter("near", lambda x: x["at"] <= F.col("at")), lambda x: best(x["at"]))
    overlap = F.when(F.col("sequence").isNull(), F.array_max(windows)).when(exact, F.col("n"))
    return close.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need")).select(
        *keys, "label", (F.col("overlap") / F.col("n")).alias("containment")
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, word and phrase figures, ``base_found`` and ``found`` (label arrays), ``score``.

    ``score`` is 1 if a phrase stands in the text, else the largest containment of a matched template.
    """
    text = F.col(text_col)
    keys = {"_id": F.col(id_col), "_h": F.xxhash64(text.cast("string")), "_n": F.octet_length(text.cast("string"))}
    base = scan_phrases(docs, keys, text)
    matches = (
        match_templates(docs, keys, text)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("label")).alias("matched"), F.max("containment").alias("containment"))
    )
    same = [base[k].eqNullSafe(matches[k]) for k in keys]
    none = F.array().cast("array<string>")
    return base.join(matches, same, "left").select(
        base["_id"].alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.sort_array("base_found").alias("base_found"),
        F.sort_array(F.array_union("base_found", F.coalesce("matched", none))).alias("found"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
