"""License scan: fixed phrases, and an exact containment join of text blocks with templates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsmith.llm.common import UPPER, back_to_columns, lower_az, text_of

#: Characters that stand between words; words are ASCII letters and digits and all beyond ASCII.
GAP = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices of public licences and their labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
           "is hereby granted",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
THRESHOLD = 0.8
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def template_tokens(text: str) -> list[str]:
    """The distinct words of a template (ASCII), in order."""
    lowered = "".join(c.lower() if c in UPPER else c for c in text)
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in lowered).split()))


def token_ranks(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """The templates' words from rare to frequent in the corpus; at most the vocabulary is collected."""
    words = lower_az(F.array_join(F.array_distinct(F.split(text_of(text), f"[{GAP}]+")), " "))
    held = F.array_intersect(F.split(words, " "), F.array(*map(F.lit, vocabulary)))
    counts = {r["token"]: r["count"] for r in docs.select(F.explode(held).alias("token")).groupBy("token").count().collect()}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    return {w: i for i, w in enumerate(ordered)}


def prefix_index(templates: dict[str, str], ranks: dict[str, int], threshold: float) -> list[tuple]:
    """(word, label, place, words of the template, words needed, all its words) of the rarest words."""
    index = []
    for label, text in templates.items():
        own = sorted(template_tokens(text), key=ranks.__getitem__)
        need = math.ceil(threshold * len(own) - 1e-9)
        index += [(own[i], label, i, len(own), need, own) for i in range(len(own) - need + 1)]
    return index


def block_matches(blocks: DataFrame, templates: dict[str, str], ranks: dict[str, int],
                  threshold: float = THRESHOLD) -> DataFrame:
    """Every (block, template) with at least ``threshold`` of the template's distinct words in the block.

    ``blocks`` has an id ``block`` and its ``tokens``: template words only, distinct, rare ones
    first. A template is indexed by its rarest words only, as many as could be missing and one
    more, so that any matching block holds an indexed word (prefix filter). A pair is formed only
    when the block has enough words (length filter) and both sides have enough words left from
    that word on (positional filter); the rest is counted in full. The index has at most as many
    rows as the templates have words, so it is broadcast.
    """
    index = blocks.sparkSession.createDataFrame(
        prefix_index(templates, ranks, threshold), "token string, label string, at int, n_template int, need int, template array<string>")
    rows = blocks.select("block", "tokens", F.posexplode("tokens").alias("pos", "token"))
    left = F.least(F.col("n_template") - F.col("at"), F.size("tokens") - F.col("pos"))
    joined = rows.join(F.broadcast(index), "token").where(
        (F.size("tokens") >= F.col("need")) & (left >= F.col("need")))
    overlap = F.size(F.array_intersect("tokens", "template"))
    # The pair counts at its first common word only, so it comes once.
    first = F.array_intersect("tokens", "template")[0] == F.col("token")
    return joined.where(first & (overlap >= F.col("need"))).select(
        "block", "label", (overlap / F.col("n_template")).alias("containment"))


def _starts(words: Column, phrase: str) -> Column:
    """Places in ``words`` (lower case) where the words of ``phrase`` follow each other."""
    parts = phrase.split(" ")
    here = lambda w, i: reduce(
        lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)])
    return F.filter(F.transform(words, lambda w, i: F.when(here(w, i), i).otherwise(-1)), lambda i: i >= 0)


def license_scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
                 threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its license phrases, labels and score.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case.
    ``n_base``, ``first_word`` and ``last_word`` tell the places where a fixed phrase starts;
    ``labels`` adds the templates that a block (a line) contains to the ``threshold``. ``score``
    is 1 where a fixed phrase stands, else the greatest containment of a matching template, else
    0. Only lines with an indexed word are split into tokens and joined; what they match is summed up
    by document before it meets the document again. ``carry`` names the columns of ``docs`` to return
    (all by default); those left out are not shuffled. A null or empty text has no words; repeated rows
    are labelled alike; an empty table gives an empty result. A column of ``docs`` that has the
    name of an added one is replaced.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for t in templates.values() for w in template_tokens(t)})
    ranks = token_ranks(docs, text, vocabulary)
    rare = sorted({row[0] for row in prefix_index(templates, ranks, threshold)})
    has_rare = f"(?i)(?<![^{GAP}])(?:{'|'.join(rare)})(?![^{GAP}])"

    carry = docs.columns if carry is None else carry
    placed = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row"), text_of(f"`{text}`").alias("body"),
                         F.monotonically_increasing_id().alias("place"))
    lines = placed.where(F.col("body").rlike(has_rare)).select("place", F.posexplode(F.split("body", "\n")).alias("line", "said"))
    by_rank = F.array(*[F.lit(w) for w in sorted(vocabulary, key=ranks.__getitem__)])
    held = F.array_intersect(by_rank, F.split(lower_az(F.col("said")), f"[{GAP}]+"))
    blocks = lines.where(F.col("said").rlike(has_rare)).select(F.struct("place", "line").alias("block"), held.alias("tokens"))
    matched = block_matches(blocks, templates, ranks, threshold).groupBy(F.col("block.place").alias("place")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best"))

    gap = f"[{GAP}]+"
    any_phrase = "(?i)(?<![^" + GAP + "])(?:" + "|".join(p.replace(" ", gap) for p in PHRASES) + ")(?![^" + GAP + "])"
    words = F.transform(F.filter(F.split("body", gap), lambda w: w != ""), lower_az)
    none = F.array().cast("array<int>")
    starts = F.when(F.col("body").rlike(any_phrase), F.transform(F.array(words), lambda w: F.struct(
        *[_starts(w, p).alias(label) for p, label in PHRASES.items()]))[0]).otherwise(
            F.struct(*[none.alias(label) for label in PHRASES.values()]))
    based = placed.select(
        "row", "place", F.regexp_count("body", F.lit(f"[^{GAP}]+")).cast("long").alias("n_words"), starts.alias("starts"))
    places = F.flatten(F.array(*[F.col(f"starts.`{label}`") for label in PHRASES.values()]))
    labels = F.array_compact(F.array(*[
        F.when(F.size(F.col(f"starts.`{label}`")) > 0, F.lit(label)) for label in PHRASES.values()]))
    joined = based.join(matched, "place", "left").select(
        "row", "n_words", places.alias("places"), labels.alias("held"), "found", "best")
    result = joined.select(
        "row", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.sort_array("held"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("held", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
    return back_to_columns(result, carry, ADDED)
