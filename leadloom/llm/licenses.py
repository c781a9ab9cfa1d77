"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A label and the lower-case words that give it.

    name: words that must also stand one after another. exact: all words must, so they are the name.
    """

    label: str
    words: tuple[str, ...]
    name: tuple[str, ...] = ()
    exact: bool = False
    base: bool = False

    def __post_init__(self):
        if not self.words:
            raise ValueError("a template needs words")
        if self.exact:
            object.__setattr__(self, "name", self.words)


def _t(label: str, text: str, name: str = "", **kind: bool) -> Template:
    return Template(label, tuple(text.split()), tuple(name.split()), **kind)


#: The phrases of the base labels, then public license wordings.
TEMPLATES = (
    _t("mit", "mit license", exact=True, base=True),
    _t("apache", "apache license", exact=True, base=True),
    _t("gpl", "general public license", exact=True, base=True),
    _t("all-rights-reserved", "all rights reserved", exact=True),
    _t("cc-by-nc", "licensed under cc by nc", exact=True),
    _t("cc-by-sa", "licensed under cc by sa", exact=True),
    _t("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    _t("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    _t("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    _t("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    _t("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    _t("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    _t("cc", "this work is licensed under a creative commons attribution international license", "creative commons attribution"),
    _t("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    _t("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)


def words_of(text: Column) -> Column:
    """Words of the ASCII-lower-cased text; null counts as empty."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def token_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences of the vocabulary's words in all documents: as many rows as the templates have words."""
    words = docs.select(F.explode(words_of(F.col("text"))).alias("word")).where(F.col("word").isin(vocabulary))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def matches(docs: DataFrame, templates: tuple[Template, ...], threshold: float, block: int) -> DataFrame:
    """(doc_id, n_words, met): for each row of docs an array of the pairs of block and template that meet
    the threshold, as (template, containment, places).

    A block is 2 x `block` words, starting at each multiple of `block`, so every passage of up to
    `block` + 1 words lies in one whole. Words are ordered by their number in all documents, rarest
    first. Only the first |T| - a + 1 words of a template are indexed, a = ceil(threshold x |T|)
    being the words it needs (exact templates need all). A block that holds an indexed word is a
    candidate if it has a words of the vocabulary (length filter) and the words that stand after
    that one in both suffice (positional filter); then the containment is computed, and the
    template's name is looked for. places are its starts in the first half of the block: those in
    the second are the next block's. The index has as many entries as the templates have words: it
    stands in the plan, and all is found within the document's row.
    """
    if max(len(t.words) for t in templates) > block + 1:
        raise ValueError("a template is longer than a block")
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = token_counts(docs, vocabulary)
    ranked = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(ranked)}
    index = []
    for k, t in enumerate(templates):
        own = sorted(set(t.words), key=rank.__getitem__)
        need = len(own) if t.exact else math.ceil(threshold * len(own) - 1e-9)
        index += [(w, k, p, len(own), need) for p, w in enumerate(own[: len(own) - need + 1])]
    first = sorted({x[0] for x in index})
    entries = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("template"), F.lit(size - p).alias("left"), F.lit(size).alias("size"), F.lit(need).alias("need")) for w, k, p, size, need in index])
    sets = F.array(*[_strings(sorted(set(t.words))) for t in templates])
    names = F.array(*[_strings(list(t.name)) if t.name else F.array().cast("array<string>") for t in templates])

    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("words"), F.lit(1)) - 1) / block).cast("int"))
    cut = F.transform(starts, lambda b: F.struct((b * block).alias("start"), F.slice("words", b * block + 1, 2 * block).alias("words")))
    held = F.filter(cut, lambda b: F.arrays_overlap(b["words"], _strings(first)))
    held = F.transform(held, lambda b: F.struct(b["start"].alias("start"), b["words"].alias("words"), F.array_intersect(_strings(ranked), b["words"]).alias("known")))

    def candidate(known: Column, e: Column) -> Column:
        at = F.array_position(known, e["word"])
        return (at > 0) & (F.size(known) >= e["need"]) & (F.least(e["left"], F.size(known) - at + 1) >= e["need"])

    def compared(b: Column, e: Column) -> Column:
        name = F.get(names, e["template"])
        places = F.filter(F.sequence(F.lit(0), F.size(b["words"]) - 1), lambda k: F.slice(b["words"], k + 1, F.size(name)) == name)
        return F.struct(
            e["template"].alias("template"),
            e["need"].alias("need"),
            b["start"].alias("start"),
            F.size(F.array_intersect(F.get(sets, e["template"]), b["known"])).alias("common"),
            e["size"].alias("size"),
            F.when(F.size(name) > 0, places).alias("places"),
        )

    def of_block(b: Column) -> Column:
        found = F.filter(entries, lambda e: candidate(b["known"], e))
        one = F.filter(found, lambda e, k: ~F.exists(F.slice(found, F.lit(1), k), lambda x: x["template"] == e["template"]))
        return F.transform(one, lambda e: compared(b, e))

    met = F.filter(F.flatten(F.transform(held, of_block)), lambda x: (x["common"] >= x["need"]) & (x["places"].isNull() | (F.size(x["places"]) > 0)))
    met = F.transform(
        met,
        lambda x: F.struct(
            x["template"].alias("template"),
            (x["common"] / x["size"]).alias("containment"),
            F.transform(F.filter(x["places"], lambda k: k < block), lambda k: (k + x["start"]).cast("long")).alias("places"),
        ),
    )
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), met.alias("met"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, block: int = 64) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    n_base counts all places where a base template's words stand consecutively, first_word and
    last_word are the smallest and largest start of one (null without any). labels are those of all
    templates met by a block, base_labels those of the base templates; both distinct, sorted and
    comma-joined, empty without any. score: the largest containment of a template met, else 0. Null
    and empty texts have no words and no labels; rows that repeat a doc_id get a row each; null ids
    stay null; other columns are ignored; an empty table gives no row.
    """
    labels = F.array(*[F.lit(t.label) for t in templates])
    base = F.array(*[F.lit(t.base) for t in templates])
    found = matches(docs, templates, threshold, block)
    found = found.withColumn("own", F.filter("met", lambda x: F.get(base, x["template"])))
    found = found.withColumn("places", F.flatten(F.transform("own", lambda x: x["places"])))

    def names(met: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(met, lambda x: F.get(labels, x["template"])))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        names("own").alias("base_labels"),
        names("met").alias("labels"),
        F.coalesce(F.array_max(F.transform("met", lambda x: x["containment"])), F.lit(0.0)).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, block: int = 64) -> str:
    """DuckDB SQL of scan_licenses: every block is compared with every template."""

    def strings(words: tuple[str, ...]) -> str:
        return f"[{', '.join(f"'{w}'" for w in words)}]::VARCHAR[]"

    rows = ", ".join(f"({k}, '{t.label}', {strings(t.words)}, {strings(t.name)}, {t.exact}, {t.base})" for k, t in enumerate(templates))
    return f"""
WITH templates(template, label, words, name, is_exact, is_base) AS (VALUES {rows}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
starts AS (SELECT r, words, unnest(range(0, greatest(len(words), 1), {block})) AS s FROM docs),
blocks AS (SELECT r, s, words[s + 1 : s + {2 * block}] AS words FROM starts),
pairs AS (
  SELECT r, s, label, is_base, len(name) AS named, is_exact, b.words AS words, name,
    len(list_intersect(list_distinct(t.words), b.words))::DOUBLE / len(list_distinct(t.words)) AS c
  FROM blocks b, templates t),
close AS (
  SELECT *, list_filter(range(0, len(words)), lambda k: words[k + 1 : k + named] = name) AS places FROM pairs
  WHERE c >= CASE WHEN is_exact THEN 1.0 ELSE {threshold} END - 1e-9),
met AS (SELECT *, list_filter(places, lambda k: k < {block}) AS own FROM close WHERE named = 0 OR len(places) > 0),
grouped AS (
  SELECT r, sum(CASE WHEN is_base THEN len(own) END) AS n_base, min(CASE WHEN is_base THEN s + list_min(own) END) AS first_word,
    max(CASE WHEN is_base THEN s + list_max(own) END) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(c) AS score
  FROM met GROUP BY r)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN grouped g USING (r)
"""
