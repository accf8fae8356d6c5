"""Operator 13: licences in texts, by a positional index of rare words; DataFrame expressions only.

Templates are phrases and the openings of licence texts, each with mandatory key phrases. One pass over all texts counts in how many
documents each licence word stands (at most the templates' few hundred words, whatever the data). The postings of a template's key words, ordered by
inverse document frequency, say which words are looked up: the two highest ones give places of the template's start each (place of the word less its place in the
template), and only places that both give are candidates. There the key phrases must stand word for word; the share of the template's
words that stand at their places is the match's score, and COVERED of them must. Both looked-up words belong to key phrases, so no place that passes is missed.

Defined results: null or empty text: no words, nothing found, score 0. Overlapping places all count. Repeated rows: each by itself. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .importance import LOWER, UPPER, words_of
from .secret_scan import let

#: Phrases that are licences by themselves, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, opening of the licence, key phrases.
OPENINGS = [
    ("cc-by-nc", "cc by nc", ["cc by nc"]),
    ("cc-by-sa", "cc by sa", ["cc by sa"]),
    ("cc-by-nd", "cc by nd", ["cc by nd"]),
    ("cc-by", "creative commons attribution", ["creative commons attribution"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "gnu general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted", "without restriction"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "in compliance with"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("bsd", "bsd license", ["bsd license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee", "hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]
#: Least share of a template's words at their places.
COVERED = 0.75


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # from, to in words
    base: bool

    def key_places(self) -> list[int]:
        return sorted({i for a, b in self.keys for i in range(a, b)})


def template(label: str, text: str, phrases: list[str], base: bool) -> Template:
    words = tuple(text.split())
    keys = []
    for phrase in phrases:
        own = tuple(phrase.split())
        at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
        keys.append((at, at + len(own)))
    return Template(label, words, tuple(keys), base)


TEMPLATES = [template(label, phrase, [phrase], True) for phrase, label in BASE.items()] + [template(label, text, phrases, False) for label, text, phrases in OPENINGS]


def vocabulary(templates: list[Template]) -> list[str]:
    """The words of key phrases: those that can be looked up."""
    return sorted({t.words[i] for t in templates for i in t.key_places()})


def occurrences(words: Column, vocabulary: list[str]) -> Column:
    """array<struct<at, word>> of the licence words of a text."""
    return F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))


def document_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of the words stands: a row a word at most."""
    present = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(words)))).alias("word"))
    return {r.word: r.n for r in present.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def lookups(t: Template, frequency: dict[str, int]) -> list[int]:
    """The places in the template of its two key words of the highest inverse document frequency (ties: the first)."""
    return sorted(t.key_places(), key=lambda i: (frequency.get(t.words[i], 0), i))[:2]


def starts(t: Template, hits: Column, n_words: Column, looked_up: list[int]) -> Column:
    """Where the template may start: places that all looked-up words agree on."""

    def posting(i: int) -> Column:
        return F.transform(F.filter(hits, lambda x: x["word"] == t.words[i]), lambda x: x["at"] - i)

    each = [posting(i) for i in looked_up]
    both = each[0] if len(each) == 1 else F.array_intersect(*each)
    last = max(b for _, b in t.keys)
    return F.filter(both, lambda s: (s + t.keys[0][0] >= 0) & (s + last <= n_words))


def found(t: Template, words: Column, hits: Column, looked_up: list[int]) -> Column:
    """array<struct<start, score>> of the template's places in a text."""

    def stands(s: Column, i: int) -> Column:
        at = s + i
        return F.coalesce(F.when(at >= 0, F.get(words, at)) == t.words[i], F.lit(False))

    keyed = F.filter(starts(t, hits, F.size(words), looked_up), lambda s: reduce(Column.__and__, (stands(s, i) for i in t.key_places())))
    if len(t.key_places()) == len(t.words):
        return F.transform(keyed, lambda s: F.struct(s.cast("long").alias("start"), F.lit(1.0).alias("score")))
    rest = [i for i in range(len(t.words)) if i not in set(t.key_places())]
    share = lambda s: (sum((stands(s, i).cast("int") for i in rest), F.lit(len(t.key_places())))) / len(t.words)
    return F.filter(F.transform(keyed, lambda s: F.struct(s.cast("long").alias("start"), share(s).cast("double").alias("score"))), lambda x: x["score"] >= COVERED)


def scanned(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (of places of the base phrases), base_labels, labels and score (the best match's)."""
    known = vocabulary(templates)
    frequency = document_frequencies(docs, known)
    rows = docs.select("doc_id", F.coalesce(words_of(F.col("text")), F.array().cast("array<string>")).alias("words"))
    rows = rows.select("doc_id", "words", occurrences(F.col("words"), known).alias("hits"))
    none = F.array().cast("array<struct<start:bigint,score:double>>")
    by_template = F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), found(t, F.col("words"), F.col("hits"), lookups(t, frequency)).alias("places")) for t in templates))
    kind = "array<struct<label:string,base:boolean,places:array<struct<start:bigint,score:double>>>>"
    matches = F.when(F.size("hits") > 1, F.filter(by_template, lambda x: F.size(x["places"]) > 0)).otherwise(F.array().cast(kind))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), matches.alias("matches"))

    def digest(x: Column) -> Column:
        own = F.filter(x, lambda m: m["base"])
        at = F.flatten(F.transform(own, lambda m: F.transform(m["places"], lambda p: p["start"])))
        listed = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda m: m["label"]))), ",")
        best = F.array_max(F.transform(F.flatten(F.transform(x, lambda m: m["places"])), lambda p: p["score"]))
        return F.struct(F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), listed(own).alias("base_labels"), listed(x).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"))

    return rows.select("doc_id", "n_words", let(F.col("matches"), digest).alias("d")).select("doc_id", "n_words", "d.n_base", "d.first_word", "d.last_word", "d.base_labels", "d.labels", "d.score")


def oracle(templates: list[Template] = TEMPLATES) -> str:
    """The same by all places of all templates."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    values = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {quoted(t.words)}, {list(t.key_places())})" for k, t in enumerate(templates))
    return rf"""
WITH templates(k, label, base, t, keys) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
able AS (SELECT * FROM docs, templates WHERE list_has_all(w, list_transform(keys, lambda i: t[i + 1]))),
places AS (SELECT *, unnest(range(-keys[1], len(w) - list_max(keys))) AS s FROM able),
keyed AS (SELECT * FROM places WHERE len(list_filter(keys, lambda i: w[s + i + 1] = t[i + 1])) = len(keys)),
scored AS (SELECT row, label, base, s, len(list_filter(range(len(t)), lambda i: s + i >= 0 AND w[s + i + 1] = t[i + 1])) / len(t) AS score FROM keyed),
hits AS (SELECT row, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM scored WHERE score >= {COVERED} GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM docs LEFT JOIN hits USING (row)
"""


ORACLE = oracle()
