"""Licence notices in texts, found with a positional index of the templates' rare words.

A text keeps its licence words and their places. Of each template the highest-IDF words that the text
holds are looked up; a word at place p that the template has at place t says that the template would
start at p - t. Starts that agree within a few words are one place of the template, whose coverage is
the share of IDF found there; it counts if all key phrases of the template stand there too.

All of it is built-in columns and joins. Texts stay where they are: only places of licence words
are shuffled, by text, template and start, so that no word or text is a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import prepare

#: Words that are no licence words: too frequent to look anything up with. Numbers are none either.
FUNCTION_WORDS = "a above all an and any are as at be by can do following for from his i if in into is it its may met name names neither no nor not of on one or other such than that the their they this to under use used want was what which who will with you your".split()

#: Phrases that are counted wherever they stand, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    """A notice: its label, its text, and phrases of it without which it isn't there."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Notices and characteristic passages of licences in wide use.
TEMPLATES = [
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license version",)),
    Template("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', ("apache license version", "except in compliance")),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice", ("source and binary forms", "source code must retain")),
    Template("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("universal public domain dedication",)),
    Template("epl", "made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "free software foundation")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("without fee is hereby granted",)),
    Template("lgpl", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("hereby granted free of charge", "software without restriction")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into",)),
    Template("zlib", "In no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable", "damages arising from")),
]

#: Rare words of a template that are looked up in a text, share of their IDF that has to be found in place,
#: and words by which starts may differ.
RARE, LEAST, SLACK = 8, 0.6, 8
#: Digits of a score.
DIGITS = 6

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a template or phrase, as those of texts."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def is_licence_word(word: str) -> bool:
    return not word.isdigit() and word not in FUNCTION_WORDS


@dataclass(frozen=True)
class Index:
    """Templates as rows: vocabulary, postings (template, word, place), phrases (words, and where they stand)."""

    templates: list[Template]

    @property
    def vocabulary(self) -> list[str]:
        every = [w for t in self.templates for w in words_of(t.text)] + [w for p in self.phrases for w in p[0]]
        return sorted({w for w in every if is_licence_word(w)})

    @property
    def phrases(self) -> list[tuple[list[str], int, int]]:
        """(words, template, place in it) of key phrases; those of BASE come first, with template -1 and their number as place."""
        out = [(p.split(), -1, i) for i, p in enumerate(BASE)]
        for n, t in enumerate(self.templates):
            text = words_of(t.text)
            for key in t.keys:
                k = key.split()
                places = [i for i in range(len(text)) if text[i : i + len(k)] == k]
                if not places or not is_licence_word(k[0]) or any(not is_licence_word(a) and not is_licence_word(b) for a, b in zip(k[1:], k[2:], strict=False)):
                    raise ValueError(f"a key phrase stands in its template, begins with a licence word and has no two others in a row: {key}")
                out.append((k, n, places[0]))
        return out

    def postings(self) -> list[tuple[int, str, int]]:
        return [(n, w, i) for n, t in enumerate(self.templates) for i, w in enumerate(words_of(t.text)) if is_licence_word(w)]


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A few literal rows."""
    one = lambda v: str(v) if isinstance(v, int) else "'" + v + "'"  # noqa: E731  words and labels have no quotes
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)} AS t({names})")


def _phrase_starts(index: Index) -> str:
    """SQL of the phrases that start at each of ``found``, as (phrase, p): licence words of a phrase are
    neighbours in ``found``, and a word between two of them is the first one's next word."""
    by_first: dict[str, list[str]] = {}
    for k, (words, _, _) in enumerate(index.phrases):
        tests, step = [], 0
        for d, w in enumerate(words):
            if is_licence_word(w):
                tests += [f"get(found, i + {step}).w = '{w}'", f"get(found, i + {step}).p = x.p + {d}"] if d else []
                step += 1
            else:
                tests.append(f"get(found, i + {step - 1}).next = '{w}'")
        by_first.setdefault(words[0], []).append(f"CASE WHEN {' AND '.join(tests)} THEN {k} END")
    cases = " ".join(f"WHEN '{w}' THEN array({', '.join(tests)})" for w, tests in by_first.items())
    starts = f"transform(found, (x, i) -> transform(array_compact(CASE x.w {cases} ELSE CAST(array() AS ARRAY<INT>) END), k -> named_struct('phrase', k, 'p', x.p)))"
    return f"flatten({starts})"


def licence_words(docs: DataFrame, index: Index) -> DataFrame:
    """(row, doc_id, n_words, found, starts) of every text, kept in the shared folder: found are licence
    words with their places, starts the phrases that begin at them."""
    listed = ", ".join(f"'{w}'" for w in index.vocabulary)
    words = docs.select("doc_id", F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER_), F.lit(WORD), F.lit(0)).alias("words"))
    places = f"array_compact(transform(words, (w, i) -> CASE WHEN w IN ({listed}) THEN named_struct('p', i, 'w', w, 'next', get(words, i + 1)) END))"
    found = words.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(places).alias("found"))
    starts = found.select("doc_id", "n_words", "found", F.expr(_phrase_starts(index)).alias("starts"))
    kept = F.transform("found", lambda x: F.struct(x["p"].alias("p"), x["w"].alias("w")))
    return written(starts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", kept.alias("found"), "starts"), "licence")


def rarity(texts: DataFrame, index: Index) -> DataFrame:
    """(template, word, place, idf, rank, total): postings, with the word's rank among its template's by
    IDF over all texts, and the IDF of the template's RARE highest words. As many rows as templates have words."""
    spark = texts.sparkSession
    held = texts.where(F.size("found") > 0).select(F.explode(F.array_distinct(F.transform("found", lambda x: x["w"]))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    postings = _values(spark, index.postings(), "template, word, place")
    idf = F.log(1 + F.col("n") / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)))
    words = postings.join(held, "word", "left").crossJoin(F.broadcast(n)).select("template", "word", "place", F.coalesce("df", F.lit(0)).alias("df"), idf.alias("idf"))  # one row on the other side
    order = words.groupBy("template").agg(F.array_sort(F.collect_set(F.struct("df", "word", "idf"))).alias("o"))
    total = F.aggregate(F.slice("o", 1, RARE), F.lit(0.0), lambda a, x: a + x["idf"])
    ranks = order.select("template", F.transform("o", lambda x: x["word"]).alias("words"), total.alias("total"))
    return written(words.join(F.broadcast(ranks), "template").select("template", "word", "place", "idf", F.array_position("words", F.col("word")).cast("int").alias("rank"), "total", "words"), "rarity")


def places(texts: DataFrame, index: Index, weights: DataFrame) -> DataFrame:
    """(row, template, start, coverage): verified places of templates, of which neighbours can stand for the same one."""
    spark = texts.sparkSession
    n = len(index.templates)
    some = texts.where(F.size("found") > 0).select("row", "found", "starts", F.transform("found", lambda x: x["w"]).alias("held"))
    order = weights.select("template", "words").distinct().agg(F.array_sort(F.collect_list(F.struct("template", "words"))).alias("orders"))
    cutoffs = F.transform("orders", lambda t: F.array_position(t["words"], F.coalesce(F.get(F.array_intersect(t["words"], F.col("held")), F.lit(RARE - 1)), F.element_at(t["words"], -1))).cast("int"))
    asked = some.crossJoin(F.broadcast(order)).select("row", "found", cutoffs.alias("cutoffs"))  # one row on the other side
    windows = lambda start: F.explode(F.array(F.floor(start / SLACK), F.floor(start / SLACK) + 1))  # noqa: E731  starts within SLACK words share one of them
    posted = F.broadcast(weights.select(F.col("word").alias("w"), "template", "place", "idf", "rank"))
    at = asked.select("row", "cutoffs", F.inline("found")).join(posted, "w").where("rank <= get(cutoffs, template)")
    words = at.select("row", "template", windows(F.col("p") - F.col("place")).alias("window"), F.struct("rank", "idf").alias("hit"), F.lit(None).cast("int").alias("key"))
    keys = [(k, t, place) for k, (_, t, place) in enumerate(index.phrases) if t >= 0]
    begun = some.select("row", F.inline("starts")).join(F.broadcast(_values(spark, keys, "phrase, template, place")), "phrase")
    phrases = begun.select("row", "template", windows(F.col("p") - F.col("place")).alias("window"), F.lit(None).cast(words.schema["hit"].dataType).alias("hit"), F.col("phrase").alias("key"))
    met = words.unionByName(phrases).groupBy("row", "template", "window").agg(F.array_sort(F.collect_set("hit")).alias("hits"), F.size(F.collect_set("key")).alias("n_keys"))
    needed = _values(spark, [(t, len(index.templates[t].keys)) for t in range(n)], "template, needed")
    totals = weights.select("template", "total").distinct()
    share = F.aggregate("hits", F.lit(0.0), lambda a, x: a + x["idf"]) / F.col("total")
    out = met.join(F.broadcast(needed), "template").where("n_keys = needed").join(F.broadcast(totals), "template")
    return out.select("row", "template", F.col("window").alias("start"), F.least(F.round(share, DIGITS), F.lit(1.0)).alias("coverage")).where(F.col("coverage") >= LEAST)


def license_scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from BASE's phrases, wherever they stand; labels are these and those of templates
    that are found; score is the best coverage of a template that is found, 0 without one. A null or empty
    text has no words, no places (null) and empty labels; nothing is cut from long texts; repeated rows are
    scanned each on its own; a null doc_id is kept; an empty table gives no rows; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    index = Index(TEMPLATES if templates is None else templates)
    texts = licence_words(docs, index)
    labels = _values(spark, [(t, x.label) for t, x in enumerate(index.templates)], "template, label")
    found = places(texts, index, rarity(texts, index)).join(F.broadcast(labels), "template").groupBy("row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("score"))
    base = F.filter("starts", lambda s: s["phrase"] < len(BASE))
    names = F.array(*map(F.lit, BASE.values()))
    out = texts.select("row", "doc_id", "n_words", base.alias("base")).join(found, "row", "left")
    at = F.transform("base", lambda s: s["p"].cast("long"))
    own = F.array_distinct(F.transform("base", lambda s: F.get(names, s["phrase"])))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(own).alias("base_labels"), joined(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")
