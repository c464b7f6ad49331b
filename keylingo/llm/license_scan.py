"""Licence texts in documents, by a positional index of rare words.

The index posts each template under its rarest words, with their places in it.
How rare a licence word is (its inverse document frequency) is counted over all
documents. A document looks up those words wherever it has them; postings that
agree on where the template would begin make a candidate, whose other words are
then compared place by place. A candidate counts if its mandatory key phrases
are all there and ``SHARE`` of the template's words by rarity are too.

DataFrame functions only. Texts are read once: what later steps need is the
licence words with their places. Nothing of a document is gathered but labels.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The contract's words, in texts whose A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's words by rarity that must stand in their places; one word in so many is posted, at least one, at most ``POSTED``.
SHARE, ONE_IN, POSTED = 0.8, 3, 4


class Template(NamedTuple):
    """Words of a licence. ``keys`` are the phrases in it that must be there; a ``base`` template must be there whole."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


#: The phrases and labels of the contract.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)

#: Sentences of public licences and of notices that name them.
TEMPLATES = (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("apache-2.0", "distributed on an as is basis without warranties or conditions of any kind either express or implied", ("warranties or conditions",)),
    Template("artistic", "the artistic license 2 0", ("artistic license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ("endorse or promote products",)),
    Template("bsl", "boost software license version 1 0", ("boost software license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("public domain dedication",)),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("free documentation license",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "any person obtaining a copy")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial portions of the software",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("in no event will the authors",)),
)


def words_and_keys(template: Template) -> tuple[list[str], set[int]]:
    """A template's words, and the places of those that must be there."""
    words, places = template.text.split(), set()
    for key in (template.text,) if template.base else template.keys:
        phrase = key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        places.update(range(at, at + len(phrase)))
    return words, places


def index(templates, seen: dict[str, int], documents: int) -> list[tuple]:
    """Postings (template, word, place, weight, posted, key), a row for each word of each template.

    ``seen`` counts the documents with a word; its weight is ln((documents + 1) /
    (seen + 0.5)), above 0. A template is posted under its words of most weight,
    those that come first among equals.
    """
    out = []
    for number, template in enumerate(templates):
        words, keys = words_and_keys(template)
        weights = [math.log((documents + 1) / (seen.get(w, 0) + 0.5)) for w in words]
        rarest = sorted(range(len(words)), key=lambda i: (-weights[i], i))[: min(POSTED, max(1, len(words) // ONE_IN))]
        out += [(number, word, i, weights[i], i in rarest, i in keys) for i, word in enumerate(words)]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=BASE + TEMPLATES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of base templates, ``first_word`` and ``last_word``
    are the smallest and largest of them, counted in words from 0, else null.
    ``labels`` adds the labels of other templates found; both are sorted and
    joined by commas, empty where there are none. ``score`` is the largest share
    of a found template's words, 1 for base ones, 0 for none, to 6 places.

    Null and empty texts have no words. Repeated rows and ids are scanned and
    reported each; other columns are ignored; an empty table gives an empty
    result. A whole text's words are one array of its row while it is read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    # the Kelvin sign is the one character whose small form is an ASCII letter of its own
    lower = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("K"), F.lit("一")))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("at")))), lambda h: h.isNotNull())
    rows = words.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"), F.monotonically_increasing_id().alias("row_key"))
    rows = scratch.keep(rows, "rows")

    each = rows.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    seen = {r["word"]: r["count"] for r in each.groupBy("word").count().collect()}  # a row for each word of the templates at most
    postings = index(templates, seen, rows.count())
    indexed = spark.createDataFrame(postings, "template int, word string, place int, weight double, posted boolean, key boolean")
    number = {t: sum(1 for p in postings if p[0] == t and p[4]) for t in range(len(templates))}
    needed = [(t, t_.label, t_.base, (number[t] + 1) // 2, sum(p[3] for p in postings if p[0] == t), sum(1 for p in postings if p[0] == t and p[5])) for t, t_ in enumerate(templates)]
    needed = spark.createDataFrame(needed, "template int, label string, base boolean, n_posted int, whole double, n_keys int")
    rare = sorted({p[1] for p in postings if p[4]})

    # look up: postings that agree on the template's beginning
    probes = rows.select("row_key", F.explode(F.filter("hits", lambda h: h["word"].isin(rare))).alias("hit")).select("row_key", "hit.word", "hit.at")
    posted = indexed.where("posted").select("word", "template", "place")
    begins = probes.join(F.broadcast(posted), "word").select("row_key", "template", (F.col("at") - F.col("place")).alias("start"))
    begins = begins.groupBy("row_key", "template", "start").agg(F.count("*").alias("agree"))
    found = begins.join(F.broadcast(needed.select("template", "n_posted")), "template").where("agree >= n_posted").select("row_key", "template", "start")
    found = scratch.keep(found, "candidates")

    # verify: every word of the template against the document's word in its place
    wanted = found.join(F.broadcast(indexed.select("template", "word", "place", "weight", "key")), "template")
    wanted = wanted.select("row_key", "template", "start", (F.col("start") + F.col("place")).alias("at"), "word", "weight", "key")
    there = rows.join(found.select("row_key").distinct(), "row_key", "left_semi").select("row_key", F.explode("hits").alias("hit")).select("row_key", "hit.word", "hit.at")
    agreed = wanted.join(there, ["row_key", "at", "word"]).groupBy("row_key", "template", "start").agg(F.sum("weight").alias("weight"), F.count_if("key").alias("keys"))
    judged = agreed.join(F.broadcast(needed.drop("n_posted")), "template").where("keys = n_keys")
    share = F.when(F.col("base"), F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), F.col("weight") / F.col("whole")), 6))
    judged = judged.withColumn("share", share).where(F.col("share") >= SHARE)

    base_start = F.when(F.col("base"), F.col("start")).cast("long")
    by_row = judged.groupBy("row_key").agg(
        F.count_if("base").alias("n_base"), F.min(base_start).alias("first_word"), F.max(base_start).alias("last_word"), F.max("share").alias("score"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"),
    )
    out = rows.select("row_key", "doc_id", "n_words").join(by_row, "row_key", "left")
    listed = [F.coalesce(F.array_join(F.sort_array(c), ","), F.lit("")).alias(c) for c in ("base_labels", "labels")]
    zeros = [F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.coalesce("score", F.lit(0.0)).alias("score")]
    return out.select("doc_id", "n_words", zeros[0], "first_word", "last_word", *listed, zeros[1])
