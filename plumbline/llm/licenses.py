"""License scan with a positional index of rare words, in DataFrame functions only.

The words of the templates get their inverse document frequency from the whole
corpus. Of every template's mandatory key phrase the two words of highest
frequency weight are indexed with their offsets. A file's licence words are
looked up there; the postings that both words of a template give, as starts of
its key phrase, are intersected by relative position; and at each start that
is left the key phrase is verified word by word. The template's other words
may be shifted by a few places, as when a year or a name is put in; enough of
them must match, weighted by their rarity.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least share of a template's weight that must match, and how far its words outside the key phrase may be shifted.
LEAST_SHARE, SHIFT = 0.6, 3


class Template(NamedTuple):
    label: str
    words: str
    key: str  # mandatory phrase, consecutive words of `words`
    base: bool = False


#: The phrases of the contract and their labels.
BASE = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)
#: Sentences of well-known public licenses.
OWN = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl", "under the terms of the eclipse public license", "eclipse public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "deal in the software without restriction",
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may not use this file except in compliance with the license",
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "either version 3 of the license",
    ),
    Template(
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        "either version 2 of the license",
    ),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "must retain the above copyright notice this list of conditions",
    ),
    Template("isc", "with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "this permission notice appear in all copies"),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "authors be held liable for any damages arising from the use",
    ),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_column(text: str | Column) -> Column:
    """Words of a text with A-Z lower-cased; null is empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every template word over all documents."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    found = F.array_intersect(words_column(text), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}  # one row a template word, and "" for all documents
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1 for w in vocabulary}


#: A vote as one number: the template above, the start (which may lie before the text) below.
_PLACES = 1 << 40


def _index(templates: Sequence[Template], idf: dict[str, float]) -> list[dict[str, list[tuple[int, int]]]]:
    """For the rarest and the second rarest word of each key phrase: word -> (template, offset in the phrase)."""
    out: list[dict[str, list[tuple[int, int]]]] = [{}, {}]
    for t, template in enumerate(templates):
        key = template.key.split()
        rare = sorted(set(key), key=lambda w: (-idf[w], w))
        for postings, w in zip(out, (rare[0], rare[min(1, len(rare) - 1)]), strict=True):
            postings.setdefault(w, []).extend((t, i) for i, x in enumerate(key) if x == w)
    return out


def scan_licenses(docs: DataFrame, text: str = "text", templates: Sequence[Template] = BASE + OWN, least_share: float = LEAST_SHARE) -> DataFrame:
    """Add n_words and license_matches, an array of (label, base, start, share), to every row.

    ``start`` is where the template begins, 0 if that is before the text; its
    key phrase must stand in the text whole.
    ``share`` is the matched part of a template's weight; it is 1 for the exact
    phrases of base templates. Other words of a template may lie outside the
    text or up to SHIFT places off. Null and empty texts have no words and no
    matches; repeated rows stay repeated, no rows give none. Input columns
    named as the new ones are replaced.
    """
    idf = frequencies(docs, templates, text)
    index = _index(templates, idf)
    structs = []
    for t in templates:
        words, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        total = sum(idf[w] for w in words)
        around = [(w, i - at) for i, w in enumerate(words) if not at <= i < at + len(key)]
        structs.append(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                F.array(*map(F.lit, key)).alias("key"),
                F.lit(at).alias("at"),
                F.lit(sum(idf[w] for w in key) / total).alias("sure"),
                F.array(*[F.struct(F.lit(w).alias("w"), F.lit(d).alias("d"), F.lit(idf[w] / total).alias("weight")) for w, d in around]).cast("array<struct<w:string,d:int,weight:double>>").alias("around"),
                F.lit(1.0 if t.base else least_share).alias("least"),
            )
        )
    tokens, votes = unused(docs, "tokens"), unused(docs, "votes")
    out = without(docs, "n_words", "license_matches").withColumn(tokens, words_column(text))
    words = F.col(tokens)
    known = sorted({w for postings in index for w in postings})
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(known), F.struct(w.alias("w"), i.alias("i")))))

    def starts(hits: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
        table = F.create_map(*[x for w, places in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")) for t, o in places]))])
        own = F.filter(hits, lambda h: h["w"].isin(sorted(postings)))
        return F.flatten(F.transform(own, lambda h: F.transform(F.element_at(table, h["w"]), lambda p: p["t"].cast("long") * _PLACES + h["i"].cast("long") - p["o"].cast("long") + _PLACES // 2)))

    both = F.get(F.transform(F.array(hits), lambda h: F.array_intersect(starts(h, index[0]), starts(h, index[1]))), F.lit(0))
    out = out.withColumn(votes, both)

    def match(v: Column) -> Column:
        template, start = F.get(F.array(*structs), F.floor(v / _PLACES).cast("int")), (v % _PLACES - _PLACES // 2).cast("int")
        stands = (start >= 0) & F.forall(F.transform(template["key"], lambda w, j: F.get(words, start + j).eqNullSafe(w)), lambda x: x)
        near = lambda x: F.exists(F.sequence(F.lit(-SHIFT), F.lit(SHIFT)), lambda e: F.get(words, start + x["d"] + e).eqNullSafe(x["w"]))
        share = template["sure"] + F.aggregate(F.transform(template["around"], lambda x: F.when(near(x), x["weight"]).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        return F.struct(template["label"].alias("label"), template["base"].alias("base"), F.greatest(start - template["at"], F.lit(0)).alias("start"), F.when(stands, F.least(F.lit(1.0), share + 1e-12)).otherwise(0.0).alias("share"), template["least"].alias("least"))

    good = F.filter(F.transform(F.col(votes), match), lambda m: m["share"] >= m["least"])
    matches = F.when(F.size(votes) > 0, F.transform(good, lambda m: F.struct(m["label"].alias("label"), m["base"].alias("base"), m["start"].alias("start"), m["share"].alias("share"))))
    empty = F.expr("cast(array() as array<struct<label:string,base:boolean,start:int,share:double>>)")
    return out.withColumn("n_words", F.size(tokens).cast("long")).withColumn("license_matches", F.coalesce(matches, empty)).drop(tokens, votes)


def op1_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    base = F.filter("license_matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("license_matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("license_matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
