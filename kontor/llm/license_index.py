"""License scan by a positional rare-token index, in DataFrame operations only.

Templates are word sequences of license notices. The index keeps the postings (template,
position) of each template's rarest words, by document frequency over the whole corpus. A file
looks up every word that the index has (a few for each template); each meeting of a posting and a place in
the file proposes a template at a relative position, and proposals from different words fall
together. A proposal is verified word by word at that position: enough of the template must be
there, and all of its mandatory key phrase.

Everything happens inside the row; the only shuffle counts the template words of the corpus
(a fixed list), so a hot source or a very frequent license costs nothing more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.frames import landed

# Label, notice, mandatory phrase of the notice (lower case, single spaces).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
               "without warranties or conditions of any kind either express or implied", "distributed on an as is basis"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("artistic", "you may distribute this package under the terms of the artistic license", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
     "retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution", "reproduce the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
            "software without specific prior written permission", "endorse or promote products"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc", "licensed under cc by nc 4 0", "cc by"),
    ("cc", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
     "waived all copyright"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "under the terms of the gnu general public license", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
            "the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "with or without fee"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
            "and or sell copies of the software", "merge publish distribute sublicense"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     "copies or substantial portions"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
            "you can obtain one at", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
             "arising from the use of this software", "in no event will the authors be held liable"),
)
BASE = (("apache", ("apache", "license")), ("gpl", ("general", "public", "license")), ("mit", ("mit", "license")))
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ENOUGH = 0.8
_BITS = len(TEMPLATES).bit_length()         # of a template number in a proposal
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _template_words() -> list[list[str]]:
    return [notice.split() for _, notice, _ in TEMPLATES]


def _spare(n: int) -> int:
    """Words that a notice of ``n`` may lack."""
    return n - next(k for k in range(n + 1) if k / n >= ENOUGH)


def _key_span(i: int) -> tuple[int, int]:
    words, key = TEMPLATES[i][1].split(), TEMPLATES[i][2].split()
    at = next(p for p in range(len(words)) if words[p: p + len(key)] == key)
    return at, at + len(key)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def rare_words(docs: DataFrame) -> DataFrame:
    """One row: ``idf``, a map of each template's rarest words that the corpus has to their IDF.

    A notice that counts may lack some words; the index has one word more of each template, so at least one of
    them is there. A template too many of whose words no document has is found nowhere and has no words."""
    vocabulary = sorted({w for ws in _template_words() for w in ws})
    present = docs.select(F.array_intersect(words_of(F.col("text")), _strings(vocabulary)).alias("w"))
    # '' counts the documents in the same aggregation
    counts = (present.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("df")))
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct("w", "df"))).alias("df"))
    notices, spare = F.array(*[_strings(ws) for ws in _template_words()]), F.array(*[F.lit(_spare(len(ws))) for ws in _template_words()])
    known = lambda ws: F.filter(ws, lambda w: F.element_at("df", w).isNotNull())

    def rarest(ws: Column, t: Column) -> Column:
        by_df = F.array_sort(F.transform(F.array_distinct(known(ws)), lambda w: F.struct(F.element_at("df", w).alias("df"), w.alias("w"))))
        return F.when(F.size(known(ws)) >= F.size(ws) - F.get(spare, t), F.slice(by_df, 1, F.get(spare, t) + 1))
    every = F.array_distinct(F.flatten(F.filter(F.transform(notices, rarest), lambda x: x.isNotNull())))
    return table.select(F.map_from_entries(F.transform(every, lambda x: F.struct(
        x["w"].alias("key"), F.log((F.element_at("df", F.lit("")) + 1) / (x["df"] + 1)).alias("value")))).alias("idf"))


def _proposals(words: Column, top: Column) -> Column:
    """Distinct (t, at): template t would begin at word ``at``. Told apart as numbers, by a hash set."""
    at: dict[str, list[Column]] = {}
    for t, ws in enumerate(_template_words()):
        for p, w in enumerate(ws):
            at.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")))
    postings = F.create_map(*[c for w, places in at.items() for c in (F.lit(w), F.array(*places))])
    places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(top, h["w"]))
    met = F.transform(places, lambda h: F.transform(F.element_at(postings, h["w"]),
                                                     lambda p: F.shiftleft((h["i"] - p["p"]).cast("long"), _BITS).bitwiseOR(p["t"].cast("long"))))
    return F.transform(F.array_distinct(F.flatten(met)), lambda c: F.struct(c.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int").alias("t"),
                                                                           F.shiftright(c, _BITS).cast("int").alias("at")))


def _verified(words: Column, proposals: Column) -> Column:
    """(label, share) of each proposal that holds."""
    notices = F.array(*[_strings(ws) for ws in _template_words()])
    labels = _strings([t[0] for t in TEMPLATES])
    keys = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in map(_key_span, range(len(TEMPLATES)))])

    def check(c: Column) -> Column:
        notice = F.get(notices, c["t"])
        same = F.transform(notice, lambda w, i: F.coalesce(F.get(words, c["at"] + i) == w, F.lit(False)))
        key = F.get(keys, c["t"])
        whole = F.forall(F.slice(same, key["a"] + 1, key["b"] - key["a"]), lambda x: x)
        share = F.size(F.filter(same, lambda x: x)) / F.size(notice)
        return F.struct(F.get(labels, c["t"]).alias("label"), F.when(whole, share).otherwise(0.0).alias("share"))
    return F.filter(F.transform(proposals, check), lambda x: x["share"] >= ENOUGH)


def scan(docs: DataFrame) -> DataFrame:
    """``docs``' doc_id with n_words, places (label, word) of the base phrases, found (label, share)
    of the templates: one row per row.

    NULL text counts as empty: no words, nothing found. Repeated rows give repeated rows, NULL ids
    stay, other columns are ignored, an empty table gives an empty table."""
    rare = landed(rare_words(docs))
    idf = rare.scalar()
    w = docs.select("doc_id", words_of(F.col("text")).alias("words"), idf.alias("idf"))
    w = w.withColumn("top", F.array_intersect("words", F.coalesce(F.map_keys("idf"), F.array().cast("array<string>"))))
    none = F.array().cast("array<struct<label:string,share:double>>")
    found = F.when(F.size("top") > 0, _verified(F.col("words"), _proposals(F.col("words"), F.col("top")))).otherwise(none)
    ends = F.when(F.array_contains("words", "license"), F.filter(
        F.transform("words", lambda x, i: F.when(x == "license", i).otherwise(-1)), lambda i: i >= 0)).otherwise(F.array().cast("array<int>"))
    w = w.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", found.alias("found"), ends.alias("ends"))

    def starts(label: str, phrase: tuple[str, ...]) -> Column:
        n = len(phrase)
        def whole(i: Column) -> Column:
            ok = F.lit(True)
            for k, word in enumerate(phrase[:-1]):
                ok = ok & F.coalesce(F.get("words", i - (n - 1 - k)) == word, F.lit(False))
            return ok
        return F.transform(F.filter("ends", whole), lambda i: F.struct(F.lit(label).alias("label"), (i - (n - 1)).cast("long").alias("word")))
    return w.select("doc_id", "n_words", F.concat(*[starts(*b) for b in BASE]).alias("places"), "found")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a :func:`scan`."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda x: x["label"]), F.transform("found", lambda x: x["label"]))))
    at = F.transform("places", lambda x: x["word"])
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return scanned.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"),
                          F.array_max(at).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
                          F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))


def licenses(docs: DataFrame) -> DataFrame:
    return digest(scan(docs))
