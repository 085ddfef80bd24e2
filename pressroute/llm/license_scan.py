"""Licence scans by a positional index of rare words."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressroute.llm.common import alnum_words, key_map, once, stage, with_key_flag
from pressroute.operators.joins import split_join

# Phrases, labels and wordings that public licences use.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, wording, key phrases that must stand in the text near the wording's place)
TEMPLATES = [
    ("mit-notice", "Released under the MIT License", ["mit license"]),
    ("mit-notice", "Licensed under the MIT License", ["mit license"]),
    ("mit-notice", "The MIT License MIT Copyright", ["mit license"]),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to "
     "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at", ["apache license version 2 0", "except in compliance with the license"]),
    ("gpl-3-notice", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-2-notice", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-3-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
     ["gnu general public license", "version 3 of the license"]),
    ("gpl-2-text", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
     ["gnu general public license", "version 2 of the license"]),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl-text", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
     "the Free Software Foundation", ["gnu affero general public license"]),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions "
     "and the following disclaimer", ["redistribution and use in source and binary forms", "must retain the above copyright notice"]),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies",
     ["for any purpose with or without fee is hereby granted"]),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ["mozilla public license", "2 0"]),
    ("unlicense-text", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ["creative commons attribution 4 0 international"]),
]

#: Highest-IDF words of a template that are in the index, and the share of the highest IDF that a word must have:
#: common words of the language stay out, or every file would have to be read again.
INDEXED, LEAST_IDF = 6, 0.5
#: Share of a template's indexed weight that must meet at one place, and of its whole weight that must stand near it.
MEET, COVER = 0.5, 0.8
#: Words before and after a template's place that count as near.
SLACK = 12
KEY = ["k1", "k2"]


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def _templates(idf: dict[str, float]) -> list[dict]:
    """Base phrases, indexed whole, and templates, indexed by their highest-IDF words (of equals, the first by name)."""
    found = []
    for phrase, label in BASE_PHRASES.items():
        found.append({"label": label, "base": True, "words": _words(phrase), "phrases": [], "indexed": set(_words(phrase))})
    for label, wording, phrases in TEMPLATES:
        words = _words(wording)
        rare = sorted(set(words), key=lambda w: (-idf[w], w))[:INDEXED]
        found.append({"label": label, "base": False, "words": words, "phrases": [f" {p} " for p in phrases],
                      "indexed": {w for w in rare if idf[w] >= LEAST_IDF * idf[rare[0]]}})
    return found


def vocabulary() -> list[str]:
    return sorted({w for p in BASE_PHRASES for w in _words(p)} | {w for _, t, _ in TEMPLATES for w in _words(t)})


def _template_frames(spark: SparkSession, idf: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """The index (a row per indexed word and place) and the templates; both as small as the fixed lists above."""
    found = _templates(idf)
    postings = [(t, w, at, idf[w]) for t, x in enumerate(found) for at, w in enumerate(x["words"]) if w in x["indexed"]]
    rows = [(t, x["label"], x["base"], len(x["words"]), sorted(set(x["words"])), x["phrases"], {w: idf[w] for w in x["words"]},
             sum(idf[w] for w in set(x["words"])), sum(idf[w] for w in x["words"] if w in x["indexed"])) for t, x in enumerate(found)]
    return (spark.createDataFrame(postings, "template int, term string, place int, weight double"),
            spark.createDataFrame(rows, "template int, label string, base boolean, size int, words array<string>, phrases array<string>, "
                                        "idf map<string,double>, total double, indexed double"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, base_places, base_labels, labels, score``.

    ``base_places`` holds (label, start) of every place where a base phrase's words stand
    consecutively. ``labels`` are the base labels and those of the templates that were found;
    ``score`` is the largest share of a template's IDF weight found near one of its places, 0 without
    any whose key phrases stand there.

    IDF counts the given documents. All indexed words in a file are looked up, and those of base
    phrases all of whose words it has; a posting of the index minus the word's place in the file
    names where a template would start, and postings must meet there. Only files with an indexed word are read again; equal
    texts are looked at once.

    Null and empty texts have no words, no places and score 0; repeated rows give repeated rows;
    null ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), F.col("text"))})
    listed = F.lit(vocabulary())
    seen = stage(rows.withColumn("file", alnum_words(F.col("text"))).select(
        "doc_id", *KEY, F.size("file").cast("long").alias("n_words"), F.array_intersect(listed, F.col("file")).alias("present")), "license-seen")

    total = seen.count()
    counted = {r["term"]: r["n"] for r in seen.select(F.explode("present").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most the fixed vocabulary
    idf = {w: math.log((total + 1) / (counted.get(w, 0) + 0.5)) for w in vocabulary()}
    idf = {w: max(x, 1e-3) for w, x in idf.items()}
    index, templates = _template_frames(spark, idf)
    indexed = sorted({w for t in _templates(idf) if not t["base"] for w in t["indexed"]})

    looked = F.array_intersect(F.lit(indexed), F.col("present"))  # bounded by the fixed templates
    for phrase in BASE_PHRASES:  # its words may be common ones of some language; it can stand only where all of them are
        words = F.lit(_words(phrase))
        looked = F.array_union(looked, F.when(F.size(F.array_except(words, F.col("present"))) == 0, words).otherwise(
            F.array().cast("array<string>")))
    wanted = stage(seen.select(*KEY, looked.alias("looked")).where(F.size("looked") > 0).groupBy(*KEY).agg(
        F.first("looked").alias("looked")), "license-wanted")
    again = with_key_flag(rows, key_map(wanted, KEY, "license-texts"), KEY, "again").where("again")
    files = stage(split_join(again.select(*KEY, "text"), wanted, KEY).groupBy(*KEY).agg(
        F.first("text").alias("text"), F.first("looked").alias("looked")), "license-files")

    places = files.select(*KEY, "looked", F.posexplode(alnum_words(F.col("text"))).alias("pos", "term")).where(
        F.array_contains("looked", F.col("term"))).select(*KEY, "term", "pos")
    meets = places.join(F.broadcast(index), "term").withColumn("start", F.col("pos") - F.col("place"))
    met = meets.groupBy(*KEY, "template", "start").agg(F.collect_set(F.struct("place", "weight")).alias("met")).join(
        F.broadcast(templates.select("template", "label", "base", "size", "indexed")), "template")
    weight = F.aggregate("met", F.lit(0.0), lambda x, p: x + p["weight"])
    kept = stage(met.where(F.when(F.col("base"), F.size("met") == F.col("size")).otherwise(weight >= MEET * F.col("indexed"))).select(
        *KEY, "template", "label", "base", "start"), "license-met")

    base = kept.where("base").groupBy(*KEY).agg(
        F.collect_list(F.struct("label", "start")).alias("base_places"), F.collect_set("label").alias("base_labels"))
    starts = kept.where("not base").groupBy(*KEY, "template").agg(F.collect_list("start").alias("starts"))
    found = starts.join(F.broadcast(templates.drop("base")), "template").join(files.select(*KEY, "text"), KEY)

    def near(file, start):
        after = F.greatest(start - SLACK, F.lit(0))
        return F.slice(file, after + 1, start + F.col("size") + SLACK - after)

    spoken = lambda words: F.concat(F.lit(" "), F.concat_ws(" ", words), F.lit(" "))
    cover = lambda words: F.aggregate(F.array_intersect("words", words), F.lit(0.0), lambda x, w: x + F.col("idf")[w]) / F.col("total")
    share = lambda near: once(near, lambda words: F.when(
        once(spoken(words), lambda s: F.forall("phrases", lambda p: F.contains(s, p))), F.least(cover(words), F.lit(1.0))))
    shares = once(alnum_words(F.col("text")), lambda file: F.transform("starts", lambda start: share(near(file, start))))
    checked = found.select(*KEY, "label", F.array_max(shares).alias("cover")).where("cover is not null")
    told = checked.groupBy(*KEY).agg(F.collect_set(F.when(F.col("cover") >= COVER, F.col("label"))).alias("own"), F.max("cover").alias("score"))

    texts = stage(base.join(told, KEY, "full"), "license-found")
    nothing = F.array().cast("array<string>")
    return split_join(seen.select("doc_id", *KEY, "n_words"), texts, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("base_places", F.array().cast("array<struct<label:string,start:int>>")).alias("base_places"),
        F.array_sort(F.coalesce("base_labels", nothing)).alias("base_labels"),
        F.array_sort(F.array_union(F.coalesce("base_labels", nothing), F.coalesce("own", nothing))).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
