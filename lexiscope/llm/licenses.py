"""License scan: exact phrases, and diagonal voting against license templates.

Every rolling window of K words of every text is hashed and joined to the positions of the same hash in the
templates. A hit at word p of a text and position q of a template votes for the diagonal p - q. Votes are
counted by (text, template, diagonal); neighbouring diagonals, which a few inserted or deleted words
cause, are merged; and a merged span is verified by the share of the template's windows it found.
A bitmap of fixed size spares windows that can't be in a template from the join."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiscope.llm.common import in_bitmap, key_bitmap, materialise, per_document, rolling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
K, SLACK, SHARE = 5, 4, 0.4

#: Sentences of public license texts, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
]


class Words:
    """Word -> 64-bit hash, memoised within bounds."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and everything beyond ASCII."""
    return WORD.findall((text or "").encode().lower())


def windows(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """template, label, pos, total, w: the windows of the templates, a list that code or a caller gives."""
    rows = []
    for t, (label, text) in enumerate(templates):
        h = rolling(Words().hashes(words_of(text)), k).view(np.int64)
        rows += [(t, label, p, len(h), int(x)) for p, x in enumerate(h)]
    return spark.createDataFrame(rows, "template int, label string, pos int, total int, w long")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = K, slack: int = SLACK, share: float = SHARE) -> DataFrame:
    """docs(doc_id, text) -> a row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of the four fixed phrases; first_word and last_word are their smallest
    and largest start (null without any). labels adds those of verified template spans to the base
    ones; both are distinct, sorted and comma-joined (empty: no label). score is 1 with a base phrase, else
    the best share of a template found, 0 for none. spans lists (label, first and last word, share).
    A null or empty text has no words. Repeated rows and null doc_ids stay; other columns are
    ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    places = windows(spark, templates if templates is not None else TEMPLATES, k)
    bitmap = spark.sparkContext.broadcast(key_bitmap(places, "w"))
    phrases = [(label, p.encode().split()) for p, label in PHRASES.items()]
    words = Words()

    def run(ids, texts):
        out = {c: [] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits")}
        targets = [(label, words.hashes(p)) for label, p in phrases]
        for doc_id, text in zip(ids, texts, strict=True):
            h = words.hashes(words_of(text))
            starts, base = [], set()
            for label, p in targets:
                at = np.flatnonzero(h[: max(0, len(h) - len(p) + 1)] == p[0])
                for j in range(1, len(p)):
                    at = at[h[at + j] == p[j]]
                if len(at):
                    base.add(label)
                    starts.append(at)
            every = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            w = rolling(h, k)
            hit = np.flatnonzero(in_bitmap(bitmap.value, w)) if len(w) else []
            for c, v in (("doc_id", doc_id), ("n_words", len(h)), ("n_base", len(every)), ("first_word", int(every.min()) if len(every) else None), ("last_word", int(every.max()) if len(every) else None), ("base", sorted(base)), ("hits", [{"w": int(x), "p": int(p)} for p, x in zip(hit, w[hit].view(np.int64), strict=True)] if len(hit) else [])):
                out[c].append(v)
        return out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<w:long,p:long>>"
    rows = materialise(per_document(docs, ["doc_id", "text"], run, schema).withColumn("row", F.monotonically_increasing_id()))
    hits = rows.filter(F.size("hits") > 0).select("row", F.inline("hits"))
    votes = hits.join(places, "w").select("row", "template", "label", "total", "p", "pos", (F.col("p") - F.col("pos")).alias("diagonal"))
    lanes = votes.groupBy("row", "template", "label", "total", "diagonal").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.collect_set("pos").alias("found"))
    # a lane joins the one before it if they are at most `slack` diagonals apart
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    merged = lanes.withColumn("lane", F.sum(fresh.cast("int")).over(order)).groupBy("row", "template", "label", "total", "lane")
    spans = merged.agg(F.min("low").alias("low"), (F.max("high") + k - 1).alias("high"), (F.size(F.array_distinct(F.flatten(F.collect_list("found")))) / F.col("total")).alias("share"))
    verified = spans.filter(F.col("share") >= share)
    found = verified.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"), F.sort_array(F.collect_list(F.struct("label", "low", "high", "share"))).alias("spans"))
    joined = rows.join(found, "row", "left")
    none = F.expr("cast(array() as array<string>)")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"), text(F.concat("base", F.coalesce("more", none))).alias("labels"), score.alias("score"), F.coalesce("spans", F.expr("cast(array() as array<struct<label:string,low:long,high:long,share:double>>)")).alias("spans"))
