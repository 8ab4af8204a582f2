"""License scans by diagonal voting, all in the JVM.

Every rolling 3-gram of a document's words is joined with the places where the
same words stand in a template.  A match votes for its diagonal, the offset of
document place and template place; all matches of a verbatim copy share one.
Diagonals next to each other are merged, which lets a copy gain or lose a word,
and the span found is verified by the share of the template's gram places it
holds, each counted once.  A short phrase is a template that must be met in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sheaf.llm.native_words import let, letter_words
from sheaf.llm.tables import fitted, integral, small

K = 3
#: Offsets that still count as the next diagonal, and the share of a notice's grams that makes it a find.
NEXT, LEAST = 3, 0.6
#: Grams of templates that may be broadcast.
BROADCAST_GRAMS = 200_000

#: Phrases that name a license, with its label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Opening passages of public license notices, with labels.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}


def templates(spark, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(template, label, phrase, n, place, gram): the grams of all templates; bounded by the parameters.  A phrase needs at least three words."""
    rows = [(f"phrase {label}: {text}", label, True, text) for text, label in phrases.items()] + [(f"notice {label}", label, False, text) for label, text in notices.items()]
    out = []
    for name, label, phrase, text in rows:
        words = text.split()
        if len(words) < K:
            raise ValueError(f"a template of under {K} words: {text}")
        out += [(name, label, phrase, len(words), p, " ".join(words[p : p + K])) for p in range(len(words) - K + 1)]
    body = F.from_json(F.lit(__import__("json").dumps([dict(zip(("template", "label", "phrase", "n", "t_place", "t_gram"), r, strict=True)) for r in out])), "array<struct<template:string,label:string,phrase:boolean,n:int,t_place:int,t_gram:string>>")
    return spark.range(1).select(F.inline(body)).withColumn("t_hash", F.xxhash64("t_gram"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, least: float = LEAST) -> DataFrame:
    """One row for each row: id, n_words, n_base (places of phrases), first_word, last_word (their least and largest start), base_labels, labels, score, spans.

    ``spans``: label, whether of a phrase, [start, stop) in words and share of the
    template, for each verified find.  ``score`` is the best share, 1 for a phrase.
    A null text is empty: no words, no places, empty labels, score 0.  Null and
    repeated ids are rows like others; other columns are left out.
    """
    spark = docs.sparkSession
    known = templates(spark, phrases, notices)
    # One row of no template, which keeps documents without a match.
    known = known.unionByName(spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in known.dtypes if c not in ("t_hash", "t_gram")), F.lit("").alias("t_gram"), F.lit(0).cast("long").alias("t_hash")))

    def grams(w):
        each = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda p: let(F.concat_ws(" ", *(F.get(w, p + j) for j in range(K))), lambda g: F.struct(p.alias("place"), g.alias("gram"), F.xxhash64(g).alias("hash"))))
        own = F.array(F.struct(F.lit(-1).alias("place"), F.lit("").alias("gram"), F.lit(0).cast("long").alias("hash")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.size(w) >= K, F.concat(own, each)).otherwise(own).alias("grams"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), integral(docs, id_col).alias("id"), let(letter_words(F.col(text_col)), grams).alias("of"))
    # The list is a column of its own, else each of its rows would carry all of it.
    rows = rows.select("row", "id", "of.n_words", "of.grams").select("row", "id", "n_words", F.explode("grams").alias("g")).select("row", "id", "n_words", "g.*")
    met = rows.join(small(known, BROADCAST_GRAMS), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram"))).drop("hash", "t_hash", "gram", "t_gram")
    met = met.withColumn("diagonal", F.col("place") - F.col("t_place"))
    votes = met.groupBy("row", "id", "n_words", "template", "label", "phrase", "n", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("t_place").alias("places"))
    # A phrase: all its grams on one diagonal.  A notice: neighbouring diagonals together.
    votes = votes.where(F.col("template").isNull() | ~F.col("phrase") | (F.col("votes") == F.col("n") - (K - 1)))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEXT, F.lit(True)) | F.coalesce(F.col("phrase"), F.lit(True))
    merged = votes.withColumn("cluster", F.sum(apart.cast("int")).over(order))
    spans = merged.groupBy("row", "id", "n_words", "template", "label", "phrase", "n", "cluster").agg(
        F.min("first").alias("start"), (F.max("last") + K).alias("stop"), (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / (F.col("n") - (K - 1))).alias("share")
    )
    # Verified: enough of the template, on a span not much longer than it.
    good = F.col("template").isNotNull() & (F.col("phrase") | ((F.col("share") >= least) & (F.col("stop") - F.col("start") <= 2 * F.col("n"))))
    span = F.when(good, F.struct("label", "phrase", "start", "stop", "share"))
    out = spans.groupBy("row", "id", "n_words").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    # One small row for each document: few files, as each file written starts a process.
    result = out.select(
        F.col("id").alias(id_col), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined("spans").alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"), "spans",
    )
    return fitted(result, docs.count(), 50_000)
