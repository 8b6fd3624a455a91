"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory; DataFrame operations only.

Every line of a text, and the whole text, is compared with licence templates.
Inverse document frequencies are counted over all documents. A unit can only
reach the threshold against a template if it shares one of that template's
heaviest words: the words that may be left out together weigh less than the
threshold (by the Cauchy-Schwarz inequality). So only units with such a word
are taken apart; of these a lower bound of their length drops most, and only
the words of the others are counted in the corpus. Nothing above the threshold
is missed.

A file without a licence of its own takes that of the nearest directory above
it that has one. Directories get theirs from licence files. The chain of
directories above a file is spelled out and joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webframe.llm.common import saved

THRESHOLD = 0.6
# Dots, dashes and plus signs belong to a word only alone between letters or digits; at the ends of a text they are trimmed.
WORD_SPLIT = r"[^a-z0-9]{2,}|[^a-z0-9.+\-]"
JOINERS = ".+-"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"

# Names, notices and opening sentences of public licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is free software; licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution 4.0 International."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0 International."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def words_of(text: Column) -> Column:
    """Lower-cased words."""
    return F.array_remove(F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(JOINERS)), WORD_SPLIT), "")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, license string, text string")


def _frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(word, df)``: in how many texts each word of the vocabulary occurs."""
    words = docs.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    counted = words.join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("df"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))


def _frequencies_of(docs: DataFrame, vocabulary: DataFrame, held: Column) -> DataFrame:
    """The same for words that every text names itself, as a short array."""
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))


def _possible(tf: DataFrame, weights: DataFrame, known_idf: DataFrame, threshold: float) -> DataFrame:
    """``_doc_id, _unit`` of the units that may reach the threshold, before the frequencies of their other words are known.

    No inverse frequency is below one, so a unit's length is at least that with
    one for every word that no template has.
    """
    parts = tf.join(known_idf, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    least = parts.groupBy("doc_id", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("least"))
    least = least.select(F.col("doc_id").alias("_doc_id"), F.col("unit").alias("_unit"), "least")
    dots = parts.join(weights.select("template", "word", "x"), "word").groupBy("doc_id", "unit", "template")
    dots = dots.agg(F.sum(F.col("w") * F.col("x")).alias("dot")).groupBy("doc_id", "unit").agg(F.max("dot").alias("dot"))
    found = dots.join(least, _same(["doc_id", "unit"])).where(F.col("dot") >= (threshold - 1e-9) * F.col("least"))
    return saved(found.select("_doc_id", "_unit"))


def _nothing(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], f"doc_id {kind}, unit int, license string, score double")


def _weights(units: DataFrame, unit: list[str], idf: DataFrame) -> DataFrame:
    """``unit..., word, x``: TF-IDF weights, scaled to length one per unit, of ``units(unit..., word, tf)``."""
    w = units.join(idf, "word").select(*unit, "word", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm.select(*[F.col(u).alias(f"_{u}") for u in unit], "norm"), _same(unit))
    return w.select(*unit, "word", (F.col("w") / F.col("norm")).alias("x"))


def _same(unit: list[str]) -> Column:
    cond = F.lit(True)
    for u in unit:
        cond = cond & F.col(u).eqNullSafe(F.col(f"_{u}"))
    return cond


def own_licenses(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, unit, license, score``: the best template of every document that reaches the threshold.

    *docs* holds ``doc_id`` and ``text``; ``unit`` is the place of the line (from
    0), or -1 where the whole text fits best. Ties go to the earlier unit and
    template.
    """
    docs = docs.select("doc_id", "text")
    known = saved((templates(docs.sparkSession) if known is None else known).select("template", "license", "text"))
    parts = known.select("template", F.explode(words_of(F.col("text"))).alias("word")).groupBy("template", "word").agg(F.count("*").alias("tf"))
    total = docs.count()

    def idf(counted: DataFrame) -> DataFrame:
        return saved(counted.select("word", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1).alias("idf")))

    vocabulary = parts.select("word").distinct()
    listed = F.array(*[F.lit(r["word"]) for r in vocabulary.collect()])  # the words of a few templates
    if not known.limit(1).count() or not vocabulary.limit(1).count():
        return _nothing(docs)
    known_idf = idf(_frequencies_of(docs, vocabulary, F.array_intersect(words_of(F.col("text")), listed)))
    weights = saved(_weights(parts, ["template"], known_idf))
    lighter = Window.partitionBy("template").orderBy("x", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = weights.withColumn("rest", F.sqrt(F.sum(F.col("x") * F.col("x")).over(lighter))).where(F.col("rest") >= threshold)
    marks = F.array(*[F.lit(w) for w in sorted(needed.agg(F.collect_set("word")).first()[0])])
    marked = docs.where(F.col("text").isNotNull() & F.arrays_overlap(words_of(F.col("text")), marks))
    # the whole text and its lines, from one scan
    units = marked.select("doc_id", F.posexplode(F.concat(F.array("text"), F.split("text", "\n", -1))).alias("unit", "line"))
    units = units.select("doc_id", (F.col("unit") - 1).alias("unit"), words_of(F.col("line")).alias("w")).where(F.arrays_overlap("w", marks))
    tf = saved(units.select("doc_id", "unit", F.explode("w").alias("word")).groupBy("doc_id", "unit", "word").agg(F.count("*").alias("tf")))
    tf = saved(tf.join(_possible(tf, weights, known_idf, threshold), _same(["doc_id", "unit"]), "left_semi"))
    mine = _weights(tf, ["doc_id", "unit"], idf(_frequencies(docs, saved(tf.select("word").distinct()))))
    scored = mine.join(weights.select("template", "word", F.col("x").alias("y")), "word")
    scored = scored.groupBy("doc_id", "unit", "template").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    scored = scored.where(F.col("score") >= threshold - 1e-9).join(known.select("template", "license"), "template")
    order = F.struct(F.round("score", 9).alias("s"), (-F.col("unit")).alias("u"), (-F.col("template")).alias("t"), "license", "score")
    best = scored.groupBy("doc_id").agg(F.max(order).alias("b"))
    return best.select("doc_id", (-F.col("b.u")).alias("unit"), "b.license", "b.score")


def folders_above(path: Column) -> Column:
    """All directories that hold a path, the nearest first, the root as the empty string."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, path, license, origin, score, directory`` per row of ``docs(doc_id, path, text)``.

    ``origin`` is ``own``, ``inherited`` (with the directory) or ``none``. A
    directory's licence is the best one among its licence files, ties to the
    smaller name. Null and empty texts, and null paths, have none of their own
    or to inherit. Rows with equal doc_id share what is found in any of them; a
    null doc_id is a key like any other. Other columns are not read.
    """
    docs = docs.select("doc_id", "path", "text")
    own = saved(own_licenses(docs, known, threshold)).withColumnRenamed("doc_id", "_doc")
    d = docs.select("doc_id", "path").join(own, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    d = saved(d)
    givers = d.where(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
    givers = givers.select(F.get(folders_above(F.col("path")), F.lit(0)).alias("directory"), "license", "score")
    ranked = F.min(F.struct((-F.round("score", 9)).alias("s"), "license")).alias("best")
    top = saved(givers.groupBy("directory").agg(ranked).select("directory", F.col("best.license").alias("given")))
    bare = d.where(F.col("license").isNull() & F.col("path").isNotNull()).select("path").distinct()
    chain = bare.select("path", F.posexplode(folders_above(F.col("path"))).alias("up", "directory"))
    heirs = chain.join(top, "directory").groupBy("path").agg(F.min_by(F.struct("directory", "given"), "up").alias("from"))
    heirs = heirs.select(F.col("path").alias("_path"), "from.directory", "from.given")
    out = d.join(saved(heirs), F.col("license").isNull() & (F.col("path") == F.col("_path")), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("license", "given").alias("license"), origin.alias("origin"), "score", "directory")
