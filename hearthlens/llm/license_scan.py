"""Licence scans: a trained paragraph classifier.

Paragraphs (lines) become hashed word uni- and bigrams; a sparse multinomial
logistic regression names the licence family, a calibrated cut-off sends
doubtful paragraphs to ``unknown``, and a comparison with the family's
templates confirms the prediction.  Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlens.llm import native_lr

NONE = "none"
#: Usual wordings of public licence notices, by family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "This project is available under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Released under the BSD 3-Clause License.", "This software is distributed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Text available under CC-BY 3.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Released under CC BY-NC-SA 4.0 for noncommercial use."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal.", "This work is in the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "Released under the GPL v2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL v3.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced or distributed without prior written permission.", "Copyright, all rights reserved.", "Confidential and proprietary. Unauthorized copying is strictly prohibited."],
}
#: Sentences that use licence words without granting a licence.
LOOKALIKES = ["He renewed his driving license last year.", "The public library is free and open to everyone.", "Version 2.0 of the plan was released in May.",
              "The general public was not admitted to the work site.", "She had permission to use the software at work.", "The Apache helicopter landed under cover of night.",
              "Students at MIT released a new study.", "The Mozilla team published a report.", "Attribution of the painting is disputed.", "The terms of the agreement were modified.",
              "No part of the bridge was damaged.", "Copies of the file were distributed to any person who asked."]


def tokens(paragraph: Column) -> Column:
    """Lower-case word and version tokens."""
    clean = F.regexp_replace(F.lower(F.coalesce(paragraph, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.split(F.trim(clean), " ")


def features(words: Column, dim: int) -> Column:
    """Distinct feature numbers of the words and of the pairs of neighbours."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    two = F.transform(words, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(dim)).cast("int"))
    return F.array_distinct(F.concat(one, two))


def training_table(spark: SparkSession, docs: DataFrame, text: str, sample: int) -> DataFrame:
    """(paragraph, family, part): the templates in several settings, and as
    class ``none`` the lookalikes and ``sample`` different paragraphs of the
    corpus free of licence words (those with the smallest hashes; the bound of
    the classifier's labelled sample).  part 1 is held back for calibration."""
    rows = []
    for family, texts in TEMPLATES.items():
        for i, t in enumerate(texts):
            rows += [(t, family, 0), (t.rstrip(".:"), family, 0), (f"Copyright 20{10 + i} the authors. {t}", family, 0), (f"{t} See the LICENSE file.", family, 0), (f"Note: {t}", family, 1)]
    rows += [(t, NONE, i % 4 // 3) for i, t in enumerate(LOOKALIKES)]
    fixed = spark.createDataFrame(rows, "paragraph string, family string, part int")
    lines = docs.select(F.explode(F.split(F.col(text).cast("string"), "\n")).alias("paragraph")).where("length(paragraph) > 0")
    free = lines.where(~F.lower("paragraph").rlike(r"licen|copyright|permission|rights reserved|spdx|gpl|public domain|cc by"))
    # the hashes alone are made distinct, so that no text is shuffled for it
    free = free.select("paragraph", F.xxhash64("paragraph").alias("h"))
    least = [r["h"] for r in free.select("h").distinct().orderBy("h").limit(sample).collect()]
    picked = free.where(F.col("h").isin(least)).groupBy("h").agg(F.min("paragraph").alias("paragraph"))
    return fixed.unionByName(picked.select("paragraph", F.lit(NONE).alias("family"), F.pmod("h", F.lit(3)).cast("int").alias("m"))
                             .select("paragraph", "family", F.when(F.col("m") == 0, 1).otherwise(0).alias("part")))


class LicenseClassifier:
    """Sparse multinomial weights, the cut-off of the unknown class, templates."""

    def __init__(self, classes, rows, bias, dim, cutoff):
        self.classes, self.rows, self.bias, self.dim, self.cutoff = classes, rows, bias, dim, cutoff

    @classmethod
    def fit(cls, spark: SparkSession, docs: DataFrame, text: str = "text", dim: int = 8192, sample: int = 600,
            reg: float = 0.002, elastic: float = 0.5, false_rate: float = 0.01) -> LicenseClassifier:
        classes = [NONE, *sorted(TEMPLATES)]
        number = F.element_at(F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))]), F.col("family"))
        w = training_table(spark, docs, text, sample).select(tokens(F.col("paragraph")).alias("w"), number.alias("label"), "part")
        t = w.select("label", "part", features(F.col("w"), dim).alias("ids")).cache()  # a few thousand rows
        rows, bias = native_lr.fit(t.where("part = 0"), dim, reg, elastic)
        model = cls(classes, rows, bias, dim, 0.0)
        # calibration on the held-back part: the smallest cut-off that lets
        # at most ``false_rate`` of the paragraphs without a licence through
        top = model.score(t.where("part = 1").select("label", "ids")).select("label", F.col("best.family").alias("f"), F.col("best.p").alias("p"))
        held = [(r["p"] if r["f"] != NONE else 0.0) for r in top.where("label = 0").collect()]
        t.unpersist()
        held.sort(reverse=True)
        model.cutoff = max(0.5, held[int(false_rate * len(held))] + 1e-6 if held else 0.5)
        return model

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``best`` (family, p): the most probable class of ``ids``."""
        # the few features that any class uses get numbers of their own
        used = [i for i in range(self.dim) if any(r[i] for r in self.rows)]
        number = [-1] * self.dim
        for n, i in enumerate(used):
            number[i] = n
        short = F.split(F.lit(",".join(map(str, number))), ",").cast("array<int>")
        kept = rows.withColumn("ids", F.filter(F.transform("ids", lambda i: F.get(short, i)), lambda i: i >= 0))
        z = kept.withColumn("z", F.array(*[native_lr.log_odds(F.col("ids"), [w[i] for i in used], b) for w, b in zip(self.rows, self.bias, strict=True)]))
        z = z.withColumn("zmax", F.array_max("z"))
        z = z.withColumn("p", F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("zmax"))))
        names = F.array(*[F.lit(c) for c in self.classes])
        return z.withColumn("best", F.struct(F.get(names, (F.array_position("z", F.col("zmax")) - 1).cast("int")).alias("family"), "p")).drop("z", "zmax", "p")

    def overlap(self, family: Column, words: Column) -> Column:
        """Largest share of a template's distinct words found in ``words``."""
        out = F.lit(0.0)
        for f, texts in TEMPLATES.items():
            shares = [F.size(F.array_intersect(F.array_distinct(tokens(F.lit(t))), words)) / F.size(F.array_distinct(tokens(F.lit(t)))) for t in texts]
            out = F.when(family == f, F.greatest(*shares)).otherwise(out)
        return out


def scan_paragraphs(docs: DataFrame, model: LicenseClassifier, doc_id: str = "doc_id", text: str = "text", confirm: float = 0.6) -> DataFrame:
    """One row per paragraph: doc_id, paragraph (from 0), family (``none``, a
    licence family, or ``unknown`` below the cut-off), p, overlap, confirmed."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode_outer(F.split(F.col(text).cast("string"), "\n")).alias("paragraph", "line"))
    scored = model.score(lines.withColumn("w", tokens(F.col("line"))).withColumn("ids", features(F.col("w"), model.dim)))
    family, p = F.col("best.family"), F.col("best.p")
    scored = scored.select("doc_id", "paragraph", family.alias("raw"), p.alias("p"), F.when(family != NONE, F.col("w")).alias("w"))
    scored = scored.withColumn("overlap", F.when(F.col("raw") == NONE, 0.0).otherwise(model.overlap(F.col("raw"), F.col("w"))))
    named = F.when(F.col("raw") == NONE, F.lit(NONE)).when(F.col("p") >= model.cutoff, F.col("raw")).otherwise(F.lit("unknown"))
    return scored.select("doc_id", "paragraph", named.alias("family"), "p", "overlap", (F.col("overlap") >= confirm).alias("confirmed"))


def scan(docs: DataFrame, model: LicenseClassifier, doc_id: str = "doc_id", text: str = "text", confirm: float = 0.6) -> DataFrame:
    """One row per doc_id: n_paragraphs, licenses (confirmed families, sorted),
    n_licensed (paragraphs with one), n_unknown (paragraphs that look like a
    licence but are below the cut-off or fit no template), score (largest p of
    a confirmed paragraph, else null).

    Null text has no paragraph, empty text one empty paragraph; rows that
    repeat a doc_id (null included) are counted together; an empty table gives
    no rows; other columns are ignored.  Lines are combined per document in
    the task that made them, before the shuffle.
    """
    p = scan_paragraphs(docs, model, doc_id, text, confirm)
    sure = (F.col("family") != NONE) & (F.col("family") != "unknown") & F.col("confirmed")
    return p.groupBy("doc_id").agg(
        F.count("paragraph").alias("n_paragraphs"),
        F.sort_array(F.collect_set(F.when(sure, F.col("family")))).alias("licenses"),
        F.sum(sure.cast("long")).alias("n_licensed"),
        F.sum(((F.col("family") != NONE) & ~sure).cast("long")).alias("n_unknown"),
        F.max(F.when(sure, F.col("p"))).alias("score"))
