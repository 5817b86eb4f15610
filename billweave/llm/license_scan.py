"""Licence scans by a trained paragraph classifier; DataFrame functions only.

Paragraphs (lines) are bags of word n-grams. A multinomial logistic regression with sparse weights, trained on notices of
each family, on notices of foreign licences and on other prose, gives each paragraph the probability of every family and of
`unknown`, which foreign licences are. Families whose marks (name, version, clauses, SA, ND and the like) a paragraph lacks
are left out of its choice, unless all are. Temperature and least probability are calibrated on notices held out from the
fit, foreign ones among them. A paragraph goes on if a family is likelier than unknown and has the least probability, and
is confirmed if it has the marks and holds enough of one of the family's templates. Weights and templates are small tables
of bounded size. Licences named without their version or clauses are families of their own.

The n-grams of most paragraphs are never built: each n-gram that speaks for a family has one word that stands for it, and
a paragraph with fewer of these words than any family needs to become likelier than unknown is unknown in any case.

Defined results: null and empty texts have one empty paragraph, which is unknown; of families equally likely the first in
order counts; rows repeated in the input are rows of the output, also if they share a doc_id; other columns, whatever
their names, are kept out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.llm.common import saved

# Notices by family. Every fourth is held out from the fit, for calibration.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is licensed under the Apache License 2.0.",
        "Distributed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Distributed under the terms of the MIT License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GNU General Public License v3.0.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This software is licensed under the GPLv3.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is licensed under the GNU LGPL v3.0.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "Released under the GNU Lesser General Public License, version 3.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "This project is released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Distributed under CC BY-NC 4.0.",
        "This text is available under CC BY-NC 4.0.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content on this site is available under the Creative Commons Attribution 4.0 license.",
        "Distributed under CC BY 4.0.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the Mozilla Public License 2.0.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright 2019 The Authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
        "(c) The company. All rights reserved.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This software is licensed under the GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Released under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This software is licensed under the LGPLv2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License v2.1.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This software is licensed under the AGPLv3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Released under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License v3.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "This project is released under the 2-Clause BSD License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the BSD 2-Clause License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This text is available under CC BY-SA 4.0.",
        "Distributed under CC BY-SA 4.0.",
    ],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "This text is available under CC BY-ND 4.0.",
        "Distributed under CC BY-ND 4.0.",
    ],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This text is available under CC BY-NC-SA 4.0.",
        "Distributed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-NC-ND-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "This text is available under CC BY-NC-ND 4.0.",
        "Distributed under CC BY-NC-ND 4.0.",
    ],
    "CC0-1.0": [
        "Released under CC0 1.0.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "Licensed under CC0 1.0.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC license.",
    ],
    "Unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Licensed under the Unlicense.",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program is made available under the terms of the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "Released under the Eclipse Public License, version 2.0.",
    ],
    "GPL": [
        "Licensed under the GNU General Public License.",
        "This software is licensed under the GPL.",
        "This program is free software; you can redistribute it under the terms of the GNU General Public License.",
        "Released under the GNU General Public License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License.",
        "This library is licensed under the LGPL.",
        "Released under the GNU Lesser General Public License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD license.",
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the BSD license.",
    ],
    "CC-BY-NC": [
        "Released under the Creative Commons Attribution-NonCommercial license.",
        "Licensed under CC BY-NC.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial License.",
        "Distributed under CC BY-NC.",
    ],
    "CC-BY": [
        "Released under the Creative Commons Attribution license.",
        "Licensed under CC BY.",
        "This work is licensed under a Creative Commons Attribution License.",
        "Distributed under CC BY.",
    ],
}
# The marks of a family. A paragraph has them if it holds an n-gram of every list of the first and none of the second.
GPL_2, GPL_3 = ["version 2", "v2", "gpl 2", "gplv2", "license 2"], ["version 3", "v3", "gpl 3", "gplv3", "license 3", "lgpl 3", "lgplv3", "agpl 3", "agplv3"]
LGPL_2 = ["version 2", "v2", "lgpl 2", "lgplv2", "license 2"]
LGPL_2_1 = ["version 2 1", "v2 1", "lgpl 2 1", "lgplv2 1", "license 2 1"]
GPL_NAMES, LGPL_NAMES, AGPL_NAMES = ["gnu general public", "gpl", "gplv2", "gplv3"], ["lesser general public", "lgpl", "lgplv2", "lgplv3"], ["affero general public", "agpl", "agplv3"]
BSD_CLAUSES = ["0 clause", "1 clause", "2 clause", "3 clause", "4 clause", "zero clause", "two clause", "three clause", "four clause", "simplified bsd", "new bsd", "modified bsd", "original bsd"]
CC_NC, CC_SA, CC_ND = ["by nc", "noncommercial", "non commercial"], ["by sa", "nc sa", "sharealike", "share alike"], ["by nd", "nc nd", "noderivatives", "noderivs", "no derivatives"]
CC_BY, CC_VERSIONS = ["cc by", "commons attribution"], ["1 0", "2 0", "2 1", "2 5", "3 0", "4 0"]
MARKS = {
    "Apache-2.0": ([["apache"], ["2 0", "version 2", "v2", "apache 2", "license 2"]], []),
    "MIT": ([["mit", "permission is hereby"]], []),
    "GPL-2.0": ([GPL_NAMES, GPL_2], []),
    "GPL-3.0": ([GPL_NAMES, GPL_3], []),
    "GPL": ([GPL_NAMES], ["version 1", "gpl 1", "license 1", "v1", *GPL_2, *GPL_3]),
    "LGPL-2.1": ([LGPL_NAMES, LGPL_2_1], []),
    "LGPL-3.0": ([LGPL_NAMES, GPL_3], []),
    "LGPL": ([LGPL_NAMES], [*LGPL_2, *GPL_3]),
    "AGPL-3.0": ([AGPL_NAMES, GPL_3], []),
    "BSD-2-Clause": ([["bsd"], ["2 clause", "two clause", "simplified bsd"]], []),
    "BSD-3-Clause": ([["bsd"], ["3 clause", "three clause", "new bsd", "modified bsd"]], []),
    "BSD": ([["bsd", "redistribution and use"]], BSD_CLAUSES),
    "CC-BY-4.0": ([CC_BY, ["4 0"]], [*CC_NC, *CC_SA, *CC_ND]),
    "CC-BY-SA-4.0": ([CC_BY, CC_SA, ["4 0"]], [*CC_NC, *CC_ND]),
    "CC-BY-ND-4.0": ([CC_BY, CC_ND, ["4 0"]], [*CC_NC, *CC_SA]),
    "CC-BY-NC-4.0": ([CC_BY, CC_NC, ["4 0"]], [*CC_SA, *CC_ND]),
    "CC-BY-NC-SA-4.0": ([CC_BY, CC_NC, CC_SA, ["4 0"]], CC_ND),
    "CC-BY-NC-ND-4.0": ([CC_BY, CC_NC, CC_ND, ["4 0"]], CC_SA),
    "CC-BY-NC": ([CC_BY, CC_NC], [*CC_SA, *CC_ND, *CC_VERSIONS]),
    "CC-BY": ([CC_BY], [*CC_NC, *CC_SA, *CC_ND, *CC_VERSIONS]),
    "CC0-1.0": ([["cc0"], ["1 0"]], []),
    "MPL-2.0": ([["mozilla public", "mpl"], ["2 0", "version 2", "v2", "mpl 2", "license 2"]], []),
    "EPL-2.0": ([["eclipse public", "epl"], ["2 0", "version 2", "v2", "epl 2", "license 2"]], []),
    "ISC": ([["isc", "permission to use"]], []),
    "Unlicense": ([["unlicense", "unencumbered software"]], []),
    "all-rights-reserved": ([["rights reserved", "publication may be"]], []),
}
UNKNOWN = "unknown"
OTHER_PROSE = [
    "", "The meeting starts at nine and ends before noon.", "She got her driving licence in spring.", "Version 2 of the app is faster.",
    "The public library opens at ten.", "They released the report on Monday.", "Please read the terms before you sign.", "A copy of the letter was sent to the office.",
    "The general idea is simple.", "He is free to use the software at work.", "The patient was licensed to drive.", "We distributed the leaflets in town.",
    "The foundation was laid in 1912.", "Conditions on the road are poor.", "The author lives by the sea.", "International flights are delayed.",
    "The source of the river lies in the hills.", "Common sense is rare.", "You may use this room.", "The work is nearly done.",
    "Permission was denied by the court.", "A person in charge will call you.", "The files are in the second drawer.", "The project is under way.",
    "Creative people met in the square.", "The code of the door has changed.", "The rights of the child are protected.", "Subject to change without notice.",
    "In a later version the map was corrected.", "Its identifier is printed on the back.", "They published the list of winners.", "The following people were met at the station.",
]
# Notices of licences that are no family; they are unknown.
FOREIGN = [
    "Licensed under the Artistic License 2.0.", "Released under the zlib License.", "Licensed under the Microsoft Public License.", "Distributed under the Boost Software License, Version 1.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the European Union Public Licence, version 1.2.", "Released under the PostgreSQL License.", "Licensed under the Academic Free License 3.0.",
    "Made available under the Open Database License.", "SPDX-License-Identifier: WTFPL", "Licensed under the Python Software Foundation License, version 2.", "Released under the Common Development and Distribution License, version 1.0.",
    "SPDX-License-Identifier: Zlib", "This project is licensed under the Business Source License 1.1.", "Distributed under the Server Side Public License, version 1.", "Released under the Open Software License, version 3.",
    "SPDX-License-Identifier: BSL-1.0", "This work is licensed under the Free Art License 1.3.", "Licensed under the PHP License, version 3.01.", "This software is licensed under the Elastic License 2.0.",
]
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "in", "is", "it", "its", "may", "of", "on", "or", "that", "the", "this", "to", "under", "was", "we", "with", "you", "your"]
VOCABULARY = 4000
LEAST_HELD = 0.5
TEMPERATURES = [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.4, 2.0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """Distinct runs of one, two and three words that are not stop words alone."""
    stop = F.array(*map(F.lit, STOP))

    def runs(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(at, lambda k: F.slice(words, k, n)), lambda g: F.size(F.array_except(g, stop)) > 0)

    return F.array_distinct(F.transform(F.concat(runs(1), runs(2), runs(3)), lambda g: F.array_join(g, " ")))


@dataclass
class Model:
    families: list[str]  # unknown first
    bias: list[float]
    weights: DataFrame  # gram, weights (array by family); at most VOCABULARY rows
    speaking: list[str]  # words that stand for the n-grams that speak for a family
    needed: int  # so many of them a paragraph has that is not unknown
    templates: DataFrame  # family, template, gram, size
    least: float = 0.0  # probability under which a family is unknown


def least_words(weights: dict[str, list[float]], bias: list[float]) -> tuple[list[str], int]:
    """The words that stand for the n-grams that speak for a family, and how many of them any family needs at least.

    An n-gram's word is its longest that is no stop word. The words' weights for a family, each the sum of its n-grams'
    (over unknown's), bound the family's margin from above; the heaviest ones must make up for the biases.
    """
    held: dict[str, list[float]] = {}
    for gram, x in weights.items():
        word = max((w for w in gram.split(" ") if w not in STOP), key=lambda w: (len(w), w))
        for k in range(1, len(bias)):
            if x[k] > x[0]:
                held.setdefault(word, [0.0] * len(bias))[k] += x[k] - x[0]
    least = len(held)
    for k in range(1, len(bias)):
        total = bias[k] - bias[0]
        for many, x in enumerate(sorted((v[k] for v in held.values()), reverse=True), 1):
            if total > 0:
                many = 0
            total += x
            if total > 0:
                least = min(least, many)
                break
    return sorted(held), least


def train(spark: SparkSession) -> Model:
    """Fits and calibrates a model on the notices."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    families = [UNKNOWN, *sorted(NOTICES)]
    rows = [(families.index(f), k % 4 == 3, x) for f, notices in sorted(NOTICES.items()) for k, x in enumerate(notices)]
    rows += [(0, k % 4 == 3, x) for prose in (OTHER_PROSE, FOREIGN) for k, x in enumerate(prose)]
    notices = spark.createDataFrame(rows, "label int, held_out boolean, text string").coalesce(1)
    notices = notices.withColumn("grams", grams_of(words_of(F.col("text"))))
    fit = notices.where("not held_out")
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=VOCABULARY, minDF=1.0).fit(fit)
    machine = LogisticRegression(family="multinomial", regParam=0.003, elasticNetParam=0.3, maxIter=200, standardization=False).fit(counted.transform(fit))
    matrix, bias = machine.coefficientMatrix.toArray(), [float(x) for x in machine.interceptVector.toArray()]
    kept = [(gram, [float(x) for x in matrix[:, k]]) for k, gram in enumerate(counted.vocabulary) if abs(matrix[:, k]).max() > 1e-6]
    weights = spark.createDataFrame(kept, "gram string, weights array<double>")
    speaking, needed = least_words({gram: x for gram, x in kept}, bias)
    template_rows = [(f, f"{f} {k}", x) for f, notices_ in sorted(NOTICES.items()) for k, x in enumerate(notices_)]
    grams = spark.createDataFrame(template_rows, "family string, template string, text string").coalesce(1).withColumn("grams", grams_of(words_of(F.col("text"))))
    templates = grams.select("family", "template", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    model = Model(families, bias, weights, speaking, needed, templates)
    # calibration: the temperature under which the held-out notices are least surprising
    scored = scores(notices.where("held_out").select(F.monotonically_increasing_id().alias("key"), "label", "grams"), model, ["key", "label", "grams"])
    scored = scored.select("label", marked(F.col("margins"), F.col("grams"), families).alias("margins")).collect()  # a few notices
    import math

    def loss(temperature: float) -> float:
        total = 0.0
        for r in scored:
            z = [x / temperature for x in r.margins]
            total += max(z) + math.log(sum(math.exp(x - max(z)) for x in z)) - z[r.label]
        return total

    best = min(TEMPERATURES, key=loss)
    model.bias = [x / best for x in bias]
    model.weights = spark.createDataFrame([(g, [x / best for x in w]) for g, w in kept], "gram string, weights array<double>")
    # and the least probability with the fewest errors on them, in the middle of the widest gap
    named = []
    for r in scored:
        k = r.margins.index(max(r.margins))
        if k:
            named.append((1 / sum(math.exp((x - r.margins[k]) / best) for x in r.margins), k == r.label))
    at = sorted({0.0, 1.0, *(p for p, _ in named)})
    model.least = min((sum((p >= (x + y) / 2) != right for p, right in named), x - y, (x + y) / 2) for x, y in zip(at, at[1:]))[2]
    return model


def scores(paragraphs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """keys and margins (array by family) of paragraphs(keys, grams)."""
    each = paragraphs.select(*keys, F.explode_outer("grams").alias("gram"))
    met = each.join(F.broadcast(model.weights), "gram", "left")  # VOCABULARY rows at most
    sums = [F.coalesce(F.sum(F.col("weights")[k]), F.lit(0.0)) + F.lit(b) for k, b in enumerate(model.bias)]
    return met.groupBy(*keys).agg(F.array(*sums).alias("margins"))


def marked(margins: Column, grams: Column, families: list[str]) -> Column:
    """Margins in which families whose marks are not among the grams are minus infinity, unless all would be."""

    def any_of(some: list[str]) -> Column:
        return F.arrays_overlap(grams, F.array(*map(F.lit, some)))

    fits = []
    for f in families[1:]:
        needed, barred = MARKS[f]
        fit = any_of(needed[0])
        for some in needed[1:]:
            fit = fit & any_of(some)
        fits.append(fit & ~any_of(barred) if barred else fit)
    left = F.array(margins[0], *(F.when(fit, margins[k]).otherwise(F.lit(float("-inf"))) for k, fit in enumerate(fits, 1)))
    return F.when(F.exists(F.slice(left, 2, len(fits)), lambda z: z > float("-inf")), left).otherwise(margins)


def licence_paragraphs(docs: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, doc_id, n_paragraphs), doc a row's number, and the licence paragraphs found:
    doc, paragraph (from 1), family, probability, held (share of the best template) and confirmed (marked as well)."""
    source = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\r\n]+").alias("paragraphs"))
    each = source.select("doc", "doc_id", F.size("paragraphs").alias("n_paragraphs"), F.posexplode(F.concat(F.array(F.lit("")), "paragraphs")).alias("paragraph", "text"))
    each = each.withColumn("words", words_of(F.col("text"))).where((F.col("paragraph") == 0) | (F.size(F.array_intersect("words", F.array(*map(F.lit, model.speaking)))) >= model.needed))
    each = saved(each.select("doc", "paragraph", F.when(F.col("paragraph") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("paragraph") == 0, F.col("n_paragraphs")).alias("n_paragraphs"), "words"), "paragraphs")
    rows = each.where("paragraph = 0").select("doc", "doc_id", "n_paragraphs")
    grams = each.where("paragraph > 0").select("doc", "paragraph", grams_of(F.col("words")).alias("grams"))
    margins = scores(grams, model, ["doc", "paragraph"]).where(F.array_max(F.slice("margins", 2, len(model.families))) > F.col("margins")[0])
    # what follows is for these few paragraphs only: no other one can be of a family
    near = saved(margins, "margins").join(each.where("paragraph > 0").select("doc", "paragraph", "words"), ["doc", "paragraph"])
    near = saved(near.select("doc", "paragraph", "margins", grams_of(F.col("words")).alias("grams")), "near")
    near = saved(near.withColumn("margins", marked(F.col("margins"), F.col("grams"), model.families)), "marked")
    top = F.array_max("margins")
    names = F.array(*map(F.lit, model.families))
    likely = near.select("doc", "paragraph", F.exists("margins", lambda z: z == float("-inf")).alias("marked"), F.element_at(names, F.array_position("margins", top).cast("int")).alias("family"), (1 / F.aggregate(F.transform("margins", lambda z: F.exp(z - top)), F.lit(0.0), lambda a, x: a + x)).alias("probability"))
    likely = likely.where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.least))
    held = near.select("doc", "paragraph", F.explode("grams").alias("gram")).join(F.broadcast(model.templates), "gram").groupBy("doc", "paragraph", "family", "template", "size").agg(F.count("*").alias("met"))
    held = held.groupBy("doc", "paragraph", "family").agg(F.max(F.col("met") / F.col("size")).alias("held"))
    found = likely.join(held, ["doc", "paragraph", "family"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    return rows, found.select("doc", "paragraph", "family", "probability", "held", (F.col("marked") & (F.col("held") >= LEAST_HELD)).alias("confirmed"))


def licences(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licence (confirmed paragraphs), families (their sorted names) and doubtful (paragraphs
    that no template confirms) of every row."""
    rows, found = licence_paragraphs(docs, model)
    by_doc = found.groupBy("doc").agg(F.count_if("confirmed").alias("n_licence"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"), F.count_if(~F.col("confirmed")).alias("doubtful"))
    joined = rows.join(by_doc, "doc", "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", F.col("n_paragraphs").cast("long").alias("n_paragraphs"), F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("doubtful", zero).alias("doubtful"))
