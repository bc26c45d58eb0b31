"""Licence scans: a trained classifier of passages in paragraphs, confirmed by comparison with templates.

Everything is DataFrame functions and Spark's own logistic regression.  A paragraph's word n-grams are never
all listed: each n-gram of the model has one anchor word, and a word of the text that is an anchor is compared
with its n-grams in place.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Longest n-gram, words between n-grams of one passage at most, lines of the corpus that are trained on as negatives at
#: most and documents' worth of lines they are drawn from, and thresholds: the calibrated probability below which a family is unknown, the share of a template that
#: confirms it, and the share of the negatives from which an n-gram is too common to be used.
WORDS, GAP, NEGATIVES, NEGATIVE_ROWS, LEAST_PROBABILITY, LEAST_TEMPLATE, TOO_COMMON = 3, 8, 400, 400, 0.7, 0.6, 0.01
OTHER, UNKNOWN = "other", "unknown"

# Names of each family's licence, as notices give them.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPL version 3", "GPLv3", "GPL-3.0 license", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPL version 2", "GPLv2", "GPL-2.0 license", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU Library General Public License", "LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["BSD License", "3-Clause BSD License", "2-Clause BSD License", "BSD-style license", "New BSD License", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC"],
    "CC-BY": ["CC BY 4.0", "CC-BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal", "CC0 public domain dedication", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["The Unlicense", "Unlicense", "SPDX-License-Identifier: Unlicense"],
}
# Sentences of the licences themselves, and of the notices that they ask for.
SENTENCES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "GPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"],
    "GPL-2.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"],
    "LGPL": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
}
# How notices put a name.
FRAMES = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This project is available under the {}.", "This software is distributed under the terms of the {}.",
    "License: {}", "{}", "See the file LICENSE, {}.", "The code in this repository is provided under {}.", "Copyright 2020 the authors, {}.", "is made available under the {} by its authors.",
]
# Licences of no family here.
OTHER_NAMES = [
    "Eclipse Public License 2.0", "zlib License", "Artistic License 2.0", "European Union Public Licence", "Boost Software License 1.0", "SIL Open Font License 1.1", "PostgreSQL License", "Academic Free License", "Common Development and Distribution License",
    "Microsoft Public License", "Open Software License 3.0", "Python Software Foundation License", "a commercial license", "a proprietary license", "the license agreement of the vendor", "Acme Public License", "Server Side Public License", "SPDX-License-Identifier: EPL-2.0",
]
# Names of licences that are near a family's and are another, and sentences of such licences.
LOOK_ALIKES = [
    "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives License", "CC BY-ND 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    "Mozilla Public License 1.1", "MPL 1.1", "SPDX-License-Identifier: MPL-1.1", "Apache License 1.1", "Apache Software License 1.0", "SPDX-License-Identifier: Apache-1.1", "GNU General Public License, version 1", "GPL version 1", "GPLv1",
    "MIT No Attribution License", "MIT-0 License", "SPDX-License-Identifier: MIT-0", "BSD Zero Clause License", "Zero-Clause BSD License", "SPDX-License-Identifier: 0BSD", "GNU Free Documentation License", "SPDX-License-Identifier: GFDL-1.3-or-later",
    "Historical Permission Notice and Disclaimer", "SPDX-License-Identifier: HPND", "OpenLDAP Public License", "SPDX-License-Identifier: OLDAP-2.8", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: Zlib", "X11 License", "SPDX-License-Identifier: X11",
]
LOOK_ALIKE_SENTENCES = [
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    "Redistribution and use of this software and associated documentation, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions in source form must retain copyright statements and notices", "Redistributions in binary form must reproduce applicable copyright statements and notices, this list of conditions, and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization",
]
# What denies a notice, what speaks for one before a bare name, and for each family what makes a notice
# another one: other versions, and marks of other variants.
DENIED = r"\b(?:not|never|isn t|aren t|wasn t|neither) (?:be |been |being |yet |to be )?(?:licensed|released|covered|published|available under|made available|distributed under|provided under|under|governed|subject to|offered|the)\b|\bno longer\b|\brather than\b|\binstead of\b|\bunlike\b|\bincompatible with\b"
CUES = r"\b(?:licen[sc]ed?|released?|under|distributed|available|terms?|covered|copyright|provided|conditions?|publish\w*|see|file|spdx|identifier|granted?|permi\w*|subject|governed|fall|falls|dedicated|via|dual)\b"
_OTHER_VERSION = r"(?:as )?(?:v|version|ver)? ?(?!{0})[0-9]"
CONFLICTS = {
    "MIT": r"\bmit 0\b|\bmit no attribution\b", "Apache-2.0": r"\bapache (?:software )?(?:licen[sc]e )?" + _OTHER_VERSION.format("2"), "MPL-2.0": r"\b(?:mpl|mozilla public licen[sc]e) ?" + _OTHER_VERSION.format("2"),
    "GPL-3.0": r"\b(?:gpl|gnu general public licen[sc]e) ?" + _OTHER_VERSION.format("3"), "GPL-2.0": r"\b(?:gpl|gnu general public licen[sc]e) ?" + _OTHER_VERSION.format("2"),
    "LGPL": r"\b(?:lgpl|lesser general public licen[sc]e) ?" + _OTHER_VERSION.format("[23]"), "AGPL-3.0": r"\b(?:agpl|affero general public licen[sc]e) ?" + _OTHER_VERSION.format("3"),
    "BSD": r"\b(?:0 ?bsd|0 clause|zero clause|bsd zero)\b", "CC-BY": r"\b(?:nc|noncommercial|nd|noderiv\w*|sa|sharealike)\b", "CC-BY-SA": r"\b(?:nc|noncommercial|nd|noderiv\w*)\b",
    "CC-BY-NC": r"\b(?:nd|noderiv\w*|sa|sharealike)\b",
}
#: Words before and after an n-gram that are looked at for these, and words of a paragraph that may be a bare name.
BEFORE, AFTER, HEADING = 5, 5, 5
# Paragraphs that share words with notices and are none.
NOT_NOTICES = [
    "All rights reserved.", "Copyright by the author.", "Your driving licence must be renewed under the new rules.", "The software is in version 2 and free of charge.",
    "He studied at MIT and works in public affairs.", "The general public may obtain a copy of the report.", "Permission to enter the building is granted by the office.",
    "Apache helicopters were seen over the source of the river.", "You can use this file without restriction.", "The terms of the work are subject to law.",
    "Foundation courses are free for any person.", "A license is needed to sell alcohol.", "The commons met to discuss the attribution of the painting.",
    "This work is of international interest.", "This program is shown at eight.", "The project is available at any time.", "Version 3 of the document was released in May.",
    "Licensed doctors may redistribute the medicine.", "Conditions of use and related documentation are in the binder.", "4.0 is the average grade; 2.0 is better.",
]
# Words too common to make an n-gram by themselves.
STOP = frozenset("a all and any are as at be by can for from in is it may not of on or that the this to was with you 0 1 2 3 4".split())


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> list[tuple[str, ...]]:
    """Distinct n-grams that hold a word which isn't too common."""
    found = (tuple(words[i : i + n]) for n in range(1, WORDS + 1) for i in range(len(words) - n + 1))
    return list(dict.fromkeys(g for g in found if any(w not in STOP for w in g)))


def anchor_of(gram: tuple[str, ...]) -> int:
    """The place of the word by which an n-gram is looked up: the longest that isn't too common."""
    return max(range(len(gram)), key=lambda i: (gram[i] not in STOP, len(gram[i]), -i))


@dataclass
class LicenceModel:
    """N-grams with a weight for each class, the templates they are in, and the calibration."""

    classes: list[str]
    grams: list[tuple[str, ...]]
    weights: list[list[float]]
    bias: list[float]
    temperature: float
    #: (family, whether a sentence of the licence and not its name, n-grams)
    templates: list[tuple[str, bool, frozenset[tuple[str, ...]]]]

    def anchors(self, spark: SparkSession) -> DataFrame:
        """``(anchor, place, words_of_gram, gram)``, a few thousand rows for any corpus."""
        rows = [(g[i], i, list(g), k) for k, g in enumerate(self.grams) for i in (anchor_of(g),)]
        return spark.createDataFrame(rows, "anchor string, place int, gram_words array<string>, gram int")

    def table(self, spark: SparkSession) -> DataFrame:
        """``(gram, weights, templates)``: what each n-gram says."""
        within = defaultdict(list)
        for k, (*_, own) in enumerate(self.templates):
            for g in own:
                within[g].append(k)
        return spark.createDataFrame([(k, w, within[g]) for k, (g, w) in enumerate(zip(self.grams, self.weights, strict=True))], "gram int, weights array<double>, templates array<int>")


def notices(family: str, frames: list[str]) -> list[list[str]]:
    """Words of the training notices of a family: its names in frames, its sentences, and parts of these."""
    found = [words_of(frame.format(name)) for name in NAMES.get(family, [*OTHER_NAMES, *LOOK_ALIKES]) for frame in frames]
    for text in SENTENCES.get(family, LOOK_ALIKE_SENTENCES if family == UNKNOWN else []):
        own = words_of(text)
        found += [own, own[1:], own[: len(own) * 3 // 4], own[len(own) // 3 :], own[: len(own) // 2]]
    return found


def _fit(spark: SparkSession, rows: list, classes: int, size: int):
    data = spark.createDataFrame([(float(y), Vectors.sparse(size, {k: 1.0 for k in x})) for y, x in rows], ["y", "x"]).coalesce(1)
    fitted = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=3e-4, maxIter=60, standardization=False).fit(data)
    coefficients, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    assert coefficients.shape == (classes, size)
    return coefficients, bias


def negative_lines(documents: DataFrame, text_col: str, most: int) -> list[list[str]]:
    """Words of at most ``most`` distinct lines of the corpus that name no licence, the first by a hash.

    Lines are drawn by their hash, about as many as ``NEGATIVE_ROWS`` documents have, so few are shuffled.
    """
    share = max(1, documents.count() // NEGATIVE_ROWS)
    named = "licen[sc]e|copyright|permission|redistribut|spdx|creative commons|public domain"
    lines = documents.select(F.explode(F.split(text_col, "\n")).alias("p")).where((F.length("p") > 0) & (F.pmod(F.xxhash64("p"), F.lit(share)) == 0) & ~F.lower("p").rlike(named))
    return [words_of(r["p"]) for r in lines.distinct().orderBy(F.xxhash64("p"), "p").limit(most).collect()]


def train(documents: DataFrame, text_col: str = "text", negatives: int = NEGATIVES, frames: list[str] | None = None) -> LicenceModel:
    """Fit the classifier on the notices, and on at most ``negatives`` lines of ``documents`` as ``other``.

    Notices of licences of no family are the class ``unknown``.  The n-grams are those that two training notices
    share and few of the negatives have.  A third of the examples set the temperature by which probabilities are
    calibrated, by a model that has not seen them; the final fit takes all.  Templates are the names and sentences.
    """
    spark, frames = documents.sparkSession, frames or FRAMES
    classes = [OTHER, UNKNOWN, *NAMES]
    lines = negative_lines(documents, text_col, negatives)
    examples = [(0, w) for w in [*map(words_of, NOT_NOTICES), *lines]]
    examples += [(y, w) for y, family in enumerate(classes) if y for w in notices(family, frames)]
    held, common = Counter(), Counter()
    for y, w in examples:
        (held if y else common).update(grams_of(w))
    grams = sorted(g for g, n in held.items() if n > 1 and common[g] <= TOO_COMMON * (len(lines) + len(NOT_NOTICES)))
    number = {g: i for i, g in enumerate(grams)}
    rows = [(y, x) for y, w in examples if (x := sorted({number[g] for g in grams_of(w) if g in number}))]  # passages have an n-gram
    size = (len(classes), len(grams))
    left_out = [r for k, r in enumerate(rows) if k % 3 == 1]
    temperature = _temperature(*_fit(spark, [r for k, r in enumerate(rows) if k % 3 != 1], *size), left_out)
    coefficients, bias = _fit(spark, rows, *size)
    texts = [(f, False, t) for f in NAMES for t in NAMES[f]] + [(f, True, t) for f, own in SENTENCES.items() for t in own]
    texts += [(UNKNOWN, False, t) for t in (*OTHER_NAMES, *LOOK_ALIKES)] + [(UNKNOWN, True, t) for t in LOOK_ALIKE_SENTENCES]
    templates = [(family, sentence, frozenset(g for g in grams_of(words_of(text)) if g in number)) for family, sentence, text in texts]
    return LicenceModel(classes, grams, coefficients.T.tolist(), bias.tolist(), temperature, [t for t in templates if t[2]])


def _temperature(coefficients, bias, rows: list) -> float:
    """The divisor of the scores, from a grid, that makes the examples left out most likely."""
    import numpy as np

    scores = np.array([coefficients[:, x].sum(axis=1) for _, x in rows]) + bias
    y = np.array([y for y, _ in rows])

    def loss(t: float) -> float:
        z = scores / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    return min((0.25 * k for k in range(1, 21)), key=loss)


def licence_paragraphs(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, first_word, n_words, family, probability, template_share, confirmed)``: the passages that are a licence notice.

    A paragraph is a run of lines that aren't blank, numbered from 0, so a notice may be wrapped over lines.  Where
    its n-grams of the model lie at most ``GAP`` words apart they make one passage, from ``first_word`` (0 is the
    paragraph's first) over ``n_words``; prose around a notice doesn't count.  A passage's distinct n-grams give each
    class a score; ``probability`` is that of the best class after calibration.  ``family`` is ``unknown`` where that
    class is best, below ``LEAST_PROBABILITY``, and where the templates don't confirm it (``confirmed``).  Of all
    templates, those of near-by licences too, that are in the passage to at least ``LEAST_TEMPLATE`` of their n-grams
    the one with most n-grams there must be of the family; ``template_share`` is the greatest share of the family's own.
    The words around must not deny the notice or name another version or variant (``DENIED``, ``CONFLICTS``), and where
    the template is a bare name a word of a notice (``CUES``) must come before, or the paragraph be short.  Passages of
    the class ``other`` are left out.

    The words of the texts are met with the model's anchors by a broadcast join (its size does not depend on
    the corpus); only n-grams that are found are shuffled, once, by row and paragraph.  Null and empty texts give no
    rows; null ids are returned as such; repeated rows are each returned; ties go to the first class; two notices that
    are nearer than ``GAP`` are one passage; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    n = len(model.classes)
    parts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"\n(?:[ \t\r\x0b\f]*\n)+")).alias("paragraph", "body"))
    words = parts.select("row", "doc_id", "paragraph", F.split(F.regexp_replace(F.lower("body"), "^[^a-z0-9]+", ""), "[^a-z0-9]+").alias("words"))
    placed = words.select("row", "doc_id", "paragraph", "words", F.posexplode("words").alias("at", "anchor"))
    same = F.slice("words", F.greatest(F.lit(1), F.col("at") - F.col("place") + 1), F.size("gram_words")) == F.col("gram_words")
    found = placed.join(F.broadcast(model.anchors(spark)), "anchor").where((F.col("at") >= F.col("place")) & same)
    begin, end = F.col("at") - F.col("place"), F.col("at") - F.col("place") + F.size("gram_words")
    first = F.greatest(F.lit(0), begin - BEFORE)
    before = F.array_join(F.slice("words", first + 1, begin - first), " ")
    around = F.array_join(F.slice("words", first + 1, end - first + AFTER), " ")
    against = sum((F.when(around.rlike(rx), 1 << model.classes.index(f)).otherwise(0) for f, rx in CONFLICTS.items()), F.lit(0))
    found = found.select(
        "row", "doc_id", "paragraph", begin.alias("at"), end.alias("end"), "gram", F.when(around.rlike(DENIED), -1).otherwise(against).alias("against"),
        (before.rlike(CUES) | (F.size("words") <= HEADING)).alias("cued"),
    )
    # Passages: an n-gram that begins more than GAP words after all before it have ended opens one.
    order = Window.partitionBy("row", "paragraph").orderBy("at", "gram")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(F.col("at") - before > GAP, 1).otherwise(0))
    placed = opened.withColumn("passage", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A gram counts once a passage, however often it occurs there.
    keys = ["row", "paragraph", "passage"]
    once = placed.groupBy(*keys, "gram").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.max("end").alias("end"), F.bit_or("against").alias("against"), F.max("cued").alias("cued"))
    each = once.join(F.broadcast(model.table(spark)), "gram").groupBy(*keys).agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.max("end").alias("end"),
        *(F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(n)), F.flatten(F.collect_list("templates")).alias("within"), F.bit_or("against").alias("against"), F.max("cued").alias("cued"),
    )
    scores = F.array(*((F.col(f"w{i}") + model.bias[i]) / model.temperature for i in range(n)))
    rated = each.withColumn("scores", scores).withColumn("top", F.array_max("scores")).withColumn("best", F.array_position("scores", F.col("top")).cast("int") - 1).where("best > 0")
    mass = F.aggregate(F.transform("scores", lambda s: F.exp(s - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    # The templates as columns of one row: their class, whether sentences, and the number of their n-grams.
    own = F.array(*(F.struct(F.lit(model.classes.index(f)).alias("c"), F.lit(sentence).alias("s"), F.lit(len(t)).alias("n")) for f, sentence, t in model.templates))
    met = F.transform(own, lambda t, k: F.struct(F.size(F.filter("within", lambda x: x == k)).alias("m"), t["c"].alias("c"), t["s"].alias("s"), t["n"].alias("n"), (-k).alias("k")))
    rated = rated.withColumn("met", F.filter(met, lambda t: t["m"] > 0))
    shares = F.transform("met", lambda t: F.when(t["c"] == F.col("best"), t["m"] / t["n"]).otherwise(0.0))
    near = F.filter("met", lambda t: t["m"] / t["n"] >= LEAST_TEMPLATE)
    top = F.array_max(F.transform(near, lambda t: F.struct(t["m"].alias("m"), (t["m"] / t["n"]).alias("share"), t["k"].alias("k"), t["c"].alias("c"), t["s"].alias("s"))))
    rated = rated.withColumns({"probability": 1 / mass, "template_share": F.coalesce(F.array_max(shares), F.lit(0.0)), "template": top})
    names = F.array(*(F.lit(c) for c in model.classes))
    fits = F.col("against").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("best"))) == 0
    confirmed = F.coalesce((F.col("template.c") == F.col("best")) & fits & (F.col("template.s") | F.col("cued")), F.lit(False))
    family = F.when((F.col("probability") >= LEAST_PROBABILITY) & confirmed, names[F.col("best")]).otherwise(UNKNOWN)
    return rated.select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("at").alias("first_word"), (F.col("end") - F.col("at")).alias("n_words"),
        family.alias("family"), "probability", "template_share", confirmed.alias("confirmed"),
    )
