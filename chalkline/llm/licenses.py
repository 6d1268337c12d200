"""Licence scans: trained classifier of licence statements on sparse word pairs, confirmed by templates.

Texts are cut into paragraphs at blank lines (lines without a letter or digit), so a statement that is wrapped over
lines, with comment marks or not, is read as one. Words are lower-case; the end of a sentence is a word of its own.
Where word pairs of the templates stand close together (``GAP`` words), they are one passage; its distinct pairs are
the features of a multinomial logistic regression over licence families, an unknown licence and no licence. The model
is trained on variants of the templates with words left out and other text around them, on statements of made-up
licences (unknown) and on near misses (none), at most ``VARIANTS`` rows for each sentence below; a temperature found
on held-out variants calibrates it. It is fitted once in a Python process and kept, some hundred pairs in size.

A family is reported for a passage if its probability against the unknown and no licence reaches ``SURE`` and the
passage holds ``ENOUGH`` of one of its templates, pairs of several families counting less, and the family's ``MARKS``
(the LGPL's words hold most of the GPL's, but not its name); so a passage may grant two licences. A passage of no such
family that is a licence rather than none, by ``SURE``, from ``LEAST_PAIRS`` pairs at least, and with the words by
which licences are granted, is unknown.

Main path in DataFrame functions only. Defined results: null and empty texts, and paragraphs without any template
pair, give no rows; repeated rows give their findings once each; null ids are kept; an empty table gives no rows;
extra columns are not read. A text costs in proportion to its words, whatever its lines.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Training rows of a sentence; most words between pairs of a passage; least probability and template share of a named family, pairs of any licence.
VARIANTS, GAP, SURE, ENOUGH, LEAST_PAIRS = 24, 10, 0.5, 0.7, 2
# SPDX identifiers, and the statements by which licences are granted.
SPDX = (
    ("mit", "MIT"), ("apache-2.0", "Apache-2.0"), ("gpl-2.0", "GPL-2.0-or-later"), ("gpl-2.0", "GPL-2.0-only"), ("gpl-3.0", "GPL-3.0-or-later"),
    ("gpl-3.0", "GPL-3.0-only"), ("lgpl", "LGPL-2.1-or-later"), ("lgpl", "LGPL-3.0-only"), ("agpl-3.0", "AGPL-3.0-or-later"), ("agpl-3.0", "AGPL-3.0-only"),
    ("bsd", "BSD-2-Clause"), ("bsd", "BSD-3-Clause"), ("isc", "ISC"), ("mpl-2.0", "MPL-2.0"), ("epl-2.0", "EPL-2.0"), ("cc0", "CC0-1.0"),
    ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"), ("cc-by-nc", "CC-BY-NC-4.0"), ("unlicense", "Unlicense"),
    ("zlib", "Zlib"), ("bsl-1.0", "BSL-1.0"), ("artistic-2.0", "Artistic-2.0"),
)
STATEMENTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "The MIT License (MIT)"),
    ("mit", "MIT license"),
    ("apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "Apache License 2.0"),
    ("apache-2.0", "under the Apache 2.0 license"),
    ("gpl-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl-2.0", "GNU General Public License as published by the Free Software Foundation; version 2 of the License"),
    ("gpl-2.0", "GNU General Public License, Version 2, June 1991"),
    ("gpl-2.0", "GNU General Public License v2"),
    ("gpl-2.0", "the GPLv2"),
    ("gpl-2.0", "GPL version 2"),
    ("gpl-3.0", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("gpl-3.0", "GNU General Public License, Version 3, 29 June 2007"),
    ("gpl-3.0", "GNU General Public License v3"),
    ("gpl-3.0", "the GPLv3"),
    ("gpl-3.0", "GPL version 3"),
    ("lgpl", "GNU Lesser General Public License, Version 3, 29 June 2007"),
    ("lgpl", "GNU Lesser General Public License, Version 2.1, February 1999"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", "GNU Library General Public License"),
    ("lgpl", "the LGPLv3"),
    ("lgpl", "the LGPL 2.1"),
    ("agpl-3.0", "GNU Affero General Public License, Version 3, 19 November 2007"),
    ("agpl-3.0", "GNU Affero General Public License"),
    ("agpl-3.0", "the AGPLv3"),
    ("bsd", "BSD license"),
    ("bsd", "3-Clause BSD"),
    ("bsd", "2-Clause BSD"),
    ("mpl-2.0", "Mozilla Public License, Version 2.0"),
    ("mpl-2.0", "Mozilla Public License 2.0"),
    ("epl-2.0", "Eclipse Public License - v 2.0"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc0", "Creative Commons Zero"),
    ("isc", "ISC license"),
    ("unlicense", "the Unlicense"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib", "zlib license"),
    ("bsl-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl-1.0", "Boost Software License"),
    ("artistic-2.0", "The Artistic License 2.0"),
    ("artistic-2.0", "Artistic License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Released under the Apache License 2.0."),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
)
# Statements of licences that are none of the families, with two made-up words; and sentences that share words with licences.
MADE_UP = (
    "Licensed under the {} License, version {}.", "This work is licensed under the {} {} Public License.", "Released under the {} {} License.",
    "You can redistribute this under the terms of the {} {} License.", "Permission is hereby granted to use, copy and modify this under the {} {} terms.",
    "SPDX-License-Identifier: {}-{}", "Use of this work is governed by a {} {} license that can be found in the LICENSE file.",
)
NEAR_MISSES = (
    "He has a driving license under the age of 18 and the terms of the general agreement are clear.", "The version of the story published by the foundation was free.",
    "Under the terms of the treaty the general public may use the road.", "The license of the pub was revoked in version two of the order.", "A fishing license is required in the park.",
    "The public library is open to any person.", "Software version 2.0 was published in January 2004.", "They granted a permission to build, subject to the following conditions.",
    "The boost in software sales was large.", "An artistic director may license the play.", "The mozilla of the story is a lizard.", "The eclipse was seen by the public in June.",
    "Lesser known poets are published by the university.", "The general said that the public should not worry about version three.", "The material is provided without any charge by the authors.",
    "The licensed premises close at ten.", "Students are licensed to drive in the second year.", "The use of the hall is governed by a committee.", "Commons and lords met under one roof.",
    "We take all rights reserved seats to the front.", "All rights of way are reserved for trams.", "The driver has a license to drive under the age of 21.",
    "The court granted permission to any person living there.", "The above notice was included in all copies of the paper.", "He studied at MIT under the supervision of Smith.",
    "The free software meeting is at eight.", "Public records are available under the law.", "A copy of the letter was found in the file.", "The source of the river is in the hills.",
    "Apache helicopters were licensed in version 2 of the plan.", "The work is subject to the terms of the contract.", "Creative people share common rooms.", "Distribution of seats is subject to change.",
    "The general public was admitted without fee.", "Conditions were met with great care.", "She was released under bail.", "The following year the author waived all fees.",
)
# Word pairs of which a text of the family holds one of each group, since its statements share the rest with
# other families; and pairs of which an unknown licence holds one.
_GPL = ("gnu general", "the gpl", "gpl 2", "gpl 3", "gpl version")
_TWO, _THREE = ("version 2", "gpl 2", "license 2"), ("version 3", "gpl 3", "license 3")
MARKS = {
    "mit": (("mit license", "license identifier", "hereby granted", "permission notice"),), "isc": (("isc license", "license identifier", "hereby granted", "permission notice"),),
    "gpl-2.0": (_GPL, _TWO), "gpl-3.0": (_GPL, _THREE), "lgpl": (("gnu lesser", "lesser general", "gnu library", "the lgpl", "lgpl 2", "lgpl 3"),),
    "agpl-3.0": (("gnu affero", "affero general", "the agpl", "agpl 3"),), "mpl-2.0": (("mozilla public", "mpl 2", "the mpl"),), "epl-2.0": (("eclipse public", "epl 2"),),
    "cc-by": (("attribution 4", "cc by"),), "cc-by-sa": (("attribution sharealike", "sharealike 4", "by sa"),), "cc-by-nc": (("attribution noncommercial", "noncommercial 4", "by nc"),),
    "unknown": (("licensed under", "released under", "can redistribute", "hereby granted", "license identifier", "governed by", "the mit", "bsd license"),),
}
_COMMON = "a all and any are as at be by can for from in is it no not of on one or that the this to was with you".split()
TEMPLATES = (*STATEMENTS, *((family, f"SPDX-License-Identifier: {name}") for family, name in SPDX))
FAMILIES = tuple(dict.fromkeys(f for f, _ in TEMPLATES))
CLASSES = (*FAMILIES, "unknown", "none")
_FITTED: dict[tuple, tuple] = {}


def _words(body: str) -> str:
    """SQL: lower-case words, with a mark at both ends and after each sentence; a version's number stands without its v."""
    marked = f"regexp_replace(regexp_replace(lower({body}), '[.!?;:]+(?=\\\\s|$)', ' ¶ '), '(?<=gpl|[^\\\\p{{L}}])v(?=[0-9])', ' ')"
    return f"array_remove(split(concat('¶ ', {marked}, ' ¶'), '[^\\\\p{{L}}\\\\p{{N}}¶]+'), '')"


def _pairs(words: str) -> str:
    """SQL: hashes of adjacent words."""
    return f"transform(slice({words}, 1, greatest(size({words}) - 1, 0)), (w, i) -> xxhash64(w, get({words}, i + 1)))"


def _groups() -> list[tuple[str, tuple[str, ...]]]:
    return [(family, group) for family, groups in MARKS.items() for group in groups]


def _pairs_of(spark: SparkSession, sentences: list[str], inner: bool = False, common: bool = False) -> list[list[int]]:
    """Pairs of each sentence that are not of two common words (``common``: those too), worked out as those of documents
    are (``inner``: without the outer marks)."""
    common = ", ".join(f"'{w}'" for w in (["¶"] if common else [*_COMMON, "¶"]))
    frame = spark.createDataFrame(list(enumerate(sentences)), "k int, body string").select("k", F.expr(_words("body")).alias("w"))
    frame = frame.withColumn("w", F.expr("slice(w, 2, size(w) - 2)")) if inner else frame
    both = F.expr(f"transform(slice(w, 1, size(w) - 1), (x, i) -> if(x in ({common}) and get(w, i + 1) in ({common}), null, xxhash64(x, get(w, i + 1))))")
    return [sorted(set(r.p)) for r in frame.select("k", F.array_compact(both).alias("p")).orderBy("k").collect()]


def _examples(draw: np.random.Generator) -> list[tuple[str, str]]:
    """(class, sentence) to train on."""
    filler = "report river seven garden letters winter music paper market stone report light yellow study window".split()

    def varied(sentence: str, most: float) -> str:
        words = sentence.split()
        kept = words if len(words) < 5 else [w for w in words if draw.random() > most * draw.random()] or words
        around = lambda: " ".join(draw.choice(filler, draw.integers(0, 6)))
        return f"{around()}{draw.choice(['. ', ' ', chr(10)])}{' '.join(kept)} {around()}"

    out = [(family, varied(t, 0.35)) for family, t in TEMPLATES for _ in range(VARIANTS)]
    for t in MADE_UP:
        out += [("unknown", varied(t.format(*draw.choice(filler, 2)), 0.2)) for _ in range(2 * VARIANTS)]
    for t in NEAR_MISSES:
        out += [("none", varied(t, 0.2)) for _ in range(VARIANTS)]
    for words in (t.split() for _, t in TEMPLATES if len(t.split()) >= 12):  # a few words of a long statement are none
        for _ in range(VARIANTS // 4):
            at = draw.integers(0, max(1, len(words) - 3))
            out.append(("none", " ".join([*draw.choice(filler, 3), *words[at : at + 2], *draw.choice(filler, 3)])))
    return out


def _trained(spark: SparkSession) -> tuple[list, list[float], float]:
    """((pair, weights, template weights) rows, intercepts, accuracy on held-out variants)."""
    key = (TEMPLATES, MADE_UP, NEAR_MISSES, VARIANTS, str(MARKS))
    if key in _FITTED:
        return _FITTED[key]
    draw = np.random.default_rng(11)
    of_template = [set(p) for p in _pairs_of(spark, [t for _, t in TEMPLATES], inner=True)]
    grams = sorted(set().union(*of_template))
    at = {g: i for i, g in enumerate(grams)}
    examples = _examples(draw)
    rows = [(CLASSES.index(c), [at[g] for g in p if g in at]) for (c, _), p in zip(examples, _pairs_of(spark, [t for _, t in examples]))]
    order = draw.permutation(len(rows))
    held, fit = [rows[i] for i in order[: len(rows) // 5]], [rows[i] for i in order[len(rows) // 5 :]]
    frame = spark.createDataFrame([(float(c), Vectors.sparse(len(grams), f, [1.0] * len(f))) for c, f in fit], ["label", "features"]).coalesce(1)
    model = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.1, maxIter=60).fit(frame)
    weights, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def scores(f: list[int]) -> np.ndarray:
        return intercept + weights[:, f].sum(1)

    def loss(scale: float) -> float:
        total = 0.0
        for c, f in held:
            z = scale * scores(f)
            total += np.log(np.exp(z - z.max()).sum()) + z.max() - z[c]
        return total

    scale = min(np.geomspace(0.25, 4, 25).tolist(), key=loss)
    accuracy = float(np.mean([int(np.argmax(scores(f))) == c for c, f in held]))
    families_of = {g: {f for (f, _), p in zip(TEMPLATES, of_template) if g in p} for g in grams}
    weight = {g: len(families_of[g]) ** -2 for g in grams}  # what several families say tells little
    totals = [sum(weight[g] for g in p) for p in of_template]
    marks = [set().union(*_pairs_of(spark, list(group), inner=True, common=True)) for _, group in _groups()]
    grams += sorted(set().union(*marks) - set(grams))  # pairs that are marks only weigh nothing
    weights = np.pad(weights, ((0, 0), (0, len(grams) - weights.shape[1])))
    share = lambda g: [weight[g] / n if g in p else 0.0 for p, n in zip(of_template, totals)]
    table = [(g, (scale * weights[:, i]).tolist(), share(g) + [float(g in group) for group in marks]) for i, g in enumerate(grams)]
    _FITTED[key] = table, (scale * intercept).tolist(), accuracy
    return _FITTED[key]


def _row_of(key: str, text: str) -> F.Column:
    said = F.col(text).cast("string")
    return F.struct(F.xxhash64(F.col(key), said), F.xxhash64(F.lit(1), F.col(key), said))


def passages(docs: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, paragraph, passage, doc_id, at, pair): template pairs of each text, those close together as one passage. ``_row``
    is of id and text, so that tasks that run again agree; rows that repeat both are as one."""
    # a null or empty text is kept by the explodes below, so that no filter on a value worked out anew goes under them
    paragraphs = F.split(F.col(text).cast("string"), r"\n[^\p{L}\p{N}]*\n")
    df = docs.select(F.col(key).alias("doc_id"), _row_of(key, text).alias("_row"), F.posexplode_outer(paragraphs).alias("paragraph", "_body"))
    df = df.select("doc_id", "_row", "paragraph", F.expr(f"get(transform(array({_words('_body')}), v -> {_pairs('v')}), 0)").alias("_pairs"))
    df = df.select("doc_id", "_row", "paragraph", F.posexplode_outer("_pairs").alias("at", "_pair"))
    df = df.join(F.broadcast(pairs), F.col("_pair") == F.col("pair")).drop("_pair")
    line = Window.partitionBy("_row", "paragraph").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(line) > GAP, F.lit(False)).cast("int")
    return df.withColumn("_apart", apart).withColumn("passage", F.sum("_apart").over(line)).drop("_apart")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, paragraph, word_start, family, probability, template_share) of each passage that states a licence, by family."""
    spark = docs.sparkSession
    rows, intercepts, _ = _trained(spark)
    n, m, groups = len(CLASSES), len(TEMPLATES), _groups()
    names = [f"z{k}" for k in range(n)], [f"h{k}" for k in range(m + len(groups))]
    table = spark.createDataFrame([(g, *z, *h) for g, z, h in rows], "pair long, " + ", ".join(f"{c} double" for c in [*names[0], *names[1]]))
    found = passages(docs, table.select("pair"), key, text)
    place = ["_row", "paragraph", "passage", "doc_id"]
    once = found.groupBy(*place, "pair").agg(F.min("at").alias("at")).join(F.broadcast(table), "pair")
    # sums of plain columns, which tasks add up before they are shuffled
    gathered = once.groupBy(*place).agg(F.min("at").cast("long").alias("word_start"), F.count("*").alias("n_pairs"), *[F.sum(c).alias(c) for c in [*names[0], *names[1]]])
    summed = gathered.select(
        "_row", "doc_id", F.col("paragraph").cast("long").alias("paragraph"), "word_start", "n_pairs",
        F.array(*[F.col(c) + float(x) for c, x in zip(names[0], intercepts)]).alias("z"), F.array(*names[1]).alias("h"),
    )
    own = {f: [F.get("h", F.lit(k)) for k in range(m) if TEMPLATES[k][0] == f] for f in FAMILIES}
    marked = lambda f: reduce(and_, [F.get("h", F.lit(m + k)) > 0 for k, (g, _) in enumerate(groups) if g == f], F.lit(True))
    top = F.array_max("z")
    raised = [F.exp(F.get("z", F.lit(k)) - top) for k in range(n)]
    rest = raised[n - 2] + raised[n - 1]
    chances = [F.struct(F.lit(f).alias("family"), (raised[k] / (raised[k] + rest)).alias("p"), F.greatest(F.lit(0.0), *own[f]).alias("share"), marked(f).alias("marked")) for k, f in enumerate(FAMILIES)]
    licence = 1 - raised[n - 1] / sum(raised[1:], raised[0])
    df = summed.select("_row", "doc_id", "paragraph", "word_start", "n_pairs", F.array(*chances).alias("chances"), licence.alias("licence"), marked("unknown").alias("named"))
    df = df.withColumn("sure", F.filter("chances", lambda c: (c["p"] >= SURE) & (c["share"] >= ENOUGH) & c["marked"]))
    best = F.array_max(F.transform("chances", lambda c: c["share"]))
    unknown = F.when((F.col("licence") >= SURE) & (F.col("n_pairs") >= LEAST_PAIRS) & F.col("named"), F.array(F.struct(F.lit("unknown").alias("family"), F.col("licence").alias("p"), best.alias("share"), F.col("named").alias("marked"))))
    df = df.withColumn("said", F.when(F.size("sure") > 0, F.col("sure")).otherwise(unknown))
    df = df.select("_row", "doc_id", "paragraph", "word_start", F.explode("said").alias("s"))
    again = docs.groupBy(_row_of(key, text).alias("_again")).agg(F.count("*").alias("n")).where("n > 1")
    df = df.join(again, df["_row"] == again["_again"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int"))))
    return df.select("doc_id", "paragraph", "word_start", F.col("s.family").alias("family"), F.round("s.p", 6).alias("probability"), F.round("s.share", 6).alias("template_share"))
