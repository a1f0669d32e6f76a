"""Licence scan: a trained paragraph classifier over sparse word n-grams, with an unknown class, confirmed by templates.

DataFrame functions only (and Spark ML's regression, on the training rows). A paragraph is a line.

1. Training. The families' templates are varied (seeded loss of words other than marks, foreign words around them); lines of at
   most `NEGATIVE_DOCUMENTS` documents, those with the least hashes of their ids, are the unknown class, without
   lines that are near a template or hold one (the one bounded sample here). Statements of licences that are no family, and templates
   with other words for their marks, belong to it too. Features are the unigrams and bigrams of the templates but for those
   that are common in the documents' unknown lines. A multinomial logistic regression is fitted on four fifths.
2. Calibration. On the last fifth, a temperature is chosen by likelihood, and the least probability a family must reach,
   so that at most `FALSE_MOST` of the documents' unknown lines there reach it. A paragraph below it is unknown.
3. Scan. All paragraphs of all documents: those with a word of the features are taken apart, n-grams meet the table of
   weights (bounded by the templates), and weights are summed by paragraph. A paragraph without any feature is unknown
   by the intercepts alone; bigrams are features only with a word of them, so no paragraph with a feature is passed over.
4. Confirmation. The family stands if at least `CONTAINED` of the paragraph's n-grams are those of the family's templates, and the
   paragraph holds all marks of one of them (what tells it from neighbours: names, version numbers, SA, ND, NC) and no word
   that the family never has. A notice without a number is "gpl" or "bsd".
5. Statements inside a line, or broken over lines. Where a bigram with a mark of a template stands in a text, the words that
   the whole template would take there, over the ends of lines, are a window (its paragraph is the line of the bigram). Of the windows around a bigram with all marks
   the one that holds the largest part of its template counts, from `CONTAINED` on; it is classified like a paragraph, and
   its family stands if that is the template's. So a statement
   is found however long its line is, and a line can have several families.

Defined cases: null or empty text has no paragraphs; a document without licence has an empty list of families;
rows that repeat are documents of their own if their ids differ, and one row otherwise (their paragraphs are equal); a
null doc_id is a document; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitext_engine.llm.common import least_hashed, saved, table

#: Paragraphs by family, as such notices are commonly worded. Words between asterisks tell a family from its neighbours: a
#: statement is confirmed only if it holds all of those of a template of the family. (fixed values)
MARKED = {
    "agpl-3.0": [
        "This work is licensed under the GNU *Affero* General Public License, version *3*.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU *Affero* General Public License as published by the Free Software Foundation, either version *3* of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: *AGPL*-*3*.0-or-later",
        "Licensed under the *AGPLv3*.",
    ],
    "apache-2.0": [
        "Licensed under the *Apache* License, Version *2*.0.",
        'Licensed under the *Apache* License, Version *2*.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.*apache*.org/licenses/LICENSE-*2*.0",
        "SPDX-License-Identifier: *Apache*-*2*.0",
    ],
    "bsd": [
        "*Redistribution* and use in *source* and *binary* forms, with or without modification, are permitted provided that the following conditions are met:",
        "*Redistributions* of source code must retain the above copyright notice, this list of conditions and the following *disclaimer*.",
        "Use of this source code is governed by a *BSD*-style license.",
        "Released under the *BSD* License.",
    ],
    "bsd-2-clause": ["SPDX-License-Identifier: *BSD*-*2*-*Clause*", "Licensed under the *BSD* *2*-*Clause* License.", 'Licensed under the *Simplified* *BSD* License.'],
    "bsd-3-clause": [
        "SPDX-License-Identifier: *BSD*-*3*-*Clause*",
        "Licensed under the *BSD* *3*-*Clause* License.",
        "*Neither* the *name* of the copyright holder nor the names of its contributors may be used to *endorse* or promote products derived from this software without specific prior written permission.",
    ],
    "bsl-1.0": ["Distributed under the *Boost* Software License, Version *1*.0.", "SPDX-License-Identifier: *BSL*-*1*.0"],
    "cc-by": [
        "This work is licensed under a *Creative* *Commons* *Attribution* 4.0 International License.",
        "Licensed under *CC* *BY* 4.0.",
        "SPDX-License-Identifier: *CC*-*BY*-4.0",
    ],
    "cc-by-nc": [
        "Licensed under *CC* *BY*-*NC* 4.0.",
        "This work is licensed under a *Creative* *Commons* *Attribution*-*NonCommercial* 4.0 International License.",
        "SPDX-License-Identifier: *CC*-*BY*-*NC*-4.0",
    ],
    "cc-by-nc-nd": [
        "Licensed under *CC* *BY*-*NC*-*ND* 4.0.",
        "This work is licensed under a *Creative* *Commons* *Attribution*-*NonCommercial*-*NoDerivatives* 4.0 International License.",
        "SPDX-License-Identifier: *CC*-*BY*-*NC*-*ND*-4.0",
    ],
    "cc-by-nc-sa": [
        "Licensed under *CC* *BY*-*NC*-*SA* 4.0.",
        "This work is licensed under a *Creative* *Commons* *Attribution*-*NonCommercial*-*ShareAlike* 4.0 International License.",
        "SPDX-License-Identifier: *CC*-*BY*-*NC*-*SA*-4.0",
    ],
    "cc-by-nd": [
        "Licensed under *CC* *BY*-*ND* 4.0.",
        "This work is licensed under a *Creative* *Commons* *Attribution*-*NoDerivatives* 4.0 International License.",
        "SPDX-License-Identifier: *CC*-*BY*-*ND*-4.0",
    ],
    "cc-by-sa": [
        "Licensed under *CC* *BY*-*SA* 4.0.",
        "This work is licensed under a *Creative* *Commons* *Attribution*-*ShareAlike* 4.0 International License.",
        "SPDX-License-Identifier: *CC*-*BY*-*SA*-4.0",
    ],
    "cc0-1.0": ["Released under *CC0* 1.0.", "This work is dedicated to the public domain under *CC0* 1.0 Universal.", "SPDX-License-Identifier: *CC0*-1.0"],
    "epl-2.0": ["Licensed under the *Eclipse* *Public* License, version *2*.0.", "SPDX-License-Identifier: *EPL*-*2*.0"],
    "gpl": ["You should have received a copy of the *GNU* *General* *Public* License along with this program.", "This work is licensed under the *GNU* *General* *Public* License."],
    "gpl-2.0": [
        "This work is licensed under the *GNU* *General* *Public* License, version *2*.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the *GNU* *General* *Public* License as published by the Free Software Foundation; either version *2* of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: *GPL*-*2*.0-only",
        "Licensed under the *GPL* *v2*.", "Licensed under the *GPLv2*.",
    ],
    "gpl-3.0": [
        "This work is licensed under the *GNU* *General* *Public* License, version *3*.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the *GNU* *General* *Public* License as published by the Free Software Foundation, either version *3* of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: *GPL*-*3*.0-or-later",
        "Licensed under the *GPL* *v3*.", "Licensed under the *GPLv3*.",
    ],
    "isc": [
        "Licensed under the *ISC* License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without *fee* is hereby *granted*, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: *ISC*",
    ],
    "lgpl-2.1": [
        "This work is licensed under the GNU *Lesser* General Public License, version *2*.*1*.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU *Lesser* General Public License as published by the Free Software Foundation; either version *2*.*1* of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: *LGPL*-*2*.*1*-or-later",
    ],
    "lgpl-3.0": [
        "This work is licensed under the GNU *Lesser* General Public License, version *3*.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU *Lesser* General Public License as published by the Free Software Foundation; either version *3* of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: *LGPL*-*3*.0-or-later",
    ],
    "mit": [
        "Released under the *MIT* License.",
        "Permission is hereby granted, free of *charge*, to any person *obtaining* a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This project is licensed under the *MIT* License.",
        "SPDX-License-Identifier: *MIT*",
    ],
    "mpl-2.0": [
        "Licensed under the *Mozilla* *Public* License, Version *2*.0.",
        "This Source Code Form is subject to the terms of the *Mozilla* *Public* License, v. *2*.0.",
        "SPDX-License-Identifier: *MPL*-*2*.0",
    ],
    "reserved": ["*All* *rights* *reserved*.", "Copyright. *All* *rights* *reserved*.", "*No* *part* of this *publication* may be *reproduced* without permission."],
    "unlicense": ["This is free and *unencumbered* software released into the public domain.", "SPDX-License-Identifier: *Unlicense*"],
    "zlib": [
        "Released under the *zlib* License.",
        "This software is provided 'as-is', without any express or *implied* warranty. In no event will the *authors* be held liable for any *damages* arising from the use of this software.",
        "SPDX-License-Identifier: *Zlib*",
    ],
}
#: Words that a statement of these families does not hold. (fixed values)
NEVER = {
    **dict.fromkeys(["gpl", "gpl-2.0", "gpl-3.0"], ["lesser", "affero", "library general"]),
    "gpl": ["lesser", "affero", "library general", "version", "as published", "v2", "v3"],
    "bsd": ["2", "3", "4", "simplified", "clause"],
    "bsd-2-clause": ["4", "original"],
    "cc-by": ["nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike"],
    "cc-by-nc": ["nd", "sa", "noderivatives", "noderivs", "sharealike"],
    "cc-by-nd": ["nc", "sa", "noncommercial", "sharealike"],
    "cc-by-sa": ["nc", "nd", "noncommercial", "noderivatives", "noderivs"],
    "cc-by-nc-nd": ["sa", "sharealike"],
    "cc-by-nc-sa": ["nd", "noderivatives", "noderivs"],
}
#: Statements of licences that are no family here: examples of the unknown class. (fixed values)
FOREIGN = [
    "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2", "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0",
    "This software is released under the PostgreSQL License.", "SPDX-License-Identifier: PostgreSQL", "Licensed under the Microsoft Public License.", "SPDX-License-Identifier: MS-PL",
    "Distributed under the Common Development and Distribution License, version 1.0.", "SPDX-License-Identifier: CDDL-1.0", "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Open Software License version 3.0.", "This font is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1", "Licensed under the Open Data Commons Open Database License.",
    "Licensed under the Business Source License 1.1.", "Licensed under the Server Side Public License, version 1.", "SPDX-License-Identifier: SSPL-1.0", "Licensed under the Elastic License 2.0.",
    "Do what you want with it under the terms of the WTFPL, version 2.", "Released under the Beerware License.", "Licensed under the GNU Free Documentation License, Version 1.3.", "SPDX-License-Identifier: GFDL-1.3-or-later",
    "You need a license to use this software. Ask us for one.", "The license of this work is described in a file of its own.", "This work was printed under the direction of the author.",
]
#: What marked words are replaced by in further examples of the unknown class.
OTHER_WORDS = ["quillon", "norvane", "harbour", "7", "9", "tamber", "x11", "wessex"]


def _without_marks(line: str) -> str:
    return line.replace("*", "")


TEMPLATES = {family: [_without_marks(t) for t in lines] for family, lines in MARKED.items()}
UNKNOWN = "unknown"
NEGATIVE_DOCUMENTS = 400
NEGATIVE_LINES = 4_000
VARIATIONS = 24
COMMON = 0.002  # of unknown lines: a more frequent n-gram is no feature
FALSE_MOST = 0.0005
CONTAINED = 0.5


def words(line: Column) -> Column:
    """A line's words: lower case, letters and digits only."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def bigrams(singles: Column) -> Column:
    """Every word with the next one; null for the last."""
    return F.zip_with(singles, F.slice(singles, F.lit(2), F.size(singles)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))


def ngrams_of(singles: Column) -> Column:
    """Distinct unigrams and bigrams of words."""
    return F.array_distinct(F.concat(singles, F.array_compact(bigrams(singles))))


def ngrams(line: Column) -> Column:
    """Distinct unigrams and bigrams of a line's words."""
    return ngrams_of(words(line))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, line) of all lines that are not blank."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).where(F.trim("line") != "")


def template_rows(spark: SparkSession, families: dict | None = None) -> DataFrame:
    """(family, number, line, marks, foreign): a template, the words that tell it, and the template with other words for these."""
    import re

    rows = []
    for family, lines in sorted((families or MARKED).items()):
        for i, line in enumerate(lines):
            marks = sorted({m.lower() for m in re.findall(r"\*(\w+)\*", line)})
            others = iter(OTHER_WORDS * 3)
            rows.append((family, i, _without_marks(line), marks, re.sub(r"\*\w+\*", lambda _: next(others), line)))  # noqa: B023
    return spark.createDataFrame(rows, "family string, number int, line string, marks array<string>, foreign string")


def streams(docs: DataFrame, *keys: str) -> DataFrame:
    """(*keys, w, p): the words of a text, over the ends of its lines, and the number of each word's line."""
    rows = docs.select(*keys, F.transform(F.split("text", "\n"), words).alias("ws"))
    return rows.select(*keys, F.flatten("ws").alias("w"), F.flatten(F.transform("ws", lambda x, i: F.array_repeat(i, F.size(x)))).alias("p"))


def statements(rows: DataFrame, *keys: str, marked: dict = MARKED) -> DataFrame:
    """(*keys, paragraph, at, context, number, stated, cover, tokens, size): windows of `rows` (`streams`) that hold a template.

    That is `CONTAINED` of it and all its marks, and none of the family's `NEVER` there or in the next two words. Looked at are
    bigrams with a marked word. A row a bigram (its place in the text) and template; the context is the words around it,
    bounded by the longest template.
    """
    spark = rows.sparkSession
    known = template_rows(spark, marked).select("family", words(F.col("line")).alias("w"), ngrams(F.col("line")).alias("grams"), "marks").collect()
    longest = max(len(r.w) for r in known)
    places = [
        (f"{a} {b}", i, r.family, o, len(r.w), r.grams, r.marks, NEVER.get(r.family, []))
        for i, r in enumerate(known) for o, (a, b) in enumerate(zip(r.w, r.w[1:])) if a in r.marks or b in r.marks
    ]
    # bounded by the templates: a few hundred bigrams
    schema = "pair string, number int, stated string, ahead int, length int, grams array<string>, marks array<string>, never array<string>"
    anchors = F.broadcast(spark.createDataFrame(places, schema))
    found = F.transform(bigrams(F.col("w")), lambda pair, i: F.struct((i + 1).alias("at"), pair.alias("pair")))
    found = F.filter(found, lambda x: F.coalesce(x["pair"].isin(*sorted({p[0] for p in places})), F.lit(False)))
    start = lambda at: F.greatest(F.lit(1), at - longest)
    around = F.transform(
        found,
        lambda x: F.struct(
            x["at"].alias("at"), x["pair"].alias("pair"), F.get("p", x["at"] - 1).alias("paragraph"), F.slice("w", start(x["at"]), F.lit(2 * longest + 1)).alias("context")
        ),
    )
    hits = rows.select(*keys, F.explode(around).alias("x")).select(*keys, "x.*").join(anchors, "pair")
    begin = F.col("at") - F.col("ahead")
    first = F.greatest(F.lit(1), begin)
    window = lambda more: F.slice("context", first - start(F.col("at")) + 1, F.col("length") - (first - begin) + more)
    hits = hits.where(F.size(F.array_except("marks", window(0))) == 0)
    hits = hits.where(~F.arrays_overlap(ngrams_of(window(2)), F.col("never"))).withColumn("tokens", ngrams_of(window(0)))
    cover = F.size(F.array_intersect("tokens", "grams")) / F.size("grams")
    hits = hits.withColumn("cover", cover).where(F.col("cover") >= CONTAINED)
    return hits.select(*keys, "paragraph", "at", "context", "number", "stated", "cover", "tokens", F.size("grams").alias("size"))


def training_rows(docs: DataFrame, marked: dict = MARKED) -> DataFrame:
    """(family, line, made, part): part 0-4 by hash; bounded by the templates and the two limits on the unknown class.

    `made`: a line that no document gave. Those of the unknown class are statements of other licences, and templates whose
    marks are other words.
    """
    spark = docs.sparkSession
    templates = template_rows(spark, marked)
    base = templates.withColumn("variation", F.explode(F.sequence(F.lit(0), F.lit(VARIATIONS - 1))))

    def kept(line: str) -> Column:
        marks = lambda w: F.exists("marks", lambda m: F.lower(w).contains(m))
        luck = lambda w, i: F.pmod(F.xxhash64(w, i, F.col("variation"), F.col(line)), F.lit(100)) >= F.col("variation") % 4 * 6
        return F.array_join(F.filter(F.split(line, " "), lambda w, i: (F.col("variation") < 2) | marks(w) | luck(w, i)), " ")

    ahead = F.when(F.col("variation") % 3 == 2, F.concat(F.lit("see "), F.col("variation").cast("string"), F.lit(" "))).otherwise("")
    positive = base.select("family", F.concat(ahead, kept("line")).alias("line"), F.lit(True).alias("made"))
    foreign = spark.createDataFrame([(x,) for x in FOREIGN], "line string").unionByName(base.where("variation < 6").select(kept("foreign").alias("line")))
    foreign = foreign.select(F.lit(UNKNOWN).alias("family"), "line", F.lit(True).alias("made"))
    ids = least_hashed(docs.select("doc_id").where("doc_id is not null"), "doc_id", NEGATIVE_DOCUMENTS).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    lines = paragraphs(some).select("line").orderBy(F.xxhash64("line"), "line").limit(NEGATIVE_LINES)
    known = [r.g for r in templates.select(F.explode(ngrams(F.col("line"))).alias("g")).distinct().collect()]
    inside = F.size(F.filter(ngrams(F.col("line")), lambda g: g.isin(known)))
    lines = lines.where(inside < 0.3 * F.size(ngrams(F.col("line")))).withColumn("_h", F.xxhash64("line"))
    stated = statements(streams(lines.withColumnRenamed("line", "text"), "_h"), "_h", marked=marked).select("_h")
    negative = lines.join(stated, "_h", "left_anti").select(F.lit(UNKNOWN).alias("family"), "line", F.lit(False).alias("made"))
    rows = positive.unionByName(foreign).unionByName(negative).where(F.trim("line") != "")
    return rows.withColumn("part", F.pmod(F.xxhash64("family", "line"), F.lit(5)))


class Scanner:
    """A fitted classifier: weights by n-gram and family, temperature and the least probability of a family."""

    def __init__(self, marked, families, intercepts, weights, members, temperature, least):
        self.marked, self.families, self.intercepts, self.weights, self.members = marked, families, intercepts, weights, members
        self.temperature, self.least = temperature, least


def fit(docs: DataFrame, marked: dict = MARKED) -> Scanner:
    """A scanner for the families of `marked` (templates with marks)."""
    spark = docs.sparkSession
    rows = saved(training_rows(docs, marked).withColumn("tokens", ngrams(F.col("line"))), "licence-training").coalesce(4).cache()
    families = [*sorted(marked), UNKNOWN]
    members: dict[str, list[int]] = {}
    for r in template_rows(spark, marked).select("family", F.explode(ngrams(F.col("line"))).alias("g")).distinct().collect():
        members.setdefault(r.g, [0] * len(marked))[families.index(r.family)] = 1
    unknown = rows.where((F.col("family") == UNKNOWN) & ~F.col("made"))
    n = unknown.count()
    frequent = {r.g for r in unknown.select(F.explode("tokens").alias("g")).groupBy("g").count().where(F.col("count") > max(1, COMMON * n)).select("g").collect()}
    # a bigram is a feature only with a unigram of it, so that a line without feature unigrams needs no look at its bigrams
    vocabulary = sorted(g for g in members if g not in frequent and any(w in members and w not in frequent for w in g.split()))
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="tokens", outputCol="features").setBinary(True).transform(rows.withColumn("label", label))
    weight = F.when(F.col("family") == UNKNOWN, 1.0).otherwise(2.0)
    training = vectors.where("part < 4").withColumn("weight", weight).select("features", "label", "weight")
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, weightCol="weight").fit(training)
    matrix, intercepts = model.coefficientMatrix.toArray(), [float(x) for x in model.interceptVector]
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(vocabulary)}

    held = model.transform(vectors.where("part = 4")).select("label", "made", vector_to_array("rawPrediction").alias("raw"))
    grid = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]

    def soft(t: float) -> Column:
        e = F.transform("raw", lambda x: F.exp((x - F.array_max("raw")) / t))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    losses = held.agg(*[F.avg(-F.log(F.greatest(F.element_at(soft(t), (F.col("label") + 1).cast("int")), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(grid)]).first()
    temperature = min(range(len(grid)), key=lambda i: losses[i] if losses[i] is not None else 0)
    best = F.array_max(F.slice(soft(grid[temperature]), 1, len(marked)))
    highest = held.where((F.col("label") == len(marked)) & ~F.col("made")).agg(F.percentile_approx(best, 1 - FALSE_MOST, 100_000).alias("p")).first()["p"]
    rows.unpersist()
    return Scanner(marked, families, intercepts, weights, members, grid[temperature], min(0.95, max(0.5, highest or 0.5)))


def _mask(grams, bits: dict[str, int]) -> list[int]:
    """The bits of n-grams, 60 a number."""
    out = [0] * (len(bits) // 60 + 1)
    for g in grams:
        out[bits[g] // 60] |= 1 << bits[g] % 60
    return out


def _rules(spark: SparkSession, marked: dict):
    """The bit of every mark and `NEVER` n-gram; and (rule, options, never): a family, the masks of its templates' marks, and of `NEVER`."""
    rows = template_rows(spark, marked).select("family", "marks").collect()
    bits = {g: i for i, g in enumerate(sorted({m for r in rows for m in r.marks} | {g for f in marked for g in NEVER.get(f, [])}))}
    rules = [(f, [_mask(r.marks, bits) for r in rows if r.family == f], _mask(NEVER.get(f, []), bits)) for f in sorted(marked)]
    return bits, spark.createDataFrame(rules, "rule string, options array<array<long>>, never array<long>")


def scored(pieces: DataFrame, scanner: Scanner, *keys: str) -> DataFrame:
    """(*keys, x, told): the likeliest family of each piece (*keys, tokens) that reaches the least probability, with `contained`.

    `told`: the piece holds all marks of a template of the family, and none of its `NEVER`.
    """
    k = len(scanner.families)
    lines = pieces.select(*keys, F.size("tokens").alias("n"), F.explode("tokens").alias("g"))
    # bounded by the templates: a few hundred n-grams
    bits, rules = _rules(pieces.sparkSession, scanner.marked)
    every = [
        (g, scanner.weights.get(g, [0.0] * k), scanner.members.get(g, [0] * (k - 1)), _mask([g] if g in bits else [], bits)) for g in sorted({*scanner.members, *bits})
    ]
    known = F.broadcast(pieces.sparkSession.createDataFrame(every, "g string, weights array<double>, members array<int>, mask array<long>"))
    held = [f"held{j}" for j in range(len(_mask([], bits)))]
    rows = lines.join(known, "g").groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(k)], *[F.sum(F.col("members")[i]).alias(f"m{i}") for i in range(k - 1)],
        *[F.bit_or(F.col("mask")[j]).alias(h) for j, h in enumerate(held)],
    )
    # only a paragraph with a family above the unknown class can reach the least probability
    raw = [(F.col(f"w{i}") + scanner.intercepts[i]) / scanner.temperature for i in range(k)]
    rows = rows.select(*keys, "n", F.array(*raw).alias("raw"), F.array(*[F.col(f"m{i}") for i in range(k - 1)]).alias("m"), F.array(*held).alias("held"))
    rows = rows.where(F.array_max(F.slice("raw", 1, k - 1)) >= F.element_at("raw", k))
    rows = rows.withColumn("e", F.transform("raw", lambda x: F.exp(x - F.array_max("raw"))))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    families = F.array(*[F.lit(f) for f in scanner.families[:-1]])
    options = F.transform(
        families, lambda f, i: F.struct((F.get("e", i) / F.col("total")).alias("probability"), (F.get("m", i) / F.col("n")).alias("contained"), f.alias("family"))
    )
    rows = rows.select(*keys, F.array_max(options).alias("x"), "held").where(F.col("x.probability") >= scanner.least)
    rows = rows.join(F.broadcast(rules), F.col("x.family") == F.col("rule"))
    both = lambda mask: F.zip_with("held", mask, lambda a, b: a.bitwiseAND(b))
    told = F.exists("options", lambda mask: both(mask) == mask) & ~F.exists(both(F.col("never")), lambda x: x != 0)
    return rows.select(*keys, "x", told.alias("told"))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(doc_id, paragraph, family, probability, contained, confirmed): a row a paragraph and family, for all that are not unknown."""
    rare = [g for g in scanner.weights if " " not in g]
    lines = paragraphs(docs).where(F.exists(words(F.col("line")), lambda w: w.isin(*rare)))
    whole = scored(lines.select("doc_id", "paragraph", ngrams(F.col("line")).alias("tokens")), scanner, "doc_id", "paragraph")
    whole = whole.select("doc_id", "paragraph", "x.*", (F.col("told") & (F.col("x.contained") >= CONTAINED)).alias("confirmed"))
    # a null id is a group here too; the context keeps rows of one id and different texts apart
    best = F.max_by(F.struct("stated", "cover", "tokens"), F.struct("cover", "size", "number")).alias("best")
    inside = statements(streams(docs, "doc_id"), "doc_id", marked=scanner.marked).groupBy("doc_id", "paragraph", "at", "context").agg(best)
    inside = inside.select("doc_id", "paragraph", "best.*").distinct().withColumn("piece", F.xxhash64("tokens"))
    inside = scored(inside, scanner, "doc_id", "paragraph", "stated", "cover", "piece").where("x.family = stated")
    inside = inside.select("doc_id", "paragraph", "x.family", "x.probability", F.col("cover").alias("contained"), F.lit(True).alias("confirmed"))
    found = whole.select(inside.columns).unionByName(inside)
    best = F.max(F.struct("confirmed", "probability", "contained")).alias("x")
    return found.groupBy("doc_id", "paragraph", "family").agg(best).select("doc_id", "paragraph", "family", "x.probability", "x.contained", "x.confirmed")


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, licence_paragraphs, families, probability), a row a document; families of confirmed paragraphs."""
    found = scan(docs, fit(docs)).where("confirmed").groupBy(F.col("doc_id").alias("_id")).agg(
        F.count_distinct("paragraph").alias("licence_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability")
    )
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    every = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("paragraphs"))
    return every.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "paragraphs", F.coalesce("licence_paragraphs", F.lit(0)).cast("long").alias("licence_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), "probability"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
