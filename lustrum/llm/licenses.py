"""Licence scan: a trained paragraph classifier over sparse word n-grams.

A paragraph is what stands between line breaks behind which a sentence has ended, or
blank lines, so a notice wrapped over several lines is one.  It is a set of word 1- to
3-grams.  Logistic regressions with an L1 penalty, one for each licence family and one
for notices of any licence, are fit on notices (names of these and of other licences in
frames such as "Licensed under ...") and on prose that uses their words; the sparse
weights are whole numbers, so that sums don't depend on their order.

A class counts from its cut on, which is calibrated on names, frames and prose that the
fit didn't see: half-way between what all but a twentieth of the class's own notices
reach there and what all but a fiftieth of the others do.  Every family whose cut a
paragraph reaches is one of its families; a paragraph that reaches none of these but the
cut for notices of any licence is ``unknown``.  A family is confirmed by comparison with
its templates: of the paragraph's or the template's word 5-grams, whichever are fewer,
0.8 or more are shared.

The scan runs on DataFrame operations only.  Texts go on if they hold one of the model's
own anchors: a word (or a pair of words) of every n-gram that has a weight.  Without one
a paragraph's sums are the biases, which are below every cut, so none that some class
takes is lost.  For that, n-grams of words that any prose uses aren't features.  Weights and template
shingles are broadcast: their number is fixed by the notices here, whatever the corpus.

Defined results: a null or empty text has no paragraphs and no licence; rows alike in
doc_id and text get the same result each; an empty table gives no rows; extra columns
aren't read.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

#: Sentences by which notices of these families are known.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Text available under the CC BY-NC 4.0 license.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the CC BY 4.0 license.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the CC BY-SA 4.0 license.",
    ),
    "bsd-3-clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
FAMILIES = tuple(TEMPLATES)
ANY = "any"
CLASSES = (*FAMILIES, ANY)

#: Short names of the families, and names of other licences
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0"),
    "mit": ("MIT License", "MIT"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPL-3.0-or-later", "GNU GPL v3", "GPLv3"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "bsd-3-clause": ("BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"),
}
OTHERS = (
    "Apache License, Version 1.1", "Apache License 1.0", "Apache-1.1", "GNU General Public License, version 2", "GPL-2.0", "GPLv2", "GNU General Public License, version 1",
    "GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPL-3.0", "LGPL-2.1", "GNU Affero General Public License, version 3", "AGPL-3.0",
    "CC BY 3.0", "CC BY 2.0", "CC BY-SA 3.0", "CC BY-SA 2.0", "CC BY-NC 3.0", "CC BY-NC 2.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC0 1.0",
    "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "BSD 2-Clause License", "BSD-2-Clause", "BSD 4-Clause License", "Mozilla Public License, v. 1.1", "Mozilla Public License 1.1", "MPL-1.1", "Eclipse Public License, version 2.0", "EPL-2.0",
    "ISC License", "zlib License", "Boost Software License 1.0", "Artistic License 2.0", "Unlicense", "European Union Public License 1.2", "CDDL-1.0", "SIL Open Font License 1.1",
    "GNU Free Documentation License, version 1.3", "Academic Free License 3.0", "Open Software License 3.0", "Foo Public License, version 7", "Acme Community License", "Example Corporation License",
)
FRAMES = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "License: {}", "This project is distributed under the terms of the {}.",
    "SPDX-License-Identifier: {}", "Text is available under the {} license.", "{}", "Published under {}.", "Copyright (c) 2021 The Authors. Licensed under {}.", "SPDX: {}",
    "This program is made available under the terms of the {} license.", "See the {} for details.", "Licensed under {} or a commercial license.", "This work is under a {} license.", "Text: {}",
)
#: notices without a licence's name, and prose (in the first languages of the corpus) that uses the notices' words
NOTICES = (
    "All rights reserved.", "Copyright 2019 the authors. All rights reserved.", "Copyright (c) 2021 Someone.", "This software is proprietary and may not be copied.", "License", "A license.",
    "Licensed under the terms agreed with the vendor.", "Distributed under a custom license.", "Use of this text is subject to the license agreement.", "See the license for details.",
    "This material is dedicated to the public domain.", "No license is granted.", "The license of this text is found in the file beside it.", "You may use this under the license.",
)
PROSE = (
    "He renewed his driving license in the spring.", "The version of the story that you may know is free of any charge.", "Public opinion about the work was divided.", "The license plate of the car was red.",
    "Any person may use this road in the winter.", "The general gave permission for the release of the copy.", "A source of light in the form of a lamp is required.", "His pilot license had run out by then.",
    "The foundation of the house was made of stone and the program was published later.", "They met the following conditions with or without help.", "A license plate was found on the road.",
    "She wrote the commons committee a letter about international trade.", "You should have received the parcel along with this note.", "The file is in the folder under the desk.",
    "A license is a plate with a number on it.", "The terms of the treaty were read under the old tree.", "Text and image are printed on the page.", "See the map for details.", "This work is done.",
    "The project was released to the public in version 3 of the plan.", "The apache helicopter landed.", "Students at MIT met in the morning.", "The code is in the book.", "The authors work under pressure.",
    "Sie geht mit dem Hund.", "Der Hund kam mit.", "Er spielt mit der Katze und mit dem Kind.", "Mit der Zeit kam Rat.", "Das Haus mit dem Garten ist alt.", "Sie kommt mit.", "Komm mit und sieh selbst.",
    "Er ging mit ihr unter den Baum.", "Das war so oder mit Absicht.", "Le texte est dans le livre de la ville.", "El perro y el gato son de la casa.",
)

GRAMS, SHINGLE, ALIKE, SCALE = 3, 5, 0.8, 10_000
#: where a paragraph ends: behind a sentence at a line's end, and at blank lines
ENDED, BLANK = r"([.!?:;][ \t]*)\n", r"\n[ \t]*\n"


def words_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.translate({c: c + 32 for c in range(65, 91)}))


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def shingles_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def paragraphs_of(text: str) -> list[str]:
    return re.sub(BLANK, "\x01", re.sub(ENDED, "\\1\x01", text)).split("\x01")


#: words that any prose may use, besides those of PROSE
_USUAL = "c open provided beside 0 1 2 3 4 5 6 7 8 9 v all no not or to that use used made available following conditions public general version work works program project text code content files details terms".split()
COMMON = frozenset(w for t in PROSE for w in words_of(t)) - {"license", "licence", "apache"} | frozenset(_USUAL)


def _rare(gram: str) -> list[str]:
    return sorted(set(gram.split()) - COMMON)


def _pairs(gram: str) -> list[str]:
    words = gram.split()
    return [" ".join(p) for p in zip(words, words[1:], strict=False)]


@dataclass(frozen=True)
class Model:
    anchors: tuple[str, ...]  # words or runs of words
    weights: dict[str, tuple[int, ...]]  # n-gram -> weight in each class, times SCALE
    bias: tuple[int, ...]
    cuts: tuple[int, ...]  # sums from which a class counts


#: how much the fit makes of notices without names, of templates and of prose, which are few beside the framed names
WEIGHT = {"notice": 6.0, "template": 4.0, "prose": 12.0}


def examples() -> list[tuple[str, str | None, bool, float]]:
    """(text, family, ANY or None for prose, whether it is held out for the cuts, weight), each text once."""
    out: list[tuple[str, str | None, bool, float]] = []

    def framed(name: str, kind: str, unseen: bool) -> None:
        for k, frame in enumerate(FRAMES):
            if frame != "{}" or name != "MIT":  # a German word by itself
                text = frame.format(name).replace("License License", "License").replace("License license", "license").replace("License. license", "license")
                out.extend((t, kind, unseen or k % 4 == 2, 1.0) for t in (text, text.replace("icense", "icence")))

    for family, names in NAMES.items():
        for name in names:
            framed(name, family, False)
        for k, t in enumerate(TEMPLATES[family]):
            more = (t, f"Copyright (c) 2020 The Authors. {t}", f"{t} See the file for details.")
            out += [(v, family, i == 2 and k % 2 == 1, WEIGHT["template"]) for i, v in enumerate(more)]
    for k, name in enumerate(OTHERS):
        framed(name, ANY, k % 4 == 3)
    both = [names[0] for names in NAMES.values()]
    pairs = [(f"{a} or {b}", f, g) for f, a in zip(FAMILIES, both, strict=True) for g, b in zip(FAMILIES, both, strict=True) if f < g]
    out += [(f"Licensed under {t}.", f"{f}+{g}", k % 5 == 4, 1.0) for k, (t, f, g) in enumerate(pairs)]
    out += [(f"{NAMES[f][-1]} OR {NAMES[g][-1]}", f"{f}+{g}", False, 1.0) for _, f, g in pairs]
    out += [(t, ANY, k % 5 == 4, WEIGHT["notice"]) for k, t in enumerate(NOTICES)]
    out += [(t.replace("icense", "icence"), ANY, k % 5 == 4, WEIGHT["notice"]) for k, t in enumerate(NOTICES)]
    for k, t in enumerate(PROSE):
        out += [(v, None, k % 6 == 5, WEIGHT["prose"]) for v in (t, f"{t} {PROSE[(k + 7) % len(PROSE)]}")]
    return list({t: (t, *more) for t, *more in out}.values())


def truth(kind: str | None) -> list[bool]:
    """Which classes an example belongs to."""
    return [f in (kind or "").split("+") for f in FAMILIES] + [kind is not None]


def design(rows: list[tuple[str, str | None, bool, float]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The n-grams of several notices, the examples over them (and a one for the bias), and their classes."""
    sets = [grams_of(words_of(t)) for t, *_ in rows]
    counts: dict[str, int] = {}
    for s, (_, kind, held, _) in zip(sets, rows, strict=True):
        for g in s if kind and not held else ():
            counts[g] = counts.get(g, 0) + 1
    vocabulary = sorted(g for g, n in counts.items() if n > 1 and (_rare(g) or any("mit" in p.split() for p in _pairs(g))))
    place = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for r, s in enumerate(sets):
        x[r, [place[g] for g in s if g in place]] = 1
    return vocabulary, x, np.array([truth(kind) for _, kind, *_ in rows], float)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2e-4, steps: int = 300) -> np.ndarray:
    """Weights by accelerated proximal gradient: the shrinking keeps them sparse."""
    share = (weight / weight.sum())[:, None]
    grow = np.ones(x.shape[1])
    for _ in range(12):  # the largest curvature, by powers
        grow = x.T @ (share[:, 0] * (x @ grow))
        size = np.linalg.norm(grow)
        grow /= size
    pace = 4 / (1.05 * size)
    w = ahead = np.zeros((x.shape[1], y.shape[1]))
    for k in range(steps):
        p = 1 / (1 + np.exp(-x @ ahead))
        new = ahead - pace * x.T @ (share * (p - y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - pace * penalty)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


@functools.cache
def train() -> Model:
    rows = examples()
    vocabulary, x, y = design(rows)
    held, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    whole = np.rint(fit(x[~held], y[~held], weight[~held]) * SCALE).astype(int)
    sums, own = x[held] @ whole, y[held] > 0
    cuts = [int((np.quantile(sums[own[:, k], k], 0.05) + np.quantile(sums[~own[:, k], k], 0.98)) / 2) for k in range(len(CLASSES))]
    weights = {g: tuple(map(int, whole[k])) for k, g in enumerate(vocabulary) if whole[k].any()}
    return Model(_anchors(sorted(weights)), weights, tuple(map(int, whole[-1])), tuple(cuts))


def _anchors(grams: list[str]) -> tuple[str, ...]:
    """Words and pairs of words of which every n-gram holds one; few, as those in most n-grams come first."""
    out = {next(p for p in _pairs(g) if "mit" in p.split()) for g in grams if not _rare(g)}
    met = {g: _rare(g) for g in grams if _rare(g)}
    while met:
        counts: dict[str, int] = {}
        for words in met.values():
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        best = min(counts, key=lambda w: (-counts[w], w))
        out.add(best)
        met = {g: words for g, words in met.items() if best not in words}
    return tuple(sorted(out))


def _anchored(text: Column, model: Model) -> Column:
    runs = "|".join(a.replace(" ", "[^0-9a-z]+") for a in model.anchors)
    return text.rlike(rf"(?i)(?<![0-9a-z])(?:{runs})(?![0-9a-z])")


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, th, par, words of the paragraphs that can hold a licence."""
    hinted = docs.where(_anchored(F.col("text"), model))
    parts = F.split(F.regexp_replace(F.regexp_replace("text", ENDED, "$1\x01"), BLANK, "\x01"), "\x01", -1)
    each = hinted.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(parts).alias("par", "part"))
    words = F.filter(F.split(ascii_lower(F.col("part")), "[^0-9a-z]+", -1), lambda w: w != "")
    return each.where(_anchored(F.col("part"), model)).select("doc_id", "th", "par", words.alias("words")).where(F.size("words") > 0)


def _runs(n: int, size: Column) -> Column:
    """All runs of ``n`` words (none if there are fewer), joined by blanks."""
    at = F.sequence(F.lit(1), size - n + 1)
    return F.when(size < n, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.array_join(F.slice("words", i, n), " ")))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, th, par, family (or unknown), probability, confirmed of each licence in each paragraph."""
    model = model or train()
    spark = docs.sparkSession
    found = durable(paragraphs(docs, model).distinct())
    size = F.size("words")
    key = ["doc_id", "th", "par"]
    # the weights' and the templates' tables have as many rows as the notices give
    table = spark.createDataFrame([(g, list(w)) for g, w in sorted(model.weights.items())], "gram string, w array<int>")
    grams = found.select(*key, F.explode(F.array_distinct(F.concat(*[_runs(n, size) for n in range(1, GRAMS + 1)]))).alias("gram"))
    sums = [(F.sum(F.get("w", F.lit(k))) + model.bias[k]).alias(f"s{k}") for k in range(len(CLASSES))]
    judged = grams.join(F.broadcast(table), "gram").groupBy(*key).agg(*sums)
    sure = [F.when(F.col(f"s{k}") >= model.cuts[k], F.struct(F.lit(name).alias("name"), F.col(f"s{k}").alias("s"))) for k, name in enumerate(CLASSES)]
    families = F.filter(F.array(*sure[:-1]), lambda c: c.isNotNull())
    named = F.when(F.size(families) > 0, families).when(sure[-1].isNotNull(), F.array(F.struct(F.lit("unknown").alias("name"), F.col(f"s{len(FAMILIES)}").alias("s"))))
    likely = judged.select(*key, F.explode(named).alias("c")).select(*key, F.col("c.name").alias("family"), F.round(1 / (1 + F.exp(-F.col("c.s") / SCALE)), 6).alias("probability"))

    parts = [(s, f"{family}#{i}", family, len(shingles_of(words_of(t)))) for family, ts in TEMPLATES.items() for i, t in enumerate(ts) for s in shingles_of(words_of(t))]
    known = spark.createDataFrame(parts, "shingle string, template string, kin string, n_template int")
    whole = F.when(size < SHINGLE, F.array(F.array_join("words", " "))).otherwise(_runs(SHINGLE, size))
    shingles = found.select(*key, F.array_distinct(whole).alias("all")).select(*key, F.size("all").alias("n_own"), F.explode("all").alias("shingle"))
    shared = shingles.join(F.broadcast(known), "shingle").groupBy(*key, "n_own", "template", "kin", "n_template").agg(F.count(F.lit(1)).alias("n"))
    alike = shared.where(F.col("n") / F.least("n_own", "n_template") >= ALIKE).select(*key, F.col("kin").alias("family")).distinct().withColumn("__alike", F.lit(True))
    met = _beside(likely, alike, [*key, "family"])
    return met.select(*key, "family", "probability", F.coalesce("__alike", F.lit(False)).alias("confirmed"))


def _beside(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``a`` with the other columns of ``b`` where all of ``key`` agree, nulls too."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in key})
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(b, same, "left").drop(*[f"__{k}" for k in key])


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, families (confirmed, sorted, comma-joined), n_licence, n_confirmed, n_unknown of every document."""
    found = scan(docs).groupBy("doc_id", "th").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count(F.lit(1)).alias("n_licence"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(F.col("family") == "unknown").alias("n_unknown"),
    )
    found = found.withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["th"] == F.col("__th")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *[F.coalesce(c, zero).alias(c) for c in ("n_licence", "n_confirmed", "n_unknown")])
