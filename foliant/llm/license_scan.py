"""Licence families of paragraphs: a trained classifier whose findings a template must confirm."""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

#: A licence of no family below, and no licence.
UNKNOWN, NONE = "unknown", "none"
#: Common wordings of each family (fixed values).
TEMPLATES = {
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3", "This program is distributed under the terms of the GNU AGPL v3"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "This project is released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0", "Apache License", "MIT or Apache-2.0"],
    "bsd": ["Licensed under the BSD 3-Clause License", "Released under the BSD license", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["Released under CC0 1.0", "Dedicated to the public domain under CC0 1.0 Universal"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2", "Released under the GPL v2 license", "GNU General Public License version 2"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "Released under the GPL v3 license", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License version 3", "GNU General Public License version 3"],
    "lgpl": ["Licensed under the GNU Lesser General Public License", "This library is distributed under the LGPL license", "GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "MIT License", "MIT or Apache-2.0"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "Mozilla Public License Version 2.0"],
    "proprietary": ["All rights reserved", "Copyright, all rights reserved. No part may be reproduced without permission"],
}
#: Texts that share words with the families but state no licence (fixed values).
OTHERS = (
    "He renewed his driving license at the public office", "The license plate was photographed under the bridge", "She studied at MIT and released a paper on software", "An Apache helicopter landed near version 2 of the base",
    "The general public was reserved about all of the rights", "A general licence to practise medicine in the state", "Free of charge for any person with a ticket", "This work is under way and the terms are known", "The commons were creative about attribution of the work",
    "The copyright debate went on for years", "Source and binary stars in the night sky", "The Mozilla browser is public and free", "Redistribution of wealth and use of land are debated", "The library is open to the general public", "The program was released in version 3", "International flights leave from terminal 4",
)
#: Names of other licences, to learn how a licence is stated whatever its name (fixed values). The last five only calibrate.
OTHER_NAMES = (
    "Eclipse Public License 2.0", "zlib License", "Boost Software License 1.0", "ISC License", "Artistic License 2.0", "European Union Public Licence 1.2", "Microsoft Public License", "Academic Free License 3.0",
    "Open Software License 3.0", "Common Development and Distribution License", "PostgreSQL License", "University Software License", "Example Source License 1.1", "Python Software Foundation License", "SIL Open Font License 1.1", "Sleepycat License", "Vim License", "Upstream Public License",
)
HELD_NAMES = 5
#: Ways to state a licence by name.
STATEMENTS = ("{}", "Licensed under the {}", "Released under the {}", "Distributed under the terms of the {}", "This program is licensed under the {}", "This file is subject to the {}")
#: Word pairs of which a statement of an unknown licence has one.
CUES = ("licensed under", "public license", "public licence", "software license", "source license", "free license", "license version", "license agreement", "this license", "license terms")
#: A family counts beside the most probable one from this probability on, as under two licences at once.
ALONGSIDE = 0.25
#: Share of a template's word pairs that must stand in the paragraph.
CONFIRMED = 0.75


def words(text: str) -> list[str]:
    """Lower-case words of letters, digits, dots and hyphens; kept in step with _words."""
    return [w.strip(".-") for w in re.sub(r"[^a-z0-9.-]+", " ", text.lower()).split() if w.strip(".-")]


def grams(text: str) -> set[str]:
    w = words(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def pairs(text: str) -> set[str]:
    return {g for g in grams(text) if " " in g} or grams(text)


#: Words of any text, which the gate takes only where no other is left (fixed values).
COMMON = frozenset(("a", "and", "any", "as", "by", "for", "in", "is", "it", "no", "of", "or", "the", "this", "to", "under", "with", "use", "work", "you"))


@functools.lru_cache
def gate_words() -> list[str]:
    """Words of which every paragraph with CONFIRMED of a template's pairs has one: the pairs without them are too few."""
    texts = [t for own in TEMPLATES.values() for t in own]
    spread = Counter(w for t in [*texts, *OTHERS] for w in set(words(t)))
    chosen: set[str] = set()
    for text in texts:
        without = pairs(text)
        for word in sorted(set(words(text)), key=lambda w: (w not in chosen, w in COMMON, spread[w], -len(w), w)):
            if len(without) < CONFIRMED * len(pairs(text)):
                break
            rest = {g for g in without if word not in g.split(" ")}
            if len(rest) < len(without):
                chosen.add(word)
                without = rest
    return sorted(chosen | {w for w in cue_words() if w.startswith("licen")})


def cue_words() -> set[str]:
    return {w for cue in CUES for w in cue.split(" ")}


#: For lower-case text. Paragraphs without any of these words can't be confirmed and aren't scored. The border and a first letter are looked for before the words, as most places have neither.
GATE = r"(?:^|[^a-z0-9])(?=[" + "".join(sorted({w[0] for w in gate_words()})) + r"])(?:" + "|".join(re.escape(w) for w in gate_words()) + r")(?![a-z0-9])"


def _examples(seed: int, names: tuple[str, ...]) -> list[tuple[str, str]]:
    """Templates, statements of other names and texts without a licence, each also with words dropped and words of others around it."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pool = [w for t in OTHERS for w in words(t)]
    unknown = [form.format(name) for name in names for form in STATEMENTS]
    out = []
    for family, texts, times in [*((f, t, 12) for f, t in TEMPLATES.items()), (UNKNOWN, unknown, 4), (NONE, OTHERS, 40)]:
        for text in texts:
            for k in range(times):
                w = [x for x in words(text) if k == 0 or rng.random() > 0.1]
                before, after = (rng.choice(pool, rng.integers(0, 6)).tolist() if k else [] for _ in range(2))
                out.append((family, " ".join([*before, *w, *after])))
    return out


@functools.lru_cache
def train(seed: int = 5, ridge: float = 0.02, rounds: int = 400) -> tuple[list[str], list[str], np.ndarray, float]:
    """(classes, vocabulary, weights with the bias last, temperature) of a softmax regression on word 1- and 2-grams.

    Weights near 0 are cut to 0. The temperature calibrates the probabilities
    on held-out examples: other garbled forms of the templates, and unknown
    licences whose names the fit hasn't seen.
    """
    examples = _examples(seed, OTHER_NAMES[:-HELD_NAMES])
    classes = [*TEMPLATES, UNKNOWN, NONE]
    vocabulary = sorted({g for _, t in examples for g in grams(t)})
    index = {g: i for i, g in enumerate(vocabulary)}

    def design(some: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(some), len(vocabulary) + 1))
        x[:, -1] = 1
        for i, (_, text) in enumerate(some):
            x[i, [index[g] for g in grams(text) if g in index]] = 1
        return x, np.array([classes.index(c) for c, _ in some])

    x, y = design(examples)
    target = np.eye(len(classes))[y]
    share = 1 / np.bincount(y, minlength=len(classes))[y][:, None] / len(classes)
    w, speed = np.zeros((x.shape[1], len(classes))), 0.0
    for _ in range(rounds):
        p = _softmax(x @ w)
        speed = 0.9 * speed - 0.5 * (x.T @ ((p - target) * share) + ridge * w / len(vocabulary))
        w = w + speed
    w[np.abs(w) < 0.02] = 0
    w = w.round(9)
    held, truth = design(_examples(seed + 1, OTHER_NAMES[-HELD_NAMES:]))
    fit = [(round(-np.log(np.maximum(_softmax(held @ w / t)[np.arange(len(truth)), truth], 1e-12)).mean(), 9), t) for t in np.geomspace(0.1, 5, 40)]
    return classes, vocabulary, w, float(min(fit)[1])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _words(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9.-]+", " "), " ")
    return F.array_remove(F.transform(parts, lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", "")), "")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_paragraphs, n_license_paragraphs, families (sorted, comma-joined), n_unknown_paragraphs, probability (the least of the found ones; null without).

    A paragraph is a block of lines up to a blank one; n_paragraphs counts
    them. A notice may be one line of it, wrapped over several, or a heading
    of its own: each line, and each run of lines within a paragraph with at
    most as many words between its first and last line as the longest
    template has, goes through a softmax regression over word 1- and 2-grams.
    The families compete with the class of unknown licences and that of no
    licence. A family counts if it is the most probable class, or at least
    ALONGSIDE probable, and CONFIRMED of the word pairs of one of its
    templates stand in the run. A run whose most probable class is unknown and
    that has one of CUES is an unknown licence, unless it overlaps a found
    family. Of runs within each other the shortest counts, and those of a
    family that overlap are one found paragraph.

    What counts needs the pairs of a template or a cue, so runs without any of
    the gate's words can't count (the words are derived from these pairs, see
    gate_words); only runs with one are scored, and nothing else is left out.
    The weights (some hundred grams) are broadcast. The texts are read once;
    words of texts with a gate word are kept, and only runs with one are
    shuffled.

    A null or empty text has no paragraphs. Rows are told apart by a row
    number, so null and repeated ids are fine. Equal probabilities go to the
    class first in the list. Columns that aren't named aren't read. Very long
    lines are scored whole. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "license")
    classes, vocabulary, weights, temperature = train()
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = r"[^\x20\x09-\x0D]"
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.split(text, "\n").alias("lines"), F.lower(text).rlike(GATE).alias("gated"), F.split(text, r"\n(?:[\x20\x09\x0B-\x0D]*\n)+").alias("blocks"))
    # The words of each line (null: a blank one) of texts with a gate word.
    own = F.when(F.col("gated"), F.transform("lines", lambda p: F.when(p.rlike(solid), _words(p))))
    rows = rows.select("doc_id", F.size(F.filter("blocks", lambda p: p.rlike(solid))).cast("long").alias("n_paragraphs"), own.alias("lines"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(rows)

    # Runs of neighbouring lines up to a blank one; each is scored if a line in it has a gate word.
    span = max(len(words(t)) for texts in TEMPLATES.values() for t in texts)
    gate = ", ".join(f"'{w}'" for w in gate_words())
    ahead = rows.select("row", F.posexplode(F.expr(f"transform(lines, (l, i) -> slice(lines, i + 1, {span + 2}))")).alias("k", "ahead")).where("ahead[0] IS NOT NULL")
    ahead = ahead.withColumn("ahead", F.expr("slice(ahead, 1, coalesce(nullif(array_position(transform(ahead, l -> l IS NULL), true), 0) - 1, size(ahead)))"))
    ahead = ahead.where(f"exists(ahead, l -> arrays_overlap(l, array({gate})))")
    runs = ahead.select("row", "k", F.posexplode(F.expr("transform(ahead, (l, i) -> slice(ahead, 1, i + 1))")).alias("more", "run"))
    inner = "aggregate(slice(run, 2, greatest(more - 1, 0)), 0, (n, l) -> n + size(l))"
    own = runs.where(f"{inner} <= {span}").select("row", "k", (F.col("k") + F.col("more")).alias("last"), F.flatten("run").alias("words")).where(f"arrays_overlap(words, array({gate}))")
    two = F.expr("CASE WHEN size(words) < 2 THEN array() ELSE transform(sequence(0, size(words) - 2), i -> concat_ws(' ', words[i], words[i + 1])) END")
    own = own.select("row", "k", "last", F.explode(F.array_distinct(F.concat("words", two))).alias("gram"))

    # One broadcast table says for each gram its weights, and of which templates and cues it is a pair: each of them counts in bits of its own of the t columns.
    scale = weights / temperature
    stated = [(family, pairs(text), len(pairs(text))) for family, texts in TEMPLATES.items() for text in texts] + [(UNKNOWN, {cue}, 1) for cue in CUES]
    bits = max(n for _, _, n in stated).bit_length()
    each_column = 62 // bits
    places = [(i // each_column, i % each_column * bits) for i in range(len(stated))]
    wide = places[-1][0] + 1

    def packed(gram: str) -> list[int]:
        sums = [0] * wide
        for (column, shift), (_, own_pairs, _) in zip(places, stated):
            sums[column] += (gram in own_pairs) << shift
        return sums

    index = {g: i for i, g in enumerate(vocabulary) if scale[i].any()}
    table = [(g, *(scale[index[g]].tolist() if g in index else [0.0] * len(classes)), *packed(g)) for g in sorted(index.keys() | set().union(*(p for _, p, _ in stated)))]
    table = spark.createDataFrame(table, ", ".join(["gram string", *(f"w{j} double" for j in range(len(classes))), *(f"t{j} long" for j in range(wide))]))
    scored = own.join(F.broadcast(table), "gram").groupBy("row", "k", "last").agg(*[F.round(F.sum(f"w{j}") + scale[-1, j].item(), 9).alias(f"w{j}") for j in range(len(classes))], *[F.sum(f"t{j}").alias(f"t{j}") for j in range(wide)])

    def matched(family: str) -> Column:
        """Whether CONFIRMED of the pairs of one of the family's templates stand in the run; for UNKNOWN, whether a cue does."""
        counts = [(F.shiftright(f"t{column}", shift).bitwiseAND((1 << bits) - 1), n) for (column, shift), (f, _, n) in zip(places, stated) if f == family]
        return functools.reduce(Column.__or__, [count >= CONFIRMED * n for count, n in counts])

    top = F.greatest(*[f"w{j}" for j in range(len(classes))])
    total = sum((F.exp(F.col(f"w{j}") - top) for j in range(len(classes))), F.lit(0.0))
    first = F.coalesce(*[F.when(F.col(f"w{j}") == top, F.lit(c)) for j, c in enumerate(classes)])
    each = F.array(*[F.struct(F.lit(c).alias("family"), F.round(F.exp(F.col(f"w{j}") - top) / total, 6).alias("probability"), matched(c).alias("matched")) for j, c in enumerate(classes) if c != NONE])
    counts = lambda x: x["matched"] & ((x["family"] == first) | ((x["probability"] >= ALONGSIDE) & (x["family"] != UNKNOWN)))
    scored = scored.where(" OR ".join(f"t{j} != 0" for j in range(wide)))
    found = scratch.save(scored.select("row", "k", "last", F.explode(F.filter(each, counts)).alias("c")).select("row", "k", "last", "c.family", "c.probability"))

    # Unknown licences stand where no family does; a run counts if none inside it states its family; those that overlap are one notice.
    known = found.where(F.col("family") != UNKNOWN).select("row", F.col("k").alias("from"), F.col("last").alias("to")).distinct()
    found = found.alias("f").join(known.alias("n"), (F.col("f.row") == F.col("n.row")) & (F.col("family") == UNKNOWN) & (F.col("k") <= F.col("to")) & (F.col("last") >= F.col("from")), "left_anti")
    inside = Window.partitionBy("row", "family").orderBy(F.desc("k"), "last").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("least", F.min("last").over(inside)).where("least IS NULL OR least > last")
    before = F.lag("last").over(Window.partitionBy("row", "family").orderBy("k"))
    found = found.withColumn("starts", F.coalesce(F.col("k") > before, F.lit(True)).cast("long")).groupBy("row")
    named = F.when(F.col("family") != UNKNOWN, F.col("family"))
    found = found.agg(F.sum(F.when(named.isNotNull(), F.col("starts"))).alias("n"), F.array_join(F.sort_array(F.collect_set(named)), ",").alias("families"), F.sum(F.when(named.isNull(), F.col("starts"))).alias("u"), F.min("probability").alias("probability"))
    out = rows.select("row", "doc_id", "n_paragraphs").join(found, "row", "left")
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(name) for c, name in (("n", "n_license_paragraphs"), ("u", "n_unknown_paragraphs"))]
    return out.select("doc_id", "n_paragraphs", counted[0], F.coalesce("families", F.lit("")).alias("families"), counted[1], "probability")
