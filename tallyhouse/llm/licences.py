"""Licence notices in documents: a trained paragraph classifier whose findings templates confirm.

Features are a paragraph's words and word pairs, those of the templates' vocabulary. A multinomial logistic
regression over the licence families and an unknown class is fitted on the templates, on parts of them, and
on foreign sentences made of the same words. Its probabilities are calibrated: the smallest probability at
which no foreign training paragraph would be taken for a licence is the bar. A paragraph over the bar still
has to share enough of the words of one template of its family.

The model is a small table of weights, so scoring is a lookup and a sum in DataFrame functions; no Python
runs on the executors. A paragraph is a run of lines, as many as the longest template can be wrapped to.
Runs that cannot share enough words with any template are left out first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.shared import documents, prepare

MIN_SHARED = 0.6
UNKNOWN = "unknown"

# fixed values: usual short notices of each family
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD License.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
}
# fixed values: sentences that use the same words and are no notice
FOREIGN = [
    "She renewed her driving license before the public holiday.",
    "The general gave the public permission to use the road.",
    "Version 2.0 of the program was released in May.",
    "This work is free of charge for any person.",
    "The source of the river is subject to the terms of the treaty.",
    "You may not use this file.", "A license to fish is granted by the town.",
    "Released in the spring, the film was a work of a common man.",
    "The software foundation of the bridge is under the creative commons building.",
    "He was licensed to practice medicine under the law.",
    "The following conditions are met in most forms of use.", "Copy the documentation files to the binary folder.",
    "The apache helicopter is under repair.", "MIT is a university in Cambridge.",
    "The Mozilla browser was released.", "The GNU operating system has a general public.",
    "in the and of to a is for by or with that this are be", "the of and", "under the version", "by 4.0 and 2.0",
]
COMMON = {"the", "of", "and", "to", "a", "is", "in", "for", "by", "or", "with", "that", "are", "this", "be", "as",
          "you", "it", "any", "may", "not", "can"}  # fixed values


def words_of(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits, with dots and hyphens inside."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c in ".-") else " " for c in text.lower())
    return [w for w in (word.strip(".-") for word in kept.split()) if w]


def column_words(text: Column) -> Column:
    """The same for a column."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9.-]+", " ")
    return F.filter(
        F.transform(F.split(plain, " ", -1), lambda w: F.btrim(w, F.lit(".-"))), lambda w: w != ""
    )


def features(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def training_paragraphs() -> list[tuple[str, list[str]]]:
    """(family, words): templates, their longer beginnings and endings, and foreign text."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            out += [(family, words)] * 3
            out += [(family, words[: len(words) * n // 10]) for n in (7, 8, 9) if len(words) >= 8]
            out += [(family, words[len(words) * n // 10:]) for n in (1, 2) if len(words) >= 8]
            out += [(UNKNOWN, words[:2]), (UNKNOWN, words[::-3])]
    out += [(UNKNOWN, words_of(text)) for text in FOREIGN for _ in range(3)]
    return out


def train(penalty: float = 0.002, rounds: int = 600) -> dict:
    """Weights of a multinomial logistic regression, sparse by a soft threshold, and the calibrated bar."""
    paragraphs = training_paragraphs()
    classes = [UNKNOWN, *sorted(TEMPLATES)]
    names = sorted({f for family, words in paragraphs if family != UNKNOWN for f in features(words)})
    at = {name: n for n, name in enumerate(names)}
    x = np.zeros((len(paragraphs), len(names)))
    for row, (_, words) in enumerate(paragraphs):
        for name in features(words):
            if name in at:
                x[row, at[name]] = 1.0
    x /= np.maximum(1, np.sqrt(x.sum(1, keepdims=True)))
    y = np.array([classes.index(family) for family, _ in paragraphs])
    target = np.eye(len(classes))[y]
    weights, bias = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    for _ in range(rounds):
        error = _softmax(x @ weights + bias) - target
        weights -= 5.0 * (x.T @ error) / len(x)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - 5.0 * penalty / 10, 0)
        bias -= 5.0 * error.mean(0)
    chance = 1 - _softmax(x @ weights + bias)[:, 0]
    bar = max(0.5, float(chance[y == 0].max()) + 0.01)
    return {
        "classes": classes, "bias": bias.tolist(), "bar": min(bar, 0.95),
        "weights": {name: weights[n].tolist() for n, name in enumerate(names) if np.abs(weights[n]).max() > 0},
    }


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def telling_words() -> list[str]:
    """Words of which every paragraph that can be confirmed has one: of each template its longest words, one
    more than a paragraph with MIN_SHARED of the template's words may lack."""
    chosen = set()
    for text in (text for texts in TEMPLATES.values() for text in texts):
        own = sorted(set(words_of(text)), key=lambda w: (-len(w), w))
        chosen.update(own[: len(own) - int(np.ceil(len(own) * MIN_SHARED - 1e-9)) + 1])
    return sorted(chosen, key=lambda w: (len(w), w))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words, as part of a longer one too. The outer function binds the
    lower-cased text once."""

    def found(low: Column) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        return hit

    return F.exists(F.array(F.lower(text)), found)


def bound(value: Column, function) -> Column:
    """``function`` of a value that is worked out once, however often the function uses it."""
    return F.transform(F.array(value), function)[0]


def confirming(words: Column, share: Column) -> Column:
    """Whether the words hold ``share`` of the distinct words of any template."""
    hit = F.lit(False)
    for text in (text for texts in TEMPLATES.values() for text in texts):
        own = sorted(set(words_of(text)))
        hit = hit | (F.size(F.array_intersect(words, F.array(*map(F.lit, own)))) / float(len(own)) >= share)
    return hit


def judged(words: Column, model: dict) -> Column:
    """(family, probability, shared) of a word list; the family is null where no feature is known."""
    classes, names = model["classes"], sorted(model["weights"])
    table = F.create_map(*(
        part for name in names
        for part in (F.lit(name), F.array(*(F.lit(float(v)) for v in model["weights"][name])))
    ))
    pairs = F.when(F.size(words) > 1, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda n: F.concat_ws(" ", F.get(words, n), F.get(words, n + 1)),
    )).otherwise(F.array().cast("array<string>"))
    known = F.filter(F.array_distinct(F.concat(words, pairs)), lambda f: F.array_contains(F.lit(names), f))
    zero = F.array(*(F.lit(0.0) for _ in classes))

    def odds(known: Column) -> Column:
        summed = F.aggregate(
            known, zero, lambda total, f: F.zip_with(total, F.element_at(table, f), lambda a, b: a + b)
        )
        scale = F.sqrt(F.greatest(F.size(known), F.lit(1)).cast("double"))
        return F.when(F.size(known) > 0, F.zip_with(
            summed, F.array(*(F.lit(float(b)) for b in model["bias"])), lambda s, b: F.exp(s / scale + b)
        ))

    def shared(family: Column) -> Column:
        out = F.lit(0.0)
        for name in classes[1:]:
            parts = []
            for text in TEMPLATES[name]:
                own = sorted(set(words_of(text)))
                parts.append(F.size(F.array_intersect(words, F.array(*map(F.lit, own)))) / float(len(own)))
            out = F.when(family == name, F.greatest(*parts) if len(parts) > 1 else parts[0]).otherwise(out)
        return out

    def verdict(odds: Column) -> Column:
        best = F.slice(odds, 2, len(classes) - 1)
        family = F.element_at(
            F.array(*map(F.lit, classes[1:])), F.array_position(best, F.array_max(best)).cast("int")
        )
        total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
        return bound(family, lambda name: F.struct(
            name.alias("family"), (1 - odds[0] / total).alias("probability"), shared(name).alias("shared")
        ))

    return bound(bound(known, odds), verdict)


def following(words: Column, at: Column, longest: int) -> Column:
    """The beginnings of the lines after line ``at`` that a notice beginning there can reach: up to a line
    without words."""
    after = F.transform(F.slice(words, at + 2, longest), lambda line: F.slice(line, 1, longest))

    def cut(lines: Column) -> Column:
        blank = F.array_position(F.transform(lines, F.size), 0).cast("int")
        return F.when(blank > 0, F.slice(lines, F.lit(1), F.greatest(blank - 1, F.lit(0)))).otherwise(lines)

    return bound(after, cut)


def runs_from(words: Column, at: Column, longest: int) -> Column:
    """[(last, back, words)]: line ``at`` alone, and with each number of lines after it between whose ends a
    template has room. Of the outer lines of several those words count that a template can reach."""
    own = F.get(words, at)
    tail = F.slice(own, F.greatest(F.size(own) - longest + 1, F.lit(1)), longest)

    def lists(rest: Column) -> Column:
        def run(n: Column) -> Column:
            listed = F.when(n == 0, own).otherwise(F.concat(tail, F.flatten(F.slice(rest, F.lit(1), n))))
            return F.struct((at + n).alias("last"), (-at).alias("back"), listed.alias("words"))

        def room(n: Column) -> Column:
            inner = F.slice(rest, F.lit(1), F.greatest(n - 1, F.lit(0)))
            return F.aggregate(inner, F.lit(0), lambda total, line: total + F.size(line)) < longest

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(rest)), room), run)

    near = bound(following(words, at, longest), lambda rest: F.when(
        confirming(F.concat(own, F.flatten(rest)), F.lit(MIN_SHARED)), lists(rest)
    ))
    return F.filter(
        F.coalesce(near, F.array().cast("array<struct<last: int, back: int, words: array<string>>>")),
        lambda run: confirming(run["words"], F.lit(MIN_SHARED)),
    )


def apart(found: Column, families: list[str]) -> Column:
    """Of runs sorted by their end, the later start first, those that share no line with one of the same
    family before them. So a run with a smaller one inside goes."""
    kind = "array<struct<last: int, back: int, family: string, probability: double, shared: double>>"
    nothing = F.struct(F.lit(-1).alias("end"), F.array().cast(kind).alias("kept"))

    def of(family: str) -> Column:
        return F.aggregate(
            F.filter(found, lambda run: run["family"] == family), nothing,
            lambda state, run: F.when(-run["back"] > state["end"], F.struct(
                run["last"].alias("end"), F.concat(state["kept"], F.array(run)).alias("kept")
            )).otherwise(state),
            lambda state: state["kept"],
        )

    return F.concat(*map(of, families))


def licence_paragraphs(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, paragraph, last_paragraph, family, probability, shared): lines taken for a licence notice.

    ``paragraph`` and ``last_paragraph`` are the numbers, from 0, of the first and last line of the shortest
    run of lines that is confirmed; a run has no line without words inside, and runs of one family share no
    line. So a notice may be wrapped at any width, and one on a single line is found on that line.
    ``shared`` is the part of the best template's words that the run has. Null and empty texts have no notice.
    Rows are independent: repeated rows give repeated results, a null id stays null, other columns are ignored.
    """
    prepare(docs.sparkSession)
    model = model or train()
    telling = telling_words()
    longest = max(len(words_of(text)) for texts in TEMPLATES.values() for text in texts)
    # the explode calls bind a document's words and runs once
    words = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .filter(has_any(F.col("text"), telling))
        .select("doc_id", F.split("text", "\n", -1).alias("lines"))
        .select("doc_id", F.explode(F.array(F.struct(
            F.transform("lines", column_words).alias("words"),
            F.transform("lines", lambda line: has_any(line, telling)).alias("telling"),
        ))).alias("cut"))
        .select("doc_id", F.col("cut.words").alias("words"), F.col("cut.telling").alias("telling"))
    )
    starts = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda at: (F.size(F.get("words", at)) > 0) & F.exists(F.slice("telling", at + 1, longest + 1), lambda hit: hit),
    )
    runs = words.select(
        "doc_id", F.explode(F.array(F.flatten(F.transform(starts, lambda at: runs_from(F.col("words"), at, longest))))).alias("runs")
    ).filter(F.size("runs") > 0)
    scored = runs.select("doc_id", F.explode(F.array(F.transform("runs", lambda run: bound(
        judged(run["words"], model),
        lambda v: F.struct(run["last"], run["back"], v["family"].alias("family"), v["probability"].alias("probability"),
                           v["shared"].alias("shared")),
    )))).alias("scored"))
    found = F.array_sort(F.filter(
        "scored", lambda run: (run["probability"] >= model["bar"]) & (run["shared"] >= MIN_SHARED)
    ))
    return (
        scored.select("doc_id", F.explode(F.array(found)).alias("found"))
        .select("doc_id", F.explode(apart(F.col("found"), model["classes"][1:])).alias("run"))
        .select("doc_id", (-F.col("run.back")).alias("paragraph"), F.col("run.last").alias("last_paragraph"),
                "run.family", "run.probability", "run.shared")
    )


def op9_licences(spark, sf_dir):
    return licence_paragraphs(documents(spark, sf_dir)).select(
        "doc_id", F.col("paragraph").cast("bigint").alias("paragraph"),
        F.col("last_paragraph").cast("bigint").alias("last_paragraph"), "family",
        F.round("probability", 6).alias("probability"), F.round("shared", 6).alias("shared"),
    )
