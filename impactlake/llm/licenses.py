"""License scan by the Dice coefficient over word bigrams, with DataFrame operations only.

Lines of a text, and paragraphs of several lines, are normalised (lower case, runs of other
characters than letters, digits and dots to one space, dots at word ends dropped) and
compared with licence templates.  A unit of ``a`` words can reach a coefficient of t with
a template of ``b`` only if their numbers of bigrams are within a factor of (2 - t) / t, so
most templates are ruled out by size.  Runs of words anywhere in the text, whatever marks
and line ends stand between them, are compared too: from the first to the last word of
stretches of a template's bigrams.  All of it happens within a row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Least coefficient, in thousandths.
DICE = 800
#: Notices of public licences (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def normal_words(text: str) -> list[str]:
    import re

    return [w for w in re.sub(r"\.+(?= |$)", "", re.sub(r"[^a-z0-9.]+", " ", text.lower()).strip(" ")).split(" ") if w]


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors(templates: list[list[str]], least: int) -> list[str]:
    """Words, long ones first, such that a unit without any of them reaches no template.

    A unit must share at least least / (2000 - least) of a template's bigrams, so words
    that stand in all but fewer of them are enough.
    """
    chosen: list[str] = []
    for grams in templates:
        words = sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w))
        without = [g for g in grams if not set(g.split(" ")) & set(chosen)]
        for w in words:
            if len(without) * (2000 - least) < len(grams) * least:
                break
            if any(w in g.split(" ") for g in without):
                chosen.append(w)
                without = [g for g in without if w not in g.split(" ")]
    return chosen


def sql_words(unit: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9.]+", " "))
    return F.filter(F.split(F.regexp_replace(plain, r"\.+(?= |$)", ""), " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


RUN = "minus:int,licence:string,first:int,last:int"


def sql_runs(words: Column, known: list[tuple[str, list[str]]], least: int) -> Column:
    """array<struct<RUN>> of the runs of words[first], ..., words[last] that reach the coefficient, best first, without overlaps.

    Growing a run by one of the template's bigrams never lowers the coefficient, and
    dropping another from its end never does, so runs go from the start of a stretch of
    the template's bigrams to the end of one.  A run of several stretches has at most
    twice the bigrams that a unit of distinct ones can have.
    """
    lists = [F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, own)).alias("own"), F.lit(-(-len(own) * least // (2000 - least))).alias("fewest"), F.lit(len(own) * (2000 - least) // least).alias("most")) for name, own in known]
    every = F.array(*map(F.lit, sorted({g for _, own in known for g in own})))

    def scored(g: Column, t: Column, first: Column, end: Column) -> Column:
        def dice(run: Column) -> Column:
            return F.floor(2000 * F.size(F.array_intersect(run, t["own"])) / (F.size(F.array_distinct(run)) + F.size(t["own"]))).cast("int")

        value = let(F.slice(g, first + 1, end - first + 1), dice)
        return F.struct((-value).alias("minus"), t["licence"].alias("licence"), first.alias("first"), (end + 1).alias("last"))

    def of_template(g: Column, t: Column) -> Column:
        def stretches(at: Column) -> Column:
            starts = F.filter(at, lambda p, k: F.coalesce(F.get(at, k - 1) != p - 1, F.lit(True)))
            ends = F.filter(at, lambda p, k: F.coalesce(F.get(at, k + 1) != p + 1, F.lit(True)))
            return let(ends, lambda e: F.flatten(F.transform(starts, lambda s, q: F.transform(F.filter(F.slice(e, q + 1, t["most"] + 1), lambda x: (x == F.get(e, q)) | (x - s < 2 * t["most"])), lambda x: scored(g, t, s, x)))))

        at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(t["own"], F.get(g, i)))
        return F.filter(let(at, stretches), lambda r: r["minus"] <= -least)

    def of_bigrams(g: Column) -> Column:
        able = let(F.array_intersect(g, every), lambda met: F.filter(F.array(*lists), lambda t: F.size(F.array_intersect(met, t["own"])) >= t["fewest"]))
        return F.array_sort(F.flatten(F.transform(able, lambda t: of_template(g, t))))

    none = F.array().cast(f"array<struct<{RUN}>>")
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
    runs = F.when(F.size(words) > 1, let(grams, of_bigrams)).otherwise(none)
    return F.aggregate(runs, none, lambda a, r: F.when(F.exists(a, lambda x: (r["first"] < x["last"]) & (x["first"] < r["last"])), a).otherwise(F.concat(a, F.array(r))))


def licence_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = DICE) -> DataFrame:
    """(doc_id, matches) with matches: array<struct<line, licence, dice>>, dice in thousandths.

    ``line`` counts from 0; a paragraph has the number of lines as an offset.  Runs of words
    come last, with the line of their first word: those that share no word with a line or
    paragraph of the same licence that is reported, and no bigram with a better run.  Of several
    templates the best counts, of equals the first licence by name.  Null and empty texts
    have no matches; ids may be null or repeated; texts of any length are read whole; other
    columns are not read.
    """
    known = [(name, bigrams(normal_words(text))) for name, text in (templates if templates is not None else TEMPLATES)]
    known = [(name, grams) for name, grams in known if grams]
    if not known:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array().cast("array<struct<line:int,licence:string,dice:int>>").alias("matches"))
    most = max(len(g) * (2000 - least) // least for _, g in known)
    fewest = min(-(-len(g) * least // (2000 - least)) for _, g in known)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a unit that reaches the coefficient has a bigram with one of these words
    needed = r"(?:" + "|".join(w.replace(".", r"\.") for w in anchors([g for _, g in known], least)) + ")"
    rows = rows.withColumn("text", F.when(F.lower("text").rlike(needed), F.col("text")).otherwise(""))
    lines = F.split("text", "\n", -1)
    paragraphs = F.when(F.contains(F.col("text"), F.lit("\n\n")) | F.col("text").rlike(r"\n[\x20\t]+\n"), F.split("text", r"\n[\x20\t]*+\n", -1)).otherwise(F.array("text"))
    units = F.concat(F.transform(lines, lambda u, i: F.struct(i.alias("line"), i.alias("place"), u.alias("unit"))), F.transform(F.filter(F.transform(paragraphs, lambda p, i: F.struct(i.alias("place"), p.alias("unit"))), lambda p: F.contains(p["unit"], F.lit("\n"))), lambda u, i: F.struct((i + F.size(lines)).alias("line"), (u["place"] + F.size(lines)).alias("place"), u["unit"].alias("unit"))))
    # short units are ruled out by their length before any word is looked at; a long one may repeat few bigrams
    units = F.filter(units, lambda u: F.length(u["unit"]) > 2 * fewest)
    words = F.transform(units, lambda u: F.struct(u["line"], u["place"], sql_words(u["unit"]).alias("words")))
    words = F.filter(words, lambda u: F.size(u["words"]) > fewest)
    grams = F.transform(words, lambda u: F.struct(u["line"], u["place"], F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(u["words"]) - 1), lambda i: F.concat(F.get(u["words"], i - 1), F.lit(" "), F.get(u["words"], i)))).alias("grams")))
    grams = F.filter(grams, lambda u: F.size(u["grams"]).between(fewest, most))

    def best(u: Column) -> Column:
        n = F.size(u["grams"])
        each = []
        for name, own in known:
            b = len(own)
            dice = F.expr("0") + F.floor(2000 * F.size(F.array_intersect(u["grams"], F.array(*map(F.lit, own)))) / (n + b)).cast("int")
            fits = (n * (2000 - least) >= b * least) & (n * least <= b * (2000 - least))
            each.append(F.struct(F.when(fits, -dice).otherwise(0).alias("minus"), F.lit(name).alias("licence")))
        return F.array_min(F.array(*each))

    scored = F.transform(grams, lambda u: F.struct(u["line"], u["place"], best(u).alias("best")))
    found = F.transform(F.filter(scored, lambda s: s["best"]["minus"] <= -least), lambda s: F.struct(s["line"], s["best"]["licence"].alias("licence"), (-s["best"]["minus"]).alias("dice"), s["place"]))

    def beside(found: Column, runs: Column) -> Column:
        """The runs that no reported line or paragraph of their licence shares a word with."""

        def places(of: Column) -> Column:
            return F.flatten(F.transform(of, lambda u, i: F.array_repeat(i, F.size(sql_words(u)))))

        def kept(line: Column, paragraph: Column) -> Column:
            def new(r: Column) -> Column:
                own = F.transform(F.filter(found, lambda m: m["licence"] == r["licence"]), lambda m: m["place"])
                inside = lambda of: F.slice(of, r["first"] + 1, r["last"] - r["first"] + 1)
                return ~(F.arrays_overlap(own, inside(line)) | F.arrays_overlap(own, F.transform(inside(paragraph), lambda x: x + F.size(lines))))

            return F.transform(F.array_sort(F.transform(F.filter(runs, new), lambda r: F.struct(r["first"], r["licence"], r["minus"]))), lambda r: F.struct(F.get(line, r["first"]).alias("line"), r["licence"].alias("licence"), (-r["minus"]).alias("dice")))

        return let(places(lines), lambda line: let(places(paragraphs), lambda paragraph: kept(line, paragraph)))

    plain = lambda f: F.transform(f, lambda m: F.struct(m["line"], m["licence"], m["dice"]))
    matches = let(found, lambda f: let(let(sql_words(F.col("text")), lambda w: sql_runs(w, known, least)), lambda r: F.when(F.size(r) > 0, F.concat(plain(f), beside(f, r))).otherwise(plain(f))))
    return rows.select("doc_id", matches.alias("matches"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licence_matches(read_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",")
    where = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["line"].cast("string"), m["licence"], m["dice"].cast("string"))), ",")
    return rows.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licences"), where.alias("matches"))
