"""Licence scan with DataFrame functions only: no shuffle, no Python on the executors.

A document's whole text, each of its paragraphs and each of its lines is a unit. A unit is normalised to lower-case
ASCII words, and its set of word bigrams is compared with each template's by the Dice coefficient,
2 |A and B| / (|A| + |B|). At a threshold t a template of n bigrams can only match units of n t / (2 - t) to
n (2 - t) / t bigrams: this bound prunes units before their bigrams are made, and templates before any comparison.
By the same bound a match shares all but a known number of the template's bigrams. So words are chosen that stand in
more of each template's bigrams than may be missing: a text or unit without any of these words has no match, and a
plain search for them spares it all other work.

A notice inside a longer line, or over several paragraphs, is a run: consecutive word bigrams of the text, whatever line
ends lie between them, first and last ones of the template, no more than the size bound and what the template repeats.
Runs are sought outside the units that have a licence; of overlapping runs the one with most bigrams of its template counts.

Defined results: a null or empty text has no licence; equal units of a text count once; on equal coefficients the
first template by name wins; repeated rows give repeated results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = Fraction(4, 5)

#: Licence texts and notices by name.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Words too common to tell a licence by.
COMMON = {"a", "and", "any", "by", "can", "for", "if", "in", "is", "it", "may", "not", "of", "or", "that", "the", "this", "to", "with", "you"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARAGRAPH = r"\n[ \t\r]*\n"
MARK = "\x01"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(n: int, threshold: Fraction = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a unit that can reach the threshold against n."""
    low = n * threshold / (2 - threshold)
    return -(-low.numerator // low.denominator), int(n * (2 - threshold) / threshold)


def anchor_words(templates: dict[str, str], threshold: Fraction = THRESHOLD) -> list[str]:
    """Words of which every match holds at least one: long words first, then those that serve most templates."""
    known = [bigrams(t) for t in templates.values()]
    open_to = [{"grams": set(g), "need": len(g) - size_bounds(len(g), threshold)[0] + 1} for g in known]
    chosen: list[str] = []
    while left := [t for t in open_to if t["need"] > 0]:
        gain: Counter = Counter()
        for t in left:
            own = Counter(w for g in t["grams"] for w in set(g.split()))
            gain.update({w: min(n, t["need"]) for w, n in own.items()})
        best = max(sorted(gain), key=lambda w: (w not in COMMON, len(w) >= 6, len(w) >= 4, gain[w], len(w)))
        chosen.append(best)
        for t in left:
            hit = {g for g in t["grams"] if best in g.split()}
            t["grams"] -= hit
            t["need"] -= len(hit)
    return sorted(chosen)


def license_matches(text: Column, low: Column, templates: dict[str, str] = TEMPLATES, threshold: Fraction = THRESHOLD) -> Column:
    """array<struct<unit, best: struct<dice, license>>> of each unit that has a licence; null if the text cannot hold any.

    `low` is the text in lower case.
    """
    known = [(name, bigrams(t), *size_bounds(len(bigrams(t)), threshold)) for name, t in sorted(templates.items())]
    least, most = min(k[2] for k in known), max(k[3] for k in known)
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, g)).alias("grams")) for name, g, low, high in known])
    need, anchors = float(threshold), anchor_words(templates, threshold)
    holds = lambda low: reduce(or_, [F.contains(low, F.lit(w)) for w in anchors])
    anchored = lambda u: F.exists(F.array(F.lower(u)), holds)  # noqa: E731  the array binds the lower-cased unit, so it is made once

    units = F.filter(F.array_distinct(F.concat(F.array(text), F.split(text, PARAGRAPH), F.split(text, "\n"))), anchored)
    words = F.transform(units, lambda u: F.struct(u.alias("unit"), F.split(F.trim(F.regexp_replace(F.translate(u, UPPER, LOWER), "[^a-z0-9]+", " ")), " ").alias("w")))
    words = F.filter(words, lambda x: F.size(x["w"]) > least)  # repeated bigrams only lower the count: no upper bound yet
    grams = F.transform(words, lambda x: F.struct(x["unit"].alias("unit"), F.array_distinct(pairs(x["w"])).alias("g")))
    grams = F.filter(grams, lambda x: F.size(x["g"]).between(least, most))

    def dice(g: Column) -> Column:
        open_to = F.filter(table, lambda t: F.size(g).between(t["low"], t["high"]))
        scored = F.transform(open_to, lambda t: F.struct((2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice"), t["name"].alias("license")))
        return F.filter(scored, lambda x: x["dice"] >= need)

    first = lambda found: F.reduce(found, F.element_at(found, 1), lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a))
    scored = F.filter(F.transform(grams, lambda x: F.struct(x["unit"].alias("unit"), dice(x["g"]).alias("all"))), lambda x: F.size(x["all"]) > 0)
    return F.when(holds(low), F.transform(scored, lambda x: F.struct(x["unit"].alias("unit"), first(x["all"]).alias("best"))))


def pairs(words: Column) -> Column:
    """The word bigrams of an array of words."""
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def words_outside(text: Column, units: Column) -> Column:
    """The words of a text, with a mark that is no word where a unit stood."""
    taken = F.transform(units, lambda x: x["unit"])
    clear = lambda u: F.when(F.array_contains(taken, u), F.lit(MARK)).otherwise(F.translate(u, UPPER + MARK, LOWER + " "))
    lines = lambda p: F.array_join(F.transform(F.split(p, "\n"), clear), "\n")
    rest = F.array_join(F.transform(F.split(text, PARAGRAPH), lambda p: F.when(F.array_contains(taken, p), F.lit(MARK)).otherwise(lines(p))), "\n")
    return F.when(~F.array_contains(taken, text), F.split(F.trim(F.regexp_replace(rest, f"[^a-z0-9{MARK}]+", " ")), " "))


def template_runs(name: str, text: str, grams: Column, hits: Column, threshold: Fraction) -> Column:
    """array<struct<less, dice, license, start, end>> of one template: the best run from each start that has one."""
    own = bigrams(text)
    n, need, (low, high) = len(own), float(threshold), size_bounds(len(own), threshold)
    span = high + len(re.findall("[a-z0-9]+", text.lower())) - 1 - n
    table = F.array(*map(F.lit, own))

    def best_from(p: Column, k: Column) -> Column:
        start = F.element_at(p, k)
        ends = F.filter(F.slice(p, k + low - 1, F.lit(span)), lambda e: e - start < span)
        sets = F.transform(ends, lambda e: F.struct(e.alias("end"), F.array_distinct(F.slice(grams, start + 1, e - start + 1)).alias("g")))
        shared = F.transform(sets, lambda x: F.struct(x["end"].alias("end"), F.size(x["g"]).alias("m"), F.size(F.array_intersect(x["g"], table)).alias("shared")))
        scored = F.transform(shared, lambda x: F.struct((2.0 * x["shared"] / (x["m"] + n)).alias("dice"), x["shared"].alias("shared"), (-x["end"]).alias("end")))
        best = F.array_max(F.filter(scored, lambda x: x["dice"] >= need))
        return F.transform(F.array(best), lambda b: F.struct((-b["shared"]).alias("less"), (-b["dice"]).alias("dice"), F.lit(name).alias("license"), start.alias("start"), (-b["end"]).alias("end")))[0]

    def from_hits(p: Column) -> Column:
        starts = F.when(F.size(p) >= low, F.sequence(F.lit(1), F.size(p) - low + 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda k: F.element_at(p, k + low - 1) - F.element_at(p, k) < span)
        return F.filter(F.transform(starts, lambda k: best_from(p, k)), lambda x: x["dice"].isNotNull())

    places = F.transform(F.filter(hits, lambda x: x["gram"].isin(own)), lambda x: x["at"])
    return F.flatten(F.transform(F.array(places), from_hits))


def license_runs(words: Column, grams: Column, hits: Column, templates: dict[str, str] = TEMPLATES, threshold: Fraction = THRESHOLD) -> Column:
    """array<struct<dice, license>> of the runs; hits are the (gram, at) of `grams` that any template has."""
    found = [template_runs(name, text, grams, hits, threshold) for name, text in sorted(templates.items())]
    ordered = F.array_sort(F.concat(*found))
    apart = lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] <= y["end"]) & (y["start"] <= x["end"])), acc).otherwise(F.concat(acc, F.array(x)))
    chosen = F.aggregate(ordered, F.filter(ordered, lambda x: F.lit(False)), apart)
    runs = F.transform(chosen, lambda x: F.struct((-x["dice"]).alias("dice"), x["license"].alias("license"), F.concat_ws(" ", F.slice(words, x["start"] + 1, x["end"] - x["start"] + 2)).alias("run")))
    return F.transform(F.array_distinct(runs), lambda x: F.struct(x["dice"].alias("dice"), x["license"].alias("license")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_units, licenses, best_license, best_dice): units and runs with a licence, the distinct licences, and the best."""
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.lower(text_col).alias("_low"))  # a column, so it is made once
    # each step is a column of its own, so it is made once; a text that cannot hold a licence is null from the first one on
    steps = texts.select(F.col(id_col), "_text", license_matches(F.col("_text"), F.col("_low")).alias("_units"))
    steps = steps.select(F.col(id_col), "_units", words_outside(F.col("_text"), F.col("_units")).alias("_words"))
    steps = steps.select(F.col(id_col), "_units", "_words", pairs(F.col("_words")).alias("_grams"))
    known = [(own, size_bounds(len(own))[0]) for own in map(bigrams, TEMPLATES.values())]
    every = sorted({g for own, _ in known for g in own})
    steps = steps.select(F.col(id_col), "_units", "_words", "_grams", F.array_intersect("_grams", F.array(*map(F.lit, every))).alias("_common"))
    opened = reduce(or_, [F.size(F.array_intersect("_common", F.array(*map(F.lit, own)))) >= low for own, low in known])  # the search by place is slow
    hits = F.filter(F.transform("_grams", lambda g, i: F.struct(g.alias("gram"), i.alias("at"))), lambda x: x["gram"].isin(every))
    steps = steps.select(F.col(id_col), "_units", "_words", "_grams", F.when(opened, hits).alias("_hits"))
    runs = F.when(F.col("_hits").isNotNull(), license_runs(F.col("_words"), F.col("_grams"), F.col("_hits")))
    in_units, none = F.transform("_units", lambda x: x["best"]), F.array().cast("array<struct<dice:double,license:string>>")
    found = steps.select(F.col(id_col), F.concat(F.coalesce(in_units, none), F.coalesce(runs, none)).alias("_found"))
    best = F.reduce("_found", F.element_at(F.col("_found"), 1), lambda a, x: F.when((x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["license"] < a["license"])), x).otherwise(a))
    some = F.size("_found") > 0
    digest = F.struct(
        F.size("_found").cast("long").alias("n_units"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["license"])))).alias("licenses"),
        F.when(some, best["license"]).alias("best_license"),
        F.when(some, F.round(best["dice"], 6)).alias("best_dice"),
    )
    # a generator of one row: a filter on the result would else be written out through all steps, and its plan explode
    return found.select(id_col, F.inline(F.array(digest)))


def oracle_sql(table: str = "documents") -> str:
    """The same scan as plain SQL, comparing every unit with every template without pruning."""
    values = ", ".join(f"('{name}', '{chr(31).join(bigrams(t))}')" for name, t in sorted(TEMPLATES.items()))
    return f"""
    with templates as (select name, string_split(grams, chr(31)) as tg from (values {values}) v(name, grams)),
    units as (
      select doc_id, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '{PARAGRAPH}'), string_split(text, chr(10))))) as unit from {table} where text is not null),
    words as (select doc_id, unit, string_split(trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') as w from units),
    grams as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from words where len(w) > 1),
    dice as (select doc_id, unit, name, 2.0::double * len(list_intersect(g, tg)) / (len(g) + len(tg)) as dice from grams, templates),
    matched as (select doc_id, unit, max(dice) as dice, arg_min(name, (-dice, name)) as name from dice where dice >= {float(THRESHOLD)}::double group by doc_id, unit),
    found as (
      select doc_id, count(*) as n_units, string_agg(distinct name, ',' order by name) as licenses, arg_min(name, (-dice, name)) as best_license, max(dice) as best_dice
      from matched group by doc_id)
    select d.doc_id, coalesce(n_units, 0)::bigint as n_units, coalesce(licenses, '') as licenses, best_license, round(best_dice, 6) as best_dice
    from {table} d left join found f on d.doc_id = f.doc_id"""
