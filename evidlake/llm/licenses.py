"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by folder.

A text is read as lower-case runs of ASCII letters and digits, in American spelling (SPELLINGS).
Wherever it holds an anchor of a template, the template is laid over it there, and the words beneath the
template are compared with it by TF-IDF cosine; so a notice is found at any place of a whole text, over
several lines and behind comment marks. A template's anchors are its words of CUES and its rarest words,
so many that words without any of them can't reach THRESHOLD: no single word has to be undamaged.
Matches of at least THRESHOLD count; of overlapping ones the best does. The inverse document frequencies
are those of the templates; words that no template has weigh most.

A notice that reserves all rights (RESERVED) counts after all that grant something, since many licences
hold that line too; alone it is the licence of its file, which then inherits none.

A licence file is one named like FILE_NAME with a match, or one whose whole text matches a template that
grants something. It
licenses its folder. Files without a notice of their own take the licence of the nearest folder above
them that has one: the distinct folders are joined with the licensed ones on each of their ancestors,
then files with folders. Nothing is broadcast by hint, no files are paired.

Edge cases: null and empty texts hold no notice but inherit; a null path neither inherits nor licenses
a folder; of several licence files in a folder the best match counts (RESERVED last), then the first name in order;
rows that repeat are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import memo, picked, settle

THRESHOLD = 0.8
FILE_NAME = r"(?i)^(licen[sc]e|copying|unlicense)([-._].*)?$"
WORD = re.compile(r"[a-z0-9]+")
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense"}
RESERVED = "LicenseRef-All-Rights-Reserved"

#: Public licence names and the notices by which they are known.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (RESERVED, "All rights reserved."),
)
CUES = ("license", "licensed", "copyright", "redistribution", "permission", "unencumbered", "reserved")
#: Words of the templates that any prose has: anchors only where others don't suffice.
COMMON = frozenset("a all an and any are as at author be by case charge code copy deal either except file files following for form free has in into is it later law may met mit nd no not of on or person possible published related sa same software source subject terms that the this to under use v version with without work you your 0 1 2 3 4".split())


def words_of(text: str) -> list[str]:
    return [SPELLINGS.get(w, w) for w in WORD.findall(text.lower())]


class Matcher:
    """Templates with their weights; find() gives the notices of a text."""

    def __init__(self, templates=TEMPLATES):
        names = dict.fromkeys(n for n, _ in templates if n != RESERVED)
        all_of = [*templates, *((n, f"SPDX-License-Identifier: {n}") for n in names)]
        self.templates = [(n, words_of(t)) for n, t in all_of]
        df = Counter(w for _, ws in self.templates for w in set(ws))
        n = len(self.templates)
        self.idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
        self.rare = math.log(1 + n) + 1
        self.vectors = [self._vector(ws) for _, ws in self.templates]
        self.at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, ws) in enumerate(self.templates):
            anchors = self.anchors(i)
            for j, w in enumerate(ws):
                if w in anchors:
                    self.at.setdefault(w, []).append((i, j))

    def anchors(self, i: int) -> set[str]:
        """Words of which any match has one: the cosine of others is at most the root of the weight they share."""
        t = self.vectors[i]
        out = {w for w in t if w in CUES}
        left = sum(x * x for w, x in t.items() if w not in out)
        for w in sorted(t.keys() - out, key=lambda w: (w in COMMON and 99 - len(w), -self.idf[w], -len(w), w)):
            if left < THRESHOLD**2 - 1e-9 and len(out) > 1:
                break
            out.add(w)
            left -= t[w] ** 2
        return out

    def _vector(self, words: list[str]) -> dict[str, float]:
        v = {w: c * self.idf.get(w, self.rare) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def cosine(self, words: list[str], i: int) -> float:
        v, t = self._vector(words), self.vectors[i]
        return min(1.0, sum(x * t[w] for w, x in v.items() if w in t)) if v else 0.0

    def find(self, text: str) -> list[tuple[str, float]]:
        """(name, cosine) of the notices in a text, best first and RESERVED last, in order of their places where equal."""
        words, found, seen = words_of(text), [], set()
        for p, w in enumerate(words):
            for i, j in self.at.get(w, ()):
                a, b = max(0, p - j), p - j + len(self.templates[i][1])
                if (i, a, b) not in seen:
                    seen.add((i, a, b))
                    if (c := self.cosine(words[a:b], i)) >= THRESHOLD:
                        found.append((self.templates[i][0] == RESERVED, -round(c, 9), i, a, min(b, len(words))))
        out, taken = [], []
        for last, c, i, a, b in sorted(found):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((last, c, a, self.templates[i][0]))
        return [(n, -c) for _, c, _, n in sorted(out)]

    def whole(self, text: str) -> float:
        """The best cosine of all words of a text to a template that grants something."""
        words = words_of(text)
        return max((self.cosine(words, i) for i, (n, _) in enumerate(self.templates) if n != RESERVED), default=0.0)


def _scan(text: pa.Array) -> pa.Array:
    m = memo("licenses", Matcher)
    names, scores, alls, wholes = [], [], [], []
    for t in text.to_pylist():
        found = m.find(t) if t else []
        names.append(found[0][0] if found else None)
        scores.append(found[0][1] if found else None)
        alls.append(list(dict.fromkeys(n for n, _ in found)))
        wholes.append(bool(found) and m.whole(t) >= THRESHOLD)
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(alls, pa.list_(pa.string())), pa.array(wholes, pa.bool_())], names=["name", "score", "all", "whole"])


def notices(text: Column) -> Column:
    """struct(name, score, all, whole) of whole texts; texts without an anchor never leave the JVM."""
    low, cue, anchors = F.lower(text), F.lit(False), set(Matcher().at)
    anchors |= {x for x, w in SPELLINGS.items() if w in anchors}
    brief = {x for x in anchors if len(x) < 5}  # most texts have these within other words
    for c in sorted(anchors - brief):
        cue = cue | F.contains(low, F.lit(c)) if not any(c != o and o in c for o in anchors - brief) else cue  # the shorter anchor finds it
    if brief:
        cue = cue | low.rlike(f"(?<![a-z0-9])(?:{'|'.join(sorted(brief))})(?![a-z0-9])")
    return F.arrow_udf(_scan, "struct<name:string,score:double,all:array<string>,whole:boolean>")(F.when(cue, text))


def scan(files: DataFrame, *, id_col="doc_id", path_col="path", text_col="text") -> DataFrame:
    """One row per file: id, path, license, score, origin (header, file, inherited, none), licenses, from_folder."""
    files, id_col, path_col, text_col = picked(files, id=id_col, path=path_col, text=text_col), "id", "path", "text"
    parts = F.filter(F.split(F.coalesce(F.col(path_col), F.lit("")), "/"), lambda x: (x != "") & (x != "."))
    folder = F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), folder.alias("folder"), F.element_at(F.when(F.size(parts) > 0, parts), -1).alias("base"), notices(F.col(text_col)).alias("n"))
    named = F.coalesce(F.col("base").rlike(FILE_NAME), F.lit(False))
    rows = rows.withColumn("is_file", F.col("n.name").isNotNull() & (named | F.col("n.whole")))
    rows = settle(rows.select("id", "path", "folder", "base", "is_file", "n.name", "n.score", "n.all"))

    best = F.min(F.struct((F.col("name") == RESERVED).alias("last"), (-F.col("score")).alias("s"), "base", "name"))
    licensed = rows.where("is_file and folder is not null").groupBy("folder").agg(best.alias("b")).select(F.col("folder").alias("above"), F.col("b.name").alias("given"), (-F.col("b.s")).alias("given_score"))
    steps = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))
    folders = rows.where("name is null and folder is not null").select("folder").distinct().select("folder", F.posexplode(above).alias("depth", "above"))
    nearest = folders.join(licensed, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "given", "given_score")).alias("g"))
    out = rows.join(settle(nearest), "folder", "left")  # settled, so that Spark can split a folder of very many files
    own = F.col("name").isNotNull()
    return out.select(
        "id", "path", F.coalesce("name", "g.given").alias("license"), F.when(own, F.col("score")).otherwise(F.col("g.given_score")).alias("score"),
        F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("g.given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.col("all").alias("licenses"), F.when(~own, F.col("g.above")).alias("from_folder"),
    )
