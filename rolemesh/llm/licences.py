"""Licence scan: sparse TF-IDF cosine with licence templates, inherited along directories.

A file is read as one sequence of terms, so that line ends and sentences around a notice do
not matter. Wherever a telling term of a template stands, the window of as many terms as the
template has, laid so that this term falls on its place in the template, is compared with
the template. A file takes the licence of its best window; a file without one takes that of
the nearest directory above it which holds a licence file.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

THRESHOLD = 0.7
LICENCE_FILE = "^(LICEN[CS]E|COPYING|NOTICE)([.].*)?$"

# The notices that licences ask to be put into files, and the heads of their full texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction",
    ),
    ("MPL-2.0", "of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Proprietary", "All rights reserved."),
]

# English words that many texts hold.
COMMON = {
    "a", "all", "and", "any", "are", "by", "charge", "code", "copy", "deal", "files", "for", "form", "forms", "free", "from", "in",
    "is", "of", "or", "person", "public", "source", "subject", "terms", "the", "this", "to", "under", "use", "v", "version", "with",
    "without", "work",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


SHORT_NUMBER = "^[0-9]{1,2}$"


def _plain(term: str) -> bool:
    return term in COMMON or re.match(SHORT_NUMBER, term) is not None


class Templates:
    """Weights of the templates' terms, and the terms without which no window can reach the threshold."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        self.terms = [re.findall("[a-z0-9]+", text.lower()) for _, text in templates]
        n = len(templates)
        df = Counter(t for own in self.terms for t in set(own))
        # Common words and short numbers tell little: they weigh as if every template had them.
        self.idf = {t: 1.0 if _plain(t) else math.log((1 + n) / (1 + k)) + 1 for t, k in sorted(df.items())}
        self.rare = math.log(1 + n) + 1  # of any other word that is not in the template
        self.weights, self.places = [], []
        for own in self.terms:
            raw = {t: k * self.idf[t] for t, k in Counter(own).items()}
            length = math.sqrt(sum(w * w for w in raw.values()))
            weights = {t: w / length for t, w in sorted(raw.items())}
            # By Cauchy-Schwarz a window has at most the length of the part it can meet. Any
            # order is safe; words that many texts hold come last.
            left, anchors = 1.0, set()
            for t, w in sorted(weights.items(), key=lambda x: (_plain(x[0]), -x[1], x[0])):
                if math.sqrt(max(left, 0.0)) < threshold:
                    break
                anchors.add(t)
                left -= w * w
            self.weights.append(weights)
            # Where each telling term stands in the template.
            self.places.append([(t, i) for i, t in enumerate(own) if t in anchors])
        self.anchors = sorted({t for places in self.places for t, _ in places})

    def gate(self, text: Column) -> Column:
        """False only for texts in which no window can reach the threshold: none of the telling terms is in it."""
        any_of = lambda low: reduce(or_, (F.contains(low, F.lit(t)) for t in self.anchors), F.lit(False))
        return F.get(F.transform(F.array(F.translate(text, _UPPER, _LOWER)), any_of), 0)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), lambda t: t != "")


def best_windows(texts: DataFrame, templates: Templates) -> DataFrame:
    """(h, licence, score, position) of the best window of each text that reaches the threshold.

    ``texts`` has h and text. Every window of the whole text that can reach the threshold is
    compared; ties go to the first template, then the first position (a term's number). All
    steps are array expressions in a text's own row: nothing is shuffled but the few rows found.
    """
    # Generators stand between the steps: Spark would otherwise compute a step again for each
    # element of the next.
    once = lambda value, name: F.explode(F.array(value)).alias(name)
    words = texts.where(templates.gate(F.col("text"))).select("h", once(tokens(F.col("text")), "words"))
    hit = lambda w, i: F.when(w.isin(templates.anchors), F.struct(w.alias("term"), i.alias("at")))
    hits = words.select("h", "words", once(F.array_compact(F.transform("words", hit)), "hits"))

    def starts(number: int) -> Column:
        found = []
        for term, place in templates.places[number]:
            at = F.filter("hits", lambda x: x["term"] == term)
            found.append(F.transform(at, lambda x: F.greatest(x["at"] - place, F.lit(0))))
        return F.transform(F.array_distinct(F.concat(*found)), lambda s: F.struct(F.lit(number).alias("template"), s.alias("start")))

    used = [i for i, p in enumerate(templates.places) if p]
    if not used:
        return hits.select("h", F.lit("").alias("licence"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("position")).limit(0)
    sizes = F.array(*(F.lit(len(t)) for t in templates.terms))
    windows = hits.select("h", "words", F.explode(F.concat(*map(starts, used))).alias("w")).select(
        "h", "w.*", F.slice("words", F.col("w.start") + 1, F.get(sizes, F.col("w.template"))).alias("terms")
    )
    windows = windows.select("h", "template", "start", "terms", once(F.array_distinct("terms"), "distinct"))
    table = [[{"term": t, "idf": templates.idf[t], "w": w} for t, w in own.items()] for own in templates.weights]
    table = F.from_json(F.lit(json.dumps(table)), "array<array<struct<term:string,idf:double,w:double>>>")
    windows = windows.select("h", "template", "start", "terms", "distinct", once(F.get(table, F.col("template")), "own"))
    elsewhere = lambda t: F.when(t.isin(sorted(COMMON)) | t.rlike(SHORT_NUMBER), 1.0).otherwise(templates.rare)

    def weighed(t: Column) -> Column:
        n = F.size(F.filter("terms", lambda x: x == t))
        entry = F.filter("own", lambda e: e["term"] == t)
        own = lambda e: F.struct((n * e["idf"]).alias("w"), e["w"].alias("own"))
        return F.coalesce(
            F.get(F.transform(entry, own), 0), F.struct((n * elsewhere(t)).alias("w"), F.lit(0.0).alias("own"))
        )

    pairs = F.transform("distinct", weighed)
    scored = windows.select("h", "template", "start", once(pairs, "p"))
    total = lambda value: F.aggregate("p", F.lit(0.0), lambda s, x: s + value(x))
    cosine = total(lambda x: x["w"] * x["own"]) / F.sqrt(total(lambda x: x["w"] * x["w"]))
    best = (
        scored.withColumn("score", F.round(cosine, 6))
        .where(F.col("score") >= templates.threshold)
        .groupBy("h")
        .agg(F.max(F.struct("score", (-F.col("template")).alias("order"), (-F.col("start")).alias("up"))).alias("best"))
    )
    names = F.array(*(F.lit(n) for n in templates.names))
    return best.select(
        "h", F.get(names, -F.col("best.order")).alias("licence"), "best.score", (-F.col("best.up")).cast("long").alias("position")
    )


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


_OWN = ("licence", "score", "position", "basis", "licence_path")


def scan_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``files`` (path, text, ...) with licence, score, position, basis and licence_path.

    basis is ``own`` (a window of the file), ``inherited`` (the licence file licence_path in
    the nearest directory above, its own included) or ``none``. Of several licence files in
    a directory the highest score counts, then the first path. Null and empty texts have no
    licence of their own, null paths inherit nothing; repeated rows each get their row, and
    very long texts are read whole. Other columns of ``files`` are kept but for those that
    the result's own columns replace. Only paths and text hashes are joined, directories as
    their distinct set, so a directory with very many files counts once.
    """
    # Two hashes name a text: one alone would give a few of 10^10 texts another's licence.
    h = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    # A row for each text with a licence; read three times below.
    found = stored(best_windows(files.select(h.alias("h"), "text"), Templates(templates, threshold)), "licences")
    kept = F.struct(*(F.col(f"`{c}`") for c in files.columns if c not in ("text", *_OWN))).alias("kept")
    own = files.select(kept, F.col("path").alias("own_path"), h.alias("h")).join(found, "h", "left").drop("h")
    name = F.regexp_extract("own_path", "([^/]*)$", 1)
    held = (
        own.where(F.col("licence").isNotNull() & name.rlike(LICENCE_FILE))
        .select(directory_of(F.col("own_path")).alias("top"), "licence", "score", "own_path")
        .groupBy("top")
        .agg(F.min(F.struct((-F.col("score")).alias("order"), "own_path", "licence")).alias("from"))
    )
    places = own.where("licence is null and own_path is not null").select(directory_of(F.col("own_path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = F.concat(
        F.array(F.lit("")),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
    )
    nearest = (
        places.select("directory", F.explode(F.array_distinct(above)).alias("top"))
        .join(held, "top")
        .groupBy("directory")
        .agg(F.max_by(F.col("from"), F.length("top")).alias("from"))
    )
    joined = own.withColumn("directory", F.when(F.col("licence").isNull(), directory_of(F.col("own_path")))).join(nearest, "directory", "left")
    return joined.select(
        "kept.*",
        F.coalesce("licence", "from.licence").alias("licence"),
        "score",
        "position",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(F.col("licence").isNull(), F.col("from.own_path")).alias("licence_path"),
    )
