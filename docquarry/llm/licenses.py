"""License scans: base phrases plus ordered signature rules, as DataFrame and SQL expressions only.

A text is lower-cased (A-Z), cut into words of [a-z0-9] and non-ASCII characters, and rewritten so that each word
carries a space of its own on both sides (" w1  w2 "). A phrase or a rule is then a pattern over such cells;
neighbouring matches share no character, and a word's index is the number of spaces before it, halved.

Method. `rules()` gives the signature rules: wordings of license texts and file headers (`WORDINGS`), and names of licenses in the ways in which they
are cited. Each has a keyword, a regular expression, a label, a priority (0 is strongest) and a confidence. A text without any keyword is left
at once; on the others only rules whose keyword occurs are matched. A detection is suppressed if an interval of
the same or a stronger priority contains it; equal intervals keep the stronger, then the rule that comes first.
All of it happens inside the row: there is no shuffle, and one license or source may hold any share of the rows.

Defined results. Null is the empty text: no words, counts 0, first_word and last_word null, labels "" and score
0. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base phrases and labels of the contract.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License families. label stem: (names in words, versions as words; "" is no version).
FAMILIES: dict[str, tuple[list[str], list[str]]] = {
    "gpl": (["gnu general public license", "gnu gpl", "gpl"], ["1", "2", "3"]),
    "lgpl": (["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"], ["2", "2 1", "3"]),
    "agpl": (["gnu affero general public license", "affero general public license", "agpl"], ["1", "3"]),
    "gfdl": (["gnu free documentation license", "gfdl"], ["1 1", "1 2", "1 3"]),
    "apache": (["apache license", "apache software license"], ["1 0", "1 1", "2 0"]),
    "mpl": (["mozilla public license", "mpl"], ["1 0", "1 1", "2 0"]),
    "epl": (["eclipse public license", "epl"], ["1 0", "2 0"]),
    "cddl": (["common development and distribution license", "cddl"], ["1 0", "1 1"]),
    "cpl": (["common public license"], ["1 0"]),
    "eupl": (["european union public licence", "european union public license", "eupl"], ["1 1", "1 2"]),
    "artistic": (["artistic license", "perl artistic license"], ["1 0", "2 0"]),
    "afl": (["academic free license"], ["2 1", "3 0"]),
    "osl": (["open software license"], ["2 1", "3 0"]),
    "bsl": (["boost software license"], ["1 0"]),
    "odbl": (["open database license", "odbl"], ["1 0"]),
    "ofl": (["sil open font license", "open font license"], ["1 0", "1 1"]),
    "cc-by": (["creative commons attribution", "cc by"], ["1 0", "2 0", "3 0", "4 0"]),
    "cc-by-sa": (["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"], ["2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nd": (["creative commons attribution noderivatives", "cc by nd"], ["2 0", "3 0", "4 0"]),
    "cc-by-nc": (["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"], ["2 0", "3 0", "4 0"]),
    "cc-by-nc-sa": (["creative commons attribution noncommercial sharealike", "cc by nc sa"], ["2 0", "3 0", "4 0"]),
    "cc-by-nc-nd": (["creative commons attribution noncommercial noderivatives", "cc by nc nd"], ["2 0", "3 0", "4 0"]),
    "cc0": (["creative commons zero", "cc0"], ["1 0"]),
    "mit": (["mit license", "mit licence", "expat license"], [""]),
    "isc": (["isc license", "isc licence"], [""]),
    "bsd-2-clause": (["bsd 2 clause license", "simplified bsd license", "2 clause bsd license"], [""]),
    "bsd-3-clause": (["bsd 3 clause license", "new bsd license", "revised bsd license", "3 clause bsd license"], [""]),
    "bsd": (["bsd license", "bsd style license"], [""]),
    "zlib": (["zlib license", "zlib libpng license"], [""]),
    "unlicense": (["the unlicense"], [""]),
    "wtfpl": (["wtfpl"], [""]),
    "python": (["python software foundation license", "psf license"], ["2"]),
    "postgresql": (["postgresql license"], [""]),
    "php": (["php license"], ["3 0", "3 01"]),
    "public-domain": (["public domain"], [""]),
    "all-rights-reserved": (["all rights reserved"], [""]),
}

# Words that open a license grant.
GRANTS = ["licensed", "released", "distributed", "published", "available", "provided", "redistributable", "relicensed", "offered"]


# What license texts, file headers and disclaimers say. label, words, priority, confidence; "..." stands for up to MOST_BETWEEN other words, "[x]" for words that may be left out.
WORDINGS: list[tuple[str, str, int, float]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("mit", "permission is hereby granted free of charge", 2, 0.8),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", 1, 0.9),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0, 0.98),
    ("isc", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted", 1, 0.95),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", 1, 0.85),
    ("bsd", "redistribution and use in source and binary forms", 2, 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 1, 0.9),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice", 2, 0.8),
    ("bsd-3-clause", "neither the name ... may be used to endorse or promote products", 1, 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", 1, 0.95),
    ("apache-2.0", "you may not use this file except in compliance with the license", 1, 0.9),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1, 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0, 0.98),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 0, 0.98),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 0, 0.98),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 0, 0.98),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1, 0.95),
    ("cc0", "to the extent possible under law ... has waived all copyright", 1, 0.95),
    ("zlib", "altered source versions must be plainly marked as such", 1, 0.95),
    ("wtfpl", "do what the fuck you want to", 1, 0.95),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 1, 0.95),
    ("python", "psf hereby grants licensee a nonexclusive royalty free world wide license", 1, 0.95),
    ("openssl", "this product includes software developed by the openssl project", 1, 0.95),
    ("gpl", "this program is free software you can redistribute it and or modify it", 2, 0.8),
    ("lgpl", "this library is free software you can redistribute it and or modify it", 2, 0.8),
    ("gfdl", "permission is granted to copy distribute and or modify this document", 1, 0.9),
    ("cc", "you are free to share copy and redistribute the material in any medium or format", 2, 0.7),
    ("proprietary", "unauthorized copying of this file ... is strictly prohibited", 1, 0.9),
    ("proprietary", "confidential and proprietary", 3, 0.6),
    ("warranty-disclaimer", "provided as is without [any] warranty", 3, 0.6),
    ("warranty-disclaimer", "provided as is without [any] express or implied warranty", 3, 0.6),
    ("warranty-disclaimer", "as is without warranty of any kind express or implied", 3, 0.6),
    ("warranty-disclaimer", "without any warranty without even the implied warranty of merchantability", 3, 0.6),
    ("warranty-disclaimer", "provided by the copyright holders and contributors as is", 3, 0.6),
    ("warranty-disclaimer", "there is no warranty for the program to the extent permitted by applicable law", 3, 0.6),
]
MOST_BETWEEN = 20
#: Licenses of one family that are granted in a version alone, or in that and all later ones.
GRADED = {"gpl": "general", "lgpl": "lesser general", "agpl": "affero general"}
GRADES = {"gpl": ["1", "2", "3"], "lgpl": ["2", "2 1", "3"], "agpl": ["3"]}
# End of the fixed values.


def _wording(words: str) -> tuple[str, str]:
    """Keyword and pattern of a wording: the keyword is its longest run of words that must be there and that the gate knows."""
    parts = re.split(r" ?(\.\.\.|\[[^\]]*\]) ?", words)
    pattern = "".join(f"(?: [^ ]+ ){{1,{MOST_BETWEEN}}}" if p == "..." else _optional(p[1:-1]) if p.startswith("[") else _cells(p) for p in parts)
    return max((_cells(p) for p in parts[::2] if re.search(GATE, _cells(p))), key=len), pattern


def _grades() -> list[tuple[str, str, str, int, float]]:
    """Rules of "or later" and "only": as identifiers, beside a name, and in the header of a file."""
    out = []
    for stem, kind in GRADED.items():
        for version in GRADES[stem]:
            label, n = f"{stem}-{version.replace(' ', '.')}", _cells(version) + ("" if " " in version else "(?: 0 )?")
            for grade in ("or later", "only"):
                own = f"{label}-{grade.replace(' ', '-')}"
                out.append((own, _cells(stem), _optional("spdx license identifier") + _cells(stem) + f"(?: (?:version|v|ver) )?{n}" + _cells(grade), 0, 0.97))
                out.append((own, _cells(f"{kind} public license"), _optional("gnu") + _cells(f"{kind} public license") + f"(?: (?:version|v|ver) )?{n}" + _cells(grade), 0, 0.97))
            later = _cells("either version") + _cells(version) + _cells("of the license or") + _optional("at your option") + _cells("any later")
            out.append((f"{label}-or-later", _cells("any later"), _optional("gnu") + _cells(f"{kind} public license") + f"(?: [^ ]+ ){{1,{MOST_BETWEEN}}}" + later, 0, 0.98))
    return out


def _cells(words: str) -> str:
    """Pattern of consecutive words, each with its own spaces."""
    return "".join(f" {w} " for w in words.split())


def _optional(words: str) -> str:
    return f"(?:{_cells(words)})?"


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(rule, label, keyword in cells, pattern, priority, confidence), strongest first."""
    out = [(label, *_wording(words), priority, confidence) for label, words, priority, confidence in WORDINGS] + _grades()
    grant = f" (?:{'|'.join(GRANTS)}) " + " (?:under|with) " + _optional("the") + _optional("terms of") + _optional("the")
    for stem, (names, versions) in FAMILIES.items():
        for version in versions:
            label = "-".join([stem, version.replace(" ", ".")]) if version else stem
            for name in names:
                key = _cells(name)
                v = (_optional("license") + "(?: (?:version|v|ver) )?" + _cells(version)) if version else ""
                if version:
                    joined = f"{_optional('license')} v{version.split()[0]} {_cells(' '.join(version.split()[1:]))}"
                    out.append((label, key, key + joined, 2, 0.85))
                out.append((label, key, grant + key + v, 1, 0.95))
                if version:
                    out.append((label, key, key + v, 2, 0.85))
            spdx = f"{stem.replace('-', ' ')} {version}".strip()
            out.append((label, _cells("spdx license identifier"), _cells(f"spdx license identifier {spdx}"), 0, 0.99))
        for name in names:
            out.append((stem, _cells(name), grant + _cells(name), 3, 0.75))
            out.append((stem, _cells(name), _cells(name), 4, 0.5))
    out.sort(key=lambda r: r[3])
    return [(i, *r) for i, r in enumerate(out)]


PRIORITIES = 5
#: One cheap pattern that every text with a rule's keyword matches.
GATE = (
    r" (?:licen[sc]ed?|unlicense|gpl|lgpl|agpl|gfdl|mpl|epl|cddl|eupl|odbl|cc|cc0|creative|wtfpl|domain|reserved|permission|redistributions?|endorse|advertising|unencumbered|waived|altered|fuck|intent|licensee|openssl"
    r"|redistribute|prohibited|unauthorized|proprietary|warranty|contributors|later) "
)


def normalised(text: Column) -> Column:
    """The text as cells. The Kelvin sign is the one character outside ASCII that lower() turns into an ASCII letter alone."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _detections(norm: Column) -> Column:
    """Array of (start, end, priority, rule, label, confidence) of all rules whose keyword occurs."""
    table_ = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(pattern).alias("pattern"), F.lit(p).alias("priority"), F.lit(c).alias("confidence")) for i, label, key, pattern, p, c in rules()])

    def matches(rule: Column) -> Column:
        found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
        before = F.split(norm, rule["pattern"])
        none = F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string,confidence:double>>")

        def step(acc: Column, x: Column) -> Column:
            start = acc["pos"] + F.char_length(x["before"])
            end = start + F.char_length(x["match"])
            one = F.struct(start.alias("start"), end.alias("end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))
            return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

        pairs = F.zip_with(F.slice(before, 1, F.greatest(F.size(found), F.lit(0))), found, lambda b, m: F.struct(b.alias("before"), m.alias("match")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.filter(table_, lambda r: F.contains(norm, r["key"])), matches))


def _kept(found: Column) -> Column:
    """Labels and best confidence of the detections that no interval of the same or a stronger priority contains.

    Sorted by start, longest first, then priority, a container comes before what it contains; so one pass with
    the furthest end seen for each priority decides.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("minus_end"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"), d["confidence"].alias("confidence"))))
    zero = F.struct(F.array_repeat(F.lit(-1), PRIORITIES).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        end = -d["minus_end"]
        hidden = F.array_max(F.slice(acc["ends"], F.lit(1), d["priority"] + 1)) >= end
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == d["priority"], F.greatest(e, end)).otherwise(e))
        return F.when(hidden, acc).otherwise(F.struct(ends.alias("ends"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.greatest(acc["score"], d["confidence"]).alias("score")))

    return F.aggregate(ordered, zero, step)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row with base places, labels and score; see the module's docstring."""
    df = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("_norm"))
    parts = df.withColumn("_hits", F.when(F.col("_norm").rlike(GATE), _detections(F.col("_norm"))))
    parts = parts.withColumn("_method", F.when(F.size("_hits") > 0, _kept(F.col("_hits"))))
    count, first, last = {}, {}, {}
    for phrase in BASE:
        cells = _cells(phrase)
        count[phrase] = ((F.char_length("_norm") - F.char_length(F.replace(F.col("_norm"), F.lit(cells), F.lit("")))) / len(cells)).cast("long")
        found = F.contains("_norm", F.lit(cells))
        first[phrase] = F.when(found, _spaces(F.substring_index("_norm", cells, 1)) / 2).cast("long")
        after = F.substring_index("_norm", cells, -1)
        last[phrase] = F.when(found, (_spaces(F.col("_norm")) - _spaces(after)) / 2 - len(phrase.split())).cast("long")
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.contains("_norm", F.lit(_cells(p))), F.lit(label)) for p, label in BASE.items()])))
    return parts.select(
        "doc_id",
        (_spaces(F.col("_norm")) / 2).cast("long").alias("n_words"),
        sum(count.values(), F.lit(0)).cast("long").alias("n_base"),
        F.least(*first.values()).alias("first_word"),
        F.greatest(*last.values()).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce(F.col("_method.labels"), F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce(F.col("_method.score"), F.lit(0.0)).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ",\n".join(f"({i}, '{label}', '{key}', '{pattern}', {p}, {c}::DOUBLE)" for i, label, key, pattern, p, c in rules())
    base = ", ".join(f"('{_cells(p)}', '{label}', {len(p.split())})" for p, label in BASE.items())
    return rf"""
WITH rules(rule, label, key, pattern, priority, confidence) AS (VALUES {values}),
base(cells, label, n) AS (VALUES {base}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT doc_id, ws, array_to_string(list_transform(ws, lambda x: ' ' || x || ' '), '') AS norm FROM w),
b AS (SELECT doc_id, base.label, base.n, base.cells, unnest(range(1, len(ws) + 1)) AS i, ws FROM n JOIN base ON contains(norm, base.cells)),
bp AS (SELECT doc_id, label, i - 1 AS pos FROM b WHERE array_to_string(list_transform(ws[i:i + n - 1], lambda x: ' ' || x || ' '), '') = cells),
bs AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM bp GROUP BY doc_id),
h AS (SELECT doc_id, rules.*, regexp_extract_all(norm, pattern) AS ms, string_split_regex(norm, pattern) AS ps FROM n JOIN rules ON contains(norm, key)),
u AS (SELECT doc_id, rule, label, priority, confidence, unnest(range(1, len(ms) + 1)) AS k, ms, ps FROM h),
d AS (SELECT doc_id, rule, label, priority, confidence,
             list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS s, length(ms[k]) AS l FROM u),
k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.s <= d.s AND e.s + e.l >= d.s + d.l AND e.priority <= d.priority
        AND (e.l > d.l OR e.priority < d.priority OR e.rule < d.rule))),
al AS (SELECT doc_id, label FROM k UNION SELECT doc_id, label FROM bp),
ls AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM al GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM bp) GROUP BY doc_id),
sc AS (SELECT doc_id, max(confidence) AS score FROM k GROUP BY doc_id)
SELECT n.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM n LEFT JOIN bs USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN sc USING (doc_id)"""


SQL = _sql()
