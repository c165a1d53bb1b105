"""License scans by ordered signature rules.

A text becomes its words, lower-cased A-Z, each between two blanks of its own.  A rule is a regular
expression over that line, a label, a rank and a keyword; it runs only on texts that hold its keyword
as a word.  A detection is dropped when its words lie within those of a detection of the same or a
stronger rank: full names with a version outrank names, names outrank hints; of equal intervals
of one rank the earlier label stays.  All of it is DataFrame expressions over the row; no shuffle.

Base phrases are found and counted in any case, and always keep their labels.

Defined cases: null counts as empty; a text without words has no detections and null places; repeated rows
give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is no part of a word, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
BASE: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: One word of each base phrase.
BASE_KEYWORDS = {"cc", "general", "reserved"}

#: Weight of a kept detection by rank.
WEIGHTS = {1: 1.0, 2: 0.75, 3: 0.25}


@dataclass(frozen=True)
class Rule:
    label: str
    rank: int
    keyword: str
    pattern: str


def _line(phrase: str) -> str:
    """A phrase as a pattern over the line: words between their blanks.

    ``a|b`` is a choice, ``word?`` may be absent, ``#`` stands for any number, other words for themselves.
    """
    parts = []
    for word in phrase.split():
        optional = word.endswith("?")
        choice = "|".join(f" {w} ".replace("#", "[0-9]+") for w in word.rstrip("?").split("|"))
        parts.append(f"(?:{choice})?" if optional else f"(?:{choice})")
    return "".join(parts)


def _versioned(label: str, keyword: str, name: str, versions: tuple[str, ...], rank: int = 1) -> list[Rule]:
    """The name with each version, as words with or without the word version or v."""
    rules = []
    for version in versions:
        numbers = version.split(".")
        digits = " ".join(numbers) if numbers[-1] != "0" else " ".join([*numbers[:-1], "0?"])
        attached = f"v{numbers[0]}"
        tail = " ".join(digits.split()[1:])
        for stated in (f"version|v? {digits}", f"{attached} {tail}".strip()):
            rules.append(Rule(f"{label}-{version}", rank, keyword, _line(f"{name} {stated}")))
    return rules


def rules() -> list[Rule]:
    """All rules, strongest rank first.

    Families with versions and Creative Commons licenses are built from their parts.
    """
    found: list[Rule] = []
    gnu = {"": "gpl", "lesser|library": "lgpl", "affero": "agpl"}
    for kind, label in gnu.items():
        name = f"gnu? {kind} general public license|licence".replace("  ", " ")
        versions = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0")}[label]
        found += _versioned(label, "general", name, versions)
        found += _versioned(label, label, f"gnu? {label} license|licence?", versions)
        for version in versions:
            major = version.split(".")[0]
            found.append(Rule(f"{label}-{version}-or-later", 1, "later", _line(f"{name} version|v? {major} # or any? later version?").replace(" [0-9]+ ", "(?: [0-9]+ )?", 1)))
            found.append(Rule(f"{label}-{version}", 1, f"{label}v{major}", _line(f"{label}v{major}")))
            found.append(Rule(f"{label}-{version}", 1, f"{label}{major}", _line(f"{label}{major}")))
        found.append(Rule(label, 2, "general", _line(name)))
        found.append(Rule(label, 2, label, _line(f"gnu? {label}")))
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        label = "cc-" + parts.replace(" ", "-")
        long = " ".join({"by": "attribution", "sa": "share alike?", "nc": "non? commercial|noncommercial", "nd": "no? derivatives|noderivatives|noderivs"}[p] for p in parts.split())
        long = long.replace("share alike?", "sharealike|share alike?")
        versions = ("1.0", "2.0", "2.5", "3.0", "4.0")
        found += _versioned(label, "cc", f"cc {parts}", versions)
        found += _versioned(label, "creative", f"creative commons {long} international|unported|generic? license|licence?", versions)
        found += _versioned(label, "creative", f"creative commons {long} license|licence?", versions)
        found.append(Rule(label, 2, "cc", _line(f"cc {parts}")))
        found.append(Rule(label, 2, "creative", _line(f"creative commons {long} license|licence?")))
    found += _versioned("apache", "apache", "apache software? license|licence", ("1.0", "1.1", "2.0"))
    found += _versioned("apache", "apache", "apache", ("1.0", "1.1", "2.0"))
    found += _versioned("mpl", "mozilla", "mozilla public license|licence", ("1.0", "1.1", "2.0"))
    found += _versioned("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0"))
    found += _versioned("epl", "eclipse", "eclipse public license|licence", ("1.0", "2.0"))
    found += _versioned("epl", "epl", "epl", ("1.0", "2.0"))
    found += _versioned("cddl", "cddl", "cddl", ("1.0", "1.1"))
    found += _versioned("cddl", "distribution", "common development and distribution license|licence", ("1.0", "1.1"))
    found += _versioned("eupl", "eupl", "eupl", ("1.0", "1.1", "1.2"))
    found += _versioned("eupl", "european", "european union public licence|license", ("1.0", "1.1", "1.2"))
    found += _versioned("artistic", "artistic", "artistic license|licence", ("1.0", "2.0"))
    found += _versioned("bsl", "boost", "boost software license|licence", ("1.0",))
    found += _versioned("osl", "osl", "osl", ("1.0", "2.0", "2.1", "3.0"))
    found += _versioned("osl", "open", "open software license|licence", ("1.0", "2.0", "2.1", "3.0"))
    found += _versioned("afl", "academic", "academic free license|licence", ("1.1", "2.0", "3.0"))
    found += _versioned("ofl", "font", "sil? open font license|licence", ("1.0", "1.1"))
    found += _versioned("odc-by", "attribution", "open data commons attribution license|licence", ("1.0",))
    found += _versioned("odbl", "database", "open database license|licence", ("1.0",))
    found += _versioned("gfdl", "documentation", "gnu? free documentation license|licence", ("1.1", "1.2", "1.3"))
    found += _versioned("openssl", "openssl", "openssl license|licence", ("1.0",))
    found += _versioned("python", "python", "python software foundation license|licence", ("2.0",))
    found += _versioned("php", "php", "php license|licence", ("3.0", "3.01"))
    found += _versioned("zpl", "zope", "zope public license|licence", ("2.0", "2.1"))
    found += _versioned("ms-pl", "microsoft", "microsoft public license|licence", ("1.0",))
    for label, keyword, phrases in (
        ("mit", "mit", ("mit license|licence", "mit x11 license|licence?", "licensed under mit", "mit licensed")),
        ("mit", "deal", ("permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction")),
        ("expat", "expat", ("expat license|licence",)),
        ("isc", "isc", ("isc license|licence",)),
        ("isc", "hereby", ("permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted",)),
        ("bsd-2-clause", "bsd", ("bsd 2|two clause license|licence?", "simplified bsd license|licence?", "2|two clause bsd license|licence?", "freebsd license|licence")),
        ("bsd-3-clause", "bsd", ("bsd 3|three clause license|licence?", "new|revised|modified bsd license|licence?", "3|three clause bsd license|licence?")),
        ("bsd-4-clause", "bsd", ("bsd 4|four clause license|licence?", "original bsd license|licence?")),
        ("0bsd", "0bsd", ("0bsd",)),
        ("bsd", "redistribution", ("redistribution and use in source and binary forms with or without modification are permitted",)),
        ("zlib", "zlib", ("zlib license|licence", "zlib libpng license|licence?")),
        ("unlicense", "unlicense", ("the? unlicense",)),
        ("unlicense", "unencumbered", ("this is free and unencumbered software released into the public domain",)),
        ("wtfpl", "wtfpl", ("wtfpl",)),
        ("cc0-1.0", "cc0", ("cc0 1 0 universal?", "cc0 1? 0?")),
        ("cc0-1.0", "creative", ("creative commons zero 1? 0? universal?", "creative commons cc0 1? 0? universal?")),
        ("gpl", "free", ("free software foundation either version # of the license",)),
        ("apache-2.0", "www", ("www apache org licenses license 2 0",)),
        ("gpl", "www", ("www gnu org licenses",)),
        ("public-domain", "domain", ("released|dedicated|placed into|to|in the public domain",)),
    ):
        found += [Rule(label, 1, keyword, _line(phrase)) for phrase in phrases]
    for label, keyword, phrases in (
        ("apache", "apache", ("apache license|licence", "apache software license|licence", "apache licensed")),
        ("mpl", "mozilla", ("mozilla public license|licence",)),
        ("epl", "eclipse", ("eclipse public license|licence",)),
        ("cddl", "cddl", ("cddl",)),
        ("eupl", "eupl", ("eupl",)),
        ("artistic", "artistic", ("artistic license|licence",)),
        ("bsl", "boost", ("boost software license|licence",)),
        ("bsd", "bsd", ("bsd license|licence", "bsd style license|licence", "bsd licensed")),
        ("ofl", "font", ("open font license|licence",)),
        ("odbl", "database", ("open database license|licence",)),
        ("gfdl", "documentation", ("free documentation license|licence",)),
        ("python", "psf", ("psf license|licence",)),
        ("public-domain", "domain", ("public domain",)),
        ("cc", "creative", ("creative commons license|licence?",)),
        ("proprietary", "proprietary", ("proprietary and? confidential", "proprietary license|licence|software")),
        ("proprietary", "prohibited", ("reproduction|redistribution|copying is strictly? prohibited", "unauthorized copying of this file via any medium is strictly prohibited")),
        ("copyright", "copyright", ("copyright c? # #? all rights reserved", "copyright c? #")),
        ("copyright", "reserved", ("some rights reserved", "no rights reserved")),
        ("spdx", "spdx", ("spdx license identifier",)),
    ):
        found += [Rule(label, 2, keyword, _line(phrase)) for phrase in phrases]
    for label, keyword, phrases in (
        ("licensed", "licensed", ("licensed under", "is licensed", "licensed to")),
        ("licensed", "license", ("under the terms of the license", "see the license", "released under the", "license file", "license agreement", "open source license")),
        ("licensed", "licence", ("under the terms of the licence", "see the licence", "licence agreement")),
        ("warranty", "warranty", ("without warranty of any kind", "without any warranty", "as is without warranty")),
        ("warranty", "liability", ("limitation of liability", "in no event shall")),
        ("copyright", "copyright", ("copyright notice", "copyright holder|holders", "the copyright")),
        ("copyleft", "copyleft", ("copyleft",)),
        ("eula", "eula", ("eula",)),
        ("trademark", "trademark", ("registered? trademark|trademarks of",)),
        ("patent", "patent", ("patent license|licence|grant", "patent pending")),
    ):
        found += [Rule(label, 3, keyword, _line(phrase)) for phrase in phrases]
    found += [Rule(label, 2, phrase.split()[0] if phrase != "all rights reserved" else "reserved", _line(phrase)) for phrase, label in BASE.items()]
    unique = {(r.label, r.rank, r.keyword, r.pattern): r for r in found}
    return sorted(unique.values(), key=lambda r: (r.rank, r.label, r.keyword, r.pattern))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else; null becomes empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())


def _word_count(line: Column) -> Column:
    """Words in a stretch of the line: every word has two blanks of its own."""
    return F.floor((F.length(line) - F.length(F.replace(line, F.lit(" ")))) / 2).cast("bigint")


def _places(line: Column, pattern: Column) -> Column:
    """First word and end of every match, from the words in and between the matches."""
    gaps, hits = F.split(line, pattern, -1), F.regexp_extract_all(line, pattern, 0)
    sizes = F.zip_with(gaps, hits, lambda gap, hit: F.struct(_word_count(gap).alias("gap"), _word_count(hit).alias("hit")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("found"))

    def add(done: Column, size: Column) -> Column:
        first = done["at"] + size["gap"]
        place = F.struct(first.alias("first"), (first + size["hit"]).alias("last"))
        return F.when(size["hit"].isNull(), done).otherwise(
            F.struct((first + size["hit"]).alias("at"), F.concat(done["found"], F.array(place)).alias("found"))
        )

    return F.aggregate(sizes, start, add, lambda done: done["found"])


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda p: F.struct(p["first"].alias("first"), F.lit(label).alias("label")))


_DETECTION = "array<struct<first:bigint,back:bigint,rank:int,label:string>>"


def _keywords(table: list[Rule]) -> list[str]:
    """Keywords of the rules, and of the base phrases whatever the rules are."""
    return sorted({r.keyword for r in table} | BASE_KEYWORDS)


def _by_keyword(table: list[Rule]) -> Column:
    """The rules of every keyword, as a constant map."""
    entries: dict[str, list[dict]] = {keyword: [] for keyword in _keywords(table)}
    for rule in table:
        entries[rule.keyword].append({"pattern": rule.pattern, "rank": rule.rank, "label": rule.label})
    return F.from_json(F.lit(json.dumps(entries)), "map<string,array<struct<pattern:string,rank:int,label:string>>>")


def _detections(line: Column, held: Column, table: list[Rule]) -> Column:
    """All matches of the rules whose keyword the text holds, sorted: outer intervals come first."""
    known = _by_keyword(table)
    asked = F.flatten(F.transform(held, lambda keyword: F.element_at(known, keyword)))
    each = F.transform(
        asked,
        lambda r: F.transform(
            _places(line, r["pattern"]),
            lambda p: F.struct(p["first"].alias("first"), (-p["last"]).alias("back"), r["rank"].alias("rank"), r["label"].alias("label")),
        ),
    )
    return F.array_sort(F.flatten(each))


def _kept(detections: Column) -> Column:
    """Drop what lies within an earlier detection of the same or a stronger rank."""
    ranks = sorted(WEIGHTS)
    start = F.struct(
        *[F.lit(-1).cast("bigint").alias(f"end{rank}") for rank in ranks], F.array().cast(_DETECTION).alias("kept")
    )

    def add(done: Column, one: Column) -> Column:
        end = -one["back"]
        inside = F.lit(False)
        for rank in ranks:
            inside = inside | ((one["rank"] >= rank) & (done[f"end{rank}"] >= end))
        ends = [
            F.when(one["rank"] == rank, F.greatest(done[f"end{rank}"], end)).otherwise(done[f"end{rank}"]).alias(f"end{rank}")
            for rank in ranks
        ]
        return F.struct(*ends, F.when(inside, done["kept"]).otherwise(F.concat(done["kept"], F.array(one))).alias("kept"))

    return F.aggregate(detections, start, add, lambda done: done["kept"])


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """``(doc_id, n_words, base, detections, score)``.

    ``base`` are the places of the base phrases by label, ``detections`` what suppression leaves
    (first word, negated end, rank, label), and the score is the largest weight among them.
    """
    table = rules() if table is None else table
    words = docs.select(
        F.col("doc_id").cast("bigint"), F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), 0).alias("_words")
    )
    # The keywords a text holds are a column of their own, so that they are looked up once per text.
    held = words.withColumn("_held", F.array_intersect("_words", F.array(*[F.lit(k) for k in _keywords(table)])))
    some = F.size("_held") > 0
    # Only texts with a keyword need the line.
    lined = held.withColumn(
        "_line", F.when(some, F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))).otherwise(F.lit(""))
    )
    base = F.flatten(
        F.array(
            *[
                _labelled(_places(F.col("_line"), F.lit(_line(phrase))), label)
                for phrase, label in BASE.items()
            ]
        )
    )
    nothing = F.array()
    found = lined.select(
        "doc_id", F.size("_words").cast("bigint").alias("n_words"),
        F.when(some, base).otherwise(nothing.cast("array<struct<first:bigint,label:string>>")).alias("base"),
        F.when(some, _detections(F.col("_line"), F.col("_held"), table)).otherwise(nothing.cast(_DETECTION)).alias("_all"),
    ).withColumn("detections", _kept(F.col("_all")))
    weight = F.lit(0.0)
    for rank in sorted(WEIGHTS, reverse=True):
        weight = F.when(F.array_contains("detections.rank", rank), F.lit(WEIGHTS[rank])).otherwise(weight)
    return found.drop("_all").withColumn("score", weight)
