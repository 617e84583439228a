"""License scan by ordered signature rules (native DataFrame functions only).

A text is reduced to its lower-case words with one space between them. Rules are regexes over such words; each has a
keyword (a word that every match holds), a priority and a confidence. A text is only scanned if it holds one of a few
substrings, and only by the rules whose keyword it has. Of the detections of a document, one inside another of equal
or higher priority is suppressed (of equal spans and priorities, the later rule's); the rest give the labels, and the
largest confidence is the score.

Beside the rules, four base phrases are counted in every text, whatever the rules find.

Defined results: a null or blank text has no words, no detection and score 0; repeated rows get the same results; an
empty table gives an empty result; columns other than the ones named are not read.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, land, with_document_key

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Substrings of which every rule's match holds one.
GATES = ["licen", "copyright", "redistribut", "permission", "public domain", "creativecommons", "creative commons", "cc by", "cc0", "spdx",
         "gpl", "warrant", "unlicense", "mozilla", "eclipse", "sil org", "wtfpl", "fuck", "advertising", "endorse"]

# Licenses: label, names (regex over words, keyword), SPDX words, URL words.
FAMILIES = [
    ("apache-1.0", [("apache(?: software)? license(?: version)? 1 0", "apache")], "apache 1 0", "apache org licenses license 1 0"),
    ("apache-1.1", [("apache(?: software)? license(?: version)? 1 1", "apache")], "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", [("apache(?: software)? license(?: version)? 2(?: 0)?", "apache"), ("asl 2 0 license", "asl")], "apache 2 0", "apache org licenses license 2 0"),
    ("mit", [("mit(?: x11)? licen[cs]e", "mit"), ("expat licen[cs]e", "expat")], "mit", "opensource org licenses mit"),
    ("mit-0", [("mit no attribution licen[cs]e", "attribution")], "mit 0", "opensource org licenses mit 0"),
    ("x11", [("x11 licen[cs]e", "x11")], "x11", None),
    ("isc", [("isc licen[cs]e", "isc")], "isc", "opensource org licenses isc"),
    ("bsd-2-clause", [("(?:simplified|2 clause|two clause|freebsd) bsd licen[cs]e", "bsd"), ("bsd (?:2|two) clause(?: simplified)? licen[cs]e", "bsd")], "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", [("(?:modified|new|revised|3 clause|three clause) bsd licen[cs]e", "bsd"), ("bsd (?:3|three) clause(?: new)? licen[cs]e", "bsd")], "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", [("(?:original|old|4 clause|four clause) bsd licen[cs]e", "bsd")], "bsd 4 clause", None),
    ("0bsd", [("(?:zero clause|0 clause|free public) bsd licen[cs]e", "bsd"), ("0bsd licen[cs]e", "0bsd")], "0bsd", "opensource org licenses 0bsd"),
    ("gpl-1.0", [("gnu general public licen[cs]e(?: version| v)? 1", "gnu"), ("(?:gnu )?gpl (?:version |v ?)?1(?: 0)?", "gpl")], "gpl 1 0(?: only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", [("gnu general public licen[cs]e(?: version| v)? 2", "gnu"), ("(?:gnu )?gpl (?:version |v ?)?2(?: 0)?", "gpl"), ("gplv2", "gplv2")], "gpl 2 0(?: only| or later)?", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", [("gnu general public licen[cs]e(?: version| v)? 3", "gnu"), ("(?:gnu )?gpl (?:version |v ?)?3(?: 0)?", "gpl"), ("gplv3", "gplv3")], "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", [("gnu library general public licen[cs]e(?: version| v)? 2", "gnu"), ("lgpl (?:version |v ?)?2 0", "lgpl")], "lgpl 2 0(?: only| or later)?", None),
    ("lgpl-2.1", [("gnu lesser general public licen[cs]e(?: version| v)? 2 1", "gnu"), ("lgpl (?:version |v ?)?2 1", "lgpl")], "lgpl 2 1(?: only| or later)?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", [("gnu lesser general public licen[cs]e(?: version| v)? 3", "gnu"), ("lgpl (?:version |v ?)?3(?: 0)?", "lgpl"), ("lgplv3", "lgplv3")], "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", [("gnu affero general public licen[cs]e(?: version| v)? 3", "gnu"), ("agpl (?:version |v ?)?3(?: 0)?", "agpl"), ("agplv3", "agplv3")], "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("gfdl", [("gnu free documentation licen[cs]e", "gnu"), ("gfdl licen[cs]e", "gfdl")], "gfdl 1 [123](?: only| or later)?", "gnu org licenses fdl 1 [123]"),
    ("mpl-1.1", [("mozilla public licen[cs]e(?: version| v)? 1 1", "mozilla")], "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", [("mozilla public licen[cs]e(?: version| v)? 2 0", "mozilla"), ("mpl 2 0 licen[cs]e", "mpl")], "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1.0", [("eclipse public licen[cs]e(?: version| v)? 1 0", "eclipse")], "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", [("eclipse public licen[cs]e(?: version| v)? 2 0", "eclipse")], "epl 2 0", "eclipse org legal epl v20"),
    ("eupl", [("european union public licen[cs]e", "european")], "eupl 1 [012]", None),
    ("cddl", [("common development and distribution licen[cs]e", "common")], "cddl 1 [01]", None),
    ("cpl-1.0", [("common public licen[cs]e(?: version| v)? 1 0", "common")], "cpl 1 0", None),
    ("artistic-1.0", [("artistic licen[cs]e 1 0", "artistic")], "artistic 1 0", None),
    ("artistic-2.0", [("artistic licen[cs]e 2 0", "artistic")], "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("boost-1.0", [("boost software licen[cs]e", "boost")], "bsl 1 0", "boost org license 1 0 txt"),
    ("zlib", [("zlib(?: libpng)? licen[cs]e", "zlib")], "zlib", "opensource org licenses zlib"),
    ("python-2.0", [("python software foundation licen[cs]e", "python")], "(?:python|psf) 2 0", None),
    ("ruby", [("ruby licen[cs]e", "ruby")], "ruby", None),
    ("php-3.0", [("php licen[cs]e(?: version)? 3 0", "php")], "php 3 01?", None),
    ("openssl", [("openssl licen[cs]e", "openssl")], "openssl", None),
    ("postgresql", [("postgresql licen[cs]e", "postgresql")], "postgresql", "opensource org licenses postgresql"),
    ("ofl-1.1", [("sil open font licen[cs]e", "sil")], "ofl 1 1", "scripts sil org ofl"),
    ("ms-pl", [("microsoft public licen[cs]e", "microsoft")], "ms pl", None),
    ("ms-rl", [("microsoft reciprocal licen[cs]e", "microsoft")], "ms rl", None),
    ("odbl-1.0", [("open (?:data commons open )?database licen[cs]e", "database")], "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by", [("open data commons attribution licen[cs]e", "commons")], "odc by 1 0", "opendatacommons org licenses by"),
    ("wtfpl", [("do what the fuck you want to public licen[cs]e", "fuck")], "wtfpl", "wtfpl net"),
    ("unlicense", [("(?:the )?unlicense", "unlicense")], "unlicense", "unlicense org"),
    ("upl-1.0", [("universal permissive licen[cs]e", "universal")], "upl 1 0", None),
    ("cc0-1.0", [("cc0(?: 1 0)?(?: universal)?", "cc0"), ("creative commons zero(?: v?1 0)?(?: universal| licen[cs]e)", "zero")], "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc", [("cc by nc(?: [1-4] [05])?", "nc"), ("creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)? licen[cs]e", "creative")], "cc by nc [1-4] [05]", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-nd", [("cc by nc nd(?: [1-4] [05])?", "nd"), ("creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international)? licen[cs]e", "creative")], "cc by nc nd [1-4] [05]", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", [("cc by nc sa(?: [1-4] [05])?", "sa"), ("creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)? licen[cs]e", "creative")], "cc by nc sa [1-4] [05]", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nd", [("cc by nd(?: [1-4] [05])?", "nd"), ("creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international)? licen[cs]e", "creative")], "cc by nd [1-4] [05]", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-sa", [("cc by sa(?: [1-4] [05])?", "sa"), ("creative commons attribution share ?alike(?: [1-4] [05])?(?: international)? licen[cs]e", "creative")], "cc by sa [1-4] [05]", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-plain", [("cc by [1-4] [05]", "cc"), ("creative commons attribution(?: [1-4] [05])?(?: international)? licen[cs]e", "creative")], "cc by [1-4] [05]", "creativecommons org licenses by [1-4] [05]"),
    ("proprietary", [("(?:proprietary|commercial|closed source) license", "license")], None, None),
]

# Sentences that only stand in one license's text or notice: label, regex over words, keyword.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", "endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "received"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "received"),
    ("agpl", "under the terms of the gnu affero general public license", "affero"),
    ("or-later", "either version [123](?: 1)? of the license or (?:at your option )?any later version", "later"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|placed|dedicated|donated) (?:in|into|to) the public domain", "domain"),
    ("public-domain", "this (?:file|work|software|code|text) is in the public domain", "domain"),
    ("cc0-1.0", "to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright", "waived"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("all-rights-reserved", "copyright(?: c)?(?: [0-9]{4})?(?: [^ ]+){0,6} all rights reserved", "reserved"),
    ("all-rights-reserved", "all rights reserved copyright", "reserved"),
    ("no-redistribution", "(?:may|must) not be (?:copied|reproduced|redistributed) without (?:prior )?(?:written )?permission", "permission"),
    ("academic-use", "licensed for (?:academic|research|non ?commercial) use only", "licensed"),
    ("as-is", "provided as is without warranty of any kind", "warranty"),
]

SCHEMA = "rule int, label string, pattern string, keyword string, priority int, confidence double"


def signature_rules() -> list[tuple]:
    """All rules, in order: (rule, label, pattern, keyword, priority, confidence)."""
    def of(family):
        label, names, spdx, url = family
        for name, keyword in names:
            yield label, name, keyword, 2, 0.7
            yield (label, "(?:licensed|released|distributed|available|published|provided|offered|shared) (?:under|according to)"
                   rf"(?: the)?(?: terms (?:of|and conditions of))?(?: the)? {name}", keyword, 3, 0.9)
            yield label, rf"(?:see|read) (?:the )?{name}(?: for (?:more )?details)", keyword, 3, 0.8
        if spdx:
            yield label, f"spdx license identifier {spdx}", "spdx", 4, 1.0
        if url:
            yield label, f"(?:https? )?(?:www )?{url}", next(w for w in url.split(" ") if w not in ("org", "net")), 3, 0.95

    listed = chain(chain.from_iterable(of(f) for f in FAMILIES),
                   ((label, pattern, keyword, 5, 0.95) for label, pattern, keyword in SENTENCES))
    return [(i, label, f"(?<= )(?:{pattern})(?= )", keyword, priority, confidence)
            for i, (label, pattern, keyword, priority, confidence) in enumerate(listed)]


def normal_words(text: Column) -> Column:
    """The words of a text, each after one space, and a space at the end; one space for no words."""
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _base_columns(words: Column) -> dict[str, Column]:
    any_phrase = "(?<= )(?:" + "|".join(BASE_PHRASES) + ")(?= )"
    has = {p: F.contains(words, F.lit(f" {p} ")) for p in BASE_PHRASES}
    some = has["cc by"] | F.contains(words, F.lit(" license "))
    back = F.reverse(words)
    at = [F.when(F.locate(f" {p} ", words) > 0, F.locate(f" {p} ", words)) for p in BASE_PHRASES]
    from_end = [F.when(F.locate(f" {p[::-1]} ", back) > 0, F.locate(f" {p[::-1]} ", back) + len(p) + 1)
                for p in BASE_PHRASES]
    first = F.substring(words, F.lit(1), F.least(*at))
    last = F.substring(words, F.lit(1), F.length(words) + 1 - F.least(*from_end))
    labels = F.array_sort(F.filter(F.array(*[F.when(has[p], F.lit(label)) for p, label in BASE_PHRASES.items()]),
                                   lambda x: x.isNotNull()))
    return {
        "n_words": _spaces(words) - 1,
        "n_base": F.when(some, F.regexp_count(words, F.lit(any_phrase))).otherwise(0).cast("long"),
        "first_word": F.when(some, _spaces(first) - 1),
        "last_word": F.when(some, _spaces(last) - 1),
        "base_labels": F.when(some, labels).otherwise(F.array().cast("array<string>")),
    }


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(signature_rules(), SCHEMA)


def detections(texts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """All unsuppressed detections (k, c, rule, label, priority, confidence, start, end) in ``texts(k, c, words)``;
    start and end are character places in the words. Each document's spans are resolved in one window over its own
    detections. The rule table has a fixed number of rows, which is why it is broadcast."""
    rules = rules if rules is not None else rule_table(texts.sparkSession)
    keywords = sorted({r[3] for r in signature_rules()})
    present = F.array_intersect(F.split("words", " "), F.array(*[F.lit(w) for w in keywords]))
    gated = texts.select("k", "c", "words", F.explode(present).alias("keyword")).join(F.broadcast(rules), "keyword")
    # what stands between the matches and the matches, in turn: their lengths give the places
    between = F.transform(F.split("words", F.col("pattern"), -1), lambda x: F.length(x))
    matched = F.transform(F.regexp_extract_all("words", F.col("pattern"), F.lit(0)), lambda x: F.length(x))
    found = (gated.withColumn("matched", matched).where(F.size("matched") > 0)
             .withColumn("between", between)
             .select("k", "c", "rule", "label", "priority", "confidence",
                     F.posexplode(F.arrays_zip(F.slice("between", F.lit(1), F.size("matched")).alias("gap"),
                                               F.col("matched").alias("size"))).alias("i", "m")))
    order = Window.partitionBy("k", "c", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(order)).withColumn(
        "start", F.col("end") - F.col("m.size"))
    before = (Window.partitionBy("k", "c").orderBy("start", F.desc("end"), F.desc("priority"), "rule")
              .rowsBetween(Window.unboundedPreceding, -1))
    tiers = sorted({r[4] for r in signature_rules()})
    reach = F.coalesce(*[F.when(F.col("priority") == t, F.max(F.when(F.col("priority") >= t, F.col("end"))).over(before))
                         for t in tiers], F.lit(-1))
    return (placed.withColumn("reach", reach).where("reach < end")
            .select("k", "c", "rule", "label", "priority", "confidence", "start", "end"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row; the labels are sorted
    arrays, and score is the largest confidence of an unsuppressed detection, or 0."""
    keyed = with_document_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    rows = keyed.withColumn("words", normal_words(F.col("text")))
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains("words", F.lit(g))
    rows = land(rows.select("id", F.col("__k").alias("k"), F.col("__c").alias("c"),
                            *[c.alias(n) for n, c in _base_columns(F.col("words")).items()],
                            F.when(gate, F.col("words")).alias("words")), "license-words")
    found = detections(rows.where("words is not null").select("k", "c", "words").dropDuplicates(["k", "c"]))
    merged = found.groupBy("k", "c").agg(F.collect_set("label").alias("found"), F.max("confidence").alias("score"))
    return rows.drop("words").join(merged, ["k", "c"], "left").select(
        "id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
