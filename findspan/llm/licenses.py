"""Licence recognition: known licence sentences become identifiers, rules match their sequences.

DataFrame functions only: no Python runs on the rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import lowered, texts

# Sentences of licences and their notices, as their authors publish them.
SENTENCES = {
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MIT-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "Apache-use": "you may not use this file except in compliance with the License.",
    "Apache-copy": "You may obtain a copy of the License at",
    "Apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-free": "This program is free software:",
    "GPL-free-2": "This program is free software;",
    "GPL-3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "Reserved": "All rights reserved.",
}
# Names by which a notice calls a licence, and the licence's short identifier.
NAMES = {
    "MIT License": "MIT", "MIT": "MIT", "Expat License": "MIT",
    "Apache License, Version 2.0": "Apache-2.0", "Apache License 2.0": "Apache-2.0", "Apache 2.0": "Apache-2.0", "Apache-2.0": "Apache-2.0",
    "BSD License": "BSD-3-Clause", "BSD 2-Clause License": "BSD-2-Clause", "BSD-2-Clause": "BSD-2-Clause",
    "BSD 3-Clause License": "BSD-3-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC License": "ISC", "ISC": "ISC",
    "GNU General Public License, version 3": "GPL-3.0-only", "GNU General Public License v3": "GPL-3.0-only", "GPLv3": "GPL-3.0-only",
    "GPL-3.0-only": "GPL-3.0-only", "GPL-3.0-or-later": "GPL-3.0-or-later",
    "GNU General Public License, version 2": "GPL-2.0-only", "GNU General Public License v2": "GPL-2.0-only", "GPLv2": "GPL-2.0-only",
    "GPL-2.0-only": "GPL-2.0-only", "GPL-2.0-or-later": "GPL-2.0-or-later",
    "GNU Lesser General Public License, version 2.1": "LGPL-2.1-only", "LGPL-2.1-only": "LGPL-2.1-only",
    "GNU Lesser General Public License, version 3": "LGPL-3.0-only", "LGPL-3.0-only": "LGPL-3.0-only",
    "GNU Affero General Public License, version 3": "AGPL-3.0-only", "AGPL-3.0-only": "AGPL-3.0-only",
    "Mozilla Public License, version 2.0": "MPL-2.0", "Mozilla Public License 2.0": "MPL-2.0", "MPL-2.0": "MPL-2.0",
    "CC BY 4.0": "CC-BY-4.0", "Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "CC-BY-4.0": "CC-BY-4.0",
    "CC BY-SA 4.0": "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "CC BY-NC 4.0": "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0",
    "CC0 1.0": "CC0-1.0", "CC0-1.0": "CC0-1.0", "Unlicense": "Unlicense",
}
# A notice is a fixed lead and a name; the lead is cut to this mark before the look-up.
LEADS = (
    r"^(this (work|project|software|program|file|package|library|code|document) is )?"
    r"(licensed|released|distributed|available|published|provided) under (the )?(terms of (the )?)?"
    r"|^spdx license identifier "
)
MARK = "under "
# The holder's name stands where it pleases; in the normal form the words of the licence's own template take its place.
HOLDERS = r"^neither the names? of .{1,200}? nor the names of (its|their|any) contributors may "
HOLDER = "neither the name of the copyright holder nor the names of its contributors may "
#: What begins a line of a comment, and lines that end a sentence whatever follows: who holds the copyright.
LEADERS = r"(^|\n)[ \t]*(/\*+|\*+/|\*+|//+!?|#+|--+|;+|<!--|dnl|rem )[ \t]*"
HOLDING = r"(^|\n)([ \t]*(copyright|\(c\)|©)[^\n]*)"
#: Rules in order: the first takes its identifiers away from those after it. Up to two
#: other known sentences may stand between two of a rule.
RULES = [
    ("BSD-3-Clause", ["BSD-grant", "BSD-source", "BSD-binary", "BSD-names"]),
    ("BSD-2-Clause", ["BSD-grant", "BSD-source", "BSD-binary"]),
    ("MIT", ["MIT-grant", "MIT-notice", "MIT-warranty", "MIT-liability"]),
    ("MIT", ["MIT-grant", "MIT-notice"]),
    ("ISC", ["ISC-grant"]),
    ("Apache-2.0", ["Apache-header", "Apache-use", "Apache-copy", "Apache-basis"]),
    ("Apache-2.0", ["Apache-header", "Apache-use"]),
    ("AGPL-3.0-or-later", ["GPL-free", "AGPL-3-later"]),
    ("GPL-3.0-or-later", ["GPL-free", "GPL-3-later"]),
    ("GPL-2.0-or-later", ["GPL-free-2", "GPL-2-later"]),
    ("LGPL-2.1-or-later", ["GPL-free-2", "LGPL-21-later"]),
    ("MPL-2.0", ["MPL-header"]),
    ("Unlicense", ["Unlicense-domain"]),
    *[(spdx, [f"notice-{spdx}"]) for spdx in dict.fromkeys(NAMES.values())],
    ("Proprietary", ["Reserved"]),
]
CUT = "\x01"
#: What cuts a text into sentences, one after another: (pattern, what stands instead, groups as ``\\1``). An operator of an
#: SPDX expression repeats the lead, as often as a line has operators, up to four.
CUTS = [
    (LEADERS, "\\1"),
    *[(rf"(?i)(spdx-license-identifier:)([^\n{CUT}]*?)[ \t()]+(?:and|or|with)[ \t(]+", rf"\1\2{CUT}\1 ")] * 4,
    (rf"(?i){HOLDING}", rf"\1\2{CUT}"),
    (r"\b([Ii]nc|[Ll]td|[Cc]orp|[Cc]o|[Ll]lc|LLC)[.](,?[ \t\r\n]+[a-z])", r"\1\2"),  # no end of a sentence
    (r"([.;!?]|[^r]:)[ \t\r\n]+", rf"\1{CUT}"),
    (r"\n[ \t\r]*\n", CUT),
]


def plain(text: str) -> str:
    """The normal form of a sentence: a-z and 0-9, other characters as single blanks, a notice's lead as its mark."""
    normal = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())
    return re.sub(LEADS, MARK, re.sub(HOLDERS, HOLDER, normal))


def sentence_ids() -> dict[str, str]:
    """Normal form of each known sentence and its identifier."""
    known: dict[str, str] = {}
    for name, text in SENTENCES.items():
        # Sentences that differ only in marks share the first identifier.
        known.setdefault(plain(text), name)
    for name, spdx in NAMES.items():
        known.setdefault(MARK + plain(name), f"notice-{spdx}")
    return known


def rule_patterns() -> list[tuple[str, str]]:
    """(licence, pattern) over a sequence written as ``|id|id|…``."""
    known = set(sentence_ids().values())
    alias = {name: sentence_ids()[plain(text)] for name, text in SENTENCES.items()}
    patterns = []
    for licence, ids in RULES:
        ids = [alias.get(i, i) for i in ids]
        if set(ids) <= known:
            patterns.append((licence, r"([^|]+\|){0,2}".join(rf"{i.replace('.', '[.]')}\|" for i in ids)))
    return patterns


def known_sentences(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    Comment leaders at line starts are left out first. Sentences end at ``. ; : ! ?`` before white space (not at a colon after r, as in
    ``SPDX-License-Identifier:``), at empty lines and after a line that names the holder of the copyright. In an expression behind
    ``SPDX-License-Identifier:`` each licence is a notice of its own. A sentence that is not known is looked
    up line by line, since notices often stand on lines of their own.
    """
    table = F.create_map(*[F.lit(x) for pair in sentence_ids().items() for x in pair])

    def look_up(part: Column) -> Column:
        normal = F.trim(F.regexp_replace(lowered(part), "[^a-z0-9]+", " "))
        named = F.regexp_replace(F.regexp_replace(normal, HOLDERS, HOLDER), LEADS, MARK)
        # Longer than any known sentence: not looked up.
        return F.when(F.length(normal) <= longest, F.element_at(table, named))

    longest = max(map(len, sentence_ids())) + 200
    for pattern, instead in CUTS:
        text = F.regexp_replace(text, pattern, instead.replace("\\", "$"))
    parts = F.split(text, CUT, -1)
    found = F.transform(
        parts,
        lambda p: F.when(look_up(p).isNotNull(), F.array(look_up(p))).otherwise(
            F.transform(F.split(p, "\n", -1), look_up)
        ),
    )
    return F.filter(F.flatten(found), lambda i: i.isNotNull())


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, sentences (``|id|id|…``), licences (ascending, comma-separated).

    Rules are tried in order; what one matches is not seen by the next, and a rule may match several times.
    Texts without known sentences (null and empty ones too) give empty strings. Repeated rows give
    repeated results. All work is within a row: no shuffle.
    """
    rows = texts(docs, key, text).select("doc_id", known_sentences(F.col("text")).alias("ids"))
    rows = rows.select(
        "doc_id",
        F.when(F.size("ids") > 0, F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))).otherwise("").alias("sentences"),
    )
    step = rows.withColumn("rest", F.col("sentences")).withColumn("found", F.array().cast("array<string>"))
    patterns = rule_patterns()
    for start in range(0, len(patterns), 8):
        rest, found = F.col("rest"), []
        for licence, pattern in patterns[start : start + 8]:
            found.append(F.when(F.regexp_like(rest, F.lit(pattern)), F.lit(licence)))
            rest = F.regexp_replace(rest, pattern, "#|")
        step = step.select(
            "doc_id", "sentences", F.when(F.col("sentences") == "", "").otherwise(rest).alias("rest"),
            F.when(F.col("sentences") == "", F.col("found")).otherwise(F.concat("found", F.array(*found))).alias("found"),
        )
    licences = F.array_join(F.array_sort(F.array_distinct(F.filter("found", lambda x: x.isNotNull()))), ",")
    return step.select("doc_id", "sentences", licences.alias("licences"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licences_sql() -> str:
    """The same scan in DuckDB's SQL."""
    known = sentence_ids()
    table = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in known.items()) + "}"
    longest = max(map(len, known)) + 200
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def look_up(x: str) -> str:
        normal = f"trim(regexp_replace(translate({x}, '{upper}', '{lower}'), '[^a-z0-9]+', ' ', 'g'), ' ')"
        named = f"regexp_replace(regexp_replace({normal}, {_quoted(HOLDERS)}, '{HOLDER}', 'g'), {_quoted(LEADS)}, '{MARK}', 'g')"
        return f"CASE WHEN length({normal}) <= {longest} THEN {table}[{named}] END"

    cut = "coalesce(text, '')"
    for pattern, instead in CUTS:
        cut = f"regexp_replace({cut}, {_quoted(pattern)}, {_quoted(instead)}, 'g')"
    steps = []
    for n, (licence, pattern) in enumerate(rule_patterns()):
        steps.append(f"CASE WHEN regexp_matches(r{n}, {_quoted(pattern)}) THEN {_quoted(licence)} END")
    layers = "SELECT doc_id, sentences, sentences AS r0 FROM s"
    for n, (_, pattern) in enumerate(rule_patterns()):
        layers = f"SELECT *, regexp_replace(r{n}, {_quoted(pattern)}, '#|', 'g') AS r{n + 1} FROM ({layers})"
    return f"""
WITH p AS (
  SELECT doc_id, string_split({cut}, chr(1)) AS parts FROM documents),
i AS (
  SELECT doc_id, list_filter(flatten(list_transform(parts, lambda p: CASE WHEN {look_up('p')} IS NOT NULL THEN [{look_up('p')}]
    ELSE list_transform(string_split(p, chr(10)), lambda l: {look_up('l')}) END)), lambda x: x IS NOT NULL) AS ids FROM p),
s AS (SELECT doc_id, CASE WHEN len(ids) > 0 THEN '|' || array_to_string(ids, '|') || '|' ELSE '' END AS sentences FROM i)
SELECT doc_id, sentences,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(steps)}], lambda x: x IS NOT NULL))), ','), '') AS licences
FROM ({layers})"""
