"""License scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised to lower-case letters and digits, and those that equal a known licence
sentence or one of the patterns with a free part (holders, Creative Commons notices), or that do once lines wrapped within
a sentence are joined, become its identifier. The sequence of a text's identifiers, in order, is matched against ordered
rules: a rule holds if its identifiers occur in that order, whatever stands between. A licence whose rule is part of
another one's that holds is left out. Everything happens within a row: no shuffle, no group, and nothing that grows with
the corpus.

Defined results: a null text has no sentences; a sentence without letters or digits isn't counted; a sentence that occurs
twice gives its identifier twice; a licence is named once, in the order of the rules; rows are judged one by one, so
repeated rows give repeated results; very long texts are scanned whole; an empty table gives no rows; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

#: Known licence sentences by identifier, as published, before normalisation.
SENTENCES: dict[str, str] = {
    "mit-name": "The MIT License (MIT)",
    "mit-title": "MIT License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-released": "Released under the BSD License",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-define": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-licensed": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software",
    "gpl-version-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-version-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-either-2": "either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "lgpl-details": "See the GNU Lesser General Public License for more details",
    "agpl-details": "See the GNU Affero General Public License for more details",
    "mpl-source": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "rights-reserved": "All rights reserved",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
}

#: Ordered rules - name of the licence, kind, identifiers in order.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", "notice", ("mit-released",)),
    ("MIT", "notice", ("mit-licensed",)),
    ("MIT", "notice", ("mit-name",)),
    ("MIT", "notice", ("mit-title",)),
    ("ISC", "text", ("isc-grant", "isc-warranty")),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD", "notice", ("bsd-released",)),
    ("Apache-2.0", "text", ("apache-licensed-define", "apache-use", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", "notice", ("apache-licensed-define",)),
    ("Apache-2.0", "notice", ("apache-licensed",)),
    ("GPL-3.0-or-later", "text", ("gpl-free", "gpl-version-3", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0-or-later", "text", ("gpl-free", "gpl-version-2", "gpl-either-2", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0", "notice", ("gpl3-licensed",)),
    ("GPL-2.0", "notice", ("gpl2-licensed",)),
    ("LGPL", "notice", ("gpl-hope", "gpl-implied", "lgpl-details")),
    ("AGPL", "notice", ("gpl-hope", "gpl-implied", "agpl-details")),
    ("MPL-2.0", "text", ("mpl-source", "mpl-copy")),
    ("CC-BY-4.0", "notice", ("cc-by-4",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-4",)),
    ("Unlicense", "text", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", "notice", ("unlicense-free",)),
    ("proprietary", "notice", ("rights-reserved",)),
    ("Apache-2.0", "full text", ("apache-title", "apache-terms")),
    ("GPL-3.0", "full text", ("gpl3-title", "gnu-verbatim")),
    ("GPL-2.0", "full text", ("gpl2-title", "gnu-verbatim")),
    ("LGPL-3.0", "full text", ("lgpl3-title", "gnu-verbatim")),
    ("AGPL-3.0", "full text", ("agpl3-title", "gnu-verbatim")),
)

#: Sentences with a free part, the holder's name, as patterns over normalised sentences.
HOLDERS: dict[str, str] = {
    "bsd-name": "neither the names? of (?:[a-z0-9]+ ){1,15}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by (?:[a-z0-9]+ ){1,15}as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
}

#: Creative Commons notices as patterns over normalised sentences - licences with or without version, CC0, and links.
_CC_LEAD = r"(?:(?:this|the)(?: [a-z]+){1,2} is )?(?:(?:dual )?(?:licensed|released|available|distributed|published|shared|made available) (?:under|with) )?(?:the terms of )?(?:the |an? )?"
_CC_KIND = r"(?:by|attribution)(?: nc| non ?commercial)?(?: sa| share ?alike| nd| no ?deriv(?:ative)?s?(?: works)?)?"
_CC_TAIL = r"(?: international| unported| generic| public| deed)*(?: licen[sc]e)?"
CC = rf"(?:{_CC_LEAD}(?:spdx license identifier )?(?:cc|creative commons) {_CC_KIND}(?: [1-4] [05])?{_CC_TAIL}(?: cc {_CC_KIND}(?: [1-4] [05])?)?(?: licen[sc]e)?)"
CC_ZERO = rf"(?:{_CC_LEAD}(?:(?:cc|creative commons)(?: cc ?0| zero)|cc0)(?: 1 0)?(?: universal)?(?: cc0 1 0)?(?: public domain dedication)?(?: licen[sc]e)?)"
CC_LINK = rf"(?:(?:[a-z0-9]+ ){{0,12}}?(?:www )?creativecommons org (?:licenses {_CC_KIND} [1-4] [05]|publicdomain zero 1 0)(?: [a-z0-9]+){{0,3}})"

#: Kinds and versions, for rules like CC-BY-NC-4.0.
CC_RULES = tuple((f"CC-{kind.upper()}" + (f"-{version}" if version else ""), "notice", (f"cc-{kind}" + (f"-{version.removesuffix('.0')}" if version else ""),)) for kind in ("by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd") for version in ("4.0", "3.0", "2.5", "2.0", "1.0", ""))
SCAN_RULES = (*RULES, *(r for r in CC_RULES if r not in RULES), ("CC0-1.0", "notice", ("cc0",)))

#: Where a sentence ends; the same in Java and RE2.
SPLIT = r"[.;:!?]+(?:[ \t\r\n]+|\z)|[\r\n]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(s: str) -> str:
    """A sentence as the scan sees it."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())


def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier."""
    out = {_normal(text): name for name, text in SENTENCES.items()}
    if len(out) != len(SENTENCES):
        raise ValueError("two sentences are equal when normalised")
    return out


def rule_pattern(ids: tuple[str, ...]) -> str:
    """A pattern that the line ' id  id ... ' of a document, each identifier between spaces of its own, contains if the rule holds; plain for Java and RE2."""
    return " " + "  (?:[^ ]+  )*".join(ids) + " "


def _covered(rule: int, rules: tuple = RULES) -> list[int]:
    """Rules of other licences that have this one's identifiers among theirs, in order."""

    def within(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        it = iter(b)
        return len(a) < len(b) and all(x in it for x in a)

    name, _, ids = rules[rule]
    return [k for k, (other, _, more) in enumerate(rules) if other != name and within(ids, more)]


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.transform(F.split(lower, SPLIT, -1), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def lines_of(text: Column) -> Column:
    """The normalised text with \\f where a sentence ends for certain (punctuation, blank lines) and \\n at single line breaks; comment marks at the beginning of lines go like all other characters."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, r"\f", " ")
    t = F.regexp_replace(t, r"[.;:!?]+(?:[ \t\r\n]+|\z)", "\f")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"[^a-z0-9\n\f]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r" ?([\n\f]) ?", "$1"), r"\n{2,}|\n*\f[\n\f]*", "\f"), r"^ +| +\z", "")


def wrapped(space: str) -> str:
    """One pattern for all known sentences, in which `space` stands for a space or the break of a wrapped line."""
    parts = (*sorted(known_sentences(), key=len, reverse=True), *HOLDERS.values(), CC_ZERO, CC, CC_LINK)  # the longest first: another one may end at a line break within it
    return "|".join(p.replace(" ?", "\0").replace(" ", space).replace("\0", space + "?") for p in parts)


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences, in order; a sentence may be wrapped over any lines."""
    table = F.create_map(*(F.lit(x) for pair in known_sentences().items() for x in pair))
    found = F.regexp_extract_all(lines_of(text), F.lit(rf"(?:^|[\n\f])({wrapped("[ \\n]")})(?=[\n\f]|\z)"), F.lit(1))

    def name(s: Column) -> Column:
        free = [F.when(s.rlike(rf"\A(?:{pattern})\z"), F.lit(i)) for i, pattern in HOLDERS.items()]
        return F.coalesce(F.try_element_at(table, s), *free, _creative_commons(s))

    return F.transform(F.transform(found, lambda s: F.translate(s, "\n", " ")), name)


def _creative_commons(s: Column) -> Column:
    """The identifier of a Creative Commons notice."""
    part = lambda pattern, name: F.when(s.rlike(pattern), F.lit(name)).otherwise(F.lit(""))
    version = F.regexp_extract(s, r" ([1-4]) ([05])(?: |\z)", 0)
    version = F.when(version == "", F.lit("")).otherwise(F.concat(F.lit("-"), F.regexp_replace(F.translate(F.trim(version), " ", "."), r"\.0", "")))
    kind = F.concat(F.lit("cc-by"), part(r" nc(?: |\z)| non ?commercial", "-nc"), part(r" sa(?: |\z)| share ?alike", "-sa"), part(r" nd(?: |\z)| no ?deriv", "-nd"), version)
    return F.when(s.rlike("cc ?0|zero"), F.lit("cc0")).otherwise(kind)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_sentences, n_known, sentence_ids (in order, comma-joined), licenses (comma-joined)."""
    found = docs.select(col(doc_id).alias("doc_id"), sentences(col(text)).alias("parts"), identifiers(col(text)).alias("ids"))
    found = found.select("doc_id", F.size("parts").cast("long").alias("n_sentences"), "ids")
    line = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))  # each identifier with a space of its own on both sides
    holds = [F.col("line").rlike(rule_pattern(ids)) for _, _, ids in SCAN_RULES]
    names = []
    for k, (name, _, _) in enumerate(SCAN_RULES):
        own = holds[k]
        for other in _covered(k, SCAN_RULES):
            own = own & ~holds[other]
        names.append(F.when(own, F.lit(name)))
    licenses = F.when(F.size("ids") == 0, F.lit("")).otherwise(F.array_join(F.array_distinct(F.array_compact(F.array(*names))), ","))
    return found.withColumn("line", line).select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), licenses.alias("licenses"))


def scan_sql() -> str:
    """The scan as DuckDB SQL, from the same tables of sentences, patterns and rules."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(t)}, {quoted(i)})" for t, i in known_sentences().items())
    holds = [f"regexp_matches(line, {quoted(rule_pattern(ids))})" for _, _, ids in SCAN_RULES]
    names = []
    for k, (name, _, _) in enumerate(SCAN_RULES):
        names.append(f"{{'k': {k}, 'name': CASE WHEN " + " AND ".join([holds[k], *(f"NOT {holds[o]}" for o in _covered(k, SCAN_RULES))]) + f" THEN {quoted(name)} END}}")
    holders = " ".join(f"WHEN regexp_matches(s, {quoted(rf'\A(?:{p})\z')}) THEN {quoted(i)}" for i, p in HOLDERS.items())
    # each break stands twice, so that one sentence's end can be the next one's beginning without looking ahead
    pattern = rf"[\n\f]({wrapped(r'(?: |\n\n)')})[\n\f]"
    return rf"""
WITH known(s, id) AS (VALUES {table}), d AS (
  SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), c AS (
  SELECT r, count(*) AS n_sentences FROM (SELECT r, unnest(string_split_regex(t, {quoted(SPLIT)})) AS p FROM d) WHERE regexp_matches(p, '[a-z0-9]') GROUP BY r
), e AS (
  SELECT r, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\f', ' ', 'g'), '[.;:!?]+(?:[ \t\r\n]+|\z)', chr(12), 'g'), '\r\n?', chr(10), 'g'), '[^a-z0-9\n\f]+', ' ', 'g') AS t FROM d
), l AS (
  SELECT r, regexp_replace(regexp_replace(regexp_replace(t, ' ?([\n\f]) ?', '\1', 'g'), '\n{{2,}}|\n*\f[\n\f]*', chr(12), 'g'), '^ +| +\z', '', 'g') AS t FROM e
), f AS (
  SELECT r, regexp_extract_all(chr(12) || regexp_replace(t, '([\n\f])', '\1\1', 'g') || chr(12), {quoted(pattern)}, 1) AS found FROM l
), s AS (
  SELECT r, unnest(range(1, len(found) + 1)) AS k, replace(unnest(found), chr(10) || chr(10), ' ') AS s FROM f
), i AS (
  SELECT r, k, CASE WHEN id IS NOT NULL THEN id {holders} WHEN regexp_matches(s, 'cc ?0|zero') THEN 'cc0'
    ELSE 'cc-by' || CASE WHEN regexp_matches(s, ' nc(?: |\z)| non ?commercial') THEN '-nc' ELSE '' END || CASE WHEN regexp_matches(s, ' sa(?: |\z)| share ?alike') THEN '-sa' ELSE '' END
      || CASE WHEN regexp_matches(s, ' nd(?: |\z)| no ?deriv') THEN '-nd' ELSE '' END
      || CASE WHEN regexp_matches(s, ' [1-4] [05](?: |\z)') THEN '-' || replace(replace(trim(regexp_extract(s, ' [1-4] [05](?: |\z)', 0)), ' ', '.'), '.0', '') ELSE '' END END AS id
  FROM s LEFT JOIN known USING (s)
), g AS (
  SELECT r, ids, ' ' || array_to_string(ids, '  ') || ' ' AS line FROM (SELECT r, list(id ORDER BY k) AS ids FROM i GROUP BY r)
), m AS (
  SELECT r, name, min(k) AS k FROM (SELECT r, unnest([{", ".join(names)}], recursive := true) FROM g) WHERE name IS NOT NULL GROUP BY r, name
), n AS (
  SELECT r, string_agg(name, ',' ORDER BY k) AS licenses FROM m GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r) LEFT JOIN n USING (r)
"""
