"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences twice: at line ends and sentence ends ("line"), and at sentence ends and blank lines only
("flow", for wrapped license texts). Each sentence is normalised (lower case, runs of
other characters than a-z and 0-9 as one space, trimmed) and mapped to the identifier of a known sentence, or dropped.
Ordered rules then look for their identifiers, in order and with gaps allowed, in either sequence.
Nothing is shuffled: a row's result depends on that row alone, so no source or group of copies can be hot.

Null and empty texts have no sentences and no license. Ids may be null or repeat: one row out for each row in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of public licenses in normalised form, with our identifiers.
SENTENCES: list[tuple[str, str]] = [
    ("mit-name", "mit license"),
    ("mit-name-the", "the mit license"),
    ("mit-released", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-this", "this project is licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("asis-software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-licensed", "licensed under the apache license version 2 0"),
    ("apache-licensed-the", "licensed under the apache license version 2 0 the license"),
    ("apache-released", "released under the apache license version 2 0"),
    ("apache-name", "apache license"),
    ("apache-comply", "you may not use this file except in compliance with the license"),
    ("apache-obtain", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-licensed", "licensed under the gnu general public license version 3"),
    ("gpl2-work", "this work is licensed under the gnu general public license version 2"),
    ("gpl2-licensed", "licensed under the gnu general public license version 2"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl3-licensed", "licensed under the gnu lesser general public license version 3"),
    ("agpl3-licensed", "licensed under the gnu affero general public license version 3"),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2-licensed", "licensed under the mozilla public license version 2 0"),
    ("bsd-redist", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd3-licensed", "licensed under the bsd 3 clause license"),
    ("bsd2-licensed", "licensed under the bsd 2 clause license"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-licensed", "licensed under the isc license"),
    ("ccbync4-licensed", "licensed under cc by nc 4 0"),
    ("ccbysa4-licensed", "licensed under cc by sa 4 0"),
    ("ccby4-licensed", "licensed under cc by 4 0"),
    ("ccby4-work", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("ccbysa4-work", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("ccbync4-work", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0-work", "released into the public domain under the cc0 1 0 license"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache", "spdx license identifier apache 2 0"),
    ("spdx-gpl3", "spdx license identifier gpl 3 0 or later"),
    ("spdx-bsd3", "spdx license identifier bsd 3 clause"),
    ("rights", "all rights reserved"),
]

# License, then identifiers that must follow one another in this order; earlier rules are listed first.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-notice", "asis-software")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-this",)),
    ("MIT", ("mit-name", "mit-grant")),
    ("MIT", ("mit-name-the", "mit-grant")),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache-licensed-the", "apache-comply", "apache-asis")),
    ("Apache-2.0", ("apache-comply", "apache-obtain")),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-released",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-licensed",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-2.0", ("gpl2-work",)),
    ("GPL-2.0", ("gpl2-licensed",)),
    ("LGPL-3.0", ("lgpl3-licensed",)),
    ("AGPL-3.0", ("agpl3-licensed",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("MPL-2.0", ("mpl2-licensed",)),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd3-licensed",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd2-licensed",)),
    ("ISC", ("isc-grant", "asis-software")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-licensed",)),
    ("CC-BY-NC-4.0", ("ccbync4-licensed",)),
    ("CC-BY-NC-4.0", ("ccbync4-work",)),
    ("CC-BY-SA-4.0", ("ccbysa4-licensed",)),
    ("CC-BY-SA-4.0", ("ccbysa4-work",)),
    ("CC-BY-4.0", ("ccby4-licensed",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC0-1.0", ("cc0-work",)),
    ("Unlicense", ("unlicense-free",)),
]

#: A license whose rule holds hides the weaker reading of the same words.
HIDES = {"BSD-3-Clause": "BSD-2-Clause"}

#: Each known sentence holds one of these, so that other sentences need not be normalised (a test holds this).
CUE = r"(?i)licen|permission|redistribut|warrant|compliance|neither|public domain|free software|rights reserved|spdx"
SENTENCE_END = r"[.!?;][^\p{L}\p{N}]+"
LINE_CUT = SENTENCE_END + r"|[\r\n]+"
FLOW_CUT = SENTENCE_END + r"|[\r\n][ \t]*[\r\n]+"


def rule_pattern(ids: tuple[str, ...]) -> str:
    """The rule as a regular expression over identifiers that each stand between spaces."""
    return " " + r" (?:\S+ )*".join(ids) + " "


def _known(sentences: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for name, sentence in SENTENCES for x in (sentence, name)])
    cued = F.filter(sentences, lambda s: s.rlike(CUE))
    named = F.transform(cued, lambda s: F.try_element_at(lookup, F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))))
    return F.array_join(F.filter(named, lambda s: s.isNotNull()), " ")


def sentence_ids(text: Column, flow: bool) -> Column:
    """The identifiers of a text's known sentences in text order, joined by a space."""
    return F.when(text.rlike(CUE), _known(F.split(text, FLOW_CUT if flow else LINE_CUT))).otherwise("")


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: keep's columns, line_ids, flow_ids, licenses (comma-joined in rule order), n_licenses."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, sentence_ids(body, False).alias("line_ids"), sentence_ids(body, True).alias("flow_ids"))

    def holds(ids: tuple[str, ...]) -> Column:
        at = rule_pattern(ids)
        return F.concat(F.lit(" "), "line_ids", F.lit(" ")).rlike(at) | F.concat(F.lit(" "), "flow_ids", F.lit(" ")).rlike(at)

    by_license: dict[str, list[tuple[str, ...]]] = {}
    for name, ids in RULES:
        by_license.setdefault(name, []).append(ids)

    def any_of(name: str) -> Column:
        found = F.lit(False)
        for ids in by_license[name]:
            found = found | holds(ids)
        for strong, weak in HIDES.items():
            if weak == name:
                found = found & ~any_of(strong)
        return found

    names = F.array(*[F.when(any_of(name), F.lit(name)) for name in by_license])
    has = (F.col("line_ids") != "") | (F.col("flow_ids") != "")
    found = F.when(has, F.filter(names, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("_found", found).select(
        *keep, "line_ids", "flow_ids", F.array_join("_found", ",").alias("licenses"), F.size("_found").cast("long").alias("n_licenses")
    )


def oracle() -> str:
    """The same scan in DuckDB's SQL."""
    known = "map {" + ", ".join(f"'{sentence}': '{name}'" for name, sentence in SENTENCES) + "}"
    def ids(body: str, cut: str) -> str:
        cued = f"list_filter(regexp_split_to_array({body}, '{cut}'), lambda s: regexp_matches(s, '{CUE}'))"
        named = f"list_transform({cued}, lambda s: known[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))])"
        return f"coalesce(array_to_string(list_filter({named}, lambda s: s IS NOT NULL), ' '), '')"

    def any_of(name: str) -> str:
        each = [f"regexp_matches(' ' || {c} || ' ', '{rule_pattern(i)}')" for n, i in RULES if n == name for c in ("line_ids", "flow_ids")]
        found = "(" + " OR ".join(each) + ")"
        for strong, weak in HIDES.items():
            if weak == name:
                found = f"({found} AND NOT {any_of(strong)})"
        return found

    names = list(dict.fromkeys(n for n, _ in RULES))
    found = "list_filter([" + ", ".join(f"CASE WHEN {any_of(n)} THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS t, {known} AS known FROM documents),
seqs AS (SELECT doc_id, {ids("t", LINE_CUT)} AS line_ids, {ids("t", FLOW_CUT)} AS flow_ids FROM body),
found AS (SELECT *, {found} AS f FROM seqs)
SELECT doc_id, line_ids, flow_ids, coalesce(array_to_string(f, ','), '') AS licenses, CAST(len(f) AS BIGINT) AS n_licenses FROM found"""
