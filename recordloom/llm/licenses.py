"""License scans by sentence rules, with built-in functions only.

A text is cut at marks and line ends into pieces, the pieces are normalised (small letters and digits, single spaces), and known
license sentences become identifiers. A sentence may go on over single line ends, with or without comment marks, and over ':'
and ';'; it never goes over a blank line or '.', '!' or '?' before white space. Ordered rules are then matched against the sequence of identifiers; what a rule matches is
taken out before the next rule is tried, so a whole license counts before its parts do.

Results for odd input: a null or empty text has no sentences and no licenses; repeated rows are scanned alike; a known sentence
that no rule takes stays in ``unmatched``; other columns are neither read nor changed; an empty table gives an empty result.
Texts of any length are scanned whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of published licenses, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheTerms",
    "spdx license identifier apache 2 0": "ApacheSpdx",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "mit license": "MitTitle",
    "the mit license": "MitTitle",
    "the mit license mit": "MitTitle",
    "spdx license identifier mit": "MitSpdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitAsIs",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplHope",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "spdx license identifier gpl 3 0 only": "Gpl3Spdx",
    "spdx license identifier gpl 3 0 or later": "Gpl3LaterSpdx",
    "licensed under cc by nc 4 0": "CcByNc4Ref",
    "licensed under cc by 4 0": "CcBy4Ref",
    "licensed under cc by sa 4 0": "CcBySa4Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4Ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4Ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNoEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdAsIs",
}
#: A known sentence has one of these, so that a text without them needs no cutting.
TRIGGERS = ("licen", "permi", "redistribut", "copyright notice", "warrant", "free software")
# Ordered rules: the license and the identifiers that it takes; parts in brackets may be missing.
RULES = [
    ("Apache-2.0", "ApacheRef (?:ApacheUse )?(?:ApacheCopy )?(?:ApacheUrl )?ApacheAsIs (?:ApacheTerms )?"),
    ("MIT", "(?:MitTitle )?MitGrant MitNotice (?:MitAsIs )?"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdNoEndorse (?:BsdAsIs )?"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary (?:BsdAsIs )?"),
    ("GPL-3.0-or-later", "Gpl3Later (?:GplHope )?(?:GplSee )?(?:GplReceived )?"),
    ("GPL-2.0-or-later", "Gpl2Later (?:GplHope )?(?:GplSee )?(?:GplReceived )?"),
    ("Apache-2.0", "ApacheSpdx |ApacheRef (?:ApacheCopy )?(?:ApacheUrl )?"),
    ("MIT", "MitSpdx |MitRef |MitTitle "),
    ("GPL-3.0-only", "Gpl3Spdx |Gpl3Ref "),
    ("GPL-3.0-or-later", "Gpl3LaterSpdx "),
    ("GPL-2.0-only", "Gpl2Ref "),
    ("CC-BY-NC-4.0", "CcByNc4Ref "),
    ("CC-BY-SA-4.0", "CcBySa4Ref "),
    ("CC-BY-4.0", "CcBy4Ref "),
]
#: Where a piece ends: a line end, or a mark before white space. The SQL knows sentences of one piece only.
BREAK = r"[.!?;:]*[ \t\r]*\n\s*|[.!?;:]+[ \t\r]+"
ODD = "[^a-z0-9]+"
#: Where a sentence ends for certain, and where it ends unless a known one goes on: H and S in a text of small letters.
HARD = r"(?<![.!?;:])(?=[;:]*+[.!?])[.!?;:]++(?=[ \t\r\n])|\n[^a-z0-9\n]*+(?=\n)"
SOFT = r"(?<![.!?;:])[;:]++(?=[ \t\r\n])|\n"
#: A known sentence of one or more whole pieces, longest first.
KNOWN = "(?<![a-z0-9 ])(" + "|".join(s.replace(" ", "[ S]") for s in sorted(SENTENCES, key=len, reverse=True)) + ")(?![a-z0-9 ])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    pieces = F.regexp_replace(F.regexp_replace(F.regexp_replace(lowered, HARD, "H"), SOFT, "S"), "[^a-z0-9HS]+", " ")
    pieces = F.trim(F.regexp_replace(F.regexp_replace(pieces, "(?<![ S])[ S]*+H[ SH]*+", "H"), "(?<! ) ?S[ S]*+", "S"))
    ids = F.transform(F.regexp_extract_all(pieces, F.lit(KNOWN), 1), lambda s: F.element_at(known, F.translate(s, "S", " ")))
    worth_cutting = reduce(or_, [F.contains(lowered, F.lit(t)) for t in TRIGGERS])
    return F.when(worth_cutting, ids).otherwise(F.array().cast("array<string>"))


def recognised(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with license_sentences, licenses (in rule order, each once) and unmatched (identifiers no rule takes)."""
    out = docs.withColumn("license_sentences", sentence_ids(F.col(text)))
    rest = F.concat_ws("", F.transform("license_sentences", lambda i: F.concat(i, F.lit(" "))))
    steps = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("found"))
    for license_id, rule in RULES:
        steps = apply_rule(steps, license_id, rf"\b(?:{rule})")
    done = F.when(F.size("license_sentences") > 0, steps)
    out = out.withColumn("_done", done)
    none = F.array().cast("array<string>")
    unmatched = F.filter(F.split(F.col("_done.rest"), " "), lambda i: i != "")
    return out.withColumns({"licenses": F.coalesce(F.array_distinct("_done.found"), none), "unmatched": F.coalesce(unmatched, none)}).drop("_done")


def apply_rule(state: Column, license_id: str, rule: str) -> Column:
    """Take what the rule matches out of the rest and add the license."""
    step = lambda s: F.when(s["rest"].rlike(rule), F.struct(F.regexp_replace(s["rest"], rule, "").alias("rest"), F.concat(s["found"], F.array(F.lit(license_id))).alias("found"))).otherwise(s)
    return F.transform(F.array(state), step)[0]


def license_report(docs: DataFrame) -> DataFrame:
    found = recognised(docs.select("doc_id", "text"))
    return found.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"), F.array_join("license_sentences", " ").alias("sentences"), F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", " ").alias("unmatched"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    """The same in SQL: a chain of subqueries, one per rule."""
    known = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(i)}" for s, i in SENTENCES.items()) + "}"
    sql = f"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), {quoted(BREAK)}),
        lambda s: {known}[trim(regexp_replace(s, {quoted(ODD)}, ' ', 'g'))]), lambda i: i IS NOT NULL) AS ids FROM documents"""
    sql = f"SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: i || ' '), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM ({sql})"
    for license_id, rule in RULES:
        pattern = quoted(rf"\b(?:{rule})")
        sql = f"""SELECT doc_id, ids, regexp_replace(rest, {pattern}, '', 'g') AS rest,
            CASE WHEN regexp_matches(rest, {pattern}) AND NOT list_contains(found, {quoted(license_id)}) THEN list_append(found, {quoted(license_id)}) ELSE found END AS found FROM ({sql})"""
    return f"""SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentences,
        coalesce(array_to_string(found, ','), '') AS licenses, trim(coalesce(rest, '')) AS unmatched FROM ({sql})"""
