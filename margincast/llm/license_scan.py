"""Licence recognition by sentence rules.

A text is normalised (ASCII letters lower-cased, marks to spaces) and its cuts
are marked: a sentence mark before white space, a blank line, a line break, a
colon or a semicolon.  A listed sentence stands between two cuts; a single
line break, a colon, a semicolon or the point of "v. 2.0" may also lie inside
it, as in wrapped notices (the longest listed sentence is taken).  It becomes
its identifier; all other text is dropped.  The identifier sequence is matched
against licence rules in their order: a rule names a licence and the sequence
of identifiers that must follow each other, and uses up what it matches, so a
long licence is not reported again through a shorter rule that is part of it.

Only DataFrame functions; the sentence table is a literal map (its size is
the table's, not the data's), so no row leaves its task.

Defined results: null or empty text has no sentences and no licence; repeated
sentences and rows repeat; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margincast.llm.common import LOWER, UPPER

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheDef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarr",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "the mit license": "MitTitle",
    "mit license": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitPerm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarr",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdPre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdWarr",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarr",
    "see the gnu general public license for more details": "GplSee",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MplRef",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MplCopy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscPerm",
    "this is free and unencumbered software released into the public domain": "UnlicensePre",
    "licensed under cc by 4 0": "CcByRef",
    "licensed under cc by sa 4 0": "CcBySaRef",
    "licensed under cc by nc 4 0": "CcByNcRef",
    "licensed under cc by nc sa 4 0": "CcByNcSaRef",
    "licensed under cc by nd 4 0": "CcByNdRef",
    "licensed under cc0 1 0": "Cc0Ref",
    "all rights reserved": "AllRights",
}
#: Fixed values, tried in this order: licence and its identifier sequence.
RULES = (
    ("Apache-2.0", ("ApacheDef", "ApacheUse", "ApacheCopy", "ApacheWarr", "ApacheSee")),
    ("Apache-2.0", ("ApacheRef", "ApacheUse", "ApacheCopy", "ApacheWarr", "ApacheSee")),
    ("BSD-3-Clause", ("BsdPre", "BsdSource", "BsdBinary", "BsdEndorse", "BsdWarr")),
    ("BSD-2-Clause", ("BsdPre", "BsdSource", "BsdBinary", "BsdWarr")),
    ("MIT", ("MitTitle", "MitPerm", "MitNotice", "MitWarr")),
    ("MIT", ("MitPerm", "MitNotice", "MitWarr")),
    ("GPL-3.0-or-later", ("Gpl3Later", "GplWarr", "GplSee")),
    ("GPL-2.0-or-later", ("Gpl2Later", "GplWarr", "GplSee")),
    ("MPL-2.0", ("MplRef", "MplCopy")),
    ("ISC", ("IscPerm", "MitWarr")),
    ("ISC", ("IscPerm",)),
    ("GPL-3.0-or-later", ("Gpl3Later",)),
    ("GPL-2.0-or-later", ("Gpl2Later",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("Apache-2.0", ("ApacheDef",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitRef",)),
    ("MPL-2.0", ("MplRef",)),
    ("Unlicense", ("UnlicensePre",)),
    ("CC-BY-4.0", ("CcByRef",)),
    ("CC-BY-SA-4.0", ("CcBySaRef",)),
    ("CC-BY-NC-4.0", ("CcByNcRef",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSaRef",)),
    ("CC-BY-ND-4.0", ("CcByNdRef",)),
    ("CC0-1.0", ("Cc0Ref",)),
    ("Proprietary", ("AllRights",)),
)
#: Sentence ends of the SQL version, which looks up only what lies between two
#: of them: a mark before white space or the end, a line break, or a colon or
#: semicolon.  "2.0" stays whole.
SENTENCE_END = r"[.!?]+(?:[\x20\x09-\x0D]|\z)|[\n:;]"
#: Cuts, in this order: a sentence may go on over a soft one (S), not over a
#: hard one (H).  Capitals are free for this in lower-cased text.
CUTS = (
    (r"(?<=[^a-z0-9]v)\.(?=[\x20\x09-\x0D]+[0-9])", "S"),
    (r"(?<![.!?])[.!?]+(?:[\x20\x09-\x0D]|\z)", "H"),
    # a line of ASCII marks alone is blank: comment signs
    (r"\n[\x20\t\r!-/:-@\[-`{-~]*\n", "H"),
    (r"[\n:;]", "S"),
)
#: Every listed sentence holds one of these, so other texts have no identifiers.
SIGNS = (r"licen[cs]e|permission|redistribution|copyright|warrant|free[^a-z0-9]+software|public[^a-z0-9]+domain"
         r"|rights[^a-z0-9]+reserved|mpl")


def sentence_ids(text: Column, table: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of ``text``, in order."""
    table = SENTENCES if table is None else table
    if not table:
        return F.array().cast("array<string>")
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    for pattern, mark in CUTS:
        low = F.regexp_replace(low, pattern, mark)
    normal = F.trim(F.regexp_replace(low, r"[^a-z0-9HS]+", " "))
    for pattern, mark in ((" ?H ?", "H"), (" ?S ?", "S")):
        normal = F.regexp_replace(normal, pattern, mark)
    listed = "|".join(s.replace(" ", "[ S]+") for s in sorted(table, key=lambda s: (-len(s), s)))
    known = F.regexp_extract_all(normal, F.lit(rf"(?<![^HS])(?:{listed})(?![^HS])"), F.lit(0))
    return F.transform(known, lambda s: F.element_at(lookup, F.regexp_replace(s, "[ S]+", " ")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  table: dict[str, str] | None = None, rules=RULES, signs: str | None = SIGNS) -> DataFrame:
    """Per document: ``n_sentences`` known, ``sentence_ids`` (comma-joined, in
    order), ``licenses`` (comma-joined, in rule order, each once) and
    ``unmatched`` (identifiers no rule used).  ``signs`` is a pattern that
    every sentence of ``table`` matches, or None."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    ids = sentence_ids(F.col("_t"), table)
    if signs is not None:
        ids = F.when(F.col("_t").rlike(f"(?i){signs}"), ids).otherwise(F.array().cast("array<string>"))
    df = docs.select(F.col(id_col).alias("doc_id"), raw.alias("_t")).select("doc_id", ids.alias("_ids"))
    # every identifier stands between its own commas: ",,A,,,,B,," - so a rule is a plain substring
    seq = F.concat(F.lit(""), F.array_join(F.transform("_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""))
    df = df.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"),
                   F.array_join("_ids", ",").alias("sentence_ids"), seq.alias("_s0"))
    hits = []
    for i, (_, names) in enumerate(rules):
        pattern = "".join(f"<{n}>" for n in names)
        df = df.withColumns({f"_h{i}": F.col(f"_s{i}").contains(pattern),
                             f"_s{i + 1}": F.replace(F.col(f"_s{i}"), F.lit(pattern), F.lit("|"))}).drop(f"_s{i}")
        hits.append(F.when(F.col(f"_h{i}"), F.lit(rules[i][0])))
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    rest = F.regexp_replace(F.regexp_replace(F.col(f"_s{len(rules)}"), r"\|", ""), r"><", ",")
    return df.select("doc_id", "n_sentences", "sentence_ids", F.array_join(found, ",").alias("licenses"),
                     F.regexp_replace(rest, "[<>]", "").alias("unmatched"))
