"""Licence scan by sentence rules, in DataFrame functions alone.

Comment marks at line starts (// # * ; -- /* <!-- % >) are removed. A text is cut into
units at blank lines, after . ! ? before white space, and after a line's closing colon;
a unit may run over several lines, as wrapped licence texts do. Units are normalised:
lower case, all but a-z and 0-9 to single blanks. A unit equal to a known licence
sentence, as it stands or without a subject such as 'this project is', becomes its
identifier; any other unit is cut at its line ends and its lines are looked up alike. The
sequence of identifiers (sentences without one are left out) is then matched
against the rules in their order: wherever a rule's identifiers stand next to
each other, that run is taken as one find of the rule's licence, and later rules
see only what is left. Identifiers that no rule takes are counted as unmatched.

Everything happens within the row, so there is no shuffle and no group: copies,
hot sources and repeated ids cost nothing extra. Null and empty texts have no
sentence. The tables are bounded by the module, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licence sentences in normalised form and the identifiers they carry.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("ApacheRef", "licensed under the apache license version 2 0"),
    ("ApacheRefThe", "licensed under the apache license version 2 0 the license"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheObtain", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", "released under the mit license"),
    ("MitRefLic", "licensed under the mit license"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("GplRef3", "this work is licensed under the gnu general public license version 3"),
    ("GplRef2", "this work is licensed under the gnu general public license version 2"),
    ("GplFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplNoWarranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("CcByNc4", "licensed under cc by nc 4 0"),
    ("CcBy4", "licensed under cc by 4 0"),
    ("CcBySa4", "licensed under cc by sa 4 0"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("Reserved", "all rights reserved"),
    ("ApacheRefUse", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("ApacheRef", "licensed under the apache license 2 0"),
    ("ApacheRef", "released under the apache license version 2 0"),
    ("ApacheRef", "distributed under the apache license version 2 0"),
    ("MitRefDist", "distributed under the mit license"),
    ("MitRefTerms", "licensed under the terms of the mit license"),
    ("GplRef3", "licensed under the gnu general public license version 3"),
    ("GplRef2", "licensed under the gnu general public license version 2"),
    ("GplFree2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("BsdAsIs", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BsdName", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
)
# Ordered rules (licence, identifiers in sequence); longer ones first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("ApacheRefThe", "ApacheUse", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheRefUse", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheRefThe", "ApacheUse", "ApacheObtain")),
    ("Apache-2.0", ("ApacheRefUse", "ApacheObtain")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdName", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdName")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("GplFree", "GplNoWarranty")),
    ("GPL-2.0-or-later", ("GplFree2", "GplNoWarranty")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("Apache-2.0", ("ApacheRef",)),
    ("Apache-2.0", ("ApacheRefThe",)),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitRefLic",)),
    ("MIT", ("MitRefDist",)),
    ("MIT", ("MitRefTerms",)),
    ("MIT", ("MitGrant",)),
    ("Apache-2.0", ("ApacheRefUse",)),
    ("GPL-3.0-only", ("GplRef3",)),
    ("GPL-2.0-only", ("GplRef2",)),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("GPL-2.0-or-later", ("GplFree2",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("proprietary", ("Reserved",)),
)
# line starts lose comment marks, and units end with a form feed
MARKS = r"(^|\n)[ \t]*(?:/\*+|\*+/|<!--|-->|//+|--+|#+|\*+|;+|%+|>+)?[ \t\r]*"
ENDS = r"([.!?])[ \t\r\n]+|(:)[ \t\r]*\n|\n\n+"
SUBJECT = "^(?:this|the) (?:project|software|work|file|code|program|library|package|repository|module|document|source code) is "


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """A row per row of docs: doc_id, n_known (sentences with an identifier),
    identifiers (in order, joined by blanks), n_matched (finds of rules),
    licences (distinct, sorted, joined by commas), n_unmatched."""
    known = F.create_map(*[F.lit(x) for name, norm in sentences for x in (norm, name)])
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    text_ = F.regexp_replace(F.replace(F.coalesce("__text", F.lit("")), F.lit("\f"), F.lit(" ")), MARKS, "$1")
    units = F.split(F.regexp_replace(text_, ENDS, "$1$2\f"), "\f", -1)
    norm = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    name = lambda s: F.coalesce(F.element_at(known, s), F.element_at(known, F.regexp_replace(s, SUBJECT, "")))
    lines = lambda s: F.transform(F.split(s, "\n", -1), lambda x: name(norm(x)))
    ids = F.transform(units, lambda s: F.when(name(norm(s)).isNotNull(), F.array(name(norm(s)))).when(s.contains("\n"), lines(s)).otherwise(F.array().cast("array<string>")))
    ids = F.filter(F.flatten(ids), lambda s: s.isNotNull())
    d = d.select("doc_id", ids.alias("__ids"))
    d = d.withColumn("__left", F.array_join(F.transform("__ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""))
    for name, seq in rules:
        d = d.withColumn("__left", F.replace("__left", F.lit("".join(f"<{s}>" for s in seq)), F.lit("{" + name + "}")))
    finds = F.regexp_extract_all("__left", F.lit(r"\{([^}]*)\}"), F.lit(1))
    return d.select("doc_id", F.size("__ids").alias("n_known"), F.array_join("__ids", " ").alias("identifiers"), F.size(finds).alias("n_matched"),
                    F.array_join(F.array_sort(F.array_distinct(finds)), ",").alias("licences"), F.regexp_count("__left", F.lit("<")).alias("n_unmatched"))


def scan_sql(sentences=SENTENCES, rules=RULES) -> str:
    """The same in DuckDB SQL over ``documents``."""
    keys = ", ".join(f"'{n}'" for _, n in sentences)
    vals = ", ".join(f"'{i}'" for i, _ in sentences)
    left = "array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '')"
    for name, seq in rules:
        left = f"replace({left}, '{''.join(f'<{s}>' for s in seq)}', '{{{name}}}')"
    at = lambda x: f"coalesce(list_position(keys, {x}), list_position(keys, regexp_replace({x}, '{SUBJECT}', '')))"
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH bare AS (
  SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(12), ' '), '{MARKS}', '\\1', 'g') AS t, [{keys}] AS keys FROM documents),
cut AS (SELECT doc_id, keys, string_split(regexp_replace(t, '{ENDS}', '\\1\\2' || chr(12), 'g'), chr(12)) AS units FROM bare),
placed AS (SELECT doc_id, flatten(list_transform(units, lambda u: CASE WHEN {at(norm('u'))} IS NOT NULL THEN [{at(norm('u'))}]
    WHEN contains(u, chr(10)) THEN list_transform(string_split(u, chr(10)), lambda x: {at(norm('x'))}) ELSE [] END)) AS ps FROM cut),
mapped AS (SELECT doc_id, list_transform(list_filter(ps, lambda p: p IS NOT NULL), lambda p: ([{vals}])[p]) AS ids FROM placed),
ruled AS (SELECT doc_id, ids, {left} AS lft FROM mapped),
found AS (SELECT doc_id, ids, lft, regexp_extract_all(lft, '\\{{([^}}]*)\\}}', 1) AS finds FROM ruled)
SELECT doc_id, CAST(len(ids) AS INT) AS n_known, array_to_string(ids, ' ') AS identifiers, CAST(len(finds) AS INT) AS n_matched,
       array_to_string(list_sort(list_distinct(finds)), ',') AS licences, CAST(length(lft) - length(replace(lft, '<', '')) AS INT) AS n_unmatched
FROM found"""
