"""Operator 3 [native]: licence scans by sentence rules.

Texts lose comment leaders, are cut into parts at sentence ends and line feeds, normalised (lower case, runs of other characters
than a-z and 0-9 become one space) and mapped to identifiers of known licence sentences. A known sentence may go over several
parts of a paragraph, as in wrapped texts; a part that belongs to none is judged alone. Sentences that name a holder, a licence by
one of its names or SPDX identifiers are patterns over words. The identifiers of a text, in order, form a sequence; ordered rules then consume it: a
rule that matches names its licence and removes its part, so that a full licence text is found before a reference inside it.
Everything is one projection of column functions: no shuffle, no Python on the executors.

Defined cases: null or empty text has no sentence and verdict none; a part that speaks of a licence but is not known gives
the identifier u and, if no rule matches, the verdict unknown; a choice of licences in prose and an SPDX expression with an
identifier that is not listed are u; an expression of listed ones gives each. Repeats of a sentence count each time, its licence once;
repeated rows are judged alike; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences in normalised form, by identifier.
SENTENCES = {
    "apache_ref": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0"],
    "apache_use": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at"],
    "apache_asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit_ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd_intro": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl3_ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "ccbync_ref": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "ccby_ref": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "mpl_ref": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
# Names of licences as patterns over normalised words, by identifier; a name that also means other things is known in references only.
NAMES = {
    "apache_ref": "(?:the )?apache(?: software)? license(?: version| v)? ?2(?: 0)?|apache 2 0(?: license)?",
    "mit_ref": "(?:the )?mit licen[sc]e(?: mit)?",
    "gpl3plus_ref": "(?:the )?(?:gnu )?(?:general public license|gpl)(?: gpl)?(?: version| v)? ?v?3(?: 0)? or(?: any)? later(?: version)?",
    "gpl3_ref": "(?:the )?(?:gnu )?(?:general public license|gpl)(?: gpl)?(?: version| v)? ?v?3(?: 0)?(?: only| license)?",
    "gpl2_ref": "(?:the )?(?:gnu )?(?:general public license|gpl)(?: gpl)?(?: version| v)? ?v?2(?: 0)?(?: only| license)?",
    "lgpl3_ref": "(?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?: lgpl)?(?: version| v)? ?v?3(?: 0)?(?: only| license)?",
    "lgpl21_ref": "(?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?: lgpl)?(?: version| v)? ?v?2 1(?: only| license)?",
    "ccbync_ref": "(?:a |the )?(?:creative commons attribution non ?commercial|cc by nc) 4 0(?: international)?(?: public)?(?: license)?(?: cc by nc 4 0)?",
    "ccbysa_ref": "(?:a |the )?(?:creative commons attribution share ?alike|cc by sa) 4 0(?: international)?(?: public)?(?: license)?(?: cc by sa 4 0)?",
    "ccby_ref": "(?:a |the )?(?:creative commons attribution|cc by) 4 0(?: international)?(?: public)?(?: license)?(?: cc by 4 0)?",
    "cc0_ref": "(?:the )?(?:creative commons zero|cc0)(?: v)? ?1 0(?: universal)?(?: license)?",
    "mpl_ref": "(?:the )?(?:mozilla public license|mpl)(?: version| v)? ?2 0(?: license)?",
    "bsd3_ref": "(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?",
    "bsd2_ref": "(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?",
    "isc_ref": "(?:the )?isc license",
}
# SPDX identifiers in normalised form.
SPDX = {
    "mit": "mit_ref", "apache 2 0": "apache_ref", "gpl 3 0 or later": "gpl3plus_ref", "gpl 3 0 only": "gpl3_ref", "gpl 3 0": "gpl3_ref", "gpl 2 0 only": "gpl2_ref", "gpl 2 0": "gpl2_ref",
    "lgpl 3 0 only": "lgpl3_ref", "lgpl 3 0": "lgpl3_ref", "lgpl 2 1 only": "lgpl21_ref", "lgpl 2 1": "lgpl21_ref", "bsd 2 clause": "bsd2_ref", "bsd 3 clause": "bsd3_ref", "mpl 2 0": "mpl_ref",
    "isc": "isc_ref", "cc by 4 0": "ccby_ref", "cc by sa 4 0": "ccbysa_ref", "cc by nc 4 0": "ccbync_ref", "cc0 1 0": "cc0_ref",
}
# Sentences with free words in them.
FREE = {
    "bsd_names": "neither the names? of (?:[a-z0-9]+ ){1,20}may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_adv": "all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?: [a-z0-9]+){0,30}",
    "mit_grant": "(?:the )?mit license (?:[a-z0-9]+ ){0,30}" + SENTENCES["mit_grant"][0],
}
# Ordered licence rules, licence and pattern over ;identifier; sequences.
RULES = [
    ("Apache-2.0", "(;apache_ref;)?(;u;)*;apache_use;(;u;)*;apache_copy;(;u;)*(;apache_asis;)?"),
    ("MIT", "(;mit_ref;)?(;u;)*;mit_grant;(;u;)*;mit_notice;(;u;)*(;mit_asis;)?"),
    ("BSD-4-Clause", ";bsd_intro;(;u;)*;bsd_source;(;u;)*;bsd_binary;(;u;)*;bsd_adv;(;u;)*;bsd_names;"),
    ("BSD-3-Clause", "(;bsd3_ref;)?(;u;)*;bsd_intro;(;u;)*;bsd_source;(;u;)*;bsd_binary;(;u;)*;bsd_names;"),
    ("BSD-2-Clause", "(;bsd2_ref;)?(;u;)*;bsd_intro;(;u;)*;bsd_source;(;u;)*;bsd_binary;"),
    ("GPL-3.0-or-later", ";gpl_free;(;u;)*(;gpl_hope;)?"),
    ("ISC", "(;isc_ref;)?(;u;)*;isc_grant;"),
    ("Apache-2.0", ";apache_ref;"),
    ("CC-BY-NC-4.0", ";ccbync_ref;"),
    ("CC-BY-SA-4.0", ";ccbysa_ref;"),
    ("CC-BY-4.0", ";ccby_ref;"),
    ("CC0-1.0", ";cc0_ref;"),
    ("GPL-3.0-or-later", ";gpl3plus_ref;"),
    ("GPL-3.0-only", ";gpl3_ref;"),
    ("GPL-2.0-only", ";gpl2_ref;"),
    ("LGPL-3.0-only", ";lgpl3_ref;"),
    ("LGPL-2.1-only", ";lgpl21_ref;"),
    ("MIT", ";mit_ref;"),
    ("MPL-2.0", ";mpl_ref;"),
    ("BSD-3-Clause", ";bsd3_ref;"),
    ("BSD-2-Clause", ";bsd2_ref;"),
    ("ISC", ";isc_ref;"),
    ("Unlicense", ";unlicense;"),
]
#: A known or unknown licence sentence holds one of these.
CUE = "licen[sc]e|permission|redistribut|copyright|free software|warranty|(released|distributed|available|published) under|public domain|creative commons|spdx"


#: Parts meet at a line feed, paragraphs at this character.
_PARAGRAPH = "\x01"


def parts(text: Column) -> Column:
    """The normalised text: parts, cut at sentence ends and line feeds, joined by line feeds; blank lines become paragraph marks."""
    lines = F.regexp_replace(F.lower(text), r"(?md)^[^a-z0-9\n]+", "")  # comment leaders, indents, list marks
    cut = F.regexp_replace(F.regexp_replace(lines, r"\n{2,}", _PARAGRAPH), r"([.!?;:])[ \t\r\n]+", "$1\n")
    return F.trim(F.regexp_replace(F.regexp_replace(cut, r"[^a-z0-9\n\x01]+", " "), r" *([\n\x01]) *", "$1"))


#: A reference: what is licensed, how, the licence's name, and where to read on.
_LEAD = "(?:(?:this|the|all|our) (?:[a-z0-9]+ ){1,5}?(?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|published|provided)(?: to you)? under (?:the )?(?:terms of )?"
_TAIL = "(?: (?:see|as|which|found|in)(?: [a-z0-9]+){1,20})?"
_SPDX = "|".join(sorted(SPDX, key=len, reverse=True))
SPDX_LINE = f"spdx license identifier (?:{_SPDX})(?: (?:or|and) (?:{_SPDX}))*"


def patterns() -> list[tuple[str, str]]:
    """Identifier and pattern over words, in order of trial."""
    bare = {"mit_ref": f"|{_LEAD.replace('(?:the )?', '')}mit{_TAIL}"}  # a name in references only, and without an article
    return [*FREE.items()] + [(k, f"(?:{names})|{_LEAD}(?:{names}){_TAIL}{bare.get(k, '')}") for k, names in NAMES.items()]


def _known(gap: str) -> str:
    """Pattern of all known sentences whose words stand apart by gap, longest texts first."""
    texts = sorted((t for texts in SENTENCES.values() for t in texts), key=len, reverse=True)
    return "|".join([*texts, *[f"(?:{p})" for _, p in patterns()], SPDX_LINE]).replace(" ", gap)


def _units() -> str:
    """Pattern of a known sentence over one or several whole parts of a paragraph, or else of one part."""
    return r"(?<![^\n\x01])(?:(?:%s)(?![^\n\x01])|[^\n\x01]+)" % _known(r"[ \n]")


def sentence_ids(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, texts in SENTENCES.items() for t in texts for x in (t, k)])
    spdx = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    units = F.transform(F.regexp_extract_all(parts(text), F.lit(_units()), F.lit(0)), lambda s: F.translate(s, "\n", " "))

    def ids(s: Column) -> Column:
        found = F.try_element_at(known, s)
        for k, p in patterns():
            found = F.coalesce(found, F.when(s.rlike(f"^(?:{p})$"), F.lit(k)))
        several = F.transform(F.regexp_extract_all(F.regexp_replace(s, "^spdx license identifier ", ""), F.lit(_SPDX), F.lit(0)), lambda x: F.try_element_at(spdx, x))
        one = F.coalesce(found, F.when(s.rlike("(^| )licen[sc]e"), F.lit("u")))
        return F.when(s.rlike(f"^{SPDX_LINE}$"), several).otherwise(F.array(one))

    none = F.array().cast("array<string>")
    return F.when(F.lower(text).rlike(CUE), F.filter(F.flatten(F.transform(units, ids)), lambda x: x.isNotNull())).otherwise(none)


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids, licenses (arrays) and verdict (none, unknown or known) of every row."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(sentence_ids(F.col(text)), F.array().cast("array<string>")).alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern")) for name, pattern in RULES])
    start = F.struct(F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(F.lit(";"), x, F.lit(";")))).alias("rest"), F.array().cast("array<string>").alias("names"))

    def consume(acc: Column, rule: Column) -> Column:
        names = F.when(F.regexp_like(acc["rest"], rule["pattern"]), F.array_append(acc["names"], rule["name"])).otherwise(acc["names"])
        return F.struct(F.regexp_replace(acc["rest"], rule["pattern"], F.lit("")).alias("rest"), names.alias("names"))

    names = F.when(F.size("sentence_ids") > 0, F.array_distinct(F.aggregate(rules, start, consume)["names"])).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("licenses", names)
    verdict = F.when(F.size("licenses") > 0, "known").when(F.size("sentence_ids") > 0, "unknown").otherwise("none")
    return found.withColumn("verdict", verdict)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"), "verdict")


def _oracle() -> str:
    known = ", ".join(f"'{t}': '{k}'" for k, texts in SENTENCES.items() for t in texts)
    spdx = ", ".join(f"'{t}': '{k}'" for t, k in SPDX.items())
    tried = " ".join(f"WHEN regexp_full_match(x, '{p}') THEN '{k}'" for k, p in patterns())
    gap = r"(?: |\n\n)"
    steps, last = [], "q0"
    for i, (name, pattern) in enumerate(RULES):
        steps.append(f"q{i + 1} AS (SELECT doc_id, ids, regexp_replace(rest, '{pattern}', '', 'g') AS rest, CASE WHEN regexp_matches(rest, '{pattern}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"q{i + 1}"
    # every part stands between two line feeds of its own, so that no look-around is needed
    return rf"""
WITH c AS (SELECT doc_id, regexp_matches(lower(text), '{CUE}') AS cue, regexp_replace(lower(text), '(?m)^[^a-z0-9\n]+', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, cue, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\n{{2,}}', chr(1), 'g'), '([.!?;:])[ \t\r\n]+', E'\\1\n', 'g'), '[^a-z0-9\n\x01]+', ' ', 'g'), ' *([\n\x01]) *', '\1', 'g')) AS t FROM c),
n AS (SELECT doc_id, CASE WHEN cue THEN regexp_extract_all(chr(10) || replace(replace(t, chr(10), chr(10) || chr(10)), chr(1), chr(10) || chr(1) || chr(10)) || chr(10), '\n(?:{_known(gap)})\n|\n[^\n\x01]+\n') ELSE [] END AS s FROM p),
m AS (SELECT doc_id, list_transform(s, lambda x: trim(replace(x, chr(10) || chr(10), ' '), chr(10))) AS s FROM n),
i AS (SELECT doc_id, list_filter(flatten(list_transform(s, lambda x: CASE WHEN regexp_full_match(x, '{SPDX_LINE}') THEN list_transform(regexp_extract_all(regexp_replace(x, '^spdx license identifier ', ''), '{_SPDX}'), lambda y: map_extract_value(MAP {{{spdx}}}, y))
   ELSE [coalesce(map_extract_value(MAP {{{known}}}, x), CASE {tried} WHEN regexp_matches(x, '(^| )licen[sc]e') THEN 'u' END)] END)), lambda x: x IS NOT NULL) AS ids FROM m),
q0 AS (SELECT doc_id, coalesce(ids, []) AS ids, array_to_string(list_transform(ids, lambda x: ';' || x || ';'), '') AS rest, CAST([] AS VARCHAR[]) AS names FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licenses,
  CASE WHEN len(names) > 0 THEN 'known' WHEN len(ids) > 0 THEN 'unknown' ELSE 'none' END AS verdict FROM {last}
"""


ORACLE = _oracle()
