"""License scans by sentence rules.

A text is cut into sentences, each is normalised (ASCII lower case, everything but letters and digits to single
spaces) and mapped to the identifier of a known licence sentence, if it is one. The sequence of identifiers is then
matched against ordered rules, longer rules first; what a rule has matched is used up.

Texts are cut three times: at line ends and sentence ends, which finds notices on their own line; at sentence ends only,
which finds sentences wrapped over lines; and by paragraphs, which finds headers in their usual layout. There a line without
letters and digits (comment marks may stand in it) and a line with nothing but a url end a sentence; a colon, a semicolon and
the start of such a url may end one, so up to ``SPAN`` pieces between them are also tried as one sentence. A rule whose
sequence is a part of a longer one (BSD-2-Clause of BSD-3-Clause) counts only if no cut finds the longer one in its stead.
Besides, every ``SPDX-License-Identifier:`` tag names the licences of its expression. Everything runs
inside one narrow pass; only texts that hold one of the hint words, of which every known sentence has one, are cut at all.

Defined results: null, empty and other texts without known sentences have no licences (an empty list, 0 sentences); very
long texts are cut whole; repeated rows get equal results; an empty table gives none; other columns of the input are not
read, so no name clashes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Known sentences, normalised; an identifier is a place in this list, from 1. Fixed values.
SENTENCES = [
    "licensed under the apache license version 2 0",
    "released under the mit license",
    "this work is licensed under the gnu general public license version 3",
    "licensed under cc by nc 4 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "you should have received a copy of the gnu general public license along with this program",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "this source code form is subject to the terms of the mozilla public license v",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "this is free and unencumbered software released into the public domain",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
]
#: Names that differ from notice to notice: (pattern, a blank being anything but letters and digits; the usual wording). Fixed values.
VARIABLE = [(r"neither the names? of [\s\S]{1,160}? nor the names of (?:its|their|any) contributors", "neither the name of the copyright holder nor the names of its contributors"), (r"the names? of (?:the )?(?:authors?|[\s\S]{1,80}?) may not be used to endorse", "the name of the author may not be used to endorse")]
#: Creative Commons: (part of the name, its sentence's words), versions with their kind. Fixed values.
CC_PARTS = [("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-ND", "attribution noderivatives"), ("BY-NC", "attribution noncommercial"), ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives")]
CC_KINDS = [("4.0", "international"), ("3.0", "unported")]
#: GNU: (licence, its name, what carries it, versions). Fixed values.
GNU = [("GPL", "general", ["program", "file"], ["2", "3"]), ("LGPL", "lesser general", ["library", "program"], ["2.1", "3"]), ("AGPL", "affero general", ["program"], ["3"])]
#: (licence, identifiers in order): fixed values.
RULES = [
    ("Apache-2.0", [1]), ("MIT", [2]), ("GPL-3.0", [3]), ("CC-BY-NC-4.0", [4]), ("Apache-2.0", [5, 6, 7]), ("MIT", [8, 9]),
    ("BSD-2-Clause", [10, 11]), ("MIT", [12]), ("Apache-2.0", [13]), ("GPL-3.0-or-later", [14, 15]), ("CC-BY-4.0", [16]),
    ("Apache-2.0", [5, 6, 17]), ("BSD-3-Clause", [10, 11, 18]), ("ISC", [19]), ("ISC", [20]), ("MPL-2.0", [21, 22]), ("MPL-2.0", [21, 23]), ("Unlicense", [24]), ("BSD-3-Clause", [10, 11, 25]),
]


def _place(sentence: str) -> int:
    """The identifier of a sentence, which joins the list if it is new."""
    if sentence not in SENTENCES:
        SENTENCES.append(sentence)
    return SENTENCES.index(sentence) + 1


def _rule(name: str, *sentences: str) -> None:
    rule = (name, [_place(s) for s in sentences])
    if rule not in RULES:
        RULES.append(rule)


for _part, _words in CC_PARTS:
    for _v, _kind in CC_KINDS:
        _rule(f"CC-{_part}-{_v}", f"licensed under cc {_part.lower().replace('-', ' ')} {_v.replace('.', ' ')}")
        for _to in ("a", "the"):
            _rule(f"CC-{_part}-{_v}", f"this work is licensed under {_to} creative commons {_words} {_v.replace('.', ' ')} {_kind} license")
for _short, _name, _things, _versions in GNU:
    for _thing in _things:
        _copy = f"you should have received a copy of the gnu {_name} public license along with this {_thing}"
        _free = f"this {_thing} is free software you can redistribute it and or modify it under the terms of the gnu {_name} public license"
        for _v in _versions:
            _n, _spoken = _v if "." in _v else f"{_v}.0", _v.replace(".", " ")
            _rule(f"{_short}-{_n}-or-later", f"{_free} as published by the free software foundation either version {_spoken} of the license or at your option any later version", _copy)
            for _comma in ("version", "as published by the free software foundation version"):
                _tail = " as published by the free software foundation" if _comma == "version" else " of the license"
                _rule(f"{_short}-{_n}-only", f"{_free} {_comma} {_spoken}{_tail}")
#: Every SPDX expression is read by this pattern; its licences are the words that are not operators.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+:()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+:()-]+)*)"


def hints_of(known: list[str]) -> list[str]:
    """Few words such that every known sentence has one of them: always the word that the most sentences without one have."""
    rest, out = [set(k.split()) for k in known if k], []
    while rest:
        count: dict[str, int] = {}
        for words in rest:
            for w in words:
                count[w] = count.get(w, 0) + 1
        # long words are rarer in other texts, so three letters more outweigh half of the sentences
        best = max(sorted(count), key=lambda w: count[w] * 2.0 ** (min(len(w), 12) / 3))
        out.append(best)
        rest = [words for words in rest if best not in words]
    return out


HINTS = hints_of(SENTENCES)
#: Most pieces between colons, semicolons and urls that one known sentence may have.
SPAN = 3


def sentences(text: Column, wrapped: bool) -> Column:
    """Normalised sentences of a text; with ``wrapped``, line ends do not end a sentence."""
    cut = F.regexp_replace(F.regexp_replace(text, r"[\n\r]+", " ") if wrapped else text, r"([.!?])[ \t]+", "$1\n")
    parts = F.split(ascii_lower(cut), r"[\n\r]+")
    return F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")))


def _listed(places: Column) -> Column:
    """Places in the list of known sentences, each between commas, without the zeros."""
    return F.array_join(F.transform(F.filter(places, lambda k: k > 0), lambda k: F.concat(F.lit(","), k.cast("string"), F.lit(","))), "")


def identifiers(text: Column, wrapped: bool, known: list[str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order, each between commas: ``,5,,6,``; empty if there are none."""
    table = F.array(*[F.lit(k) for k in known])
    return _listed(F.transform(sentences(text, wrapped), lambda s: F.array_position(table, s)))


def paragraph_identifiers(text: Column, known: list[str] = SENTENCES) -> Column:
    """``identifiers`` of a text cut by paragraphs: at ``\\r`` a sentence ends, at ``\\x01`` it may end."""
    table, mark = F.array(*[F.lit(k) for k in known]), r"[^\p{L}\p{N}\n\r]*"
    cut = F.regexp_replace(ascii_lower(text), r"\r\n?", "\n")
    for pattern, usual in VARIABLE:
        cut = F.regexp_replace(cut, re.sub(" ", r"[^\\p{L}\\p{N}]+", pattern), usual)
    cut = F.regexp_replace(cut, r"\n[^\p{L}\p{N}]*\n", "\r")
    cut = F.regexp_replace(cut, rf"[\n\r]{mark}(https?://\S+){mark}(?=[\n\r]|\z)", "\x01$1\r")
    cut = F.regexp_replace(F.regexp_replace(cut, r"[:;](?=\s)", "\x01"), r"[.!?]\s+", "\r")
    pieces = lambda s: F.array_remove(F.transform(F.split(s, "\x01"), lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))), "")

    def places(p: Column) -> Column:
        place = lambda x, i, n: F.array_position(table, F.array_join(F.slice(p, i + 1, n), " "))
        return F.transform(p, lambda x, i: F.coalesce(*[F.nullif(place(x, i, n), F.lit(0)) for n in range(SPAN, 0, -1)], F.lit(0)))

    return _listed(F.flatten(F.transform(F.transform(F.split(cut, "\r"), pieces), places)))


def matched(ids: Column, rules=RULES) -> Column:
    """Licences whose rule occurs in a sequence of identifiers: longer rules first, each using up what it matched."""
    ordered = [F.struct(F.lit(name).alias("name"), F.lit("".join(f",{k}," for k in sequence)).alias("mark")) for name, sequence in sorted(rules, key=lambda r: -len(r[1]))]
    if not ordered:
        return F.array().cast("array<string>")
    start = F.struct(ids.alias("rest"), F.array().cast("array<string>").alias("found"))

    def used(so_far: Column, rule: Column) -> Column:
        after = F.struct(F.replace(so_far["rest"], rule["mark"], F.lit("|")).alias("rest"), F.concat(so_far["found"], F.array(rule["name"])).alias("found"))
        return F.when(F.contains(so_far["rest"], rule["mark"]), after).otherwise(so_far)

    return F.when(ids != "", F.aggregate(F.array(*ordered), start, used, lambda x: x["found"])).otherwise(F.array().cast("array<string>"))


def spdx(text: Column) -> Column:
    """Names in the SPDX tags of a text; what follows WITH is an exception, not a licence."""
    tags = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda e: F.regexp_replace(e, r"(?i)[ \t]+WITH[ \t]+[A-Za-z0-9.+:-]+", ""))
    names = F.flatten(F.transform(tags, lambda e: F.split(F.regexp_replace(e, r"(?i)[ \t]+(?:AND|OR)[ \t]+|[()]", " "), " ")))
    return F.array_remove(F.transform(names, lambda n: F.regexp_replace(n, r"[.:-]+$", "")), "")


def _contained(rules) -> list[tuple[str, str]]:
    """Pairs (short, long) of licences where a rule of the first is a part of a rule of the second."""
    part = lambda a, b: len(a) < len(b) and any(b[k : k + len(a)] == a for k in range(len(b)))
    return sorted({(n, m) for n, a in rules for m, b in rules if n != m and part(a, b)})


def scan(docs: DataFrame, known: list[str] = SENTENCES, rules=RULES, hints: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sequence, n_sentences, licenses``: identifiers as cut by lines, known sentences among them, and sorted licence names.

    ``hints``: lower-case words of which every known sentence has one; found from the sentences if not given.
    """
    text, low = F.coalesce(F.col(text_col), F.lit("")), "|".join(hints_of(known) if hints is None else hints)
    tagged = F.lower(text).contains("spdx-license-identifier")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.lower(text).rlike(low) if low else F.lit(False), text).alias("text"), F.when(tagged, text).alias("tagged"))
    rows = rows.withColumn("lines", F.coalesce(identifiers(F.col("text"), False, known), F.lit(""))).withColumn("prose", F.coalesce(identifiers(F.col("text"), True, known), F.lit("")))
    rows = rows.withColumn("paragraphs", F.coalesce(paragraph_identifiers(F.col("text"), known), F.lit("")))
    cuts = ["lines", "prose", "paragraphs"]
    rows = rows.withColumns({f"by_{c}": matched(F.col(c), rules) for c in cuts})
    names = F.array_distinct(F.concat(*[F.col(f"by_{c}") for c in cuts]))
    for short, long in _contained(rules):
        instead = F.lit(False)
        for c in cuts:
            instead = instead | (F.array_contains(f"by_{c}", long) & ~F.array_contains(f"by_{c}", short))
        names = F.when(instead, F.array_remove(names, short)).otherwise(names)
    names = F.array_sort(F.array_distinct(F.concat(names, F.coalesce(spdx(F.col("tagged")), F.array().cast("array<string>")))))
    return rows.select("doc_id", F.col("lines").alias("sequence"), F.length(F.regexp_replace("lines", "[^,]", "")).cast("long").alias("commas"), names.alias("licenses")).select("doc_id", "sequence", F.expr("commas div 2").alias("n_sentences"), "licenses")
