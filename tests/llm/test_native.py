"""Decontamination, mixing, sharding and license scans against plain Python, with awkward rows."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from setflow.llm import decontam, licenses, mixing, sharding
from setflow.llm.common import alnum_words, ascii_lower, space_words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", None, "   ", "ÉCOLE École İstanbul KELVIN\u212a", "a\tb\x0bc\x1cd", "x" * 50_000, "\U0001f600 smile 中文"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, pos long, bytes long, spots string"


def docs(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, 1, 2, 3, "x") for i, t, s in rows], SCHEMA)


def test_words(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, t string")
    got = df.select("i", alnum_words(F.col("t")).alias("a"), space_words(F.col("t")).alias("s"), ascii_lower(F.col("t")).alias("l")).orderBy("i").collect()
    for r, t in zip(got, ODD, strict=True):
        assert r["a"] == WORD.findall((t or "").translate(LOW)) and r["s"] == re.findall(r"[^\x20\x09-\x0D]+", t or "") and r["l"] == (t and t.translate(LOW) if t is not None else None)


def brute_decontaminate(rows, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        if w:
            for k in range(max(1, len(w) - width + 1)):
                windows[tuple(w[k : k + width])].add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for i, t, _ in rows:
        w, hit, ids = WORD.findall((t or "").translate(LOW)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[key] - {'None'}
        out.append((i, len(w), len(hit), ",".join(sorted(ids)), bool(hit)))
    return sorted(out, key=repr)


def decontaminated(df, items):
    rows = decontam.decontaminate(df, items).select("doc_id", "n_words", "n_hit", F.array_join("item_ids", ","), "contaminated").collect()
    return sorted(map(tuple, rows), key=repr)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short, item!"), (10, "the the the the the the the the the the"), (3, None), (4, "..."), (5, "lone"), (None, "no id here")]


def test_decontamination(spark):
    long = "a b c " * 20_000 + "One-Two three FOUR five six seven eight nine ten " + "the " * 25
    texts = [*ODD, ITEMS[0][1].upper(), "x one two three four five six seven eight nine ten eleven y", "one two three four five six seven eight nine", "short item short item", "lone, lone no id HERE", "the " * 30, long]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "short item", "s"), (None, "other", "s"), (7, texts[7], "s"), (7, "lone", "s")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminated(docs(spark, rows), items) == brute_decontaminate(rows, ITEMS)
    assert decontaminated(docs(spark, []), items) == []
    assert decontaminated(docs(spark, rows), items.limit(0)) == brute_decontaminate(rows, [])


def test_item_without_id_hits_but_has_no_name(spark):
    items = spark.createDataFrame([(None, "no id here"), (1, "named item")], "item_id long, text string")
    got = decontaminated(docs(spark, [(1, "x no id here y", "s"), (2, "no id here named item", "s")]), items)
    assert got == [(1, 5, 3, "", True), (2, 5, 5, "1", True)]
    assert "null id hits like any other" in decontam.__doc__


def test_decontamination_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    rows = [(i, " ".join(f"w{(i * j) % 13}" for j in range(40)), "s") for i in range(30)]
    items = [(k, " ".join(f"w{(k * j) % 13}" for j in range(5, 17))) for k in range(12)]
    assert decontaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")) == brute_decontaminate(rows, items)


def test_decontamination_with_a_kept_index(spark):
    texts = [ITEMS[0][1], "short item", "nothing of it", "lone word", None]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    index = decontam.build_index(df)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for _ in range(2):
        got = decontam.decontaminate(df, items, index=index).select("doc_id", "n_words", "n_hit", F.array_join("item_ids", ","), "contaminated").collect()
        assert sorted(map(tuple, got), key=repr) == brute_decontaminate([(i, t, "s") for i, t in enumerate(texts)], ITEMS)


def test_a_phrase_of_many_items_in_many_documents(spark):
    phrase = "p q r s t u v w x y"
    items = [(i, phrase) for i in range(60)] + [(100, phrase + " z")]
    rows = [(i, f"d{i} {phrase} " * 3, "s") for i in range(50)] + [(99, phrase + " z", "s")]
    got = decontaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute_decontaminate(rows, items)


def test_proximity(spark):
    texts = ["a x x b", "a x x x b", "b a", "a c b", "b x a c", None]
    index = decontam.build_index(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), None)
    patterns = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a", "b", "c"])], "pid string, terms array<string>")
    got = sorted({(r["pid"], r["doc_id"]) for r in decontam.proximity_matches(index, patterns, 4).collect()})
    want = []
    for pid, terms in (("p", "ab"), ("q", "abc")):
        for i, t in enumerate(texts):
            w = (t or "").split()
            if any(set(terms) <= set(w[k : k + 4]) for k in range(len(w))):
                want.append((pid, i))
    assert got == want


def sizes_of(rows):
    return {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}


def mixed(df, weights=(3.0, 1.0, 2.0), share=1.5):
    return mixing.mix(df, list(weights), share)


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 400)), [None, "b", "a", "é", "Z"][i % 5]) for i in range(400)] + [(1000, None, "a"), (1001, "", "empty"), (None, "x y z", "b")]
    got = [r.asDict() for r in mixed(docs(spark, rows)).collect()]
    assert len(got) == len(rows) and {"th", "spots"} <= set(got[0])
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += len((t or "").split())
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while True:  # share by weight, cap, share the excess again
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    target |= {s: unit * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in got:
        assert r["__mix_total"] == total[r["source"]] and abs(r["__mix_target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["__mix_copies"] <= 2
        taken[r["source"]] += r["__mix_copies"] * r["__mix_size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(30, 0.005 * target[s]), s
    again = {r["doc_id"]: r["__mix_copies"] for r in mixed(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["__mix_copies"] for r in got}


def test_mixing_degenerate(spark):
    assert mixed(docs(spark, [])).count() == 0
    none = mixed(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [r["__mix_copies"] for r in none] == [0, 0]
    same = [(5, "a b c d", "s")] * 40
    out = mixing.mixed_rows(mixed(docs(spark, same)), ["doc_id", "text"])
    assert out.columns == ["doc_id", "text"] and out.count() <= 80


@pytest.mark.parametrize("seed", ["1:", "2:", "3:", "4:"])
def test_mixing_cuts_between_equal_rows(spark, seed):
    """Half of the rows are copies of one; the words taken stay within a document of the target, and reruns agree."""
    rows = [(7, "w " * 100, "s")] * 300 + [(i, f"x{i} " * 100, "s") for i in range(1000, 1300)]
    df = docs(spark, rows).repartition(6)
    got = mixing.mix(df, [1.0], 0.5, seed=seed).groupBy("doc_id").agg(F.sum("__mix_copies").alias("n"), F.count("*").alias("rows"), F.max("__mix_copies").alias("most")).collect()
    assert sum(r["rows"] for r in got) == 600 and max(r["most"] for r in got) == 1
    assert abs(100 * sum(r["n"] for r in got) - 30_000) <= 100
    again = mixing.mix(docs(spark, rows[::-1]), [1.0], 0.5, seed=seed).groupBy("doc_id").agg(F.sum("__mix_copies").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {r["doc_id"]: r["n"] for r in again}


def test_mixing_one_hot_id_and_null_ids(spark):
    """Equal ids with different texts, null ids, and copies in several sources: each source comes within a document of its target."""
    rows = [(5, f"t{i} " * (20 + i % 7), "a") for i in range(300)] + [(None, f"n{i} " * 30, "b") for i in range(200)] + [(None, "same " * 30, "b")] * 200 + [(6, "same " * 10, s) for s in ("c", None) for _ in range(150)]
    got = mixing.mix(docs(spark, rows), [3.0, 1.0, 2.0], 0.7).groupBy("source").agg(F.sum(F.col("__mix_copies") * F.col("__mix_size")).alias("taken"), F.first("__mix_target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == len(rows)
    assert all(abs(r["taken"] - r["target"]) <= 30 for r in got)
    split = mixing.mix(docs(spark, rows), [1.0], 0.7).where("doc_id is null").groupBy(F.xxhash64("text")).agg(F.max("__mix_copies").alias("n")).collect()
    assert {r["n"] for r in split} == {0, 1}


def test_mixing_replaces_clashing_columns(spark):
    df = docs(spark, [(i, "a b c", "s") for i in range(8)]).withColumn("__mix_in", F.lit(9)).withColumn("__mix_copies", F.lit("x"))
    got = mixed(df)
    assert "__mix_in" not in got.columns and got.agg(F.sum("__mix_copies")).first()[0] == 12


def test_inclusion_follows_the_odds(spark):
    """Over many seeds each document is taken about as often as its expected copies say; short ones half as often."""
    rows = [(i, "w " * (100 if i % 2 else 20), "s") for i in range(60)]
    taken = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix(docs(spark, rows), [1.0], 0.5, seed=f"{seed}:").collect():
            taken[r["doc_id"] % 2] += r["__mix_copies"]
    assert 1.5 < taken[1] / taken[0] < 2.7


def brute_shards(rows, limit):
    word = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:13], 16)
    items = [(format(word(i), "052b"), len((t or "").encode()), i) for i, t, _ in rows]

    def split(group, depth):
        if depth == 52 or len(group) <= 1 or sum(b for _, b, _ in group) <= limit:
            return [(i, h[:depth]) for h, _, i in group]
        return [x for bit in "01" for x in split([g for g in group if g[0][depth] == bit], depth + 1)]

    return sorted(split(items, 0))


@pytest.mark.parametrize("step", [None, 2, 5, 20])
def test_sharding(spark, step):
    rows = [(i, "x" * (i * 7919 % 500), "s") for i in range(300)] + [(999, "é" * 5000, "s"), (1000, None, "s"), (1001, "", "s")]
    got = sharding.shard(docs(spark, rows), 2000, step=step)
    assert sorted((r["doc_id"], r["__shard"]) for r in got.collect()) == brute_shards(rows, 2000)
    over = got.groupBy("__shard").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n")).where("b > 2000").collect()
    assert [r["n"] for r in over] == [1]


def test_sharding_splits_rows_of_one_id(spark):
    rows = [(5, "y" * 100, "s")] * 200 + [(None, "z" * 100, "s")] * 100 + [(6, "q", "s")]
    got = sharding.shard(docs(spark, rows), 1000)
    assert got.count() == 301 and set(got.columns) == set(SCHEMA.replace(",", " ").split()[::2]) | {"__bytes", "__depth", "__shard"}
    assert got.groupBy("__shard").agg(F.sum("__bytes").alias("b")).where("b > 1000").count() == 0
    assert sharding.shard(docs(spark, []), 1000).count() == 0
    assert {r["__shard"] for r in sharding.shard(docs(spark, rows[-1:]), 1000).collect()} == {""}


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."


def test_licenses(spark):
    wrapped = MIT.replace(" person ", "\nperson ").replace("conditions:\n\n", "conditions. ")
    cases = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "words\nRELEASED   under the MIT License.\nmore": "MIT",
        "Some text. This work is licensed under the GNU General Public License, version 3. More!": "GPL-3.0",
        MIT: "MIT",
        wrapped: "MIT",
        MIT.split("\n\n")[1] + "\n" + MIT.split("\n\n")[0]: "",  # wrong order
        "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.": "CC-BY-NC-4.0,MIT",
        "not licensed under anything": "",
    }
    texts = [*cases, *ODD]
    want = [*cases.values(), *[""] * len(ODD)]
    got = {r["doc_id"]: ",".join(r["licenses"]) for r in licenses.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert licenses.scan(docs(spark, [])).count() == 0
    assert all(any(h in s for h in licenses.HINTS) for s in licenses.SENTENCES)
    assert licenses.scan(docs(spark, [(1, MIT, "s")] * 3)).count() == 3


MIT_FILE = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
APACHE_HEADER = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL_HEADER = """<one line to give the program's name and a brief idea of what it does.>
Copyright (C) 2020  Jane Doe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_licenses_in_their_usual_layout(spark):
    heads = {MIT_FILE: "MIT", APACHE_HEADER: "Apache-2.0", GPL_HEADER: "GPL-3.0-or-later"}
    ways = [
        lambda t: t,
        lambda t: t.replace("\n", "\r\n"),
        lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()) + "import os\n",
        lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.splitlines()) + " */\nint main;\n",
        lambda t: t.replace("software: you", "software;\nyou").replace('"License");\nyou', '"License"); you').replace("at\n\n ", "at:\n"),
    ]
    cases = [(way(t), name) for way in ways for t, name in heads.items()]
    cases += [(GPL_HEADER.replace("You should", "You must"), ""), (APACHE_HEADER.replace("/LICENSE-2.0", "/OTHER"), ""), (APACHE_HEADER + "\n" * 5000 + MIT_FILE, "Apache-2.0,MIT")]
    got = {r["doc_id"]: ",".join(r["licenses"]) for r in licenses.scan(docs(spark, [(i, t, "s") for i, (t, _) in enumerate(cases)])).collect()}
    assert [got[i] for i in range(len(cases))] == [name for _, name in cases]


BSD_2 = """Copyright (c) 2021, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
BSD_3 = BSD_2.replace("\nTHIS SOFTWARE", """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""")
GPL_2 = GPL_HEADER.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2").replace("\nalong with this program.  If not, see <https://www.gnu.org/licenses/>", """
along with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""")
ISC = """Copyright 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS".
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
LINUX = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
"""
HEADS = {
    BSD_2: "BSD-2-Clause", BSD_3: "BSD-3-Clause", BSD_3.replace("the copyright holder nor", "Example, Inc. nor"): "BSD-3-Clause", ISC: "ISC", MPL: "MPL-2.0", LINUX: "GPL-2.0-only", GPL_2: "GPL-2.0-or-later",
    GPL_HEADER.replace("General", "Affero General"): "AGPL-3.0-or-later", GPL_2.replace("General", "Lesser General").replace("version 2 ", "version 2.1 ").replace("program", "library"): "LGPL-2.1-or-later",
    GPL_HEADER.replace("General", "Lesser General"): "LGPL-3.0-or-later", APACHE_HEADER.replace("http:", "https:"): "Apache-2.0", BSD_3 + "\n" * 3 + BSD_2: "BSD-2-Clause,BSD-3-Clause",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "This is free and unencumbered software released into the public domain.": "Unlicense",
}


def found_licenses(spark, texts):
    got = {r["doc_id"]: ",".join(r["licenses"]) for r in licenses.scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    return [got[i] for i in range(len(texts))]


def test_canonical_notices(spark):
    ways = [
        lambda t: t,
        lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()) + "import os\n",
        lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.splitlines()) + " */\nint main;\n",
        lambda t: "".join(f"// {x}".rstrip() + "\r\n" for x in t.splitlines()),
        lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")),
    ]
    assert found_licenses(spark, [way(t) for way in ways for t in HEADS]) == list(HEADS.values()) * len(ways)
    one_cut = BSD_3.replace("notice, this\n   list", "notice, this list").replace("notice,\n   this", "notice, this").replace("documentation\n   and", "documentation and")
    assert found_licenses(spark, [one_cut]) == ["BSD-3-Clause"]  # by lines two sentences of three would do


def test_spdx_expressions(spark):
    cases = {
        "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */": "GPL-2.0-only",
        "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-4.0\ncode": "Apache-2.0,CC-BY-4.0,MIT", "spdx-license-identifier:Zlib.": "Zlib", "SPDX-License-Identifier:": "", "an SPDX-License-Identifier is a tag": "",
    }
    assert found_licenses(spark, list(cases)) == list(cases.values())


def test_callers_sentences_have_their_own_hints(spark):
    known = ["use this as you like", "my own terms apply"]
    assert all(any(h in k.split() for h in licenses.hints_of(known)) for k in known) and all(any(h in k.split() for h in licenses.HINTS) for k in licenses.SENTENCES)
    got = licenses.scan(docs(spark, [(1, "Use this, as you like!", "s"), (2, "My own terms apply.", "s"), (3, None, "s")]), known, [("A", [1]), ("B", [2])]).collect()
    assert [r["licenses"] for r in sorted(got)] == [["A"], ["B"], []]
    assert licenses.scan(docs(spark, [(1, MIT, "s")]), [], []).first()["licenses"] == []
