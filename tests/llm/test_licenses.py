import re

import pytest

from checks.compare import difference
from phrasewell.llm import licenses
from phrasewell.llm.oracles import SQL
from phrasewell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_query_agrees_with_sql(spark, sf_dir):
    assert difference(spark, sf_dir, QUERIES["op2_licenses"], SQL["op2_licenses"]) is None


def brute_force(texts, least=0.8):
    """All units against all templates, without pruning."""
    found = set()
    for key, text in texts:
        normal = re.sub(r"[^\w\n]+|_+", " ", (text or "").lower())
        normal = re.sub(" +", " ", normal)
        parts = [p for p in (x.strip(" \n") for x in re.split(r"\n(?: ?\n)+", normal)) if p]
        units = [("line", i, x) for i, x in enumerate(normal.split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(parts) if "\n" in x] + [("text", 0, normal)] * (len(parts) > 1)
        for kind, i, unit in units:
            words = unit.split()
            own = set(zip(words, words[1:]))
            best = []
            for name, body in licenses.TEMPLATES:
                other = {tuple(b.split(" ")) for b in licenses.template_bigrams(body)}
                dice = 2 * len(own & other) / (len(own) + len(other))
                if dice >= least:
                    best.append((-dice, name))
            if best:
                found.add((key, kind, i, min(best)[1], round(-min(best)[0], 9)))
    return found


def test_all_units_against_all_templates(spark, odd_docs, no_docs):
    mit = dict(reversed(licenses.TEMPLATES))["MIT"]
    long = licenses.TEMPLATES[14][1]
    texts = [
        (1, "licensed UNDER the apache license -- version 2.0"), (2, f"Intro.\n\n{long.replace('any person', 'any person ' + chr(10))}\n\nEnd"),
        (3, "Released under the MIT License.\nReleased under the MIT License today.\n\n \n" + mit), (4, None), (5, ""), (6, "\n\n"), (7, "word " * 5000),
        (8, "\n".join(t for _, t in licenses.TEMPLATES)), (9, "This work is licensed under the GNU General Public License, version 4."), (None, "Licensed under CC BY-NC 4.0."),
        (10, long + "\n\n" + long[:40]),
    ]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {(r.doc_id, r.unit, r.number, r.license, round(r.dice, 9)) for r in licenses.scan(df).collect()}
    assert got == brute_force(texts) and len(got) > 20
    assert licenses.scan(odd_docs).collect() == [] and licenses.scan(no_docs).collect() == []
    assert licenses.scan(df, templates=()).collect() == []


def test_no_python_on_executors(spark):
    plan = QUERIES["op2_licenses"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_short_forms_headers_and_paragraphs(spark):
    lines = {
        "Licensed under the MIT License.": "MIT",
        "This software is released under the MIT License": "MIT",
        "# Licensed under the Apache License 2.0": "Apache-2.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "CC0-1.0",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
        "SPDX-License-Identifier: MIT": "MIT",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0",
        "Licensed under the Foo License.": None,
        "SPDX-License-Identifier: Foo": None,
        "This project is about the history of the licence.": None,
    }
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df).where("unit = 'line'").collect()}
    assert {i: got.get(i) for i in range(len(lines))} == dict(enumerate(lines.values()))
