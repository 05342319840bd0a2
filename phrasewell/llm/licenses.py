"""Licence notices in texts, in DataFrame functions only.

Lines, paragraphs of several lines, and texts of several paragraphs are compared with templates by
the Dice coefficient of their word bigrams. Sizes so different that the coefficient cannot be
reached rule a template out before anything is compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from phrasewell.llm.quality import let

# Notices, standard headers, and the paragraphs of short licences.
NOTICES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "This project is licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "This project is licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "This project is licensed under the ISC License."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)

# Identifiers that stand in a line of their own.
IDENTIFIERS = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-NC-SA-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)

TEMPLATES = NOTICES + tuple((re.sub("-(only|or-later)$", "", x), f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS)

#: What is not a letter, a digit or the end of a line stands for a space.
OTHER = r"[^\p{L}\p{N}\n]+"
GAP = r"\n(?: ?\n)+"


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as texts are."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def units(text: Column) -> Column:
    """Array of (kind, number, words): lines, paragraphs of more than one line, the text if it has several.

    Numbers count from 0, lines among all lines and paragraphs among those that have a word. Words
    are in lower case, with one space between them.
    """

    def cut(normal: Column) -> Column:
        spaced = lambda x: F.trim(F.regexp_replace(x, r"[ \n]+", " "))
        unit = lambda kind, x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("number"), spaced(x).alias("words"))
        blank = lambda x: F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")
        lines = F.transform(F.split(normal, "\n", -1), lambda x, i: unit("line", x, i))

        def longer(paragraphs: Column) -> Column:
            numbered = F.transform(paragraphs, lambda x, i: unit("paragraph", F.when(F.contains(x, F.lit("\n")), x).otherwise(F.lit("")), i))
            whole = F.array(unit("text", F.when(F.size(paragraphs) > 1, normal).otherwise(F.lit("")), F.lit(0)))
            return F.concat(lines, numbered, whole)

        return let(F.filter(F.transform(F.split(normal, GAP, -1), blank), lambda x: x != ""), longer)

    return let(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " "), cut)


def best_template(words: Column, templates: tuple[tuple[str, str], ...], least: float) -> Column:
    """The template with the largest Dice coefficient of at least ``least``, of equals the first by name; else null."""
    known = [(name, template_bigrams(text)) for name, text in templates]
    known = [(name, b) for name, b in known if b]
    sizes = [len(b) for _, b in known]
    low, high = least / (2 - least), (2 - least) / least
    every = sorted({x for _, b in known for x in b})
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(b)).alias("size"), F.lit(b).alias("bigrams")) for name, b in known])

    def compared(found: Column) -> Column:
        size = F.size(found)
        possible = F.filter(rows, lambda t: (t["size"] >= low * size) & (t["size"] <= high * size))

        def dice(t: Column) -> Column:
            share = 2.0 * F.size(F.array_intersect(found, t["bigrams"])) / (size + t["size"])
            return F.struct((-share).alias("less"), t["license"].alias("license"))

        best = F.array_min(F.filter(F.transform(possible, dice), lambda d: d["less"] <= -least))
        # What is shared with one template is shared with all of them together.
        shared = F.size(F.filter(found, lambda b: b.isin(*every)))
        near = (size >= low * min(sizes)) & (size <= high * max(sizes)) & (shared >= low * size)
        return F.when(near, best)

    def bigrams(parts: Column) -> Column:
        following = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        pairs = F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), following, lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(pairs)

    if not known:
        return F.lit(None).cast("struct<less:double,license:string>")
    spaces = F.length(words) - F.length(F.translate(words, " ", ""))
    found = let(F.split(words, " ", -1), lambda parts: let(bigrams(parts), compared))
    return F.when(spaces >= low * min(sizes), found)


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    least: float = 0.8,
) -> DataFrame:
    """Rows (key, unit, number, license, dice): what is like a template by at least ``least``, with the most alike.

    ``unit`` is line, paragraph or text. Row by row, without a shuffle; null and empty texts and those
    without a match give no row, repeated rows give theirs each, null keys are kept, other columns are
    not read. No templates, no rows.
    """
    split = docs.select(F.col(key).alias("key"), F.explode(units(F.col(text))).alias("u"))
    found = split.select("key", "u.kind", "u.number", best_template(F.col("u.words"), templates, least).alias("best")).where("best is not null")
    return found.select(F.col("key").alias(key), F.col("kind").alias("unit"), "number", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"))
