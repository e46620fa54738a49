import random
import re

import pytest

from tracelake.llm import licenses

MIT = """Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def slow_match(found):
    """Try every rule at every place, longest first."""
    got, i = [], 0
    rules = sorted(licenses._RULES, key=lambda r: -len(r[2]))
    while i < len(found):
        hit = next((r for r in rules if tuple(x[1] for x in found[i : i + len(r[2])]) == r[2] and all(found[j + 1][0] - found[j][0] <= licenses.GAP + 1 for j in range(i, i + len(r[2]) - 1))), None)
        if hit:
            version = next((x[2] for x in found[i : i + len(hit[2])] if x[2]), "")
            got.append((hit[0].replace("{v}", version if "." in version or not version else version + ".0"), hit[1]))
        i += len(hit[2]) if hit else 1
    return [x for x in got if x[1] != "proprietary"] or got


def test_known_texts():
    cases = {
        MIT: ["MIT"],
        "Foo.\nLicensed under the Apache License, Version 2.0.\nBar.": ["Apache-2.0"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Released under the MIT License. All rights reserved.": ["MIT"],
        "The licence of the sea. Permission granted. All rights are reserved to nobody": [],
        "": [],
        None: [],
    }
    for text, want in cases.items():
        found = licenses.identifiers(text)
        assert [n for n, _ in licenses.match(found)[0]] == want
        assert licenses.match(found)[0] == slow_match(found)


def test_far_sentences_are_no_rule():
    parts = MIT.split("\n\n")
    apart = parts[1] + "\n" + "other words here\n" * 9 + "\n".join(parts[2:])
    got, left = licenses.match(licenses.identifiers(apart))
    assert got == [("MIT", "permissive")] and left == ["mit-notice", "mit-warranty", "mit-liability"]


def test_odd_rows(odd, make):
    out = licenses.scan(odd).collect()
    assert len(out) == odd.count() and all(r.licenses == [] and r.sentences == [] for r in out)
    assert licenses.scan(make([])).count() == 0
    assert [r.licenses for r in licenses.scan(make([(1, MIT), (1, MIT)])).collect()] == [["MIT"], ["MIT"]]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def test_wrapped_and_commented():
    import textwrap

    for text, want, kinds in ((MIT, ["MIT"], 4), (APACHE, ["Apache-2.0"], 5)):
        for width in (40, 72, 200):
            for mark in ("", "// ", " * ", "# "):
                lines = [mark + x for p in text.split("\n") for x in textwrap.wrap(p, width) or [""]]
                got, left = licenses.match(licenses.identifiers("int main;\n" + "\n".join(lines) + "\nmore words"))
                assert [n for n, _ in got] == want and left == [], (width, mark, got, left)
                assert len(licenses.identifiers("\n".join(lines))) == kinds


def slow_scan(text):
    """Every run of pieces against every known sentence, the longest first."""
    known = {licenses.normalise(f"SPDX-License-Identifier: {n}")[0] for names in licenses.SPDX.values() for n in names} | set(licenses.SENTENCES.values())
    pieces = [p for p in map(licenses.normalise, re.split(r"\n+|(?<=[.!?;:])[ \t]+", text or "")) if p[0]]
    out, at, number = [], 0, 0
    while at < len(pieces):
        ends = [e for e in range(len(pieces), at, -1) if " ".join(w for w, _ in pieces[at:e]) in known]
        if ends:
            words = " ".join(w for w, _ in pieces[at : ends[0]])
            out.append((number, words, next((v for _, v in pieces[at : ends[0]] if v), "")))
        at, number = ends[0] if ends else at + 1, number + 1
    return out


def test_scan_against_brute_force(spark, make):
    """Sentences of all families, spaced, wrapped and mixed with others."""
    rng = random.Random(3)
    sentences = list(licenses.SENTENCES.values()) + [f"SPDX-License-Identifier: {n}" for names in licenses.SPDX.values() for n in names]
    texts = ["All  rights  reserved.", "All rights\nreserved.", "released.\nThis is free and unencumbered software released into the public\ndomain.", "ALL\tRIGHTS RESERVED", MIT, APACHE]
    for k in range(300):
        parts = []
        start = rng.randrange(len(sentences))
        for x in rng.choice((sentences[start : start + 4], rng.sample(sentences, 3))):
            x = x.replace("{v}", rng.choice(("2.0", "3", "v4.0")))
            parts.append("".join(c if c != " " else rng.choice((" ", " ", " ", "  ", "\n", ", ")) for c in x))
            parts += ["some other words"] * rng.randrange(4)
        texts.append(rng.choice(("\n", ". ", ".\n")).join(parts))
    out = {r.doc_id: r for r in licenses.scan(make(list(enumerate(texts)))).collect()}
    names = licenses._KNOWN
    for i, text in enumerate(texts):
        want = [(n, names[w], v) for n, w, v in slow_scan(text)]
        assert out[i].sentences == [n for _, n, _ in want], text
        assert out[i].licenses == list(dict.fromkeys(n for n, _ in slow_match(want))), text
    assert sum(len(r.sentences) for r in out.values()) > 700 and all(out[i].sentences for i in range(6))


def test_full_texts():
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
    isc = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    for text, want in ((bsd, "BSD-2-Clause"), (isc, "ISC"), (gpl, "GPL-3.0-or-later"), ("/* SPDX-License-Identifier: LGPL-2.1-or-later */", "LGPL-2.1-or-later"), ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0")):
        assert [n for n, _ in licenses.match(licenses.identifiers(text))[0]] == [want], text


GPL_NAMED = "Foo is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("// SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note)", ["GPL-2.0 WITH Linux-syscall-note"]),
        ("SPDX-License-Identifier: (MIT AND (GPL-2.0+ OR bsd-2-clause)) */", ["MIT", "GPL-2.0-or-later", "BSD-2-Clause"]),
        ("SPDX-License-Identifier: LicenseRef-Own", ["LicenseRef-Own"]),
        ("SPDX-License-Identifier: Nothing-1.0", []),
        ("This project is licensed under the MIT License - see the LICENSE file for details", ["MIT"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]),
        ("Licensed under the BSD 3-Clause License.", ["BSD-3-Clause"]),
        ("It is distributed under the terms of the GNU Lesser General Public License version 3 or later.", ["LGPL-3.0-or-later"]),
        ("The code is released under the\nMozilla Public License 2.0", ["MPL-2.0"]),
        (GPL_NAMED, ["GPL-3.0-or-later"]),
        (GPL_NAMED.replace("General", "Lesser General"), ["LGPL-3.0-or-later"]),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", ["GPL-3.0"]),
        ("Copyright 2020. All rights reserved.\n" + MIT, ["MIT"]),
        ("All rights reserved.", ["Proprietary"]),
        ("the ship sails under the flag of Apache 2.0", []),
        ("He is available under pressure.", []),
    ],
)
def test_ordinary_texts(text, want):
    assert [n for n, _ in licenses.match(licenses.identifiers(text))[0]] == want
