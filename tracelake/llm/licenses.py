"""Licence recognition by sentences and rules.

A text is cut into sentences at line ends and sentence marks, and pieces of a
wrapped one are joined again.  A sentence is normalised (lower case, marks and repeated spaces out, numbers of copyright
years out) and looked up among known licence sentences, which gives its
identifier.  The identifiers of a text, in order, form a sequence; ordered
rules are matched against it from left to right, longest rule first, each rule
an ordered list of identifiers with a bounded number of unknown sentences
between two of them.  Identifiers that no rule takes are reported as unmatched
evidence.  A sentence that is not known whole, but says what something is
licensed under, and an SPDX expression are identified by the licences they name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier and wording of known licence sentences; {v} stands
#: for a version number.
SENTENCES = {
    "apache-licensed-under": "licensed under the apache license version {v}",
    "apache-licensed-header": "licensed under the apache license version {v} the license",
    "apache-may-not-use": "you may not use this file except in compliance with the license",
    "apache-obtain-copy": "you may obtain a copy of the license at",
    "apache-unless-required": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see-license": "see the license for the specific language governing permissions and limitations under the license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-no-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-work": "this work is licensed under the gnu general public license version {v}",
    "gpl-licensed": "licensed under the gnu general public license version {v}",
    "gpl-free-software": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "lgpl-work": "this work is licensed under the gnu lesser general public license version {v}",
    "mpl-source": "this source code form is subject to the terms of the mozilla public license v {v}",
    "cc-by": "licensed under cc by {v}",
    "cc-by-sa": "licensed under cc by sa {v}",
    "cc-by-nc": "licensed under cc by nc {v}",
    "cc-by-nc-sa": "licensed under cc by nc sa {v}",
    "cc-by-nd": "licensed under cc by nd {v}",
    "cc-by-work": "this work is licensed under a creative commons attribution {v} international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike {v} international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial {v} international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
    "agpl-free-software": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "agpl-licensed": "licensed under the gnu affero general public license version {v}",
    "apache-title": "apache license version {v}",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-licensed": "licensed under the bsd license",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost-header": "distributed under the boost software license version {v}",
    "boost-title": "boost software license version {v}",
    "cc-by-nc-nd": "licensed under cc by nc nd {v}",
    "cc-by-nc-sa-work": "this work is licensed under a creative commons attribution noncommercial sharealike {v} international license",
    "cc-by-nc-nd-work": "this work is licensed under a creative commons attribution noncommercial noderivatives {v} international license",
    "cc-by-nd-work": "this work is licensed under a creative commons attribution noderivatives {v} international license",
    "epl-title": "eclipse public license v {v}",
    "epl-licensed": "licensed under the eclipse public license version {v}",
    "gfdl-grant": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version {v} or any later version published by the free software foundation",
    "gpl-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version {v} as published by the free software foundation",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl-free-software": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "lgpl-licensed": "licensed under the gnu lesser general public license version {v}",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl {v}",
    "mpl-copy-https": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl {v}",
    "unlicense-free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl": "do what the fuck you want to public license",
    "zero-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "gpl-title": "gnu general public license version {v} 29 june 2007",
    "gpl-title-1991": "gnu general public license version {v} june 1991",
    "lgpl-title": "gnu lesser general public license version {v} 29 june 2007",
    "lgpl-title-1999": "gnu lesser general public license version {v} february 1999",
    "agpl-title": "gnu affero general public license version {v} 19 november 2007",
    "mpl-title": "mozilla public license version {v}",
    "mpl-title-short": "mozilla public license v {v}",
}
#: Rules in order of preference; the licence, its class, and the
#: identifiers in sequence; {v} is the version its sentences name.
RULES = [
    ("MIT", "permissive", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", "permissive", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-no-endorsement")),
    ("BSD-2-Clause", "permissive", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-{v}", "permissive", ("apache-licensed-under", "apache-may-not-use", "apache-obtain-copy", "apache-unless-required", "apache-see-license")),
    ("Apache-{v}", "permissive", ("apache-licensed-header", "apache-may-not-use", "apache-obtain-copy", "apache-unless-required", "apache-see-license")),
    ("Apache-{v}", "permissive", ("apache-licensed-header", "apache-may-not-use")),
    ("Apache-{v}", "permissive", ("apache-licensed-header",)),
    ("Apache-{v}", "permissive", ("apache-licensed-under",)),
    ("GPL-{v}-or-later", "copyleft", ("gpl-free-software", "gpl-hope", "gpl-details")),
    ("GPL-{v}-or-later", "copyleft", ("gpl-free-software",)),
    ("GPL-{v}", "copyleft", ("gpl-work",)),
    ("GPL-{v}", "copyleft", ("gpl-licensed",)),
    ("LGPL-{v}", "copyleft", ("lgpl-work",)),
    ("MPL-{v}", "copyleft", ("mpl-source",)),
    ("MIT", "permissive", ("mit-released",)),
    ("MIT", "permissive", ("mit-licensed",)),
    ("MIT", "permissive", ("mit-title", "mit-grant")),
    ("MIT", "permissive", ("mit-title-short", "mit-grant")),
    ("MIT", "permissive", ("mit-grant",)),
    ("CC-BY-{v}", "attribution", ("cc-by",)),
    ("CC-BY-{v}", "attribution", ("cc-by-work",)),
    ("CC-BY-SA-{v}", "share-alike", ("cc-by-sa",)),
    ("CC-BY-SA-{v}", "share-alike", ("cc-by-sa-work",)),
    ("CC-BY-NC-{v}", "non-commercial", ("cc-by-nc",)),
    ("CC-BY-NC-{v}", "non-commercial", ("cc-by-nc-work",)),
    ("CC-BY-NC-SA-{v}", "non-commercial", ("cc-by-nc-sa",)),
    ("CC-BY-ND-{v}", "no-derivatives", ("cc-by-nd",)),
    ("CC0-1.0", "public-domain", ("cc0",)),
    ("Unlicense", "public-domain", ("unlicense",)),
    ("Proprietary", "proprietary", ("all-rights",)),
    ("MIT", "permissive", ("mit-title", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", "permissive", ("mit-title-short", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-4-Clause", "permissive", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-no-endorsement", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", "permissive", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-no-endorsement", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", "permissive", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("BSD", "permissive", ("bsd-licensed",)),
    ("Apache-{v}", "permissive", ("apache-title",)),
    ("ISC", "permissive", ("isc-grant", "isc-warranty", "isc-liability")),
    ("ISC", "permissive", ("isc-grant",)),
    ("0BSD", "permissive", ("zero-grant", "isc-warranty", "isc-liability")),
    ("0BSD", "permissive", ("zero-grant",)),
    ("Zlib", "permissive", ("zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", "permissive", ("zlib-grant",)),
    ("BSL-{v}", "permissive", ("boost-title", "boost-grant")),
    ("BSL-{v}", "permissive", ("boost-header",)),
    ("BSL-{v}", "permissive", ("boost-title",)),
    ("BSL-1.0", "permissive", ("boost-grant",)),
    ("GPL-{v}-or-later", "copyleft", ("gpl-free-software", "gpl-hope", "gpl-details", "gpl-received")),
    ("GPL-{v}", "copyleft", ("gpl-only", "gpl-hope", "gpl-details", "gpl-received")),
    ("GPL-{v}", "copyleft", ("gpl-only",)),
    ("AGPL-{v}-or-later", "copyleft", ("agpl-free-software", "gpl-hope", "agpl-details")),
    ("AGPL-{v}-or-later", "copyleft", ("agpl-free-software",)),
    ("AGPL-{v}", "copyleft", ("agpl-licensed",)),
    ("LGPL-{v}-or-later", "copyleft", ("lgpl-free-software", "lgpl-hope", "lgpl-details")),
    ("LGPL-{v}-or-later", "copyleft", ("lgpl-free-software",)),
    ("LGPL-{v}", "copyleft", ("lgpl-licensed",)),
    ("MPL-{v}", "copyleft", ("mpl-source", "mpl-copy")),
    ("MPL-{v}", "copyleft", ("mpl-source", "mpl-copy-https")),
    ("EPL-{v}", "copyleft", ("epl-title",)),
    ("EPL-{v}", "copyleft", ("epl-licensed",)),
    ("GFDL-{v}-or-later", "copyleft", ("gfdl-grant",)),
    ("CC-BY-NC-SA-{v}", "non-commercial", ("cc-by-nc-sa-work",)),
    ("CC-BY-NC-ND-{v}", "non-commercial", ("cc-by-nc-nd",)),
    ("CC-BY-NC-ND-{v}", "non-commercial", ("cc-by-nc-nd-work",)),
    ("CC-BY-ND-{v}", "no-derivatives", ("cc-by-nd-work",)),
    ("Unlicense", "public-domain", ("unlicense", "unlicense-free")),
    ("WTFPL", "permissive", ("wtfpl",)),
    ("GPL-{v}", "copyleft", ("gpl-title",)),
    ("GPL-{v}", "copyleft", ("gpl-title-1991",)),
    ("LGPL-{v}", "copyleft", ("lgpl-title",)),
    ("LGPL-{v}", "copyleft", ("lgpl-title-1999",)),
    ("AGPL-{v}", "copyleft", ("agpl-title",)),
    ("MPL-{v}", "copyleft", ("mpl-title",)),
    ("MPL-{v}", "copyleft", ("mpl-title-short",)),
    ("LGPL-{v}-or-later", "copyleft", ("lgpl-free-software", "gpl-hope", "lgpl-details")),
]
#: Names that a line ``SPDX-License-Identifier:`` may have, by class.
SPDX = {
    "permissive": ("MIT", "MIT-0", "X11", "Apache-2.0", "BSD-2-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "WTFPL", "PostgreSQL", "NCSA", "Python-2.0", "Artistic-2.0"),
    "copyleft": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "EUPL-1.2", "CDDL-1.0", "OSL-3.0"),
    "public-domain": ("CC0-1.0", "Unlicense"),
    "attribution": ("CC-BY-4.0", "OFL-1.1"),
    "share-alike": ("CC-BY-SA-4.0",),
    "non-commercial": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"),
    "no-derivatives": ("CC-BY-ND-4.0",),
}
#: Unknown sentences that may stand between two of a rule.
GAP = 2
#: How a sentence names a licence that something stands under, by
#: the start of its name and what may follow; the groups are its version and
#: whether later ones do.
NAMED = (
    ("MIT", r"(?:mit|expat)", "permissive"),
    ("Apache-{v}", r"apache(?: software)?(?: licen[sc]e)?(?: version)? v?(\d(?:\.\d)?)", "permissive"),
    ("BSD-{v}-Clause", r"(?:new |modified |revised |simplified )?bsd (\d) clause", "permissive"),
    ("BSD-{v}-Clause", r"(\d) clause bsd", "permissive"),
    ("AGPL-{v}", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version)? ?v?(\d(?:\.\d)?)", "copyleft"),
    ("LGPL-{v}", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version)? ?v?(\d(?:\.\d)?)", "copyleft"),
    ("GPL-{v}", r"(?:gnu )?(?:general public licen[sc]e|gpl)(?: version)? ?v?(\d(?:\.\d)?)", "copyleft"),
    ("MPL-{v}", r"(?:mozilla public licen[sc]e|mpl)(?: version)? ?v?(\d(?:\.\d)?)", "copyleft"),
    ("EPL-{v}", r"(?:eclipse public licen[sc]e|epl)(?: version)? ?v?(\d(?:\.\d)?)", "copyleft"),
    ("BSL-{v}", r"boost software licen[sc]e(?: version)? ?v?(\d(?:\.\d)?)", "permissive"),
    ("ISC", r"isc", "permissive"),
    ("Zlib", r"zlib", "permissive"),
    ("Unlicense", r"unlicense", "public-domain"),
)

_CUT = re.compile(r"\n+|(?<=[.!?;:])[ \t]+").split
_MARKS = re.compile(r"[^\w.]+|(?<!\d)\.|\.(?!\d)|_").sub
# a program's own name in the place of "this program"
_PROGRAM = re.compile(r"^(?!this library\b).{1,60}? is (free software\b|distributed in the hope\b)").sub
_VERSION = re.compile(r"(?<![\w.])v?(\d+(?:\.\d+)*)(?![\w.])")


def normalise(sentence: str) -> tuple[str, str]:
    """Words in lower case, single spaces, the first number as {v}; and it."""
    words = _MARKS(" ", sentence.lower()).strip()
    found = _VERSION.search(words)
    return (_VERSION.sub("{v}", words, count=1), found[1]) if found else (words, "")


_KNOWN = {text: name for name, text in SENTENCES.items()}
_RULES = list(RULES)
for _kind, _names in SPDX.items():
    for _name in _names:
        _text, _number = normalise(f"SPDX-License-Identifier: {_name}")
        _id = f"spdx-{_text.removeprefix('spdx license identifier ')}"
        _KNOWN[_text] = _id
        _RULES.append((_name.replace(_number, "{v}", 1) if _number else _name, _kind, (_id,)))
# a library's sentences, of a program
for _text, _id in [(t, i) for t, i in _KNOWN.items() if t.startswith("this library is free software")]:
    _KNOWN.setdefault(_text.replace("this library", "this program", 1), _id)
_SORTED = sorted(_KNOWN)


def _telling(sentences: list[str]) -> tuple[str, ...]:
    """Words of which every sentence has one.  A text in whose lower case none
    of them stands has no known sentence, however it is spaced or wrapped."""
    left, out = [{w for w in x.split() if len(w) > 5} or set(x.split()) for x in sentences], []
    while left:
        counts = Counter(w for x in left for w in x)
        out.append(min(counts, key=lambda w: (-counts[w], w)))
        left = [x for x in left if out[-1] not in x]
    return tuple(out)


_TELLING = _telling(_SORTED)
_UNDER = re.compile(r"\b(?:licensed|distributed|released|available|provided|published) (?:\w+ )?under (?:the terms of )?(?:either |both )?(?:of )?(?:the )?").search
_NAMES = [(name, re.compile(r"(?:the )?" + text + r"\b((?: or| and)? (?:any )?later(?: versions?)?)?(?: licen[sc]es?)?").match, kind) for name, text, kind in NAMED]
_BETWEEN = re.compile(r" (?:or|and)(?: the)? ").match
_ITEM = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*|[()]").match
_SPDX_BY_NAME = {n.lower(): n for names in SPDX.values() for n in names}
_CLASS = {n: kind for kind, names in SPDX.items() for n in names}


def _whole(version: str) -> str:
    """A version as SPDX names have it: 3 is 3.0."""
    return version if "." in version or not version else f"{version}.0"


def _references(sentence: str) -> list[tuple[str, str]]:
    """The licences, and their classes, that a sentence says something is
    licensed under, whatever else it says."""
    words = _MARKS(" ", sentence.lower()).strip()
    start, out = _UNDER(words), []
    at = start.end() if start else -1
    while at >= 0:
        for name, match_, kind in _NAMES:
            if found := match_(words, at):
                version = found[1] if found.re.groups > 1 else ""
                name = name.replace("{v}", version if "Clause" in name else _whole(version or ""))
                out.append((name + ("-or-later" if kind == "copyleft" and found[found.re.groups] else ""), kind))
                on = _BETWEEN(words, found.end())
                at = on.end() if on else -1
                break
        else:
            break
    return out


def _expression(text: str) -> list[tuple[str, str]]:
    """The licences of an SPDX expression, each with its exception."""
    out, at, named = [], 0, False
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        item = _ITEM(text, at)
        if not item:
            return out
        word, at = item[0], item.end()
        if word in "()":
            continue
        if word.upper() in ("AND", "OR") and named:
            named = False
        elif word.upper() == "WITH" and named and (item := _ITEM(text, at + 1)):
            out[-1], at = (f"{out[-1][0]} WITH {item[0]}", out[-1][1]), item.end()
        elif not named:
            plain = word.rstrip("+").rstrip(".")
            name = _SPDX_BY_NAME.get(plain.lower(), plain if plain.startswith("LicenseRef-") else None)
            if name is None:
                return out
            kind = _CLASS.get(name, "other")
            out.append((f"{name.removesuffix('-only')}-or-later" if word.endswith("+") and kind == "copyleft" and not name.endswith("-or-later") else name, kind))
            named = True
        else:
            return out


def _begins(words: str) -> bool:
    """Whether a known sentence begins with these words and goes on."""
    at = bisect_left(_SORTED, words + " ")
    return at < len(_SORTED) and _SORTED[at].startswith(words + " ")


def identifiers(text: str | None) -> list[tuple[int, str, str]]:
    """``(sentence number, identifier, version)`` for the known sentences.  A
    sentence may be wrapped: pieces are joined as long as a known one begins
    so, and the longest one found counts as one."""
    out = []
    if not text:
        return out
    lower = text.lower()
    if "licen" not in lower and not any(w in lower for w in _TELLING):
        return out
    raw = [x for x in _CUT(text) if _MARKS(" ", x).strip()]
    pieces = [(_PROGRAM(r"this program is \1", w), v) for w, v in map(normalise, raw)]
    at = number = 0
    while at < len(pieces):
        words, version = pieces[at]
        end, known = at + 1, None
        while True:
            if words in _KNOWN:
                known = (end, _KNOWN[words], version)
            if end == len(pieces) or not _begins(words):
                break
            words, version = f"{words} {pieces[end][0]}", version or pieces[end][1]
            end += 1
        if known:
            at = known[0]
            out.append((number, *known[1:]))
        else:
            # what is no sentence that is known whole may still name licences
            named, took = [], 1
            tag = raw[at].lower().rfind("license-identifier:")
            if tag >= 0 and "spdx" in raw[at].lower():
                rest = raw[at][tag + len("license-identifier:") :]
                took = 1 if rest.strip() or at + 1 == len(raw) else 2
                named = _expression(rest if took == 1 else raw[at + 1])
            elif "under" in words:
                line, took = raw[at], 1
                named = _references(line)
                if at + 1 < len(raw) and (not named or line.rstrip()[-1:] not in ".!?;:"):  # wrapped
                    more = _references(f"{line} {raw[at + 1]}")
                    if len(more) > len(named) or (more and more != named):
                        named, took = more, 2
            out += [(number, f"named:{kind}:{name}", "") for name, kind in named]
            at += took if named else 1
        number += 1
    return out


_BY_FIRST: dict[str, list[int]] = {}
for _i, (_, _, _seq) in sorted(enumerate(_RULES), key=lambda x: (-len(x[1][2]), x[0])):
    _BY_FIRST.setdefault(_seq[0], []).append(_i)


def match(found: list[tuple[int, str, str]]) -> tuple[list[tuple[str, str]], list[str]]:
    """``(licence, class)`` of the rules matched in order, and the identifiers
    left over."""
    got, left, at = [], [], 0
    while at < len(found):
        if found[at][1].startswith("named:"):
            _, kind, name = found[at][1].split(":", 2)
            got.append((name, kind))
            at += 1
            continue
        for r in _BY_FIRST.get(found[at][1], ()):
            name, kind, seq = _RULES[r]
            part = found[at : at + len(seq)]
            if tuple(x[1] for x in part) == seq and all(b[0] - a[0] <= GAP + 1 for a, b in zip(part, part[1:])):
                version = next((x[2] for x in part if x[2]), "")
                got.append((name.replace("{v}", _whole(version)), kind))
                at += len(seq)
                break
        else:
            left.append(found[at][1])
            at += 1
    # a reservation of rights beside a licence takes nothing back
    granted = [x for x in got if x[1] != "proprietary"]
    return granted or got, left


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, licenses, classes, sentences, unmatched`` for each row: the
    licences and their classes in order of appearance, each once; the
    identifiers of known sentences in order, repeats included; and those that
    no rule took.

    A null, empty or other text without a known sentence has empty lists;
    repeated rows repeat; an empty table gives no rows; other columns are
    ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.string())
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(1).to_pylist():
                found = identifiers(text)
                got, left = match(found)
                got = list(dict.fromkeys(got))
                for c, x in zip(cols, ([n for n, _ in got], list(dict.fromkeys(k for _, k in got)), [n for _, n, _ in found], left)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, lists) for c in cols)], ["doc_id", "licenses", "classes", "sentences", "unmatched"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, licenses array<string>, classes array<string>, sentences array<string>, unmatched array<string>")
