"""License scans: ordered signature rules behind a keyword prefilter (DataFrame functions only).

A few hundred regexes, made from license families and the forms in which a text refers to one, and from
the sentences of licenses themselves, are tried only on texts that hold the rule's keywords. Each match is a detection with a priority; a
detection inside the interval of one that outranks it is suppressed. The plan is one pass over the
texts: no shuffle, nothing broadcast but the fixed rule table, which sits in the plan as a literal.

Defined results: a null or empty text has no words and no detection; repeated rows each get their own
result, ties of rules are settled by their order; texts of any length are scanned whole; further columns, whatever
their names, are carried along, but those with the names of results (n_words, base, detections, score) give way to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, spans, sql_text, text_of, unused

#: Characters that part words, for texts in their own case: ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label, SPDX words, family keyword, names (words parted by spaces; ``a|b`` are alternatives).
FAMILIES = (
    ("gpl-2.0", "gpl 2 0", "gpl|gnu", "gnu gpl|gpl|gnu general public license", "2(?:{g}0)?"),
    ("gpl-3.0", "gpl 3 0", "gpl|gnu", "gnu gpl|gpl|gnu general public license", "3(?:{g}0)?"),
    ("lgpl-2.1", "lgpl 2 1", "lgpl|gnu", "gnu lgpl|lgpl|gnu lesser general public license", "2{g}1"),
    ("lgpl-3.0", "lgpl 3 0", "lgpl|gnu", "gnu lgpl|lgpl|gnu lesser general public license", "3(?:{g}0)?"),
    ("agpl-3.0", "agpl 3 0", "agpl|gnu", "gnu agpl|agpl|gnu affero general public license", "3(?:{g}0)?"),
    ("gfdl-1.3", "gfdl 1 3", "gfdl|gnu", "gnu fdl|gfdl|gnu free documentation license", "1{g}3"),
    ("apache-1.1", "apache 1 1", "apache", "apache software license|apache license|apache", "1{g}1"),
    ("apache-2.0", "apache 2 0", "apache", "apache software license|apache license|apache", "2(?:{g}0)?"),
    ("mit", "mit", "mit|expat", "mit|expat", ""),
    ("mit-0", "mit 0", "mit", "mit no attribution", ""),
    ("bsd-2-clause", "bsd 2 clause", "bsd|freebsd", "simplified bsd|2 clause bsd|bsd 2 clause|freebsd", ""),
    ("bsd-3-clause", "bsd 3 clause", "bsd", "new bsd|revised bsd|3 clause bsd|bsd 3 clause|modified bsd", ""),
    ("bsd-4-clause", "bsd 4 clause", "bsd", "original bsd|4 clause bsd|bsd 4 clause", ""),
    ("0bsd", "0bsd", "bsd|0bsd", "zero clause bsd|0bsd", ""),
    ("isc", "isc", "isc", "isc", ""),
    ("zlib", "zlib", "zlib", "zlib|zlib libpng", ""),
    ("bsl-1.0", "bsl 1 0", "boost|bsl", "boost software", "1{g}0"),
    ("mpl-1.1", "mpl 1 1", "mozilla|mpl", "mozilla public license|mpl", "1{g}1"),
    ("mpl-2.0", "mpl 2 0", "mozilla|mpl", "mozilla public license|mpl", "2{g}0"),
    ("epl-1.0", "epl 1 0", "eclipse|epl", "eclipse public license|epl", "1{g}0"),
    ("epl-2.0", "epl 2 0", "eclipse|epl", "eclipse public license|epl", "2{g}0"),
    ("cddl-1.0", "cddl 1 0", "cddl|common development", "common development and distribution license|cddl", "1{g}0"),
    ("cpl-1.0", "cpl 1 0", "common public|cpl", "common public license|cpl", "1{g}0"),
    ("eupl-1.2", "eupl 1 2", "european union|eupl", "european union public licence|eupl", "1{g}2"),
    ("artistic-2.0", "artistic 2 0", "artistic", "artistic license|artistic", "2{g}0"),
    ("psf-2.0", "psf 2 0", "python software|psf", "python software foundation license|psf", "2"),
    ("ofl-1.1", "ofl 1 1", "open font|ofl", "sil open font license|open font license|ofl", "1{g}1"),
    ("odbl-1.0", "odbl 1 0", "open database|odbl", "open database license|odbl", "1{g}0"),
    ("odc-by-1.0", "odc by 1 0", "open data commons|odc", "open data commons attribution license|odc by", "1{g}0"),
    ("ms-pl", "ms pl", "microsoft|ms{g}pl", "microsoft public license|ms pl", ""),
    ("ms-rl", "ms rl", "microsoft|ms{g}rl", "microsoft reciprocal license|ms rl", ""),
    ("unlicense", "unlicense", "unlicense", "unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl", ""),
    ("cc0-1.0", "cc0 1 0", "cc0|creative commons", "cc0|creative commons zero", "1{g}0"),
    ("cc-by-3.0", "cc by 3 0", "cc{g}by|creative commons", "creative commons attribution|cc by", "3{g}0"),
    ("cc-by-4.0", "cc by 4 0", "cc{g}by|creative commons", "creative commons attribution|cc by", "4{g}0"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "cc{g}by|creative commons", "creative commons attribution sharealike|creative commons attribution share alike|cc by sa", "3{g}0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "cc{g}by|creative commons", "creative commons attribution sharealike|creative commons attribution share alike|cc by sa", "4{g}0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "cc{g}by|creative commons", "creative commons attribution noncommercial|creative commons attribution non commercial|cc by nc", "4{g}0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "cc{g}by|creative commons", "creative commons attribution noncommercial sharealike|cc by nc sa", "4{g}0"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "cc{g}by|creative commons", "creative commons attribution noderivatives|cc by nd", "4{g}0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "cc{g}by|creative commons", "creative commons attribution noncommercial noderivatives|cc by nc nd", "4{g}0"),
)

#: Form, context keywords, pattern ({n} name, {s} SPDX words, {i} SPDX identifier, {a} abbreviation, {v} version, {d} its first digit, {g} gap), priority,
#: confidence. Every match of a pattern holds one of its context keywords and one of its family's. Higher priorities outrank lower ones.
FORMS = (
    ("spdx", "spdx", "spdx{g}license{g}identifier{g}{s}(?:{g}(?:only|or{g}later))?", 6, 1.0),
    ("licensed-version", "licen", "licen[sc]ed{g}under{g}(?:the{g})?(?:terms{g}of{g}(?:the{g})?)?(?:{n})(?:{g}licen[sc]e)?{g}(?:version{g}|v)?{v}", 5, 0.98),
    ("licensed", "licen", "licen[sc]ed{g}under{g}(?:the{g})?(?:terms{g}of{g}(?:the{g})?)?(?:{n})(?:{g}licen[sc]e)?", 4, 0.9),
    ("released-version", "released under|distributed under|available under|published under", "(?:released|distributed|available|published){g}under{g}(?:the{g})?(?:terms{g}of{g}(?:the{g})?)?(?:{n})(?:{g}licen[sc]e)?{g}(?:version{g}|v)?{v}", 5, 0.98),
    ("released", "released under|distributed under|available under|published under", "(?:released|distributed|available|published){g}under{g}(?:the{g})?(?:terms{g}of{g}(?:the{g})?)?(?:{n})(?:{g}licen[sc]e)?", 4, 0.9),
    ("name-version", "version {d}|v{d}", "(?:{n})(?:{g}licen[sc]e)?{g}(?:version{g}|v){v}", 3, 0.85),
    ("name", "licen", "(?:{n}){g}licen[sc]e", 2, 0.7),
    ("tag", "licen", "licen[sc]e[\\x20\"']*[:=]{1,2}>?[\\x20\"']*{s}(?:{g}(?:only|or{g}later))?", 5, 0.98),
    ("identifier", "{s}", "{i}(?:-only|-or-later)?", 4, 0.9),
    ("short-version", "{a}v{d}", "(?:gnu{g})?{a}v{v}(?:{g}(?:only|or{g}later))?", 4, 0.9),
)

#: Families whose version is often written right after their letters, as GPLv3.
SHORT = ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "eupl")

#: Rules of one form only: label, keyword, pattern, priority, confidence.
SINGLE = (
    ("public-domain", "public domain", "(?:dedicated{g}to|released{g}into|in){g}the{g}public{g}domain", 3, 0.8),
    ("all-rights-reserved", "rights reserved", "all{g}rights{g}reserved", 1, 0.6),
    ("copyright-notice", "copyright", "copyright{g}(?:c{g})?[0-9]{4}", 1, 0.5),
    ("permission-notice", "permission is", "permission{g}is{g}hereby{g}granted{g}free{g}of{g}charge", 3, 0.8),
)

#: Sentences of the licenses' own texts as label, keyword, words (a keyword stands in every match), priority,
#: confidence. Gaps between words may be any run of characters that aren't letters or digits.
SENTENCES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 5, 0.95),
    ("mit", "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 4, 0.9),
    ("mit", "copyright", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 4, 0.85),
    ("mit-0", "restriction", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software", 4, 0.8),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 5, 0.95),
    ("hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose", 4, 0.85),
    ("postgresql", "copyright", "for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph", 5, 0.95),
    ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", 4, 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 4, 0.9),
    ("bsd", "redistribution", "redistributions of source code must retain the above copyright notice", 4, 0.9),
    ("bsd", "redistribution", "redistributions in binary form must reproduce the above copyright notice", 4, 0.9),
    ("bsd-3-clause", "contributors", "nor the names of its contributors may be used to endorse or promote products derived from this software", 5, 0.95),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 5, 0.95),
    ("bsd-2-clause-views", "conclusions", "the views and conclusions contained in the software and documentation are those of the authors", 5, 0.9),
    ("bsd", "copyright", "this software is provided by the copyright holders and contributors as is", 3, 0.85),
    ("apache-2.0", "license", "you may not use this file except in compliance with the license", 5, 0.95),
    ("apache-2.0", "license", "you may obtain a copy of the license at https? www apache org licenses license 2 0", 5, 1.0),
    ("apache-2.0", "license", "software distributed under the license is distributed on an as is basis", 4, 0.9),
    ("apache-2.0", "license", "see the license for the specific language governing permissions and limitations under the license", 4, 0.9),
    ("apache-2.0", "license", "licensed to the apache software foundation asf under one or more contributor license agreements", 5, 0.95),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 5, 0.9),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 4, 0.9),
    ("gpl", "warranty", "this program is distributed in the hope that it will be useful but without any warranty", 4, 0.85),
    ("gpl", "general public license", "you should have received a copy of the gnu general public license along with this program", 4, 0.9),
    ("gpl-2.0-or-later", "license", "either version 2 of the license or at your option any later version", 5, 0.95),
    ("gpl-3.0-or-later", "license", "either version 3 of the license or at your option any later version", 5, 0.95),
    ("gpl", "permitted", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 4, 0.9),
    ("lgpl", "lesser general public license", "you should have received a copy of the gnu lesser general public license", 5, 0.9),
    ("lgpl", "library general public license", "under the terms of the gnu library general public license", 5, 0.9),
    ("lgpl-2.1-or-later", "license", "either version 2 1 of the license or at your option any later version", 5, 0.95),
    ("agpl", "affero general public license", "you should have received a copy of the gnu affero general public license", 5, 0.9),
    ("gpl-exception", "exception", "as a special exception the copyright holders of this library give you permission to link this library", 5, 0.9),
    ("gpl-exception", "exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 5, 0.9),
    ("gfdl", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 5, 0.95),
    ("fsfap", "permitted", "copying and distribution of this file with or without modification are permitted in any medium without royalty", 5, 0.95),
    ("fsful", "permission", "this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", 5, 0.95),
    ("mpl-2.0", "license", "this source code form is subject to the terms of the mozilla public license v 2 0", 5, 1.0),
    ("mpl-2.0", "distributed with this file", "if a copy of the mpl was not distributed with this file you can obtain one at", 5, 0.95),
    ("mpl-1.1", "license", "the contents of this file are subject to the mozilla public license version 1 1", 5, 1.0),
    ("npl-1.1", "license", "the contents of this file are subject to the netscape public license version 1 1", 5, 1.0),
    ("cddl", "license", "the contents of this file are subject to the terms of the common development and distribution license", 5, 0.95),
    ("epl", "license", "this program and the accompanying materials are made available under the terms of the eclipse public license", 5, 0.95),
    ("cpl", "license", "the accompanying program is provided under the terms of this common public license", 5, 0.95),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain", 5, 1.0),
    ("unlicense", "compiled binary", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", 5, 0.95),
    ("wtfpl", "license", "do what the f[a-z*]{3} you want to public license", 5, 1.0),
    ("beerware", "beer", "as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer", 5, 1.0),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 5, 0.95),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 4, 0.9),
    ("zlib", "misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented", 4, 0.9),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 5, 0.95),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 5, 0.95),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young", 5, 0.95),
    ("json", "software shall", "the software shall be used for good not evil", 5, 1.0),
    ("ncsa", "licen", "university of illinois ncsa open source licen[sc]e", 5, 0.95),
    ("afl-3.0", "licen", "licensed under the academic free licen[sc]e version 3 0", 5, 1.0),
    ("osl-3.0", "licen", "licensed under the open software licen[sc]e version 3 0", 5, 1.0),
    ("artistic-1.0", "copyright holder", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 5, 0.95),
    ("artistic-1.0-perl", "perl", "you can redistribute it and or modify it under the same terms as perl itself", 5, 0.9),
    ("ruby", "ruby", "you can redistribute it and or modify it under the same terms as ruby itself", 5, 0.9),
    ("php-3.01", "php", "this product includes php software freely available from", 5, 0.95),
    ("psf-2.0", "python", "psf is making python available to licensee on an as is basis", 5, 0.95),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license", 5, 0.95),
    ("ofl-1.1", "font software", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", 4, 0.85),
    ("ms-pl", "license", "this license governs use of the accompanying software if you use the software you accept this license", 4, 0.8),
    ("libpng", "reference library", "the png reference library is supplied as is", 5, 0.9),
    ("curl", "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 5, 0.95),
    ("cc0-1.0", "public domain", "the person who associated a work with this deed has dedicated the work to the public domain", 5, 0.95),
    ("cc0-1.0", "copyright", "to the extent possible under law the author has waived all copyright and related or neighboring rights", 5, 0.95),
    ("cc-by", "creativecommons org", "creativecommons org licenses by [0-9] [0-9]", 5, 0.95),
    ("cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [0-9] [0-9]", 5, 0.95),
    ("cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [0-9] [0-9]", 5, 0.95),
    ("cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [0-9] [0-9]", 5, 0.95),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [0-9] [0-9]", 5, 0.95),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [0-9] [0-9]", 5, 0.95),
    ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0", 5, 0.95),
    ("public-domain", "creativecommons org", "creativecommons org publicdomain mark 1 0", 5, 0.95),
    ("cc", "creative commons", "this work is licensed under a creative commons", 4, 0.85),
    ("cc-by", "creative commons", "open access article distributed under the terms of the creative commons attribution licen[sc]e", 5, 0.95),
    ("cc", "permits", "permits unrestricted use distribution and reproduction in any medium provided the original work is properly (?:cited|credited)", 3, 0.8),
    ("ogl-uk-3.0", "licen", "contains public sector information licensed under the open government licen[sc]e v3 0", 5, 1.0),
    ("ogl-uk", "licen", "open government licen[sc]e", 3, 0.8),
    ("crown-copyright", "copyright", "crown copyright", 2, 0.6),
    ("gutenberg", "ebook", "this ebook is for the use of anyone anywhere (?:at no cost|in the united states)", 5, 0.95),
    ("public-domain", "public domain", "this work is in the public domain", 4, 0.85),
    ("public-domain", "public domain", "has been identified as being free of known restrictions under copyright law public domain", 4, 0.85),
    ("us-government", "government", "this is a work of the united states government", 4, 0.85),
    ("proprietary", "proprietary", "confidential and proprietary", 2, 0.7),
    ("proprietary", "copying", "unauthorized copying of this file via any medium is strictly prohibited", 4, 0.9),
    ("proprietary", "reproduced", "no part of this publication may be reproduced", 3, 0.85),
    ("proprietary", "reproduced", "may not be reproduced in any form without (?:prior|express|written)", 3, 0.8),
    ("proprietary", "redistribut", "not for redistribution", 2, 0.6),
    ("proprietary", "license", "end user license agreement", 3, 0.75),
    ("proprietary", "license", "software license agreement", 2, 0.7),
    ("non-commercial", "non commercial|noncommercial", "for non\\W?commercial use only", 3, 0.75),
    ("non-commercial", "non commercial|noncommercial", "non\\W?commercial purposes only", 3, 0.75),
    ("with-permission", "permission", "(?:used|reproduced|reprinted) with permission", 2, 0.6),
    ("royalty-free", "royalty", "royalty free licen[sc]e", 2, 0.6),
    ("permissive", "permission", "permission is granted to anyone to use this software for any purpose including commercial applications", 4, 0.85),
    ("cecill", "licen", "this software is governed by the cecill licen[sc]e", 5, 0.95),
    ("eupl", "licen", "licensed under the eupl", 5, 0.9),
    ("sspl-1.0", "license", "server side public license version 1", 5, 0.95),
    ("busl-1.1", "license", "business source license 1 1", 5, 0.95),
    ("elastic-2.0", "license", "elastic license 2 0", 5, 0.95),
    ("commons-clause", "condition", "commons clause license condition", 5, 0.95),
    ("odc-pddl-1.0", "dedication", "public domain dedication and license", 4, 0.85),
    ("vim", "vim", "vim is charityware you can use and copy it as much as you like", 5, 0.95),
)

LEVELS = 6


@dataclass(frozen=True)
class Rule:
    """``order`` settles ties of priority and extent: the smaller one wins."""

    order: int
    label: str
    context: str
    family: str
    pattern: str
    priority: int
    confidence: float


def _words(phrase: str) -> str:
    return "|".join(rf"{GAP}+".join(x.split()) for x in phrase.split("|"))


def _gates(phrases: Iterable[str]) -> str:
    """Alternatives of keywords, the longest first at any place, by first letter. Between two words of one there may also
    be any one character that isn't a letter or digit of ASCII, as ``\\W`` in a rule lets through."""
    groups: dict[str, list[str]] = {}
    for phrase in sorted(set(phrases), key=lambda k: (-len(k), k)):
        groups.setdefault(phrase[0], []).append(rf"(?:{GAP}+|\W)".join(phrase.split())[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


def _bounded(body: str) -> str:
    return rf"(?i)(?<!{WORD})(?:{body})(?!{WORD})"


def rules() -> list[Rule]:
    """Every rule in order, each pattern once a label. Families without a version get the forms of a version left out."""
    out: list[Rule] = []
    seen: set[tuple[str, str]] = set()
    gap = rf"{GAP}+"
    for form, context, pattern, priority, confidence in FORMS:
        for label, spdx, family, names, version in FAMILIES:
            if form.endswith("version") and not version:
                continue
            if form in ("licensed", "released", "name") and version:
                label = label.rsplit("-", 1)[0]  # no version said
            short = label.split("-")[0]
            if (form == "identifier" and not ("-" in label and re.search("[0-9]", label))) or (form == "short-version" and short not in SHORT):
                continue  # a word of the language, perhaps
            body = pattern.replace("{n}", _words(names)).replace("{s}", _words(spdx)).replace("{i}", re.escape(label)).replace("{a}", short)
            body = body.replace("{v}", version or "(?!)").replace("{g}", gap)
            if (label, body) in seen:  # versions of one family that aren't told apart here
                continue
            seen.add((label, body))
            out.append(Rule(len(out), label, context.replace("{d}", version[:1]).replace("{s}", spdx).replace("{a}", short), family.replace("{g}", " "), _bounded(body), priority, confidence))
    for label, keyword, pattern, priority, confidence in SINGLE:
        out.append(Rule(len(out), label, keyword, keyword, _bounded(pattern.replace("{g}", gap)), priority, confidence))
    for label, keyword, sentence, priority, confidence in SENTENCES:
        out.append(Rule(len(out), label, keyword, keyword, _bounded(gap.join(sentence.split(" "))), priority, confidence))
    return out


def _keywords(table: list[Rule]) -> set[str]:
    return {k for r in table for k in [*r.context.split("|"), *r.family.split("|")]}


def _rule_table(table: list[Rule]) -> str:
    rows = ", ".join(
        f"named_struct('label', {sql_text(r.label)}, 'ctx', array({', '.join(map(sql_text, r.context.split('|')))}), 'fam', array({', '.join(map(sql_text, r.family.split('|')))}), "
        f"'pattern', {sql_text(r.pattern)}, 'prio', {r.priority}, 'conf', {r.confidence}D, 'ord', {r.order})"
        for r in table
    )
    return f"array({rows})"


def detect_licenses(docs: DataFrame, text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """Add to each row of ``docs``:

    ``n_words``, ``base`` (places of the base phrases: label, s, e in code points, by place),
    ``detections`` (what stays of the rules' matches: label, s, e, prio, conf, ord) and ``score``
    (the highest confidence of a detection; a base phrase alone counts 0.7; else 0).
    """
    table = rules() if table is None else table
    if any(not 1 <= r.priority <= LEVELS for r in table):
        raise ValueError(f"priorities are 1 to {LEVELS}")
    t, g, ks = unused(docs, "t", "g", "k")
    df = docs.withColumn(t, text_of(text))
    df = df.withColumn("n_words", F.expr(f"cast(regexp_count({t}, {sql_text(WORD + '+')}) as bigint)"))

    # Context words open the scan; without one, and without a base phrase, no rule can match. All begin where a word does.
    gate = f"(?i)(?<!{WORD})(?:" + _gates({k for r in table for k in r.context.split("|")} | {phrase for phrase, _ in BASE}) + ")"
    df = df.withColumn(g, F.expr(f"{t} rlike {sql_text(gate)}"))

    base = ", ".join(f"transform({spans(t, sql_text(_bounded(_words(phrase))))}, x -> named_struct('s', x.s, 'e', x.e, 'label', {sql_text(label)}))" for phrase, label in BASE)
    df = df.withColumn("base", F.expr(f"case when {g} then array_sort(concat({base})) else cast(array() as array<struct<s:int,e:int,label:string>>) end"))

    found = _gates(_keywords(table))
    lower = "lower(regexp_replace(x, '[^A-Za-z0-9]+', ' '))"
    df = df.withColumn(ks, F.expr(f"case when {g} then array_distinct(transform(regexp_extract_all({t}, {sql_text(f'(?i)(?<!{WORD})(?=({found}))')}, 1), x -> {lower})) end"))
    # lookahead hits give the longest keyword at a place; shorter ones inside it count as well
    has = "exists(" + ks + ", k -> contains(k, {}))"
    live = f"filter({_rule_table(table)}, r -> exists(r.ctx, c -> {has.format('c')}) and exists(r.fam, f -> {has.format('f')}))"
    every = f"flatten(transform({live}, r -> transform({spans(t, 'r.pattern')}, x -> named_struct('s', x.s, 'ne', -x.e, 'np', -r.prio, 'ord', r.ord, 'label', r.label, 'conf', r.conf))))"
    # In order of start, then widest, then priority: a match is inside one that outranks it if a row
    # before it of at least its priority ends no earlier. tops[p] holds the furthest end at priority >= p.
    kept = (
        f"aggregate(array_sort({every}), named_struct('tops', array_repeat(-1, {LEVELS}), 'out', cast(array() as array<struct<s:int,e:int,prio:int,ord:int,label:string,conf:double>>)), "
        "(acc, d) -> named_struct('tops', transform(acc.tops, (t, i) -> case when i < -d.np then greatest(t, -d.ne) else t end), "
        "'out', case when element_at(acc.tops, -d.np) >= -d.ne then acc.out else concat(acc.out, array(named_struct('s', d.s, 'e', -d.ne, 'prio', -d.np, 'ord', d.ord, 'label', d.label, 'conf', d.conf))) end), "
        "acc -> acc.out)"
    )
    none = "cast(array() as array<struct<s:int,e:int,prio:int,ord:int,label:string,conf:double>>)"
    df = df.withColumn("detections", F.expr(f"case when size({ks}) > 0 then {kept} else {none} end"))
    df = df.withColumn("score", F.expr("greatest(coalesce(array_max(transform(detections, d -> d.conf)), 0D), case when size(base) > 0 then 0.7D else 0D end)"))
    return df.drop(t, g, ks)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, places of base phrases, their labels, all labels, and a score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    df = detect_licenses(docs)
    before = "cast(regexp_count(substring(coalesce(text, ''), 1, {}), " + sql_text(WORD + "+") + ") as bigint)"
    join = "array_join(array_sort(array_distinct({})), ',')"
    return df.select(
        "doc_id",
        "n_words",
        F.expr("cast(size(base) as bigint)").alias("n_base"),
        F.expr(f"case when size(base) > 0 then {before.format('base[0].s')} end").alias("first_word"),
        F.expr(f"case when size(base) > 0 then {before.format('base[size(base) - 1].s')} end").alias("last_word"),
        F.expr(join.format("transform(base, b -> b.label)")).alias("base_labels"),
        F.expr(join.format("concat(transform(base, b -> b.label), transform(detections, d -> d.label))")).alias("labels"),
        "score",
        F.expr("cast(size(detections) as bigint)").alias("n_detections"),
    )
