"""License detection by ordered signature rules.

A rule is a regular expression over the words of a text (lower-cased, one space
between) with a label, a priority, a confidence and the keywords that any of
its matches contains. The keywords gate it: a text is only searched with the
rules all of whose keywords it has, which the words' hashes tell for a whole
batch at once. Rules run in the order of their priority.

Overlaps are resolved by intervals: a detection that lies inside the interval
of one of higher priority, or of the same priority and more words, is
suppressed; of equal ones the earlier rule's stays. The base rules' places and
labels are reported before suppression and always stay.

Rules of one kind are whole sentences of license texts and notices, each
written by hand. The others come from families (names of licenses), SPDX
identifiers and short names, and contexts (phrasings around a name), which are
written by hand too: each pair makes a rule. Short names count in a context
only, unless their version tells them from a word.

Defined cases: a null or empty text has no words, no place, empty labels and
score 0. Rows are independent, so repeated rows and null ids are kept as they
are. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import ship
from .shared import table
from .words import ALNUM, U64, cut, slices

#: Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: the name as it stands in running words.
FAMILIES = {
    "agpl": r"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: v(?:ersion)? ?\d)?(?: 0)?",
    "lgpl": r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)(?: v(?:ersion)? ?\d(?: \d)?)?",
    "gpl-2.0": r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: v| version )2(?: 0)?",
    "gpl-3.0": r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: v| version )3(?: 0)?",
    "gpl": r"(?:gnu )?(?:general public licen[cs]e|gpl)",
    "gfdl": r"(?:gnu )?(?:free documentation licen[cs]e|gfdl)(?: v(?:ersion)? ?1(?: \d)?)?",
    "apache-2.0": r"apache(?: software)? licen[cs]e(?: version)?(?: v)? ?2(?: 0)?",
    "apache-1.1": r"apache(?: software)? licen[cs]e(?: version)? 1 1",
    "apache": r"apache(?: software)? licen[cs]e",
    "mit": r"mit(?: x11)? licen[cs]e",
    "x11": r"x11 licen[cs]e",
    "isc": r"isc licen[cs]e",
    "bsd-2-clause": r"(?:simplified bsd licen[cs]e|freebsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?)",
    "bsd-3-clause": r"(?:(?:new|revised|modified) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?)",
    "bsd": r"bsd(?: style)? licen[cs]e",
    "mpl-2.0": r"(?:mozilla public licen[cs]e|mpl)(?: v(?:ersion)?)? ?2(?: 0)?",
    "mpl": r"mozilla public licen[cs]e",
    "epl": r"eclipse public licen[cs]e(?: v(?:ersion)?)?(?: ?\d(?: \d)?)?",
    "eupl": r"european union public licen[cs]e(?: v(?:ersion)?)?(?: ?\d(?: \d)?)?",
    "cddl": r"common development and distribution licen[cs]e",
    "cpl": r"common public licen[cs]e",
    "artistic": r"artistic licen[cs]e(?: \d(?: \d)?)?",
    "boost": r"boost software licen[cs]e(?: version)?(?: 1 0)?",
    "zlib": r"zlib(?: libpng)? licen[cs]e",
    "unlicense": r"unlicense",
    "wtfpl": r"do what the f\w* you want to public licen[cs]e",
    "cc0": r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?",
    "cc-by": r"(?:cc by|creative commons attribution)(?: licen[cs]e)?(?: \d 0)?(?: international)?",
    "cc-by-sa": r"(?:cc by sa|creative commons attribution sharealike)(?: \d 0)?(?: international)?",
    "cc-by-nc": r"(?:cc by nc|creative commons attribution non ?commercial)(?: \d 0)?(?: international)?",
    "cc-by-nd": r"(?:cc by nd|creative commons attribution no ?deriv\w*)(?: \d 0)?(?: international)?",
    "cc-by-nc-sa": r"(?:cc by nc sa|creative commons attribution non ?commercial sharealike)(?: \d 0)?(?: international)?",
    "cc-by-nc-nd": r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)(?: \d 0)?(?: international)?",
    "odbl": r"open database licen[cs]e(?: v(?:ersion)?)?(?: ?1(?: 0)?)?",
    "odc-by": r"open data commons attribution licen[cs]e",
    "ofl": r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 \d)?",
    "openrail": r"openrail(?: [ms])?(?: licen[cs]e)?",
    "ms-pl": r"microsoft public licen[cs]e",
    "python": r"(?:python software foundation|psf) licen[cs]e(?: version)?(?: \d)?",
    "public-domain": r"public domain",
}
#: (phrasing with the name at {}, its words that gate it, priority, confidence)
CONTEXTS = [
    (r"spdx licen[cs]e identifier {}", ("spdx", "identifier"), 9, 0.99),
    (r"licensed under (?:the )?(?:terms of )?(?:the )?{}", ("licensed", "under"), 8, 0.95),
    (r"released (?:under|into) (?:the )?(?:terms of )?(?:the )?{}", ("released",), 8, 0.95),
    (r"distributed under (?:the )?(?:terms of )?(?:the )?{}", ("distributed", "under"), 8, 0.95),
    (r"(?:available|provided|published|shared) under (?:the )?(?:terms of )?(?:the )?{}", ("under",), 8, 0.9),
    (r"(?:governed|covered) by (?:the )?(?:terms of )?(?:the )?{}", ("by",), 7, 0.85),
    (r"subject to (?:the )?(?:terms of )?(?:the )?{}", ("subject", "to"), 7, 0.85),
    (r"terms of (?:the )?{}", ("terms", "of"), 6, 0.8),
    (r"{}", (), 4, 0.6),
]
_LATER = r"(?: only| or later)?"
#: SPDX identifiers and short names, by hand: (label, expression, words one of which any match has, whether it also counts outside of a context)
SHORT = [
    ("agpl", rf"(?:gnu )?agpl(?: ?v? ?[13](?: 0)?)?{_LATER}", ("agpl", "agplv3", "agpl3"), False),
    ("lgpl", rf"(?:gnu )?lgpl(?: ?v? ?[23](?: [01])?)?{_LATER}", ("lgpl", "lgplv2", "lgplv3", "lgpl2", "lgpl3"), False),
    ("gpl-2.0", rf"(?:gnu )?(?:general public licen[cs]e|gpl) ?v? ?2(?: 0)?{_LATER}", ("general", "gpl", "gplv2", "gpl2"), True),
    ("gpl-3.0", rf"(?:gnu )?(?:general public licen[cs]e|gpl) ?v? ?3(?: 0)?{_LATER}", ("general", "gpl", "gplv3", "gpl3"), True),
    ("gfdl", rf"(?:gnu )?gfdl(?: 1 [123])?{_LATER}", ("gfdl",), False),
    ("apache-2.0", r"apache(?: software)?(?: licen[cs]e)?(?: version)?(?: v)? ?(?:2|v2)(?: 0)?", ("apache", "apache2"), True),
    ("apache-1.1", r"apache 1 1", ("apache",), True),
    ("mit", r"mit(?: 0)?", ("mit",), False), ("x11", r"x11", ("x11",), False), ("isc", r"isc", ("isc",), False),
    ("bsd-2-clause", r"bsd 2 clause(?: patent| views)?", ("bsd",), False), ("bsd-3-clause", r"bsd 3 clause(?: clear)?", ("bsd",), False), ("bsd", r"bsd(?: 4 clause| 1 clause)?", ("bsd",), False),
    ("mpl-2.0", r"mpl(?: v)? ?2(?: 0)?", ("mpl", "mpl2"), True), ("mpl", r"mpl(?: 1 [01])?", ("mpl",), False), ("epl", r"epl(?: v)?(?: [12](?: 0)?)?", ("epl",), False),
    ("eupl", r"eupl(?: v)?(?: 1(?: [012])?)?", ("eupl",), False), ("cddl", r"cddl(?: 1 [01])?", ("cddl",), False), ("cpl", r"cpl 1 0", ("cpl",), False), ("artistic", r"artistic [12](?: 0)?(?: perl| cl8)?", ("artistic",), False),
    ("boost", r"(?:bsl 1 0|boost(?: 1 0)?)", ("bsl", "boost"), False), ("zlib", r"zlib(?: acknowledgement)?", ("zlib",), False), ("unlicense", r"unlicense", ("unlicense",), False), ("wtfpl", r"wtfpl", ("wtfpl",), True), ("cc0", r"cc0(?: 1 0)?", ("cc0",), False),
    *[(f"cc-{x}", rf"cc {x.replace('-', ' ')}(?: [1234] [05])?", ("cc",), False) for x in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")],
    ("odbl", r"odbl(?: 1 0)?", ("odbl",), False), ("odc-by", r"odc by(?: 1 0)?", ("odc",), False), ("ofl", r"(?:sil )?ofl(?: 1 [01](?: (?:no )?rfn)?)?", ("ofl",), False), ("ms-pl", r"ms pl", ("pl",), False), ("python", r"(?:psf|python)(?: 2 0(?: 1)?)?", ("psf", "python"), False),
]
#: Rules of their own: (label, expression, keywords, priority, confidence)
NOTICES = [
    ("reserved", r"all rights reserved", ("all", "rights", "reserved"), 3, 0.7),
    ("reserved", r"copyright (?:c )?(?:\d{4} )?(?:\S+ ){0,6}all rights reserved", ("copyright", "all", "rights", "reserved"), 5, 0.9),
    ("reserved", r"no part of this \S+ may be reproduced", ("no", "part", "reproduced"), 5, 0.9),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("permission", "hereby", "granted", "obtaining"), 9, 0.99),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", ("permission", "copy", "modify", "distribute"), 9, 0.99),
    ("bsd", r"redistribution and use in source and binary forms", ("redistribution", "source", "binary"), 9, 0.97),
    ("warranty", r"without warranty of any kind", ("without", "warranty"), 2, 0.4),
    ("proprietary", r"proprietary and confidential", ("proprietary", "confidential"), 5, 0.8),
    ("copyright", r"copyright (?:c )?\d{4}", ("copyright",), 1, 0.3),
]
#: Sentences that stand in one license or its notice: (label, expression, keywords). They have priority 7 and confidence 0.95.
SENTENCES = [
    ("gpl", r"this program is free software you can redistribute it and or modify", ("program", "redistribute", "modify")),
    ("gpl", r"either version \d of the license or at your option any later version", ("version", "option", "later")),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", ("received", "gnu", "general")),
    ("gpl", r"the licenses for most software are designed to take away your freedom", ("designed", "freedom")),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", ("permitted", "verbatim")),
    ("gpl", r"work based on the program means either the program or any derivative work", ("program", "derivative")),
    ("gpl-2.0", r"you must cause the modified files to carry prominent notices", ("cause", "modified", "prominent")),
    ("gpl-2.0", r"59 temple place suite 330 boston", ("temple", "suite", "boston")),
    ("gpl-2.0", r"51 franklin st(?:reet)? fifth floor boston", ("franklin", "fifth", "boston")),
    ("gpl-3.0", r"to propagate a work means to do anything with it that without permission", ("propagate", "permission")),
    ("gpl-3.0", r"the corresponding source for a work in object code form", ("corresponding", "object")),
    ("gpl-3.0", r"no covered work shall be deemed part of an effective technological measure", ("covered", "technological", "measure")),
    ("gpl-3.0", r"a user product is either a consumer product", ("user", "consumer", "product")),
    ("lgpl", r"this library is free software you can redistribute it and or modify", ("library", "redistribute", "modify")),
    ("lgpl", r"you should have received a copy of the gnu lesser general public licen[cs]e", ("received", "gnu", "lesser")),
    ("lgpl", r"a program that contains no derivative of any portion of the library", ("derivative", "portion", "library")),
    ("lgpl", r"work that uses the library", ("uses", "library")),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e", ("received", "gnu", "affero")),
    ("agpl", r"all users interacting with it remotely through a computer network", ("users", "interacting", "remotely", "network")),
    ("agpl", r"prominently offer all users an opportunity to receive the corresponding source", ("prominently", "opportunity", "corresponding")),
    ("gfdl", r"permission is granted to copy distribute and or modify this document", ("permission", "granted", "document")),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", ("invariant", "sections", "cover")),
    ("gfdl", r"a secondary section is a named appendix or a front matter section", ("secondary", "appendix", "matter")),
    ("apache-2.0", r"you may not use this file except in compliance with the license", ("file", "except", "compliance")),
    ("apache-2.0", r"you may obtain a copy of the license at http www apache org licenses license 2 0", ("obtain", "apache", "org")),
    ("apache-2.0", r"www apache org licenses license 2 0", ("www", "apache", "org")),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license", ("unless", "applicable", "writing")),
    ("apache-2.0", r"grant of copyright licen[cs]e subject to the terms and conditions of this license each contributor", ("grant", "subject", "contributor")),
    ("apache-2.0", r"if the work includes a notice text file as part of its distribution", ("work", "notice", "file", "distribution")),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", ("product", "developed", "apache", "foundation")),
    ("apache-1.1", r"products derived from this software may not be called apache", ("products", "derived", "called", "apache")),
    ("mit", r"to deal in the software without restriction including without limitation the rights", ("deal", "restriction", "limitation")),
    ("mit", r"use copy modify merge publish distribute sublicense and or sell", ("merge", "publish", "sublicense", "sell")),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", ("above", "notice", "permission", "included")),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim", ("event", "authors", "holders", "liable")),
    ("x11", r"the name of the x consortium shall not be used in advertising", ("consortium", "advertising")),
    ("isc", r"the software is provided as is and the author disclaims all warranties", ("provided", "author", "disclaims", "warranties")),
    ("isc", r"the author disclaims all warranties with regard to this software", ("author", "disclaims", "regard")),
    ("bsd", r"redistributions of source code must retain the above copyright notice", ("redistributions", "retain", "notice")),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", ("redistributions", "binary", "reproduce")),
    ("bsd", r"this software is provided by the (?:copyright holders|authors?|regents) and contributors as is", ("provided", "contributors")),
    ("bsd-3-clause", r"neither the names? of .{0,80}? may be used to endorse or promote products", ("neither", "endorse", "promote")),
    ("bsd-3-clause", r"the name of the author may not be used to endorse or promote products", ("name", "author", "endorse", "promote")),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", ("advertising", "materials", "mentioning")),
    ("bsd-4-clause", r"this product includes software developed by the university of california berkeley", ("product", "university", "california", "berkeley")),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", ("permission", "fee", "granted")),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", ("form", "subject", "mozilla")),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", ("mpl", "distributed", "obtain")),
    ("mpl-2.0", r"mozilla org mpl 2 0", ("mozilla", "org", "mpl")),
    ("mpl-2.0", r"this source code form is incompatible with secondary licenses", ("form", "incompatible", "secondary")),
    ("mpl", r"the contents of this file are subject to the mozilla public licen[cs]e", ("contents", "subject", "mozilla")),
    ("mpl", r"the initial developer of the original code is", ("initial", "developer", "original")),
    ("mpl", r"alternatively the contents of this file may be used under the terms of", ("alternatively", "contents", "terms")),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", ("program", "accompanying", "eclipse")),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e", ("accompanying", "provided", "eclipse")),
    ("epl", r"www eclipse org legal epl", ("www", "eclipse", "legal")),
    ("eupl", r"licensed under the eupl version 1 \d(?: or as soon they will be approved)?", ("licensed", "eupl", "version")),
    ("eupl", r"as soon they will be approved by the european commission subsequent versions of the eupl", ("approved", "european", "commission", "eupl")),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", ("contents", "subject", "development", "distribution")),
    ("cddl", r"opensource org licenses cddl", ("opensource", "cddl")),
    ("cpl", r"the accompanying program is provided under the terms of this common public licen[cs]e", ("accompanying", "provided", "common")),
    ("artistic", r"the package refers to the collection of files distributed by the copyright holder", ("package", "collection", "holder")),
    ("artistic", r"you may make and give away verbatim copies of the source form of the standard version", ("verbatim", "source", "standard")),
    ("artistic", r"same terms as perl itself", ("same", "terms", "perl")),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ("organization", "obtaining", "accompanying")),
    ("boost", r"www boost org license 1 0 txt", ("www", "boost", "txt")),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("provided", "express", "implied", "held")),
    ("zlib", r"altered source versions must be plainly marked as such", ("altered", "versions", "plainly", "marked")),
    ("zlib", r"the origin of this software must not be misrepresented", ("origin", "misrepresented")),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered", "released", "domain")),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", ("anyone", "compile", "sell")),
    ("unlicense", r"unlicense org", ("unlicense", "org")),
    ("wtfpl", r"you just do what the f\w* you want to", ("just", "want")),
    ("cc0", r"has waived all copyright and related or neighboring rights", ("waived", "related", "neighboring")),
    ("cc0", r"creativecommons org publicdomain zero 1 0", ("creativecommons", "publicdomain", "zero")),
    ("cc0", r"to the extent possible under law .{0,80}? has waived all copyright", ("extent", "possible", "waived")),
    ("cc-by", r"creativecommons org licenses by [1234] [05]", ("creativecommons", "licenses", "by")),
    ("cc-by-sa", r"creativecommons org licenses by sa [1234] [05]", ("creativecommons", "licenses", "sa")),
    ("cc-by-nc", r"creativecommons org licenses by nc [1234] [05]", ("creativecommons", "licenses", "nc")),
    ("cc-by-nd", r"creativecommons org licenses by nd [1234] [05]", ("creativecommons", "licenses", "nd")),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [1234] [05]", ("creativecommons", "nc", "sa")),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [1234] [05]", ("creativecommons", "nc", "nd")),
    ("cc-by-sa", r"text is available under the creative commons attribution sharealike", ("text", "creative", "sharealike")),
    ("cc-by", r"some rights reserved", ("some", "rights", "reserved")),
    ("odbl", r"opendatacommons org licenses odbl", ("opendatacommons", "odbl")),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents licen[cs]e", ("individual", "contents", "database")),
    ("odc-by", r"opendatacommons org licenses by", ("opendatacommons", "by")),
    ("ofl", r"the font software may be sold as part of a larger software package", ("font", "sold", "package")),
    ("ofl", r"with reserved font name", ("reserved", "font", "name")),
    ("ofl", r"scripts sil org ofl", ("scripts", "sil", "ofl")),
    ("openrail", r"use based restrictions as referenced in paragraph", ("restrictions", "referenced", "paragraph")),
    ("ms-pl", r"if you bring a patent claim against any contributor over patents that you claim are infringed", ("patent", "contributor", "infringed")),
    ("python", r"psf is making python available to licensee on an as is basis", ("psf", "python", "licensee")),
    ("python", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e", ("psf", "grants", "licensee")),
    ("openssl", r"this product includes software developed by the openssl project", ("product", "developed", "openssl")),
    ("openssl", r"this product includes cryptographic software written by eric young", ("product", "cryptographic", "young")),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights", ("deal", "with", "restriction")),
    ("ncsa", r"university of illinois ncsa open source licen[cs]e", ("university", "illinois", "ncsa")),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", ("documentation", "fee", "written", "agreement")),
    ("hpnd", r"the name of the copyright holder not be used in advertising or publicity", ("holder", "advertising", "publicity")),
    ("json", r"the software shall be used for good not evil", ("good", "evil")),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", ("meet", "stuff", "beer")),
    ("vim", r"vim is charityware", ("vim", "charityware")),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", ("based", "independent", "jpeg")),
    ("libpng", r"the contributing authors and glenn randers pehrson", ("contributing", "glenn", "pehrson")),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", ("permission", "fee", "provided", "notice")),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", ("permission", "unicode", "data")),
    ("ofl", r"neither the font software nor any of its individual components", ("neither", "font", "components")),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized", "copying", "prohibited")),
    ("proprietary", r"this software is the confidential and proprietary information of", ("confidential", "proprietary", "information")),
    ("proprietary", r"may not be reproduced distributed or transmitted in any form or by any means", ("reproduced", "transmitted", "means")),
    ("proprietary", r"without the prior written permission of the publisher", ("prior", "written", "publisher")),
    ("proprietary", r"for internal use only", ("internal", "use", "only")),
    ("proprietary", r"end user licen[cs]e agreement", ("end", "user", "agreement")),
    ("public-domain", r"the authors? (?:of this \S+ )?disclaims? copyright to this source code", ("disclaims", "source")),
    ("public-domain", r"is hereby placed in the public domain", ("hereby", "placed", "domain")),
    ("public-domain", r"dedicated? (?:this work )?to the public domain", ("to", "domain")),
]
#: The words one of which any match of a family has; by default the longest fixed word of its expression.
_FAMILY_GATES = {
    "agpl": ("affero", "agpl"), "lgpl": ("lesser", "library", "lgpl"), "gpl-2.0": ("general", "gpl"), "gpl-3.0": ("general", "gpl"), "gpl": ("general", "gpl"), "gfdl": ("documentation", "gfdl"),
    "bsd-2-clause": ("bsd", "freebsd"), "bsd-3-clause": ("bsd",), "mpl-2.0": ("mozilla", "mpl"), "cc0": ("cc0", "zero"), "python": ("python", "psf"), "cc-by": ("cc", "commons"), "cc-by-sa": ("cc", "commons"),
    "cc-by-nc": ("cc", "commons"), "cc-by-nd": ("cc", "commons"), "cc-by-nc-sa": ("cc", "commons"), "cc-by-nc-nd": ("cc", "commons"), "mit": ("mit",), "x11": ("x11",), "isc": ("isc",), "bsd": ("bsd",), "cpl": ("common",), "public-domain": ("domain",),
}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[tuple[str, ...], ...]  # one of each group
    priority: int
    confidence: float
    base: bool = False


def _compiled(expression: str) -> re.Pattern:
    return re.compile(rf"(?<!\S)(?:{expression})(?!\S)".encode())


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in the order in which they run."""
    out = []
    for label, name in FAMILIES.items():
        gate = _FAMILY_GATES.get(label) or (max(re.findall(r"[a-z]{3,}", re.sub(r"licen\[cs\]e|\\.|\([^)]*\)\?", " ", name)), key=len),)
        for phrase, keywords, priority, confidence in CONTEXTS:
            out.append(Rule(label, _compiled(phrase.replace("{}", f"(?:{name})")), (*((k,) for k in keywords), gate), priority, confidence))
    for label, name, gate, bare in SHORT:
        for phrase, keywords, priority, confidence in [*CONTEXTS, (r"(?:or|and) {}", ("spdx", "identifier"), 8, 0.9)]:
            if phrase != "{}" or bare:
                out.append(Rule(label, _compiled(phrase.replace("{}", f"(?:{name})")), (*((k,) for k in keywords), gate), priority, confidence))
    out += [Rule(label, _compiled(expression), tuple((k,) for k in keywords), priority, confidence) for label, expression, keywords, priority, confidence in NOTICES]
    out += [Rule(label, _compiled(expression), tuple((k,) for k in keywords), 7, 0.95) for label, expression, keywords in SENTENCES]
    out += [Rule(label, _compiled(phrase), tuple((k,) for k in phrase.split()), 0, 0.5, True) for phrase, label in BASE.items()]
    return tuple(sorted(out, key=lambda r: -r.priority))


@dataclass
class Gate:
    """The keywords of all rules, as sorted hashes behind a table of their first bits."""

    words: list[str]
    hashes: np.ndarray
    first: np.ndarray
    groups: list[list[np.ndarray]]  # rule -> keyword groups, as places in ``hashes``

    def present(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Texts x keywords."""
        near = np.flatnonzero(self.first[hashes >> U64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[near]
        out = np.zeros((n, len(self.hashes)), bool)
        out[doc[near[hit]], at[hit]] = True
        return out


@lru_cache(maxsize=1)
def gate() -> Gate:
    words = sorted({w for r in rules() for group in r.keywords for w in group})
    hashes = cut(pa.array([" ".join(words)]), ALNUM, lower=True).hashes()
    order = np.argsort(hashes)
    place = {words[j]: i for i, j in enumerate(order)}
    first = np.zeros(1 << 20, bool)
    first[hashes >> U64(44)] = True
    return Gate([words[i] for i in order], hashes[order], first, [[np.array([place[w] for w in group]) for group in r.keywords] for r in rules()])


@dataclass(frozen=True)
class Detection:
    label: str
    start: int
    end: int
    priority: int
    confidence: float
    order: int
    base: bool


def detect(normal: bytes, allowed: list[int]) -> list[Detection]:
    """Everything that the rules (by their number) find in words joined by one space; places count words."""
    out = []
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20)
    for i in allowed:
        r = rules()[i]
        at = [m.span() for m in r.pattern.finditer(normal)]
        words = np.searchsorted(spaces, np.array(at, np.int64).reshape(-1, 2))  # spaces before: the word's number
        out += [Detection(r.label, start, end + 1, r.priority, r.confidence, i, r.base) for start, end in words.tolist()]
    return out


def suppress(found: list[Detection]) -> list[Detection]:
    """What stays after containment in intervals of higher rank.

    One pass in the order of rank. What is suppressed lies inside something
    kept, so it's enough to know for each start the greatest end of all
    intervals of higher rank that start there or before: a tree of maxima.
    """
    kept: list[Detection] = []
    starts = sorted({d.start for d in found})
    place = {x: i + 1 for i, x in enumerate(starts)}
    most = [-1] * (len(starts) + 1)
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.order, d.start)):
        i, end = place[d.start], -1
        while i:
            end = max(end, most[i])
            i &= i - 1
        if end < d.end:
            kept.append(d)
            i = place[d.start]
            while i < len(most):
                most[i] = max(most[i], d.end)
                i += i & -i
    return kept


_TO_SPACE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if ALNUM[b] else 0x20 for b in range(256))
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g = gate()
    for batch in batches:
        for part in slices(batch):
            words = cut(part.column("text"), ALNUM, lower=True)
            n = part.num_rows
            present = g.present(words.hashes(), words.doc, n)
            ready = np.ones((n, len(g.groups)), bool)
            for i, groups in enumerate(g.groups):
                for group in groups:
                    ready[:, i] &= present[:, group].any(axis=1)
            n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
            base_labels, labels, scores = [""] * n, [""] * n, np.zeros(n)
            for d in np.flatnonzero(ready.any(axis=1)).tolist():
                a, b = words.offsets[d], words.offsets[d + 1]
                raw = words.data[words.start[a] : words.end[b - 1]].tobytes()
                normal = b" ".join(raw.translate(_TO_SPACE).split())
                found = detect(normal, np.flatnonzero(ready[d]).tolist())
                base = [x for x in found if x.base]
                kept = suppress(found)
                if base:
                    n_base[d], first[d], last[d] = len(base), min(x.start for x in base), max(x.start for x in base)
                    base_labels[d] = ",".join(sorted({x.label for x in base}))
                labels[d] = ",".join(sorted({x.label for x in kept} | {x.label for x in base}))
                scores[d] = 1 - np.prod([1 - x.confidence for x in kept]) if kept else 0.0
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(scores)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
