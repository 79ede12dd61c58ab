"""License scans by ordered signature rules.

Texts become lower-case words joined by single spaces. The rules are regexes over that form: for each license family
its grant ("licensed under the ..."), its SPDX line, its address and its plain mention; and notices, choices of licenses,
exceptions, "or later" and "only", and sentences of the licenses' own texts. A rule runs only where the literals occur
that its own regex requires. Rules are ordered by priority; a detection whose words lie inside those of a detection of
higher priority, or of an earlier and longer one of the same, is suppressed.
"""

from __future__ import annotations

import bisect
import re
import re._parser as grammar
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, table, text_batches

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label; names (regex over words); SPDX identifiers as words; address as words
FAMILIES = (
    ("mit", "mit(?: x11| expat)? licen[cs]e|(?:x11|expat) licen[cs]e", "mit", "opensource org licenses? mit"),
    ("apache-2", "apache(?: software)? license(?: version)? 2(?: 0)?|apache 2(?: 0)?(?: license)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", "apache(?: software)? license(?: version)? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("bsd-2-clause", "(?:bsd 2 clause|simplified bsd|freebsd|two clause bsd)(?: license)?", "bsd 2 clause", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "(?:bsd 3 clause|new bsd|modified bsd|three clause bsd|revised bsd)(?: license)?", "bsd 3 clause", "opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", "(?:bsd 4 clause|original bsd|four clause bsd)(?: license)?", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("bsd", "bsd(?: style)? license", "0bsd", "opensource org licenses? bsd license"),
    ("gpl-2", "(?:gnu )?(?:gpl|general public license)(?: gpl)? (?:version 2|v2|2)(?: 0)?|gplv?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "(?:gnu )?(?:gpl|general public license)(?: gpl)? (?:version 3|v3|3)(?: 0)?|gplv?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu (?:gpl|general public license)|gpl(?: license)?", "gpl", "gnu org licenses gpl"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license)(?: lgpl)? (?:version 2 1|v2 1|2 1)|lgplv?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "(?:gnu )?(?:lgpl|lesser general public license)(?: lgpl)? (?:version 3|v3|3)(?: 0)?|lgplv?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", "gnu (?:lesser|library) general public license|lgpl(?: license)?", "lgpl", "gnu org licenses lgpl"),
    ("agpl-3", "(?:gnu )?(?:agpl|affero general public license)(?: (?:version 3|v3|3)(?: 0)?)?|agplv?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl"),
    ("mpl-1.1", "(?:mozilla public license|mpl)(?: version)? 1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2", "(?:mozilla public license|mpl)(?: version)? (?:v ?)?2(?: 0)?|mplv?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1", "(?:eclipse public license|epl)(?: version)? (?:v )?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", "(?:eclipse public license|epl)(?: version)? (?:v )?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl", "common development and distribution license|cddl", "cddl 1 [01]", "opensource org licenses? cddl 1 0"),
    ("artistic-2", "artistic license(?: version)? 2(?: 0)?", "artistic 2 0", "perlfoundation org artistic license 2 0"),
    ("artistic", "artistic license", "artistic 1 0", "opensource org licenses? artistic license"),
    ("isc", "isc license", "isc", "opensource org licenses? isc"),
    ("zlib", "zlib(?: libpng)? license", "zlib", "zlib net zlib license"),
    ("unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "do what the fuck you want to public license|wtfpl", "wtfpl", "wtfpl net"),
    ("boost", "boost software license(?: version 1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("eupl", "european union public licen[cs]e|eupl(?: v?1 [012])?", "eupl 1 [012]", "joinup ec europa eu collection eupl"),
    ("cecill", "cecill(?: [bc])?(?: license)?", "cecill(?: [bc])?(?: [12] [01])?", "cecill info licences"),
    ("python", "python software foundation license|psf license", "psf 2 0|python 2 0", "docs python org license"),
    ("openssl", "openssl license", "openssl", "openssl org source license"),
    ("postgresql", "postgresql license", "postgresql", "postgresql org about licence"),
    ("php", "php license(?: version)?(?: 3 01?)?", "php 3 01?", "php net license"),
    ("ofl", "(?:sil )?open font license(?: version 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("ms-pl", "microsoft public license|ms pl", "ms pl", "opensource org licenses? ms pl"),
    ("ms-rl", "microsoft reciprocal license|ms rl", "ms rl", "opensource org licenses? ms rl"),
    ("cc0", "creative commons zero|cc0(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creative commons attribution(?: [1234] 0)?|cc by(?: [1234] 0)", "cc by [1234] 0", "creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: [1234] 0)?|cc by sa(?: [1234] 0)?", "cc by sa [1234] 0", "creativecommons org licenses by sa"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s(?: [1234] 0)?|cc by nd(?: [1234] 0)?", "cc by nd [1234] 0", "creativecommons org licenses by nd"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: [1234] 0)?|cc by nc(?: [1234] 0)?", "cc by nc [1234] 0", "creativecommons org licenses by nc"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1234] 0)?|cc by nc sa(?: [1234] 0)?", "cc by nc sa [1234] 0", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] 0)?|cc by nc nd(?: [1234] 0)?", "cc by nc nd [1234] 0", "creativecommons org licenses by nc nd"),
    ("gfdl", "(?:gnu )?free documentation license|gfdl", "gfdl 1 [123](?: only| or later)?", "gnu org licenses fdl"),
    ("odbl", "open database license|odbl", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("pddl", "public domain dedication and license|pddl", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("ogl-uk", "open government licen[cs]e(?: v?[123] 0)?", "ogl uk [123] 0", "nationalarchives gov uk doc open government licence"),
    ("public-domain", "(?:in|into|to) the public domain", "cc pddc", "creativecommons org licenses publicdomain"),
    ("bsl", "business source license(?: 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("sspl", "server side public license|sspl", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic", "elastic license(?: 2 0| v2)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("openrail", "(?:big ?science |creativeml )?open ?rail(?: [ms]| m\\+\\+)?(?: license)?", "openrail(?: m)?", "huggingface co spaces bigscience license"),
    ("llama", "llama [234](?: [123])? community license", "llama [234]", "ai meta com llama license"),
    ("proprietary", "all rights reserved|proprietary and confidential", "licenseref proprietary", "all rights reserved worldwide"),
)

FSF = "(?:as published by the free software foundation )?(?:either )?"
LATER = "(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?later(?: versions?)?"
ONLY = "(?: 0)?(?: of the license)? only"
WITH = "(?:with|and) (?:the |a )?(?:special )?"

#: priority, label, words: notices, exceptions and sentences of the licenses' own texts
NOTICES = (
    # later versions, one version only
    (0, "gpl-2-or-later", "(?:gnu )?(?:gpl|general public license) " + FSF + "(?:version |v)?2" + LATER),
    (0, "gpl-3-or-later", "(?:gnu )?(?:gpl|general public license) " + FSF + "(?:version |v)?3" + LATER),
    (0, "lgpl-2.1-or-later", "(?:gnu )?(?:lgpl|lesser general public license) " + FSF + "(?:version |v)?2 1" + LATER),
    (0, "lgpl-3-or-later", "(?:gnu )?(?:lgpl|lesser general public license) " + FSF + "(?:version |v)?3" + LATER),
    (0, "lgpl-2-or-later", "(?:gnu )?(?:library general public license|lgpl) " + FSF + "(?:version |v)?2" + LATER),
    (0, "agpl-3-or-later", "(?:gnu )?(?:agpl|affero general public license) " + FSF + "(?:version |v)?3" + LATER),
    (0, "gfdl-or-later", "free documentation license version 1 [123] or any later version"),
    (0, "gpl-2-or-later", "spdx license identifier gpl 2 0 or later"),
    (0, "gpl-3-or-later", "spdx license identifier gpl 3 0 or later"),
    (0, "lgpl-2.1-or-later", "spdx license identifier lgpl 2 1 or later"),
    (0, "lgpl-3-or-later", "spdx license identifier lgpl 3 0 or later"),
    (0, "agpl-3-or-later", "spdx license identifier agpl 3 0 or later"),
    (0, "gpl-2-only", "(?:gnu )?(?:gpl|general public license) " + FSF + "(?:version |v)?2" + ONLY),
    (0, "gpl-3-only", "(?:gnu )?(?:gpl|general public license) " + FSF + "(?:version |v)?3" + ONLY),
    (0, "gpl-2-only", "spdx license identifier gpl 2 0 only"),
    (0, "gpl-3-only", "spdx license identifier gpl 3 0 only"),
    (0, "lgpl-2.1-only", "spdx license identifier lgpl 2 1 only"),
    (0, "agpl-3-only", "spdx license identifier agpl 3 0 only"),
    # exceptions
    (0, "classpath-exception", "(?:gpl 2 0(?: only| or later)? )?with classpath exception(?: 2 0)?|classpath exception"),
    (0, "classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    (0, "gcc-exception", WITH + "gcc runtime library exception|gcc exception 3 1"),
    (0, "linux-syscall-note", "with linux syscall note"),
    (0, "llvm-exception", "(?:apache 2 0 )?with llvm exceptions?"),
    (0, "font-exception", "with font exception(?: 2 0)?"),
    (0, "autoconf-exception", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    (0, "bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    (0, "openssl-exception", WITH + "openssl exception|permission to link the code of portions of this program with the openssl library"),
    (0, "commons-clause", "commons clause(?: license condition)?|the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    # choices
    (0, "dual-license", "dual licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:mit|apache|gpl|bsd|gnu|mozilla|artistic)"),
    (0, "dual-license", "licen[cs]ed under either of(?: the)?"),
    (0, "dual-license", "you may (?:choose|select|use this (?:file|software) under) (?:either|one) of (?:the following|these|two) licen[cs]es"),
    (0, "dual-license", "under (?:the terms of )?(?:either )?the mit license or the apache license"),
    (0, "dual-license", "this file may be used under the terms of either"),
    (0, "perl-5", "under the same terms as perl(?: itself)?"),
    (0, "ruby", "under the same terms as ruby|ruby license"),
    # permissive texts
    (1, "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (1, "mit", "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    (1, "mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (1, "mit-0", "mit no attribution|mit 0"),
    (1, "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (1, "bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (1, "bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    (1, "bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|any|the) contributors may be used to endorse or promote products"),
    (1, "bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (1, "bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license"),
    (1, "0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    (1, "isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    (1, "zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    (1, "zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (1, "boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (1, "unlicense", "this is free and unencumbered software released into the public domain"),
    (1, "unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    (1, "ntp", "permission to use copy modify and distribute this software and its documentation for any purpose (?:with or without|and without) fee is hereby granted"),
    (1, "hpnd", "in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    (1, "curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    (1, "x11", "except as contained in this notice the name of the x consortium shall not be used"),
    (1, "icu", "icu license|unicode license v3|permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files"),
    (1, "json", "the software shall be used for good not evil"),
    (1, "beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    (1, "wtfpl", "you just do what the fuck you want to"),
    (1, "fsf-unlimited", "gives unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved"),
    (1, "libpng", "this code is released under the libpng license|png reference library license"),
    (1, "ijg", "this software is based in part on the work of the independent jpeg group"),
    (1, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    (1, "php", "this product includes php software freely available from"),
    (1, "python", "psf is making python available to licensee on an as is basis"),
    (1, "zpl", "zope public license|this software is subject to the provisions of the zope public license"),
    (1, "w3c", "w3c software notice and license|by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    (1, "sissl", "sun industry standards source license"),
    (1, "bluoak", "blue oak model license"),
    (1, "afl", "academic free license(?: version| v)?(?: [123] [0-9])?"),
    (1, "osl", "open software license(?: version| v)?(?: [123] [0-9])?"),
    (1, "ecl-2", "educational community license(?: version)?(?: 2 0)?"),
    (1, "ncsa", "university of illinois(?: ncsa)? open source license"),
    (1, "upl", "universal permissive license(?: v)?(?: 1 0)?"),
    (1, "mulan", "mulan (?:psl|permissive software license)(?: v)?[12]?"),
    (1, "ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software"),
    # apache texts
    (1, "apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (1, "apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    (1, "apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    (1, "apache-2", "apache license version 2 0 january 2004"),
    (1, "apache-2", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"),
    (1, "apache-1.1", "this product includes software developed by the apache software foundation"),
    # copyleft texts
    (1, "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (1, "gpl", "you should have received a copy of the gnu general public license along with"),
    (1, "gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"),
    (1, "gpl-2", "gnu general public license version 2 june 1991"),
    (1, "gpl-3", "gnu general public license version 3 29 june 2007"),
    (1, "gpl", "the licenses for most software are designed to take away your freedom to share and change it"),
    (1, "lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (1, "lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    (1, "lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    (1, "lgpl-3", "gnu lesser general public license version 3 29 june 2007"),
    (1, "agpl-3", "gnu affero general public license version 3 19 november 2007"),
    (1, "agpl-3", "you should have received a copy of the gnu affero general public license along with"),
    (1, "agpl-3", "all users interacting with it remotely through a computer network"),
    (1, "gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (1, "gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    (1, "mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (1, "mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    (1, "mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    (1, "npl", "the contents of this file are subject to the netscape public license"),
    (1, "cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    (1, "epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (1, "epl-2", "which accompanies this distribution and is available at https www eclipse org legal epl 2 0"),
    (1, "cpl", "common public license(?: version)?(?: 1 0)?"),
    (1, "ipl", "ibm public license(?: version)?(?: 1 0)?"),
    (1, "qpl", "q public license(?: version)?(?: 1 0)?"),
    (1, "eupl", "licensed under the eupl version 1 [12] or as soon they will be approved by the european commission"),
    (1, "sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    (1, "rpl", "reciprocal public license(?: version)?(?: 1 [15])?"),
    # content and data
    (1, "cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    (1, "cc0", "to the extent possible under law (?:[^ ]+ ){1,12}(?:has|have) waived all copyright and related or neighboring rights"),
    (1, "cc-by", "this (?:work|article|document|book) is licensed under (?:a |the )?creative commons attribution (?:[1234] 0 )?(?:international|unported|generic)"),
    (1, "cc-by-sa", "creative commons attribution share ?alike (?:[1234] 0 )?(?:international|unported|generic) license"),
    (1, "cc-by-nc", "creative commons attribution non ?commercial (?:[1234] 0 )?(?:international|unported|generic) license"),
    (1, "cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[1234] 0 )?(?:international|unported|generic) license"),
    (1, "cc-by", "text is available under the creative commons attribution"),
    (1, "odc-by", "open data commons attribution license|odc by(?: 1 0)?"),
    (1, "cdla", "community data license agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?"),
    (1, "public-domain", "(?:this (?:work|file|software|code|document) is|has been) (?:hereby )?(?:placed |released |dedicated )?(?:in|into|to) the public domain"),
    (1, "us-government-work", "work of the (?:united states|u s) government(?: and is not subject to copyright)?"),
    # restricted
    (1, "non-commercial", "for non ?commercial (?:use|purposes|research)(?: purposes)? only|free for non ?commercial use"),
    (1, "no-derivatives", "no derivative works may be (?:made|created|distributed)"),
    (1, "evaluation-only", "for evaluation purposes only|licensed for evaluation use only"),
    (1, "proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited"),
    (1, "proprietary", "this (?:software|source code|file) is (?:the )?(?:confidential and )?proprietary (?:information|property|and confidential)"),
    (1, "proprietary", "no part of this (?:publication|book|document|work) may be reproduced(?: stored in a retrieval system)?(?: distributed)? or transmitted in any form"),
    (1, "bsl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    (1, "sspl", "if you make the functionality of the program or a modified version available to third parties as a service"),
    (1, "elastic", "you may not provide the software to third parties as a hosted or managed service"),
    (1, "polyform", "polyform (?:noncommercial|small business|shield|strict|free trial|perimeter|internal use) license"),
    (1, "openrail", "use based restrictions (?:as referenced in|set forth in) (?:paragraph|attachment)"),
    (1, "llama", "additional commercial terms if on the (?:[^ ]+ ){1,6}version release date the monthly active users"),
)

GRANT = "(?:licen[cs]ed|released|distributed|available|published|redistributed|dual licensed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
#: priority, form, weight; {0} stands for the family's names, SPDX identifiers or address
FORMS = ((0, "spdx", "spdx license identifier (?:{0})", 1.0), (1, "name", GRANT + "(?:{0})", 0.95), (2, "address", "(?:https? )?(?:www )?(?:{0})", 0.9), (3, "name", "(?:{0})", 0.6))


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    literals: tuple[tuple[bytes, ...], ...]  # of each group one at least is in every match
    pattern: re.Pattern
    weight: float


def required(parsed) -> list[tuple[bytes, ...]]:
    """Groups of literals of a parsed regex; every match contains one at least of each group."""
    out, run = [], bytearray()
    for kind, value in [*parsed, (None, None)]:
        if kind is grammar.LITERAL:
            run.append(value)
            continue
        if run:
            out.append((bytes(run),))
            run = bytearray()
        if kind is grammar.SUBPATTERN:
            out += required(value[3])
        elif kind is grammar.BRANCH and all(ways := [required(x) for x in value[1]]):
            out.append(tuple(x for groups in ways for x in max(groups, key=lambda g: min(map(len, g)))))
        elif kind is grammar.MAX_REPEAT and value[0]:
            out += required(value[2])
    return out


def rule(priority: int, label: str, pattern: str, weight: float) -> Rule:
    raw = pattern.encode()
    return Rule(priority, label, tuple(required(grammar.parse(raw))), re.compile(b"(?<= )" + raw + b"(?= )"), weight)


def rules() -> list[Rule]:
    """All rules by priority; notices come before the families' forms, which follow the order of the families."""
    out = []
    for priority, part, form, weight in FORMS:
        out += [rule(priority, label, f"(?:{words})", weight) for p, label, words in NOTICES if p == priority]
        for label, name, spdx, address in FAMILIES:
            out.append(rule(priority, label, form.format({"name": name, "spdx": spdx, "address": address}[part]), weight))
    return out


RULES = rules()
SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


@dataclass
class Scan:
    n_words: int
    places: list[tuple[int, str]]  # first word and label of each base phrase
    detections: list[tuple[int, int, str, float]]  # first word, word after the last, label, weight


def suppressed(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Keeps, of (priority, start, end, label, weight), what no earlier detection in priority order contains."""
    kept: list[tuple[int, int, str, float]] = []
    starts: list[int] = []
    reach: list[int] = []  # largest end up to each start
    for priority in sorted({f[0] for f in found}):
        new, most = [], -1
        for _, start, end, label, weight in sorted((f for f in found if f[0] == priority), key=lambda f: (f[1], -f[2])):
            i = bisect.bisect_right(starts, start)
            if (not i or reach[i - 1] < end) and most < end:
                new.append((start, end, label, weight))
                most = end
        kept = sorted(kept + new, key=lambda k: k[0])
        starts, reach, most = [k[0] for k in kept], [], -1
        for k in kept:
            reach.append(most := max(most, k[1]))
    return kept


def scan(text: str | None) -> Scan:
    words = (text or "").encode("utf-8", "surrogatepass").translate(SPACED).split()
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in BASE:
        needle, at, word, last = f" {phrase} ".encode(), -1, -1, 0
        while (at := joined.find(needle, at + 1)) >= 0:
            word += joined.count(b" ", last, at + 1)
            last = at + 1
            places.append((word, label))
    found = []
    present: dict[bytes, bool] = {}
    for rule in RULES:
        for k in (k for group in rule.literals for k in group):
            if k not in present:
                present[k] = k in joined
        if not all(any(present[k] for k in group) for group in rule.literals):
            continue
        word, last = -1, 0
        for m in rule.pattern.finditer(joined):
            word += joined.count(b" ", last, m.start())
            last = m.start()
            found.append((rule.priority, word, word + m[0].count(b" ") + 1, rule.label, rule.weight))
    return Scan(len(words), places, suppressed(found))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is the largest weight of what was found (base phrases: 0.95), 0 where nothing was. spans lists the kept
    detections as (first word, word after the last, label, weight). Null and empty texts have no words and no
    labels ('' each); whole texts are read, however long; null ids and repeated rows stay. An empty table gives an empty
    result.
    """
    text_batches(docs.sparkSession)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    @F.pandas_udf(kinds + ", spans array<struct<start: long, end: long, label: string, weight: double>>")
    def look(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            s = scan(text)
            at, base = [w for w, _ in s.places], {x for _, x in s.places}
            labels = base | {d[2] for d in s.detections}
            score = max([0.0, *(d[3] for d in s.detections), *([0.95] if base else [])])
            spans = [{"start": a, "end": b, "label": x, "weight": w} for a, b, x, w in s.detections]
            out.append((s.n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
        found = pd.DataFrame(out, columns=names)
        return found.astype({"first_word": "Int64", "last_word": "Int64"})

    return pick(docs, id=id_col, text=text_col).select("id", look("text").alias("got")).select("id", "got.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")
