from __future__ import annotations

import random
import re._parser as grammar

import pytest

from tidemark.llm import license_scan as m
from tests.llm.test_lines_licenses import labels


def example(parsed, draw) -> str:
    """A random text that a parsed regex matches."""
    out = ""
    for kind, value in parsed:
        if kind is grammar.LITERAL:
            out += chr(value)
        elif kind is grammar.NOT_LITERAL:
            out += "q"
        elif kind is grammar.IN:
            out += chr(draw.choice([c for k, v in value for c in ([v] if k is grammar.LITERAL else range(v[0], v[1] + 1))]))
        elif kind is grammar.BRANCH:
            out += example(draw.choice(value[1]), draw)
        elif kind is grammar.SUBPATTERN:
            out += example(value[3], draw)
        elif kind is grammar.MAX_REPEAT:
            out += "".join(example(value[2], draw) for _ in range(draw.randint(value[0], min(value[1], value[0] + 3))))
        else:
            assert kind in (grammar.ASSERT, grammar.ASSERT_NOT), kind
    return out


def test_gates_pass_every_text_that_a_rule_matches():
    draw = random.Random(4)
    for rule in m.RULES:
        assert rule.literals
        for _ in range(20):
            text = example(grammar.parse(rule.pattern.pattern.decode()), draw)
            joined = f" {text} ".encode()
            assert rule.pattern.search(joined), (rule, text)
            assert all(any(k in joined for k in group) for group in rule.literals), (rule, text)
            assert m.scan(text).detections, (rule, text)


@pytest.mark.parametrize(("text", "label"), [
    ("SPDX-License-Identifier: BUSL-1.1", "bsl"), ("https://mariadb.com/bsl11", "bsl"), ("SPDX-License-Identifier: OGL-UK-3.0", "ogl-uk"),
    ("SPDX-License-Identifier: CC-PDDC", "public-domain"), ("creativecommons.org/licenses/publicdomain", "public-domain"),
    ("https://www.gnu.org/licenses/fdl", "gfdl"), ("huggingface.co/spaces/bigscience/license", "openrail"),
    ("released under GPLv2", "gpl-2"), ("GPLv3", "gpl-3"), ("LGPLv3", "lgpl-3"), ("LGPLv2.1+", "lgpl-2.1"), ("AGPLv3", "agpl-3"), ("MPLv2.0", "mpl-2"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
])
def test_found(text, label):
    assert label in labels(text)


# texts as they stand in files, with all labels that a reader would give; none of them is copied from the rules
SET = [
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", {"gpl-2-or-later", "gpl"}),
    ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2-or-later"}),
    ("// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", {"gpl-2-only", "linux-syscall-note"}),
    ("/* SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception */", {"apache-2", "llvm-exception"}),
    ("GPL v3 or later", {"gpl-3-or-later"}),
    ("Copyright (c) 2019 J. Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", {"mit"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", {"bsd"}),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", {"bsd-3-clause"}),
    ("Dual licensed under the MIT and GPL licenses.", {"dual-license"}),
    ("This library is licensed under either of Apache License, Version 2.0 or MIT license at your option.", {"dual-license", "apache-2", "mit"}),
    ("you can redistribute it under the same terms as Perl itself", {"perl-5"}),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", {"apache-2"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", {"mpl-2"}),
    ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"cc-by-sa"}),
    ("Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential", {"proprietary"}),
    ("The Software shall be used for Good, not Evil.", {"json"}),
    ("Distributed under the Boost Software License, Version 1.0.", {"boost"}),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version", {"gfdl", "gfdl-or-later"}),
    ("with Classpath Exception", {"classpath-exception"}),
    ("The committee will release the report to the public next year; a driving license is required at the domain office.", set()),
    ("She had a licence to fish, and the apache helicopter flew over the eclipse of the sun; public radio was free.", set()),
    ("Later versions of the story exist only in the library, and permission was granted to nobody.", set()),
    ("Bison and perl were seen at the same terms of trade; good, not bad.", set()),
]


def test_precision_and_recall_on_a_labelled_set():
    right = sum(len(labels(text) and set(labels(text)) & want) for text, want in SET)
    given, wanted = sum(len(set(labels(text))) for text, _ in SET), sum(len(want) for _, want in SET)
    wrong = [(text[:50], labels(text), want) for text, want in SET if set(labels(text)) != want]
    assert right / given >= 0.95 and right / wanted >= 0.95, wrong


def test_patterns_written_by_hand():
    written = {x for family in m.FAMILIES for x in family[1:]} | {words for _, _, words in m.NOTICES}
    assert len(written) > 250 and len(m.RULES) > 300
