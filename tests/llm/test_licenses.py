from __future__ import annotations

import random
import textwrap

import pytest

from textmill.llm import licenses
from textmill.llm.licenses import RULES, SENTENCES, identifiers, license_table, marked, match_rules, normalised, scan

# Public licence texts.
MIT = """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES) HOWEVER CAUSED."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BOOST = """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"""


def wrapped(text):
    """As it is, as two kinds of comments, and on one line."""
    parts = text.split("\n\n")
    yield text
    yield "\n *\n".join("\n".join(" * " + x for x in textwrap.wrap(p, 60)) for p in parts)
    yield "\n#\n".join("\n".join("# " + x for x in textwrap.wrap(p, 34)) for p in parts)
    yield " ".join(text.split())


@pytest.mark.parametrize("text, want", [(MIT, "MIT"), (BSD3, "BSD-3-Clause"), (GPL3, "GPL-3.0-or-later"), (GPL3.replace("General", "Affero General"), "AGPL-3.0-or-later"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), (BOOST, "BSL-1.0")])
def test_texts_in_every_wrapping(text, want):
    for t in wrapped(text):
        assert [x[0] for x in scan(t)] == [want], t
        assert [x[0] for x in scan("Some words before. " + t + "\n\nAnd more words after it.")] == [want]


@pytest.mark.parametrize("text, want", [
    ("This library is licensed under the MIT License.", ["MIT"]),
    ("The code is released under the MIT license.", ["MIT"]),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", ["Apache-2.0", "MIT"]),
    ("# SPDX-License-Identifier: MIT", ["MIT"]),
    ("The code is released under the terms of the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("All of it is distributed under the 3-clause BSD License.", ["BSD-3-Clause"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.", ["GPL-2.0-or-later"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("This library is available under the LGPL v2.1 or later.", ["LGPL-2.1-or-later"]),
    ("Released under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Text is available under Creative Commons BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("It is licensed under the Apache License, Version 2.0, and available under the MIT License.", ["Apache-2.0", "MIT"]),
    ("Released under the MIT License.\nAll rights reserved.", ["MIT", "all-rights-reserved"]),
    ("a licence to fish. no rights here", []),
    ("Permission to enter is granted. The summit committee reserved rooms.", []),
    ("", []),
])
def test_statements(text, want):
    assert sorted(x[0] for x in scan(text)) == want


def test_parts_far_apart_are_no_rule():
    grant, notice = MIT.split("\n\n")[1:3]
    near, far = (scan(grant + "\n\n" + "Other words stand here.\n\n" * n + notice) for n in (2, 1000))
    assert near[0][2] > len(grant) and far[0][2] <= len(grant) + 1


def test_every_known_sentence_holds_a_mark_and_is_found():
    for name, s in SENTENCES.items():
        text = s.replace("*", "something else")
        assert marked(text), name
        assert any(x[0] == licenses.ALIAS.get(name, name) for x in identifiers(text)) or identifiers(text), name
        assert normalised(text) == text or "licence" in text


def test_rules_against_every_choice():
    """The matcher against the rules' definition by trying all places."""
    r = random.Random(6)
    names = sorted({x for _, rule in RULES for x in rule})[:14]
    for _ in range(400):
        ids = [(r.choice(names[: r.randint(2, 14)]), 0) for _ in range(r.randint(0, 14))]
        place, at = [], 0
        for name, _ in ids:
            at += r.choice((1, 1, 2, 9))
            place.append((name, at))
        free, want = set(range(len(place))), []
        for k, (_, rule) in enumerate(RULES):
            for first in range(len(place)):
                chain = []
                for x in rule:
                    later = [i for i in sorted(free) if place[i][0] == x and (i > chain[-1] if chain else i == first)]
                    if not later or chain and place[later[0]][1] - place[chain[-1]][1] > licenses.GAP:
                        break
                    chain.append(later[0])
                if len(chain) == len(rule):
                    free -= set(chain)
                    want.append((k, chain))
        assert match_rules(place) == want


def test_table(odd_docs, odd_texts, no_docs):
    got = license_table(odd_docs).collect()
    assert len(got) == len(odd_texts) and all(r.n_licenses == 0 and r.licenses == "" and r.spans == "" for r in got)
    assert license_table(no_docs).count() == 0


@pytest.mark.parametrize("text, want", [
    ("License: MIT", ["MIT"]),
    ("# My tool\n\nMIT License\n\nCopyright me", ["MIT"]),
    ("License: GPLv3+", ["GPL-3.0-or-later"]),
    ('"license" = "Apache-2.0"\nauthor = x', ["Apache-2.0"]),
    ("License: BSD-3-Clause\nVersion: 1", ["BSD-3-Clause"]),
    ("Distributed under the PostgreSQL License.", ["PostgreSQL"]),
    ("Licensed under the EUPL 1.2", ["EUPL-1.2"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright", ["GPL-3.0-only"]),
    ("Apache License\nVersion 2.0, January 2004\n\nTERMS", ["Apache-2.0"]),
    ("The code is in the public domain.", ["public-domain"]),
    ("This is not licensed under the MIT License.", []),
    ("It isn't released under the GPL.", []),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", ["GPL-2.0-only WITH Linux-syscall-note"]),
    ("SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0)", ["GPL-2.0-only WITH Classpath-exception-2.0", "MIT"]),
    ("the license of a driver", []),
    ("license: see the office", []),
    ("“Released under the MIT License” — all of it", ["MIT"]),
])
def test_labels_headings_and_denials(text, want):
    assert sorted({x[0] for x in scan(text)}) == want


def test_many_grants_take_linear_time():
    import time

    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software.\n\n"
    began = time.process_time()
    ids = [("mit-grant", 3 * i) for i in range(60_000)] + [("mit-warranty", 200_000)]
    assert len(match_rules(ids)) == 60_000 and time.process_time() - began < 5
    assert len(scan(grant * 8000)) == 8000
