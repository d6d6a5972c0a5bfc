import textwrap

from telemill.llm import licenses


def test_sequences_in_order_of_the_rules(spark, docs_of):
    full = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at http"
    rows = [
        (1, "Some text.\n" + full),
        (2, "LICENSED under the Apache License, Version 2.0. Released under the MIT License.\nReleased under the MIT license."),
        (3, None),
        (4, ""),
        (5, "You may obtain a copy of the License at\nAll rights reserved."),
        (6, "word. " * 30000 + "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r.doc_id: r for r in licenses.recognise(docs_of(*rows)).collect()}
    assert got[1].sentence_ids == ["ApacheRef2", "ApacheComply"] and got[1].licenses == ["Apache-2.0"] and got[1].unmatched == ["ApacheComply"]
    assert got[2].licenses == ["Apache-2.0", "MIT"] and got[2].sentence_ids == ["ApacheRef2", "MitRef", "MitRef"]
    assert got[3].licenses == got[4].licenses == [] and got[5].unmatched == ["ApacheCopy", "AllRights"] and got[6].licenses == ["GPL-3.0"]


def test_a_longer_rule_comes_first(spark, docs_of):
    s = dict((i, t) for i, t in reversed(licenses.SENTENCES))
    text = "\n".join(s[i] for i in ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "MitGrant", "MitNotice", "MitAsIs"))
    assert licenses.recognise(docs_of((1, text))).first().licenses == ["MIT", "BSD-3-Clause"]
    assert licenses.recognise(docs_of((1, "x")).limit(0)).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def test_wrapped_texts_and_comments(spark, docs_of):
    want = {"MIT": MIT, "BSD-2-Clause": BSD, "GPL-3.0-or-later": GPL, "Apache-2.0": APACHE}
    rows, names = [], []
    for name, text in want.items():
        for mark in ("", "# ", " * ", "// ", ";; ", "! "):
            for end in ("\n", "\r\n"):
                lines = [line for part in text.split("\n") for line in textwrap.wrap(part, 72) or [""]]
                rows.append((len(rows), "Copyright 2020 A. B.\n" + end.join(mark + line for line in ["", *lines])))
                names.append(name)
    got = {r.doc_id: r for r in licenses.recognise(docs_of(*rows)).collect()}
    for i, name in enumerate(names):
        assert got[i].licenses == [name] and got[i].unmatched == [], rows[i]


def test_runs_inside_longer_sentences(spark, docs_of):
    rows = [
        (1, "This file is released under the MIT License."),
        (2, "Unreleased under the MIT License."),
        (3, "It was released under the. MIT License"),
        (4, "It was released under\n\nthe MIT License"),
        (5, "Copyright (c) 2020, all rights reserved"),
        (6, "Code licensed under CC\n * BY-SA\n * 4.0; text licensed under CC BY 4.0"),
        (7, "Released under the MIT License agreement."),
    ]
    got = {r.doc_id: r.sentence_ids for r in licenses.recognise(docs_of(*rows)).collect()}
    assert got == {1: ["MitRef"], 2: [], 3: [], 4: [], 5: ["AllRights"], 6: ["CcBySaRef4", "CcByRef4"], 7: []}


def test_further_licenses(spark, docs_of):
    rows = [
        ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS."),
        ("Unlicense", "# This is free and unencumbered software released into the public domain.\n# Anything else"),
        ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nint main() {}"),
        ("GPL-2.0-or-later", GPL.replace("version 3", "version 2") + "\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
        ("LGPL-2.1-or-later", GPL.replace("This program", "This library").replace("GNU General Public", "GNU Lesser General Public").replace("version 3", "version 2.1")),
        ("Zlib", "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. x"),
    ]
    got = {r.doc_id: r for r in licenses.recognise(docs_of(*[(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert [got[i].licenses for i in range(len(rows))] == [[name] for name, _ in rows]


def test_every_rule_names_known_sentences():
    assert {x for _, run in licenses.RULES for x in run} <= {i for i, _ in licenses.SENTENCES}


def test_names_references_and_expressions(spark, docs_of):
    """Holders' names in BSD texts, notices without the warranty, references that go on, and SPDX expressions."""
    free = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    rows = [
        (["BSD-3-Clause"], BSD + "\n\n3. Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without\nspecific prior written permission."),
        (["GPL-2.0-or-later"], free.format("General Public", 2)),
        (["AGPL-3.0-or-later"], free.format("Affero General Public", 3)),
        (["GPL-2.0-only"], "You may use it under the terms of the GNU General Public License version 2 as published by the\nFree Software Foundation."),
        (["GPL-2.0-only"], "under the GNU General Public License version 2 as published, no other"),
        (["MIT"], "This tool is released under the MIT License, see LICENSE."),
        (["EPL-2.0"], " * This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License 2.0 which is available at\n * https://www.eclipse.org/legal/epl-2.0/\n */"),
        (["MIT", "Apache-2.0"], "// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}"),
        (["GPL-2.0-only", "BSD-3-Clause"], "# spdx-license-identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause"),
        (["MIT"], "/* SPDX-License-Identifier: MIT */"),
        ([], "SPDX-License-Identifier: Unknown-1.0 OR Other"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.recognise(docs_of(*[(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert [got[i] for i in range(len(rows))] == [want for want, _ in rows]
