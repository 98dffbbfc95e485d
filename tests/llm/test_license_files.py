"""Licence texts in the form files have them: hard-wrapped, commented, with numbered clauses."""

import textwrap

import time

import duckdb

from faultline.llm import license_scan, queries
from llm.helpers import docs
from llm.test_license_scan import MIT

APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
BSD2 = """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
LGPL = GPL2.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1")
AGPL = GPL3.replace("GNU General", "GNU Affero General")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
TAIL = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.\n'
WRAPPED_MIT = "\n\n".join(textwrap.fill(p, 78) for p in MIT.split("\n\n"))


def commented(text, lead):
    return "\n".join(f"{lead} {line}".rstrip() for line in text.splitlines())


def test_files(spark):
    files = {"MIT": [WRAPPED_MIT, WRAPPED_MIT.replace("\n", "\r\n"), textwrap.fill(MIT, 40)], "Apache-2.0": [APACHE],
             "GPL-3.0-or-later": [GPL3], "GPL-2.0-or-later": [GPL2], "BSD-2-Clause": [BSD2 + TAIL, BSD2.replace("1. ", "* ")],
             "LGPL-2.1-or-later": [LGPL], "AGPL-3.0-or-later": [AGPL], "ISC": [ISC], "Zlib": [ZLIB],
             "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.\n"],
             "BSD-3-Clause": [BSD3 + TAIL, BSD3.replace("the copyright holder", "Foo Bar, Inc."), BSD3.replace("3. ", "(c) ")]}
    rows = [(name, form) for name, texts in files.items() for t in texts
            for form in (t, commented(t, "#"), commented(t, "//"), commented(t, ";;"), f"/*\n{commented(t, ' *')}\n */\nint x;\n")]
    got = license_scan.scan(docs(spark, [(k, t) for k, (_, t) in enumerate(rows)])).collect()
    assert {r["doc_id"]: (r["licenses"], r["n_unresolved"]) for r in got} == {k: (n, 0) for k, (n, _) in enumerate(rows)}


def test_not_a_licence(spark):
    texts = [WRAPPED_MIT.replace("substantial", "many"), "I was\nreleased under the MIT License", "Released under the MIT. License",
             "Released under the\n漢字\nMIT License", "Released under the MIT License\nfor 3 days only"]
    got = license_scan.scan(docs(spark, list(enumerate(texts)))).collect()
    assert [r["licenses"] for r in sorted(got)] == ["", "MIT", "", "", "MIT"]


def test_lines_of_a_megabyte(spark):
    texts = ["漢" * 350_000 + "a", "é, " * 200_000 + "x", "# " * 500_000, "a. " * 300_000, "\n1. " * 200_000 + "b", "neither the name of " * 50_000,
             "ab " * 300_000 + "\nReleased under the MIT License."]
    df = docs(spark, list(enumerate(texts)))
    began = time.time()
    got = license_scan.scan(df).collect()
    assert [r["licenses"] for r in sorted(got)] == [""] * 6 + ["MIT"]
    assert time.time() - began < 60                          # seconds; a quadratic pattern takes hours


def test_sql_states_the_same(spark):
    """Wrapped, commented and numbered texts, odd ones and foreign ones against the query's SQL."""
    texts = [form for t in (WRAPPED_MIT, APACHE, GPL3, GPL2, BSD2, BSD3, BSD3.replace("the copyright holder", "Foo Bar, Inc."), LGPL, AGPL, ISC, ZLIB)
             for form in (t, commented(t, "#"), commented(t, "//"), f"/*\n{commented(t, ' *')}\n */\nint x;\n")]
    texts += ["Released under the MIT. License", "Released under the\n漢字\nMIT License", "É ñ.\n漢字! x; y\n\n(iv) All rights reserved", None, "",
              "version\n2. All rights reserved", "Licensed under the MIT License\r\nSPDX-License-Identifier: Zlib"]
    df = docs(spark, list(enumerate(texts)))
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    cur = con.execute(queries.ORACLES["op1_license_scan"])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, license_scan.scan(df).select(*names).collect())) == sorted(map(tuple, cur.fetchall()))
