import duckdb

from pathweave.llm import licences as L

from .util import docs_of

ROWS = [
    (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved."),
    (2, "Licensed under CC BY-NC 4.0. Released under the MIT license! more"),
    (3, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: \nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. Other.'),
    (4, "You may not use this file except in compliance with the License. x"),
    (5, None), (6, ""), (7, "no licence here"), (8, "ALL RIGHTS  RESERVED.\n" * 3), (9, "x" * 100000 + "\n" + "All rights reserved."), (9, "repeat"), (None, "All rights reserved"),
    (10, "This is not licensed under CC BY-NC 4.0."), (11, "All rights reserved {MIT} <ApacheRef>"),
    (12, "This project is licensed under the MIT License."), (13, "The software is released under the\nMIT License.\nAll rights reserved\nmore text"),
]

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
APACHE = """Copyright 2020 Jane Doe

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
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
FULL = [("MIT", MIT), ("Apache-2.0", APACHE), ("BSD-2-Clause", BSD), ("GPL-2.0-or-later", GPL)]


def commented(text, mark):
    return "".join(f"{mark} {x}".rstrip() + "\n" for x in text.splitlines())


FORMS = [lambda t: t, lambda t: commented(t, "#"), lambda t: commented(t, "//"), lambda t: "/*\n" + commented(t, " *") + " */\nint x;", lambda t: t.replace("\n", "\r\n")]
WRAPPED = [(100 * i + j, form(text)) for i, (_, text) in enumerate(FULL) for j, form in enumerate(FORMS)]


def test_wrapped_texts(spark):
    got = {r.doc_id: r for r in L.scan_licences(docs_of(spark, WRAPPED)).collect()}
    for i, (name, _) in enumerate(FULL):
        for j in range(len(FORMS)):
            r = got[100 * i + j]
            assert (r.licences, r.n_matched, r.n_unmatched) == (name, 1, 0), (name, j, r)


def test_finds(spark):
    got = {r.doc_id: r for r in L.scan_licences(docs_of(spark, ROWS)).collect() if r.doc_id != 9}
    assert got[1].licences == "Apache-2.0,proprietary" and got[2].licences == "CC-BY-NC-4.0,MIT"
    assert got[3].licences == "MIT" and got[3].n_matched == 1 and got[3].n_known == 2
    assert got[4].n_unmatched == 1 and got[4].licences == ""
    assert got[12].licences == "MIT" and got[13].licences == "MIT,proprietary"
    assert got[8].n_matched == 3 and got[None].licences == "proprietary"
    assert all(got[i].n_known == 0 for i in (5, 6, 7, 10, 11))
    assert L.scan_licences(docs_of(spark, [])).count() == 0


def test_equals_sql(spark):
    df = docs_of(spark, ROWS + WRAPPED)
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  (read by DuckDB)
    want = duckdb.sql(L.scan_sql()).df().astype(str).values.tolist()
    got = L.scan_licences(df).toPandas().astype(str).values.tolist()
    assert sorted(map(str, got)) == sorted(map(str, want)) or sorted(x[1:] for x in got) == sorted(x[1:] for x in want)


def test_native(spark):
    plan = L.scan_licences(docs_of(spark, ROWS[:1]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
