import time

import duckdb

from orebody.llm import license_scan as lic
from orebody.llm.queries import op3_license_scan

APACHE = """# Copyright 2020 Someone
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
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
TEXTS = {
    "Some text.\nReleased under the MIT License.\nMore text here": ("MIT", 1, ""),
    "Some text. Licensed under the Apache License, Version 2.0.": ("Apache-2.0", 1, ""),
    "x\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.": ("GPL-3.0-only,CC-BY-NC-4.0", 2, ""),
    "released   under the *MIT* license.  Released under the MIT License. Released under the MIT License.": ("MIT", 3, ""),
    "The MIT licence is discussed here. A license is not granted.": ("", 0, ""),
    "MIT License": ("", 1, "MIT_NAME"),
    "You may not use this file except in compliance with the License. All rights reserved.": ("All-rights-reserved", 2, "APACHE_USE"),
    "": ("", 0, ""),
    None: ("", 0, ""),
    "word " * 50_000 + ".\nAll rights reserved": ("All-rights-reserved", 1, ""),
}


def test_rules(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "Released under the MIT License.")] * 2
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = list(TEXTS.values())
    for r in got:
        assert (r.licenses, r.n_sentences, r.unmatched) == (("MIT", 1, "") if r.id is None else want[r.id]), r


def test_long_licences_are_reported_once(spark):
    df = spark.createDataFrame([(1, GPL), (2, "Header\n" + GPL + "\n\nReleased under the MIT License.")], "doc_id long, text string")
    got = {r.id: r for r in lic.scan(df).collect()}
    assert got[1].licenses == "GPL-3.0-or-later"
    assert got[2].licenses == "MIT,GPL-3.0-or-later"


def test_sequence_takes_the_longer_rule_first(spark):
    text = 'Licensed under the Apache License, Version 2.0 (the "License"). You may not use this file except in compliance with the License. Released under the MIT License.'
    row = lic.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.licenses, row.sentences, row.unmatched) == ("Apache-2.0,MIT", "APACHE_HEAD,APACHE_USE,MIT_SHORT", "")


def test_every_known_sentence_is_normalised_and_mentioned(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lic.SENTENCES.values())], "doc_id long, text string")
    got = {r.id: r.sentences for r in lic.scan(df).collect()}
    ids = list(lic.SENTENCES)
    assert {i: s for i, s in got.items() if s != ids[i]} == {}


def test_sql_agrees_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    mine = op3_license_scan(spark, folder)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    cur = con.execute(lic.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=str)
    assert sorted(names) == sorted(mine.columns) and any(r[1] for r in want)
    assert sorted(map(tuple, mine.select(*names).collect()), key=str) == want


def test_empty_table(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string, ids int, left int")).count() == 0


def test_cue_words_apart_by_any_white_space(spark):
    texts = [f"This work is dedicated to the public{gap}domain." for gap in (" ", "\n", "\t", "  ", "\r\n", "-", "\n  ")]
    for r in lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert (r.licenses, r.sentences, r.unmatched) == ("CC0-1.0", "CC0", ""), texts[r.id]


def test_any_number_of_neighbours_is_taken(spark):
    mit, head = "Released under the MIT License. Some words. ", lic.SENTENCES["BSD_HEAD"] + ".\n"
    cases = [(mit * n, "MIT", "") for n in (1, 2, 4, 10, 101)]
    cases += [(("All rights reserved. " + head) * n, "BSD", "") for n in (1, 2, 4, 10)]
    cases += [("All rights reserved. " + head + mit * 4 + "All rights reserved. " * 5, "MIT,BSD,All-rights-reserved", "")]
    cases += [("MIT License. " + mit * 5 + "MIT License. " + lic.SENTENCES["GPL_SEE"] + ". ", "MIT", "MIT_NAME;MIT_NAME;GPL_SEE")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    for r in lic.scan(df).collect():
        assert (r.licenses, r.unmatched) == cases[r.id][1:], cases[r.id]


MIT = """MIT License

Copyright (c) 2020 Some One

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD3 = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
BSD2 = BSD3.replace(BSD3[BSD3.index("3. Neither") : BSD3.index("THIS SOFTWARE")], "")
NOTICE = """    Foo Bar is free software: you can redistribute it and/or modify
    it under the terms of the GNU {0}General Public License as published by
    the Free Software Foundation, either version {1} of the License, or
    (at your option) any later version.

    Foo Bar is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {0}General Public License for more details.
"""
ISC = """ISC License

Copyright (c) 2020 Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
PUBLISHED = {
    MIT: "MIT", APACHE: "Apache-2.0", BSD3: "BSD-3-Clause", BSD2: "BSD-2-Clause", ISC: "ISC",
    NOTICE.format("", 3): "GPL-3.0-or-later", NOTICE.format("", 2).replace("Foundation,", "Foundation;"): "GPL-2.0-or-later", NOTICE.format("Lesser ", 3): "LGPL-3.0-or-later",
    NOTICE.format("Lesser ", "2.1"): "LGPL-2.1-or-later", NOTICE.format("Affero ", 3): "AGPL-3.0-or-later",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": "GPL-3.0-only",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n": "GPL-2.0-only",
    "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n": "LGPL-2.1-only",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n": "Apache-2.0",
    "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions": "MPL-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n": "MPL-2.0",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n": "Unlicense",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International\nLicense.": "CC-BY-SA-4.0",
    "CC0 1.0 Universal\n": "CC0-1.0",
}


def commented(text, mark):
    return "\n".join(mark + line for line in text.split("\n"))


def test_published_texts():
    for text, name in PUBLISHED.items():
        for form in (text, commented(text, "# "), commented(text, " * "), commented(text, "//"), "Some words before\n" + text + "\nMore words after.", text.replace("\n", "\r\n")):
            found, left = lic.licenses(lic.identifiers(form))
            assert found == [name] and not left, (name, form, found, left)


def test_texts_wrapped_elsewhere():
    words = MIT[MIT.index("Permission") : MIT.index("\n\nThe above")].split()
    for width in range(3, 20):
        text = "Header line\n" + "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width)) + "\n\nOther words"
        assert lic.licenses(lic.identifiers(text))[0] == ["MIT"], text


def test_a_very_long_text_of_short_lines_takes_linear_time():
    began = time.time()
    assert lic.identifiers("The license\n" * 200_000) == []
    assert lic.identifiers("This\n" * 200_000 + "all license\n") == []
    assert time.time() - began < 20
