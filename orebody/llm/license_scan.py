"""Licence scans by sentence rules.

A text is cut into sentences: at full stops before white space or the end and at empty
lines, where a line of nothing but comment marks is empty.  A sentence is normalised (lower
case, runs of anything but letters, digits and inner full stops become one space) and
looked up among the known licence sentences, which gives an identifier.  A sentence that
is not known may be several lines that none ends by a full stop: of those, runs that begin
at a capital, the longest first, are looked up in the same way.

The identifiers of a document, in order, are matched against the licence rules, in order:
where a rule matches, its licence is reported and what it matched is taken out of the
sequence, so a long text is not reported again by a rule for a part of it.

A row is scanned by itself: no shuffle.  Texts without a word that every known sentence
has one of are not cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences as normalised, by identifier.  Fixed values: public licence texts.
SENTENCES = {
    "APACHE_SHORT": "licensed under the apache license version 2.0",
    "APACHE_HEAD": "licensed under the apache license version 2.0 the license",
    "APACHE_BOTH": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "APACHE_USE": "you may not use this file except in compliance with the license",
    "APACHE_COPY": "you may obtain a copy of the license at",
    "APACHE_COPY_URL": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "APACHE_ASIS": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "APACHE_SEE": "see the license for the specific language governing permissions and limitations under the license",
    "APACHE_TITLE": "apache license version 2.0 january 2004 http www.apache.org licenses",
    "MIT_SHORT": "released under the mit license",
    "MIT_NAME": "mit license",
    "MIT_THE_NAME": "the mit license mit",
    "MIT_GRANT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT_NOTICE": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT_BOTH": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT_ASIS": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MIT_LIABLE": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BSD_HEAD": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD_SOURCE": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD_BINARY": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD_NAMES": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD_ASIS": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BSD2_NAME": "bsd 2 clause license",
    "BSD3_NAME": "bsd 3 clause license",
    "ISC_NAME": "isc license",
    "ISC_GRANT": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISC_ASIS": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "GPL3_SHORT": "this work is licensed under the gnu general public license version 3",
    "GPL3_TITLE": "gnu general public license version 3 29 june 2007",
    "GPL2_TITLE": "gnu general public license version 2 june 1991",
    "LGPL3_TITLE": "gnu lesser general public license version 3 29 june 2007",
    "LGPL21_TITLE": "gnu lesser general public license version 2.1 february 1999",
    "AGPL3_TITLE": "gnu affero general public license version 3 19 november 2007",
    "GPL3_LATER": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL2_LATER": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "LGPL3_LATER": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LGPL21_LATER": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "AGPL3_LATER": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL_HOPE": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GPL_SEE": "see the gnu general public license for more details",
    "LGPL_SEE": "see the gnu lesser general public license for more details",
    "AGPL_SEE": "see the gnu affero general public license for more details",
    "GPL_RECEIVED": "you should have received a copy of the gnu general public license along with this program",
    "MPL2": "this source code form is subject to the terms of the mozilla public license v",
    "MPL2_COPY": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "MPL2_COPY_S": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "MPL2_TITLE": "mozilla public license version 2.0",
    "UNLICENSE": "this is free and unencumbered software released into the public domain",
    "UNLICENSE_ANYONE": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "CC_BY_NC": "licensed under cc by nc 4.0",
    "CC_BY_SA": "licensed under cc by sa 4.0",
    "CC_BY": "licensed under cc by 4.0",
    "CC_BY_LONG": "this work is licensed under a creative commons attribution 4.0 international license",
    "CC_BY_SA_LONG": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "CC_BY_NC_LONG": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "CC_BY_ND_LONG": "this work is licensed under a creative commons attribution noderivatives 4.0 international license",
    "CC0": "this work is dedicated to the public domain",
    "CC0_TITLE": "cc0 1.0 universal",
    "RESERVED": "all rights reserved",
}
#: Rules in order: a licence and its sentences, written as a pattern over ``identifier;``.
RULES = (
    ("Apache-2.0", "(APACHE_BOTH;|APACHE_HEAD;(APACHE_USE;)?)(APACHE_COPY;|APACHE_COPY_URL;)?(APACHE_ASIS;)?(APACHE_SEE;)?"),
    ("Apache-2.0", "APACHE_USE;(APACHE_COPY;|APACHE_COPY_URL;)?APACHE_ASIS;(APACHE_SEE;)?"),
    ("Apache-2.0", "APACHE_TITLE;|APACHE_SHORT;"),
    ("MIT", "(MIT_NAME;|MIT_THE_NAME;)?(RESERVED;)?(MIT_BOTH;|MIT_GRANT;(MIT_NOTICE;)?)(MIT_ASIS;)?(MIT_LIABLE;)?"),
    ("MIT", "MIT_SHORT;"),
    ("BSD-3-Clause", "(BSD3_NAME;)?(RESERVED;)?BSD_HEAD;BSD_SOURCE;BSD_BINARY;BSD_NAMES;(BSD_ASIS;)?"),
    ("BSD-2-Clause", "(BSD2_NAME;)?(RESERVED;)?BSD_HEAD;BSD_SOURCE;BSD_BINARY;(BSD_ASIS;)?"),
    ("ISC", "(ISC_NAME;)?ISC_GRANT;(ISC_ASIS;)?"),
    ("AGPL-3.0-or-later", "AGPL3_LATER;(GPL_HOPE;)?(AGPL_SEE;)?"),
    ("LGPL-3.0-or-later", "LGPL3_LATER;(GPL_HOPE;)?(LGPL_SEE;)?"),
    ("LGPL-2.1-or-later", "LGPL21_LATER;(GPL_HOPE;)?(LGPL_SEE;)?"),
    ("GPL-3.0-or-later", "GPL3_LATER;(GPL_HOPE;)?(GPL_SEE;)?(GPL_RECEIVED;)?"),
    ("GPL-2.0-or-later", "GPL2_LATER;(GPL_HOPE;)?(GPL_SEE;)?(GPL_RECEIVED;)?"),
    ("AGPL-3.0-only", "AGPL3_TITLE;"),
    ("LGPL-3.0-only", "LGPL3_TITLE;"),
    ("LGPL-2.1-only", "LGPL21_TITLE;"),
    ("GPL-3.0-only", "GPL3_TITLE;|GPL3_SHORT;"),
    ("GPL-2.0-only", "GPL2_TITLE;"),
    ("Unlicense", "UNLICENSE;(UNLICENSE_ANYONE;)?"),
    ("CC-BY-NC-4.0", "CC_BY_NC;|CC_BY_NC_LONG;"),
    ("CC-BY-ND-4.0", "CC_BY_ND_LONG;"),
    ("CC-BY-SA-4.0", "CC_BY_SA;|CC_BY_SA_LONG;"),
    ("CC-BY-4.0", "CC_BY;|CC_BY_LONG;"),
    ("CC0-1.0", "CC0;|CC0_TITLE;"),
    ("BSD", "(RESERVED;)?BSD_HEAD;"),
    ("MPL-2.0", "MPL2;(MPL2_COPY;|MPL2_COPY_S;)?|MPL2_TITLE;"),
    ("All-rights-reserved", "RESERVED;"),
)
#: Every known sentence has one of these; a word stays in one piece however a text is wrapped.
CUES = re.compile("licens|permission|permitted|warrant|reserved|domain|distribut|redistribut|liable|disclaim|cc0|mpl|anyone", re.I)
#: Where a sentence ends: full stops, or an empty line, in which comment marks may stand.
_END = re.compile(r"\.+(?=\s|\Z)|\n[^A-Za-z0-9\n]*\n")
_OTHER = re.compile(r"[^a-z0-9.]+")
#: A work goes by its own name in the notices that speak of "this program".
_SUBJECT = re.compile(r"^(?:[a-z0-9.]+ ){1,6}(is free software you can redistribute|is distributed in the hope that)")
_BEGINS = re.compile(r"[^A-Za-z0-9]*[A-Z0-9]")

_ID = {s: i for i, s in SENTENCES.items()}
_SORTED = sorted(_ID)
_FIRST = frozenset(s.split(" ", 1)[0] for s in _ID)
_RULES = [(name, re.compile(re.sub("([A-Z0-9_]+;)", r";\1", pattern))) for name, pattern in RULES]


def _normal(part: str) -> str:
    return _SUBJECT.sub(r"this program \1", _OTHER.sub(" ", part.lower()).strip())


def _in_lines(sentence: str) -> Iterator[str]:
    """Identifiers of the runs of whole lines of an unknown ``sentence``; of those that begin at a line the longest."""
    lines = sentence.split("\n")
    plain = [_OTHER.sub(" ", x.lower()).strip() for x in lines]
    i = 0
    while i < len(lines):
        step = 1
        if plain[i] and (i == 0 or _BEGINS.match(lines[i])):
            run, found = "", None
            for j in range(i, len(lines)):
                run = f"{run} {plain[j]}".strip()
                as_known = _SUBJECT.sub(r"this program \1", run)
                if as_known in _ID:
                    found, step = _ID[as_known], j + 1 - i
                at = bisect_left(_SORTED, as_known)
                # A run that begins no known sentence is not made longer, but for a subject that is not complete.
                if not (at < len(_SORTED) and _SORTED[at].startswith(as_known)) and run.count(" ") > 8:
                    break
            if found:
                yield found
        i += step


def identifiers(text: str | None) -> list[str]:
    """The identifiers of the known sentences of ``text``, in order."""
    if not text or not CUES.search(text):
        return []
    out: list[str] = []
    for sentence in _END.split(text):
        whole = _ID.get(_normal(sentence))
        if whole:
            out.append(whole)
        elif "\n" in sentence and CUES.search(sentence):
            out.extend(_in_lines(sentence))
    return out


def licenses(ids: list[str]) -> tuple[list[str], list[str]]:
    """The distinct licences of the rules that match ``ids``, in the order of the rules, and what no rule took."""
    # Each identifier has semicolons of its own on both sides, so neighbours share none and one pass takes all.
    left, found = "".join(f";{x};" for x in ids), []
    for name, pattern in _RULES:
        if left:
            left, n = pattern.subn("", left)
            if n and name not in found:
                found.append(name)
    return found, [x for x in left.split(";") if x]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``licenses``, ``n_sentences``, ``sentences``, ``unmatched`` for each row of ``docs``.

    ``licenses`` joins by commas the distinct licences in the order of the rules,
    ``sentences`` the identifiers in the order of the text, ``unmatched`` by semicolons
    those that no rule took.  Null and empty texts have none.  Repeated rows and null ids
    stay; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, licenses string, n_sentences long, sentences string, unmatched string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [identifiers(t) for t in batch.column(1).to_pylist()]
            told = [licenses(x) if x else ([], []) for x in ids]
            arrays = [[",".join(a) for a, _ in told], [len(x) for x in ids], [",".join(x) for x in ids], [";".join(b) for _, b in told]]
            types = (pa.string(), pa.int64(), pa.string(), pa.string())
            columns = [batch.column(0), *(pa.array(a, t) for a, t in zip(arrays, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "licenses", "n_sentences", "sentences", "unmatched"])

    return rows.mapInArrow(run, schema)


#: DuckDB SQL of the registered query on the given tables, whose licence sentences are these five, each on a line of its own.
ORACLE_SQL = r"""
WITH known(line, id, name, place) AS (VALUES
  ('Licensed under the Apache License, Version 2.0.', 'APACHE_SHORT', 'Apache-2.0', 1),
  ('Released under the MIT License.', 'MIT_SHORT', 'MIT', 2),
  ('This work is licensed under the GNU General Public License, version 3.', 'GPL3_SHORT', 'GPL-3.0-only', 3),
  ('Licensed under CC BY-NC 4.0.', 'CC_BY_NC', 'CC-BY-NC-4.0', 4),
  ('All rights reserved.', 'RESERVED', 'All-rights-reserved', 5)),
rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, i, trim(lines[i]) AS line FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM rows)),
found AS (SELECT r, i, id, name, place FROM each JOIN known USING (line)),
told AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM found GROUP BY r),
named AS (SELECT r, string_agg(name, ',' ORDER BY place) AS names FROM (SELECT DISTINCT r, name, place FROM found) GROUP BY r)
SELECT doc_id, coalesce(names, '') AS licenses, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentences, '' AS unmatched
FROM rows LEFT JOIN told USING (r) LEFT JOIN named USING (r)
"""
