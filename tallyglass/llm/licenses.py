"""License scans by template markup.

A template is mandatory wording with ``<<opt words>>`` (may be left out) and ``<<var N>>`` (any words, N at most). It is compiled
into an automaton over words; a text matches where the automaton, started at the template's opening words, accepts.

Defined cases: null text is empty (no words, labels ''); a null ``doc_id`` stays null; repeated rows are scanned each; an empty
table gives an empty result; further columns are ignored. Whole texts are read, of any length. The bodies of the Apache, GNU and
Mozilla licenses have no template of their own, only their notices and the references to them by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

#: Base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Wording of public licenses, as words. Each begins with at least two mandatory words. Labels that end in "-text" are
#: for whole texts, "-notice" for whole notices in source files; the rest are one-sentence references to a license by its name.
_DAMAGES = "arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<opt 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt 2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
_BSD_DISCLAIMER = (
    "this software is provided by <<var 8>> as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 8>> be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
    "profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
    "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_ISC_DISCLAIMER = (
    "the software is provided as is and <<var 6>> disclaims all warranties with regard to this software including all implied warranties of "
    "merchantability and fitness in no event shall <<var 6>> be liable for any special direct indirect or consequential damages or any damages "
    "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of "
    "or in connection with the use or performance of this software"
)
_GNU_NOTICE = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {0} general public license as published by the free "
    "software foundation either version {1} of the license or <<opt at your option>> any later version <<var 4>> is distributed in the hope that "
    "it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
    "gnu {0} general public license for more details"
)
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt the software>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt including the next paragraph>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<var 2>> in no event shall <<var 8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise " + _DAMAGES),
    ("isc-text", "permission to use copy modify <<opt and>> <<opt or>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies " + _ISC_DISCLAIMER),
    ("0bsd-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted " + _ISC_DISCLAIMER),
    ("bsd-2-clause-text", f"{_BSD} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause-text", f"{_BSD} <<opt 3>> neither the name of <<var 8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_DISCLAIMER}"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt 1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<opt 2>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<opt 3>> this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0-text", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license <<opt the software>> to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and <<var 2>> in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise " + _DAMAGES),
    ("unlicense-text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<var 2>> in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise " + _DAMAGES),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 <<opt the license>> you may not use this file except in compliance with the license you may obtain a copy of the license at <<var 10>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2.0-notice", _GNU_NOTICE.format("", 2)),
    ("gpl-3.0-notice", _GNU_NOTICE.format("", 3)),
    ("agpl-3.0-notice", _GNU_NOTICE.format("affero", 3)),
    ("lgpl-2.1-notice", _GNU_NOTICE.format("lesser", "2 1")),
    ("lgpl-3.0-notice", _GNU_NOTICE.format("lesser", 3)),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<var 6>>"),
    ("apache-2.0", "licensed under the apache license <<opt version>> 2 0 <<opt the license>>"),
    ("mit", "licensed under the <<opt terms of the>> mit license"),
    ("mit", "released under the <<opt terms of the>> mit license"),
    ("gpl-2.0", "licensed under the <<opt terms of the>> gnu general public license <<opt as published by the free software foundation>> <<opt either>> version 2"),
    ("gpl-3.0", "licensed under the <<opt terms of the>> gnu general public license <<opt as published by the free software foundation>> <<opt either>> version 3"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation either version <<var 2>> of the license or <<opt at your option>> any later version"),
    ("lgpl", "licensed under the <<opt terms of the>> gnu lesser general public license <<opt version>> <<var 2>>"),
    ("cc-by-4.0", "licensed under <<opt the>> cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under <<opt the>> cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under <<opt the>> cc by nc 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under <<opt the>> cc by nc nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution <<var 3>> <<opt 4 0>> international license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<opt v>> 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_PART = re.compile(r"<<(opt|var) ([^>]*)>>")


def parse(template: str) -> list[tuple[str, object]]:
    """[('words', [..]) | ('opt', [..]) | ('var', N)]"""
    out, at = [], 0
    for m in _PART.finditer(template):
        out += [("words", w)] if (w := template[at : m.start()].split()) else []
        out.append(("opt", m[2].split()) if m[1] == "opt" else ("var", int(m[2])))
        at = m.end()
    return out + ([("words", w)] if (w := template[at:].split()) else [])


class Automaton:
    """States are numbers; ``step[s]`` has (word or None for any, next) and ``free[s]`` the states reached without a word."""

    def __init__(self, template: str):
        self.step, self.free = [[]], [[]]
        parts = parse(template)
        if parts[0][0] != "words" or len(parts[0][1]) < 2:
            raise ValueError("a template begins with two mandatory words at least")
        self.opening = b" " + " ".join(parts[0][1][:3]).encode() + b" "
        for kind, x in parts:
            begin = len(self.step) - 1
            for w in x if kind != "var" else [None] * x:
                self._new(w)
            end = len(self.step) - 1
            for s in {"words": [], "opt": [begin], "var": range(begin, end)}[kind]:
                self.free[s].append(end)
        self.last = len(self.step) - 1
        self.closed = [self._closure(s) for s in range(len(self.step))]

    def _new(self, word: str | None) -> None:
        self.step[-1].append((word.encode() if word else None, len(self.step)))
        self.step.append([])
        self.free.append([])

    def _closure(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the template's wording begins at word ``at``."""
        states = self.closed[0]
        for w in words[at:]:
            if self.last in states:
                return True
            states = frozenset().union(*(self.closed[n] for s in states for x, n in self.step[s] if x is None or x == w))
            if not states:
                return False
        return self.last in states


def compiled(templates=None) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in (TEMPLATES if templates is None else templates)]


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions of ``phrase`` (with a space at either end) in words joined and enclosed by spaces."""
    out, at, word, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


def scan(text: str, automata) -> tuple[int, int, int | None, int | None, str, str, float]:
    w = text.encode("utf-8", "surrogatepass").translate(_SEPARATE).split()
    joined = b" " + b" ".join(w) + b" "
    found = [(p, label) for phrase, label in PHRASES for p in places(joined, f" {phrase} ".encode())]
    base = {label for _, label in found}
    own = {label for label, a in automata if any(a.accepts(w, p) for p in places(joined, a.opening))}
    at = [p for p, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = [scan(t, automata) for t in b.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def license_scan(docs: DataFrame, templates=None) -> DataFrame:
    """One row per document: base phrases (count, first and last word, labels), all labels, and a score: 1 if a template accepted, 0.5 if only a base phrase stands there, else 0."""
    return texts(docs).mapInArrow(_scan(templates), SCHEMA)


def pattern(template: str) -> str:
    """The template as a regular expression over words that each have a space before them; used by the SQL check alone."""
    text = {"words": lambda x: "".join(f" {w}" for w in x), "opt": lambda x: "(?:" + "".join(f" {w}" for w in x) + ")?", "var": lambda x: f"(?: [^ ]+){{0,{x}}}"}
    return "".join(text[kind](x) for kind, x in parse(template)) + " "


def _sql() -> str:
    at = " UNION ALL ".join(
        "SELECT doc_id, i - 1 AS p, '%s' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM s WHERE contains(j, ' %s ')) WHERE %s" % (label, phrase, " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())))
        for phrase, label in PHRASES
    )
    own = ", ".join(f"CASE WHEN regexp_matches(j, '{pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES)
    return rf"""
WITH s AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents)),
p AS ({at}),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list_distinct(list(label)) AS bl FROM p GROUP BY doc_id),
o AS (SELECT doc_id, len(w) AS n_words, list_filter([{own}], lambda x: x IS NOT NULL) AS ol FROM s)
SELECT o.doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), ol))), ','), '') AS labels,
       CASE WHEN len(ol) > 0 THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM o LEFT JOIN b USING (doc_id)
"""


SQL = _sql()
