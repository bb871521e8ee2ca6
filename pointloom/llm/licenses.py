r"""Licence scans by template matching (operator 6).

A template is plain wording with two marks: ``<< ... >>`` is a region that a text may leave out, and
``{{n}}`` stands for one to n words of any kind (names, years); ``{{a|b c}}`` for one of the wordings
named. Each template is compiled to an automaton over words (states with moves on a word, on
any word, and empty moves around optional regions), made deterministic as texts are read. A template is found
where a run from some place accepts, that is, where all mandatory wording stands word by word. Only
texts that hold all words every match must have run its automaton.

Three kinds of templates: ``text``, the whole wording of a short licence; ``notice``, the standard notice by
which a long licence is applied to a work; ``mention``, a sentence that places a work under a licence by name.
``score`` is that of the best kind found: 1, 0.8, 0.6; 0.5 for base phrases alone; else 0.

The base is a list of fixed phrases. Texts are lower-cased in A-Z only; words are runs of letters,
digits and non-ASCII characters. Defined results: null text counts as empty: 0 words, no labels, score 0; texts may be of
any length; repeated rows give repeated results; an empty table gives an empty result; extra columns are
ignored. Each row is scanned on its own, whole, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import ship, table

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_COPYRIGHT = "<< copyright << c >> << {{20}} >> >> << all rights reserved >>"
_AS_IS_BSD = (
    "this software is provided {{by the copyright holders and contributors|by the author and contributors|by the regents and contributors|by the author}} "
    "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
    "purpose are disclaimed in no event shall {{the copyright holder|the copyright holders|the copyright owner|the author|the regents}} << or contributors >> "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
    "or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
    "or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<< 1 >> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<< 2 >> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution "
)
_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
    "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
    "of the software and to permit persons to whom the software is furnished to do so "
)
_AS_IS_MIT = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness "
    "for a particular purpose and noninfringement in no event shall the authors << or copyright holders >> be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "<< provided that the above copyright notice and this permission notice appear in all copies >> "
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
    "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from "
    "loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
    "performance of this software"
)


def _gnu(name: str, version: int) -> str:
    return (
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} general public license as published by the free software "
        f"foundation {{{{either version {version}|version {version}}}}} of the license << or at your option any later version >> "
        f"<< << this program >> << {{{{8}}}} >> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        f"merchantability or fitness for a particular purpose see the gnu {name} general public license for more details >>"
    )


_PLACED = "{{licensed under|released under|distributed under|available under|made available under|covered by|subject to}} << the terms of >> << the >> << a >>"

#: (label, kind, wording) of public licences, in lower case, punctuation left out; the wordings are fixed values.
TEMPLATES = [
    ("mit", "text", f"<< << the >> mit license << mit >> >> {_COPYRIGHT} {_GRANT} subject to the following conditions the above copyright notice and this permission notice << including the next paragraph >> shall be included in all copies or substantial portions of the software {_AS_IS_MIT}"),
    ("mit-0", "text", f"{_COPYRIGHT} {_GRANT} {_AS_IS_MIT}"),
    ("bsd-2-clause", "text", f"{_COPYRIGHT} {_BSD} {_AS_IS_BSD}"),
    ("bsd-3-clause", "text", f"{_COPYRIGHT} {_BSD} << 3 >> neither the {{{{name|names}}}} of {{{{20}}}} may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS_BSD}"),
    ("isc", "text", _ISC.replace("<< ", "").replace(" >>", "")),
    ("0bsd", "text", _ISC[: _ISC.index("<<")] + _ISC[_ISC.index(">>") + 3 :]),
    ("zlib", "text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions << 1 >> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required << 2 >> altered source versions must be plainly marked as such and must not be misrepresented as being the original software << 3 >> this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "text", "boost software license version 1 0 << august 17th 2003 >> permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("unlicense", "text", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software << for more information please refer to {{http unlicense org|https unlicense org}} >>"),
    ("wtfpl", "text", "do what the fuck you want to public license << version 2 december 2004 >> << {{30}} >> everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification << 0 >> you just do what the fuck you want to"),
    ("apache-2.0", "notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at << {{http|https}} >> www apache org licenses license 2 0 << unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license >>"),
    *[(f"{label}-{v}.0", "notice", _gnu(name, v)) for label, name, versions in (("gpl", "", (2, 3)), ("agpl", "affero", (3,)), ("lgpl", "lesser", (3,))) for v in versions],
    ("lgpl-2.1", "notice", _gnu("lesser", 2).replace("version 2", "version 2 1")),
    ("mpl-2.0", "notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at << {{http|https}} >> {{mozilla org mpl 2 0|www mozilla org mpl 2 0}}"),
    ("cc0-1.0", "notice", "to the extent possible under law << {{20}} >> {{has|have}} waived all copyright and related or neighboring rights to << this work >>"),
    ("apache-2.0", "mention", f"{_PLACED} apache license version 2 0"),
    ("bsd-2-clause", "mention", f"{_PLACED} {{{{bsd 2 clause|2 clause bsd|simplified bsd}}}} license"),
    ("bsd-3-clause", "mention", f"{_PLACED} {{{{bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd}}}} license"),
    *[(f"cc-{c.replace(' ', '-')}", "mention", f"{_PLACED} {{{{cc {c}|creative commons cc {c}|creative commons {n} cc {c}|creative commons {n}}}}} << license >> {{{{2|3|4}}}} 0 << international >> << license >>") for c, n in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))],
    *[(f"{label}-{v}", "mention", f"{_PLACED} {{{{gnu {name}general public license|{short}}}}} << {short} >> {{{{version|v}}}} {v.replace('.', ' ').removesuffix(' 0')} << 0 >> << or << at your option >> any later version >>") for label, name, short, versions in (("gpl", "", "gpl", ("2.0", "3.0")), ("agpl", "affero ", "agpl", ("3.0",)), ("lgpl", "lesser ", "lgpl", ("2.1", "3.0"))) for v in versions],
    ("isc", "mention", f"{_PLACED} isc license"),
    ("mit", "mention", f"{_PLACED} mit license"),
    ("mpl-2.0", "mention", f"{_PLACED} mozilla public license << mpl >> << version >> << v >> 2 0"),
    ("unlicense", "mention", f"{_PLACED} unlicense"),
]
SCORES = {"text": 1.0, "notice": 0.8, "mention": 0.6}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ANY = object()


def tokens_of(template: str) -> list:
    """A template's items: ``<<``, ``>>``, a number (of words of any kind at most), or a list of wordings (lists of words)."""
    out: list = []
    for item in re.findall(r"<<|>>|\{\{[^}]*\}\}|[^\s]+", template):
        if item.startswith("{{"):
            out.append(int(item[2:-2]) if item[2:-2].isdigit() else [w.split() for w in item[2:-2].split("|")])
        else:
            out.append(item if item in ("<<", ">>") else [[item]])
    return out


class Automaton:
    """A template's automaton over words (bytes). State 0 starts; ``final`` accepts."""

    def __init__(self, template: str):
        self.moves: list[dict] = [{}]
        self.empty: list[set[int]] = [set()]
        self.must: list[bytes] = []
        here, opened = 0, []
        for item in tokens_of(template):
            if item == "<<":
                opened.append(here)
            elif item == ">>":
                # What follows may also start where the optional region began.
                nxt = self._state()
                self.empty[here].add(nxt)
                self.empty[opened.pop()].add(nxt)
                here = nxt
            elif isinstance(item, int):
                nxt = self._state()
                for k in range(item):
                    self.moves[here].setdefault(_ANY, set()).add(nxt)
                    if k + 1 < item:
                        mid = self._state()
                        self.moves[here][_ANY].add(mid)
                        here = mid
                here = nxt
            else:
                nxt = self._state()
                for wording in item:
                    at = here
                    for w in wording[:-1]:
                        mid = self._state()
                        self.moves[at].setdefault(w.encode(), set()).add(mid)
                        at = mid
                    self.moves[at].setdefault(wording[-1].encode(), set()).add(nxt)
                if not opened and len(item) == 1:
                    self.must += [w.encode() for w in item[0]]
                here = nxt
        assert not opened, template
        self.final = here
        self.must = sorted(set(self.must), key=lambda w: (-len(w), w))
        self.start = self._closed({0})
        self.first = {w for s in self.start for w in self.moves[s] if w is not _ANY}
        self.known: dict = {}

    def _state(self) -> int:
        self.moves.append({})
        self.empty.append(set())
        return len(self.moves) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return frozenset(out)

    def accepts_at(self, words: list[bytes], at: int) -> int | None:
        """The end (exclusive) of the longest match that starts at ``at``, or None."""
        states, end = self.start, None
        for i in range(at, len(words) + 1):
            if self.final in states:
                end = i
            if i == len(words) or not states:
                break
            key = (states, words[i])
            if key not in self.known:
                if len(self.known) > 100_000:  # words that any-word moves met; the cache only saves time
                    self.known.clear()
                self.known[key] = self._closed({t for s in states for w in (words[i], _ANY) for t in self.moves[s].get(w, ())})
            states = self.known[key]
        return end


def compiled(templates: list[tuple[str, str, str]] = TEMPLATES) -> list[tuple[str, str, Automaton]]:
    return [(label, kind, Automaton(t)) for label, kind, t in templates]


def scan(text: bytes | None, automata: list[tuple[str, str, Automaton]], phrases: list[tuple[list[bytes], str]]) -> dict:
    """All findings in one text: n_words, base places, template spans (label, kind, first word, end)."""
    low = (text or b"").lower()
    words = _WORD.findall(low)
    base, spans = [], []
    for phrase, label in phrases:
        if all(w in low for w in phrase):
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    base.append((at, label))
    for label, kind, automaton in automata:
        if all(w in low for w in automaton.must):
            at = 0
            while at < len(words):
                end = automaton.accepts_at(words, at) if words[at] in automaton.first else None
                if end:
                    spans.append((label, kind, at, end))
                at = end or at + 1
    return {"n_words": len(words), "base": base, "spans": spans}


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, kind: string, start: long, end: long>>"


def scanned(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Findings for each row of ``docs`` (doc_id, text); spans are the template matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        wanted = [(p.encode().split(), label) for p, label in phrases.items()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                x = scan(text, automata, wanted)
                places = [at for at, _ in x["base"]]
                base_labels = sorted({label for _, label in x["base"]})
                labels = sorted({*base_labels, *(x[0] for x in x["spans"])})
                rows.append({"doc_id": doc_id, "n_words": x["n_words"], "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(base_labels), "labels": ",".join(labels), "score": max([SCORES[k] for _, k, _, _ in x["spans"]], default=0.5 if places else 0.0), "spans": [{"label": a, "kind": k, "start": b, "end": c} for a, k, b, c in x["spans"]]})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, _DDL)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("spans")


ship(__name__)
