"""License scans by template markup: each template is compiled to an automaton over words.

In a template, <<beginOptional>> ... <<endOptional>> may be absent and <<var;match=REGEX;most=N>> stands for one to N
words that each match REGEX whole (least=0: or for none); all other words must be there exactly, in order, from the first to the
last: a license whose clauses are altered or cut off is not accepted. Labels ending in -notice are short statements that name a license, -header the
notices that files bear, all others whole license texts. Words are runs of letters, digits and
non-ASCII characters after A-Z are lower-cased, so case, punctuation and line breaks do not count. The automaton has a
state per word of the template; a match may start wherever the first mandatory or optional word stands, and ends
at the longest accepting state. Base labels come from three fixed phrases.

The score is 0 without a hit; 0.5 with a base phrase only; with an accepted template it is 1 - 0.5 / (1 + mandatory
words of the longest template accepted), so longer exact wording is stronger evidence.

Defined results: null is an empty text: no words, no labels, score 0 and null positions. Repeated rows are scored
one by one, an empty table gives no rows, other columns are not looked at. A text is held as one list of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import FOLD, binaries, by_batches

# Phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Texts and notices of public licenses as templates, by label.
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
BSD_BEGIN = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<var;match=[0-9a-z];most=1;least=0>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<var;match=[0-9a-z];most=1;least=0>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
BSD_NAMES = (
    "<<var;match=[0-9a-z];most=1;least=0>> Neither the <<var;match=name|names;most=1>> of <<var;match=.+;most=12>> nor the names of <<var;match=its|their;most=1>> contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY <<var;match=.+;most=12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=.+;most=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
ISC_BEGIN = "Permission to use, copy, modify, <<var;match=and;most=1>><<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"
ISC_END = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;match=.+;most=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "<<var;match=.+;most=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
)
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be "
        f"included in all copies or substantial portions of the Software. {AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=.+;most=8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        f"AN ACTION OF CONTRACT, TORT OR OTHERWISE, {DEALINGS}"
    ),
    "bsd-2-clause": BSD_BEGIN + BSD_END,
    "bsd-3-clause": BSD_BEGIN + BSD_NAMES + BSD_END,
    "isc": ISC_BEGIN + ", provided that the above copyright notice and this permission notice appear in all copies." + ISC_END,
    "0bsd": ISC_BEGIN + "." + ISC_END,
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will <<var;match=.+;most=8>> be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1. "
        "<<endOptional>>The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an <<var;match=acknowledge?ment;most=1>> "
        "in the product documentation would be appreciated but is not required. <<beginOptional>>2. <<endOptional>>Altered source versions must be plainly marked as such, and must not be misrepresented as being "
        "the original software. <<beginOptional>>3. <<endOptional>>This notice may not be removed or altered from any source distribution"
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
        f"processor. {AS_IS}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR "
        f"OTHERWISE, {DEALINGS}"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        f"act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        f"OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, {DEALINGS}"
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use <<var;match=this|these;most=1>> <<var;match=.+;most=3>> except in compliance with the License. You may obtain a copy of the "
        "License at <<var;match=https?;most=1>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"
    ),
    "gpl-header": (
        "<<var;match=.+;most=4>> is free software<<var;match=you;most=1>> can redistribute it and/or modify it under the terms of the GNU <<var;match=lesser|library|affero;most=1;least=0>> General Public License as "
        "published by the Free Software Foundation; either version <<var;match=[0-9]+;most=2>> of the License, or (at your option) any later version. <<var;match=.+;most=4>> is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<var;match=lesser|library|affero;most=1;least=0>> General "
        "Public License for more details"
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "<<var;match=https?;most=1>>://<<beginOptional>>www.<<endOptional>>mozilla.org/MPL/2.0/"
    ),
    "mit-notice": "<<beginOptional>>This software is <<endOptional>><<var;match=released|licensed|distributed|available|provided;most=1>> under the <<beginOptional>>terms of the <<endOptional>>MIT License",
    "apache-2.0-notice": "Licensed under the Apache License<<beginOptional>>,<<endOptional>> Version 2.0 <<beginOptional>>(the \"License\")<<endOptional>>",
    "gpl-notice": "<<beginOptional>>This <<var;match=work|program|software|file|document;most=1>> is <<endOptional>>licensed under the GNU <<beginOptional>>Lesser <<endOptional>>General Public License<<beginOptional>>, version <<var;match=[0-9]+;most=2>> <<beginOptional>>or later<<endOptional>><<endOptional>>",
    "cc-notice": "<<beginOptional>>This work is <<endOptional>>licensed under <<beginOptional>>a <<endOptional>>CC BY<<beginOptional>>-NC<<endOptional>><<beginOptional>>-SA<<endOptional>><<beginOptional>>-ND<<endOptional>> <<var;match=[0-9];most=2>>",
    "creative-commons-notice": "licensed under <<beginOptional>>a <<endOptional>>Creative Commons <<var;match=[a-z]+;most=4>> <<beginOptional>><<var;match=[0-9];most=2>><<endOptional>> <<beginOptional>>International <<endOptional>>License",
}

MARK = re.compile(r"<<(beginOptional|endOptional|var;[^<>]*)>>")


class Template:
    """States are 0 to `last`; edges carry a word (bytes) or a compiled pattern, empty moves skip optional regions."""

    def __init__(self, label: str, markup: str):
        self.label, self.words, self.patterns, self.empty, self.mandatory = label, {}, {}, {}, 0
        self.last, opened, at = 0, [], 0
        for part in [*MARK.finditer(markup), None]:
            for word in markup[at : part.start() if part else len(markup)].encode().translate(FOLD).split():
                self.words[self.last] = word
                self.last += 1
                self.mandatory += not opened
            if part is None:
                break
            at = part.end()
            if part[1] == "beginOptional":
                opened.append(self.last)
            elif part[1] == "endOptional":
                self.empty.setdefault(opened.pop(), set()).add(self.last)
            else:
                options = dict(x.split("=", 1) for x in part[1].split(";")[1:])
                pattern, most = re.compile(options["match"].encode()), int(options.get("most", 1))
                first = self.last
                for _ in range(most):
                    self.patterns[self.last] = pattern
                    self.last += 1
                least = int(options.get("least", 1))
                for k in range(first + min(1, least), self.last):
                    self.empty.setdefault(k, set()).add(self.last)
                self.mandatory += not opened and least > 0
        if opened:
            raise ValueError(f"{label}: an optional region is not closed")
        self.begin = self.closure({0})
        if self.last in self.begin:
            raise ValueError(f"{label}: nothing is mandatory")

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for k in self.empty.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return frozenset(seen)

    def first(self) -> tuple[set[bytes], bool]:
        """Words that can begin a match, and whether a pattern can."""
        return {self.words[k] for k in self.begin if k in self.words}, any(k in self.patterns for k in self.begin)

    def accept(self, found: list[bytes], start: int) -> int | None:
        """The end of the longest match from start."""
        states, end = self.begin, None
        for at in range(start, len(found)):
            word = found[at]
            states = self.closure({k + 1 for k in states if self.words.get(k) == word or k in self.patterns and self.patterns[k].fullmatch(word)})
            if not states:
                break
            if self.last in states:
                end = at + 1
        return end


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.templates = [Template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
        self.phrases = [(tuple(k.encode().split()), v) for k, v in PHRASES.items()]
        # a text without any mandatory word of a template can't match it
        self.needs = {t.label: self._rarest(t) for t in self.templates}

    @staticmethod
    def _rarest(t: Template) -> bytes:
        """The longest word that no empty move can skip, the first of those."""
        skipped = {k for a, ends in t.empty.items() for b in ends for k in range(a, b)}
        return max((w for k, w in t.words.items() if k not in skipped), key=len, default=b"")

    def base(self, found: list[bytes], folded: bytes) -> tuple[list[int], set[str]]:
        starts: list[int] = []
        labels: set[str] = set()
        if b"license" in folded:
            at = -1
            while True:
                try:
                    at = found.index(b"license", at + 1)
                except ValueError:
                    break
                for words, label in self.phrases:
                    k = at - len(words) + 1
                    if k >= 0 and tuple(found[k : at + 1]) == words:
                        starts.append(k)
                        labels.add(label)
        return starts, labels

    def matched(self, found: list[bytes], folded: bytes) -> list[tuple[int, int, Template]]:
        wanted = [t for t in self.templates if self.needs[t.label] in folded]
        if not wanted:
            return []
        out, whole = [], set(found)
        for t in wanted:
            words, pattern = t.first()
            if (need := self.needs[t.label]) and need not in whole:
                continue
            places = range(len(found)) if pattern else sorted(k for w in words & whole for k in positions(found, w))
            upto = 0
            for k in places:
                if k >= upto and (end := t.accept(found, k)):
                    out.append((k, end, t))
                    upto = end
        return out

    def scan(self, text: bytes) -> tuple:
        folded = text.translate(FOLD)
        found = folded.split()
        starts, base = self.base(found, folded)
        matched = self.matched(found, folded)
        labels = base | {t.label for _, _, t in matched}
        score = 1 - 0.5 / (1 + max(t.mandatory for _, _, t in matched)) if matched else 0.5 if base else 0.0
        ends = (min(starts), max(starts)) if starts else (None, None)
        return len(found), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, [[a, b] for a, b, _ in matched]


def positions(found: list[bytes], word: bytes) -> Iterator[int]:
    at = -1
    try:
        while True:
            yield (at := found.index(word, at + 1))
    except ValueError:
        return


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans ([start, end) in words of accepted templates)."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.list_(pa.int64()))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = [scanner.scan(t) for t in binaries(batch.column("text"))]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<array<long>>"
    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
