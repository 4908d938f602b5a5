"""Licence scan: template markup compiled into token automata.

A template is words with two kinds of marked regions:
  <<beginOptional>> ... <<endOptional>>     may be absent as a whole; may nest
  <<var;name=holder>>                       replaceable: any words, up to where the next mandatory ones stand
  <<var;name=holder;line>>                  the same, without a blank line among them
The automaton of a template runs over a text's words from each place where its first mandatory
words stand, and accepts when all mandatory wording has been met exactly. Words are
[0-9A-Za-z and bytes from 0x80] runs, A-Z in lower case; whole texts are read.

Null and empty texts have no words, no labels and score 0. Rows are never dropped.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .words import ALNUM, Texts, slices

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The warranty parts of licence texts, in the words of their authors.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE"""
_HOLDERS = """THIS SOFTWARE IS PROVIDED BY <<var;name=provider>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=liable>> BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""

#: Fixed values: (label, template) of notices and licence texts. A text without its warranty part counts, one with another wording of it doesn't run on into it.
TEMPLATES = [
    ("mit", "released under the <<beginOptional>>terms of the <<endOptional>>MIT License"),
    ("mit", "licensed under the <<beginOptional>>terms of the <<endOptional>>MIT <<beginOptional>>open source <<endOptional>>License"),
    ("mit", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
shall be included in all copies or substantial portions of the Software. <<beginOptional>>{_AS_IS}<<endOptional>>"""),
    ("apache-2", "Licensed under the Apache License, Version 2<<beginOptional>>.0<<endOptional>>"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use this file except in
compliance with the License. You may obtain a copy of the License at <<var;name=url>> Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
<<beginOptional>>See the License for the specific language governing permissions and limitations under the License.<<endOptional>>"""),
    ("gpl-3", "licensed under the GNU General Public License, <<beginOptional>>either <<endOptional>>version 3 <<beginOptional>>or later<<endOptional>>"),
    ("gpl", """under the terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>; either version
<<var;name=version>> of the License, or (at your option) any later version<<endOptional>>"""),
    ("cc-by-nc", "licensed under <<beginOptional>>a <<endOptional>>CC BY-NC <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial <<beginOptional>><<var;name=version;line>><<endOptional>> License"),
    ("cc-by", "licensed under a Creative Commons Attribution <<beginOptional>>4.0<<endOptional>> International License"),
    ("bsd", f"""Redistribution and use in source and binary forms, with or without modification, are permitted <<beginOptional>>(subject to the limitations
in the disclaimer below)<<endOptional>> provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
<<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=holder>> may be used to endorse or promote products derived from this software without specific prior
written permission.<<endOptional>> <<beginOptional>>{_HOLDERS}<<endOptional>>"""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS<<endOptional>>"""),
    ("all-rights-reserved", "Copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;line>> All rights reserved"),
]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLANK = re.compile(rb"\n[ \t\r]*\n")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """States are places between a template's words; each has word moves, free moves and loops."""

    def __init__(self, template: str):
        self.word: list[tuple[bytes, int] | None] = []
        self.free: list[list[int]] = []
        self.loop: list[str | None] = []
        at, opened = self._state(), []
        lead: list[bytes] = []
        leading = True
        for mark, plain in re.findall(r"<<(.*?)>>|([^<]+|<)", template, re.S):
            if mark.startswith("beginOptional"):
                opened.append(at)
                leading = leading and not lead
            elif mark.startswith("endOptional"):
                self.free[opened.pop()].append(at)
            elif mark.startswith("var"):
                # a state of its own that any word leads back to
                new = self._state()
                self.free[at].append(new)
                at = new
                self.loop[at] = "line" if mark.endswith(";line") else "any"
            else:
                for w in words_of(plain):
                    new = self._state()
                    self.word[at] = (w, new)
                    at = new
            if not mark and not opened and len(lead) < 2 and leading:
                lead += words_of(plain)
            elif lead:
                leading = False
        if opened or not lead:
            raise ValueError("a template needs balanced regions and begins with mandatory words")
        self.lead, self.end = lead, at
        # skipping ahead: a region's free moves chain, so close them once
        self.close = [self._closed(s) for s in range(len(self.word))]

    def _state(self) -> int:
        self.word.append(None)
        self.free.append([])
        self.loop.append(None)
        return len(self.word) - 1

    def _closed(self, s: int) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            todo += (new := set(self.free[todo.pop()]) - seen)
            seen |= new
        return frozenset(seen)

    def match(self, words: list[bytes], at: int, breaks: Collection[int] = (), known: dict | None = None) -> int | None:
        """The end of the accepted run of words that starts at `at`, else None; with its optional tail as far as that goes.

        breaks: words that a blank line stands before. known: what earlier calls over the same words
        found, so that many starts in one text cost no more than one.
        """
        states, end, known, path = self.close[0], None, {} if known is None else known, []
        for i in range(at, len(words) + 1):
            if (states, i) in known:
                end = known[states, i] or end
                break
            path.append((states, i))
            if self.end in states:
                # regions before the end were as short as they can be
                end, first = i, min(s for s in states if self.end in self.close[s])
                states = frozenset(s for s in states if s >= first)
            if i == len(words) or not states:
                break
            w, new = words[i], set()
            for s in states:
                if (x := self.word[s]) and x[0] == w:
                    new |= self.close[x[1]]
                if self.loop[s] == "any" or (self.loop[s] and i not in breaks):
                    new |= self.close[s]
            states = frozenset(new)
        for key in path:
            known[key] = end if end is not None and end >= key[1] else None
        return end


class Scanner:
    """All phrases and automata over slices of texts."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES):
        self.automata = [(label, Automaton(t)) for label, t in templates]
        self.phrases = [(label, words_of(p)) for p, label in phrases.items()]
        self.leads = [self._hash(a.lead[:2]) for _, a in self.automata]
        self.keys = [self._hash(p) for _, p in self.phrases]

    @staticmethod
    def _hash(words: list[bytes]) -> np.ndarray:
        data = b" ".join(words)
        return Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).words(ALNUM).hashes()

    def scan(self, texts: Texts) -> tuple[np.ndarray, dict[int, list[tuple[int, int, str, bool]]]]:
        """Words per row, and by row the found (first word, end word, label, by template)."""
        words = texts.lower().words(ALNUM)
        h = words.hashes()
        row_end = np.repeat(words.rows[1:], words.counts())
        found: dict[int, list[tuple[int, int, str, bool]]] = {}

        def places(key: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(h == key[0])
            at = at[at + len(key) <= row_end[at]]
            for j in range(1, len(key)):
                at = at[h[at + j] == key[j]]
            return at

        for (label, p), key in zip(self.phrases, self.keys, strict=True):
            for at in places(key):
                row = int(np.searchsorted(words.rows, at, side="right")) - 1
                found.setdefault(row, []).append((int(at - words.rows[row]), int(at - words.rows[row]) + len(p), label, False))
        starts = [(int(at), label, a) for (label, a), key in zip(self.automata, self.leads, strict=True) for at in places(key)]
        spelt: tuple[int, list[bytes], set[int], dict] = (-1, [], set(), {})
        data = texts.lower().data if starts else None
        # row by row, so that one row's words are held
        for at, label, a in sorted(starts, key=lambda x: x[0]):
            row = int(np.searchsorted(words.rows, at, side="right")) - 1
            if row != spelt[0]:
                text = data[texts.offsets[row] : texts.offsets[row + 1]].tobytes()
                places = [m.span() for m in _WORD.finditer(text)]
                blank = {k + 1 for k, (x, y) in enumerate(zip(places[:-1], places[1:], strict=True)) if text.count(b"\n", x[1], y[0]) > 1 and _BLANK.search(text, x[1], y[0])}
                spelt = row, [text[x:y] for x, y in places], blank, {}
            first = at - int(words.rows[row])
            if (end := a.match(spelt[1], first, spelt[2], spelt[3].setdefault(id(a), {}))) is not None:
                found.setdefault(row, []).append((first, end, label, True))
        return words.counts(), found


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans is a text of first-end:label joined by spaces, for all matches. score is 1 where an
    automaton accepted, 0.5 where only a base phrase stands, else 0.
    """
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"))
    names = [("n_words", LongType()), ("n_base", LongType()), ("first_word", LongType()), ("last_word", LongType()), ("base_labels", StringType()), ("labels", StringType()), ("score", DoubleType()), ("spans", StringType())]
    schema = StructType([source.schema["doc_id"], *(StructField(n, t) for n, t in names)])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for i, j, texts in slices(batch.column(1)):
                counts, found = scanner.scan(texts)
                out = []
                for row, n in enumerate(counts.tolist()):
                    got = found.get(row, ())
                    base = [x for x in got if not x[3]]
                    at = [x[0] for x in base]
                    out.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x[2] for x in base})), ",".join(sorted({x[2] for x in got})), 1.0 if len(base) < len(got) else 0.5 * bool(base), " ".join(f"{a}-{b}:{c}" for a, b, c, _ in sorted(got))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)
