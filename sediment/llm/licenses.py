"""License scans by template markup.

A template is license wording with markup for regions that may be left out and regions that may be replaced:

    <<beginOptional>>words<<endOptional>>
    <<var;name="who";min="1";max="8";match="regex of one word">>

It is compiled to an automaton over words. A text is accepted where the mandatory words stand one after
another exactly, with nothing between them but what the markup allows. Words are
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased, so case, punctuation and white space never matter.

Next to it, every place of a few fixed phrases is counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.frames import batch, ddl, prepare, read
from sediment.llm.kernel import ALNUM, text_spans, word_hash

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

_VERB = '<<var;name="verb";min="1";max="1";match="licensed|released|distributed|published|available">>'
_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
    '<<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction'
)
# The public wording of whole licenses, with markup where they may differ.
_MIT_REST = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "<<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    'FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;name="who";min="1";max="8";match="[^ ]+">> BE LIABLE FOR ANY CLAIM, DAMAGES '
    "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE"
)
_ISC = (
    "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="who";min="1";max="8";match="[^ ]+">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    'WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="who2";min="1";max="8";match="[^ ]+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR '
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
    '<<beginOptional>><<beginOptional>>3. <<endOptional>>Neither the name of <<var;name="who";min="1";max="12";match="[^ ]+">> may be used to endorse or promote products derived '
    "from this software without specific prior written permission. <<endOptional>>"
    'THIS SOFTWARE IS PROVIDED BY <<var;name="who2";min="1";max="12";match="[^ ]+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    '<<var;name="who3";min="1";max="12";match="[^ ]+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED '
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
    "subject to the following restrictions: <<beginOptional>>1. <<endOptional>>The origin of this software must not be misrepresented; you must not claim that you wrote "
    "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "<<beginOptional>>2. <<endOptional>>Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "<<beginOptional>>3. <<endOptional>>This notice may not be removed or altered from any source distribution"
)
TEMPLATES = {
    "mit-notice": f"{_VERB} under <<beginOptional>>the terms of <<endOptional>>the MIT License",
    "mit-text": _GRANT,
    "apache-2-notice": f"{_VERB} under the <<beginOptional>>terms of the <<endOptional>>Apache License<<beginOptional>>, Version<<endOptional>> 2",
    "cc-by-nc-notice": f'{_VERB} under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC BY-NC <<var;name="version";min="1";max="2";match="[0-9]+">>',
    "gpl-notice": (
        '<<beginOptional>><<var;name="work";min="1";max="4";match="[^ ]+">> is <<endOptional>>licensed under the '
        "<<beginOptional>>terms of the <<endOptional>>GNU General Public License"
        '<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<beginOptional>>, either<<endOptional>> version '
        '<<var;name="version";min="1";max="1";match="[23]">>'
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "isc-text": (
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"
    ),
    "mit-license": f"{_GRANT}{_MIT_REST}",
    "isc-license": _ISC,
    "bsd-license": _BSD,
    "zlib-license": _ZLIB,
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(.*?)>>", re.S)


def fold(text: str) -> list[str]:
    """The words of a text, A-Z lower-cased."""
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


@dataclass(frozen=True)
class Var:
    """A replaceable region: least to most words that each match the pattern."""

    least: int
    most: int
    pattern: str


def parse(template: str) -> list:
    """A template as a list of words, Vars and lists for optional regions."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(template):
        stack[-1] += fold(template[at : m.start()])
        at = m.end()
        kind, *rest = m[1].split(";")
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(inner)
        elif kind == "var":
            got = dict(re.findall(r'(\w+)="(.*?)"', ";".join(rest)))
            stack[-1].append(Var(int(got.get("min", 0)), int(got.get("max", 8)), got.get("match", "[^ ]+")))
        else:
            raise ValueError(f"unknown markup {kind}")
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + fold(template[at:])


class Automaton:
    """A template's automaton: from each state, the next states by word, by pattern and by nothing."""

    def __init__(self, template: str):
        self.by_word: list[dict[str, int]] = [{}]
        self.by_pattern: list[list[tuple[re.Pattern, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        parts = parse(template)
        self.needed = [p for p in parts if isinstance(p, str)]
        if not self.needed:
            raise ValueError("a template needs a mandatory word outside its optional regions")
        self.final = self._chain(parts, 0)
        self.start = self._close({0})
        self.first_words = {w for s in self.start for w in self.by_word[s]}
        self.first_any = any(self.by_pattern[s] for s in self.start)

    def _state(self) -> int:
        self.by_word.append({})
        self.by_pattern.append([])
        self.free.append([])
        return len(self.free) - 1

    def _chain(self, parts: list, at: int) -> int:
        for p in parts:
            if isinstance(p, str):
                to = self._state()
                self.by_word[at][p] = to
                at = to
            elif isinstance(p, Var):
                pattern, ends = re.compile(p.pattern), []
                for k in range(p.most):
                    if k >= p.least:
                        ends.append(at)
                    to = self._state()
                    self.by_pattern[at].append((pattern, to))
                    at = to
                to = self._state()
                for e in [*ends, at]:
                    self.free[e].append(to)
                at = to
            else:
                inside, to = self._state(), self._state()
                self.free[at] += [inside, to]
                self.free[self._chain(p, inside)].append(to)
                at = to
        return at

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts(self, words: list[str], at: int) -> bool:
        """Whether an accepted wording starts at word `at`."""
        now = self.start
        while self.final not in now:
            if at >= len(words):
                return False
            w, nxt = words[at], set()
            for s in now:
                if w in self.by_word[s]:
                    nxt.add(self.by_word[s][w])
                nxt.update(t for p, t in self.by_pattern[s] if p.fullmatch(w))
            if not nxt:
                return False
            now, at = self._close(nxt), at + 1
        return True

    def occurs(self, words: list[str]) -> bool:
        return any(self.accepts(words, k) for k, w in enumerate(words) if self.first_any or w in self.first_words)


_FOUND = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.automata = {k: Automaton(t) for k, t in templates.items()}
        # a text without the longest mandatory word of a template cannot be accepted by it
        self.anchor = {k: np.uint64(word_hash(max(a.needed, key=len))) for k, a in self.automata.items()}
        self.anchors = np.unique(np.array(list(self.anchor.values()), np.uint64))
        self.phrases = {k: [np.uint64(word_hash(w)) for w in p.split()] for k, p in PHRASES.items()}

    def scan(self, column: pa.Array) -> Iterator[dict]:
        """One dict of result columns for each group of texts of a column, in order."""
        for first, h, off, starts, ends in text_spans(column, ALNUM):
            rows = len(off) - 1
            text = np.repeat(np.arange(rows), np.diff(off))
            base: list[set[str]] = [set() for _ in range(rows)]
            places = []
            for label, phrase in self.phrases.items():
                k = len(phrase)
                if len(h) < k:
                    continue
                at = np.flatnonzero(h[: len(h) - k + 1] == phrase[0])
                for j in range(1, k):
                    at = at[h[at + j] == phrase[j]]
                at = at[text[at] == text[at + k - 1]]
                places.append(at)
                for r in np.unique(text[at]).tolist():
                    base[r].add(label)
            at = np.concatenate(places) if places else np.zeros(0, np.int64)
            n_base = np.bincount(text[at], minlength=rows)
            low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            np.minimum.at(low, text[at], at - off[text[at]])
            np.maximum.at(high, text[at], at - off[text[at]])
            own: list[set[str]] = [set() for _ in range(rows)]
            near = np.flatnonzero(np.isin(h, self.anchors))
            for r in np.unique(text[near]).tolist():
                hashes = h[off[r] : off[r + 1]]
                words = fold(column[first + r].as_py())
                for label, a in self.automata.items():
                    if (hashes == self.anchor[label]).any() and a.occurs(words):
                        own[r].add(label)
            some = n_base > 0
            yield {
                "n_words": np.diff(off), "n_base": n_base,
                "first_word": pa.array(np.where(some, low, 0), pa.int64(), mask=~some), "last_word": pa.array(np.where(some, high, 0), pa.int64(), mask=~some),
                "base_labels": [",".join(sorted(b)) for b in base], "labels": [",".join(sorted(b | o)) for b, o in zip(base, own, strict=True)],
                "score": [1.0 if o else 0.5 if b else 0.0 for b, o in zip(base, own, strict=True)],
            }


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            row = 0
            for found in scanner.scan(b.column("text")):
                n = len(found["n_words"])
                part = batch(_FOUND, **found)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, n), *part.columns], names=["doc_id", *_FOUND])
                row += n

    return run


def license_scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs (doc_id, text).

    n_base counts all places of PHRASES, first_word and last_word are the smallest and largest of their first
    words' places, null without any. labels joins the phrases' labels and those of the templates that
    accept. score: 1 where a template accepts, 0.5 where only a phrase stands, else 0. A null or empty text
    has no words and empty labels; a text of any length is scanned as a whole; rows are scanned one by one, so repeated
    rows give equal ones; other columns are left out; an empty table gives an empty one.
    """
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_scan(templates or TEMPLATES), f"doc_id {kind}, {ddl(_FOUND)}")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, read(spark, sf_dir, "documents"))


def _regex(parts: list) -> str:
    """The language of a parsed template over words that each end in a space."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += p + " "
        elif isinstance(p, Var):
            out += f"(?:(?:{p.pattern}) ){{{p.least},{p.most}}}"
        else:
            out += f"(?:{_regex(p)})?"
    return out


def _sql() -> str:
    phrase = {k: p.split() for k, p in PHRASES.items()}
    places = " || ".join(
        "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p)) + ")" for p in phrase.values()
    )
    base = ", ".join(f"CASE WHEN contains(t, ' {p} ') THEN '{k}' END" for k, p in PHRASES.items())
    own = ", ".join(f"CASE WHEN regexp_matches(t, ' {_regex(parse(x))}') THEN '{k}' END" for k, x in TEMPLATES.items())
    join = "coalesce(array_to_string(list_sort(list_filter({0}, lambda x: x IS NOT NULL)), ','), '')"
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
texts AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM words),
found AS (SELECT doc_id, len(w)::BIGINT AS n_words, {places} AS p, [{base}] AS b, [{own}] AS o FROM texts)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
       {join.format("b")} AS base_labels, {join.format("b || o")} AS labels,
       CASE WHEN len(list_filter(o, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM found
"""


OP6_SQL = _sql()
