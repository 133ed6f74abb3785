"""Operator 9: license scan by template-markup matching.

A template is a license text with markup: ``<<optional>> ... <<end>>`` may be missing (and hold another), ``<<any:n>>`` stands
for 0 to n replaceable words.  Each is compiled into a token automaton; a text is accepted where the mandatory wording matches word
for word.  The automata run only from places where a template's first mandatory words stand, found for all texts at once
by word hashes and then checked by words.

Fixed phrases give the base places and labels besides.

Defined cases: a null text counts as empty: no words, no labels, score 0; rows are independent, so null and repeated ids,
ties and extra columns don't matter; an empty table gives an empty result; a very long text is scanned whole, in its own slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, words

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution {} "
    "this software is provided by <<any:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<any:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_BSD_NAMES = "neither the name of <<any:15>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"

#: Label, and template in markup: license notices, and the wording of whole licenses.
TEMPLATES = [
    ("notice-gpl", "this <<any:3>> is licensed under <<optional>> the terms of <<end>> the gnu general public license <<optional>> as published by the free software foundation <<end>> version <<any:1>>"),
    ("notice-apache", "licensed under the apache license version 2 0"),
    ("notice-mit", "released under <<optional>> the terms of <<end>> the mit license"),
    ("notice-cc-by-nc", "licensed under <<optional>> a <<end>> <<optional>> the <<end>> cc by nc <<optional>> 4 0 <<end>>"),
    (
        "text-mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the <<any:2>> to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute <<optional>> sublicense <<end>> and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall <<any:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("text-bsd-2", _BSD.format("")),
    ("text-bsd-3", _BSD.format(f"<<optional>> 3 <<end>> {_BSD_NAMES}")),
    ("text-bsd-4", _BSD.format(f"<<optional>> 3 <<end>> all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<any:20>> <<optional>> 4 <<end>> {_BSD_NAMES}")),
    (
        "header-apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:10>> "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "header-gpl",
        "this <<any:2>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version <<any:1>> of the license or <<optional>> at your option <<end>> any later version "
        "this <<any:2>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details <<optional>> you should have received a copy of the gnu general public license along with this <<any:2>> <<optional>> if not see <<any:8>> <<end>> <<end>>",
    ),
]

_SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def split(text: str) -> list[str]:
    return [x for x in _SPLIT.split(text.translate(_UPPER)) if x]


class Automaton:
    """States are places in the template; ``step`` holds (word or None for any, next state), ``skip`` moves without a word."""

    def __init__(self, template: str):
        self.step: list[list[tuple[str | None, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        self.lead: list[str] = []
        leading, opened = True, []
        for item in template.split():
            here = len(self.step) - 1
            if item == "<<optional>>":
                opened.append(here)
                leading = False
            elif item == "<<end>>":
                self.skip[opened.pop()].append(here)
            elif item.startswith("<<any:"):
                leading = False
                n = int(item[6:-2])
                for _ in range(n):
                    self._grow(None)
                for k in range(n):
                    self.skip[here + k].append(here + n)
            else:
                self._grow(item)
                if leading:
                    self.lead.append(item)
        self.accept = len(self.step) - 1
        self.mandatory = len(self.lead)

    def _grow(self, word: str | None) -> None:
        self.step[-1].append((word, len(self.step)))
        self.step.append([])
        self.skip.append([])

    def _close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for x in self.skip[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return states

    def match(self, text: list[str], start: int) -> int | None:
        """Where the shortest match from start ends, or None."""
        states = self._close({0})
        at = start
        while states:
            if self.accept in states:
                return at
            if at >= len(text):
                return None
            states = self._close({to for s in states for word, to in self.step[s] if word is None or word == text[at]})
            at += 1
        return None


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automata = [(label, Automaton(x)) for label, x in templates]
        if not all(a.lead for _, a in self.automata):
            raise ValueError("a template has to begin with a mandatory word")
        self.phrases = [(x.split(), label) for x, label in phrases.items()]
        self.hashes = {w: words.hash_words([w])[0] for w in {w for p, _ in self.phrases for w in p} | {w for _, a in self.automata for w in a.lead}}

    def places(self, sequence: list[str], h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Places of a slice's words where the sequence stands within one text."""
        n = len(h) - len(sequence) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        rare = max(range(len(sequence)), key=lambda i: len(sequence[i]))
        at = np.flatnonzero(h[rare : rare + n] == self.hashes[sequence[rare]])
        for i, w in enumerate(sequence):
            at = at[h[at + i] == self.hashes[w]]
        return at[doc[at] == doc[at + len(sequence) - 1]]

    def scan(self, column: pa.Array) -> Iterator[tuple]:
        """Per text: n_words, n_base, first, last, base labels, labels, score."""
        for first, counts, h in words.hashed(column):
            doc = np.repeat(np.arange(len(counts)), counts)
            begin = np.cumsum(counts) - counts
            starts: dict[int, list[int]] = {}
            base: dict[int, set[str]] = {}
            for sequence, label in self.phrases:
                for p in self.places(sequence, h, doc).tolist():
                    d = int(doc[p])
                    starts.setdefault(d, []).append(p - int(begin[d]))
                    base.setdefault(d, set()).add(label)
            wanted: dict[int, list[tuple[int, int]]] = {}
            for k, (_, automaton) in enumerate(self.automata):
                for p in self.places(automaton.lead, h, doc).tolist():
                    d = int(doc[p])
                    wanted.setdefault(d, []).append((k, p - int(begin[d])))
            own: dict[int, set[str]] = {}
            for d, tries in wanted.items():
                text = split(column[first + d].as_py() or "")
                own[d] = {self.automata[k][0] for k, p in tries if self.automata[k][1].match(text, p) is not None}
            for d, n in enumerate(counts.tolist()):
                places, mine, found = starts.get(d, []), base.get(d, set()), own.get(d, set())
                score = 1.0 if found else 0.5 if mine else 0.0
                yield n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(mine)), ",".join(sorted(mine | found)), score


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1: a template's whole wording stands in
    the text; 0.5: a phrase only)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            rows = list(scanner.scan(batch.column(1)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return common.pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The phrases and templates as patterns over a text's words joined by spaces (each word between two of them)."""
    joined = "' ' || array_to_string(ws, '  ') || ' '"

    def pattern(template: str) -> str:
        kinds = {"<<optional>>": "(?:", "<<end>>": ")?"}
        return "".join(kinds.get(x) or (f"(?: [^ ]+ ){{0,{x[6:-2]}}}" if x.startswith("<<any:") else f" {x} ") for x in template.split())

    patterns = {label: pattern(template) for label, template in TEMPLATES}
    places = ", ".join(f"list_filter(range(1, len(ws) + 1), lambda i: {' AND '.join(f'ws[i + {k}] = {w!r}' for k, w in enumerate(p.split()))})" for p in PHRASES)
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, {joined} AS j, [{places}] AS ps FROM w),
q AS (SELECT doc_id, len(ws) AS n_words, flatten(ps) AS f,
  list_filter([{', '.join(f"CASE WHEN len(ps[{i + 1}]) > 0 THEN {label!r} END" for i, label in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS b,
  list_filter([{', '.join(f"CASE WHEN regexp_matches(j, {x!r}) THEN {label!r} END" for label, x in patterns.items())}], lambda x: x IS NOT NULL) AS m
  FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(f) AS BIGINT) AS n_base,
  CAST(list_min(f) - 1 AS BIGINT) AS first_word, CAST(list_max(f) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(b), ',') AS base_labels, array_to_string(list_sort(list_concat(b, m)), ',') AS labels,
  CASE WHEN len(m) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM q"""


ORACLE = _oracle()
