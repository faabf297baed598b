"""License scans by template-markup matching.

A template is the wording of a license or notice with markup: text between ``<<beginOptional>>`` and
``<<endOptional>>`` may be left out, and ``<<var;max=n>>`` stands for up to n words of any kind. It is compiled into
an automaton over words. A place in a text is accepted if the automaton runs from it to its end: the mandatory
words match exactly and in order, whatever the punctuation, case and white space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import add_columns, binary, unused
from shelfwise.llm.words import ALPHANUMERIC, Words, join_hashes, read_words

#: Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license wordings, and the short notices that name one, in words without punctuation.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
    "the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph"
    "<<endOptional>> shall be included in all copies or substantial portions of the software <<beginOptional>>the software is provided as is "
    "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
    "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether "
    "in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the "
    "software<<endOptional>>"
)
_NO_WARRANTY = (
    "<<beginOptional>>this software is provided by <<var;max=12>> as is and any express or implied warranties including but not limited to the "
    "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=12>> be liable for "
    "any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict "
    "liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility "
    "of such damage<<endOptional>>"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met <<var;max=1>> redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer <<var;max=1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution"
)
_NO_ENDORSEMENT = (
    "neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
    "that the above copyright notice and this permission notice appear in all copies <<beginOptional>>the software is provided as is and <<var;max=6>> "
    "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
    "<<var;max=6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
    "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
    "this software<<endOptional>>"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
    "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
    "alter it and redistribute it freely subject to the following restrictions <<var;max=1>> the origin of this software must not be "
    "misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the "
    "product documentation would be appreciated but is not required <<var;max=1>> altered source versions must be plainly marked as such and must "
    "not be misrepresented as being the original software <<var;max=1>> this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
    "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
_SUBJECT = "<<beginOptional>>this <<var;max=3>> is<<endOptional>>"
#: The notices of a family differ in one word and the version; each name and version is mandatory wording of its own template.
_GNU = {
    "GPL-1.0": ("general public license", "1"), "GPL-2.0": ("general public license", "2"), "GPL-3.0": ("general public license", "3"),
    "LGPL-2.0": ("library general public license", "2"), "LGPL-2.1": ("lesser general public license", "2 1"),
    "LGPL-3.0": ("lesser general public license", "3"), "AGPL-3.0": ("affero general public license", "3"),
}
_LATER = "<<beginOptional>>of the license<<endOptional>> or <<beginOptional>>at your option<<endOptional>> <<beginOptional>>any<<endOptional>> %s"


def _gnu_templates() -> list[tuple[str, str]]:
    """The notice of the licenses' appendix, that of a single version, and the short notices, for each license of the family."""
    made = []
    for label, (name, version) in _GNU.items():
        free = f"this <<var;max=3>> is free software you can redistribute it and or modify it under the terms of the gnu {name} "
        by = "as published by the free software foundation "
        made.append((f"{label}-or-later", f"{free}{by}either version {version} of the license or <<beginOptional>>at your option<<endOptional>> any later version"))
        made.append((f"{label}-only", f"{free}version {version} <<beginOptional>>only<<endOptional>> {by}"))
        made.append((f"{label}-only", f"{free}{by}version {version} <<beginOptional>>of the license<<endOptional>> <<beginOptional>>only<<endOptional>>"))
        for verb in ("licensed", "released", "distributed"):
            short = f"{_SUBJECT} {verb} under the <<beginOptional>>terms of the<<endOptional>> gnu {name} "
            for numbered in (f"version {version}", f"v{version}"):
                made.append((f"{label}-only", f"{short}{numbered} <<beginOptional>>of the license<<endOptional>> <<beginOptional>>only<<endOptional>>"))
                made += [(f"{label}-or-later", short + numbered + " " + _LATER % word) for word in ("later", "newer", "later version", "newer version")]
    return made


#: (label, template). Where several are accepted at a place, the longest wins: see ``outermost``.
TEMPLATES = [
    ("MIT", _MIT),
    ("MIT", "released under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("MIT", "licensed under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("BSD-2-Clause", f"{_BSD} {_NO_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD} <<var;max=1>> {_NO_ENDORSEMENT} {_NO_WARRANTY}"),
    ("BSD-3-Clause", _NO_ENDORSEMENT),
    ("ISC", _ISC),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", f"{_SUBJECT} licensed under the apache license version 2 0 <<beginOptional>>the license "
     "you may not use this file except in compliance with the license<<endOptional>>"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 <<beginOptional>>if a copy of the mpl was not "
     "distributed with this file you can obtain one at<<endOptional>>"),
    ("EPL-2.0", "made available under the terms of the eclipse public license <<var;max=1>> 2 0"),
    ("BSL-1.0", "distributed under the boost software license version 1 0"),
    *_gnu_templates(),
    ("CC-BY-NC-4.0", f"{_SUBJECT} licensed under cc by nc 4 0"),
    ("CC-BY-4.0", f"{_SUBJECT} licensed under cc by 4 0"),
    ("CC-BY-SA-4.0", f"{_SUBJECT} licensed under cc by sa 4 0"),
    ("CC-BY-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-SA-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CC-BY-NC-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
]
_ANCHOR = 3


@dataclass
class Automaton:
    """States 0 to ``end``: state i reads word ``words[i]``, or any word if that is None; ``free[i]`` are states reached without a word."""

    words: list[str | None]
    free: list[tuple[int, ...]]
    anchor: tuple[str, ...]
    before: tuple[int, int]

    @property
    def end(self) -> int:
        return len(self.words)

    def _spread(self, states: set[int]) -> set[int]:
        waiting = list(states)
        while waiting:
            for s in self.free[waiting.pop()]:
                if s not in states:
                    states.add(s)
                    waiting.append(s)
        return states

    def longest(self, words: list[str], first: int) -> int | None:
        """Where the longest accepted run from word ``first`` ends (exclusive)."""
        states, at, best = self._spread({0}), first, None
        while states:
            if self.end in states:
                best = at
            if at == len(words):
                break
            word = words[at]
            states = self._spread({s + 1 for s in states if s < self.end and self.words[s] in (None, word)})
            at += 1
        return best


def compile_template(template: str) -> Automaton:
    """The automaton of a template; three mandatory words in a row are needed for an anchor, by which places are found."""
    parts = re.findall(r"<<[^>]*>>|[^\s<]+", template)
    words: list[str | None] = []
    free: dict[int, list[int]] = {}
    opened: list[int] = []
    run, anchor, before, least, most = [], None, (0, 0), 0, 0
    for part in parts:
        if part == "<<beginOptional>>":
            opened.append(len(words))
        elif part == "<<endOptional>>":
            free.setdefault(opened.pop(), []).append(len(words))
        elif part.startswith("<<var"):
            for _ in range(int(re.search(r"max=(\d+)", part)[1])):
                free.setdefault(len(words), []).append(len(words) + 1)
                words.append(None)
                most += 1
        else:
            words.append(part)
            most += 1
            least += not opened
            if not opened:
                run.append(part)
                if len(run) == _ANCHOR and anchor is None:
                    anchor, before = tuple(run), (least - _ANCHOR, most - _ANCHOR)
                continue
        run = []
    if anchor is None or opened:
        raise ValueError(f"no three mandatory words in a row, or an optional part left open: {template!r}")
    return Automaton(words, [tuple(free.get(i, ())) for i in range(len(words) + 1)], anchor, before)


def outermost(places: set[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The (label, first, stop) places that lie in no longer one, in order: a notice that goes on is what it says as a whole."""
    kept: list[tuple[str, int, int]] = []
    for label, first, stop in sorted(places, key=lambda m: (m[1], -m[2], m[0])):
        if not kept or stop > kept[-1][2] or (first, stop) == kept[-1][1:]:
            kept.append((label, first, stop))
    return kept


class Scanner:
    """Phrases and templates with the hashes of what a text must hold for them."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.automata = [(label, compile_template(t)) for label, t in templates]
        self.phrases = [(tuple(p.split()), label) for p, label in phrases.items()]
        self.by_length: dict[int, dict[int, list]] = {}
        for words, what in [*((w, ("phrase", label)) for w, label in self.phrases), *((a.anchor, ("template", i)) for i, (_, a) in enumerate(self.automata))]:
            value = int(self._grams(read_words(binary(pa.array([" ".join(words)])), ALPHANUMERIC).hash, len(words))[0])
            self.by_length.setdefault(len(words), {}).setdefault(value, []).append((b" ".join(w.encode() for w in words), what))

    @staticmethod
    def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
        value = hashes[: max(0, len(hashes) - n + 1)]
        for k in range(1, n):
            value = join_hashes(value, hashes[k : k + len(value)])
        return value

    def places(self, words: Words) -> list[tuple[int, int, tuple]]:
        """(text, first word within it, what) of all phrases and anchors that stand within a text."""
        out = []
        whose = words.text_of()
        for n, wanted in self.by_length.items():
            value = self._grams(words.hash, n)
            for at in np.flatnonzero(np.isin(value, np.array(list(wanted), np.uint64))).tolist():
                if whose[at] == whose[at + n - 1]:
                    phrase = words.phrase(at, at + n)
                    out += [(int(whose[at]), at - int(words.first[whose[at]]), what) for text, what in wanted[int(value[at])] if text == phrase]
        return out

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]], list[list[dict]]]:
        """Of each text: its number of words, the phrases and the accepted template places."""
        words = read_words(texts, ALPHANUMERIC, lower=True)
        base: list[list[dict]] = [[] for _ in range(len(texts))]
        accepted: list[set] = [set() for _ in range(len(texts))]
        own: dict[int, list[str]] = {}
        for i, at, (kind, what) in sorted(self.places(words), key=str):
            if kind == "phrase":
                length = next(len(w) for w, label in self.phrases if label == what)
                base[i].append({"label": what, "first": at, "stop": at + length})
                continue
            if i not in own:
                a, b = int(words.first[i]), int(words.first[i + 1])
                own[i] = words.phrase(a, b).decode("utf-8", "replace").split(" ")
            label, automaton = self.automata[what]
            least, most = automaton.before
            for first in range(max(0, at - most), at - least + 1):
                stop = automaton.longest(own[i], first)
                if stop is not None and stop > at:
                    accepted[i].add((label, first, stop))
                    break
        found = [[{"label": x, "first": a, "stop": b} for x, a, b in outermost(s)] for s in accepted]
        return words.counts(), [sorted(b, key=lambda m: (m["first"], m["label"])) for b in base], found


def scan_licenses(
    docs: DataFrame, keep: list[str], text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` columns of every document, its number of words, the places of phrases and those of templates.

    Places are arrays of (label, first, stop) in words from 0. Returns the frame and the names of the new columns by
    role (``n_words``, ``phrases``, ``templates``), which avoid those in ``keep``. Words are runs of letters, digits and
    characters beyond ASCII, A-Z lower-cased. Each place of a template's anchor gives one match at most, the longest of those
    that start first; an anchor that repeats gives each of its places. A match within a longer one, of whatever template, is left out. Null and empty texts have no words; repeated rows
    stay rows. No shuffle; automata run only where an anchor stands, in time linear in the template.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    names = {role: unused(kept, role) for role in ("n_words", "phrases", "templates")}
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("stop", T.LongType())])
    kinds = (T.LongType(), T.ArrayType(place), T.ArrayType(place))
    arrow = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64())]))

    def make(texts: pa.Array) -> list[pa.Array]:
        n, base, found = scanner.scan(texts)
        return [pa.array(n, pa.int64()), pa.array(base, arrow), pa.array(found, arrow)]

    return add_columns(docs, text, keep, [T.StructField(x, k) for x, k in zip(names.values(), kinds)], make), names


def labels_of(*places: Column) -> Column:
    """Distinct labels, sorted and comma-joined."""
    labels = F.array_sort(F.array_distinct(F.transform(F.concat(*places), lambda m: m["label"])))
    return F.array_join(labels, ",")


def covered_share(n_words: Column, *places: Column) -> Column:
    """The share of the words that lie in any place."""
    runs = F.array_sort(F.transform(F.concat(*places), lambda m: F.struct(m["first"].alias("first"), m["stop"].alias("stop"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate(
        runs, start,
        lambda a, m: F.struct(
            (a["n"] + F.greatest(m["stop"] - F.greatest(m["first"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], m["stop"]).alias("end")
        ),
        lambda a: a["n"],
    )
    return F.when(n_words > 0, total / n_words).otherwise(F.lit(0.0))
