"""Licence texts found with templates that mark optional and replaceable wording.

A template is plain wording with two kinds of markup: ``[...]`` may be left out, and ``{n}`` stands
for up to n words of any kind (names, years). It is compiled to an automaton over words; states are
made as texts need them. A text is accepted where the wording outside the markup stands exactly and in
order. The base phrases are templates without markup, so one pass finds both.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public licence notices and texts as templates.
TEMPLATES = {
    "gpl-3.0": "licensed under [the terms of] the gnu general public license [as published by the free software foundation] [either] version 3",
    "gpl-2.0": "licensed under [the terms of] the gnu general public license [as published by the free software foundation] [either] version 2",
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-4.0": "licensed under [a] [creative commons] [attribution] cc by [{3}] 4 0",
    "cc-by-nc-4.0": "licensed under [a] cc by nc 4 0",
    "mit-notice": "[{4}] released under the [terms of the] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "all-rights-reserved": "all rights reserved",
    "gpl-3.0-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [either] version 3",
    "gpl-2.0-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation [either] version 2",
    "lgpl-3.0-notice": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [either] version 3",
    "lgpl-2.1-notice": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation [either] version 2 1",
    "agpl-3.0-notice": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation [either] version 3",
    "gnu-no-warranty": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose [see the gnu [lesser] [affero] general public license for more details]",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {1} mozilla org mpl 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {2} apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "mit-license-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall [the] {6} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify [and or] [and] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-3-clause": "neither the name of [the] {8} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0-notice": "to the extent possible under law {8} has waived all copyright and related or neighboring rights to {8}",
}
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
ANY = object()


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return WORD.findall(text.lower()) if text else []


class Automaton:
    """All templates as one automaton over words."""

    def __init__(self, templates: dict[str, str]):
        self.arcs: list[list[tuple[object, int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, str] = {}
        self.start = self._state()
        for label, template in templates.items():
            parts = re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template)
            end = self._chain(parts, self.start)
            self.accepts[end] = label
        self.moves: dict[frozenset, dict[bytes, frozenset]] = {}
        self.begin = self._closed({self.start})
        self.dead = frozenset()
        self.firsts = {w for s in self.begin for w, _ in self.arcs[s] if w is not ANY}

    def _state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _chain(self, parts: list[str], at: int) -> int:
        """Adds the parts after a state; markup that may be left out gets a free way round it."""
        opened: list[int] = []
        for part in parts:
            if part == "[":
                opened.append(at)
                at = self._next(at)
            elif part == "]":
                end = self._state()
                self.free[at].append(end)
                self.free[opened.pop()].append(end)
                at = end
            elif part[0] == "{":
                end = self._state()
                for _ in range(int(part[1:-1])):
                    self.free[at].append(end)
                    after = self._state()
                    self.arcs[at].append((ANY, after))
                    at = after
                self.free[at].append(end)
                at = end
            else:
                after = self._state()
                self.arcs[at].append((part.encode(), after))
                at = after
        return at

    def _next(self, at: int) -> int:
        after = self._state()
        self.free[at].append(after)
        return after

    def _closed(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for state in self.free[todo.pop()]:
                if state not in seen:
                    seen.add(state)
                    todo.append(state)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        known = self.moves.setdefault(states, {})
        if word not in known:
            new = self._closed({t for s in states for w, t in self.arcs[s] if w is ANY or w == word})
            if len(known) > 10_000:
                known.clear()
            known[word] = new
        return known[word]

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, str]]:
        """``(first word, end, label)`` of every place where a template is accepted, the shortest way."""
        firsts = self.firsts
        for at in [i for i, w in enumerate(words) if w in firsts]:
            states, stop, found = self.begin, at, set()
            while stop < len(words) and (states := self.step(states, words[stop])):
                stop += 1
                for state in states:
                    if state in self.accepts and self.accepts[state] not in found:
                        found.add(self.accepts[state])
                        yield at, stop, self.accepts[state]


@lru_cache(4)
def automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(dict(templates))


def _anchored(templates: dict[str, str]) -> dict[str, str]:
    """Without markup in front: it changes where a match begins, not whether there is one."""
    return {label: re.sub(r"^(\s*\[[^\[\]]*\])+\s*", "", t) for label, t in templates.items()}


def scan(
    documents: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row.

    An empty table gives no rows; a very long text is one task's row and read whole.
    ``n_base`` counts all places of base phrases, overlapping ones too; ``first_word`` and
    ``last_word`` are their least and greatest start. ``score`` is 1 where a template is accepted,
    0.5 where only a base phrase stands, else 0. A null text is empty; repeated rows stay repeated;
    other columns are ignored.
    """
    base = {f"base {i}": p for i, p in enumerate(phrases)}
    names = dict(zip(base, phrases.values()))
    rules = tuple((base | _anchored(templates)).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(rules)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                found = list(own.matches(words))
                places = [at for at, _, label in found if label in names]
                labels = {names[label] for _, _, label in found if label in names}
                more = {label for _, _, label in found if label not in names}
                out.append((
                    len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if more else 0.5 if labels else 0.0,
                ))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *columns])

    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kind = documents.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col})


def sql() -> str:
    """The same in DuckDB's SQL: phrases by places of words, templates as patterns over the joined words."""

    def pattern(template: str) -> str:
        out = ""
        for part in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
            out += {"[": "(", "]": ")?"}.get(part) or (f"([^ ]+ ){{0,{part[1:-1]}}}" if part[0] == "{" else f"{part} ")
        return out

    tests = ", ".join(
        f"CASE WHEN regexp_matches(line, ' {pattern(t)}') THEN '{label}' END" for label, t in sorted(_anchored(TEMPLATES).items())
    )
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i FROM (SELECT doc_id, words, unnest(range(1, len(words) - {len(p.split()) - 2}))"
        f" AS i FROM w WHERE contains(line, ' {p} ')) WHERE words[i:i + {len(p.split()) - 1}] = {p.split()!r}"
        for p, label in PHRASES.items()
    )
    return rf"""
WITH w AS (
  SELECT doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)
), p AS ({places}), b AS (
  SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS found
  FROM p GROUP BY doc_id
), t AS (SELECT doc_id, list_filter([{tests}], lambda x: x IS NOT NULL) AS more FROM w)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_concat(coalesce(found, []), more)), ','), '') AS labels,
       CASE WHEN len(more) > 0 THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM w JOIN t USING (doc_id) LEFT JOIN b USING (doc_id)
"""
