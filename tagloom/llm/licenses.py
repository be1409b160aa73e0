"""License scans: exact phrases, and short notices found in spite of a few edits.

A notice that differs from its template by at most k edits holds at least one of k + 1 parts of the template as it
is.  These parts are looked for exactly (all at once); around each place the regex library matches the whole template
with at most k errors and gives the span.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagloom.llm.common import only, scan, texts

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices of public licenses by label, as words.
NOTICES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy", "licensed under the mit license", "released under the mit license"),
    "apache-2": ("licensed under the apache license version 2", "you may not use this file except in compliance with the license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification", "licensed under the bsd license"),
    "gpl": ("gnu general public license", "this program is free software you can redistribute it and or modify"),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "mpl-2": ("mozilla public license version 2",),
    "cc-by": ("creative commons attribution",),
    "cc-by-nc": ("creative commons attribution noncommercial", "attribution non commercial"),
    "cc-by-sa": ("creative commons attribution sharealike", "attribution share alike"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license"),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable",),
    "epl": ("eclipse public license",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "cc0": ("creative commons zero", "cc0 1 0 universal"),
    "bsl": ("boost software license version 1 0",),
    "all-rights": ("all rights reserved",),
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12

# Fixed rule: bytes outside words become blanks, A-Z become a-z; bytes from 0x80 on belong to words.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b < 0x61 or 0x7B <= b < 0x80 else b for b in range(256))


def normal_words(text: str) -> list[bytes]:
    """Words of the lower-cased text: runs of letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Matcher:
    """Templates cut into seeds, and their bounded-error patterns."""

    def __init__(self, notices: dict[str, tuple[str, ...]] | None = None, base: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT):
        self.base = [(f" {p} ".encode(), label) for p, label in (BASE if base is None else base).items()]
        self.templates = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for label, wordings in (NOTICES if notices is None else notices).items():
            for wording in wordings:
                edits = len(wording) // chars_per_edit
                pattern = regex.compile(rf"(?b)(?:{regex.escape(wording, literal_spaces=True)}){{e<={edits}}}")
                n, cuts = len(self.templates), [len(wording) * i // (edits + 1) for i in range(edits + 2)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    seeds.setdefault(wording[a:b], []).append((n, a))
                self.templates.append((wording, label, edits, pattern))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        self.search = lru_cache(1 << 14)(self._search)  # notices are repeated more often than not

    def base_places(self, line: bytes) -> list[tuple[int, str]]:
        """(byte offset, label) of each base phrase in words joined by blanks, with a blank at both ends."""
        out = []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = line.find(phrase, at + 1)
        return out

    def fuzzy(self, line: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the template) of what matches a template in ``line``.

        Each seed is searched in a window of its own, little longer than the template; of matches of one template that
        overlap, the one with the fewest edits counts.
        """
        begins: dict[int, set[int]] = {}
        for end, (size, places) in self.seeds.iter(line):
            for n, offset in places:
                begins.setdefault(n, set()).add(end - size + 1 - offset)
        out = []
        for n, starts in begins.items():
            wording, label, edits, _ = self.templates[n]
            found = set()
            for low, high in clusters(sorted(starts), 2 * edits):
                a = max(0, low - edits)
                found.update((e, a + s, a + t) for s, t, e in self.search(n, line[a : max(0, high + len(wording) + edits)]))
            taken: list[tuple[int, int]] = []
            for e, s, t in sorted(found):
                at = bisect(taken, (s, t))
                if (not at or taken[at - 1][1] <= s) and (at == len(taken) or t <= taken[at][0]):
                    taken.insert(at, (s, t))
                    out.append((s, t, label, e, len(wording)))
        return sorted(out)

    def _search(self, n: int, window: str) -> tuple[tuple[int, int, int], ...]:
        """(start, end, edits) of the matches of template n in a short window."""
        return tuple((m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.templates[n][3].finditer(window))


def clusters(starts: list[int], width: int) -> list[tuple[int, int]]:
    """First and last of runs of sorted numbers that lie within ``width`` of their first."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][0] + width:
            out[-1] = (out[-1][0], s)
        else:
            out.append((s, s))
    return out


def inspect(text: str, matcher: Matcher) -> dict:
    """Words, base places and fuzzy notices of one text.

    ``score`` is the closeness of the best notice: 1 for a base phrase or an exact one, else one minus edits per
    character, 0 without any.
    """
    words = normal_words(text)
    line = b" " + b" ".join(words) + b" "
    # the number of a word is the number of blanks before it, less the one in front
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    places = [(int(np.searchsorted(blanks, at)), label) for at, label in matcher.base_places(line)]
    decoded = line.decode("utf-8", "surrogatepass")
    if found := matcher.fuzzy(decoded):
        if not decoded.isascii():
            blanks = np.flatnonzero(np.frombuffer(decoded.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
        first = np.searchsorted(blanks, [a for a, *_ in found], "right") - [decoded[a] != " " for a, *_ in found]
        last = np.searchsorted(blanks, [b for _, b, *_ in found]) - 1
    notices = [{"first_word": int(first[i]), "last_word": int(last[i]), "label": label, "edits": e, "score": 1 - e / n} for i, (_, _, label, e, n) in enumerate(found)]
    score = 1.0 if places else max((x["score"] for x in notices), default=0.0)
    return {"n_words": len(words), "places": sorted(places), "notices": notices, "score": score}


def find_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), notices: dict | None = None, base: dict | None = None, emit: tuple[str, Callable] | None = None) -> DataFrame:
    """Columns ``keep`` with n_words, places (word, label), notices (words, label, edits, score) and score of each row.

    Words count from 0.  Null and empty texts have no words and score 0; rows are looked at one by one, so repeated
    rows stay repeated; other columns are left out.  ``emit`` may turn the result of :func:`inspect` into other columns.
    """
    ddl, make = emit or (
        "n_words long, places array<struct<word:long,label:string>>, notices array<struct<first_word:long,last_word:long,label:string,edits:int,score:double>>, score double",
        lambda x: (x["n_words"], [{"word": w, "label": s} for w, s in x["places"]], x["notices"], x["score"]),
    )
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(ddl).fields])

    def rows(batch: pa.RecordBatch, matcher: Matcher) -> list:
        made = [make(inspect(t, matcher)) for t in texts(batch, text)]
        return [*(batch.column(c) for c in keep), *map(list, zip(*made, strict=True))]

    return scan(only(docs, *dict.fromkeys((*keep, text))), rows, schema, lambda: Matcher(notices, base))


DIGEST_DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def digest(x: dict) -> tuple:
    at, labels = [w for w, _ in x["places"]], {s for _, s in x["places"]}
    return x["n_words"], len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {n["label"] for n in x["notices"]})), x["score"]
