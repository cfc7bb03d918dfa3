"""License scans by conditional compression.

Lines around a cue word are candidate blocks. Each is compressed on its own
and with each license template as a zstandard raw dictionary; templates are
ranked by the bytes they save. The winners are confirmed in order by exact
wording: the block's and the template's words are aligned, digits counting as
one placeholder, and a template is confirmed when nearly all its words stand
in the block in their order with nearly none between. The first confirmed
winner names its words' span; the rest of the block is searched on.

A block is the line of a cue, or of a long line the neighbourhood of the cue;
if it is no license, the lines around it are tried as one block, which finds
wrapped notices. Offsets are code points, ends exclusive. Null and empty texts hold no
license. Repeated rows are judged one by one; ties in saved bytes go to the
template listed first.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from marginlens.llm.common import map_batches

# Public license notices (fixed values): (name, wording).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
)
CUES = ("licens", "licenc", "permission", "redistribut", "public domain", "copyright")
# A word that makes another license of the same wording.
QUALIFIERS = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike lesser affero".split())
_CUE = re.compile("|".join(CUES), re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    name: str
    saved: int
    missing: int
    extra: int


def wording(text: str) -> list[str]:
    return ["#" if w.isdigit() else w for w in _WORD.findall(text.lower())]


class Scanner:
    def __init__(self, templates=TEMPLATES, share: float = 0.9):
        self.names = [n for n, _ in templates]
        self.words = [wording(t) for _, t in templates]
        self.share = share
        params = zstandard.ZstdCompressionParameters.from_level(12, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.primed = [
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=raw), compression_params=params)
            for _, t in templates
        ]

    def rank(self, block: str) -> list[tuple[int, int]]:
        """(saved bytes, template), the most saved first; those that save nothing are left out."""
        data = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        gains = [(alone - len(p.compress(data)), i) for i, p in enumerate(self.primed)]
        return sorted((g for g in gains if g[0] > 0), key=lambda g: (-g[0], g[1]))

    def confirm(self, block: list[str], template: list[str]) -> tuple[int, int, int, int] | None:
        """(first word, end, template words missing, words between them that
        aren't the template's), or None if too much differs."""
        most = int(len(template) * (1 - self.share) + 1e-9)
        if (Counter(template) & Counter(block)).total() < len(template) - most:
            return None
        # Words far from the longest common run are not this notice's.
        run = SequenceMatcher(None, template, block, autojunk=False).find_longest_match()
        low = max(0, run.b - run.a - most)
        near = block[low : run.b - run.a + len(template) + most]
        same = [m for m in SequenceMatcher(None, template, near, autojunk=False).get_matching_blocks() if m.size]
        held = sum(m.size for m in same)
        start, end = same[0].b, same[-1].b + same[-1].size
        missing, extra = len(template) - held, end - start - held
        if missing > most or extra > most:
            return None
        if (Counter(template) - Counter(near[start:end]) + (Counter(near[start:end]) - Counter(template))).keys() & QUALIFIERS:
            return None
        return low + start, low + end, missing, extra

    def block(self, text: str, start: int, end: int) -> list[Found]:
        """The notices between two places, each with its words' own span: the
        first confirmed winner, then those before and behind it."""
        out, parts = [], [(start, end)]
        while parts:
            left, right = parts.pop()
            if not _CUE.search(text, left, right):
                continue
            at = [m.span() for m in _WORD.finditer(text, left, right)]
            words = ["#" if (w := text[i:j].lower()).isdigit() else w for i, j in at]
            for gain, i in self.rank(text[left:right]):
                if (got := self.confirm(words, self.words[i])) is not None:
                    first, last = at[got[0]][0], at[got[1] - 1][1]
                    out.append(Found(first, last, self.names[i], gain, *got[2:]))
                    parts += [(left, first), (last, right)]
                    break
        return out

    def text(self, text: str | None, reach: int = 400) -> Iterator[Found]:
        """The licenses of a text. Each cue outside the notices found so far is
        tried in its line, or the part of it within ``reach``, then with the
        lines around it within ``reach``, up to the notices beside it."""
        low = (text or "").lower()
        if not any(cue in low for cue in CUES):
            return
        taken: list[Found] = []
        for m in _CUE.finditer(text):
            i = bisect(taken, m.start(), key=lambda f: f.start)
            if i and m.start() < taken[i - 1].end:
                continue
            left = max(m.start() - reach, taken[i - 1].end if i else 0, 0)
            right = min(m.end() + reach, taken[i].start if i < len(taken) else len(text))
            line = text.rfind("\n", left, m.start()) + 1 or left, text.find("\n", m.end(), right)
            line = line[0], right if line[1] < 0 else line[1]
            found = self.block(text, *line)
            if not any(f.start <= m.start() < f.end for f in found) and (left, right) != line:
                # The notice may be wrapped: also between those found in the line.
                before = max([left, *(f.end for f in found if f.end <= m.start())])
                behind = min([right, *(f.start for f in found if f.start > m.start())])
                found += self.block(text, before, behind)
            taken = sorted([*taken, *found], key=lambda f: f.start) if found else taken
        yield from taken


def licenses(docs: DataFrame, templates=TEMPLATES, share: float = 0.9) -> DataFrame:
    """(doc_id, start, end, license, saved, missing, extra): one row per
    notice of a confirmed license, over every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        scanner = Scanner(templates, share)
        ids, rows = [], []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for f in scanner.text(text):
                ids.append(i)
                rows.append(f)
        cols = [pa.array(ids, batch.column("doc_id").type)]
        cols += [pa.array([getattr(f, k) for f in rows], pa.int64()) for k in ("start", "end")]
        cols.append(pa.array([f.name for f in rows], pa.string()))
        cols += [pa.array([getattr(f, k) for f in rows], pa.int64()) for k in ("saved", "missing", "extra")]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end", "license", "saved", "missing", "extra"])

    schema = f"doc_id {kind}, start long, end long, license string, saved long, missing long, extra long"
    return map_batches(docs.select("doc_id", "text"), run, schema)
