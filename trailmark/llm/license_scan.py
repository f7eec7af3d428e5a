"""License scan by conditional compression: blocks that speak of licences are compressed with each template as raw
dictionary, templates are ranked by the bytes they save, and confirmed in that order by exact word differences."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import map_texts

_GNU = "is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Wordings of public licences and notices, several for a licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "This program " + _GNU.format(mark=";", kind="", comma=";", version="2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "This program " + _GNU.format(mark=":", kind="", comma=",", version="3")),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "This library " + _GNU.format(mark=";", kind="Lesser ", comma=";", version="2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This program " + _GNU.format(mark=":", kind="Lesser ", comma=",", version="3")),
    ("LGPL-3.0", "This library " + _GNU.format(mark=":", kind="Lesser ", comma=",", version="3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program " + _GNU.format(mark=":", kind="Affero ", comma=",", version="3")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide."),
    ("BSD", _BSD),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD_3),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
#: Endings of short names in identifier lines.
_ENDINGS = ("", "-only", "-or-later")
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}{end}") for name in dict.fromkeys(n for n, _ in TEMPLATES) if name not in ("BSD", "Proprietary") for end in (_ENDINGS if "GPL" in name else ("",))]
#: A line with one of these words may belong to a licence.
TRIGGERS = ("licen", "copyright", "permission", "redistribut", "public domain", "all rights reserved", "free software", "cc by", "creative commons")
#: Lines between two lines of one block at most.
GAP = 3
#: Characters of a block that are compressed at once, and from one such piece to the next. In longer pieces a short template's
#: saving drowns in the changes of the entropy code, which may cost up to NOISE bytes more than it saves.
PIECE, STEP, NOISE = 1024, 512, 16
#: Bytes of a place whose saving can't show.
SHORT = 24

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Words of the longest template: no notice reaches further from its trigger word.
MARGIN = max(len(wording(t)) for _, t in TEMPLATES)


def candidate_blocks(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of runs of lines that hold trigger words, with whole lines of MARGIN words before and
    after them, as a wrapped notice goes on where no trigger is; runs that then overlap are one."""
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    lines, runs, out = text.split("\n"), [], []
    for i, line in enumerate(lines):
        if any(t in line.lower() for t in TRIGGERS):
            if runs and i - runs[-1][1] <= GAP:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    for a, b in runs:
        room = MARGIN
        while a > 0 and room > 0:
            a -= 1
            room -= len(wording(lines[a]))
        room = MARGIN
        while b + 1 < len(lines) and room > 0:
            b += 1
            room -= len(wording(lines[b]))
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b, "\n".join(lines[a : b + 1])) for a, b in out]


@cache
def _compressors(level: int):
    plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
    made = []
    for name, text in TEMPLATES:
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, wording(text), zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_dict_id=False)))
    return plain, made


def ranked_templates(block: str, level: int = 19) -> list[tuple[int, int]]:
    """(bytes saved in the piece of the block where it saves most, template's number), the largest saving first, ties by
    number; templates that cost over NOISE bytes in every piece are left out, as no piece can hold their words."""
    plain, made = _compressors(level)
    low = block.lower()
    pieces = [low[i : i + PIECE].encode() for i in range(0, max(1, len(low) - PIECE + STEP), STEP)]
    alone = [len(plain.compress(p)) for p in pieces]
    saved = [(max(a - len(c.compress(p)) for a, p in zip(alone, pieces, strict=True)), k) for k, (_, _, c) in enumerate(made)]
    return sorted((e for e in saved if e[0] >= -NOISE), key=lambda e: (-e[0], e[1]))


def _needed(word: str) -> bool:
    """A word with a digit or a licence's short mark, which may not be missing."""
    return len(word) <= 3 or any(c.isdigit() for c in word)


#: What a missing word of a template weighs against a strange word inside its place; what rules a place out.
MISSING, NEVER = 4, 1 << 20


@cache
def refused(k: int) -> frozenset[str]:
    """Words that may not be added inside a place of template k: those that templates of other licences with much the same words
    have and it lacks, as "lesser" in the GNU notices or another version's number."""
    name, own = TEMPLATES[k][0], Counter(wording(TEMPLATES[k][1]))
    out: set[str] = set()
    for other, text in TEMPLATES:
        words = Counter(wording(text))
        if other != name and 10 * (own & words).total() >= 6 * min(own.total(), words.total()):
            out |= words.keys() - own.keys()
    return frozenset(out)


def _align(words: list[str], own: list[str], coverage: float, strange: frozenset[str] = frozenset()) -> tuple[int, int, int, list[str], list[str]] | None:
    """(start, end, words repeated, missing, added) of the place that states `own` in order with the least difference, MISSING for
    each word missing and 1 for each added; the first of several. None if that place lacks needed words or more than 1 -
    coverage of all, adds words of `strange`, or adds more words than `own` has.

    Exact, by the table of least differences between beginnings of `own` and stretches of `words` that may start anywhere.
    """
    code = {w: i for i, w in enumerate(dict.fromkeys(own))}
    text = np.array([code.get(w, -1) for w in words])
    adding = np.concatenate([[0], np.cumsum([NEVER if w in strange else 1 for w in words])])
    rows = [np.zeros(len(words) + 1, np.int64)]
    for w in own:
        row = rows[-1] + (NEVER if _needed(w) else MISSING)
        hit = np.flatnonzero(text == code[w])
        row[hit + 1] = np.minimum(row[hit + 1], rows[-1][hit])
        rows.append(np.minimum.accumulate(row - adding) + adding)
    j = end = int(rows[-1].argmin())
    if rows[-1][end] >= NEVER:
        return None
    i, missing, added = len(own), [], []
    while i:
        if j and words[j - 1] == own[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif j and rows[i][j] == rows[i][j - 1] + adding[j] - adding[j - 1]:
            j -= 1
            added.append(words[j])
        else:
            i -= 1
            missing.append(own[i])
    hit = len(own) - len(missing)
    return (j, end, hit, missing[::-1], added[::-1]) if hit >= coverage * len(own) and len(added) <= len(own) else None


def _places(words: list[str], own: list[str], coverage: float, strange: frozenset[str] = frozenset()) -> list[tuple[int, int, int, list[str], list[str]]]:
    """Places where the words state the template, as _align gives them: the least different of a piece, then those before and after
    it. A place has at most twice the template's words. Long texts are searched in pieces that overlap by that much, so
    the time is linear; a place in two pieces comes twice."""
    need, out = Counter(own), []
    todo = [(lo, min(len(words), lo + 8 * len(own))) for lo in range(0, max(1, len(words) - 2 * len(own)), 6 * len(own))]
    while todo:
        lo, hi = todo.pop()
        have = Counter(words[lo:hi])
        if sum(min(n, have[w]) for w, n in need.items()) < coverage * len(own) or any(have[w] < n for w, n in need.items() if _needed(w)):
            continue
        hit = _align(words[lo:hi], own, coverage, strange)
        if hit:
            out.append((lo + hit[0], lo + hit[1], *hit[2:]))
            todo += [(lo, lo + hit[0]), (lo + hit[1], hi)]
    return out


def classify_block(block: str, level: int = 19, coverage: float = 0.9) -> list[tuple[int, int, str, float, float, str, str]]:
    """(first line, last line, license, reduction, coverage, missing, added) of each place where the block is confirmed to
    state a licence; lines count from the block's first.

    The templates are tried by rank of the bytes they save in the block; one that clearly saves none isn't tried. A template is
    confirmed at a place if that repeats at least `coverage` of its words in order, no word with a digit nor
    a licence's short mark is missing, no added word tells of another licence (see refused), and the place gets smaller with the
    template as raw dictionary (places of under SHORT bytes needn't, as a frame's overhead hides the saving). reduction: by what
    share; missing: the template's words that the place lacks; added: the place's words inside it. A licence is
    dropped only where its words overlap those of another confirmed one that repeats more words, missing and added ones
    taken off. Of several licences in one identifier line (MIT OR ...) the first alone is found.
    """
    plain, made = _compressors(level)
    low = block.lower()
    at = [m.span() for m in _WORD.finditer(low)]
    words, found = [low[a:b] for a, b in at], []
    for _, k in ranked_templates(block, level):
        name, own, c = made[k]
        for lo, hi, hit, missing, added in _places(words, own, coverage, refused(k)):
            data = low[at[lo][0] : at[hi - 1][1]].encode()
            alone = len(plain.compress(data))
            gain = (alone - len(c.compress(data))) / alone
            if gain > 0 or len(data) < SHORT:
                found.append((len(missing) + len(added) - hit, -len(own), -gain, lo, hi, name, hit / len(own), " ".join(missing), " ".join(added)))
    kept, cover = [], [[] for _ in words]
    for e in sorted(found):
        over = [f for k in range(e[3], e[4]) for f in cover[k]]
        if any(f[5] == e[5] or f[0] < e[0] for f in over):
            continue
        kept.append(e)
        for k in range(e[3], e[4]):
            cover[k].append(e)
    line = lambda w, end: low.count("\n", 0, at[w][end])
    return sorted((line(e[3], 0), line(e[4] - 1, 1), e[5], round(-e[2], 6), round(e[6], 6), e[7], e[8]) for e in kept)


RESULT = "first_line int, last_line int, license string, reduction double, coverage double, missing string, added string"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 19, coverage: float = 0.9) -> DataFrame:
    """A row for each place where the whole texts state a licence: id, first_line, last_line (from 0), license, reduction
    (share of the place's compressed size that the template saves), coverage, missing, added.

    Null and empty texts and texts without trigger words give no row; repeated rows give repeated rows; other columns
    aren't read. Map-only; only blocks around trigger words are compressed.
    """

    def step(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch | None:
        rows, at = [], []
        for i, text in enumerate(texts.to_pylist()):
            for first, _, block in candidate_blocks(text):
                new = [(first + a, first + b, *hit) for a, b, *hit in classify_block(block, level, coverage)]
                rows += new
                at += [i] * len(new)
        if not rows:
            return None
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *columns], names=["id", "first_line", "last_line", "license", "reduction", "coverage", "missing", "added"])

    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(frame, "text", f"id {docs.schema[id_col].dataType.simpleString()}, {RESULT}", step).withColumnRenamed("id", id_col)
