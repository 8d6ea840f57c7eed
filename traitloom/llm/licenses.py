"""License scans by patience alignment.

A notice is looked for where its rarer words stand at the right distances. There, words
that occur once in the notice and once in the text are anchors; the longest increasing
run of anchors is kept and what lies between them is aligned in the same way. The share
of the notice's words that got aligned is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from traitloom.llm.common import map_rows, typed

WORDS = re.compile(r"[^\W_]+")

# Notices as their publishers word them (fixed values); a caller may give others.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the Software.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: Redistributions of source code must retain the above copyright"
        " notice, this list of conditions and the following disclaimer.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation; version 2 of the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the License,"
        " or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
        " was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "all-rights-reserved": ("All rights reserved.",),
}


@dataclass(frozen=True)
class Limits:
    coverage: float = 0.8  # of the notice's words
    density: float = 0.75  # of the words of the text between the first and the last aligned one


def rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing run, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for at, place in enumerate(places):
        pile = bisect_left(tops, place)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(place)
            piles.append(at)
        else:
            tops[pile], piles[pile] = place, at
    run, at = [], piles[-1] if piles else -1
    while at >= 0:
        run.append(at)
        at = before[at]
    return run[::-1]


def align(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned words, both rising.

    Gaps wait on a list instead of a call stack, so that long texts need no depth.
    """
    pairs = []
    gaps = [(0, len(left), 0, len(right))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and left[a] == right[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(left[a:b]), Counter(right[c:d])
        at = {word: j for j, word in enumerate(right[c:d], c) if theirs[word] == 1}
        anchors = [(i, at[word]) for i, word in enumerate(left[a:b], a) if ours[word] == 1 and word in at]
        chosen = [anchors[k] for k in rising([j for _, j in anchors])]
        if not chosen:
            continue
        pairs += chosen
        edges = [(a - 1, c - 1), *chosen, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(pairs)


def beginnings(notice: list[str], at: dict[str, list[int]], limits: Limits) -> list[int]:
    """Places, in order, at which the notice can begin.

    More words than a match may lack are seeds, the rarest in the text first, so that every
    match has one of them; where a seed stands says where the notice would begin.
    """
    lacking = len(notice) - int(-(-limits.coverage * len(notice) // 1))
    order = sorted(range(len(notice)), key=lambda i: (len(at.get(notice[i], ())), i))
    return sorted({place - i for i in order[: lacking + 1] for place in at.get(notice[i], ())})


def aligned(notice: list[str], words: list[str], a: int, b: int, limits: Limits) -> tuple[int, int, int] | None:
    """(first, last, aligned words) of a match within words[a:b]."""
    pairs = align(notice, words[a:b])
    if not pairs:
        return None
    first, last = a + pairs[0][1], a + pairs[-1][1]
    near = len(pairs) >= limits.density * (last - first + 1)
    return (first, last, len(pairs)) if near and len(pairs) >= limits.coverage * len(notice) else None


def matches_of(notice: list[str], words: list[str], begins: list[int], limits: Limits) -> list[tuple[int, int, int]]:
    """Matches (first, last, aligned words) from left to right, each looked for where it would begin.

    Where copies follow each other no word is unique in a wide window, so each window is hardly
    longer than the notice and starts after the match before it.
    """
    many, slack, least = Counter(notice), len(notice) // 5 + 1, limits.coverage * len(notice)
    found, free = [], 0
    for begin in begins:
        wide, start = max(free, begin - slack), max(free, begin)
        stop = min(len(words), begin + len(notice) + slack)
        if stop - wide < least or (Counter(words[wide:stop]) & many).total() < least:
            continue
        # the place itself, then with room for words that were put in or left out
        tries = [(start, min(stop, start + len(notice))), (start, stop), (wide, stop)]
        tried = [match for a, b in tries if (match := aligned(notice, words, a, b, limits))]
        if tried:
            found.append(max(tried, key=lambda match: (match[2], match[0] - match[1])))
            free = found[-1][1] + 1
    return found


def scan(text: str | None, notices: list[tuple[str, list[str]]], limits: Limits) -> list[dict]:
    """The matches of one text in their order; of matches that overlap the best stays."""
    lower = (text or "").lower()
    present = set(WORDS.findall(lower))
    likely = [
        (name, notice) for name, notice in notices
        if sum(word in present for word in notice) >= limits.coverage * len(notice)
    ]
    if not likely:
        return []
    # offsets are those of the text itself: some letters change their number when lower-cased
    places = [(match.start(), match.end(), match.group().lower()) for match in WORDS.finditer(text)]
    words = [word for _, _, word in places]
    asked = {word for _, notice in likely for word in notice}
    at: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        if word in asked:
            at.setdefault(word, []).append(i)
    found = []
    for name, notice in likely:
        for first, last, many in matches_of(notice, words, beginnings(notice, at, limits), limits):
            found.append((-many * many / len(notice), first, last, name, many / len(notice)))
    kept: list[tuple[int, int, str, float]] = []
    for _, *match in sorted(found):
        spot = bisect_left(kept, tuple(match))
        if (not spot or kept[spot - 1][1] < match[0]) and (spot == len(kept) or match[1] < kept[spot][0]):
            kept.insert(spot, tuple(match))
    return [
        {"license": name, "start": places[first][0], "end": places[last][1], "coverage": coverage}
        for first, last, name, coverage in kept
    ]


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, limits: Limits = Limits()) -> DataFrame:
    """One row per document: doc_id and matches, an array of (license, start, end, coverage) in text order.

    Offsets are code points, end exclusive. Null and empty texts have no matches; rows that
    repeat are scanned each. Other columns are neither read nor returned.
    """
    notices = [(name, WORDS.findall(text.lower())) for name, texts in templates.items() for text in texts]
    notices = [(name, words) for name, words in notices if words]

    def scanned(batch: pa.RecordBatch) -> dict[str, list]:
        return {
            "doc_id": batch["doc_id"],
            "matches": [scan(text, notices, limits) for text in batch["text"].to_pylist()],
        }

    return map_rows(
        typed(docs, doc_id="bigint", text="string"),
        scanned,
        "doc_id bigint, matches array<struct<license:string,start:bigint,end:bigint,coverage:double>>",
    )
