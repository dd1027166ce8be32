"""Licence scans: windows of words against licence templates by Dice over word bigrams.

A window is any run of words of a normalised text, over line breaks too. A template is only compared with texts that
hold enough of its bigrams at all, which an inverted index of bigrams tells in one pass over the words, and there
only with windows that begin and end with a bigram of the template (others score less) and whose size can reach the
threshold. The words that tell licences apart, names and versions, must be the same in the window and the template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import records, small_batches

THRESHOLD = 0.8

# fixed values: parts of licence texts
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so"
)
_MIT_TERMS = (
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TERMS = "provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_GNU = (
    ("GPL", "General Public License", "2.0"), ("GPL", "General Public License", "3.0"),
    ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3.0"),
    ("AGPL", "Affero General Public License", "3.0"),
)
_GNU_DATES = ("June 1991", "29 June 2007", "February 1999", "29 June 2007", "19 November 2007")
_VERBS = ("Released under", "Licensed under", "Distributed under", "Available under", "This work is licensed under")
# what stands after such a verb, by SPDX name
_TITLES = {
    "MIT": ("the MIT License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    **{f"{short}-{version}-only": (f"the GNU {title}, version {version}", f"the GNU {title} v{version}") for short, title, version in _GNU},
    **{
        f"{short}-{version}-or-later": (
            f"the GNU {title}, version {version} or later",
            f"the GNU {title}, version {version}, or (at your option) any later version",
        )
        for short, title, version in _GNU
    },
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "ISC": ("the ISC License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "EPL-2.0": ("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0",),
    **{
        f"CC-{short}-4.0": (f"CC {short} 4.0", f"a Creative Commons {title} 4.0 International License")
        for short, title in {
            "BY": "Attribution",
            "BY-SA": "Attribution-ShareAlike",
            "BY-NC": "Attribution-NonCommercial",
            "BY-ND": "Attribution-NoDerivatives",
            "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
            "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
}

# fixed values: licence notices as they are commonly given, by SPDX name
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", f"{_MIT_GRANT} {_MIT_TERMS} {_MIT_WARRANTY}"),
    ("MIT-0", _MIT_GRANT),
    ("MIT-0", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, {_ISC_TERMS}"),
    ("ISC", f"{_ISC_GRANT}, {_ISC_TERMS} {_ISC_WARRANTY}"),
    ("0BSD", _ISC_GRANT),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_WARRANTY}"),
    *[
        (
            f"{short}-{version}-or-later",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            f"{title} as published by the Free Software Foundation, either version {version} of the License, or (at "
            "your option) any later version.",
        )
        for short, title, version in _GNU
    ],
    # the long texts by their heads
    *[(f"{short}-{version}-only", f"GNU {title} Version {version}, {date}") for (short, title, version), date in zip(_GNU, _GNU_DATES, strict=True)],
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *[(name, f"{verb} {title}.") for name, titles in _TITLES.items() for title in titles for verb in _VERBS],
    *[(name, f"SPDX-License-Identifier: {name}") for name in _TITLES],
)

# fixed values: words that tell licences apart
DISTINGUISHING = frozenset(
    "mit apache gnu gpl lgpl agpl lesser library affero mozilla mpl bsd isc eclipse epl boost bsl cc cc0 nc sa nd noncommercial "
    "sharealike noderivatives noderivs unlicense later endorse clause".split()
)
_VERSION = re.compile(r"v?([0-9]{1,2}(?:\.[0-9]+)*)")
#: So many words after a notice of one version may still widen it to later ones.
_LATER_WITHIN = 6

_WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")


def words(text: str) -> list[str]:
    """Lower-case words of letters, digits and inner points; all else only separates. ``2.0`` is the word ``2``."""
    return [w[:-2] if w[-2:] == ".0" else w for w in _WORD.findall(text.lower())]


def bigrams(found: list[str]) -> Counter:
    return Counter(zip(found, found[1:], strict=False))


def distinguishing(word: str) -> str | None:
    """The word as it is compared, if it tells licences apart: a name, or a version without a ``v``."""
    if word in DISTINGUISHING:
        return word
    version = _VERSION.fullmatch(word)
    return version[1] if version else None


class Cover:
    """Runs of words that share none."""

    def __init__(self):
        self.firsts: list[int] = []
        self.lasts: list[int] = []

    def add(self, first: int, last: int) -> bool:
        """Take a run in unless it shares a word with one that is in."""
        k = bisect_left(self.lasts, first)
        if k < len(self.firsts) and self.firsts[k] <= last:
            return False
        self.firsts.insert(k, first)
        self.lasts.insert(k, last)
        return True


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        self.bags = [bigrams(words(text)) for _, text in templates]
        self.sizes = [sum(bag.values()) for bag in self.bags]
        self.marks = [{m for w in words(text) if (m := distinguishing(w))} for _, text in templates]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, bag in enumerate(self.bags):
            for pair in bag:
                self.holders.setdefault(pair, []).append(i)

    def matches(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, first line, last line, Dice): windows that share no word, those with more of a template first."""
        if not text:
            return []
        found_words, rows = [], []
        for row, line in enumerate(text.split("\n")):
            line = words(line)
            found_words += line
            rows += [row] * len(line)
        places = defaultdict(list)
        for at, pair in enumerate(zip(found_words, found_words[1:], strict=False)):
            if pair in self.holders:
                places[pair].append(at)
        shared = Counter()
        for pair, ats in places.items():
            for i in self.holders[pair]:
                shared[i] += min(len(ats), self.bags[i][pair])
        # a window that reaches the threshold shares this much of the template at least
        able = [i for i, n in shared.items() if n >= self._least(i)]
        if not able:
            return []
        marks = [(at, m) for at, w in enumerate(found_words) if (m := distinguishing(w))]
        held = {m for _, m in marks}
        able = [i for i in able if self.marks[i] <= held]
        found = [(n, score, i, a, b) for i in able for score, n, a, b in self._windows(i, places, marks)]
        kept: list[tuple[str, int, int, float, int]] = []
        cover = Cover()
        for _, score, i, a, b in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            if cover.add(a, b):
                name = self.names[i]
                if name.endswith("-only") and "later" in found_words[b + 1 : b + 1 + _LATER_WITHIN]:
                    name = name.removesuffix("only") + "or-later"
                kept.append((name, rows[a], rows[b], score, a))
        return [k[:4] for k in sorted(kept, key=lambda k: k[4])]

    def _least(self, i: int) -> float:
        return max(1, self.sizes[i] * self.threshold / (2 - self.threshold) - 1e-9)

    def _windows(
        self, i: int, places: dict[tuple[str, str], list[int]], marks: list[tuple[int, str]]
    ) -> list[tuple[float, int, int, int]]:
        """(Dice, shared bigrams, first word, last word): the best windows of one template that share no word."""
        bag, size, least = self.bags[i], self.sizes[i], self._least(i)
        most = size * (2 - self.threshold) / self.threshold + 1e-9
        at = sorted((p, pair) for pair in bag if pair in places for p in places[pair])
        marked = [p for p, _ in marks]
        found = []
        last = 0
        for j, (start, _) in enumerate(at):
            last = max(last, j)
            while last < len(at) and at[last][0] - start < most:
                last += 1
            if last - j < least:
                continue
            count, n, best = Counter(), 0, None
            for stop, pair in at[j:last]:
                count[pair] += 1
                n += count[pair] <= bag[pair]
                score = 2 * n / (stop - start + 1 + size)
                if n >= least and score >= self.threshold and (best is None or score > best[0]):
                    inside = {m for _, m in marks[bisect_left(marked, start) : bisect_left(marked, stop + 2)]}
                    if inside == self.marks[i]:
                        best = (score, n, start, stop + 1)
            if best:
                found.append(best)
        kept: list[tuple[float, int, int, int]] = []
        cover = Cover()
        for window in sorted(found, key=lambda f: (-f[0], f[2])):
            if cover.add(window[2], window[3]):
                kept.append(window)
        return kept


def license_scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, license, first_line, last_line, dice``: one row per notice found, lines counted from 0.

    Texts without a notice, NULL and empty ones included, give no row; rows without an id are reported with NULL;
    repeated rows are reported each.
    """
    index = Templates(templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
        for batch in records(batches):
            rows = [
                (key, *match)
                for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                for match in index.matches(text)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "license", "first_line", "last_line", "dice"],
            )

    return small_batches(docs).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, license string, first_line long, last_line long, dice double")
