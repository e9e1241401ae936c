"""Operator 4, license scans.

Overlapping windows of each text, as long as a template plus a stride, are MinHashed; a window and a template that agree in
all rows of some band are candidates, and the template's exact shingle containment in the window decides. Strides are an
eighth of the template, so a window around a copy that holds 0.8 of the template's shingles has a Jaccard similarity of at
least ``LEAST_JACCARD``; the number of bands follows from the collision probability that is asked for (``bands_for``).
Texts of different licenses that share most shingles (versions, families, clauses) are told apart by phrases that the window
must hold or must not; a notice that cites a license by name (``<license>-notice``) must stand there whole. A template of fewer than five words, such as an SPDX line, is one shingle of all its words.

A license may have several templates; the best window of any counts. Only windows that share a shingle with a template can
collide with it, so only those are hashed. A narrow map; the templates are a fixed list (or the caller's), some kilobytes.

Null or empty text: no license. Of windows of equal containment the first one is told. Repeated rows are each scanned; null
doc_ids are carried; further columns don't matter. A text of any length is scanned whole. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Shingled, map_texts, mixed, whole_texts

SHINGLE = 5
CONTAINMENT = 0.8
LEAST_JACCARD = 0.5
ROWS = 2
COLLISION = 0.9999

# Notices and opening passages of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


# Further notices and opening passages; GNU licenses name themselves and their version.
_GNU = (
    "This {kind} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version. This {kind} is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
)
_GNU_BODY = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
MORE = {
    "MIT": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Unlicense": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "GPL-2.0-or-later": _GNU.format(kind="program", name="GNU General Public License", version="2"),
    "LGPL-2.1-or-later": _GNU.format(kind="library", name="GNU Lesser General Public License", version="2.1"),
    "LGPL-3.0-or-later": _GNU.format(kind="program", name="GNU Lesser General Public License", version="3"),
    "AGPL-3.0-or-later": _GNU.format(kind="program", name="GNU Affero General Public License", version="3"),
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _GNU_BODY,
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU_BODY,
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. " + _GNU_BODY,
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU_BODY,
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GNU_BODY,
}
# Names under which notices cite a license.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "CC0-1.0": ("CC0 1.0 Universal license",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0 license"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0 license"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
}
_FORMS = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "Under the terms of the {}")
#: Phrases that a window must hold, and must not, for a license to be told from its kin.
MUST = {
    "GPL-2.0-or-later": ("GNU General Public License", "version 2"), "GPL-3.0-or-later": ("GNU General Public License", "version 3"), "LGPL-2.1-or-later": ("Lesser General Public License", "version 2.1"),
    "LGPL-3.0-or-later": ("Lesser General Public License", "version 3"), "AGPL-3.0-or-later": ("Affero General Public License", "version 3"), "GPL-2.0": ("GNU General Public License", "Version 2"),
    "GPL-3.0": ("GNU General Public License", "Version 3"), "LGPL-2.1": ("Lesser General Public License", "Version 2.1"), "LGPL-3.0": ("Lesser General Public License", "Version 3"),
    "AGPL-3.0": ("Affero General Public License", "Version 3"), "BSD-3-Clause": ("Neither the name",),
}
MUST_NOT = {"BSD-2-Clause": ("Neither the name",)}


def default_templates() -> dict[str, tuple[str, ...]]:
    """Every license's texts: passages, notices by name (as ``<license>-notice``) and SPDX lines."""
    out: dict[str, tuple[str, ...]] = {}
    for texts in (TEMPLATES, MORE):
        for name, text in texts.items():
            out[name] = (*out.get(name, ()), text)
    for name, cited in NAMES.items():
        notice = f"{name}-notice"
        out[notice] = (*out.get(notice, ()), *(f.format(x) for x in cited for f in _FORMS), *(f"SPDX-License-Identifier: {name}{x}" for x in (("", "-only", "-or-later") if "GPL" in name else ("",))))
    return out


def bands_for(jaccard: float, rows: int, probability: float) -> int:
    """Bands with which two sets of that similarity agree in some band with at least that probability."""
    return math.ceil(math.log(1 - probability) / math.log(1 - jaccard**rows))


def _phrase(text: str) -> np.ndarray:
    return Shingled([text], 1).word_hashes


@dataclass
class Group:
    """Templates of one shingle size: which license each is of, its set of shingles, the least containment, and phrases by word hashes."""

    size: int
    licenses: list[int] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    least: list[float] = field(default_factory=list)
    must: list[list[np.ndarray]] = field(default_factory=list)
    must_not: list[list[np.ndarray]] = field(default_factory=list)


class Templates:
    def __init__(self, templates: Mapping[str, str | Sequence[str]], containment: float = CONTAINMENT, must: Mapping = MUST, must_not: Mapping = MUST_NOT):
        self.names = list(templates)
        self.bands = bands_for(LEAST_JACCARD, ROWS, COLLISION)
        self.seeds = mixed(np.arange(1, self.bands * ROWS + 1, dtype=np.uint64))
        groups: dict[int, Group] = {}
        for k, (name, texts) in enumerate(templates.items()):
            for text in dict.fromkeys([texts] if isinstance(texts, str) else texts):
                n = len(_phrase(text))
                if n:
                    g = groups.setdefault(min(n, SHINGLE), Group(min(n, SHINGLE)))
                    g.licenses.append(k)
                    g.least.append(1.0 if name.endswith("-notice") else containment)
                    g.sets.append(np.unique(Shingled([text], g.size).of_text(0)))
                    g.must.append([_phrase(x) for x in must.get(name, ())])
                    g.must_not.append([_phrase(x) for x in must_not.get(name, ())])
        self.groups = []
        for g in groups.values():
            all_ = np.unique(np.concatenate(g.sets))
            lengths = {int(s): {len(x) for x in g.sets if s in x} for s in all_}
            self.groups.append((g, all_, lengths, np.array([self.band_keys(x) for x in g.sets]), np.array([len(x) for x in g.sets])))

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        """MinHash values, a key for each band."""
        least = mixed(hashes[None, :] ^ self.seeds[:, None]).min(axis=1).reshape(self.bands, ROWS)
        return mixed(least[:, 0] + np.uint64(3) * mixed(least[:, 1]))

    def found(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, license, first word, words, containment): the best window of each text and license."""
        best: dict[tuple[int, int], tuple] = {}
        for g, all_, lengths, keys, sizes in self.groups:
            got = Shingled(texts, g.size)
            at, text = got.hits(all_)
            for t in np.unique(text).tolist():
                begin, end = int(got.words.first[t]), int(got.words.first[t + 1]) - g.size + 1
                windows = set()
                for p in at[text == t].tolist():
                    for n in lengths[int(got.hashes[p])]:
                        # Windows begin at multiples of the stride; all that hold the shingle. One shingle: itself.
                        stride = max(1, n // 8)
                        wide = n + stride if n > 1 else 1
                        first = max(0, -(-(p - begin - wide + 1) // stride))
                        windows.update((begin + s * stride, wide, n) for s in range(first, (p - begin) // stride + 1))
                for start, wide, n in sorted(windows):
                    own = np.unique(got.hashes[start : min(start + wide, end)])
                    for k in np.flatnonzero((keys == self.band_keys(own)).any(axis=1) & (sizes == n)).tolist():
                        share = float(np.isin(g.sets[k], own, assume_unique=True).mean())
                        words = min(wide, end - start) + g.size - 1
                        one = (-share, start - begin, words)
                        key = t, g.licenses[k]
                        if share >= g.least[k] - 1e-12 and (key not in best or one < best[key]) and self._told(got, g, k, start, words):
                            best[key] = one
        for t, k in sorted(best):
            share, first, words = best[t, k]
            yield t, k, first, words, -share

    @staticmethod
    def _told(got: Shingled, g: Group, k: int, start: int, words: int) -> bool:
        """Whether the window's words hold every phrase that they must, and none that they must not."""
        own = got.word_hashes[start : start + words]

        def has(phrase: np.ndarray) -> bool:
            return len(own) >= len(phrase) and bool((np.lib.stride_tricks.sliding_window_view(own, len(phrase)) == phrase).all(axis=1).any())

        return all(map(has, g.must[k])) and not any(map(has, g.must_not[k]))


SCHEMA = "doc_id bigint, license string, first_word bigint, n_words bigint, containment double"


def scan_licenses(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each document and license that it holds, with the best window."""
    templates = default_templates() if templates is None else templates

    def make():
        known = Templates(templates, containment)

        def work(part: pa.RecordBatch) -> list:
            rows = list(known.found(whole_texts(part.column("text"))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            t = pa.array(columns[0], pa.int64())
            return [part.column("doc_id").take(t), pa.array([known.names[k] for k in columns[1]], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:4]), pa.array(columns[4], pa.float64())]

        return work

    return map_texts(docs, SCHEMA, make)
