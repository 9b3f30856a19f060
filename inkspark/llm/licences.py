"""Licence scan: a trained paragraph classifier, confirmed by templates (operator 8).

Paragraphs are non-blank lines; longer ones are read in windows of WINDOW words that overlap by half, so whole texts
are covered. Features are the word 2- and 3-grams of the templates below and their gate words (sparse, 0 or 1). Gates are the
templates' words that at most COMMON of the corpus's windows have, and of each template its rarest word in any case; their
counts are of the whole corpus. A multinomial logistic regression tells the families and an unknown class. It is
trained, with a fixed seed, on templates with words dropped and ordinary words around them, and on ordinary text: mixed-up
words of the templates, and a bounded sample of windows of the corpus, NEGATIVES at most, picked anywhere in a text by a
hash of the document and the window's number. A temperature fitted on a further set calibrates it; a window whose best
family has less than ``least_probability`` is unknown. A family is confirmed if one of its templates agrees with the
window: shared word pairs over those of the template or, in a window of MINIMUM words or more, over those of the window,
at least ``least_similarity``. Beside a window's best family, any other counts that is likelier than unknown and confirmed
by word pairs which the best one's templates lack: so two licences in one window are both found. Neighbouring windows of a
line with one family are one finding.

A null or empty text has no paragraph and no finding. A window is not looked at further where no family can be likelier than
unknown: with each of its features counted for the family that it speaks most for, which is at least what any one family
has. So nothing is left out, however common its words are in the corpus; gates only choose single words as features. An empty corpus gives a model of the templates alone. Repeated
and null ids, and columns with any names, play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialize

WINDOW, MINIMUM, NEGATIVES, COMMON = 80, 6, 2000, 0.002
#: A longer word of an ordinary window stands as its first characters in the sample, which is so bounded in bytes.
LONG = 40
UNKNOWN = "unknown"
_WORD = re.compile(r"[^\W_]+(?:[.\-+][^\W_]+)*")

# Wording of common licences' notices and of their characteristic paragraphs.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "Artistic-2.0": [
        "This is free software, licensed under the Artistic License 2.0.",
        "This program is free software; you may redistribute it and/or modify it under the terms of the Artistic License.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "BSD": [
        "This software is released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
        "https://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "https://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "https://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "https://creativecommons.org/publicdomain/zero/1.0/",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, Version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "either version 2 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "either version 3 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "OFL-1.1": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ],
    "Proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This document is confidential and proprietary. Unauthorized copying or distribution is strictly prohibited.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
}
# Wording of licences of no family above, for the unknown class.
OTHERS = [
    "Licensed under the Apache License, Version 1.1.", "Licensed under the Apache Software License, Version 1.0.", "Licensed under the EUPL, Version 1.2 only.",
    "Licensed under the European Union Public Licence, Version 1.2", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "Released under the Microsoft Public License.", "This software is released under the Microsoft Reciprocal License.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",
    "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License", "Licensed under the Server Side Public License, version 1.", "Use of this software is governed by the Business Source License 1.1",
    "Licensed under the Elastic License 2.0.", "This software is released under the PostgreSQL License.", "Licensed under the Academic Free License version 3.0", "Licensed under the Open Software License version 3.0",
    "This program is free software. It comes without any warranty. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2", "Licensed under the Python Software Foundation License Version 2.",
    "This program is licensed under the Common Public License Version 1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "Licensed under the Creative Commons Attribution 2.5 Generic License with other terms", "This work is licensed under the GNU General Public License, version 1.", "Licensed under the Universal Permissive License v 1.0", "Licensed under the Open Data Commons Open Database License.",
    "Licensed under the Blue Oak Model License 1.0.0.", "This software is released under the University of Illinois/NCSA Open Source License.",
]
# Words that tell that a text is about rights in a work. Of those of a template half at least must be there.
CORE = frozenset(
    "license licence licenses licensed licensing copyright copyrighted software program library source binary redistribution redistributions redistribute sublicense warranty warranties "
    "merchantability fitness noninfringement unencumbered reserved publication proprietary confidential mpl contributor contributors domain waived cc0 cc by by-nc by-sa".split()
)
# Families of SPDX short identifiers; version suffixes -only, -or-later and + are cut off before.
SPDX = {
    "AGPL-3.0": "AGPL-3.0", "Apache-2.0": "Apache-2.0", "Artistic-2.0": "Artistic-2.0", "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD", "BSL-1.0": "BSL-1.0", "CC-BY-3.0": "CC-BY", "CC-BY-4.0": "CC-BY", "CC-BY-NC-3.0": "CC-BY-NC",
    "CC-BY-NC-4.0": "CC-BY-NC", "CC-BY-SA-3.0": "CC-BY-SA", "CC-BY-SA-4.0": "CC-BY-SA", "CC0-1.0": "CC0", "EPL-2.0": "EPL-2.0", "GPL-2.0": "GPL-2.0", "GPL-3.0": "GPL-3.0", "ISC": "ISC", "LGPL-2.0": "LGPL", "LGPL-2.1": "LGPL",
    "LGPL-3.0": "LGPL", "MIT": "MIT", "MPL-2.0": "MPL-2.0", "OFL-1.1": "OFL-1.1", "Unlicense": "Unlicense", "Zlib": "Zlib",
}
_SPDX = {k.lower(): v for k, v in SPDX.items()}
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- \t]+)", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z0-9.+\-]+")
_NUMBER = re.compile(r"v?(\d{1,2})(?:\.(\d+))?")
# Words that are ordinary in any corpus.
STOP = frozenset("the of and to in a is or with for this any on as by at it an be not all are from has no you may use work part mit".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows_of(words: list) -> Iterator[tuple[int, list]]:
    """(first word, words) of the windows of a line."""
    return ((i, words[i : i + WINDOW]) for i in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2))


def _grams(words: list[str], most: int = 3) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)}


def _versions(words: list[str]) -> set[tuple[str, str]]:
    """Numbers of versions: 2 and v2.0 are one."""
    return {(m[1], (m[2] or "0").rstrip("0") or "0") for w in words if (m := _NUMBER.fullmatch(w))}


def _core(words: Iterable[str]) -> frozenset[str]:
    """The words on rights, each form of a word as its first seven letters."""
    return frozenset("licen" if w.startswith("licen") else w[:7] for w in CORE.intersection(words))


def spdx_families(expression: str) -> list[str]:
    """The families that an SPDX expression names, in order; unknown for identifiers of none. What follows WITH is an exception."""
    out, names = [], _IDENTIFIER.findall(expression)
    while names:
        name = names.pop(0)
        if name.upper() == "WITH":
            names[:1] = []
        elif name.upper() not in ("AND", "OR"):
            family = _SPDX.get(re.sub(r"(?:-only|-or-later|\+)$", "", name.lower()), UNKNOWN)
            out += [family] if family not in out else []
            if not (names and names[0].upper() in ("AND", "OR", "WITH")):
                break  # prose behind the expression
    return out


@dataclass(frozen=True)
class Template:
    """A wording: its units (words and word pairs), and what a window must have to be confirmed by it."""

    units: frozenset[str]
    core: frozenset[str]
    versions: frozenset[tuple[str, str]]

    @staticmethod
    def of(words: list[str]) -> Template:
        return Template(frozenset(_grams(words, 2)), _core(words), frozenset(_versions(words)))

    def fits(self, core: frozenset[str], versions: set[tuple[str, str]]) -> bool:
        """Half of the words on rights are there, and of versions not only others."""
        return 2 * len(self.core & core) >= len(self.core) and not (self.versions and versions and self.versions.isdisjoint(versions))


@dataclass
class Model:
    families: list[str]
    gates: frozenset[str]  #: templates' words that are features by themselves
    features: dict[str, int]
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[Template]]  #: of families, and under UNKNOWN of other licences
    worth: dict[str, float]  #: one over the number of licences whose wording has a unit

    def __post_init__(self) -> None:
        """``gains``: by number of words, what a feature adds at most to any family over unknown; features for none are left out.
        ``need``: what the features of a window that is not unknown add at least. ``pairs``: the first two words of gains."""
        self.gains: tuple[dict, ...] = ({}, {}, {})
        if UNKNOWN in self.families:
            unknown = self.families.index(UNKNOWN)
            over = np.delete(self.weight - self.weight[:, [unknown]], unknown, 1).max(1, initial=0)
            for gram, i in self.features.items():
                words = tuple(gram.split(" "))
                if over[i] > 0:
                    self.gains[len(words) - 1][words if len(words) > 1 else gram] = float(over[i])
            self.need = float(self.bias[unknown] - np.delete(self.bias, unknown).max()) - 1e-3  # room for rounding
        self.pairs = frozenset(self.gains[1]) | {g[:2] for g in self.gains[2]}

    def may_tell(self, words: list[str]) -> bool:
        """False only if unknown is likelier than any family in each window of these words."""
        one, two, three = self.gains
        most = 0.0 if one.keys().isdisjoint(words) else sum(one.get(w, 0.0) for w in words)
        for i, pair in enumerate(zip(words, words[1:])):
            if pair in self.pairs:
                most += two.get(pair, 0.0) + three.get((*pair, *words[i + 2 : i + 3]), 0.0)
        return most >= self.need

    def probabilities(self, grams: set[str]) -> np.ndarray:
        at = [self.features[g] for g in grams if g in self.features]
        z = (self.bias + self.weight[at].sum(0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def _sum(self, units: Iterable[str]) -> float:
        return sum(self.worth.get(u, 1.0) for u in units)

    def similarity(self, family: str, words: list[str]) -> float:
        """The best agreement with a template that fits: what is shared over the template's units or, in windows of MINIMUM words or
        more, over the window's. A unit counts by its worth, so what tells licences apart weighs most."""
        own, there, versions = _grams(words, 2), _core(words), _versions(words)
        best, whole = 0.0, self._sum(own)
        for t in self.templates[family]:
            if t.fits(there, versions):
                shared = self._sum(own & t.units)
                best = max(best, shared / self._sum(t.units), shared / whole if len(words) >= MINIMUM else 0.0)
        return best

    def apart(self, family: str, best: str, words: list[str]) -> float:
        """The share of one of the family's templates that is there without the units of the best family's."""
        own, there, versions = _grams(words, 2).difference(*(t.units for t in self.templates[best])), _core(words), _versions(words)
        return max((self._sum(own & t.units) / self._sum(t.units) for t in self.templates[family] if t.fits(there, versions)), default=0.0)

    def findings(self, text: str | None, least_probability: float, least_similarity: float) -> tuple[int, list[tuple]]:
        """Number of paragraphs, and (paragraph, start, end, family, probability, similarity, confirmed) of each finding."""
        text = text or ""
        count = sum(1 for line in text.split("\n") if line and not line.isspace())
        found: list[tuple] = []
        at = number = 0
        for line in text.split("\n"):
            if line and not line.isspace():
                words = words_of(line)
                if "spdx-license-identifier" in words or self.may_tell(words):
                    found += [(number, at + f[0], at + f[1], *f[2:]) for f in self._of_line(line, least_probability, least_similarity)]
                number += 1
            at += len(line) + 1
        return count, found

    def _of_line(self, line: str, least_probability: float, least_similarity: float) -> list[tuple]:
        tags = list(_EXPRESSION.finditer(line))
        found = [(m.start(), m.end(), family, 1.0, float(family != UNKNOWN), family != UNKNOWN) for m in tags for family in spdx_families(m[1])]
        if tags:  # what is left is read as prose
            line = "".join(" " * len(part) if i % 2 else part for i, part in enumerate(_EXPRESSION.sub(lambda m: f"\0{m[0]}\0", line).split("\0")))
        return found + self._of_prose(line, least_probability, least_similarity)

    def _of_prose(self, line: str, least_probability: float, least_similarity: float) -> list[tuple]:
        spans = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(line)]
        found: list[tuple] = []
        for first, part in windows_of(spans):
            words = [w for *_, w in part]
            if len(part) < len(spans) and not self.may_tell(words):
                continue
            # a line's ends belong to its first and last window
            start, end = 0 if not first else part[0][0], len(line) if first + len(part) == len(spans) else part[-1][1]
            p = self.probabilities(_grams(words))
            best = int(p.argmax())
            for k in (best, *np.flatnonzero(p > p[self.families.index(UNKNOWN)]).tolist()) if self.families[best] != UNKNOWN else ():
                # another family than the best needs word pairs of its own
                similarity = self.similarity(self.families[k], words) if k == best else self.apart(self.families[k], self.families[best], words)
                sure = similarity >= least_similarity and (k != best or similarity >= self.similarity(UNKNOWN, words))
                if sure or (k == best and p[k] >= least_probability):
                    same = next((i for i, f in enumerate(found) if f[2] == self.families[k] and f[1] > start), None)
                    new = (start, end, self.families[k], float(p[k]), similarity, sure)
                    if same is None:
                        found.append(new)
                    else:
                        was = found[same]
                        found[same] = (was[0], end, was[2], max(was[3], new[3]), max(was[4], new[4]), was[5] or sure)
        return found


def corpus_counts(docs: DataFrame, vocabulary: frozenset[str], share: float, text_col: str, id_col: str) -> DataFrame:
    """From one pass over whole texts: (word, n) for each task and word of ``vocabulary``, how many windows have it, and for ""
    how many windows there are; and (hash, window) of a share of the windows, picked by a hash of text and window number."""
    bound = min(int(share * 2.0**64), (1 << 64) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = Counter(), ("word", "n", "hash", "window")
        for batch in batches:
            picked = []
            for seed, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = 0
                for line in text.split("\n"):
                    for _, part in windows_of(words_of(line)) if line and not line.isspace() else ():
                        seen[""] += 1
                        seen.update(vocabulary.intersection(part))
                        h = xxhash.xxh64_intdigest(number.to_bytes(8, "little"), seed & ((1 << 64) - 1))
                        number += 1
                        if h <= bound:
                            picked.append((h - (1 << 63), " ".join(w[:LONG] for w in part)))
            empty = [None] * len(picked)
            yield pa.RecordBatch.from_arrays([pa.array(empty, pa.string()), pa.array(empty, pa.int64()), pa.array([h for h, _ in picked], pa.int64()), pa.array([w for _, w in picked], pa.string())], names=names)
        empty = [None] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array(empty, pa.int64()), pa.array(empty, pa.string())], names=names)

    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("seed"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long, hash long, window string")


def fit(docs: DataFrame, text_col: str = "text", negatives: int = NEGATIVES, seed: int = 9, id_col: str = "doc_id") -> Model:
    """Train on the driver, which gets the counts of the templates' words and ``negatives`` windows at most. The share of windows
    to pick is known only when they are counted: the pass writes about two for each document that is to give one, and a
    hash bound on what was written leaves about twice ``negatives`` for the choice by the smallest hash."""
    templates = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}
    vocabulary = frozenset(w for ts in templates.values() for t in ts for w in t)
    counted = materialize(corpus_counts(docs, vocabulary, 2 * negatives / max(1, docs.count()), text_col, id_col))
    seen = {r.word: r.n for r in counted.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the vocabulary's words
    picked = counted.where("window IS NOT NULL")
    share = min(1.0, 2 * negatives / max(1, picked.count()))
    least = picked.agg(F.min("hash"), F.max("hash")).first()
    if least[0] is not None:
        picked = picked.where(F.col("hash") <= least[0] + int((least[1] - least[0]) * share))
    wordings, worth = references(templates)
    plain = Model([], frozenset(), {}, np.zeros((0, 0)), np.zeros(0), 1.0, wordings, worth)
    windows = [r.window.split(" ") for r in picked.orderBy("hash", "window").limit(negatives).collect()]
    # A window that a template agrees with is a notice itself, not ordinary text; others that share wording stay.
    ordinary = [w for w in windows if not any(plain.similarity(f, w) >= 0.5 or plain.apart(f, UNKNOWN, w) >= 0.5 for f in templates)]
    drop(counted)
    return train(templates, seen, ordinary, np.random.default_rng(seed))


def references(templates: dict[str, list[list[str]]]) -> tuple[dict[str, list[Template]], dict[str, float]]:
    """Templates of families and of other licences, and the worth of their units."""
    wordings = {f: [Template.of(t) for t in ts] for f, ts in templates.items()} | {UNKNOWN: [Template.of(words_of(t)) for t in OTHERS]}
    having = Counter(u for f, ts in wordings.items() for u in (set().union(*(t.units for t in ts)) if f != UNKNOWN else ()))
    for t in wordings[UNKNOWN]:
        having.update(t.units)
    return wordings, {u: 1 / n for u, n in having.items()}


def gates_of(templates: dict[str, list[list[str]]], seen: dict[str, int]) -> frozenset[str]:
    """The words that are rare in the corpus, and each template's rarest one."""
    most = COMMON * seen.get("", 0)
    words = {w for ts in templates.values() for t in ts for w in t}
    rare = {w for w in words if seen.get(w, 0) <= most and w not in STOP}
    return frozenset(rare | {min(t, key=lambda w: (seen.get(w, 0), w in STOP, w)) for ts in templates.values() for t in ts if rare.isdisjoint(t)})


class _Sparse:
    """Rows of 0/1 features as their numbers, in the orders that products with a matrix and its transpose need."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.count, self.width = len(rows), width
        self.row, self.column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([c for r in rows for c in r], np.int64)
        self.by_column = np.argsort(self.column, kind="stable")

    @staticmethod
    def _sums(values: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, values.shape[1]), values.dtype)
        if len(keys):
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            out[keys[first]] = np.add.reduceat(values, first, axis=0)
        return out

    def times(self, weight: np.ndarray) -> np.ndarray:
        return self._sums(weight[self.column], self.row, self.count)

    def transposed_times(self, error: np.ndarray) -> np.ndarray:
        return self._sums(error[self.row[self.by_column]], self.column[self.by_column], self.width)


def train(templates: dict[str, list[list[str]]], seen: dict[str, int], ordinary: list[list[str]], rng: np.random.Generator) -> Model:
    families, gates = [*sorted(templates), UNKNOWN], gates_of(templates, seen)
    all_words, others = [w for ts in templates.values() for t in ts for w in t], [words_of(t) for t in OTHERS]
    worth = references(templates)[1]
    told = gates | gates_of({UNKNOWN: others}, seen)
    grams = sorted({g for t in [*(t for ts in templates.values() for t in ts), *others] for g in _grams(t) if " " in g or g in told})
    features = {g: i for i, g in enumerate(grams)}

    def example(family: str, template: list[str]) -> tuple[list[str], str]:
        kept = template
        if family != UNKNOWN and rng.random() < 0.5:  # the words around what no other licence has: a licence's name within other words
            own = [i for i in range(len(template)) if worth.get(" ".join(template[i : i + 2]), 0) == 1]
            if own:
                at = own[rng.integers(len(own))]
                kept = template[max(0, at - rng.integers(0, 4)) : at + 2 + rng.integers(0, 4)]
        kept = [w for w in kept if rng.random() > 0.08] or kept
        if len(kept) > 2 * MINIMUM and rng.random() < 0.5:  # a wrapped line of a paragraph
            first = rng.integers(len(kept) - MINIMUM)
            kept = kept[first : first + MINIMUM + rng.integers(2 * MINIMUM)]
        around = ordinary[rng.integers(len(ordinary))] if ordinary else []
        cut = rng.integers(0, 12)
        return [*around[:cut], *kept, *around[cut : cut + rng.integers(0, 12)]], family

    def made(times: int) -> list[tuple[list[str], str]]:
        known = [example(f, t) for f, ts in templates.items() for t in ts for _ in range(times)]
        # Other licences, and near misses: what a template says of something else than rights in works.
        known += [example(UNKNOWN, t) for t in others for _ in range(times // 2)]
        word = lambda: ordinary[rng.integers(len(ordinary))][0] if ordinary else "other"
        known += [example(UNKNOWN, [word() if w in CORE else w for w in t]) for ts in templates.values() for t in ts for _ in range(times // 4) if CORE & set(t)]
        mixed = [([*map(str, rng.choice(all_words, rng.integers(1, 12))), *(ordinary[rng.integers(len(ordinary))][:20] if ordinary else [])], UNKNOWN) for _ in range(len(known) // 4)]
        return known + mixed

    def matrix(rows: list[tuple[list[str], str]]) -> tuple[_Sparse, np.ndarray]:
        return _Sparse([sorted(features[g] for g in _grams(words) if g in features) for words, _ in rows], len(features)), np.array([families.index(f) for _, f in rows])

    half = len(ordinary) // 2
    x, y = matrix(made(12) + [(w, UNKNOWN) for w in ordinary[:half]])
    weight, bias = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32)
    target = np.eye(len(families), dtype=np.float32)[y]
    momentum_w, momentum_b = np.zeros_like(weight), np.zeros_like(bias)
    for _ in range(600):
        z = x.times(weight) + bias
        e = np.exp(z - z.max(1, keepdims=True))
        error = (e / e.sum(1, keepdims=True) - target) / x.count
        momentum_w, momentum_b = 0.9 * momentum_w + x.transposed_times(error) + 1e-5 * weight, 0.9 * momentum_b + error.sum(0)
        weight, bias = weight - 3 * momentum_w, bias - 3 * momentum_b
    x, y = matrix(made(4) + [(w, UNKNOWN) for w in ordinary[half:]])
    z = x.times(weight) + bias

    # The temperature, and a shift of the unknown class as if it were as frequent as all families together.
    weights = np.where(y == families.index(UNKNOWN), 0.5 / max(1, (y == families.index(UNKNOWN)).sum()), 0.5 / max(1, (y != families.index(UNKNOWN)).sum()))

    def loss(at: tuple[float, float]) -> float:
        s = z / at[0]
        s[:, families.index(UNKNOWN)] -= at[1]
        return float((weights * (np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(y)), y])).sum())

    temperature, shift = min(((float(t), float(d)) for t in np.geomspace(0.25, 4, 33) for d in np.arange(0, 4.1, 0.25)), key=loss)
    bias[families.index(UNKNOWN)] -= shift * temperature
    return Model(families, gates, features, weight, bias, temperature, *references(templates))


_FINDING = "array<struct<paragraph:int,start:int,end:int,family:string,probability:double,similarity:double,confirmed:boolean>>"


def scan(docs: DataFrame, model: Model, least_probability: float = 0.5, least_similarity: float = 0.5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, n_paragraphs, findings (array of structs; offsets count code points)."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), dict(docs.dtypes)[id_col]
    names = ("paragraph", "start", "end", "family", "probability", "similarity", "confirmed")
    finding = pa.list_(pa.struct([*((n, pa.int32()) for n in names[:3]), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.findings(t, least_probability, least_similarity) for t in batch.column(1).to_pylist()]
            found = [[dict(zip(names, f)) for f in fs] for _, fs in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(found, finding)], names=["id", "n_paragraphs", "findings"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_paragraphs long, findings {_FINDING}").withColumnRenamed("id", id_col)
