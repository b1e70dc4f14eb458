"""Operator 9, licence scans: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over sparse word n-grams (one to three words) is trained here. Its examples are
notices: the names of licence families in frames ("Licensed under the ..."), paragraphs of licence texts, and variants
of both (words left out, words of prose before and after). The class unknown has the same frames with the names of
other licences, so that a frame alone says nothing, and prose, some of it with words of licence names. A temperature,
fitted on frames, names and prose that training doesn't see, calibrates the probabilities; below MIN_PROBABILITY a
paragraph is unknown. A prediction counts when a template of the family confirms it: a window of the paragraph, half as
long again as the template, holds CONFIRM or more of the template's words in their order (of the
paragraph's if these are fewer, but WHOLE at least: notices are wrapped), and with them the words that distinguish the family, but none that distinguishes another one from it.

Paragraphs are the lines of a text. One of several sentences and more than LONG words is judged sentence by sentence,
too, and has the most probable family found. Lines without the words that a confirmation needs are unknown without being
scored.

Cases: null and empty texts have no paragraphs, an empty table gives an empty one; very long paragraphs are judged
whole; repeated rows come out once per row; ties between families go to the first by name. Columns named like the new
ones are replaced.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, slices

MIN_PROBABILITY, CONFIRM, LONG, WHOLE = 0.5, 0.75, 40, 8
STEPS, RATE, PENALTY = 120, 0.5, 0.002
UNKNOWN = "unknown"

#: Names of licences as notices write them.
NAMES = {
    "agpl": ["GNU Affero General Public License, version 3", "Affero General Public License", "GNU AGPL v3", "AGPL 3.0", "AGPL-3.0-or-later", "AGPLv3"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License v2", "Apache Software License", "Apache licence"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "new BSD licence", "BSD-style license"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 License", "CC BY 4.0", "CC-BY-SA 4.0", "CC BY-SA 3.0", "CC BY", "CC-BY-4.0", "Creative Commons Attribution 3.0 Unported"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License", "CC BY-NC 4.0", "CC-BY-NC-SA 4.0", "CC BY-NC 3.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0"],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal", "CC0", "Creative Commons Zero", "CC0-1.0", "Creative Commons CC0 public domain dedication"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPL, version 2 or later", "GPL v2", "GPLv3", "GPL-3.0-or-later", "GPL-2.0-only", "GPL 3.0"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "Lesser General Public License", "GNU LGPL", "LGPL v3", "LGPL-2.1-or-later", "LGPLv2.1", "GNU Library General Public License"],
    "mit": ["MIT License", "MIT", "MIT licence", "Expat/MIT license", "MIT/X11 license", "MIT license (MIT)"],
    "mpl": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPL 1.1"],
}
#: Names of licences outside the families.
OTHERS = [
    "Eclipse Public License 2.0", "EPL-2.0", "ISC License", "ISC", "European Union Public Licence 1.2", "EUPL 1.2", "EUPL", "Boost Software License 1.0", "BSL-1.0", "zlib License", "zlib/libpng license",
    "Artistic License 2.0", "Perl Artistic License", "Common Development and Distribution License", "CDDL 1.0", "Microsoft Public License", "MS-PL", "SIL Open Font License 1.1", "OFL-1.1", "WTFPL",
    "PostgreSQL License", "Python Software Foundation License", "PSF-2.0", "Open Database License", "ODbL 1.0", "Business Source License 1.1", "Server Side Public License", "SSPL", "Academic Free License 3.0", "IBM Public License",
    "Ruby License", "PHP License 3.01", "Common Public License 1.0", "Q Public License", "Sleepycat License", "Universal Permissive License", "CeCILL 2.1", "W3C Software Notice", "NASA Open Source Agreement", "Community Data License Agreement",
    "standard commercial license", "site licence", "end user license agreement", "open source license", "public licence", "free license", "general license, version 3", "software license 2.0", "Creative Commons", "Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0",
]
#: Frames of training and, apart from these, of calibration.
FRAMES = (
    "{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is distributed under the terms of the {}", "SPDX-License-Identifier: {}",
    "License: {}", "{} licensed.", "Code: {}", "Published under {}", "This Source Code Form is subject to the terms of the {}.", "Copyright 2021 the authors. {}.", "Available under the {} license", "Use of this source code is governed by the {}",
    "This library is licensed under the {}.", "Permission is granted to copy it under the terms of the {} as published by the foundation",
)
HELD_FRAMES = ("may be used under the terms of the {}", "The project uses the {}.", "Copyright 2020 Example Ltd, under {}", "This file is part of Foo, which is covered by the {}", "see the file LICENSE ({})", "distributed under the {}", "Licence of the data: {}")
#: Paragraphs of licence texts and notices without a name, each with words that must be in it.
BODIES = {
    "agpl": [("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero")],
    "apache": [
        ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0", "compliance apache"),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "unless applicable writing basis"),
    ],
    "bsd": [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary permitted"),
        ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "redistributions binary disclaimer"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither contributors endorse promote"),
        ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", "provided contributors merchantability disclaimed"),
    ],
    "cc0": [
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived copyright"),
        ("the author has dedicated all copyright to the public domain under CC0 1.0.", "cc0"),
    ],
    "gpl": [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "gnu redistribute"),
        ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", "hope warranty gnu"),
    ],
    "lgpl": [("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser library")],
    "mit": [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "hereby granted charge obtaining"),
        ("including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "merge sublicense furnished"),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "notice copies substantial portions"),
        ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", "provided warranty kind express"),
    ],
    "mpl": [("If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla.org MPL 2.0", "mpl obtain")],
    "reserved": [
        ("All rights reserved.", "all rights reserved"),
        ("Copyright the authors. All rights reserved.", "all rights reserved"),
        ("Unauthorized copying of this file, via any medium, is strictly prohibited", "unauthorized copying prohibited"),
        ("No part of this work may be reproduced without written permission of the publisher", "part reproduced permission"),
        ("No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission", "part reproduced permission"),
    ],
}
#: Names that are common words, too, count with a neighbour only.
COMMON = {"mit": ["license mit", "licence mit", "identifier mit", "code mit", "under mit", "mit licensed", "mit style"]}
#: Words that distinguish a family (one of them must be there) and words that belong to another one.
OWN = {
    "agpl": {"affero", "agpl", "agplv3"}, "apache": {"apache"}, "bsd": {"bsd"}, "cc-by": {"cc", "attribution"}, "cc-by-nc": {"nc", "noncommercial"}, "cc0": {"cc0", "zero"},
    "gpl": {"gnu", "gpl", "gplv2", "gplv3"}, "lgpl": {"lesser", "library", "lgpl", "lgplv2.1", "lgplv3"}, "mit": {"mit"}, "mpl": {"mozilla", "mpl"},
}
NEVER = {"cc-by": {"nc", "noncommercial", "nd", "noderivatives"}, "gpl": {"affero", "lesser", "agpl", "lgpl"}}
PROSE = [
    "She renewed her driving licence at the office in the city last week.",
    "The doctor was licensed to practise medicine in the state.",
    "A public meeting about the new version of the plan will be held on Monday.",
    "The general said that the work of the foundation is free for any person.",
    "Apache helicopters flew over the general area in the morning.",
    "The Apache people lived in the mountains under the terms of a treaty.",
    "Researchers at MIT released a report about the use of software in schools.",
    "He studied at MIT and holds a license to teach.",
    "GNU is the name of a kind of antelope that lives in large herds.",
    "Mozilla published a public report about the state of the web.",
    "The library is open to the public, and a lesser known branch is in the old town.",
    "BSD is a family of operating systems with a long history.",
    "The source of the river is in the mountains and its form is subject to the seasons.",
    "He wrote to the author under a different name and used the file as a copy.",
    "Permission to build was granted by the city on the following conditions.",
    "The terms of the agreement were published by the company in its annual report.",
    "Attribution of the painting is uncertain, and all the experts disagree.",
    "This is a common creative exercise for a class of young writers.",
    "The domain of the function is the set of all numbers to which it applies.",
    "The rights of all workers were reserved for a later discussion.",
    "You can find the documentation on the following page of the manual.",
    "The software is provided to all members of the club at the front desk.",
    "No part of the house was open to visitors without a guide.",
    "Any copy of the letter should be sent to the office, with cc to the director.",
    "Redistribution of wealth was the topic of the lecture.",
    "The warranty of the car covers any kind of damage.",
    "La licencia de conducir se renueva en la oficina de la ciudad.",
    "Das Werk wurde unter der Leitung des Direktors mit Erfolg in der Stadt gezeigt.",
    "Der Plan wurde mit der Lizenz der Stadt gebaut, die Arbeit begann mit dem Dach.",
    "Le permis de construire est accordé par la ville pour une durée de trois ans.",
]
HELD_PROSE = [
    "The MIT team won the cup again this year.", "An Apache pilot was the guest of the evening.", "The zero line of the chart marks the mean.", "The general public is free to visit the library.", "All seats are reserved for members.",
    "Copies of the report are provided without charge.", "The licence of the pub ends in May.", "Un permis de conduire est valable dix ans.", "Die Fahrt mit dem Bus kostet nichts.", "Public domain films are shown under the stars.",
]
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}


def aligned(template: list[str], window: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(window) + 1)
    for t in template:
        before = row
        row = [0]
        for k, w in enumerate(window):
            row.append(before[k] + 1 if w == t else max(before[k + 1], row[k]))
    return row[-1]


def examples(frames: tuple[str, ...], prose: list[str], seed: int, others: list[str], variants: int = 2) -> list[tuple[list[str], str]]:
    """(words, family) of notices, bodies, other licences and prose, with variants."""
    rng = random.Random(seed)
    whole = [(f.format(n), family) for family, names in NAMES.items() for f, n in product(frames, names)]
    whole += [(f.format(n), UNKNOWN) for f, n in product(frames, others)]
    whole += [(text, family) for family, texts in BODIES.items() for text, _ in texts for _ in range(8)]
    whole += [(p, UNKNOWN) for p in prose for _ in range(8)]
    out = []
    for text, family in whole:
        ws = words(text)
        out.append((ws, family))
        for _ in range(variants - 1):
            keep = NEVER.get(family, set()) | OWN.get(family, set())
            some = [w for w in ws if w in keep or rng.random() > 0.12]
            before, after = (words(rng.choice(prose)) for _ in range(2))
            out.append((before[: rng.randrange(7)] + some + after[: rng.randrange(7)], family))
    return out


class Model:
    """The trained classifier with its templates."""

    def __init__(self, seed: int = 7):
        self.families = [*sorted(NAMES.keys() | BODIES.keys()), UNKNOWN]
        self.templates = {f: [(words(n), frozenset()) for n in [*COMMON.get(f, ()), *NAMES.get(f, ())] if n.lower() not in COMMON] + [(words(t), frozenset(must.split())) for t, must in BODIES.get(f, ())] for f in self.families}
        #: What a paragraph must have for a confirmation: one of the lone words, or all words of a group.
        self.lone = set().union(*OWN.values()) - COMMON.keys()
        self.together = [must for ts in self.templates.values() for _, must in ts if must]
        self.together += [frozenset({w, other}) for w in COMMON for ts in self.templates.values() for t, _ in ts if w in t for other in set(t) - {w}]
        rare = [max(group - COMMON.keys(), key=lambda w: (len(w), w)) if not group & COMMON.keys() else next(iter(group & COMMON.keys())) for group in self.together]
        self.anchors = self.lone | set(rare)
        train = examples(FRAMES, PROSE, seed, OTHERS[::2])
        rows = [grams(ws) for ws, _ in train]
        self.number = {g: i for i, g in enumerate(sorted(set().union(*rows)))}
        self.weight = self._train(rows, np.array([self.families.index(f) for _, f in train]))
        self.temperature = 1.0
        held = examples(HELD_FRAMES, HELD_PROSE, seed + 1, OTHERS[1::2])
        z = np.array([self._logits(grams(ws)) for ws, _ in held])
        y = np.array([self.families.index(f) for _, f in held])
        self.temperature = min(np.geomspace(0.1, 4, 30).tolist(), key=lambda t: -np.log(self._softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def _train(self, rows: list[set[str]], target: np.ndarray) -> np.ndarray:
        """Full gradient steps with a scale for each weight; examples are lists of columns, the last is the bias."""
        found = [sorted(self.number[g] for g in row) for row in rows]
        size = np.array([len(x) for x in found])
        line, column = np.repeat(np.arange(len(rows)), size), np.concatenate(found).astype(int)
        value = (1 / np.sqrt(size))[line].astype(np.float32)
        starts = np.cumsum(size) - size
        by_column = np.argsort(column, kind="stable")
        first = np.searchsorted(column[by_column], np.arange(len(self.number)))
        y = np.eye(len(self.families), dtype=np.float32)[target]
        share = (1 / np.bincount(target, minlength=len(self.families)).clip(1))[target][:, None].astype(np.float32) * len(rows) / len(self.families)
        w = np.zeros((len(self.number) + 1, len(self.families)), np.float32)
        seen = np.full_like(w, 1e-6)
        for _ in range(STEPS):
            z = np.add.reduceat(w[column] * value[:, None], starts) + w[-1]
            error = (self._softmax(z) - y) * share
            g = np.append(np.add.reduceat((error[line] * value[:, None])[by_column], first), error.sum(0, keepdims=True), axis=0) / len(rows)
            g[:-1] += PENALTY / len(rows) * w[:-1]
            seen += g * g
            w -= RATE * g / np.sqrt(seen)
        return w

    def _logits(self, row: set[str]) -> np.ndarray:
        found = [self.number[g] for g in row if g in self.number]
        return self.weight[found].sum(0) / np.sqrt(len(row) or 1) + self.weight[-1]

    def probabilities(self, ws: list[str]) -> np.ndarray:
        return self._softmax(self._logits(grams(ws)) / self.temperature)

    def predict(self, ws: list[str]) -> tuple[str, float]:
        p = self.probabilities(ws)
        k = int(p.argmax())
        return (self.families[k], float(p[k])) if p[k] >= MIN_PROBABILITY else (UNKNOWN, float(p[-1]))

    def confirmed(self, ws: list[str], family: str) -> bool:
        if family == UNKNOWN or NEVER.get(family, set()).intersection(ws):
            return False
        for template, must in self.templates[family]:
            anchor, span = must or OWN[family], len(template) * 3 // 2
            for at in (i for i, w in enumerate(ws) if w in anchor):
                window = ws[max(0, at - span) : at + span]
                need = CONFIRM * (len(template) if len(ws) < WHOLE else min(len(template), len(ws)))
                if must <= set(window) and any(aligned(template, window[k : k + span]) >= need for k in range(max(1, len(window) - span + 1))):
                    return True
        return False

    def possible(self, ws: list[str]) -> bool:
        """Whether any template could confirm a family of these words."""
        if self.anchors.isdisjoint(ws):
            return False
        return not self.lone.isdisjoint(ws) or any(group <= have for have in [set(ws)] for group in self.together)

    def paragraph(self, line: str) -> tuple[str, float]:
        """(family or unknown, probability)."""
        ws = words(line)
        if not self.possible(ws):
            return UNKNOWN, 1.0
        parts = [ws]
        if len(ws) > LONG and len(sentences := _SENTENCE.split(line)) > 1:
            parts += [x for x in map(words, sentences) if self.possible(x)]
        found = [(family, p) for part in parts for family, p in [self.predict(part)] if self.confirmed(part, family)]
        return max(found, key=lambda x: x[1]) if found else (UNKNOWN, float(self.probabilities(ws)[-1]))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return Model()


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text but with n_paragraphs, n_license, families (sorted, comma-joined) and found, the
    licence paragraphs as array<struct<line, family, probability>>."""
    made = ["n_paragraphs", "n_license", "families", "found"]
    kept = [c for c in docs.columns if c not in (text, *made)]
    types = dict(docs.dtypes)
    model = docs.sparkSession.sparkContext.broadcast(default_model())
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        anchors = sorted(own.anchors)
        for batch in slices(batches):
            rows = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                lines = (t or "").split("\n")
                found = []
                low = (t or "").lower()
                if any(a in low for a in anchors):
                    for n, line in enumerate(lines):
                        family, p = own.paragraph(line)
                        if family != UNKNOWN:
                            found.append({"line": n, "family": family, "probability": p})
                rows.append((sum(bool(x.strip()) for x in lines), len(found), ",".join(sorted({x["family"] for x in found})), found))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), kind), strict=True)], names=kept + made
            )

    ddl = "n_paragraphs long, n_license long, families string, found array<struct<line: int, family: string, probability: double>>"
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), ddl]))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_paragraphs", "n_license", "families")
