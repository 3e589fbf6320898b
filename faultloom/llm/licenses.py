"""Licence scans: a paragraph classifier over sparse word n-grams, confirmed by comparison with templates.

A paragraph is a stretch of lines without a blank one, and each of its lines is looked at as a notice of its own too. Words
(letters, digits and bytes beyond ASCII, lower-cased) make 1- to 3-grams, hashed to DIMS slots. A softmax regression over
the licence families and an unknown class, with small weights cut to zero, gives each line and paragraph a probability.
It is calibrated by a temperature on noisy copies of templates that the calibrated model hasn't seen; the model that is used
is then fitted on all templates. What reaches CERTAIN is confirmed if it shares LIKE or more of its word pairs with a
template of that family (containment of the smaller in the larger). Everything else is unknown. A paragraph is one find
where it matches more of a template than any of its lines: a notice that is wrapped over lines counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, tidy
from .shingles import Powers, located, scramble

DIMS, CERTAIN, LIKE, LEAST_PAIRS = 1 << 16, 0.5, 0.6, 2
COPIES, EPOCHS, RATE, CUT, SEED = 24, 30, 0.3, 0.02, 17

#: One of HELD templates of a family is kept for calibration; a line where a family reaches HINT has its paragraph tried.
HELD, HINT = 3, 0.05
UNKNOWN = "unknown"

#: Notices by family, one a line.
TEMPLATES = """
MIT|Released under the MIT License.
MIT|Licensed under the MIT License.
MIT|This project is licensed under the terms of the MIT license.
MIT|SPDX-License-Identifier: MIT
MIT|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction
Apache-2.0|Licensed under the Apache License, Version 2.0.
Apache-2.0|Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
Apache-2.0|SPDX-License-Identifier: Apache-2.0
Apache-2.0|This software is released under the Apache License, Version 2.0, January 2004
GPL-3.0|This work is licensed under the GNU General Public License, version 3.
GPL-3.0|This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
GPL-3.0|Licensed under the GNU GPL v3
GPL-3.0|SPDX-License-Identifier: GPL-3.0-or-later
GPL-2.0|This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.
GPL-2.0|This work is licensed under the GNU General Public License, version 2.
GPL-2.0|SPDX-License-Identifier: GPL-2.0-only
LGPL|This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation
LGPL|Licensed under the GNU Lesser General Public License, version 2.1.
LGPL|SPDX-License-Identifier: LGPL-2.1-or-later
AGPL-3.0|This program is licensed under the GNU Affero General Public License, version 3.
AGPL-3.0|SPDX-License-Identifier: AGPL-3.0-only
BSD|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD|Licensed under the BSD 3-Clause License.
BSD|Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
BSD|SPDX-License-Identifier: BSD-3-Clause
MPL-2.0|This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
MPL-2.0|Licensed under the Mozilla Public License, version 2.0.
MPL-2.0|SPDX-License-Identifier: MPL-2.0
ISC|Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
ISC|Released under the ISC License.
EPL-2.0|This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
CC0|To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
CC0|This work is dedicated to the public domain under CC0 1.0 Universal.
CC-BY|This work is licensed under a Creative Commons Attribution 4.0 International License.
CC-BY|Licensed under CC BY 4.0.
CC-BY-SA|This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
CC-BY-SA|Licensed under CC BY-SA 4.0.
CC-BY-NC|Licensed under CC BY-NC 4.0.
CC-BY-NC|This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
CC-BY-ND|Licensed under CC BY-ND 4.0.
CC-BY-ND|This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.
CC-BY-NC-ND|Licensed under CC BY-NC-ND 4.0.
Unlicense|This is free and unencumbered software released into the public domain.
Proprietary|All rights reserved.
Proprietary|Copyright 2020 Example Inc. All rights reserved.
Proprietary|Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.
unknown|The driver must carry a valid license and the papers of the car.
unknown|He was granted a fishing license by the state in version two of the law.
unknown|The public library released a new version of its catalogue.
unknown|Die Regierung mit der Mehrheit im Parlament hat das Gesetz beschlossen.
unknown|All people have rights and duties under the law of the land.
unknown|The general said that the public was free to use the road.
unknown|She works at MIT and was released from the hospital in May.
unknown|The Apache helicopter was used in version two of the film.
unknown|A common attribution of the work is to an unknown painter of that time.
unknown|The table was reserved for all of us at eight.
unknown|The terms of the contract were modified under pressure.
unknown|Permission to enter is granted to any person with a ticket free of charge.
unknown|Source and binary stars are seen in many forms with or without a telescope.
unknown|by the way of the that and to in is for it on was with as be are
unknown|le la les des de que qui pour dans avec sur par une est
unknown|der die das und ist mit von zu den im ein eine nicht
unknown|el la los las de que y en un una por con para
"""

_GAP = np.ones(256, bool)
for _part in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _GAP[list(_part)] = False
_ONE, _TWO = scramble(np.arange(2, dtype=np.uint64), 4242) | np.uint64(1)


def paragraph_words(text: bytes | None, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a text, the line (from 0) of each, and its paragraph: the first line of it that has words.

    Lines end at a line feed; a line without words ends a paragraph.
    """
    found, starts = located(text, powers, _GAP)
    ends = np.flatnonzero(np.frombuffer(text or b"", np.uint8) == 10)
    line = np.searchsorted(ends, starts)
    first = np.r_[True, np.diff(line) > 1][: len(line)]
    return found, line, line[np.maximum.accumulate(np.where(first, np.arange(len(line)), 0))]


def grams(found: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and lines of the 1- to 3-grams that lie in one line, and the hash of each word pair (0 across lines)."""
    two = np.where(line[1:] == line[:-1], scramble(found[:-1] * _ONE + found[1:]), np.uint64(0))
    inside = line[2:] == line[:-2]
    three = scramble(found[:-2] * _TWO + found[1:-1] * _ONE + found[2:])[inside] if len(found) > 2 else np.zeros(0, np.uint64)
    slots = np.concatenate([found, two[two != 0], three]) >> np.uint64(48)
    lines = np.concatenate([line, line[1:][two != 0], line[2:][inside] if len(found) > 2 else line[:0]])
    return slots.astype(np.int64), lines, two


class Scanner:
    """The classifier and the templates' word pairs."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        """rows: (family, text). Without rows everything is unknown."""
        self.families = [UNKNOWN, *sorted({f for f, _ in rows} - {UNKNOWN})]
        place = {f: k for k, f in enumerate(self.families)}
        powers = Powers()
        self.pairs: list[list[np.ndarray]] = [[] for _ in self.families]
        for family, text in rows:
            if family != UNKNOWN:
                self.pairs[place[family]].append(np.unique(grams(*paragraph_words(text.encode(), powers)[:2])[2]))
        self.heat = 1.0
        self._clear()
        if rows:
            held = self._unseen(rows)
            if held:
                kept = [r for r in rows if r not in held]
                self._fit(self._copies(kept, rows, place), powers)
                self.heat = self._temperature(self._copies(held, rows, place), powers)
            self._fit(self._copies(rows, rows, place), powers)
        self.active = np.abs(self.weights).max(1) > 0

    def _clear(self) -> None:
        self.weights, self.bias = np.zeros((DIMS, len(self.families))), np.zeros(len(self.families))

    @staticmethod
    def _unseen(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Every HELD-th template of a family, for calibration: those of families with fewer are always seen."""
        by: dict[str, list[tuple[str, str]]] = {}
        for row in rows:
            by.setdefault(row[0], []).append(row)
        return [r for some in by.values() for r in some[HELD - 1 :: HELD]]

    @staticmethod
    def _copies(rows: list[tuple[str, str]], every_row: list[tuple[str, str]], place: dict[str, int]) -> list[tuple[int, str]]:
        """(class, text) of noisy copies of templates, and counter-examples made of their words."""
        rng = np.random.default_rng(SEED)
        every = [w for _, t in every_row for w in t.split()]
        out: list[tuple[int, str]] = []
        for _ in range(COPIES):
            for family, text in rows:
                words = text.split()
                kept = [w for w in words if rng.random() > (0.08 if len(words) > 8 else 0.02)] or words
                noise = lambda: [str(x) for x in rng.choice(every, rng.integers(0, 4))] if rng.random() < 0.3 else []
                out.append((place[family], " ".join([*noise(), *kept, *noise()])))
                if rng.random() < 0.5:
                    out.append((0, " ".join(str(x) for x in rng.permutation(words))) if len(words) > 6 else (0, " ".join(str(x) for x in rng.choice(every, 8))))
        return out

    def _fit(self, examples: list[tuple[int, str]], powers: Powers) -> None:
        self._clear()
        rng = np.random.default_rng(SEED)
        encoded = [(k, grams(*paragraph_words(t.encode(), powers)[:2])[0]) for k, t in examples]
        used = rng.permutation(len(encoded))
        total, first = np.full(self.weights.shape, 1e-6), np.full(self.bias.shape, 1e-6)
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for at in range(0, len(used), 32):
                part = [encoded[k] for k in used[at : at + 32]]
                slots, own = np.concatenate([s for _, s in part]), np.repeat(np.arange(len(part)), [len(s) for _, s in part])
                share = self._share(np.stack([self.weights[s].sum(0) for _, s in part]) + self.bias)
                share[np.arange(len(part)), [k for k, _ in part]] -= 1
                share /= len(part)
                rows, inverse = np.unique(slots, return_inverse=True)
                grad = np.zeros((len(rows), len(self.families)))
                np.add.at(grad, inverse, share[own])
                grad += 1e-5 * self.weights[rows]
                total[rows] += grad * grad
                first += share.sum(0) ** 2
                self.weights[rows] -= RATE * grad / np.sqrt(total[rows])
                self.bias -= RATE * share.sum(0) / np.sqrt(first)
        self.weights[np.abs(self.weights) < CUT] = 0

    def _temperature(self, examples: list[tuple[int, str]], powers: Powers) -> float:
        """The temperature that makes examples which the weights haven't seen likeliest."""
        margin = np.stack([self.weights[grams(*paragraph_words(t.encode(), powers)[:2])[0]].sum(0) for _, t in examples]) + self.bias
        gold = np.array([k for k, _ in examples])
        loss = {heat: -np.log(self._share(margin / heat)[np.arange(len(gold)), gold] + 1e-12).mean() for heat in np.arange(0.5, 6.01, 0.25)}
        return float(min(loss, key=loss.get))

    @staticmethod
    def _share(margin: np.ndarray) -> np.ndarray:
        e = np.exp(margin - margin.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _finds(self, found: np.ndarray, part: np.ndarray, least: float) -> tuple[list[tuple[int, int, float, float, float]], np.ndarray]:
        """(family, part, probability, likeness, pairs shared) of confirmed parts, and the parts where a family reaches least."""
        slots, parts, two = grams(found, part)
        on = self.active[slots]
        slots, parts = slots[on], parts[on]
        if not len(slots) or len(self.families) < 2:
            return [], parts[:0]
        used, inverse = np.unique(parts, return_inverse=True)
        margin = np.zeros((len(used), len(self.families)))
        np.add.at(margin, inverse, self.weights[slots])
        share = self._share((margin + self.bias) / self.heat)
        best = share[:, 1:].argmax(1) + 1
        top, out = share[np.arange(len(used)), best], []
        for n in np.flatnonzero(top >= CERTAIN):
            own = np.unique(two[(part[1:] == used[n]) & (two != 0)])
            likeness = shared = 0.0
            for t in self.pairs[best[n]]:
                if len(own) >= min(LEAST_PAIRS, len(t)):
                    both = len(np.intersect1d(own, t, assume_unique=True))
                    likeness, shared = max((likeness, shared), (both / max(1, min(len(own), len(t))), both))
            if likeness >= LIKE:
                out.append((int(best[n]), int(used[n]), float(top[n]), likeness, shared))
        return out, used[top >= least]

    def scan(self, text: bytes | None, powers: Powers) -> tuple[int, list[tuple[str, int, float, float]]]:
        """Number of paragraphs, and (family, line, probability, likeness) of each confirmed line or paragraph (its first line)."""
        found, line, paragraph = paragraph_words(text, powers)
        if not len(found):
            return 0, []
        by_line, hints = self._finds(found, line, HINT)
        owner = dict(zip(line.tolist(), paragraph.tolist(), strict=True))
        inside = np.isin(paragraph, [owner[k] for k in hints.tolist()]) if len(hints) else np.zeros(0, bool)
        wide = []
        if inside.any():
            lines = {p: len(np.unique(line[paragraph == p])) for p in np.unique(paragraph[inside]).tolist()}
            inside &= np.isin(paragraph, [p for p, n in lines.items() if n > 1])
            wide = self._finds(found[inside], paragraph[inside], 1.0)[0] if inside.any() else []
        for family, place, probability, likeness, shared in wide:
            own = [f for f in by_line if f[0] == family and owner[f[1]] == place]
            if shared > max((f[4] for f in own), default=0):
                by_line = [f for f in by_line if f not in own] + [(family, place, probability, likeness, shared)]
        return int((np.diff(paragraph) > 0).sum()) + 1, [(self.families[f], n, p, s) for f, n, p, s, _ in sorted(by_line, key=lambda f: (f[1], f[0]))]


def templates_table(spark: SparkSession) -> DataFrame:
    """The default templates: family, text."""
    return spark.createDataFrame([tuple(x.split("|", 1)) for x in TEMPLATES.strip().split("\n")], "family string, text string")


def train(templates: DataFrame) -> Scanner:
    """A scanner from a small table (family, text); rows with a null are skipped, family unknown has counter-examples."""
    return Scanner(sorted((r.family, r.text) for r in templates.select("family", "text").dropna().collect()))


def find(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_paragraphs, n_licensed, families (sorted, comma-joined), found.

    found lists family:line:probability:likeness of each confirmed line or paragraph (its first line), comma-joined,
    lines from 0; of finds on one line the family's name decides. n_paragraphs counts the stretches of lines with words.
    Null and empty texts have no paragraph. Rows repeated with one id, and rows without one, are each scanned. Other
    columns are ignored; an empty docs gives no rows. A text of any length is scanned whole, as one array of words.
    """
    arrow_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            lines, found = [], []
            for raw in b.column("text"):
                paragraphs, finds = scanner.scan(raw.as_py(), powers)
                lines.append(paragraphs)
                found.append(finds)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(lines, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(sorted({f for f, *_ in x})) for x in found]), pa.array([",".join(f"{f}:{n}:{p:.3f}:{s:.3f}" for f, n, p, s in x) for x in found])],
                names=["id", "n_paragraphs", "n_licensed", "families", "found"],
            )

    return source.mapInArrow(tidy(scan), f"id {id_type}, n_paragraphs long, n_licensed long, families string, found string").withColumnRenamed("id", id_col)
