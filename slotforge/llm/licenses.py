"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance down directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, written

#: Licence and the wordings that name it: short notices as projects write them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT license. SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version. SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation. SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1. SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3. SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3. SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Licensed under the BSD 3-Clause License. SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License. SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Distributed under the BSD license."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "Licensed under the GPLv3."),
    ("GPL-2.0", "Licensed under the GPLv2."),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("LGPL-2.1", "Licensed under the LGPLv2.1."),
    ("LGPL-3.0", "Licensed under the LGPLv3."),
    ("AGPL-3.0", "Licensed under the AGPLv3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License. SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal waiver. SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited. Copyright, all rights reserved."),
]
#: Identifiers of the SPDX list, each a template of its own, and the name it is reported by if not itself.
SPDX = {
    "MIT": "", "Apache-2.0": "", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0",
    "MPL-2.0": "", "EPL-1.0": "", "EPL-2.0": "", "BSL-1.0": "", "Zlib": "", "ISC": "", "0BSD": "", "BSD-2-Clause": "", "BSD-3-Clause": "", "Unlicense": "", "CC0-1.0": "", "CC-BY-4.0": "", "CC-BY-SA-4.0": "",
    "CC-BY-NC-4.0": "", "Artistic-2.0": "", "WTFPL": "", "CDDL-1.0": "", "EUPL-1.2": "", "MS-PL": "", "PostgreSQL": "", "Python-2.0": "", "NCSA": "", "OFL-1.1": "",
}
TEMPLATES += [(name or key, f"SPDX-License-Identifier: {key}") for key, name in SPDX.items()]
#: Wordings that say that a licence does not hold.
NEGATED = re.compile(r"(?i)\b(?:not|never|no longer)\s+(?:\w+\s+){0,2}(?:licen[cs]ed|released|covered|distributed|available)\b")
#: A line with none of these can't name a licence.
CUES = (b"licen", b"copyright", b"spdx", b"rights reserved", b"public domain", b"creative commons", b"permission", b"redistribut", b"free software", b"proprietary", b"unauthorized", b"cc by", b"cc0", b"gpl", b"neither the name")
LICENCE_FILE = re.compile(r"(?i)(?:^|[._-])(?:licen[cs]es?|copying|unlicense|notice)(?:[._-]|$)")
_TERM = re.compile(r"[a-z]+(?:\d+(?:\.\d+)*)?|\d+(?:\.\d+)*")


def terms(text: str) -> Counter[str]:
    """Words and numbers; GPLv3, GPL v3.0 and GPL-3 are the same two terms."""
    low = re.sub(r"(?<=gpl)[ -]?v(?=\d)|\bv(?:ersion)?\.? ?(?=\d)", " ", text.lower())
    found = _TERM.findall(re.sub(r"(?<=\d)\.0\b", "", low))
    return Counter(re.sub(r"^licences?$|^licenses$", "license", t) for t in found)


class Templates:
    """TF-IDF vectors of the templates over their own words; words unknown to them only lengthen a text's vector."""

    def __init__(self, templates: list[tuple[str, str]]):
        bags = [terms(t) for _, t in templates]
        spread = Counter(w for b in bags for w in b)
        self.names = [name for name, _ in templates]
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in spread.items()}
        self.unknown = math.log(1 + len(bags)) + 1
        self.place = {w: i for i, w in enumerate(sorted(spread))}
        self.matrix = np.zeros((len(bags), len(self.place)))
        for row, bag in enumerate(bags):
            for w, n in bag.items():
                self.matrix[row, self.place[w]] = (1 + math.log(n)) * self.idf[w]
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)

    def best(self, text: str) -> tuple[float, str | None]:
        bag = terms(text)
        if not bag:
            return 0.0, None
        weights = {w: (1 + math.log(n)) * self.idf.get(w, self.unknown) for w, n in bag.items()}
        known = [(self.place[w], v) for w, v in weights.items() if w in self.place]
        if not known:
            return 0.0, None
        at, values = zip(*known, strict=True)
        scores = self.matrix[:, at] @ np.array(values) / math.sqrt(sum(v * v for v in weights.values()))
        i = int(np.argmax(scores))
        return float(scores[i]), self.names[i]


def chosen(found: list[tuple[float, str]]) -> tuple[float, str | None]:
    """The best (score, name) of those that a file states: rights reserved do not outvote a licence, nor the opening that both BSD licences share the third clause."""
    names = {name for _, name in found}
    weak = {"Proprietary"} if names - {"Proprietary"} else set()
    if "BSD-3-Clause" in names:
        weak.add("BSD-2-Clause")
    return max(((score, name) for score, name in found if name not in weak), default=(0.0, None))


def _blocks(text: bytes) -> Iterator[tuple[str, int]]:
    """The texts to compare and their words (``_parts``), without those that deny a licence."""
    return ((block, words) for block, words in _parts(text) if not NEGATED.search(block))


def _parts(text: bytes) -> Iterator[tuple[str, int]]:
    """Each line with a cue, its sentences with one, and each run of lines around one up to blank lines."""
    run: list[str] = []
    cued = False
    for raw in [*text.split(b"\n"), b""]:
        low = raw.lower()
        if not low.strip():
            if cued and len(run) > 1:
                whole = " ".join(run)
                yield whole, len(whole.split())
            run, cued = [], False
            continue
        line = raw.decode("utf-8", "replace")
        run.append(line)
        if any(c in low for c in CUES):
            cued = True
            yield line, len(line.split())
            for sentence in re.split(r"(?<=[.;!?])\s+", line):
                if len(sentence) < len(line) and any(c in sentence.lower().encode() for c in CUES):
                    yield sentence, len(sentence.split())


def own_licences(files: DataFrame, id_col: str, path_col: str, text_col: str, threshold: float, templates: list[tuple[str, str]]) -> DataFrame:
    """(id, path, own, own_score, is_file): the best licence that a file itself states, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        cache: dict[str, tuple[float, str | None]] = {}
        for batch in batches:
            own, scores, whole = [], [], []
            for path, text in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                stated, covered = [], 0
                text = text or b""
                low = text.lower()
                if any(c in low for c in CUES):
                    for block, words in _blocks(text):
                        if len(cache) > 100_000:
                            cache.clear()
                        found = cache.get(block) or cache.setdefault(block, known.best(block))
                        if found[0] >= threshold:
                            covered = max(covered, words)
                            stated.append(found)
                best = chosen(stated)
                own.append(best[1])
                scores.append(best[0] if best[1] else None)
                name = (path or "").rsplit("/", 1)[-1]
                whole.append(bool(best[1]) and (bool(LICENCE_FILE.search(name)) or 2 * covered >= len(text.split())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.string()), pa.array(scores, pa.float64()), pa.array(whole, pa.bool_())], names=["id", "path", "own", "own_score", "is_file"])

    picked = files.select(F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, path string, own string, own_score double, is_file boolean")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.6, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, path, own_licence, own_score, is_licence_file, licence, from_dir): one row per input row.

    A file's own licence is the template with the highest cosine to one of
    its cued lines, sentences or paragraphs, if at least ``threshold``; those that
    deny a licence ("not licensed under") do not count. Very long texts are
    read whole, line by line. A file that
    is little else, or is named like a licence file, also speaks for its
    directory: files without an own licence take that of the nearest ancestor
    directory (their own one first) that has such a file; the highest score
    there counts, then the smallest id. Null texts state nothing; null paths
    lie in no directory and inherit nothing; repeated rows stay. Ancestors are
    joined for distinct directories, not for files.
    """
    stated = own_licences(files, id_col, path_col, text_col, threshold, templates or TEMPLATES)
    stated = stated.withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    stated = written(stated, "licences")
    holders = stated.where("is_file and dir is not null").groupBy("dir").agg(F.max_by("own", F.struct("own_score", -F.coalesce("id", F.lit(2**62)))).alias("licence")).select(F.col("dir").alias("above"), "licence")
    parts = F.split("dir", "/")
    levels = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    folders = stated.where("dir is not null").select("dir").distinct()
    above = folders.select("dir", F.posexplode(levels).alias("depth", "above"))
    nearest = above.join(holders, "above").groupBy("dir").agg(F.max_by("licence", "depth").alias("inherited"), F.max_by("above", "depth").alias("from_dir"))
    done = stated.join(nearest, "dir", "left")
    takes = F.col("own").isNull() & F.col("inherited").isNotNull()
    return done.select("id", "path", F.col("own").alias("own_licence"), "own_score", F.col("is_file").alias("is_licence_file"), F.coalesce("own", "inherited").alias("licence"), F.when(takes, F.col("from_dir")).alias("from_dir"))
