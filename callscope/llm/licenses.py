"""License scans: TF-IDF cosine of statements and licence files to templates, and inheritance.

Every run of lines and sentences of a whole text, and the text itself, is a sparse TF-IDF vector. A
run has at most RUN times its template's words: words of no template weigh no less than a notice's
own, so with as many of them again it's under the cut (common words might still pass). Whole licences over RUN_WORDS words are compared with whole
texts only. Of overlapping runs the nearest one is the statement. Inverse
document frequencies of the templates' terms are counted over all documents (terms of no template
get the weight of an unseen one). The best cosine over a licence's templates is its score. A text
that opens with a statement, or as a whole matches a template, is a licence file and speaks for its
directory. A document without a statement of its own takes the licence of its nearest ancestor
directory, found by joining each directory's ancestors with the directories that have one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, text_slices
from .license_texts import WHOLE

#: Public licence notices: fixed values.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
STATEMENT, FILE = 0.75, 0.75
CUT = min(STATEMENT, FILE)
RUN, RUN_WORDS = 2, 400

#: Lower case for ASCII letters; everything else in ASCII but digits is a gap.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENT = re.compile(rb"[^\n]+?(?:[.;!?](?=[\x20\t])|(?=\n)|\Z)|[^\n]+")


def tokens(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def inverse_frequencies(docs: DataFrame, text_col: str, templates: dict[str, list[str]]) -> tuple[dict[bytes, float], float]:
    """Weight of every template term, and the weight of an unseen term."""
    vocabulary = frozenset(t for group in templates.values() for text in group for t in tokens(text.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in text_slices(batch, 0):
                for text in as_bytes(part.column(0)):
                    counts.update(vocabulary.intersection(tokens(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    total = docs.count()
    seen = {bytes(t): n for t, n in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n")).collect()}
    weight = lambda n: math.log((1 + total) / (1 + n)) + 1.0
    return {t: weight(seen.get(t, 0)) for t in sorted(vocabulary)}, weight(0)


class Matcher:
    def __init__(self, templates: dict[str, list[str]], idf: dict[bytes, float], unseen: float):
        self.idf, self.unseen = idf, unseen
        self.templates = [(name, self.unit(tokens(text.encode()))) for name, group in templates.items() for text in group]
        self.sizes = [len(tokens(text.encode())) for group in templates.values() for text in group]
        self.holds: dict[bytes, list[tuple[int, float]]] = {}
        self.opens: dict[bytes, list[int]] = {}
        for i, (_, template) in enumerate(self.templates):
            for t in self.needed(template):
                self.opens.setdefault(t, []).append(i)
            for t, x in template.items():
                self.holds.setdefault(t, []).append((i, x * x))

    def needed(self, template: dict[bytes, float]) -> list[bytes]:
        """Its rarest terms, so many that a vector with none of them stays under the cut: a cosine is
        at most the length of the template's part on the terms it shares."""
        out, rest = [], 1.0
        for t in sorted(template, key=lambda t: (-self.idf[t], t)):
            if rest < CUT * CUT - 1e-9:
                break
            out.append(t)
            rest -= template[t] ** 2
        return out

    def near(self, words: list[bytes]) -> list[int]:
        """The templates that share enough terms for a cosine at the cut, with any counts."""
        known = self.holds.keys() & words
        if self.opens.keys().isdisjoint(known):
            return []
        mass: dict[int, float] = {}
        for t in known:
            for i, x in self.holds[t]:
                mass[i] = mass.get(i, 0.0) + x
        return sorted(i for i, x in mass.items() if x >= CUT * CUT - 1e-9)

    def runs(self, units: list[list[bytes]], near: list[int]) -> list[tuple[float, int, int, str]]:
        """(cosine, first unit, last unit, licence) of disjoint runs at the cut, the nearest first."""
        found = []
        for i in near:
            name, template = self.templates[i]
            if self.sizes[i] > RUN_WORDS:
                continue
            shares = [not template.keys().isdisjoint(u) for u in units]
            for a in range(len(units)):
                # a foreign unit at either end only lengthens the vector
                if not shares[a]:
                    continue
                counts: Counter[bytes] = Counter()
                dot, square, size = 0.0, 0.0, 0
                for b in range(a, len(units)):
                    size += len(units[b])
                    if b > a and size > RUN * self.sizes[i]:
                        break
                    for t in units[b]:
                        w = self.idf.get(t, self.unseen)
                        square += w * w * (2 * counts[t] + 1)
                        dot += template.get(t, 0.0) * w
                        counts[t] += 1
                    if shares[b] and dot >= STATEMENT * math.sqrt(square):
                        found.append((dot / math.sqrt(square), a, b, name))
        taken, used = [], set()
        for run in sorted(found, key=lambda x: (-round(x[0], 9), x[1], x[2], x[3])):
            if used.isdisjoint(range(run[1], run[2] + 1)):
                used.update(range(run[1], run[2] + 1))
                taken.append(run)
        return taken

    def unit(self, words: list[bytes]) -> dict[bytes, float]:
        vector = {t: n * self.idf.get(t, self.unseen) for t, n in Counter(words).items()}
        length = math.sqrt(math.fsum(x * x for x in vector.values()))
        return {t: x / length for t, x in vector.items()}

    def best(self, words: list[bytes]) -> tuple[float, str]:
        """(cosine, licence) of the nearest template, where one reaches the cut; ties to the first name."""
        near = self.near(words)
        if not near:
            return 0.0, ""
        vector = self.unit(words)
        scores = [(math.fsum(x * vector[t] for t, x in template.items() if t in vector), name) for name, template in map(self.templates.__getitem__, near)]
        return min(scores, key=lambda s: (-round(s[0], 9), s[1]))


def statements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """What each whole text itself says: id_col, path_col, license (null if nothing), score, offset
    (bytes before the best statement), n_statements, is_file."""
    templates = templates or {name: TEMPLATES.get(name, []) + WHOLE.get(name, []) for name in sorted({*TEMPLATES, *WHOLE})}
    idf, unseen = inverse_frequencies(docs, text_col, templates)
    picked = docs.select(F.col(text_col).alias("_text"), F.col(id_col), F.col(path_col))
    carried = picked.schema.fields[1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, idf, unseen)
        for batch in batches:
            for part in text_slices(batch, 0):
                rows = []
                for text in as_bytes(part.column(0)):
                    text = text or b""
                    found: list[tuple[float, int, str]] = []
                    whole = (0.0, "")
                    words = tokens(text)
                    near = matcher.near(words)
                    if near:
                        whole = matcher.best(words)
                        units = [(m.start(), u) for m in SEGMENT.finditer(text) if (u := tokens(m[0]))]
                        found = [(score, units[first][0], name) for score, first, _, name in matcher.runs([u for _, u in units], near)]
                    top = found[0] if found else None
                    opens = bool(found) and not text[: min(x[1] for x in found)].strip()
                    if whole[0] >= FILE and (not top or whole[0] > top[0]):
                        top = (whole[0], 0, whole[1])
                    rows.append((top and top[2], top and top[0], top and top[1], len(found), opens or whole[0] >= FILE))
                cols = list(zip(*rows, strict=True))
                types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [*[f.name for f in carried], "license", "score", "offset", "n_statements", "is_file"])

    return picked.mapInArrow(run, f"{schema}, license string, score double, offset bigint, n_statements bigint, is_file boolean")


def directory(path: Column) -> Column:
    """The part before the last slash; empty for a name at the top; null for a null path."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Licence of every document.

    Returns id_col, path_col, license, score, basis ('statement', 'directory' or null), from_dir (the
    directory that a licence is taken from) and n_statements. Where licence files of one directory
    disagree, the licence of most of them speaks, ties to the first name. Null and empty texts say nothing
    but inherit; a very long text is scored run by run and as a whole; a null path neither gives nor takes. Rows stay one to one (directories join, not
    documents); an empty table gives no rows; columns that are not named are ignored.
    """
    said = checkpointed(statements(docs, id_col, text_col, path_col, templates).withColumn("_dir", directory(F.col(path_col))))
    votes = said.where(F.col("is_file") & F.col("license").isNotNull() & F.col("_dir").isNotNull()).groupBy("_dir", "license").count()
    speaks = votes.groupBy("_dir").agg(F.min_by("license", F.struct(-F.col("count"), "license")).alias("_license"))
    dirs = said.where(F.col("license").isNull() & F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = dirs.select("_dir", F.posexplode(F.array_distinct(ups)).alias("_steps", "_up"))
    nearest = up.join(speaks.withColumnRenamed("_dir", "_up"), "_up").groupBy("_dir").agg(F.min_by(F.struct("_license", "_up"), "_steps").alias("_from"))
    out = said.join(nearest, "_dir", "left")
    taken = F.col("license").isNull()
    return out.select(
        id_col,
        path_col,
        F.coalesce("license", "_from._license").alias("license"),
        "score",
        F.when(~taken, "statement").when(F.col("_from").isNotNull(), "directory").alias("basis"),
        F.when(taken, F.col("_from._up")).alias("from_dir"),
        "n_statements",
    )
