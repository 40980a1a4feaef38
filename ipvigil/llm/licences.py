"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

Texts and templates are lower-case words, five in a shingle. Templates are classed by their number of shingles: up to
3, 6, 12 and so on. For a class of up to m the text is read in windows of 4/3 m shingles, a quarter of that apart, so
wherever a template stands, some window holds it whole. A window that holds 0.8 of a template has a Jaccard similarity
of at least 0.27 with it, and with 64 bands of one hash each they collide in all but 2 of 10^9 cases. Colliding pairs
are confirmed by counting: at least `threshold` of the template's shingles must stand in the window.

A window without any shingle of any template cannot collide and gets no signature. Everything happens in one pass over
the texts; the templates are a bounded list that is sent to the tasks. Shingles are told apart by 64-bit hashes.

Defined results: null and empty texts match nothing; a text or template of fewer than five words is one shingle;
templates without words match nothing; of several windows the best, then the first, counts.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ipvigil.llm import spans
from ipvigil.llm.decontaminate import tokenised
from ipvigil.llm.frames import free_name, map_text

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 64
#: Shingles of all templates together; more are refused, to be scanned for in groups.
MAX_SHINGLES = 1 << 20

# Notices by which public licenses are named or granted.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software '
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}

_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and where each text's shingles begin and end."""
    words = np.diff(first)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(words)), count)
    start = first[doc] + np.arange(bounds[-1]) - bounds[doc]
    out = np.zeros(len(start), np.uint64)
    for n in range(1, size + 1):
        own = np.minimum(words[doc], size) == n
        if own.any():
            out[own] = spans.mixed(spans.grams(hashes, n)[start[own]] + np.uint64(n))
    return out, bounds


def signature(values: np.ndarray) -> np.ndarray:
    """BANDS minima of each row of shingle hashes, whose length is a multiple of BANDS after hashing."""
    return np.stack([(values * f).min(axis=-1) for f in _FACTORS], axis=-1)


@dataclass
class Templates:
    names: list[str]
    sets: list[np.ndarray]
    signatures: np.ndarray
    window: np.ndarray
    every: np.ndarray


def prepared(templates: dict[str, str]) -> Templates:
    names = sorted(templates)
    values, bounds = shingles(*tokenised(pa.array([templates[n] for n in names], pa.string())))
    if len(values) > MAX_SHINGLES:
        raise ValueError(f"the templates have {len(values)} shingles, more than {MAX_SHINGLES}")
    sets = [np.unique(values[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    names, sets = [n for n, s in zip(names, sets, strict=True) if len(s)], [s for s in sets if len(s)]
    window = np.array([4 << max(int(np.ceil(np.log2(len(s) / 3))), 0) for s in sets], np.int64)
    signatures = np.array([signature(s) for s in sets], np.uint64).reshape(len(sets), BANDS)
    return Templates(names, sets, signatures, window, np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)])))


def found(values: np.ndarray, bounds: np.ndarray, known: Templates, threshold: float = THRESHOLD) -> list[list[tuple[str, float, int]]]:
    """(template, containment, first shingle of the window) per text, by template."""
    n = len(bounds) - 1
    out: list[dict[str, tuple[float, int]]] = [{} for _ in range(n)]
    at = np.minimum(np.searchsorted(known.every, values), max(len(known.every) - 1, 0))
    hits = np.flatnonzero(known.every[at] == values) if len(known.every) else np.zeros(0, np.int64)
    doc = np.searchsorted(bounds, hits, "right") - 1
    for width in np.unique(known.window).tolist():
        own = np.flatnonzero(known.window == width)
        step = width // 4
        last = (hits - bounds[doc]) // step
        windows = np.stack([np.repeat(doc, 4), (last[:, None] - np.arange(4)).ravel()], axis=1)
        windows = np.unique(windows[windows[:, 1] >= 0], axis=0)
        # a window that only repeats the end of the one before is left out, unless it is a text's first
        begin = bounds[windows[:, 0]] + windows[:, 1] * step
        end = np.minimum(begin + width, bounds[windows[:, 0] + 1])
        for i in range(0, len(begin), 4096):
            a, b = begin[i : i + 4096], end[i : i + 4096]
            place = np.minimum(a[:, None] + np.arange(width), b[:, None] - 1)
            inside = values[place]
            bands = signature(inside)
            for t in own.tolist():
                for w in np.flatnonzero((bands == known.signatures[t]).any(axis=1)).tolist():
                    share = float(np.isin(known.sets[t], inside[w]).mean())
                    d = int(windows[i + w, 0])
                    best = out[d].get(known.names[t])
                    if share >= threshold and (best is None or share > best[0]):
                        out[d][known.names[t]] = (share, int(a[w] - bounds[d]))
    return [sorted((k, *v) for k, v in x.items()) for x in out]


def scanned(
    docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text"
) -> DataFrame:
    """`keep`, then licences: name, containment and the window's first word of each template found in the text."""
    known = prepared(TEMPLATES if templates is None else templates)
    kind = T.ArrayType(
        T.StructType([
            T.StructField("name", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("word", T.LongType()),
        ])
    )
    arrow = pa.list_(pa.struct([("name", pa.string()), ("containment", pa.float64()), ("word", pa.int64())]))

    def compute(part: pa.RecordBatch) -> list:
        values, bounds = shingles(*tokenised(part.column(part.schema.get_field_index(text))))
        rows = [[dict(zip(("name", "containment", "word"), x, strict=True)) for x in r] for r in found(values, bounds, known, threshold)]
        return [pa.array(rows, arrow)]

    return map_text(docs, text, [T.StructField(free_name(docs, "licences"), kind)], compute, keep)
