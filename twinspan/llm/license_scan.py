"""License templates in documents, by MinHash bands over overlapping windows.

Templates are grouped by length. A group's windows are half as long again as its longest
template and step on by half of that, so every occurrence lies whole in one window. A window
and a template are compared if they agree in one of many bands of one sample; the number of
bands makes that all but certain for the least similarity an occurrence can have. Exact
containment of the template's shingles then decides. A template of fewer words than a shingle
has one shingle of all its words, which is looked up as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.llm.symbols import blocks, chained, mix, text_buffers, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
#: Probability that an occurrence shares no band with its template.
MISS = 1e-4
#: Longest template of a group over its shortest.
GROUP_SPREAD = 1.5

# Customary wordings by which texts name their license. License bodies, longer
# notices and phrases are in the files of FOLDER.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"),
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"),
    "mit": "Released under the MIT License",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at"),
}

FOLDER = Path(__file__).parent / "licenses"


def all_templates() -> dict[str, str]:
    """TEMPLATES and the files of FOLDER, which are read where the job starts."""
    return TEMPLATES | {f.stem: f.read_text() for f in sorted(FOLDER.glob("*.txt"))}


#: ASCII letters to lower case, ASCII punctuation to spaces; other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20


@dataclass(frozen=True)
class Group:
    """Templates of similar length, their windows and bands."""

    names: list[str]
    shingles: list[np.ndarray]
    window: int
    step: int
    bands: int


def _grams(values: np.ndarray, rows: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row's words, and where each row's begin; rows under ``width`` words have none."""
    counts = np.maximum(np.diff(rows) - width + 1, 0)
    begins = np.append(0, np.cumsum(counts))
    if not begins[-1]:
        return np.zeros(0, np.uint64), begins
    start = np.arange(begins[-1]) + np.repeat(rows[:-1] - begins[:-1], counts)
    return chained(values, width)[start], begins


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    return word_hashes(data, np.array([0, len(data)]))


def phrases(templates: dict[str, str]) -> dict[str, tuple[int, np.uint64]]:
    """Words and hash of each template of fewer words than a shingle; one without words is refused."""
    out = {}
    for name in sorted(templates):
        values, rows = _words(templates[name])
        if not len(values):
            raise ValueError(f"template {name} has no words")
        if len(values) < SHINGLE:
            out[name] = len(values), _grams(values, rows, len(values))[0][0]
    return out


def find_phrases(values: np.ndarray, rows: np.ndarray, wanted: dict[str, tuple[int, np.uint64]]) -> list[tuple[int, str, float, int]]:
    """(row, phrase, 1, first word) of each phrase in each row of a block, its first place."""
    out = []
    for width in sorted({w for w, _ in wanted.values()}):
        grams, begins = _grams(values, rows, width)
        for name, (w, own) in wanted.items():
            if w == width:
                places = np.flatnonzero(grams == own)
                row, first = np.unique(np.searchsorted(begins, places, side="right") - 1, return_index=True)
                out += [(int(r), name, 1.0, int(places[k] - begins[r])) for r, k in zip(row, first, strict=True)]
    return out


def groups(templates: dict[str, str]) -> list[Group]:
    """Groups of templates; those of fewer than five words are refused, they are phrases."""
    sized = []
    for name in sorted(templates):
        grams, _ = _grams(*_words(templates[name]))
        if not len(grams):
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        sized.append((len(grams) + SHINGLE - 1, name, np.unique(grams)))
    out: list[Group] = []
    sized.sort(key=lambda t: t[:2])
    while sized:
        members = [t for t in sized if t[0] <= GROUP_SPREAD * sized[0][0]]
        sized = sized[len(members) :]
        longest = members[-1][0]
        step = max(1, longest // 2)
        window = longest + step - 1
        in_window = window - SHINGLE + 1
        # The least similarity of a window that holds enough of the shortest template.
        shared = math.ceil(CONTAINMENT * len(members[0][2]))
        similarity = shared / (in_window + len(members[0][2]) - shared)
        bands = math.ceil(math.log(MISS) / math.log(1 - min(similarity, 0.999)))
        out.append(Group([m[1] for m in members], [m[2] for m in members], window, step, bands))
    return out


def _seed(k: int) -> np.uint64:
    return np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _windows(begins: np.ndarray, group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end shingle of each window; the last of a row ends with it."""
    counts = np.diff(begins)
    n = np.where(counts > 0, np.maximum(-(-(counts - (group.window - SHINGLE + 1)) // group.step), 0) + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    start = begins[row] + group.step * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    return row, start, np.minimum(start + group.window - SHINGLE + 1, begins[row + 1])


def find(values: np.ndarray, rows: np.ndarray, found_groups: list[Group]) -> list[tuple[int, str, float, int]]:
    """(row, template, containment, first word) of each template in each row of a block, its best window."""
    all_grams, all_begins = _grams(values, rows)
    counts = np.diff(all_begins)
    best: dict[tuple[int, str], tuple[float, int]] = {}
    for group in found_groups:
        # Rows with fewer shingles than the least match hold none of the group.
        enough = counts >= math.ceil(CONTAINMENT * min(map(len, group.shingles)))
        if not enough.any():
            continue
        kept = np.flatnonzero(enough)
        grams = all_grams if enough.all() else all_grams[np.repeat(enough, counts)]
        begins = np.append(0, np.cumsum(counts[kept]))
        row, start, end = _windows(begins, group)
        # Least hashes of steps first; windows overlap, so their ends interleave.
        edges = np.stack([start, end], axis=1).ravel()
        closed = edges[-1] == len(grams)
        retrieved = np.zeros((len(group.names), len(row)), bool)
        for k in range(group.bands):
            hashes = mix(grams ^ _seed(k))
            padded = np.append(hashes, hashes[-1:]) if closed or (edges == len(grams)).any() else hashes
            least = np.minimum.reduceat(padded, edges)[::2]
            for t, own in enumerate(group.shingles):
                retrieved[t] |= least == mix(own ^ _seed(k)).min()
        for t, w in zip(*np.nonzero(retrieved), strict=True):
            inside = np.isin(grams[start[w] : end[w]], group.shingles[t])
            share = len(np.unique(grams[start[w] : end[w]][inside])) / len(group.shingles[t])
            if share >= CONTAINMENT:
                key = (int(kept[row[w]]), group.names[t])
                first = int(start[w] + np.flatnonzero(inside)[0] - begins[row[w]])
                old = best.get(key)
                if old is None or (-share, first) < (-old[0], old[1]):
                    best[key] = (share, first)
    return [(r, name, share, first) for (r, name), (share, first) in sorted(best.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, template, containment DOUBLE, first_word LONG: the templates that each row holds.

    first_word counts the words before the best match, after punctuation became spaces; of equal
    matches the first counts. A row without a match, a null or an empty text gives no row;
    repeated and null ids are rows like others. Templates are a small parameter that goes to
    every task. Without any given, all_templates are looked for.
    """
    wanted = all_templates() if templates is None else templates
    short = phrases(wanted)
    found_groups = groups({name: text for name, text in wanted.items() if name not in short})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for low, high in blocks(offsets):
                values, rows = word_hashes(_FOLD[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low])
                found = sorted(find(values, rows, found_groups) + find_phrases(values, rows, short))
                if found:
                    row, name, share, first = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([low + r for r in row])), pa.array(name), pa.array(share), pa.array(first, pa.int64())],
                        ["doc_id", "template", "containment", "first_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id LONG, template STRING, containment DOUBLE, first_word LONG")
