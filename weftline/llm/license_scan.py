"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

Every line of every file, every 2 to ``JOINED`` lines of it that follow each other without one that holds no term, every
whole run of such lines, and every whole file of a licence file's name, is compared with short templates: a statement may be
wrapped, and a licence file is known by its title and opening lines. Weights are
(1 + ln tf) * idf with idf = ln((1 + N) / (1 + df)) + 1, where df counts all files that hold the term; a term of no template is
weighed like one that no file holds. A file's own licence is the template with the highest cosine of at least
``THRESHOLD`` on any of these. A licence file lends its licence to its directory; a file without a licence of its own
takes that of the nearest directory above it that has one. Ancestors are made from paths and matched by equi-joins.

Terms are the lower-cased (A-Z) runs of letters, digits, dots and bytes beyond ASCII. In Python only hashed terms of a
batch are handled, as arrays; the templates' terms are a fixed table of under 200.

Defined results: a null text has no terms; a null path is the root directory's; equal cosines go to the first template
name; two licence files of a directory: the higher cosine, then the smaller licence name; repeated rows are scanned one by
one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_batches, own_columns, staged, table
from weftline.llm.textarrays import U64, Texts, mixed, span_hashes

THRESHOLD = 0.7
JOINED = 8
LICENSE_NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"

# Names and header statements of common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD 3-Clause License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "CC0 1.0 Universal"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "The MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
}

TERM = np.zeros(256, bool)
TERM[[0x2E, *range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(texts: pa.Array) -> tuple[Texts, np.ndarray]:
    """A batch's terms and their hashes. Dots at a term's end are no part of it."""
    t = Texts(texts, TERM, lower=True)
    starts, ends = t.starts, t.ends.copy()
    while len(ends) and (dot := (t.data[ends - 1] == 0x2E) & (ends > starts)).any():
        ends -= dot
    t.ends = ends
    return t, span_hashes(t.data, starts, ends)


class Statements:
    """Every template statement as weights over the templates' terms."""

    def __init__(self) -> None:
        self.names = [k for k, lines in sorted(TEMPLATES.items()) for _ in lines]
        t, hashes = terms(pa.array([x for _, lines in sorted(TEMPLATES.items()) for x in lines]))
        self.vocabulary = np.unique(hashes)
        self.counts = np.zeros((t.n, len(self.vocabulary)))
        np.add.at(self.counts, (t.text, np.searchsorted(self.vocabulary, hashes)), 1)

    def matrix(self, idf: np.ndarray) -> np.ndarray:
        w = np.where(self.counts > 0, 1 + np.log(np.maximum(self.counts, 1)), 0) * idf
        return w / np.sqrt((w * w).sum(1, keepdims=True))


def _in(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return i, vocabulary[i] == hashes


def document_frequencies(files: DataFrame) -> tuple[int, np.ndarray]:
    """How many files there are, and how many hold each term of the templates: one sum for each term."""
    bounded_batches(files.sparkSession)
    vocabulary = Statements().vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary) + 1, np.int64)
        for b in batches:
            t, hashes = terms(b.column(0))
            i, known = _in(vocabulary, hashes)
            pairs = np.unique(t.text[known] * len(vocabulary) + i[known])
            seen[:-1] += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            seen[-1] += t.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["term", "n"])

    got = files.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    for r in got:
        counts[r["term"]] = r["n"]
    return int(counts[-1]), counts[:-1]


def _joined(gap: np.ndarray, weight: np.ndarray, known: np.ndarray, of_line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of several lines that could be statements: the first line and the last of each. gap: by line, whether it doesn't
    follow the one before; weight and known: of every distinct term of a line (of_line)."""
    n = len(gap)
    known2, unknown2 = [np.bincount(of_line[k], weight[k] ** 2, n) for k in (known, ~known)]
    run = np.cumsum(gap)
    first, last, sums, most = np.arange(n), np.arange(n), known2, unknown2
    out = []
    for k in range(2, JOINED + 1):
        first, last, sums, most = first[:-1], last[:-1] + 1, sums[:-1] + known2[k - 1 :], np.maximum(most[:-1], unknown2[k - 1 :])
        # 1 + ln(a + b) <= 1 + ln a + 1 + ln b, so a unit's known terms weigh k times those of its lines at most
        fine = (run[first] == run[last]) & (THRESHOLD**2 * most <= (1 - THRESHOLD**2 + 1e-9) * k * sums)
        out.append((first[fine], last[fine]))
    starts = np.flatnonzero(gap)
    ends = np.append(starts[1:], n) - 1
    long = ends - starts >= JOINED
    out.append((starts[long], ends[long]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def best_statements(texts: pa.Array, lines: bool, statements: Statements, idf: np.ndarray, unknown_idf: float) -> tuple[list[str | None], np.ndarray]:
    """For each text the best template and its cosine: over the text's lines and joined lines, or for the text as a whole."""
    t, hashes = terms(texts)
    text = t.text
    if lines and len(hashes):
        cuts = np.flatnonzero(t.data == 0x0A)
        place = np.searchsorted(cuts, t.starts) + text  # a new text is a new line too
        places, at, unit = np.unique(place, return_index=True, return_inverse=True)
        gap = np.concatenate(([True], (np.diff(places) > 1) | (np.diff(text[at]) > 0)))
        _, one, tf = np.unique(mixed(hashes ^ mixed(unit.astype(U64))), return_index=True, return_counts=True)
        term, known = _in(statements.vocabulary, hashes[one])
        weight = (1 + np.log(tf)) * np.where(known, idf[term], unknown_idf)
        first, last = _joined(gap, weight, known, unit[one])
        begin, end = at[first], np.append(at, len(unit))[last + 1]
        size = end - begin
        more = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        unit = np.concatenate((unit, np.repeat(len(places) + np.arange(len(first)), size)))
        hashes, text = np.concatenate((hashes, hashes[more])), np.concatenate((text, text[more]))
    else:
        unit = text
    units = int(unit.max()) + 1 if len(unit) else 0
    text_of = np.zeros(units, np.int64)
    text_of[unit] = text
    names, score = np.full(t.n, None, object), np.zeros(t.n)
    _, first, tf = np.unique(mixed(hashes ^ mixed(unit.astype(U64))), return_index=True, return_counts=True)
    term, known = _in(statements.vocabulary, hashes[first])
    rows, weight = unit[first], (1 + np.log(tf)) * np.where(known, idf[term], unknown_idf)
    norm2 = np.bincount(rows, weight**2, units)
    # no cosine is above the share of the known terms in the norm
    near = np.bincount(rows[known], weight[known] ** 2, units) >= (THRESHOLD**2 - 1e-9) * norm2
    of = np.flatnonzero(near)
    if not len(of):
        return names.tolist(), score
    row = np.cumsum(near) - 1
    use = known & near[rows]
    dense, norm = np.zeros((len(of), len(statements.vocabulary))), np.sqrt(norm2[of])
    dense[row[rows[use]], term[use]] = weight[use]
    cosine = dense @ statements.matrix(idf).T / norm[:, None]
    top = np.round(cosine, 9).argmax(1)
    best = cosine[np.arange(len(of)), top]
    for u in np.lexsort((top, -np.round(best, 9)))[::-1]:  # the best is written last
        if best[u] >= THRESHOLD:
            names[text_of[of[u]]], score[text_of[of[u]]] = statements.names[top[u]], round(float(best[u]), 9)
    return names.tolist(), score


def scan(files: DataFrame) -> DataFrame:
    """file_id, path, license and score of every file's own statement (null and 0 where it has none)."""
    own = own_columns(files, "file_id", "path", "text")
    n, df = document_frequencies(own)
    idf, unknown = np.log((1 + n) / (1 + df)) + 1, float(np.log(1 + n) + 1)
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statements = Statements()
        for b in batches:
            names, score = best_statements(b.column(2), True, statements, idf, unknown)
            whole = np.array([bool(re.match(LICENSE_NAMES, (p or "").rsplit("/", 1)[-1])) for p in b.column(1).to_pylist()], bool)
            for i, name, s in zip(np.flatnonzero(whole), *best_statements(b.column(2).filter(pa.array(whole)), False, statements, idf, unknown), strict=True):
                if name and s > score[i]:
                    names[i], score[i] = name, s
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], ["file_id", "path", "license", "score"])

    return own.mapInArrow(run, "file_id long, path string, license string, score double")


def _directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Every file with its own licence or the nearest directory's: license, score, license_from and basis."""
    found = staged(scanned, "licenses").withColumn("directory", _directory(F.col("path")))
    named = found.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_NAMES) & F.col("license").isNotNull())
    lent = named.groupBy("directory").agg(F.min(F.struct(-F.col("score"), "license")).alias("best"))
    lent = lent.select(F.col("directory").alias("license_from"), F.col("best.license").alias("lent"))
    depth = F.size(F.split("directory", "/"))
    above = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("directory", "/"), F.lit(1), k), "/"))
    # a directory is looked up once, however many files it holds
    places = found.where("license is null").select("directory").distinct().withColumn("license_from", F.explode(F.array_union(F.array(F.lit("")), above)))
    nearest = places.join(lent, "license_from").groupBy("directory").agg(F.max_by(F.struct("license_from", "lent"), F.length("license_from")).alias("near"))
    own = F.col("license").isNotNull()
    return found.join(nearest, "directory", "left").select(
        "file_id",
        "path",
        F.coalesce("license", "near.lent").alias("license"),
        "score",
        F.when(~own, F.col("near.license_from")).alias("license_from"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("basis"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """The documents table as a source tree: a directory for each source, language and hundred; each tenth is a licence file,
    some of them higher up."""
    top = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("-")), F.when(F.col("doc_id") % 40 != 0, F.coalesce("lang", F.lit("-"))), F.when(F.col("doc_id") % 20 != 0, (F.floor(F.col("doc_id") / 100)).cast("string")))
    name = F.concat(F.when(F.col("doc_id") % 10 == 0, "LICENSE.").otherwise("text."), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", top, name).alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inherit(scan(as_files(table(spark, sf_dir, "documents")))).withColumnRenamed("file_id", "doc_id")
