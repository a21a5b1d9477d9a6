"""Find licence texts and notices in documents by diagonal voting.

Word k-grams of all documents are joined by hash with the k-grams of templates. A hit lies on the diagonal
``place in document - place in template``; hits of one diagonal vote for one copy of the template there, neighbouring
diagonals (words put in or left out) are merged, and a copy stands if enough of the template's words are covered by k-grams
whose words are equal, not only their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.llm.text_arrays import ALNUM, U64, shingles, texts
from boardfoot.plans.shared import materialize

# Phrases whose every place counts, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices and leading sentences of well-known licences.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
KS = (2, 3, 4)


def _grams(column: pa.Array) -> Iterator[tuple]:
    """Of each lot of texts: the lot, its words' starts, ends and rows, and for each k the hashes and first words of its k-grams."""
    for lot in texts(column):
        lot = lot.lowered()
        starts, ends, rows = lot.words(ALNUM)
        words = lot.hashes(starts, ends)
        found = {}
        for k in KS:
            n = max(0, len(words) - k + 1)
            first = np.flatnonzero(rows[:n] == rows[len(words) - n :]) if n else np.zeros(0, np.int64)
            found[k] = shingles(words, rows, k)[0], first
        yield lot, starts, ends, rows, found


def template_grams(phrases: dict[str, str], templates: dict[str, list[str]]) -> list[tuple]:
    """(template, label, base, words, k, place, hash, gram) for every k-gram of every phrase and template."""
    items = [(p, label, True) for p, label in phrases.items()] + [(t, label, False) for label, ts in templates.items() for t in ts]
    out = []
    for number, (text, label, base) in enumerate(items):
        for lot, starts, ends, rows, found in _grams(pa.array([text])):
            k = min(len(starts), max(KS))
            for h, first in zip(*found[k]):
                gram = b" ".join(lot.data[starts[i] : ends[i]].tobytes() for i in range(first, first + k)).decode()
                out.append((number, label, base, len(starts), k, int(first), int(h.astype(np.int64)), gram))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, least: float = 0.8, slack: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of licence copies in every text.

    documents: row (its number here), id and n_words, one a row of `docs`. spans: row, label, base, start and stop (words,
    stop not in it), n_words of the template and coverage (share of the template's words that equal k-grams cover). Phrases
    (base) must be covered whole; templates to `least`, over diagonals at most `slack` apart. Null and empty texts have no
    words; repeated rows are scanned each. The templates' k-grams are some hundreds of rows, whatever the input.
    """
    spark = docs.sparkSession
    grams = template_grams(phrases, templates)
    known = np.unique(np.array([g[6] for g in grams], np.int64).view(U64))
    bitmap = np.zeros(1 << 16, bool)
    bitmap[(known & U64(0xFFFF)).astype(np.int64)] = True
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    hit = pa.struct([("k", pa.int32()), ("at", pa.int64()), ("hash", pa.int64()), ("gram", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for lot, starts, ends, row, found in _grams(batch.column("text")):
                n = np.bincount(row, minlength=lot.rows)
                counts[lot.first : lot.first + lot.rows] = n
                begin = np.cumsum(n) - n
                for k, (h, first) in found.items():
                    maybe = np.flatnonzero(bitmap[(h & U64(0xFFFF)).astype(np.int64)])
                    maybe = maybe[np.isin(h[maybe], known)]
                    for i in maybe:
                        w = first[i]
                        gram = b" ".join(lot.data[starts[j] : ends[j]].tobytes() for j in range(w, w + k)).decode("utf-8", "replace")
                        hits[lot.first + row[w]].append({"k": k, "at": int(w - begin[row[w]]), "hash": int(h[i].astype(np.int64)), "gram": gram})
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), pa.array(hits, pa.list_(hit))], ["id", "n_words", "hits"])

    # Grams that no template has are left out here, as a join's runtime filter would; the join below settles the rest.
    scanned = rows.mapInArrow(scan, f"id {id_type}, n_words long, hits array<struct<k:int,at:long,hash:long,gram:string>>")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "licence-hits")
    table = spark.createDataFrame(grams, "template int, label string, base boolean, words int, k int, place int, hash long, gram string")
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    votes = hits.join(F.broadcast(table), ["k", "hash", "gram"]).withColumn("diagonal", F.col("at") - F.col("place"))
    diagonals = votes.groupBy("row", "template", "label", "base", "words", "k", "diagonal").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh = F.col("base") | gap.isNull() | (gap > slack)
    merged = diagonals.withColumn("copy", F.sum(fresh.cast("int")).over(order))
    merged = merged.groupBy("row", "template", "label", "base", "words", "k", "copy").agg(F.min("first").alias("start"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    coverage = covered / F.col("words")
    spans = merged.select("row", "label", "base", "start", (F.col("last") + F.col("k")).alias("stop"), F.col("words").alias("n_words"), coverage.alias("coverage"))
    return scanned.select("row", "id", "n_words"), spans.where((F.col("coverage") >= F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(least))))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_base (places of phrases), first_word and last_word (their smallest and largest
    start, or null), base_labels, labels (with those of templates; both sorted, '' if none) and score (the largest
    coverage, 0 if none)."""
    documents, spans = scan_licenses(docs, id_col, text_col)
    start = F.when(F.col("base"), F.col("start"))
    label = F.when(F.col("base"), F.col("label"))
    found = spans.groupBy("row").agg(F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"))
    out = documents.join(found, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
