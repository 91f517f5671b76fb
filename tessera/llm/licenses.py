"""License detection by diagonal voting (operator 4).

The rolling k-word hashes of every text are joined with the positions of the
same hashes in license templates.  A match votes for its diagonal, text place
minus template place; votes are counted by diagonal.  A diagonal that covers
enough of the template stands for itself; of the others, neighbouring diagonals
(small insertions and deletions) are merged, over less than half the template's
length, so that one notice after another never becomes one long band.  A span is
accepted if it covers enough of the template within a span about as long.  Apart
from that, plain phrases give base counts and labels.

A text's task only emits hashes that a bit table of the templates' hashes lets
pass; the join then decides.  The template table is a parameter of checked size
and is the broadcast side.

Defined results: a null text is an empty one, without words, places or labels
(empty strings) and score 0; results depend on the text alone, so repeated rows
and null ids give a row each, and there are no ties; an empty table gives an
empty one; texts of any length are scanned whole; columns other than id and text
are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytekit as bk
from tessera.llm.runtime import checkpointed, ship

GRAM = 3
#: Most template positions; beyond it the templates are not small enough to broadcast.
MAX_POSITIONS = 1_000_000

_SALTS = 16

#: Base phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Opening or notice wording of public licenses, with labels (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chunk = bk.Chunk(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), "text")
    starts, ends, first = chunk.runs(bk.ALNUM_WORD)
    return chunk.span_hash(starts, ends, folded=True), first


def template_positions(templates: tuple[tuple[str, str], ...] = TEMPLATES, gram: int = GRAM) -> list[tuple[int, int, int, str, int]]:
    """Rows (hash, template, place, label, places of the template); a template needs gram words at least."""
    words, first = _words([text for _, text in templates])
    rows = []
    for t, (label, _) in enumerate(templates):
        grams = bk.ngram_hash(words[first[t] : first[t + 1]], gram).view(np.int64)
        rows += [(int(h), t, i, label, len(grams)) for i, h in enumerate(grams)]
    if len(rows) > MAX_POSITIONS:
        raise ValueError(f"{len(rows)} template positions; at most {MAX_POSITIONS} are broadcast")
    return rows


def _scan(df: DataFrame, id_col: str, text_col: str, grams: np.ndarray, gram: int) -> DataFrame:
    """By row: base results, the text's digest, and its rolling hashes that may be in a template."""
    ship(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hit = T.StructType([T.StructField("place", T.LongType()), T.StructField("hash", T.LongType())])
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("key", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")), T.StructField("base_labels", T.StringType()), T.StructField("hits", T.ArrayType(hit))])
    arrow_hit = pa.struct([("place", pa.int64()), ("hash", pa.int64())])
    phrases = []
    words, first = _words([p for p, _ in PHRASES])
    for i, (_, label) in enumerate(PHRASES):
        phrases.append((words[first[i] : first[i + 1]], label))
    bits = np.zeros(1 << 20, dtype=bool)
    bits[grams.view(np.uint64) >> np.uint64(44)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in bk.chunks(batches, "text"):
            starts, ends, first = chunk.runs(bk.ALNUM_WORD)
            words, row = chunk.span_hash(starts, ends, folded=True), bk.row_of(first)
            n_base, labels = np.zeros(chunk.rows, dtype=np.int64), [set() for _ in range(chunk.rows)]
            low, high = np.full(chunk.rows, 1 << 62), np.full(chunk.rows, -1)
            for phrase, label in phrases:
                n = len(phrase)
                at = np.flatnonzero(words[: max(0, len(words) - n + 1)] == phrase[0])
                for j in range(1, n):
                    at = at[words[at + j] == phrase[j]]
                at = at[row[at] == row[at + n - 1]]
                np.add.at(n_base, row[at], 1)
                np.minimum.at(low, row[at], at - first[row[at]])
                np.maximum.at(high, row[at], at - first[row[at]])
                for r in np.unique(row[at]):
                    labels[r].add(label)
            rolling = bk.ngram_hash(words, gram)
            at = np.flatnonzero(bits[rolling >> np.uint64(44)])
            at = at[row[at] == row[at + gram - 1]]
            edges = np.searchsorted(row[at], np.arange(chunk.rows + 1))
            hits = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(at - first[row[at]], pa.int64()), pa.array(rolling[at].view(np.int64), pa.int64())], fields=list(arrow_hit)))
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column(0), pa.array([hashlib.md5(chunk.text(r)).digest() for r in range(chunk.rows)], pa.binary()), pa.array(np.diff(first), pa.int64()), pa.array(n_base, pa.int64()), pa.array(low, pa.int64(), mask=none), pa.array(high, pa.int64(), mask=none), pa.array([",".join(sorted(x)) for x in labels], pa.string()), hits],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def votes(scanned: DataFrame, positions: DataFrame, slack: int = 4, coverage: float = 0.6, stretch: float = 1.5, gram: int = GRAM) -> DataFrame:
    """Verified spans: key, label, template, first, last, coverage."""
    hits = scanned.where(F.size("hits") > 0).dropDuplicates(["key"]).select("key", F.explode("hits").alias("hit")).select("key", "hit.place", "hit.hash")
    voted = hits.join(F.broadcast(positions), "hash").withColumn("diagonal", F.col("place") - F.col("template_place"))
    by_diagonal = voted.groupBy("key", "template", "label", "places", "diagonal").agg(F.collect_set("template_place").alias("covered"), F.min("place").alias("first"), F.max("place").alias("last"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    alone = F.size("covered") >= F.lit(coverage) * F.col("places")
    near = F.col("diagonal") - F.lag("diagonal").over(along) <= F.least(F.lit(slack), F.floor(F.col("places") / 2))
    starts = F.when(near & ~alone & ~F.lag(alone).over(along), 0).otherwise(1)
    merged = by_diagonal.withColumn("head", starts).withColumn("band", F.sum("head").over(along))
    spans = merged.groupBy("key", "template", "label", "places", "band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"), F.min("first").alias("first"), (F.max("last") + gram).alias("beyond"))
    fits = (F.col("n") >= F.lit(coverage) * F.col("places")) & (F.col("beyond") - F.col("first") <= F.lit(stretch) * (F.col("places") + gram - 1) + slack)
    return spans.where(fits).select("key", "label", "template", "first", "beyond", (F.col("n") / F.col("places")).alias("coverage"))


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """A row for each row of df: id, base results, labels and score."""
    spark: SparkSession = df.sparkSession
    rows = template_positions(templates, gram)
    positions = spark.createDataFrame(rows, "hash long, template int, template_place long, label string, places long")
    scanned = checkpointed(_scan(df, id_col, text_col, np.array([r[0] for r in rows], dtype=np.int64), gram))
    found = votes(scanned, positions, gram=gram).groupBy("key").agg(F.collect_set("label").alias("found"), F.max("coverage").alias("coverage"))
    # A text with very many copies is one key: its rows are dealt over salts.
    salted = scanned.drop("hits").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
    joined = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["key", "salt"], "left")
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
