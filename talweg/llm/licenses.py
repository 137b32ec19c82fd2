"""License scan by diagonal voting.

Rolling word k-gram hashes of every document are joined to template positions.
A hit votes for the diagonal (document position less template position);
neighbouring diagonals are merged, so that inserted or dropped words don't split
a match, and merged spans are verified by the longest chain of hits that rises
in both document and template.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from talweg.llm.common import mapped
from talweg.llm.words import NOT_ALNUM, Words, filled, signed, slices

#: Phrases that count wherever their words stand consecutively.
PHRASES: Mapping[str, str] = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Short notices by which a document names its licence.
NOTICES: Mapping[str, Sequence[str]] = {
    "agpl-3.0": ("licensed under the GNU Affero General Public License version 3",),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License",
    ),
    "cc-by-4.0": ("licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "gpl-2.0": ("licensed under the GNU General Public License, version 2",),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("licensed under the GNU Lesser General Public License",),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}
#: A k-gram of these words alone is too common to index for a notice.
COMMON = frozenset("a and any at by for in is of or that the this to with".split())
K = 2


def _grams(text: str) -> tuple[np.ndarray, list[str]]:
    w = Words(pa.array([text]), NOT_ALNUM)
    words = [bytes(w.body[a:b]).decode().lower() for a, b in zip(w.start, w.end, strict=True)]
    return w.grams(K)[0], words


def template_table(spark: SparkSession, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, Sequence[str]] = NOTICES) -> DataFrame:
    """(gram, label, template, at, grams, is_phrase): a row per indexed template position."""
    rows = []
    for is_phrase, group in ((True, {k: (v,) for k, v in phrases.items()}), (False, notices)):
        for label, texts in group.items():
            for text in texts:
                grams, words = _grams(text)
                if len(words) < K:
                    raise ValueError(f"a template needs {K} words or more: {text!r}")
                keep = [i for i in range(len(grams)) if is_phrase or not {*words[i : i + K]} <= COMMON]
                number = 1 + (rows[-1][2] if rows else -1)
                rows += [(int(signed(grams)[i]), label, number, i, len(keep), is_phrase) for i in keep]
    return spark.createDataFrame(rows, "gram long, label string, template int, at int, grams int, is_phrase boolean")


def longest_chain(hits: Sequence[tuple[int, int]]) -> tuple[int, int, int]:
    """Length, first and last document position of the longest chain of (document, template) places that rises in both."""
    tails: list[int] = []
    ends: list[tuple[int, int, int]] = []  # (document position, chain's first position, index of length)
    best: dict[int, tuple[int, int]] = {}
    for pos, at in sorted(hits, key=lambda h: (h[0], -h[1])):
        k = bisect_left(tails, at)
        first = best[k - 1][0] if k else pos
        if k == len(tails):
            tails.append(at)
        else:
            tails[k] = at
        best[k] = (first, pos)
        ends.append((pos, first, k))
    top = len(tails) - 1
    last, first, _ = next(e for e in ends if e[2] == top)
    return len(tails), first, last


_CHAIN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("hits", "first", "last")])


def _chains(hits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([longest_chain([(h["pos"], h["at"]) for h in x]) for x in hits], columns=["hits", "first", "last"], dtype="int32")


def document_grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, n_words, grams): ``mark`` digests the text, so that id and mark tell rows apart by content."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            for at, to in slices(texts):
                part = texts.slice(at, to - at)
                w = Words(part, NOT_ALNUM)
                grams, first = w.grams(K)
                marks = [xxhash.xxh3_128_digest(w.body[a:b].tobytes()) for a, b in zip(w.off[:-1], w.off[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(grams)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(marks, pa.binary()), pa.array(w.n.astype(np.int64)), lists], names=["id", "mark", "n_words", "grams"])

    schema = rows.select("id").schema.add("mark", T.BinaryType()).add("n_words", T.LongType()).add("grams", T.ArrayType(T.LongType()))
    return mapped(rows, scan, schema)


def matches(grams: DataFrame, templates: DataFrame, *, gap: int = 3, least: float = 0.75) -> DataFrame:
    """Verified spans: id, mark, label, is_phrase, first_word, last_word, coverage.

    A phrase must be whole on one diagonal. A notice's neighbouring diagonals
    (at most ``gap`` apart) are merged, and ``least`` of its indexed grams must
    lie on one rising chain no longer than twice the notice.
    """
    placed = grams.select("id", "mark", F.posexplode("grams").alias("pos", "gram"))
    hits = placed.join(F.broadcast(templates), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))  # the templates are fixed
    votes = hits.groupBy("id", "mark", "label", "template", "is_phrase", "grams", "diagonal").agg(F.collect_set(F.struct("pos", "at")).alias("hits"))
    exact = votes.filter(F.col("is_phrase") & (F.size("hits") == F.col("grams")))
    exact = exact.select("id", "mark", "label", "is_phrase", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("grams") + K - 2).alias("last_word"), F.lit(1.0).alias("coverage"))
    along = Window.partitionBy("id", "mark", "template").orderBy("diagonal")
    near = votes.filter("not is_phrase").withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > gap).cast("int"))
    near = near.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = near.groupBy("id", "mark", "label", "template", "grams", "run").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    merged = merged.filter(F.size(F.array_distinct(F.transform("hits", lambda h: h["at"]))) >= least * F.col("grams"))
    chained = merged.withColumn("chain", F.pandas_udf(_chains, _CHAIN)("hits")).withColumn("coverage", F.col("chain.hits") / F.col("grams"))
    chained = chained.filter((F.col("coverage") >= least) & (F.col("chain.last") - F.col("chain.first") < 2 * (F.col("grams") + K)))
    spans = chained.select("id", "mark", "label", F.lit(False).alias("is_phrase"), F.col("chain.first").alias("first_word"), (F.col("chain.last") + K - 1).alias("last_word"), "coverage")
    return exact.union(spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, Sequence[str]] = NOTICES, gap: int = 3, least: float = 0.75) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (array of label, is_phrase, first_word, last_word, coverage) in text order.

    Words are runs of letters and digits, A-Z lower-cased, bytes from 0x80 up
    counting as letters. Null and empty texts have no words and no spans;
    repeated rows each get their spans; null ids are an id like any other; an
    empty table gives no rows; other columns are not looked at.
    """
    grams = document_grams(docs, id_col, text_col)
    found = matches(grams, template_table(docs.sparkSession, phrases, notices), gap=gap, least=least)
    spans = found.groupBy(F.col("id").alias("of"), F.col("mark").alias("as")).agg(F.array_sort(F.collect_list(F.struct("first_word", "last_word", "label", "is_phrase", "coverage"))).alias("spans"))
    rows = grams.select("id", "mark", "n_words")
    joined = rows.join(spans, rows["id"].eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as")), "left")
    return joined.select("id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<first_word:int, last_word:int, label:string, is_phrase:boolean, coverage:double>>)")).alias("spans"))
