"""Licence scans: an exact set-similarity join of text blocks with licence templates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import growing, materialize, source_columns, texts

# Phrases that name a licence, and the beginnings of well-known notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Bytes of words after A-Z became a-z: digits, a-z and all of what is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Distinct words of all templates together; what is collected and broadcast is bounded by it.
MOST_WORDS = 20_000


@dataclass(frozen=True)
class Templates:
    """Word lists to look for.

    ``phrases`` (words to label) must stand word by word; of ``notices`` a share of at
    least ``percent`` of the distinct words must stand in one text block.
    """

    phrases: dict[str, str]
    notices: dict[str, str]
    percent: int = 80
    block: int = 64

    def __post_init__(self) -> None:
        if not all(text.split() for text in self.texts()) or not 0 < self.percent <= 100 or self.block < 1:
            raise ValueError("templates need words, a share of 1 to 100 percent and blocks of at least one word")
        if len(self.vocabulary()) > MOST_WORDS:
            raise ValueError(f"templates have more than {MOST_WORDS} distinct words")

    def texts(self) -> list[str]:
        return [*self.phrases, *self.notices]

    def vocabulary(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(sorted({w for text in self.texts() for w in text.split()}))}

    def needs(self) -> list[int]:
        """How many distinct words of each template a block must hold."""
        sizes = [len(set(text.split())) for text in self.texts()]
        return [size if k < len(self.phrases) else math.ceil(size * self.percent / 100) for k, size in enumerate(sizes)]

    def reach(self) -> int:
        """Words of a block; blocks start every ``block`` words, so any run as long as a template lies in one."""
        return self.block + max(len(text.split()) for text in self.texts()) - 1


LICENSES = Templates(PHRASES, NOTICES)


def word_lists(raw: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, from about ``most`` bytes at a time."""
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + most) if at + most < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield WORD.findall(raw, at, end)
        at = end


def template_words(docs: DataFrame, templates: Templates, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where words of the templates stand: one row for each document, one for each block that may match.

    (row, doc_id, n_words, block, places, tokens): ``row`` numbers the input rows;
    ``block`` is null on the document's own row.  Words outside the templates cannot
    count for any, so a block's set is made of template words alone, and blocks with
    fewer than the smallest need of them are left out.
    """
    vocabulary = {w.encode(): k for w, k in templates.vocabulary().items()}
    block, reach, least = templates.block, templates.reach(), min(templates.needs())

    def hits(raw: bytes) -> tuple[int, dict[int, list[tuple[int, int]]]]:
        n, blocks = 0, {}
        for words in word_lists(raw):
            for place, word in enumerate(words, n):
                token = vocabulary.get(word)
                if token is not None:
                    for k in range(max(0, (place - reach) // block + 1), place // block + 1):
                        blocks.setdefault(k, []).append((place, token))
            n += len(words)
        return n, blocks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, bounds = texts(batch.column(1))
            raw = data.tobytes().lower()
            out: list[tuple] = []
            for doc, start, stop in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n, blocks = hits(raw[start:stop])
                out.append((row, doc, n, None, [], []))
                for k, found in blocks.items():
                    if len({token for _, token in found}) >= least:
                        out.append((row, doc, n, k, [p for p, _ in found], [t for _, t in found]))
                row += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "doc_id", "n_words", "block", "places", "tokens"])

    rows = source_columns(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), text=F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(work, "row long, doc_id long, n_words long, block long, places array<long>, tokens array<int>")


def global_ranks(blocks: DataFrame, templates: Templates) -> list[int]:
    """The place of each template word in the global order: rarest over all blocks first.

    What is collected is one count for each distinct template word.
    """
    counted = blocks.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.token: r.n for r in counted.collect()}
    order = sorted(templates.vocabulary().values(), key=lambda token: (counts.get(token, 0), token))
    ranks = [0] * len(order)
    for rank, token in enumerate(order):
        ranks[token] = rank
    return ranks


def consecutive(phrase: Column, block: Column, size: int) -> Column:
    """First places of ``phrase`` (array of tokens) among ``places`` and ``tokens``, of starts that the block owns."""
    at = F.sequence(F.lit(0), F.size("places") - F.size(phrase))
    whole = lambda i: F.slice(F.col("tokens"), i + 1, F.size(phrase)) == phrase
    # Places ascend, so the first and the last tell whether no word lies between.
    joined = lambda i: F.col("places")[i + F.size(phrase) - 1] - F.col("places")[i] == F.size(phrase) - 1
    own = lambda i: F.col("places")[i] < (block + 1) * size
    starts = F.transform(F.filter(at, lambda i: whole(i) & joined(i) & own(i)), lambda i: F.col("places")[i])
    return F.when(F.size("places") >= F.size(phrase), starts).otherwise(F.array().cast("array<bigint>"))


def matching_blocks(blocks: DataFrame, templates: Templates) -> DataFrame:
    """(row, block, template, containment, starts): every block that holds enough words of a template.

    Exact prefix filter: with all sets in the global order, a template and a block that
    share ``need`` words share one within the template's first size - need + 1 and the
    block's first size - need + 1 words.  Length filter: a block needs ``need`` words.
    Positional filter: behind the match enough words must be left on both sides.
    A pair that passes is counted once, at its first common word.  The template side
    has at most one row for each template word (bounded by ``MOST_WORDS`` a template), so
    it is broadcast; blocks stay where they are.
    """
    ranks = global_ranks(blocks, templates)
    vocabulary, needs = templates.vocabulary(), templates.needs()
    index = []
    for k, text in enumerate(templates.texts()):
        words = [vocabulary[w] for w in text.split()]
        ordered = sorted({ranks[t] for t in words})
        index += [(rank, k, place, needs[k], ordered, words if k < len(templates.phrases) else None) for place, rank in enumerate(ordered[: len(ordered) - needs[k] + 1])]
    prefixes = blocks.sparkSession.createDataFrame(index, "rank int, template int, t_place int, need int, wanted array<int>, phrase array<int>")
    ranked = F.transform("tokens", lambda t: F.lit(ranks)[t])
    sets = blocks.withColumn("set", F.array_sort(F.array_distinct(ranked))).filter(F.size("set") >= min(needs))
    probes = F.posexplode(F.slice("set", F.lit(1), F.size("set") - F.lit(min(needs) - 1))).alias("b_place", "rank")
    found = sets.select("row", "block", "places", "tokens", "set", probes).join(F.broadcast(prefixes), "rank")
    enough = (F.size("set") >= F.col("need")) & (F.least(F.size("wanted") - F.col("t_place"), F.size("set") - F.col("b_place")) >= F.col("need"))
    shared = F.array_intersect("set", "wanted")
    found = found.filter(enough).withColumn("shared", shared).filter((F.size("shared") >= F.col("need")) & (F.array_min("shared") == F.col("rank")))
    starts = F.when(F.col("phrase").isNotNull(), consecutive(F.col("phrase"), F.col("block"), templates.block))
    return found.select("row", "block", "template", (F.size("shared") / F.size("wanted")).alias("containment"), starts.alias("starts"))


def scan(docs: DataFrame, templates: Templates = LICENSES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences named or quoted by each document.

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row
    for each input row.  Words are runs of digits, letters and all of what is not ASCII,
    A-Z lower-cased.  ``n_base`` counts all places of the phrases, ``first_word`` and
    ``last_word`` are their smallest and largest start (null without); ``labels`` adds those of
    notices whose words a block of the text holds to at least the share asked for.
    ``score``: 1 with a phrase, else the largest share found, else 0.  A null text is empty
    and has no words; rows that repeat a doc_id (or have none) are judged one by one.
    """
    marks = materialize(template_words(docs, templates, doc_id, text), "template_words")
    labels = F.array(*[F.lit(label) for label in [*templates.phrases.values(), *templates.notices.values()]])
    found = matching_blocks(marks.filter("block is not null"), templates)
    found = found.filter("starts is null or size(starts) > 0").withColumn("label", labels[F.col("template")])
    base = F.col("starts").isNotNull()
    found = found.groupBy("row").agg(
        F.sum(F.when(base, F.size("starts")).otherwise(0)).alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("containment").alias("score"),
    )
    sorted_text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    rows = marks.filter("block is null").select("row", "doc_id", "n_words")
    return rows.join(growing(found), "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        sorted_text("base_labels").alias("base_labels"),
        sorted_text("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
