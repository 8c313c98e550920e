"""License scans: an exact set-similarity join of text blocks with notice templates.

A template of ``L`` words is compared with every block of ``2 L`` words that starts with a template word (any other block
holds no more than the one that starts at its first template word, so no position is lost). A block matches if it holds
at least ``threshold`` of the template's distinct words, all of them if they are fewer than ``SHORT``, and the words that
tell the template from its kin (``REQUIRED``) among them. The join orders template words by their frequency in all texts, rarest first, and uses three filters that lose
nothing: a matching block holds one of the first ``size - need + 1`` words (prefix), it holds ``need`` template words at
all (length), and what stands after the first shared word in both orders must suffice (positional). Only blocks that
pass are compared. Templates are parameters, so their broadcast is bounded; texts are never shuffled.

Phrases are found as runs of words. Defined results: a null text is empty; no match gives empty labels and score 0; the
score is the largest containment of a match, 1 if a phrase was found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hallwatch.llm import words as W

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
}
#: words without which a notice is another one
REQUIRED = {"apache-2.0": "apache 2", "apache-2.0-header": "apache 2", "cc-by-nc": "cc by nc", "gpl-3.0": "gnu 3", "mit": "mit"}
THRESHOLD, SHORT = 0.8, 10


def tokens(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return W.hash_words(data, np.array([0, len(data)]), lower=True, separators=W.NOT_ALNUM)[0]


class Templates:
    """Words of all templates as numbers, and each template's words from rare to frequent."""

    def __init__(self, templates: Mapping[str, str], threshold: float, required: Mapping[str, str] = REQUIRED):
        self.names = sorted(n for n in templates if len(tokens(templates[n])))
        hashes = [tokens(templates[n]) for n in self.names]
        self.known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.length = [len(h) for h in hashes]
        self.members = [np.searchsorted(self.known, np.unique(h)) for h in hashes]
        self.need = [len(m) if len(m) < SHORT else max(1, math.ceil(threshold * len(m) - 1e-9)) for m in self.members]
        self.required = [self.number(np.unique(tokens(required.get(n, "")))) for n in self.names]
        self.order = np.arange(len(self.known))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words of no template."""
        if len(self.known) == 0:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def rank_by(self, frequency: np.ndarray) -> None:
        self.order = np.empty(len(self.known), np.int64)
        self.order[np.lexsort((np.arange(len(self.known)), frequency))] = np.arange(len(self.known))

    def matches(self, numbers: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, end, containment) of every matching block."""
        out, place = [], np.flatnonzero(numbers >= 0)
        codes, begins = numbers[place], np.cumsum(counts) - counts
        text = np.searchsorted(begins, place, "right") - 1
        for t, (length, members, need) in enumerate(zip(self.length, self.members, self.need)):
            inside = np.zeros(len(self.known), bool)
            inside[members] = True
            ranked = members[np.argsort(self.order[members])]
            rank = np.full(len(self.known), -1)
            rank[ranked] = np.arange(len(ranked))
            early = np.zeros(len(self.known), bool)
            early[ranked[:len(ranked) - need + 1]] = True
            mine = np.flatnonzero(inside[codes])
            if len(mine) < need:
                continue
            at, held_by, ranks = place[mine], text[mine], rank[codes[mine]]
            ends = np.minimum(at + 2 * length, (begins + counts)[held_by])
            upto = np.searchsorted(at, ends)  # each block holds the template words from its own to this one
            rare = np.r_[0, np.cumsum(early[codes[mine]])]
            blocks = np.flatnonzero((upto - np.arange(len(mine)) >= need) & (rare[upto] > rare[:-1]))
            for k in blocks:
                held = np.unique(ranks[k:upto[k]])  # template words of the block, rare to frequent
                if len(held) < need or 1 + min(len(ranked) - held[0] - 1, len(held) - 1) < need:
                    continue
                if not np.isin(rank[self.required[t]], held).all():
                    continue
                d = held_by[k]
                out.append((int(d), t, int(at[k] - begins[d]), int(ends[k] - begins[d]), len(held) / len(ranked)))
        return out


def frequencies(docs: DataFrame, templates: Templates, text: str) -> np.ndarray:
    """How often each template word stands in all texts."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.known), np.int64)
        for part in parts:
            h, _ = W.hash_words(*W.text_bytes(part.column(0)), lower=True, separators=W.NOT_ALNUM)
            at = templates.number(h)
            total += np.bincount(at[at >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])
    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(templates.known), np.int64)
    for r in counts.collect():  # a row per template word
        out[r["word"]] = r["n"]
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD, required: Mapping[str, str] = REQUIRED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches`` (template, words, containment)."""
    known = Templates(templates, threshold, required)
    known.rank_by(frequencies(docs, known, text))
    runs = [(tokens(p), label) for p, label in sorted(phrases.items())]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            h, counts = W.hash_words(*W.text_bytes(part.column(1)), lower=True, separators=W.NOT_ALNUM)
            owner, begins, n = W.owners(counts), np.cumsum(counts) - counts, part.num_rows
            base, found = [set() for _ in range(n)], [[] for _ in range(n)]
            starts = []
            for words, label in runs:
                size = len(h) - len(words) + 1
                if size <= 0:
                    continue
                fits = owner[:size] == owner[len(words) - 1:]
                for k, w in enumerate(words):
                    fits &= h[k:k + size] == w
                at = np.flatnonzero(fits)
                starts.append(at)
                for d in np.unique(owner[at]):
                    base[d].add(label)
            at = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
            n_base = np.bincount(owner[at], minlength=n)
            has = np.flatnonzero(n_base)
            upto = np.cumsum(n_base)
            first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first[has] = at[(upto - n_base)[has]] - begins[has]
            last[has] = at[upto[has] - 1] - begins[has]
            for d, t, a, z, share in known.matches(known.number(h), counts):
                found[d].append({"template": known.names[t], "first": a, "end": z, "containment": share})
            labels = [",".join(sorted(b | {m["template"] for m in f})) for b, f in zip(base, found)]
            score = [1.0 if b else max((m["containment"] for m in f), default=0.0) for b, f in zip(base, found)]
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), pa.array(n_base.astype(np.int64)), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(b)) for b in base], pa.string()),
                 pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template:string,first:bigint,end:bigint,containment:double>>")


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark.read.parquet(f"{folder}/documents.parquet")).drop("matches")
