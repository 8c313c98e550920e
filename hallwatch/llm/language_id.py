"""Language identification with a bit-sliced Bloom filter over character n-grams.

Learning counts 4-byte grams of letters per language over all training texts. A language *contains* a gram that makes up
at least ``LEAST`` of its grams and is not ``SHARE`` times rarer than in the language that uses it most; so a language
has at most ``1 / LEAST`` grams and the filter has a fixed bound. Slot ``h`` of the filter holds one bit per language;
a gram sets its languages' bits in ``HASHES`` slots, and the AND of these slots returns all languages containing it.

A text's grams are looked up, counted per language and corrected for that language's false positives (the share of its
bits that are set, to the power of the number of hashes). The largest corrected count decides; the score is its share.
How far it can be trusted does not depend on the number of languages: ``held`` is the largest count as a share of all
grams of the text, ``margin`` what it is ahead of the second language, as a share of them too.

Defined results: ``und`` with score 0 for a null text or one without a letter, or if nothing was learned; equal counts go
to the alphabetically first language; a text with letters but no known gram gets the most frequent language, score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hallwatch.llm import words as W
from hallwatch.operators.state_tables import discard, settle

WIDTH, LEAST, SHARE, HASHES, SLOTS_PER_GRAM = 4, 5e-6, 0.25, 3, 8
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint8)  # everything but letters is a space
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, its text) of all windows with two letters or more; texts are padded with a space on both sides."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    padded[np.arange(len(data)) + 2 * text + 1] = _LETTERS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    size = len(padded) - WIDTH + 1
    if size <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    letter = np.r_[0, np.cumsum(padded != 32, dtype=np.int32)]
    use = (owner[:size] == owner[WIDTH - 1:]) & (letter[WIDTH:] - letter[:size] >= 2)
    gram = np.zeros(size, np.uint32)
    for k in range(WIDTH):
        gram = gram << np.uint32(8) | padded[k:k + size]
    return gram[use], owner[:size][use]


@dataclass(frozen=True)
class Filter:
    languages: list[str]
    usual: str
    slots: np.ndarray  # (words of 64 languages, slots)
    false_rate: np.ndarray

    def places(self, gram: np.ndarray) -> list[np.ndarray]:
        h = W.mix(gram.astype(np.uint64) + np.uint64(1))
        step = h >> np.uint64(32) | np.uint64(1)
        mask = np.uint64(self.slots.shape[1] - 1)
        return [((h + np.uint64(k) * step) & mask).astype(np.int64) for k in range(HASHES)]

    def count(self, gram: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Grams of each text that each language contains, false positives taken off."""
        places, total, out = self.places(gram), np.bincount(text, minlength=texts), []
        for number in range(len(self.languages)):
            if number % 64 == 0:
                held = self.slots[number // 64][places[0]]
                for p in places[1:]:
                    held &= self.slots[number // 64][p]
            hits = np.bincount(text, held >> np.uint64(number % 64) & np.uint64(1), minlength=texts)
            rate = self.false_rate[number]
            out.append(np.maximum(hits - total * rate, 0) / max(1 - rate, 1e-9))
        return np.stack(out, 1) if out else np.zeros((texts, 0))


def _count_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        names = part.column("lang").dictionary_encode()
        codes, names = names.indices.to_numpy(), names.dictionary
        data, offsets = W.text_bytes(part.column("text"))
        for i, j in W.chunks(offsets):
            gram, text = grams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            keys, times = np.unique(codes[i:j][text].astype(np.uint64) << np.uint64(32) | gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array((keys >> np.uint64(32)).astype(np.int64))), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "n"])


def learn(labelled: DataFrame) -> Filter:
    """From ``text, lang`` (null languages are left out)."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = settle(counts)
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filter([], UNKNOWN, np.zeros((1, 1), np.uint64), np.zeros(0))
    sums = counts.sparkSession.createDataFrame([(name, float(totals[name])) for name in languages], "lang string, total double")
    shares = counts.join(F.broadcast(sums), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= LEAST)
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    kept = shares.join(best, "gram").where(F.col("share") >= SHARE * F.col("best")).select("lang", "gram").toArrow()
    discard(counts)
    number = {name: k for k, name in enumerate(languages)}
    code = np.array([number[x] for x in kept.column("lang").to_pylist()], np.int64)
    gram = kept.column("gram").to_numpy().astype(np.uint32)
    size = 1 << int(max(len(np.unique(gram)) * SLOTS_PER_GRAM, 2) - 1).bit_length()
    out = Filter(languages, max(languages, key=lambda x: (totals[x], [-ord(c) for c in x])), np.zeros((-(-len(languages) // 64), size), np.uint64), np.zeros(len(languages)))
    for place in out.places(gram):
        for w in range(len(out.slots)):
            mine = code // 64 == w
            np.bitwise_or.at(out.slots[w], place[mine], np.uint64(1) << (code[mine] % 64).astype(np.uint64))
    for k in range(len(languages)):
        out.false_rate[k] = float((out.slots[k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) ** HASHES
    return out


def _judge(own: Filter, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, score, held, margin) of each text; the number after the last language is ``und``."""
    data, offsets = W.text_bytes(column)
    pick, score, held, margin = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0)]
    for i, j in W.chunks(offsets):
        piece, cuts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        gram, text = grams(piece, cuts)
        counts, all_grams = own.count(gram, text, j - i), np.maximum(np.bincount(text, minlength=j - i), 1)
        letters = np.r_[0, np.cumsum((_LETTERS[piece] != 32) & (piece < 128))]
        lettered = letters[cuts[1:]] - letters[cuts[:-1]] > 0
        for k in np.flatnonzero(~lettered):
            lettered[k] = any(c.isalpha() for c in piece[cuts[k]:cuts[k + 1]].tobytes().decode("utf-8", "replace"))
        if not own.languages:
            pick.append(np.zeros(j - i, int))
            for x in (score, held, margin):
                x.append(np.zeros(j - i))
            continue
        total = counts.sum(1)
        best = np.where(total > 0, counts.argmax(1), own.languages.index(own.usual))
        pick.append(np.where(lettered, best, len(own.languages)))
        score.append(np.where(lettered & (total > 0), counts.max(1) / np.where(total > 0, total, 1), 0.0))
        ranked = np.sort(np.c_[np.zeros(j - i), counts], 1)
        held.append(np.where(lettered, ranked[:, -1] / all_grams, 0.0))
        margin.append(np.where(lettered, (ranked[:, -1] - ranked[:, -2]) / all_grams, 0.0))
    return np.concatenate(pick), np.concatenate(score), np.concatenate(held), np.concatenate(margin)


def language(model: Filter, text: Column) -> Column:
    """``struct<lang_pred, score, held, margin>`` of a text column."""
    shared = SparkSession.active().sparkContext.broadcast(model)  # languages / LEAST grams at most

    @F.arrow_udf("struct<lang_pred:string,score:double,held:double,margin:double>")
    def judged(column: pa.Array) -> pa.Array:
        at, *shares = _judge(shared.value, column)
        names = np.array([*shared.value.languages, UNKNOWN], object)
        return pa.StructArray.from_arrays([pa.array(names[at], pa.string()), *map(pa.array, shares)], names=["lang_pred", "score", "held", "margin"])
    return judged(text)


def identify(docs: DataFrame, model: Filter, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), language(model, F.col(text).cast("string")).alias("x")).select("doc_id", "x.lang_pred", "x.score")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = learn(docs.where(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
