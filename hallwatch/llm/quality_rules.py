"""Quality rules by distribution divergence.

A text's histograms of character classes and of common words are compared with references of every language by
Jensen-Shannon distance (base 2, so 0 to 1); the nearest language counts. References are means of the histograms of
all texts of a language that pass the base rules, taken twice: the second time without texts far from the first.

Common words of a language are those with at least ``COMMON`` of its words: chunks of texts name candidates so that no
such word is missed, and exact counts over all texts decide.

A text is rejected if its classes are over ``CHAR_LIMIT`` away, or both distances together over ``SUM_LIMIT``.
Guards: a text under ``MIN_CHARS`` characters skips both tests and one under ``MIN_WORDS`` words the second, whose limit
widens with one over the root of the number of words.

Defined results: a null text has no words and fails the base rule; without any language the base rule decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hallwatch.llm import batches as B, words as W
from hallwatch.operators.state_tables import discard, settle

COMMON = 1 / 250
LEAST_WORDS, REPEATED = 50, 50  # base rule: words, percent of words in repeated windows
MIN_CHARS, MIN_WORDS = 200, 50
TRIM = 0.14  # distance of classes up to which a text shapes the second references
CHAR_LIMIT, SUM_LIMIT, SLACK = 0.3, 0.32, 1.9  # a short text of good prose strays further: the sum may grow by SLACK / sqrt(words)
CLASSES = 10

_CLASS = np.full(256, 7, np.uint8)  # lower, upper, digit, space, line end, stop, other punctuation, symbol, beyond ASCII, control
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32] = 0, 1, 2, 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,"]] = 5
_CLASS[[ord(c) for c in ";:!?'\"()-"]] = 6
_CLASS[128:] = 8
_CLASS[[*range(0, 10), 11, 12, *range(14, 32), 127]] = 9
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(" \t\n\v\f\r"))
        else:
            seen.add(line)
    return n


def repeated_words(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words per text inside a 3-word window that occurs again in it."""
    keys, first = W.windows(hashes, counts, 3)
    text = W.owners(counts)
    order, starts, run = B.same_keys(W.mix(keys + text[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    size = np.diff(np.r_[starts, len(keys)])
    again = first[order[size[run] > 1]] if len(keys) else first
    covered = np.zeros(len(hashes) + 3, bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(text[covered[:len(text)]], minlength=len(counts))


def _common(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language the number of words, and the words that reach half of ``COMMON`` in a chunk."""
    for part in parts:
        names = part.column(1).dictionary_encode()
        lang, names = names.indices.to_numpy(), names.dictionary
        data, offsets = W.text_bytes(part.column(0))
        for i, j in W.chunks(offsets):
            h, counts = W.hash_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower=True)
            mine = lang[i:j][W.owners(counts)]
            for k in np.unique(mine):
                word, n = np.unique(h[mine == k], return_counts=True)
                often = n >= COMMON / 2 * n.sum()
                words = pa.array(np.r_[0, word[often].view(np.int64)], mask=np.arange(often.sum() + 1) == 0)
                yield pa.RecordBatch.from_arrays([pa.array([names[int(k)].as_py()] * len(words), pa.string()), words, pa.array(np.r_[n.sum(), n[often]])], names=["lang", "word", "n"])


def common_words(docs: DataFrame, text: str, lang: str) -> np.ndarray:
    """Hashes of all words that may be common in a language: ``2 / COMMON`` per language at most.

    A chunk that does not name a word holds less than half of ``COMMON`` of it, so a common word's named occurrences
    make up at least half of ``COMMON`` of all words."""
    named = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = settle(named.mapInArrow(_common, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.where("word is null").select("lang", F.col("n").alias("total"))
    words = counts.where("word is not null").join(totals, "lang").where(F.col("n") >= COMMON / 2 * F.col("total")).select("word").distinct().collect()
    discard(counts)
    return np.sort(np.array([r["word"] for r in words], np.int64).view(np.uint64))


def _features(column: pa.Array, known: np.ndarray) -> list[np.ndarray]:
    """Base counts, character classes and common words of each text."""
    data, offsets = W.text_bytes(column)
    out = [[np.zeros(0, np.int64)] * 5 + [np.zeros((0, CLASSES), np.int64), np.zeros((0, len(known)), np.int64)]]
    for i, j in W.chunks(offsets):
        piece, cuts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        h, counts = W.hash_words(piece, cuts, lower=True)
        raw, _ = W.hash_words(piece, cuts)
        lead = _LEAD[piece]
        owner = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(cuts))
        chars = np.bincount(owner[lead] * CLASSES + _CLASS[piece[lead]], minlength=(j - i) * CLASSES).reshape(j - i, CLASSES)
        hit, words = np.zeros(len(h), bool), np.zeros((j - i, 0), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            words = np.bincount(W.owners(counts)[hit] * len(known) + at[hit], minlength=(j - i) * len(known)).reshape(j - i, len(known))
        lines = [repeated_lines(piece[a:z].tobytes().decode()) for a, z in zip(cuts, cuts[1:])]
        out.append([counts, _per_text(lead & ~W.SPACES[piece], cuts), _per_text(_SYMBOLS[piece], cuts), np.array(lines, np.int64), repeated_words(raw, counts), chars, words])
    return [np.concatenate(c) for c in zip(*out)]


def features(docs: DataFrame, known: np.ndarray, doc_id: str, text: str, lang: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            flat = _features(part.column(1), known)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), pa.array(c.ravel().astype(np.int32))) for c in flat[5:]]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *[pa.array(c.astype(np.int64)) for c in flat[:5]], *lists], names=["doc_id", "lang", *_COUNTS, "chars", "words"])
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", chars array<int>, words array<int>")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)
    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def _matrix(part: pa.RecordBatch, column: str) -> np.ndarray:
    flat = part.column(column).flatten().to_numpy()
    return flat.reshape(part.num_rows, -1 if len(flat) else 0).astype(np.float64)


def _histograms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return part.column("n_words").to_numpy(), _matrix(part, "chars"), _matrix(part, "words")


def _shares(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    return x / np.maximum(total, 1)[:, None]


def _with_rest(words: np.ndarray, total: np.ndarray, use: np.ndarray) -> np.ndarray:
    picked = _shares(words[:, use], total)
    return np.c_[picked, 1 - picked.sum(1)]


class References:
    """Mean histograms per language; ``uses`` are the language's common words among the candidates."""

    def __init__(self, languages: list[str], chars: np.ndarray, words: np.ndarray, exact: np.ndarray):
        self.languages, self.chars = languages, chars
        self.uses = [np.flatnonzero(row >= COMMON) for row in exact]
        self.words = [np.r_[words[k, use], 1 - words[k, use].sum()] for k, use in enumerate(self.uses)]

    def nearest(self, n: np.ndarray, chars: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, distance of classes, distance of words) of the nearest language."""
        shares = _shares(chars, chars.sum(1))
        d_chars = np.stack([distance(shares, q) for q in self.chars], 1)
        d_words = np.stack([distance(_with_rest(words, n, use), q) for use, q in zip(self.uses, self.words)], 1)
        best = (d_chars + d_words).argmin(1)
        rows = np.arange(len(n))
        return best, d_chars[rows, best], d_words[rows, best]


def verdict(n_chars: np.ndarray, n_words: np.ndarray, d_chars: np.ndarray, d_words: np.ndarray) -> np.ndarray:
    fits = (n_chars < MIN_CHARS) | (d_chars <= CHAR_LIMIT)
    return fits & ((n_chars < MIN_CHARS) | (n_words < MIN_WORDS) | (d_chars + d_words <= SUM_LIMIT + SLACK / np.sqrt(np.maximum(n_words, 1))))


def references(rows: DataFrame, before: References | None = None) -> References | None:
    """From feature rows that pass the base rules (and are near ``before``)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            if part.num_rows == 0:
                continue
            n, chars, words = _histograms(part)
            use = np.ones(len(n), bool) if before is None else before.nearest(n, chars, words)[1] <= TRIM
            row = np.c_[np.ones(len(n)), n, _shares(chars, chars.sum(1)), _shares(words, n), words]
            names = np.array(part.column("lang").to_pylist(), object)
            for name in set(names[use]):
                sums[name] = sums.get(name, 0) + row[use & (names == name)].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"])
    passed = rows.where(~base_failed() & F.col("lang").isNotNull()).mapInArrow(run, "lang string, sums array<double>")
    totals = passed.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("total")).groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda x: x["total"]).alias("sums")).orderBy("lang").collect()
    if not totals:
        return before
    sums = np.array([r["sums"] for r in totals])
    size = (sums.shape[1] - 2 - CLASSES) // 2
    means = sums[:, 2:2 + CLASSES + size] / sums[:, :1]
    return References([r["lang"] for r in totals], means[:, :CLASSES], means[:, CLASSES:], sums[:, 2 + CLASSES + size:] / np.maximum(sums[:, 1:2], 1))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[np.ndarray, References | None, DataFrame]:
    """(common words, references, feature rows of all texts)."""
    known = common_words(docs, text, lang)
    rows = settle(features(docs, known, doc_id, text, lang))
    refs = references(rows)
    return known, references(rows, refs) if refs is not None else None, rows


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed, kept, nearest_lang, char_distance, word_distance``."""
    _, refs, rows = fit(docs, doc_id, text, lang)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, chars, words = _histograms(part)
            best, d_chars, d_words, good = [None] * len(n), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
            if refs is not None and len(n):
                k, d_chars, d_words = refs.nearest(n, chars, words)
                best, good = [refs.languages[x] for x in k], verdict(chars.sum(1), n, d_chars, d_words)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", *_COUNTS)], pa.array(good), pa.array(best, pa.string()), pa.array(d_chars), pa.array(d_words)],
                                             names=["doc_id", *_COUNTS, "good", "nearest_lang", "char_distance", "word_distance"])
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", good boolean, nearest_lang string, char_distance double, word_distance double"
    judged = rows.mapInArrow(run, schema)
    return judged.select("doc_id", *_COUNTS, base_failed().alias("base_failed"), (~base_failed() & F.col("good")).alias("kept"), "nearest_lang", "char_distance", "word_distance")


def passes(known: np.ndarray, refs: References | None, text: Column) -> Column:
    """The verdict on a text column."""
    @F.arrow_udf("boolean")
    def judged(column: pa.Array) -> pa.Array:
        n, _, _, _, again, chars, words = _features(column, known)
        good = (n >= LEAST_WORDS) & (100 * again <= REPEATED * n)
        if refs is not None and len(n):
            _, d_chars, d_words = refs.nearest(n, chars.astype(np.float64), words.astype(np.float64))
            good &= verdict(chars.sum(1), n, d_chars, d_words)
        return pa.array(good)
    return judged(text)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(spark.read.parquet(f"{folder}/documents.parquet"))
