"""Fill-in-middle transformation with a wavelet matrix over character classes.

Every byte of a text has a class of three bits: it begins a code point, it belongs to a word, it ends a token. A token is
white space and the word after it; white space at the end of a text is a token of its own. A wavelet matrix over the
classes of all texts of a chunk answers how many bytes of a class stand before any place. The classes that end a token
(ASCII or longer last character of a word, last white space of a text) have their ranks added to a boundary count; the
place of both cuts is found by bisection on that count, for all texts at once, and the code points before a cut are the
rank of the classes that begin one. Texts stay whole, nothing is shuffled.

Cuts and forms come from a hash of the seed and the id, so a rerun gives the same output. ``restore`` reads the text
back from output and form: no text that contains a mark is transformed, and neither the marks nor a piece of text next to
one can spell another mark.

Defined results: a null text is empty and plain; rows that share an id share its hash; a null id hashes like no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hallwatch.llm import words as W

MARKS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
SEED, RATE, SPM = 42, 50, 80
LEAD, WORD, END = 4, 2, 1
ENDS = (LEAD | WORD | END, WORD | END, LEAD | END)


class WaveletMatrix:
    """Ranks of small numbers in an array, a bit per level, highest first; zeros of a level come before its ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size, self.levels = bits, len(symbols), []
        for b in range(bits - 1, -1, -1):
            ones = (symbols >> b & 1).astype(bool)
            lanes = np.zeros(len(symbols) // 64 + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            lanes.view(np.uint8)[:len(raw)] = raw
            before = np.r_[0, np.cumsum(np.bitwise_count(lanes).astype(np.int64))]
            self.levels.append((lanes, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, place: np.ndarray) -> np.ndarray:
        lanes, before, _ = self.levels[level]
        lane, bit = place >> 6, (place & 63).astype(np.uint64)
        return before[lane] + np.bitwise_count(lanes[lane] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbol: int, place: np.ndarray, bits: int | None = None) -> np.ndarray:
        """How many of the first ``place`` entries are ``symbol``; with ``bits``, agree with it in so many highest bits."""
        start, place = np.zeros(1, np.int64), np.asarray(place, np.int64)
        for level in range(self.bits if bits is None else bits):
            zeros = self.levels[level][2]
            if symbol >> (self.bits - 1 - level) & 1:
                start, place = zeros + self._ones(level, start), zeros + self._ones(level, place)
            else:
                start, place = start - self._ones(level, start), place - self._ones(level, place)
        return place - start


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of every byte of texts laid end to end."""
    space = W.SPACES[data]
    closes = np.zeros(len(data) + 1, bool)
    closes[offsets[1:][np.diff(offsets) > 0] - 1] = True
    closes = closes[:-1]
    before_space = np.r_[space[1:], False]
    end = closes | (~space & before_space)
    return ((data & 0xC0) != 0x80) * np.uint8(LEAD) | ~space * np.uint8(WORD) | end * np.uint8(END)


class Boundaries:
    """Token counts, cuts and code points of a chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last = offsets[:-1], offsets[1:]
        self.matrix = WaveletMatrix(classes(data, offsets), 3)
        self.base = self.before(self.first)
        self.tokens = self.before(self.last) - self.base

    def before(self, place: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, place) for c in ENDS)

    def cut(self, count: np.ndarray) -> np.ndarray:
        """Place after the first ``count`` tokens of each text: the least with so many ends before it."""
        low, high, want = self.first.copy(), self.last.copy(), self.base + count
        while (low < high).any():
            middle = (low + high) // 2
            enough = self.before(middle) >= want
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.matrix.rank(LEAD, end, 1) - self.matrix.rank(LEAD, start, 1)


def _transform(rate: int, spm: int):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    prefix, suffix, middle = (m.encode() for m in MARKS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text")
            marked = np.zeros(part.num_rows, bool)
            for m in MARKS:
                marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
            h1, h2, h3, h4 = (part.column(f"h{k}").to_numpy() for k in range(1, 5))
            data, offsets = W.text_bytes(texts)
            plain = marked | (h3 % 100 >= rate) | (np.diff(offsets) == 0)
            form = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
            n, before, inside = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            out: list[bytes] = []
            for i, j in W.chunks(offsets):
                raw = data[offsets[i]:offsets[j]]
                held = Boundaries(raw, offsets[i:j + 1] - offsets[i])
                n[i:j] = held.tokens
                a, b = h1[i:j] % (held.tokens + 1), h2[i:j] % (held.tokens + 1)
                a, b = held.cut(np.minimum(a, b)), held.cut(np.maximum(a, b))
                before[i:j], inside[i:j] = held.chars(held.first, a), held.chars(a, b)
                raw = raw.tobytes()
                for k, lo, x, y, hi in zip(range(i, j), held.first.tolist(), a.tolist(), b.tolist(), held.last.tolist()):
                    if plain[k]:
                        out.append(raw[lo:hi])
                    elif form[k] == "psm":
                        out.append(b"".join((prefix, raw[lo:x], suffix, raw[y:hi], middle, raw[x:y])))
                    else:
                        out.append(b"".join((suffix, raw[y:hi], prefix, raw[lo:x], middle, raw[x:y])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(before, mask=plain), pa.array(inside, mask=plain),
                                              pa.array(out, pa.binary()).cast(pa.string())], names=names)
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``; ``rate`` of 100 texts change form, ``spm`` of 100 of them
    put the suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", *[F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])
    return rows.mapInArrow(_transform(rate, spm), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed."""
    prefix, suffix, middle = MARKS

    def after(c: Column, mark: str, head: Column) -> Column:
        return F.substr(c, F.length(head) + len(mark) + 1)

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = after(rest, second, one)
        two = F.substring_index(rest, middle, 1)
        return one, two, after(rest, middle, two)
    p, s, m = pieces(prefix, suffix)
    s2, p2, m2 = pieces(suffix, prefix)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def op11_wavelet_fim(spark: SparkSession, folder: str) -> DataFrame:
    done = fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
tokens AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
         ('0x' || x[1:8])::UBIGINT AS h1, ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3, ('0x' || x[25:32])::UBIGINT AS h4 FROM hashed),
cuts AS (
  SELECT *, len(t)::BIGINT AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1))::BIGINT AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1))::BIGINT AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
pieces AS (
  SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS p, coalesce(array_to_string(t[a + 1:b], ''), '') AS m, coalesce(array_to_string(t[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces"""
