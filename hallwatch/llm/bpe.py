"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

The vocabulary is a file of a public tokenizer (a path; never copied). Ids follow the merge order, so a pair of
neighbouring tokens is *compatible* when merging the symbols of both in that order never joins across their border; a
sequence whose neighbours are all compatible is the encoding. The encoder walks a word from the left: an Aho-Corasick
automaton gives the longest token at a place, an incompatible or dead-ended choice falls back to that token's longest
proper prefix that is a token, and dead places are remembered, so the work is linear in the word.

A word symbol is one byte of its UTF-8 form; the last symbol of a word also carries the end mark. Texts are split at
ASCII white space first, words met before come from a cache of bounded size.

Defined results: a null text is empty and has no tokens.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F


END = "</w>"
CACHE_WORDS, CACHE_LENGTH = 400_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.size = max(names) + 1
        # offset table: token i is names[offsets[i]:offsets[i + 1]]
        ordered = [names.get(i, "") for i in range(self.size)]
        self.table = "".join(ordered)
        self.offsets = np.cumsum([0, *map(len, ordered)]).tolist()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.white = regex.compile(r"\p{White_Space}+")
        self.letters = byte_letters()
        # symbols: a byte inside a word, or a byte that ends it; one character each
        letter = {c: b for b, c in enumerate(self.letters)}
        self.symbols, self.by_symbols = [""] * self.size, {}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        for token, i in self.ids.items():
            ends = token.endswith(END) and len(token) > len(END)
            body = [letter[c] for c in (token[:-len(END)] if ends else token)]
            if ends:
                body[-1] += 256
            self.symbols[i] = "".join(map(chr, body))
            self.by_symbols[self.symbols[i]] = i
        self.lengths = list(map(len, self.symbols))
        self.automaton = ahocorasick.Automaton()
        for s, i in self.by_symbols.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        assert all(self.ids[a + b] < self.ids[c + d] for (a, b), (c, d) in zip(merges, merges[1:])), "ids must follow the merge order"
        self.made = {(self.ids[a], self.ids[b]): self.ids[a + b] for a, b in merges}
        self.shorter = [-1] * self.size  # longest proper prefix that is a token
        for s, i in self.by_symbols.items():
            self.shorter[i] = next((self.by_symbols[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.by_symbols), -1)
        # every merge has one result, so a token has one pair of parts; single symbols have none
        self.halves = [(-1, -1)] * self.size
        for pair, made in self.made.items():
            self.halves[made] = pair
        self.fits: dict[tuple[int, int], bool] = {}
        self.word_ids: dict[str, bytes] = {}  # of words as they stand
        self.word_texts: dict[str, str] = {}
        self.known: dict[str, tuple[bytes, str]] = {}  # of pieces in lower case

    def compatible(self, a: int, b: int) -> bool:
        """Do two tokens stay apart when their symbols are merged in order?

        While merging runs, the border lies between a token on the right spine of ``a`` and one on the left spine of
        ``b``. Going back in time, the younger of the two is taken apart; a merge across the border that would have come
        before the step that ended the pair (on the left: before or at the same rank) is a conflict."""
        pair, until, fits = (a, b), self.size, True
        while True:
            across = self.made.get((a, b))
            if across is not None and across < until:
                fits = False
                break
            left, right = self.halves[a][1], self.halves[b][0]
            if left < 0 and right < 0:
                break
            if right < 0 or (left >= 0 and a > b):
                a, until = left, a
            else:
                b, until = right, b + 1
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[pair] = fits
        return fits

    def encode_symbols(self, s: str) -> list[int]:
        """Longest matches from the left; where one does not fit its neighbour, backtracking from there."""
        fits, compatible, lengths, shorter = self.fits, self.compatible, self.lengths, self.shorter
        matches = self.automaton.iter_long(s)
        _, token = next(matches)
        out, at = [token], lengths[token]
        for _, token in matches:
            fit = fits.get((out[-1], token))
            if fit is None:
                fit = compatible(out[-1], token)
            if not fit:
                break
            out.append(token)
            at += lengths[token]
        else:
            return out
        dead, token = set(), shorter[token]
        while True:
            while token >= 0:
                after = at + lengths[token]
                if after not in dead:
                    if not out:
                        break
                    fit = fits.get((out[-1], token))
                    if fit is None:
                        fit = compatible(out[-1], token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = after
                if at == len(s):
                    return out
                token = next(self.automaton.iter_long(s, at))[1]
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]

    def _piece(self, piece: str) -> tuple[bytes, str]:
        have = self.known.get(piece)
        if have is None:
            raw = piece.encode()
            ids = self.encode_symbols(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))
            have = array("I", ids).tobytes(), self.decode(ids) + " "
            if len(piece) <= CACHE_LENGTH:
                self.known[piece] = have
        return have

    def word(self, word: str) -> tuple[bytes, str]:
        """(packed ids, decoded text and a space) of a word without spaces or line ends."""
        if word.isascii():
            plain = word.lower()
        else:
            plain = "".join([c.lower() for c in self.white.sub(" ", unicodedata.normalize("NFC", word))])
        pieces = [plain] if plain.isascii() and plain.isalpha() else self.pieces.findall(plain)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        done = [self._piece(p) for p in pieces]
        return b"".join([d[0] for d in done]), "".join([d[1] for d in done])

    def decode(self, ids: list[int]) -> str:
        at, table = self.offsets, self.table
        return " ".join([table[at[i]:at[i + 1]] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """(packed ids, decoded text) of a whole text."""
        if self.marks is None or not self.marks.search(text):
            ids, decoded = self._plain(text)
        else:
            parts, at = [], 0
            for m in self.marks.finditer(text):
                parts += [self._plain(text[at:m.start()]), (array("I", [self.special[m[0]]]).tobytes(), m[0] + " ")]
                at = m.end()
            parts.append(self._plain(text[at:]))
            ids, decoded = b"".join([p[0] for p in parts]), "".join([p[1] for p in parts])
        return ids, decoded[:-1]

    def _plain(self, text: str) -> tuple[bytes, str]:
        words, ids, decoded = text.replace("\n", " ").split(" "), self.word_ids, self.word_texts
        fresh = set(words).difference(ids)
        for w in fresh:
            ids[w], decoded[w] = self.word(w)
        out = b"".join(map(ids.__getitem__, words)), "".join(map(decoded.__getitem__, words))
        for w in fresh:
            if len(w) > CACHE_LENGTH:
                del ids[w], decoded[w]
        for cache in (ids, decoded, self.known):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit numbers, packed), ``decoded``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in parts:
            done = [own.encode(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["doc_id", "ids", "decoded"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_texts(spark.read.parquet(f"{folder}/documents.parquet"), default_vocabulary())
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
