"""LM scoring with a probabilistic suffix tree over the running words of texts.

A text is a sequence of word tokens between a start and an end mark. The next token depends on the longest retained
context: up to ``ORDER`` preceding tokens of the text, the start mark among them (``context_tree``). Without a context a
word has its own count, interpolated by one pseudo count per distinct word with the probability of its spelling: a
second tree of the same form over the bytes of distinct words, weighted by their counts (contexts of up to ``DEPTH``
symbols; add-one at its root), which is all that an unseen word has. So the score is a true probability of any text.

All counts are exact over all training texts. Texts are dealt once into batches, which become cells of the word tree; the
distinct words of a batch meet in vocabulary buckets, which become cells of the spelling tree and answer with each
word's number, count and probability. The driver sees the counts of the 259 symbols and a few totals.

Defined results: a null text is empty, its only token is the end; rows with a null id belong to the training part and are
dealt by their place in the input, so a third of all rows on one null id or one text still spreads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hallwatch.llm import batches as B, words as W
from hallwatch.llm.context_tree import CELLS, expand, score_units, squeeze
from hallwatch.operators.state_tables import discard, settle

DEPTH, ORDER = 8, 4
START, STOP, SYMBOLS = 257, 258, 258  # a byte is 1 to 256
FIRST_WORD = 3  # ids of the word tree: 1 starts a text, 2 ends it

#: a batch (``tokens``: number of the distinct word at each place, in the order of vocabulary buckets) or what it sends to one
_SENT = "batch int, bucket int, tokens binary, counts binary, sizes binary, doc_id array<bigint>, held_out array<boolean>, keys binary, times binary, stands binary, lengths binary, spelled binary"
_ANSWER = "batch int, bucket int, numbers binary, times binary, stands binary, logs binary"


def _row(schema: pa.Schema, found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(found, schema)


_SENT_TYPES = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                         *((c, pa.binary()) for c in ("keys", "times", "stands", "lengths", "spelled"))])
_ANSWER_TYPES = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("numbers", "times", "stands", "logs"))])


def _gather(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some spans, one after another."""
    index = np.repeat(starts - (np.cumsum(size) - size), size)
    index += np.arange(len(index))
    return data[index]


def _send(buckets: int):
    """A batch as numbers of its distinct words, and these words to their buckets."""
    def send(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        table = B.in_order(table, "doc_id", "text")
        data, offsets = W.text_bytes(table.column("text"))
        data = W.LOWER[data]
        hashes, counts, starts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in W.chunks(offsets):
            part = data[offsets[i]:offsets[j]]
            a, z, n = W.spans(part, offsets[i:j + 1] - offsets[i])
            hashes.append(W.hash_spans(part, a, z))
            counts.append(n)
            starts.append(a + offsets[i])
            sizes.append(z - a)
        keys, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        counts, starts, sizes = np.concatenate(counts), np.concatenate(starts)[first], np.concatenate(sizes)[first]
        held = table.column("held_out").to_numpy()
        stands = np.bincount(which, minlength=len(keys)).astype(np.int64)
        times = np.bincount(which[np.repeat(~held, counts)], minlength=len(keys)).astype(np.int64)
        order, bounds = B.split(keys, buckets)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        out = [{"batch": batch, "tokens": squeeze(place[which]), "counts": squeeze(counts), "sizes": squeeze(np.diff(bounds)), "doc_id": table.column("doc_id").to_pylist(), "held_out": held.tolist()}]
        for b in np.flatnonzero(np.diff(bounds)):
            cut = order[bounds[b]:bounds[b + 1]]
            out.append({"batch": batch, "bucket": int(b), "keys": B.pack(keys[cut]), "times": squeeze(times[cut]), "stands": squeeze(stands[cut]), "lengths": squeeze(sizes[cut]), "spelled": squeeze(_gather(data, starts[cut], sizes[cut]))})
        return _row(_SENT_TYPES, out)
    return send


def _bucket(table: pa.Table):
    """(words each batch sent, word of each entry, counts in training and in all, bytes and sizes of each word)."""
    packed = B.binaries(table, "keys")
    times, stands, sizes, data = (np.concatenate([expand(x) for x in B.binaries(table, c)]) for c in ("times", "stands", "lengths", "spelled"))
    order, starts, run = B.same_keys(np.concatenate([B.unpack(k) for k in packed]))
    word = np.empty(len(order), np.int64)
    word[order] = run
    one = order[starts]
    return ([len(k) // B.KEY_BYTES for k in packed], word, np.add.reduceat(times[order], starts), np.add.reduceat(stands[order], starts),
            _gather(data.astype(np.uint8), np.cumsum(sizes)[one] - sizes[one], sizes[one]), sizes[one])


def symbols(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all words, their word, place in the word); each word is start, bytes, stop."""
    full = sizes + 2
    ends = np.cumsum(full)
    out = np.full(int(full.sum()), STOP, np.int64)
    out[ends - full] = START
    word = np.repeat(np.arange(len(sizes)), full)
    place = np.arange(len(out)) - (ends - full)[word]
    inner = (place > 0) & (place < full[word] - 1)
    out[inner] = data.astype(np.int64) + 1
    return out, word, place


def _words(table: pa.Table) -> pa.Table:
    """Totals of a vocabulary bucket, and its words as a cell of the spelling tree, as yet without its constants."""
    _, _, times, _, data, sizes = _bucket(table)
    sym, word, place = symbols(data, sizes)
    use = place > 0
    before = np.flatnonzero(use) - 1
    return pa.table({"cell": table.column("bucket")[:1], "words": pa.array([int((times > 0).sum())], pa.int64()), "total": pa.array([int(times.sum())], pa.int64()),
                     "symbols": pa.array([np.bincount(sym[use], times[word[use]], minlength=SYMBOLS + 1)], pa.list_(pa.float64())),
                     "before": pa.array([np.bincount(sym[before], times[word[before]], minlength=SYMBOLS + 1)], pa.list_(pa.float64())),
                     "standing": pa.array([np.bincount(sym[before], minlength=SYMBOLS + 1)], pa.list_(pa.float64())),
                     "tokens": pa.array([squeeze(sym)], pa.binary()), "sizes": pa.array([squeeze(sizes + 2)], pa.binary()), "weights": pa.array([squeeze(times)], pa.binary())})


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


def score_texts(docs: DataFrame) -> DataFrame:
    """``docs`` has ``doc_id, text, held_out``; returns the scores of every row, learned from those not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    parts = B.batch_count(docs)
    batch = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    sent = settle(docs.withColumn("batch", batch).groupBy("batch").applyInArrow(_send(parts), _SENT), wide=True)
    texts = sent.where("bucket is null")
    asked = sent.where("bucket is not null").drop("tokens", "counts", "sizes", "doc_id", "held_out")
    vocabulary = settle(asked.groupBy("bucket").applyInArrow(_words, "cell int, words long, total long, symbols array<double>, before array<double>, standing array<double>, tokens binary, sizes binary, weights binary"), wide=True)
    known = vocabulary.agg(F.sum("words").alias("words"), F.sum("total").alias("total")).first()
    each = vocabulary.select(F.posexplode(F.arrays_zip("symbols", "before", "standing")).alias("symbol", "n")).groupBy("symbol").agg(*[F.sum(f"n.{c}").alias(c) for c in ("symbols", "before", "standing")])
    root, before, standing = (np.zeros(SYMBOLS + 1) for _ in range(3))
    for r in each.collect():  # a row per symbol
        root[r["symbol"]], before[r["symbol"]], standing[r["symbol"]] = r["symbols"], r["before"], r["standing"]
    flags = texts.select(F.explode("held_out").alias("held_out")).agg(F.count_if(~F.col("held_out")).alias("train"), F.count(F.lit(1)).alias("all")).first()
    n_texts, n_words, distinct = flags["train"], known["total"] or 0, known["words"] or 0
    n_tokens, n_kinds = n_words + n_texts, distinct + (n_texts > 0)
    first = np.log((root + 1) / (root.sum() + SYMBOLS))
    first[START] = np.nan
    constants = [F.lit(squeeze(x)).alias(c) for c, x in (("ids", np.arange(SYMBOLS + 1) + 1), ("first", first.astype(np.float32)), ("times", before.astype(np.int64)), ("stands", standing.astype(np.int64)))]
    words = settle(vocabulary.select("cell", "tokens", "sizes", "weights", *constants), wide=True)
    discard(vocabulary)
    spelled = settle(score_units(words, DEPTH, float(root.sum()), parts), wide=True)
    discard(words)
    floor = float(np.log10(n_tokens + n_kinds + 1))
    end_p, word_p = ((x / (n_tokens + 2)) for x in (n_texts + 1, n_words + 1))
    pseudo = max(distinct, 1)

    def answer(table: pa.Table, spellings: pa.Table) -> pa.Table:
        if len(table) == 0:
            return _row(_ANSWER_TYPES, [])
        here = table.column("bucket")[0].as_py()
        entries, word, times, stands, _, _ = _bucket(table)
        with np.errstate(divide="ignore"):
            log_p = np.logaddexp(np.log(times), np.log(pseudo) + np.log(10.0) * spellings.column("scores")[0].values.to_numpy()) + np.log(word_p / (n_words + pseudo))
        frequent = np.empty(len(times), np.int64)
        frequent[np.argsort(-stands, kind="stable")] = np.arange(len(times))
        number, cuts = FIRST_WORD + frequent * parts + here, np.cumsum([0, *entries])
        return _row(_ANSWER_TYPES, [{"batch": b, "bucket": here, "numbers": squeeze(number[w]), "times": squeeze(times[w]), "stands": squeeze(stands[w]), "logs": squeeze(log_p[w].astype(np.float32))}
                                    for b, w in zip(table.column("batch").to_pylist(), (word[a:z] for a, z in zip(cuts, cuts[1:])))])

    def open_cell(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in table.to_pylist():
            answers = B.in_order(answers, "bucket")
            number, times, stands, log_p = (np.concatenate([np.zeros(0, np.int64), *[expand(x) for x in B.binaries(answers, c)]]) for c in ("numbers", "times", "stands", "logs"))
            which, counts = expand(row["tokens"]), expand(row["counts"])
            text, n, held = W.owners(counts), len(counts), np.array(row["held_out"], bool)
            ends = np.cumsum(counts + 2)
            token = np.ones(int(ends[-1]), np.int64)  # local: 0 starts a text, 1 ends it
            inner = np.ones(len(token), bool)
            inner[ends - counts - 2] = inner[ends - 1] = False
            token[ends - counts - 2], token[inner] = 0, which + 2
            base = np.bincount(text, np.log10(times + 1.0)[which], minlength=n) + np.log10(n_texts + 1.0) - (counts + 1) * floor
            out.append({"cell": row["batch"], "tokens": squeeze(token), "sizes": squeeze(counts + 2), "weights": squeeze((~held).astype(np.int64)), "ids": squeeze(np.r_[1, 2, number]),
                        "first": squeeze(np.r_[np.nan, np.log(end_p), log_p].astype(np.float32)), "times": squeeze(np.r_[n_texts, 0, times]), "stands": squeeze(np.r_[flags["all"], 0, stands]), "doc_id": row["doc_id"], "held_out": row["held_out"],
                        "n_tokens": (counts + 1).tolist(), "n_known": (np.bincount(text, (times > 0)[which], minlength=n).astype(np.int64) + (n_texts > 0)).tolist(), "base_score": base.tolist()})
        return _row(_OPENED, out)
    answers = settle(asked.groupBy("bucket").cogroup(spelled.groupBy("cell")).applyInArrow(answer, _ANSWER), wide=True)
    meta = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    opened = settle(texts.select("batch", "tokens", "counts", "doc_id", "held_out").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        open_cell, CELLS + ", doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base_score array<double>"), wide=True)
    discard(sent, spelled, answers)
    about = settle(opened.select("cell", *meta), wide=True)
    each = about.join(score_units(opened, ORDER, float(n_tokens), parts, release=True), "cell").select(F.inline(F.arrays_zip(*meta, F.col("scores").alias("score"))))
    return each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


_OPENED = pa.schema([("cell", pa.int32()), *((c, pa.binary()) for c in ("tokens", "sizes", "weights", "ids", "first", "times", "stands")), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                     ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base_score", pa.list_(pa.float64()))])


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", held_out().alias("held_out")))
