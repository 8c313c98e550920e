"""Target-distribution importance resampling: hashed n-gram weights in one array, drawn by a parallel sort.

A feature is a run of words; its bucket is a checksum modulo ``BUCKETS``. The share of each bucket in the target texts
and in all documents gives the bucket's gain, one array of ``BUCKETS`` numbers that every task receives; a document's
weight is the sum of the gains of its features. A Gumbel number from a hash of the id is added, so the largest scores
are a sample without replacement.

The draw is a parallel sort by regular sampling. Scored rows are dealt into ``p`` runs, each sorted and written once
with the place of every row in its run. Regular places of all runs (at most about ``p`` each) give ``p - 1`` splitters,
so no segment holds much more than two shares, whatever the scores; the place in the runs breaks the last ties, so
equal rows split too. Counts per segment, added up, say where each begins; only segments that begin among the rows to
draw are exchanged and merged, in Spark's sort, which spills, and a running number inside a segment plus its beginning
is the exact rank. The driver sees counts of buckets and segments and ``p * p`` samples, ``p`` being ``RUNS`` at most
(24 MB); beyond ``RUNS * SEGMENT`` rows segments grow, but stay on disk.

Defined results: a null text has no words; null ids come after all others and hash like no digits; rows that share an id
are drawn each for itself, ties in the order in which they were written. Without words anywhere all gains are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hallwatch.llm import words as W
from hallwatch.operators.state_tables import settle

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SEGMENT, RUNS = 1 << 14, 1 << 10
LONG_WORD = 64  # bytes; longer words go through the library
_LAST = np.iinfo(np.int64).max

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, _TABLE >> 1 ^ np.uint32(0xEDB88320), _TABLE >> 1)


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each span of bytes, going on from ``state``."""
    crc = np.zeros(len(starts), np.uint32) if state is None else state
    sizes, crc = ends - starts, ~crc
    live = np.flatnonzero(sizes <= LONG_WORD)
    for k in range(LONG_WORD):
        live = live[sizes[live] > k]
        if len(live) == 0:
            break
        c = crc[live]
        crc[live] = _TABLE[(c ^ data[starts[live] + k]) & 255] ^ c >> 8
    crc = ~crc
    for w in np.flatnonzero(sizes > LONG_WORD):
        crc[w] = zlib.crc32(data[starts[w]:ends[w]].tobytes(), int(crc[w]))
    return crc


def buckets_of(column: pa.Array, buckets: int, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (first text, end text, words per text, bucket of each feature, its text)."""
    data, offsets = W.text_bytes(column)
    for i, j in W.chunks(offsets):
        part = W.LOWER[data[offsets[i]:offsets[j]]]
        starts, ends, counts = W.spans(part, offsets[i:j + 1] - offsets[i], W.NOT_ALNUM)
        text, found, owner = W.owners(counts), [], []
        state, blank = None, np.full(1, 32, np.uint8)
        for n in range(1, longest + 1):
            first = np.flatnonzero(text[:max(len(text) - n + 1, 0)] == text[n - 1:]) if n > 1 else np.arange(len(text))
            if n > 1:
                state = checksums(blank, np.zeros(len(first), np.int64), np.ones(len(first), np.int64), whole[first])
            whole = np.zeros(len(text), np.uint32)
            whole[first] = checksums(part, starts[first + n - 1], ends[first + n - 1], state)
            found.append(whole[first] % np.uint32(buckets))
            owner.append(text[first])
        yield i, j, counts, np.concatenate(found).astype(np.int64), np.concatenate(owner)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all rows of the one column ``text``."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in parts:
            for _, _, _, found, _ in buckets_of(part.column("text"), buckets, longest):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    counts = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket
    out = np.zeros(buckets, np.int64)
    out[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, per bucket."""
    s, t, size = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of rows with ``doc_id, text``."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n_words, n_features, weight = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for i, j, counts, found, owner in buckets_of(part.column("text"), len(gain), longest):
                n_words[i:j], n_features[i:j] = counts, np.bincount(owner, minlength=j - i)
                weight[i:j] = np.bincount(owner, gain[found], minlength=j - i)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _segments(splitters: np.ndarray):
    """Segment of each row: how many splitters (score, key, place) stand before it."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score, key, place = (np.r_[splitters[:, k], part.column(c).to_numpy()] for k, c in enumerate(("score", "key", "place")))
            order = np.lexsort((np.arange(len(score)) < len(splitters), place, key, -score))
            before = np.empty(len(score), np.int64)
            before[order] = np.cumsum(order < len(splitters))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(before[len(splitters):])], names=[*part.schema.names, "segment"])
    return run


def _number(begins: np.ndarray, draw: int):
    """Rank of rows that arrive sorted inside their segments."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for part in parts:
            segment = part.column("segment").to_numpy()
            if len(segment) == 0:
                continue
            fresh = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            place = np.arange(len(segment)) - np.repeat(fresh, np.diff(np.r_[fresh, len(segment)])) + 1
            if segment[0] == last:
                place[:fresh[1] if len(fresh) > 1 else None] += seen
            last, seen = segment[-1], int(place[-1])
            rank = begins[segment] + place
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(rank, mask=rank > draw)], names=["row", "rank"])
    return run


def draw_largest(rows: DataFrame, may: Column, score: Column, key: Column, percent: int, segment_rows: int | None = None) -> DataFrame:
    """``rows`` and ``rank``: 1, 2, 3 ... by descending score and ascending key for the largest ``percent`` of 100 of those
    that ``may`` be drawn, null for all others."""
    spark, names = rows.sparkSession, rows.columns
    rows = settle(rows.select(F.struct(*names).alias("row"), F.coalesce(may, F.lit(False)).alias("may"), score.alias("score"), F.coalesce(key, F.lit(_LAST)).alias("key")))
    held = rows.agg(F.count_if("may")).first()[0]
    count, draw = min(RUNS, max(1, -(-held // (segment_rows or SEGMENT)))), percent * held // 100
    runs = settle(rows.where("may").repartition(count).sortWithinPartitions(F.desc("score"), "key").withColumn("place", F.monotonically_increasing_id()))
    every = max(1, held // (count * count))
    samples = runs.where(F.pmod(F.col("place").bitwiseAND(2**33 - 1), F.lit(every)) == every - 1).select("score", "key", "place").toArrow()
    samples = np.stack([samples.column(c).to_numpy() for c in ("score", "key", "place")], 1).astype(np.int64)
    samples = samples[np.lexsort((samples[:, 2], samples[:, 1], -samples[:, 0]))]
    splitters = samples[np.arange(1, count) * len(samples) // count] if len(samples) else samples
    kind = rows.schema["row"].dataType.simpleString()
    dealt = runs.mapInArrow(_segments(splitters), f"row {kind}, may boolean, score long, key long, place long, segment long")
    sizes = np.zeros(len(splitters) + 1, np.int64)
    for r in dealt.groupBy("segment").count().collect():  # a row per segment
        sizes[r["segment"]] = r["count"]
    begins = np.cumsum(sizes) - sizes
    above = int(np.searchsorted(begins, draw))  # segments that begin among the drawn rows
    tasks = max(above, int(spark.conf.get("spark.sql.shuffle.partitions"))) if above > 1 else 1
    merged = dealt.where(F.col("segment") < above).repartition(tasks, "segment").sortWithinPartitions("segment", F.desc("score"), "key", "place")
    ranked = merged.select("row", "segment").mapInArrow(_number(begins, draw), f"row {kind}, rank long")
    rest = dealt.where(F.col("segment") >= above).select("row").unionByName(rows.where(~F.col("may")).select("row")).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("row.*", "rank")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
             doc_id: str = "doc_id", text: str = "text", segment_rows: int | None = None) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``target`` has a column named like ``text``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    gain = gains(bucket_counts(rows.select("text"), buckets, longest), bucket_counts(target.select(F.col(text).cast("string").alias("text")), buckets, longest))
    scored = weigh(rows, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    drawn = draw_largest(scored, F.col("n_words") >= least_words, F.col("score"), F.col("doc_id"), percent, segment_rows)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


OP13_SQL = r"""
WITH table_ AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
texts AS (
  SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 't', NULL, coalesce(text, '') FROM benchmark),
listed AS (
  SELECT side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
spread AS (SELECT side, doc_id, unnest(words) AS word FROM listed),
kinds AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || hex(encode(word))[2 * i + 1:2 * i + 2])::BIGINT)),
                               lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM spread), table_),
counted AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM spread JOIN kinds USING (word) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM counted),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain FROM counted, whole),
weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM spread JOIN kinds USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed"""
