"""A suffix tree over sequences of tokens, counted in buckets: probabilities of whole units, whatever the corpus's size.

A *cell* is one row that holds a bounded share of the corpus as units of tokens (texts of words, words of symbols), each
unit with a weight (its occurrences in training, 0 if held out). A context of ``d`` tokens is counted if it stands at
least ``LEAST`` times in training and is retained if its next-token distribution differs from that of its nearest
retained suffix by a log-likelihood gain that pays for its parameters: ``PRICE * log(observations)`` nats for each kind
of successor, as the Bayesian information criterion asks. Distributions are interpolated towards that suffix with one
pseudo count per kind of successor (Witten-Bell).

Counting takes few exchanges instead of one a depth:

* Round 1 counts (token, next) for all positions. A cell sends each bucket its distinct pairs once, the bucket answers
  with counts and the successors of each context. A context beyond ``HEAVY`` positions is dealt to several buckets by
  its successors; their shares meet in the context's own bucket, which applies the test for all.
* A context of two or more tokens with at most ``HEAVY`` positions is small enough for one bucket, and so is everything
  below it: one exchange sends every position with such a context once, with its tokens, and the bucket counts all
  deeper contexts at once, tests them and returns the sum over each unit.
* Contexts of several tokens that are still heavy get rounds of their own like the first; without any there are none.

Cells repeat their deterministic steps instead of storing positions. Nothing of the tree passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hallwatch.llm import words as W
from hallwatch.operators.state_tables import discard, settle

LEAST, PRICE = 4, 0.5
HEAVY = 1 << 19
PAIRS, COUNTS, SHARES, ASKS, KINDS, MORE, LIGHT, SUMS = range(8)  # rows between cells and buckets
ROWS = "kind int, depth int, cell int, bucket int, parts array<binary>"
CELLS = "cell int, tokens binary, sizes binary, weights binary, ids binary, first binary, times binary, stands binary"
SCORES = "cell int, scores array<double>"

_STEP = np.uint64(0xA0761D6478BD642F)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, the smallest unsigned type that holds them in front."""
    values = np.ascontiguousarray(values)
    if values.dtype.kind in "iu" and values.dtype != np.uint64:
        values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return f"{values.dtype.str[1:]:2}".encode() + len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:2].decode().strip()), int.from_bytes(data[2:10], "little")
    raw = pa.decompress(data[10:], n * kind.itemsize, codec="zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()
    return values.astype(np.int64) if kind.kind == "u" and kind.itemsize < 8 else values


def rows(found: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()))
    return pa.table({n: pa.array([r[k] for r in found], t) for k, (n, t) in enumerate(zip(("kind", "depth", "cell", "bucket", "parts"), kinds))})


def parts_of(table: pa.Table) -> list[list[bytes]]:
    return table.column("parts").to_pylist()


def _both(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of a context with one more token: of a pair, and of the context that the next position has."""
    return W.mix(W.mix(context) * _STEP + token)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(an entry of each distinct key in order, number of each entry's key, how many)."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    return one, which, len(one)


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """Stable order by bucket."""
    return np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")


def pays(gain: np.ndarray, total: np.ndarray, kinds: np.ndarray, observations: float) -> np.ndarray:
    """The test; ``gain`` is the sum of ``n * (log n - log p)`` over successors, ``p`` from the retained suffix."""
    return (total >= LEAST) & (gain - total * np.log(np.maximum(total, 1)) >= PRICE * np.log(max(observations, 1.0)) * kinds)


def blend(log_p: np.ndarray, times: np.ndarray, kinds: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``(times + kinds * p) / (total + kinds)`` in logarithms (a long unseen word has no other form); no kinds, no change."""
    with np.errstate(divide="ignore"):
        new = np.logaddexp(np.log(times), np.log(kinds) + log_p) - np.log(np.maximum(total + kinds, 1))
    return np.where(kinds > 0, new, log_p)


class Cell:
    """One cell, replayed through the rounds that were answered."""

    def __init__(self, row: dict, buckets: int):
        local, sizes, weights, ids, first, times, stands = (expand(row[c]) for c in ("tokens", "sizes", "weights", "ids", "first", "times", "stands"))
        self.number, self.buckets, self.units = row["cell"], buckets, len(sizes)
        self.unit = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.place = (np.arange(len(local)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.token = ids.astype(np.uint64)[local]
        self.log_p = first.astype(np.float64)[local]  # natural logarithm; not a number at the start of each unit
        self.weight = weights[self.unit]
        self.at = np.flatnonzero(self.place > 0)
        self.at = self.at[times[local[self.at - 1]] >= LEAST]
        self.held = stands[local[self.at - 1]]  # positions with the same context
        self.context = self.token[self.at - 1]
        self.pairs = np.zeros(len(local), bool)  # whether the two tokens before each position stand often enough in training
        self.light: list[tuple[int, np.ndarray]] = []  # (depth, positions) that one bucket can take

    def entries(self) -> None:
        """Distinct (context, next) of the live positions, by bucket, context and next."""
        after = self.token[self.at]
        exact = int(self.token.max(initial=0)) < 1 << 32 and int(self.context.max(initial=0)) < 1 << 32  # ids, not hashes: sorted by both
        first, which, n = _groups(self.context << np.uint64(32) | after if exact else _both(self.context, after))
        self.e_context, self.e_next, self.e_salts = self.context[first], after[first], -(-self.held[first] // HEAVY)
        times, stands = np.bincount(which, self.weight[self.at], minlength=n).astype(np.int64), np.bincount(which, minlength=n)
        log_p = self.log_p[self.at[first]].astype(np.float32)
        salt = np.where(self.e_salts > 1, W.mix(self.e_next) % self.e_salts.astype(np.uint64), 0).astype(np.uint64)
        bucket = _bucket(W.mix(self.e_context + salt * _STEP), self.buckets)
        order = _by_bucket(bucket) if exact else np.lexsort((self.e_next, self.e_context, bucket))
        self.e_context, self.e_next, self.e_salts = self.e_context[order], self.e_next[order], self.e_salts[order]
        self.e_times, self.e_stands, self.e_log = times[order], stands[order], log_p[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.e_of = place[which]
        self.bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))

    def runs(self, b: int) -> np.ndarray:
        """Successors of each context among the entries of a bucket."""
        c = self.e_context[self.bounds[b]:self.bounds[b + 1]]
        return np.diff(np.r_[np.flatnonzero(np.r_[True, c[1:] != c[:-1]]), len(c)])

    def send(self, depth: int) -> list[tuple]:
        self.entries()
        out = []
        for b in np.flatnonzero(np.diff(self.bounds)):
            cut, run = slice(self.bounds[b], self.bounds[b + 1]), self.runs(b)
            begins = np.cumsum(run) - run
            contexts, nexts, logs = self.e_context[cut][begins], self.e_next[cut], self.e_log[cut]
            small = int(nexts.max()) < 1 << 32
            one, index, _ = _groups(nexts << np.uint64(32) | logs.view(np.uint32) if small else _both(nexts, logs.view(np.uint32).astype(np.uint64)))  # each with its probability once
            names = nexts[one]
            out.append((PAIRS, depth, self.number, int(b), [squeeze(x) for x in (
                np.diff(contexts, prepend=np.uint64(0)).astype(np.int64) if depth == 1 else contexts, run, self.e_salts[cut][begins], index,
                np.diff(names, prepend=np.uint64(0)).astype(np.int64) if small else names, logs[one], self.e_times[cut], self.e_stands[cut])]))
        return out

    def learn(self, depth: int, answers: pa.Table) -> None:
        """Take the answers of a round; what is live after it has heavy contexts of one more token."""
        self.entries()
        n = len(self.e_context)
        times, stands, kinds, totals = (np.zeros(n, np.int64) for _ in range(4))
        known: list[list[np.ndarray]] = []
        for kind, d, b, parts in zip(answers.column("kind").to_pylist(), answers.column("depth").to_pylist(), answers.column("bucket").to_pylist(), parts_of(answers)):
            if d != depth:
                continue
            values = [expand(x) for x in parts]
            if kind == KINDS:
                known.append(values)
                continue
            cut, run = slice(self.bounds[b], self.bounds[b + 1]), self.runs(b)
            times[cut], kinds[cut], totals[cut] = values[0], np.repeat(values[1], run), np.repeat(values[2], run)
            stands[self.bounds[b] + values[3]] = values[4]
        if known:
            names, k, t = (np.concatenate(x) for x in zip(*known))
            order = np.argsort(names)
            many = np.flatnonzero(self.e_salts > 1)
            found = order[np.searchsorted(names[order], self.e_context[many])]
            kinds[many], totals[many] = k[found], t[found]
        of, at = self.e_of, self.at
        k, t = kinds[of], totals[of]
        self.log_p[at] = blend(self.log_p[at], times[of], k, t)
        after, seen, held = at + 1, times[of], stands[of]  # held: 0 for a context that is not heavy
        inside = after < len(self.unit)
        inside[inside] = self.unit[after[inside]] == self.unit[at[inside]]
        after, seen, held, longer = after[inside], seen[inside], held[inside], _both(self.context[inside], self.token[at[inside]])
        if depth == 1:
            self.pairs[after] = seen >= LEAST
            light = after[(seen >= LEAST) & (held == 0)]
        else:
            closed = np.zeros(len(self.unit), bool)  # known to be too rare, or heavy again
            closed[after[(seen < LEAST) | (held > 0)]] = True
            light = at[(self.place[at] > depth) & ~closed[at]]
        self.light.append((depth + 1, light))
        heavy = (seen >= LEAST) & (held > 0)
        self.at, self.held, self.context = after[heavy], held[heavy], longer[heavy]
        del self.e_context, self.e_next, self.e_salts, self.e_times, self.e_stands, self.e_log, self.e_of

    def spread(self, order: int) -> list[tuple]:
        """Every light position to the bucket of its context, and the sums of all others."""
        depth = np.concatenate([np.full(len(x), d, np.int8) for d, x in self.light if d <= order] or [np.zeros(0, np.int8)])
        at = np.concatenate([x for d, x in self.light if d <= order] or [np.zeros(0, np.int64)])
        done = self.place > 0
        done[at] = False
        sums = np.bincount(self.unit[done], self.log_p[done] / np.log(10.0), minlength=self.units)
        out = [(SUMS, None, self.number, self.number % self.buckets, [squeeze(np.diff(np.arange(self.units), prepend=0)), squeeze(sums)])]
        route = np.zeros(len(at), np.uint64)
        for k in range(1, int(depth.max(initial=0)) + 1):
            on = depth >= k
            route[on] = _both(route[on], self.token[at[on] - k])
        bucket = _bucket(route, self.buckets)
        by = np.argsort(at, kind="stable")  # already in order but for several depths
        by = by[_by_bucket(bucket[by])]
        at, depth, bounds = at[by], depth[by], np.searchsorted(bucket[by], np.arange(self.buckets + 1))
        contexts, live = [], np.ones(len(at), bool)
        for k in range(1, order + 1):  # a token further back matters only if every two neighbours stand often enough
            live &= self.place[at] >= k
            if k > 2:
                live &= (depth >= k) | self.pairs[np.maximum(at - k + 2, 0)]
            contexts.append(np.where(live, self.token[np.maximum(at - k, 0)], 0).astype(np.int64))
        log_p = self.log_p[at].astype(np.float32)
        for b in np.flatnonzero(np.diff(bounds)):
            cut = slice(bounds[b], bounds[b + 1])
            out.append((LIGHT, None, self.number, int(b), [squeeze(x) for x in (
                depth[cut].astype(np.int64), np.diff(self.unit[at[cut]], prepend=0), self.weight[at[cut]], log_p[cut], self.token[at[cut]].astype(np.int64), *[c[cut] for c in contexts])]))
        return out


def _pair_bucket(observations: float, buckets: int):
    """Counts of pairs and successors of contexts back to the cells; contexts dealt to several buckets go on to their own."""
    def run(table: pa.Table) -> pa.Table:
        got = [[expand(x) for x in p] for p in parts_of(table)]
        depth, cells, here = table.column("depth")[0].as_py(), table.column("cell").to_pylist(), table.column("bucket")[0].as_py()
        names = [np.cumsum(g[0].astype(np.uint64)) if depth == 1 else g[0] for g in got]
        context = np.concatenate([np.repeat(c, g[1]) for c, g in zip(names, got)])
        after = np.concatenate([(g[4] if g[4].dtype == np.uint64 else np.cumsum(g[4]).astype(np.uint64))[g[3]] for g in got])
        logs = np.concatenate([g[5][g[3]] for g in got]).astype(np.float64)
        first, which, n = _groups(_both(context, after))
        times = np.bincount(which, np.concatenate([g[6] for g in got]), minlength=n).astype(np.int64)
        stands = np.bincount(which, np.concatenate([g[7] for g in got]), minlength=n).astype(np.int64)
        owner, own, size = _groups(context[first])
        seen = np.flatnonzero(times > 0)
        total = np.bincount(own[seen], times[seen], minlength=size)
        kinds = np.bincount(own[seen], minlength=size)
        gain = np.bincount(own[seen], times[seen] * (np.log(times[seen]) - logs[first[seen]]), minlength=size)
        held = np.concatenate([np.repeat(g[2], g[1]) for g in got])[first][owner] > 1  # dealt to several buckets
        name = context[first][owner]
        good = np.where(pays(gain, total, kinds, observations) & ~held, kinds, 0)
        out, at = [], 0
        for cell, g in zip(cells, got):
            mine = which[at:at + len(g[3])]
            begins = at + np.cumsum(g[1]) - g[1]
            of = own[which[begins]]
            heavy = np.flatnonzero(stands[mine] > HEAVY)
            out.append((COUNTS, depth, cell, here, [squeeze(x) for x in (times[mine], good[of], total[of].astype(np.int64), heavy, stands[mine][heavy])]))
            for b in np.unique(_bucket(W.mix(name[of[held[of]]]), buckets)):
                asked = name[of[held[of]]]
                out.append((ASKS, depth, cell, int(b), [squeeze(asked[_bucket(W.mix(asked), buckets) == b])]))
            at += len(g[3])
        home = _bucket(W.mix(name), buckets)
        for b in np.unique(home[held]):
            cut = held & (home == b)
            out.append((SHARES, depth, here, int(b), [squeeze(x) for x in (name[cut], total[cut].astype(np.int64), kinds[cut], gain[cut])]))
        if ((stands > HEAVY) & (times >= LEAST)).any():
            out.append((MORE, depth, here, here, []))
        return rows(out)
    return run


def _shared_contexts(observations: float):
    """Successors of contexts that were dealt to several buckets, from their shares."""
    def run(table: pa.Table) -> pa.Table:
        kinds, parts = table.column("kind").to_pylist(), parts_of(table)
        shares = [[expand(x) for x in p] for k, p in zip(kinds, parts) if k == SHARES]
        names, which = np.unique(np.concatenate([s[0] for s in shares]), return_inverse=True)
        total, count, gain = (np.bincount(which, np.concatenate([s[k] for s in shares]), minlength=len(names)) for k in (1, 2, 3))
        good = np.where(pays(gain, total, count, observations), count, 0).astype(np.int64)
        asked: dict[int, list[np.ndarray]] = {}
        for kind, cell, p in zip(kinds, table.column("cell").to_pylist(), parts):
            if kind == ASKS:
                asked.setdefault(cell, []).append(expand(p[0]))
        depth, out = table.column("depth")[0].as_py(), []
        for cell, wanted in sorted(asked.items()):
            at = np.searchsorted(names, np.unique(np.concatenate(wanted)))
            out.append((KINDS, depth, cell, None, [squeeze(names[at]), squeeze(good[at]), squeeze(total[at].astype(np.int64))]))
        return rows(out)
    return run


def _light_bucket(observations: float, order: int):
    """All deeper contexts of a bucket at once; the sums of each cell's units."""
    def run(table: pa.Table) -> pa.Table:
        kinds, cells, parts = table.column("kind").to_pylist(), table.column("cell").to_pylist(), parts_of(table)
        out = [(SUMS, None, cell, None, p) for kind, cell, p in zip(kinds, cells, parts) if kind == SUMS]
        cells, got = [c for k, c in zip(kinds, cells) if k == LIGHT], [[expand(x) for x in p] for k, p in zip(kinds, parts) if k == LIGHT]
        if not got:
            return rows(out)
        depth, weight, log_p, after = (np.concatenate([g[k] for g in got]) for k in (0, 2, 3, 4))
        log_p, after = log_p.astype(np.float64), after.astype(np.uint64)
        key, live = np.zeros(len(depth), np.uint64), np.ones(len(depth), bool)
        for d in range(1, order + 1):
            token = np.concatenate([g[4 + d] for g in got]).astype(np.uint64)
            key = _both(key, token)
            live &= token > 0
            at = np.flatnonzero(live & (depth <= d))
            if len(at) == 0:
                continue
            _, which, size = _groups(key[at])
            first, pair, n = _groups(_both(key[at], after[at]))
            times = np.bincount(pair, weight[at], minlength=n)
            owner, seen = which[first], np.flatnonzero(times > 0)
            total = np.bincount(owner, times, minlength=size)
            count = np.bincount(owner[seen], minlength=size)
            gain = np.bincount(owner[seen], times[seen] * (np.log(times[seen]) - log_p[at[first[seen]]]), minlength=size)
            k = np.where(pays(gain, total, count, observations), count, 0)[which]
            log_p[at] = blend(log_p[at], times[pair], k, total[which])
            live[at] = total[which] >= LEAST
        begin = 0
        for cell, g in zip(cells, got):
            unit, p = np.cumsum(g[1]), log_p[begin:begin + len(g[1])]
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            out.append((SUMS, None, cell, None, [squeeze(np.diff(unit[starts], prepend=0)), squeeze((np.add.reduceat(p, starts) / np.log(10.0)).astype(np.float32))]))
            begin += len(unit)
        return rows(out)
    return run


def _sum(cells: pa.Table) -> pa.Table:
    """log10 probability of each unit of a cell."""
    got = [[expand(x) for x in p] for p in parts_of(cells)]
    total = np.zeros(max(len(unit) for unit, _ in got))  # one row has all units
    for unit, values in got:
        total[np.cumsum(unit)] += values
    return pa.table({"cell": pa.array([cells.column("cell")[0].as_py()], pa.int32()), "scores": pa.array([total], pa.list_(pa.float64()))})


def _replayed(buckets: int, depth: int, order: int):
    """What a cell sends after ``depth`` answered rounds: the next round, or everything that is left beyond ``order``."""
    def run(cells: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in cells.to_pylist():
            cell = Cell(row, buckets)
            for d in range(1, depth + 1):
                cell.learn(d, answers)
            out += cell.send(depth + 1) if order == 0 else cell.spread(order)
        return rows(out)
    return run


def score_units(cells: DataFrame, order: int, observations: float, buckets: int, release: bool = False) -> DataFrame:
    """``cell, scores``: log10 probability of each unit after its start mark, for contexts of up to ``order`` tokens.

    ``cells`` is a settled table of ``CELLS``; with ``release`` what the cells send is settled too and they are deleted
    (where they are as large as that, it lowers the most that lies on disk at once). Each column is a ``squeeze``d
    array: local token of every position (units end to end, each with its start mark), size and weight of each unit, and
    of each local token its id (above 0), the logarithm of its probability without context (not a number for the start),
    how often it stands in training and how many positions have it as the token before (the end of a unit: 0)."""
    spark, held = cells.sparkSession, [cells]
    cells = cells.select("cell", "tokens", "sizes", "weights", "ids", "first", "times", "stands")
    answers = spark.createDataFrame([], ROWS)
    depth, more = 0, True
    while more and depth < order:
        sent = cells.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(_replayed(buckets, depth, 0), ROWS)
        counted = settle(sent.groupBy("bucket").applyInArrow(_pair_bucket(observations, buckets), ROWS), wide=True)
        held.append(counted)
        answers, depth = answers.unionByName(counted.where(F.col("kind") == COUNTS)), depth + 1
        shares = counted.where(F.col("kind").isin(SHARES, ASKS))
        if not shares.isEmpty():
            held.append(settle(shares.groupBy("bucket").applyInArrow(_shared_contexts(observations), ROWS), wide=True))
            answers = answers.unionByName(held[-1])
        more = not counted.where(F.col("kind") == MORE).isEmpty()
    sent = cells.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(_replayed(buckets, depth, order), ROWS)
    if release:
        sent = settle(sent, wide=True)
        discard(*held)
    sums = sent.groupBy("bucket").applyInArrow(_light_bucket(observations, order), ROWS)
    return sums.groupBy("cell").applyInArrow(_sum, SCORES)
