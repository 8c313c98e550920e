"""Scores of operator 8 against a plain reading of both trees."""

import math
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np

import brute
from odd_rows import documents, frame, odd  # noqa: F401
from hallwatch.llm import context_tree, suffix_tree_lm as lm


def tree(units, base, depth, least=context_tree.LEAST, price=context_tree.PRICE):
    """Probability of a token after its history, from [(tokens with both marks, weight)] and that of the root."""
    after = defaultdict(Counter)
    price *= math.log(max(sum(weight * (len(tokens) - 1) for tokens, weight in units), 1))
    for tokens, weight in units:
        for k in range(1, len(tokens)) if weight else ():
            for d in range(1, min(depth, k) + 1):
                after[tokens[k - d:k]][tokens[k]] += weight

    @cache
    def retained(context):
        n = after[context]
        total = sum(n.values())
        return sum(c * (math.log(c / total) - math.log(p(context[1:], x))) for x, c in n.items()) >= price * len(n)

    def p(history, x):
        out = base(x)
        for d in range(1, min(depth, len(history)) + 1):
            context = history[-d:]
            total = sum(after[context].values()) if context in after else 0
            if total < least:
                break
            if retained(context):
                out = (after[context][x] + len(after[context]) * out) / (total + len(after[context]))
        return out
    return p


def scores(rows):
    """[(id, text)] to [(id, score)]."""
    texts = [(i, tuple(brute.words(t, True)), not brute.crc(i, 7)) for i, t in rows]
    count = Counter(w for _, words, train in texts if train for w in words)
    n_texts, n_words, distinct = sum(x[2] for x in texts), sum(count.values()), max(len(count), 1)
    spellings = {w: (lm.START, *(b + 1 for b in w.encode()), lm.STOP) for _, words, _ in texts for w in words}
    symbol = Counter()
    for w, n in count.items():
        for s in spellings[w][1:]:
            symbol[s] += n
    by_symbol = tree([(spellings[w], n) for w, n in count.items()], lambda s: (symbol[s] + 1) / (sum(symbol.values()) + lm.SYMBOLS), lm.DEPTH)

    @cache
    def word(w):
        if w == "</s>":
            return (n_texts + 1) / (n_words + n_texts + 2)
        spelled = math.prod(by_symbol(spellings[w][:k], spellings[w][k]) for k in range(1, len(spellings[w])))
        return (count[w] + distinct * spelled) / (n_words + distinct) * (n_words + 1) / (n_words + n_texts + 2)
    runs = [(i, ("<s>", *words, "</s>"), train) for i, words, train in texts]
    by_word = tree([(r, 1) for _, r, train in runs if train], word, lm.ORDER)
    return [(i, sum(math.log10(by_word(r[max(k - lm.ORDER, 0):k], r[k])) for k in range(1, len(r)))) for i, r, _ in runs]


def agree(df, rows):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1])) for x in ([(r.doc_id, r.score) for r in df.select("doc_id", "score").collect()], scores(rows)))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-6)


def test_word_contexts(spark, documents):
    """The same words in another order score differently: contexts run over the words of a text."""
    agree(lm.op8_lm_scoring(spark, "/root/testdata/sf0.001"), documents)
    text = "the cat sat on the mat and the dog lay by the door"
    shuffled = text.split()
    random.Random(3).shuffle(shuffled)
    rows = [(k, text) for k in range(20)] + [(100, text), (101, " ".join(shuffled))]
    held = spark.createDataFrame([(i, t, i >= 100) for i, t in rows], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in lm.score_texts(held).collect()}
    assert got[100] > got[101] + 3


def test_heavy_contexts(spark, documents, monkeypatch):
    """Contexts dealt to several buckets, and rounds for those of several tokens, give the same scores."""
    monkeypatch.setattr(context_tree, "HEAVY", 20)
    rows = documents[:60] + [(1000 + k, "it is all the same text again and again " * 3) for k in range(30)]
    agree(lm.score_texts(spark.createDataFrame([(i, t, brute.crc(i, 7)) for i, t in rows], "doc_id long, text string, held_out boolean")), rows)


def test_a_third_on_one_null_id(spark):
    rows = [(None, "the same words on a null id")] * 40 + [(k, f"other words {k} of a text") for k in range(80)]
    agree(lm.score_texts(spark.createDataFrame([(i, t, brute.crc(i, 7) if i is not None else False) for i, t in rows], "doc_id long, text string, held_out boolean")), rows)


def test_squeezed_numbers():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.arange(5), rng.integers(0, 2**40, 1000), rng.integers(0, 2**63, 50).astype(np.uint64), rng.random(77), np.array([np.nan, -1.5], np.float32)):
        assert np.array_equal(context_tree.expand(context_tree.squeeze(values)), values, equal_nan=values.dtype.kind == "f")


def test_rare_contexts_of_a_large_corpus(spark):
    """A context needs so many occurrences, not a share of all symbols."""
    rows = [(k, "aa " * 100_000) for k in range(9)] + [(k, "qxz qxz") for k in range(20, 24)] + [(5000, "qxzz qx zx"), (5001, "xqzz xz qz")]
    agree(lm.score_texts(spark.createDataFrame([(i, t, brute.crc(i, 7)) for i, t in rows], "doc_id long, text string, held_out boolean")), rows)
