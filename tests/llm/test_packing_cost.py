"""The choice among several lengths in packing."""

import random

from hallwatch.llm import best_fit_packing


def test_larger_bin_where_it_is_cheaper():
    bins, _, capacity = best_fit_packing.pack_group([300] * 300)
    assert capacity == [1024] * 100 and all(bins.count(b) == 3 for b in range(3))


def test_plan_is_never_dearer_than_smallest_bins_and_shrinks(monkeypatch):
    rnd, shrunk = random.Random(4), 0
    for _ in range(200):
        pieces = sorted((rnd.choice([260, 300, 520, 700, rnd.randint(1, 900)]) for _ in range(rnd.randint(1, 60))), reverse=True)
        opened = []
        monkeypatch.setattr(best_fit_packing, "min", lambda *a, **k: opened.append(min(*a, **k)) or opened[-1], raising=False)
        bins, _, capacity = best_fit_packing._plan(pieces, best_fit_packing.LENGTHS, True)
        monkeypatch.undo()
        shrunk += sum(c < o for c, o in zip(capacity, [o for o in opened if o in best_fit_packing.LENGTHS]))
        used = [sum(p for p, b in zip(pieces, bins) if b == k) for k in range(len(capacity))]
        assert all(u <= c for u, c in zip(used, capacity)) and sum(used) == sum(pieces)
        costs = [sum(map(best_fit_packing.cost, best_fit_packing._plan(pieces, best_fit_packing.LENGTHS, t)[2])) for t in (True, False)]
        assert sum(map(best_fit_packing.cost, best_fit_packing.pack_group(pieces)[2])) == min(costs)
    assert shrunk > 0


def plain_plan(pieces, lengths, trial):
    """The same greedy by looking at every bin and every piece: [(lengths of its pieces, capacity)]."""
    bins = []
    for at, size in enumerate(pieces):
        free = [(c - sum(held), k) for k, (held, c) in enumerate(bins) if c - sum(held) >= size]
        if free:
            bins[min(free)[1]][0].append(size)
            continue

        def price(c):
            space = c - size
            for p in sorted(pieces[at + 1:], reverse=True) if trial else ():
                space -= p if p <= space else 0
            return best_fit_packing.cost(c) / (c - space) if trial else c
        bins.append(([size], min((c for c in lengths if c >= size), key=lambda c: (price(c), c))))
    return [(held, min(c for c in lengths if c >= sum(held))) for held, _ in bins]


def test_plan_against_a_plain_reading():
    rnd, lengths = random.Random(8), best_fit_packing.LENGTHS
    for _ in range(150):
        pieces = sorted((rnd.choice([300, 512, 700, rnd.randint(1, 4096), rnd.randint(1, 200)]) for _ in range(rnd.randint(1, 50))), reverse=True)
        for trial in (True, False):
            bins, offsets, capacity = best_fit_packing._plan(pieces, lengths, trial)
            want = plain_plan(pieces, lengths, trial)
            assert [([p for p, b in zip(pieces, bins) if b == k], c) for k, c in enumerate(capacity)] == want
            assert all(o == sum(p for p, b in zip(pieces[:k], bins[:k]) if b == bins[k]) for k, o in enumerate(offsets))


def test_groups_stay_small_with_a_third_on_one_null_id(spark, monkeypatch):
    monkeypatch.setattr(best_fit_packing, "GROUP", 100)
    rows = [(None if k % 3 == 0 else k, "one text " * 40) for k in range(1500)]
    packed = best_fit_packing.pack(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r["count"] for r in packed.groupBy("grp").count().collect()]
    assert sum(sizes) == 1500 and max(sizes) <= 160
