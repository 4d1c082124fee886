"""Containers: capacity, completeness, and how full they are."""

import itertools

import numpy as np
from exonia.llm import packing

SCHEMA = "doc_id long, text string"


def check(sizes, capacity):
    got = packing.pack(np.array(sizes, np.int64), capacity)
    assert got.groupby("box")["n_tokens"].sum().max() <= capacity if len(got) else True
    for i, size in enumerate(sizes):
        own = got[got["item"] == i].sort_values("part")
        assert own["n_tokens"].sum() == size
        assert list(own["part"]) == list(range(len(own)))
        assert list(own["tok_start"]) == list(np.cumsum(own["n_tokens"]) - own["n_tokens"])
        assert len(own) == max(1, -(-size // capacity))
    return got["box"].nunique()


def test_items_of_every_size():
    assert check([], 10) == 0
    assert check([0, 0, 0], 10) == 1
    assert check([10, 10], 10) == 2
    assert check([25, 5, 0], 10) == 3
    assert check([7] * 9, 10) == 9


def test_local_search_empties_containers():
    sizes = np.array([5, 4, 4, 3, 2, 2])
    assert len(set(packing.next_fit(sizes, 10))) == 3
    assert len(set(packing.improve(sizes, packing.next_fit(sizes, 10), 10))) == 2
    assert len(set(packing.improve(sizes, np.arange(len(sizes)), 10))) == 2


def test_the_search_packs():
    """The start wastes about a quarter; what fills the containers is the search."""
    sizes = np.minimum(np.random.default_rng(8).lognormal(6.4, 1.1, 6000).astype(np.int64) + 1, 2048)
    start, least = packing.next_fit(sizes, 2048), -(-sizes.sum() // 2048)
    assert len(set(start)) > 1.2 * least
    assert len(set(packing.improve(sizes, start, 2048))) <= 1.005 * least
    few = sizes[:400]
    assert len(set(packing.improve(few, np.arange(400), 2048))) <= 1.005 * -(-few.sum() // 2048) + 1


def test_search_is_near_the_optimum_on_small_cases():
    r = np.random.default_rng(3)
    worse = 0
    for _ in range(60):
        sizes, capacity = r.integers(1, 12, 7), 12
        best = min((len(set(a)) for a in itertools.product(range(3), repeat=7) if max(np.bincount(a, sizes)) <= capacity), default=None)
        n = check(sizes.tolist(), capacity)
        if best is not None:
            assert n <= best + 1
            worse += n > best
    assert worse <= 3


def test_waste_is_small_on_many_items():
    sizes = np.random.default_rng(1).lognormal(6.4, 1.1, 8000).astype(np.int64)
    for capacity in (2048, 4096):
        n = check(sizes.tolist(), capacity)
        assert sizes.sum() / (n * capacity) > 0.995


def test_squared_fill_never_falls():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 900, 400)
    box = np.arange(400)
    for _ in range(5):
        fill = np.bincount(box, sizes, minlength=400)
        before, after_box = (fill**2).sum(), box.copy()
        if not packing._round(sizes, after_box, fill.astype(np.int64), 1000):
            break
        assert (np.bincount(after_box, sizes, minlength=400) ** 2).sum() > before
        box = after_box


def exchanges_left(sizes, box, capacity):
    """Whether any exchange of nothing, one or two items for one or two still gains, by trying all."""
    fill, units = np.bincount(box, sizes), {}
    for b in set(box.tolist()):
        own = sizes[box == b].tolist()
        units[b] = {0, *own, *(x + y for x, y in itertools.combinations(own, 2))}
    return any(t < v and max(fill[b], fill[a] - 1) < fill[a] + v - t <= capacity for a, b in itertools.permutations(units, 2) for t in units[a] for v in units[b])


def test_tied_sizes_hide_no_exchange():
    sizes, box = np.array([1] * 8 + [2, 2]), np.array([0] * 8 + [1, 2])
    assert len(set(packing.improve(sizes, box, 10))) == 2


def test_search_ends_only_when_no_exchange_is_left():
    r = np.random.default_rng(5)
    for _ in range(100):
        capacity = int(r.integers(8, 60))
        sizes = r.integers(1, int(r.integers(2, capacity + 1)), int(r.integers(2, 60)))
        box = packing.improve(sizes, np.arange(len(sizes)), capacity)
        assert np.bincount(box, sizes).max() <= capacity
        assert len(set(box)) == -(-sizes.sum() // capacity) or not exchanges_left(sizes, box, capacity)


def test_containers_of_a_table(spark):
    texts = [None, "", "a b c d e", "a " * 100, "a b", "a b", "x"] + ["w " * (i % 17) for i in range(200)]
    docs = spark.createDataFrame([(i // 2 if i < 8 else None, t, 9, 9) for i, t in enumerate(texts)], SCHEMA + ", container int, n_tokens int")
    out = packing.containers(docs, [(1, "byte_bpe_50k", 32), (2, "byte_bpe_50k", 7)], group_items=50).toPandas()
    for limit, capacity in ((1, 32), (2, 7)):
        own = out[out["limit_id"] == limit]
        assert own.groupby("container")["n_tokens"].sum().max() <= capacity
        assert (own["part"] == 0).sum() == len(texts)
    assert out[out["limit_id"] == 1]["n_tokens"].sum() == out[out["limit_id"] == 2]["n_tokens"].sum()
    assert packing.containers(docs.limit(0), [(1, "byte_bpe_50k", 32)]).collect() == []
