import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing, sharding
from tarn.llm.common import text_hash, word_count

SCHEMA = "doc_id long, source string, text string, shard string, target string"


def corpus(n=400):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "Ä", None, "c%d" % (i % 3)]), "w " * rng.randrange(40), "mine", "") for i in range(n)]
    rows += [(None, "a", None, "", None), (None, None, "x", "", None), (n, "tiny", "one two", "", ""), (n + 1, "none", "", "", "")]
    return rows + rows[:3] * 4


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > repeats * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def mixed(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return mixing.mix(df, word_count(F.col("text")), F.col("source"), [F.col("doc_id"), text_hash("text")])


def test_mix_meets_targets(spark):
    rows = corpus()
    out = mixed(spark, rows).collect()
    assert len(out) == len(rows)
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, s, t, *_ in rows:
        sizes[s] += len((t or "").split())
        largest[s] = max(largest[s], len((t or "").split()))
    want = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert len(r.draws) <= 2 and r.draws == sorted(r.draws)
        taken[r.source] += r["size"] * len(r.draws)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1


def test_mix_is_the_brute_force_queue(spark):
    """Accepted draws are those that a sort of all finish times takes until the budget is spent."""
    out = mixed(spark, corpus()).collect()
    budget = 1.5 * sum(r["size"] for r in out)
    every = defaultdict(list)
    for r in out:
        every[r.source].append(r)
    draws = sorted(f for r in out for f in r.draws)
    total = sum(r["size"] * len(r.draws) for r in out)
    assert total <= budget < total + max(r["size"] for r in out) + 1
    for rows in every.values():  # in each source, draws follow the words given so far
        given = sorted((f, r["size"]) for r in rows for f in r.draws)
        so_far = 0
        for f, size in given:
            so_far += size
            assert f == pytest.approx(so_far / rows[0].target)
    again = mixed(spark, corpus()[::-1]).collect()
    assert sorted(f for r in again for f in r.draws) == draws


def test_mix_in_order_and_empty(spark):
    out = mixing.in_order(mixed(spark, corpus()))
    finish = [r.finish for r in out.collect()]
    assert finish == sorted(finish) and len(finish) > 300
    assert mixed(spark, []).collect() == []


def shards(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sharding.shuffle_into_shards(df, [F.col("doc_id"), text_hash("text")], **options).collect()


def test_shards_are_exact_and_whole(spark):
    rows = corpus()
    out = shards(spark, rows)
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[2]) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(repr, out)) == sorted(map(repr, shards(spark, rows[::-1])))
    assert shards(spark, []) == [] and len(shards(spark, rows[:3])) == 3


def test_shuffle_is_uniform(spark):
    """Where one row goes, and which rows meet, over many seeds."""
    rows = [(i, "s", "x", "", "") for i in range(12)]
    places = Counter()
    for seed in range(60):
        places.update((r.doc_id, r.shard) for r in shards(spark, rows, n_shards=3, seed=seed * 2) if r.doc_id < 2)
    assert all(5 <= places[d, s] <= 38 for d in (0, 1) for s in range(3))


def test_matrix_sums_and_law():
    counts, sizes = np.array([5, 0, 7, 30]), np.array([14, 14, 14])
    m = sharding.matrix(counts, sizes, 3)
    assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == sizes).all()
    rng = np.random.default_rng(0)
    large = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 1000) for _ in range(2000)]
    assert abs(np.mean(large) - 250) < 2 and abs(np.std(large) - 13.7) < 1
