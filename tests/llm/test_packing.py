import random
from collections import Counter

from pyspark.sql import functions as F
from tarn.llm import packing
from tarn.llm.common import word_count

SCHEMA = "doc_id long, text string, size string"


def check(rows, bins, capacities):
    """Every word in one item, every bin in the least capacity that holds it."""
    want, got = Counter(), Counter()
    for d, text in rows:
        n = len((text or "").split())
        want[d, None] += n
        want[d, "rows"] += 1
    for b in bins:
        assert b.used == sum(i.end - i.start for i in b["items"]) and b.n_items == len(b["items"]) == len(b.doc_ids)
        assert b.capacity == min(c for c in capacities if c >= b.used)
        for i in b["items"]:
            got[i.doc_id, None] += i.end - i.start
            got[i.doc_id, "rows"] += i.start == 0
    assert got == want
    assert len({b.bin_id for b in bins}) == len(bins)


def corpus():
    rng = random.Random(1)
    rows = [(None, None), (None, "a b"), (1, ""), (2, "w " * 10_000), (2, "w " * 8192), (3, "w " * 4096), (4, "w " * 4096)]
    rows += [(i, "x " * int(rng.paretovariate(0.7) * 20)) for i in range(10, 300)]
    return rows + rows[-5:]


def test_whole_and_dense(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    bins = packing.pack(df, word_count(F.col("text"))).collect()
    check(rows, bins, packing.CAPACITIES)
    assert sum(b.used for b in bins) / sum(b.capacity for b in bins) > 0.95
    assert len({b.capacity for b in bins}) > 1
    monkeypatch.setattr(packing, "GROUP", 20)
    again = [packing.pack(df, word_count(F.col("text"))).collect() for _ in range(2)]
    check(rows, again[0], packing.CAPACITIES)
    assert sorted(map(repr, again[0])) == sorted(map(repr, again[1]))
    assert packing.pack(df.limit(0), word_count(F.col("text"))).collect() == []


def brute_best_fit(sizes, capacities, overhead, keys=None):
    """Bins as item numbers; each capacity is filled on trial, item by item, when a bin is opened."""
    bins = []
    for i, s in enumerate(sizes):
        fits = [b for b in bins if b[0] >= s and not (keys and keys[i] in {keys[j] for j in b[1]})]
        if fits:
            b = min(fits, key=lambda b: (b[0], bins.index(b)))
        else:
            options = []
            for c in sorted(c for c in capacities if c >= s):
                used = s
                for x in sizes[i + 1 :]:
                    used += x * (used + x <= c)
                options.append(((min(k for k in capacities if k >= used) + overhead) / max(1, used), c))
            b = [min(options)[1], []]
            bins.append(b)
        b[0] -= s
        b[1].append(i)
    return [b[1] for b in bins]


def test_best_fit_against_brute_force():
    rng = random.Random(2)
    for k in range(100):
        sizes = sorted((rng.randrange(0, 33) for _ in range(rng.randrange(40))), reverse=True)
        capacities = rng.choice([(8, 16, 32), (10, 15, 33), (12, 33)])
        keys = [rng.randrange(30) for _ in sizes] if k % 2 else None
        assert packing.best_fit(sizes, capacities, 3, keys) == brute_best_fit(sizes, capacities, 3, keys)


def test_the_best_mix_of_capacities_is_opened():
    """Two items of 700 share a bin of 1500, though one of 1000 would hold the first; items of 900 stay alone in 1000."""
    bins = packing.best_fit([900, 900, 700, 700, 700, 700], (1000, 1500), 3)
    assert bins == [[0], [1], [2, 3], [4, 5]]
    assert [packing.fitting(sum([900, 900, 700, 700, 700, 700][i] for i in b), (1000, 1500)) for b in bins] == [1000, 1000, 1500, 1500]


def test_repeated_rows_never_share_a_bin(spark):
    rows = [(1, "a b c", "mine")] * 3000 + [(i, "x " * (i % 40), "mine") for i in range(2, 3000)]
    bins = packing.pack(spark.createDataFrame(rows, SCHEMA), word_count(F.col("text"))).collect()
    check([r[:2] for r in rows], bins, packing.CAPACITIES)
    assert all(len(set(b.doc_ids)) == len(b.doc_ids) for b in bins)
    assert sum(1 in b.doc_ids for b in bins) == 3000


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in df.collect()], packing.pack(df, word_count(F.col("text"))).collect(), packing.CAPACITIES)
