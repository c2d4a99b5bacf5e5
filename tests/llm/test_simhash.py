import random

import numpy as np
import xxhash

from tarn.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string"


def brute_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance=3):
    fp = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [(d, f"{fp[i]:016x}", low.get(root(i))) for i, (d, _) in enumerate(rows)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    return [tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


def corpus():
    rng = random.Random(3)
    words = lambda n: [rng.choice(["w%d" % i for i in range(200)] + ["Ünder", "ÀB"]) for _ in range(n)]
    rows = [(5, None), (3, ""), (None, " \t"), (None, "no id at all"), (8, "Two words"), (9, "two  WORDS"), (10, "one"), (10, "one")]
    base = words(300)
    for i in range(20, 60):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(300)] = "x%d" % rng.randrange(1000)
        rows.append((i, " ".join(near)))
    rows += [(i, "\n".join(words(rng.randrange(1, 60)))) for i in range(60, 200)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = sorted(brute_components(rows), key=key)
    assert sorted(run(spark, rows), key=key) == want
    monkeypatch.setattr(simhash, "BLOCK", 3)
    assert sorted(run(spark, rows), key=key) == want


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(run(spark, rows), key=key) == sorted(brute_components(rows), key=key)


def test_dense_fingerprints_lose_no_link(spark, monkeypatch):
    """Chains and clusters at all distances, on skewed bits, in blocks smaller than the buckets."""
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.zeros(600, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64) * (rng.random(600) < 0.7)
    fps = np.unique(centre[rng.integers(0, 20, 600)] ^ flips)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        after = np.array([want[n].min() for n in near])
        if (after == want).all():
            break
        want = after
    for block in (2048, 5):
        monkeypatch.setattr(simhash, "BLOCK", block)
        edges = simhash.links(df, 3).collect()
        place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        u, v = np.array([place[r.u] for r in edges]), np.array([place[r.v] for r in edges])
        got = simhash.local_components(len(fps), u, v)
        assert (got == want).all()


def test_allotment_meets_the_pigeonhole():
    cost, t = simhash.allot(np.array([[0, 1, 9, 99, 999], [0, 50, 60, 70, 80], [0, 1, 2, 3, 900]], float), 4)
    assert sum(x + 1 for x in t) == 4 and cost == 4 and t == [0, -1, 2]


def test_empty_and_keep(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(2, "same text here now", "a"), (1, "same text here now", "b"), (1, "same text here now", "b")], SCHEMA)
    assert [tuple(r) for r in simhash.first_of_each(df).collect()] == [(1, "same text here now", "b")]
