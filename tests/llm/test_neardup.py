import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from tarn.llm import neardup, simhash
from tests.llm.test_simhash import brute_components

SCHEMA = "doc_id long, text string"


def sets(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    return [frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


def brute(rows):
    """Ids that stay: the smallest of each component at Jaccard 0.8."""
    s, label = sets(rows), list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sorted((len(s[i]), len(s[j])))
        if s[i] == s[j] or 5 * a >= 4 * b and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) > 0:
            label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(d, low.get(root(i), d))
    return sorted(low.values())


def corpus():
    """Copies at all similarities around 0.8, chains of them, a line that most texts have, short and empty texts."""
    rng = random.Random(5)
    words = lambda n: ["w%d" % rng.randrange(3000) for _ in range(n)]
    line, rows = words(30), [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one")]
    for g in range(25):
        text = words(rng.randrange(20, 200))
        for i in range(8):
            if i % 4:
                text = list(text) if i % 2 else text[: len(text) - rng.randrange(4)]
                for _ in range(rng.randrange(4)):
                    text[rng.randrange(len(text))] = "x%d" % rng.randrange(1000)
            rows.append((100 + 10 * g + i, " ".join(text + (line if g % 3 else []))))
    rng.shuffle(rows)
    return rows


def stay(spark, rows):
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect())


def test_near_copies_against_brute_force(spark, monkeypatch):
    """No text goes that brute force keeps, and nearly all go that it removes; small blocks and crowded buckets give the same."""
    rows = corpus()
    want = brute(rows)
    assert len(want) < len(rows) - 50
    got = stay(spark, rows)
    removed = {r[0] for r in rows} - set(want)
    assert set(want) <= set(got) and len(removed - set(got)) >= 0.97 * len(removed)
    monkeypatch.setattr(neardup, "MANY", 0)
    monkeypatch.setattr(simhash, "BLOCK", 5)
    assert stay(spark, rows) == got


def test_recall_at_the_similarity():
    """Pairs at 0.8 to 0.85 meet in a partition of 16 bits, and are near enough on two further fingerprints, in over 0.95 of cases."""
    rng, met, n = np.random.default_rng(3), 0, 400
    for _ in range(n):
        size = int(rng.integers(40, 400))
        common = -(-8 * size // 9)
        pool = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
        one, two = neardup.fingerprints_of([pool[:size], np.concatenate((pool[:common], pool[size:]))])
        x = one ^ two
        met += (x[2:].view(np.uint16) == 0).any() and np.bitwise_count(x[:2]).sum() <= neardup.FAR
    assert met >= 0.95 * n


def test_near_copies_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert stay(spark, rows) == brute(rows)


def test_texts_below_the_similarity_stay(spark):
    """Document 185 lies within 6 bits of another document, whose shingles it shares by less than 0.8."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    low = {c for _, _, c in brute_components(rows, 6)}
    assert 185 not in low and 185 in brute(rows)
    assert stay(spark, rows) == brute(rows)
