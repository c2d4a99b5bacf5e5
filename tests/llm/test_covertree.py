import numpy as np

from tarn.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, least=0.93):
    ok = []
    for i, v, label in rows:
        a = np.array([np.nan if x is None else x for x in v], np.float64) if v else np.zeros(0)
        ok.append(a / np.linalg.norm(a) if label is not None and len(a) and np.isfinite(a).all() and a.any() else None)
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                near[i, j] = ok[i] @ ok[j] >= least
    label = np.arange(n)
    while True:
        after = np.array([min(label[i], label[near[i]].min(initial=n)) for i in range(n)])
        if (after == label).all():
            break
        label = after
    low = {}
    for (d, _, _), c in zip(rows, label):
        if d is not None:
            low[c] = min(d, low.get(c, d))
    return [(d, int(near[i].sum()), low.get(label[i]), low.get(label[i]) == d) for i, (d, _, _) in enumerate(rows)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    return [tuple(r) for r in covertree.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def corpus(n=160, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, [None] + [1.0] * 15, 1), (1005, [float("inf")] + [1.0] * 15, 1), (1006, [1.0] * 16, None), (1007, [1.0] * 16, None), (None, [1.0] * 16, 1), (None, [1.0] * 16, 1), (None, [-1.0] * 16, 2), (1008, [1.0] * 3, 1)]
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35, 2])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 2) if i % 3 else 0)))
    return rows + [rows[20]] * 6 + [(500 + k, *rows[21][1:]) for k in range(6)]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = sorted(brute(rows), key=key)
    assert sorted(run(spark, rows), key=key) == want
    monkeypatch.setattr(covertree, "LEAF", 20)
    monkeypatch.setattr(covertree, "PIVOTS", 6)
    monkeypatch.setattr(covertree, "SLICE", 30)
    assert sorted(run(spark, rows), key=key) == want


def test_finite_vectors_of_any_size(spark):
    """Only null, zero and null or non-finite components make a vector invalid, however large or small it is."""
    rows = [(1, [1e200, 0.0], 1, ""), (2, [1e200, 1e190], 1, ""), (3, [1e-320, 0.0], 1, ""), (4, [5e-324, 0.0], 1, ""), (5, [0.0, 1.7e308], 1, ""), (6, [0.0, 0.0], 1, ""), (7, [float("inf"), 0.0], 1, "")]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    out = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(df).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_dual_traversal_dense_and_sparse(monkeypatch):
    """Blocks of children and single pairs give the same links as all dot products."""
    rng = np.random.default_rng(9)
    x = np.concatenate((rng.normal(size=(300, 12)), np.repeat(rng.normal(size=(6, 12)), 40, axis=0) + rng.normal(size=(240, 12)) * 0.08))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[::3] + rng.normal(size=(180, 12)) * 0.02
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    w, wy = rng.integers(1, 4, len(x)).astype(float), rng.integers(1, 4, len(y)).astype(float)
    for dense, centres in ((4096, 256), (4, 7), (1 << 40, 1)):
        monkeypatch.setattr(covertree, "DENSE", dense)
        monkeypatch.setattr(covertree, "CENTRES", centres)
        near = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
        nx, _, u, v = covertree.link_counts(x, w, None, None, 0.93)
        assert (nx == near @ w).all()
        label, want = covertree.local_components(len(x), u, v), covertree.local_components(len(x), *np.nonzero(near))
        assert (label == want).all()
        near = x @ y.T >= 0.93
        nx, ny, u, v = covertree.link_counts(x, w, y, wy, 0.93)
        assert (nx == near @ wy).all() and (ny == near.T @ w).all()


def test_embeddings_and_empty(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert run(spark, []) == []


def test_tree_covers_and_nests():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[0] + rng.normal(size=(100, 8)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = covertree.CoverTree(x)
    assert sorted(tree.order) == list(range(300))
    for k in range(len(tree.point)):
        mine = tree.order[tree.lo[k] : tree.hi[k]]
        assert tree.point[k] in mine
        assert tree.distances(x[mine], x[tree.point[k]]).max() <= tree.radius[k] + 1e-6
        if not tree.leaf[k]:
            assert tree.hi[tree.last[k] - 1] == tree.hi[k] and tree.lo[tree.first[k]] == tree.lo[k]
