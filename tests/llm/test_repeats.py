import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tarn.llm import repeats, substring, suffix, windows

SCHEMA = "doc_id long, text string, n_removed string"


def corpus(seed=5):
    """Copies, near copies, shared passages, repeats inside a text, nulls, short texts, clashing columns."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["größe", "日本", "🎈"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, common = words(70), words(55)
    rows = [(None, " ".join(passage)), (7, None), (8, ""), (9, "short one"), (10, "a " * 300)]
    for i in range(20, 60):
        text = words(rng.randrange(30, 200))
        if i % 3 == 0:
            text[10:10] = passage
        if i % 4 == 0:
            text += common + ["x"] + common
        rows.append((i, (" " if i % 2 else "\n\t").join(text)))
    base = words(400)
    for i in range(60, 80):
        near = list(base)
        near[rng.randrange(400)] = "changed%d" % i
        rows.append((i, " ".join(near if i % 2 else base)))
    rows += [rows[10], (rows[12][0], rows[13][1]), (90, " ".join(base * 3))]
    rng.shuffle(rows)
    return rows


def brute_words(rows, window):
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        rank = (i is None, i or 0)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i is None, i or 0):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def brute_bytes(rows, window):
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(x for k, x in enumerate(b) if not gone[k])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


def by_words(spark, rows, **options):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    out = substring.drop_repeats(df, **options).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) h")
    return sorted(map(tuple, out.collect()), key=key)


def by_bytes(spark, rows, **options):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    out = suffix.drop_repeats(df, **options).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept_bytes, 256) h")
    return sorted(map(tuple, out.collect()), key=key)


@pytest.mark.parametrize("hot", [256, 3])
def test_word_windows_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus()
    assert by_words(spark, rows) == sorted(brute_words(rows, 50), key=key)


@pytest.mark.parametrize("hot", [256, 3])
def test_byte_windows_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus()
    assert by_bytes(spark, rows) == sorted(brute_bytes(rows, 200), key=key)


def test_small_chunks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 500)
    monkeypatch.setattr("tarn.llm.windows.SLICE_BYTES", 700)
    rows = corpus(6)
    assert by_words(spark, rows) == sorted(brute_words(rows, 50), key=key)
    assert by_bytes(spark, rows) == sorted(brute_bytes(rows, 200), key=key)


def test_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert by_words(spark, rows) == sorted(brute_words(rows, 50), key=key)
    assert by_bytes(spark, rows) == sorted(brute_bytes(rows, 200), key=key)


def test_empty_table(spark):
    assert by_words(spark, []) == [] == by_bytes(spark, [])


def test_layout_keeps_untouched_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a\n\n{passage}\nb"), (2, f"c  d\n{passage}\n e \n f")]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    out = {r.doc_id: r.kept_text for r in substring.drop_repeats(df, layout=True).collect()}
    assert out == {1: rows[0][1], 2: "c  d e \n f"}


def test_run_index_is_exact():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(40)] + [b"abab" * 9] * 3
    index = suffix.RunIndex(strings)
    text = index.text.tobytes()
    assert index.run_lengths.sum() == len(text)
    got = index.matching_statistics()
    for p in range(0, len(text), 7):
        stop = text.index(b"\xff", p)
        best = max((n for n in range(stop - p, 0, -1) if any(text.startswith(text[p : p + n], q) for q in range(len(text)) if q != p)), default=0)
        assert got[p] == best


def test_strings_that_collide_are_told_apart(spark):
    """Thue-Morse words of order 11 and their complements have equal polynomial hashes for any odd base."""
    word = bytes(b"ab"[i.bit_count() % 2] for i in range(1 << 11))
    unlike = word.translate(bytes.maketrans(b"ab", b"ba"))
    h = windows.PrefixHash(np.frombuffer(word + unlike, np.uint8)).ranges(np.array([0, 2048]), np.array([2048, 4096]))
    assert h[0] == h[1]
    around = [f"w{i}" for i in range(80)]
    text = lambda w: " ".join([*around[:40], w.decode(), *around[40:]])
    rows = [(1, text(word)), (2, text(unlike)), (3, text(word)), (4, text(word) + " end")]
    assert by_words(spark, rows) == sorted(brute_words(rows, 50), key=key)
    data = word + unlike + word
    starts = np.array([0, 2048, 4096])
    number = windows.told_apart(data, starts, starts + 2048, np.zeros(3, np.int64), np.zeros(3, np.int64))
    assert number[0] == number[2] != number[1]


def test_rows_that_repeat_very_often(spark):
    text = " ".join(f"w{i}" for i in range(70))
    df = spark.range(100_000).selectExpr("1L as doc_id", f"'{text}' as text").union(spark.createDataFrame([(2, text + " more")], "doc_id long, text string"))
    out = substring.drop_repeats(df).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(1, 0, 100_000), (2, 70, 1)]
    out = suffix.drop_repeats(df).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(1, len(text), len(text), 100_000), (2, len(text) + 5, len(text), 1)]
