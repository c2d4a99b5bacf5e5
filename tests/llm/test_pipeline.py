import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_neardup import brute as brute_near
from tests.llm.test_packing import check as check_bins
from tests.llm.test_quality import brute as brute_quality
from tests.llm.test_repeats import brute_words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    steps = [f for _, f in corpus_pipeline.STAGES]

    one = steps[0](spark, docs, SF).cache()
    kept = {r[0] for r in brute_quality([(r.doc_id, r.source, r.text) for r in rows]) if r[-1]}
    assert one.columns == COLUMNS and Counter(r.doc_id for r in one.collect()) == Counter(kept)

    two = steps[1](spark, one, SF).cache()
    want = brute_near([(r.doc_id, r.text) for r in one.collect()])
    assert two.columns == COLUMNS and sorted(r.doc_id for r in two.collect()) == want

    three = steps[2](spark, two, SF).cache()
    cut = {i: (n, gone) for i, n, gone, _ in brute_words([(r.doc_id, r.text) for r in two.collect()], 50)}
    assert {r.doc_id: len(r.text.split()) for r in three.collect()} == {i: n - gone for i, (n, gone) in cut.items() if gone < n}
    assert all(r.n_chars == len(r.text) for r in three.collect())

    four = steps[3](spark, three, SF).cache()
    size = sum(len(r.text.split()) for r in three.collect())
    assert four.columns == COLUMNS and max(Counter(r.doc_id for r in four.collect()).values()) <= 2
    assert 1.4 * size <= sum(len(r.text.split()) for r in four.collect()) <= 1.5 * size

    five = steps[4](spark, four, SF).collect()
    check_bins([(r.doc_id, r.text) for r in four.collect()], five, (512, 1024, 2048, 4096))
    assert all(len(set(r.doc_ids)) == len(r.doc_ids) for r in five)


def test_own_columns_nulls_ties_and_repeats(spark):
    """Columns with the operators' names come out as they went in; the row of a null id, ties and repeated rows pass through."""
    rng = random.Random(1)
    text = lambda k: " ".join(rng.choice(["w%d" % i for i in range(500)]) for _ in range(k))
    rows = [(i, text(30 + i), "en", f"s{i % 3}", 5, "mine", "own", "x", "y", 7) for i in range(40)]
    rows += [(None, text(60), None, None, None, None, None, None, None, None), (50, None, "en", "s1", 0, "mine", "own", "x", "y", 7), (51, "", "en", "s1", 0, "mine", "own", "x", "y", 7)]
    rows += [rows[3]] * 4 + [(60, rows[4][1], "en", "s2", 5, "mine", "own", "x", "y", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, n_words string, target string, row string, spans string, size long"
    docs = spark.createDataFrame(rows, schema)
    own = {r[0]: r[5:] for r in rows}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "").cache()
        out = docs.collect()
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString(), name
        left = {r[0] for r in out}
        if name.startswith("mixing"):  # which gives a source its target, less than it has or more
            assert left <= before and len(left) > 30
        else:
            assert left == set(own) - {50, 51} - ({60} if name != "quality rules" else set()), name
        before = left
        assert all(tuple(r)[5:] == own[r[0]] and r.n_chars == len(r.text) for r in out), name
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    check_bins([(r.doc_id, r.text) for r in out], bins, (512, 1024, 2048, 4096))


def test_sequences_hold_their_texts(spark):
    docs = corpus_pipeline.mixed(spark, SF)
    words = {}
    for r in docs.collect():
        words.setdefault(r.doc_id, r.text.split())
    out = corpus_pipeline.sequences(spark, SF).collect()
    assert sum(b.used for b in out) == sum(len(r.text.split()) for r in docs.collect())
    for b in out:
        assert len(b.texts) == b.n_items and sum(len(x.split()) for x in b.texts) == b.used
        assert [" ".join(words[i.doc_id][i.start : i.end]) for i in b["items"]] == list(b.texts)


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
