import random
import re
from collections import Counter, defaultdict

from tarn.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, text string, kept string"


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in earlier
        earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)


def brute(rows, least=10, most=100, share=50):
    normal = lambda line: re.sub(r"\d+", "0", " ".join(line.lower().split()))
    documents, having = defaultdict(set), defaultdict(set)
    for i, host, text in rows:
        me = (i is None, i or 0, text or "")
        documents[host].add(me)
        for line in (text or "").split("\n"):
            if WORD.search(line):
                having[host, normal(line)].add(me)
    out = []
    for i, host, text in rows:
        c = brute_counts(text)
        lines, above = (text or "").split("\n"), []
        for x in lines:
            have = having[host, normal(x)] if WORD.search(x) else set()
            many = len(have) > least and (len(have) > most or share * len(have) > len(documents[host]))
            above.append(many and (i is None, i or 0, text or "") != min(have))
        left = len(WORD.findall("\n".join(x for x, bad in zip(lines, above) if not bad)))
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        out.append((i, *c, failed, not failed and left >= 20 and left >= c[0] / 2))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    return [tuple(r) for r in quality.judge(df).select("doc_id", *quality.COUNTS, "base_failed", "kept").collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def corpus():
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(80)] + ["größe", "#tag", "<b>", "a&b", "日本"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(None, None, None), (1, "a", ""), (2, "a", "\n\n x \n"), (3, "b", sentence(7))]
    for i in range(10, 150):
        lines = [sentence(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 8))]
        if i % 3 == 0:
            lines.insert(0, f"Page {i}  of many Words")
        if i % 7 == 0:
            lines += lines
        if i % 11 == 0:
            lines = ["Page 1 of many words"] * 2 + ["boiler plate of page %d that is longer than the rest of all of it put here" % i] * 2
        rows.append((i, rng.choice(["a", "a", "b", None]), rng.choice(["\n", "\n\t"]).join(lines)))
    return rows + [rows[20]] * 15


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert any(r[-1] for r in brute(rows)) and any(not r[-1] and not r[-2] for r in brute(rows))


def test_documents_and_empty(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert run(spark, []) == []


def test_lines_are_removed(spark):
    body = " ".join(f"w{i}" for i in range(30))
    letters = "abcdefghijklmnopqrst"
    rows = [(i, "h", f"Cookie notice {i}\n{body} {letters[i]}", "x") for i in range(20)] + [(99, "other", f"Cookie notice 1\n{body}", "x")]
    out = {r.doc_id: (r.kept_text, r.kept) for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[3] == (f"{body} d", True)
    assert out[0] == (f"Cookie notice 0\n{body} a", True)
    assert out[99] == (f"Cookie notice 1\n{body}", True)


def test_one_of_many_copies_stays(spark):
    """Every line of a group of copies is above the limit of its host; the first document keeps its text, the others are depleted."""
    text = "\n".join(" ".join(f"w{i}{j}" for j in range(10)) for i in "abcde")
    rows = [(i, "h", text, "x") for i in range(5, 45)] + [(i, f"g{i}", text, "x") for i in range(50, 60)]
    out = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i, kept in sorted(out.items()) if kept] == [5, *range(50, 60)]


def test_boilerplate_of_a_large_host_is_found(spark):
    """A line in 120 of 9000 documents is above the limit, one in 15 is not; in a small host 15 are enough."""
    body = lambda i: " ".join(f"x{i}y{j}" for j in range(25))
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, "large", ("all the same\n" if i < 120 else "some the same\n" if i < 135 else "") + letters(i) + " " + body(i), "x") for i in range(9000)]
    rows += [(10_000 + i, "small", f"some the same\n{letters(i)} {body(i)}", "x") for i in range(15)]
    out = quality.judge(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg({"n_lines_removed": "sum"}).collect()
    assert {r[0]: r[1] for r in out} == {"large": 119, "small": 14}
