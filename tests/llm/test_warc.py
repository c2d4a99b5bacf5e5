import gzip
import hashlib
import random
from collections import defaultdict

import pytest

from tarn.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def brute(rows):
    body = [(h or "").encode() for _, _, h in rows]
    groups = defaultdict(list)
    for (p, _, _), b in zip(rows, body):
        if len(b) >= 1000:
            groups[b].append(p)
    out = []
    for (p, _, _), b in zip(rows, body):
        ids = [x for x in groups.get(b, []) if x is not None]
        best = max(ids, default=None)
        again = len(b) >= 1000 and len(groups[b]) > 1 and p != best
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best if again else None))
    return out


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA)
    out = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, out.collect()), key=key)


def corpus():
    rng = random.Random(0)
    text = lambda n: "".join(rng.choice("ab\r\n é日0") for _ in range(n))
    rows = [(None, None, None), (None, "u", text(1500)), (1, "http://a/b c\r\nX: y", ""), (2, "é", "WARC/1.1\r\n\r\n" * 300)]
    large = text(200_000)
    rows += [(3, "x", large), (4, "x", large), (5, "y", large), (5, "y", large), (6, "z", text(100_000)), (6, "z", text(90_000))]
    rows += [(10 + i, "s", "short") for i in range(3)] + [(20 + i, f"u{i}", text(rng.randrange(5000))) for i in range(30)] + [(60 + i, "c", "x" * 1000) for i in range(5)] + [(70, "c", "x" * 999)] * 2
    return rows


def test_round_trip(spark):
    rows = corpus()
    assert run(spark, rows) == sorted(brute(rows), key=key)
    assert run(spark, []) == []


def test_many_files_and_payloads(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE", 50_000)
    rows = corpus()
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    warc.write(df, f"{tmp_path}/w", segment=777)
    files = list((tmp_path / "w").glob("*.gz"))
    assert len(files) > 4
    kinds = [h["warc-type"] for f in files for h, _ in warc.parse(warc.inflated(memoryview(f.read_bytes())))]
    assert kinds.count("continuation") > 100
    back = [bytes(r.payload).decode() for r in warc.read(spark, f"{tmp_path}/w").where("type = 'response'").collect()]
    want = [(r[2] or "") for r, b in zip(rows, brute(rows)) if b[3] == "response"]
    assert sorted(back) == sorted(want)


def test_archives_are_the_same_in_every_run(spark, monkeypatch, tmp_path):
    """Whatever order rows come in: a task that is run again deals the same records to the same files."""
    monkeypatch.setattr(warc, "FILE", 50_000)
    rows = [(*r, "") for r in corpus()]
    for name, some in (("a", rows), ("b", rows[::-1])):
        warc.write(spark.createDataFrame(some, SCHEMA).repartition(3 if name == "a" else 5), f"{tmp_path}/{name}", segment=777)
    one, two = (sorted(f.read_bytes() for f in (tmp_path / name).glob("*.gz")) for name in "ab")
    assert len(one) > 4 and one == two


def test_archives_of_many_members_in_pieces():
    records = [warc.record("response", f"<{i}>", [], b"x\r\n\r\n" * i) + b"\r\n\r\n" for i in range(200)]
    packed = b"".join(gzip.compress(b"".join(records[i : i + 3])) for i in range(0, 200, 3))
    assert [(h["warc-record-id"], len(b)) for h, b in warc.parse(warc.inflated(memoryview(packed)))] == [(f"<{i}>", 5 * i) for i in range(200)]
    whole = b"".join(records)
    assert len(list(warc.parse(whole[i : i + 1] for i in range(len(whole))))) == 200
    with pytest.raises(ValueError):
        list(warc.inflated(memoryview(gzip.compress(whole)[:-9])))
    with pytest.raises(ValueError):
        list(warc.parse(iter([whole[:-3]])))


def test_damage_is_noticed():
    block = warc.framed(b"x" * 20_000)
    assert warc.reassembled([(1, block[:9]), (2, block[9:])], len(block)) == (b"x" * 20_000, 1)
    for parts, total in (([(2, block)], len(block)), ([(1, block[:9]), (3, block[9:])], len(block)), ([(1, block)], 7)):
        with pytest.raises(ValueError):
            warc.reassembled(parts, total)
    with pytest.raises(ValueError):
        warc.unframed(block.replace(b"2000\r\n", b"1fff\r\n"))
