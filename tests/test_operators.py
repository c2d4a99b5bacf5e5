"""Cases that the driver's tables don't hold: nulls, ties, empty tables, cycles, formats, streams."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.functions import arrays, binary, datetime, geometry, json, math, network, ranges, string, textsearch
from tarn.operators import aggregates, dml, joins, recursive, sorting, timeseries, windows
from tarn.sources import copy
from tarn.streaming import windows as event_time


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_order_and_ties(spark):
    df = frame(spark, [(1, None), (2, 5), (3, 5), (4, 7), (5, None)], "id int, v int")
    assert [r.id for r in sorting.order_by(df, "v", "id").collect()] == [2, 3, 4, 1, 5]
    assert [r.id for r in sorting.order_by(df, "v desc", "id").collect()] == [1, 5, 4, 2, 3]
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(sorting.with_ties(df, ["v"], 1)) == [2, 3]
    assert ids(sorting.with_ties(df, ["v desc"], 1)) == [1, 5]
    assert ids(sorting.with_ties(df, ["v desc nulls last"], 2)) == [2, 3, 4]
    assert ids(sorting.with_ties(df, ["v"], 4)) == [1, 2, 3, 4, 5] and ids(sorting.with_ties(df, ["v"], 9)) == [1, 2, 3, 4, 5]
    assert [tuple(r) for r in sorting.distinct_on(df, ["v"], ["id desc"]).orderBy("id").collect()] == [(3, 5), (4, 7), (5, None)]


def test_joins_with_nulls(spark):
    a, b = frame(spark, [(1,), (2,), (None,)], "x int"), frame(spark, [(2,), (None,)], "y int")
    assert joins.not_in(a, "x", b, "y").collect() == []
    assert [r.x for r in joins.not_in(a, "x", b.na.drop(), "y").collect()] == [1]
    assert joins.not_in(a, "x", b.limit(0), "y").count() == 3
    left = frame(spark, [("k", 5, "a"), ("k", 1, "b"), ("z", 9, "c")], "k string, t int, n string")
    right = frame(spark, [("k", 2, 10), ("k", 5, 20), ("k", None, 30)], "k string, at int, v int")
    assert sorted((r.n, r.v) for r in joins.asof(left, right, ["k"], "t", "at", ["v"]).collect()) == [("a", 20), ("b", None), ("c", None)]
    left = frame(spark, [("k" if i % 3 else None, (i * 37) % 101, i) for i in range(90)] + [("k", None, 99)], "k string, t int, i int")
    right = frame(spark, [("k" if i % 4 else None, (i * 53) % 103, i) for i in range(30)], "k string, at int, v int")
    plain, cut = (sorted(map(repr, joins.asof(left, right, ["k"], "t", "at", ["v"], cell=c).collect())) for c in (None, lambda t: F.floor(t / 10)))
    assert plain == cut and len(cut) == 91


def test_quantified_comparisons_with_nulls(spark):
    rows = frame(spark, [(1,), (2,), (5,), (None,)], "x int")
    want = lambda op, how, members: [{"any": any, "all": all}[how](a) if None not in a or ({"any": True, "all": False}[how] in a) else None for a in ([None if x is None or m is None else eval(f"{x} {op} {m}") for m in members] for x in (1, 2, 5, None))]
    for members in ([2], [1, 2], [None, 2], [], [None]):
        sub = frame(spark, [(m,) for m in members], "m int")
        for op in ("=", "<>", "<", "<=", ">", ">="):
            for how in ("any", "all"):
                got = {r.x: r.q for r in joins.quantified(rows, "x", op, how, sub, "m", "q").collect()}
                assert [got[x] for x in (1, 2, 5, None)] == want({"=": "==", "<>": "!="}.get(op, op), how, members), (op, how, members)


def test_exclusion_against_all_pairs(spark):
    from tarn.operators import constraints

    rows = [(i, i % 2, (i * 37) % 100, (i * 37) % 100 + i % 7) for i in range(80)]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    out = constraints.exclusion_violations(frame(spark, rows, "id int, k int, lo int, hi int"), "k", "lo", "hi", "id")
    assert sorted(map(tuple, out.collect())) == want


def test_aggregates(spark):
    df = frame(spark, [("a", 1, 3), ("a", None, 2), ("a", 3, 1), ("b", None, 1)], "g string, x int, k int")
    out = {r.g: r for r in df.groupBy("g").agg(aggregates.array_agg(F.col("x"), F.col("k")).alias("l"), aggregates.string_agg(F.col("x"), ";", F.col("k")).alias("s"), aggregates.json_agg(F.col("x"), F.col("k")).alias("j")).collect()}
    assert out["a"].l == [3, None, 1] and out["a"].s == "3;1" and out["a"].j == "[3,null,1]"
    assert out["b"].l == [None] and out["b"].s is None
    spans = frame(spark, [("a", 1, 3), ("a", 3, 4), ("a", 6, 9), ("a", 7, 8), ("a", 5, 5)], "g string, lo int, hi int")
    assert sorted((r.lo, r.hi) for r in aggregates.range_agg(spans, ["g"], "lo", "hi").collect()) == [(1, 4), (6, 9)]
    twice = frame(spark, [("k", 1), ("k", 2), ("j", None)], "k string, v int")
    assert twice.agg(aggregates.json_object_agg(F.col("k"), F.col("v"))).first()[0] == '{"j":null,"k":1,"k":2}'
    assert twice.agg(aggregates.json_object_agg(F.col("k"), F.col("v"), unique=True)).first()[0] == '{"j":null,"k":2}'
    many = spark.range(50_000).selectExpr("id % 3 g", "id v")
    longest = aggregates.combining_aggregate(many, ["g"], F.col("v"), "m", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s")), lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["s"] + x).alias("s")), lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["s"] + b["s"]).alias("s")), lambda s: s["s"] / s["n"])
    assert sorted(map(tuple, longest.collect())) == sorted(map(tuple, many.groupBy("g").avg("v").collect()))
    assert spans.limit(0).agg(aggregates.array_agg(F.col("lo")).alias("l")).first().l is None


def test_window_features(spark):
    df = frame(spark, [(1, 10), (2, 10), (3, 20), (4, None)], "id int, v int")
    w, peers = Window.partitionBy(F.lit(1)), Window.partitionBy("v")
    pick = lambda what: [r.s for r in df.withColumn("s", windows.sum_excluding(F.col("v"), w, peers, what)).orderBy("id").collect()]
    assert pick("current row") == [30, 30, 20, 40] and pick("group") == [20, 20, 20, 40] and pick("ties") == [30, 30, 40, 40]
    assert [r.n for r in windows.groups_frame(df, "n", F.count("*"), [], ["v"], 1, 0).orderBy("id").collect()] == [2, 2, 3, 2]
    last = lambda n, *frame: windows.nth_from_last(F.col("v"), n, [], ["id"], *frame)
    assert df.select(last(1).alias("x"), last(9).alias("y")).first() == (None, None)
    assert [r.x for r in df.select("id", last(2).alias("x")).orderBy("id").collect()] == [20] * 4
    assert [r.x for r in df.select("id", last(2, 1, 1).alias("x")).orderBy("id").collect()] == [10, 10, 20, 20]


@pytest.mark.parametrize("what", ["current row", "group", "ties", "no others"])
def test_excluding_frames_against_brute_force(spark, what):
    rows = [(i, i * 7 % 4, None if i % 5 == 0 else i * i % 11, "ab"[i % 2]) for i in range(40)]
    df = frame(spark, rows, "id int, k int, v long, g string")
    for before, after in ((None, None), (2, 1), (0, 3), (None, 0), (4, -2)):
        out = windows.aggregate_excluding(df, "s", "v", ["g"], ["k", "id"] if before == 4 else ["k"], before, after, what)
        counts = {r.id: r.s for r in windows.aggregate_excluding(df, "s", "v", ["g"], ["k", "id"], before, after, what, "count").collect()}
        for g in "ab":
            mine = sorted((r for r in rows if r[3] == g), key=lambda r: (r[1], r[0]))
            for i, r in enumerate(mine):
                low, high = 0 if before is None else max(0, i - before), len(mine) - 1 if after is None else min(len(mine) - 1, i + after)
                gone = {"current row": [i], "group": [i], "ties": [], "no others": []}[what]  # ordered by k and id, a row has no peers
                assert counts[r[0]] == sum(mine[j][2] is not None for j in range(low, high + 1) if j not in gone)
        assert out.count() == len(rows)
    whole = {r.id: r.s for r in windows.aggregate_excluding(df, "s", "v", ["g"], ["k"], None, None, what).collect()}
    for r in rows:
        others = [x[2] for x in rows if x[3] == r[3] and x[2] is not None and {"current row": x[0] != r[0], "group": x[1] != r[1], "ties": x[1] != r[1] or x[0] == r[0], "no others": True}[what]]
        assert whole[r[0]] == (sum(others) if others else None)


def test_recursion(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    out = recursive.recursive(frame(spark, [(1,)], "n int"), lambda new: new.join(e, F.col("a") == F.col("n")).select("b"))
    assert sorted(r.n for r in out.collect()) == [1, 2, 3, 4]
    up = recursive.recursive(frame(spark, [(1,)], "n int"), lambda new: new.where("n < 5").selectExpr("n + 1"), distinct=False)
    assert sorted(r.n for r in up.collect()) == [1, 2, 3, 4, 5]


def test_merge_rules(spark):
    target, source = frame(spark, [(1, "a"), (2, "b")], "k int, v string"), frame(spark, [(2, "B"), (3, "C")], "k int, v string")
    out = dml.upsert(target, source, ["k"], {"v": F.col("s.v")})
    assert sorted(map(tuple, out.table.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted((r.action, r.new.k) for r in out.returning.collect()) == [("INSERT", 3), ("UPDATE", 2)]
    assert sorted(map(tuple, dml.delete_using(target, source, ["k"]).table.collect())) == [(1, "a")]
    twice = source.union(source)
    assert sorted(map(tuple, dml.update_from(target, twice, ["k"], {"v": F.col("s.v")}).table.collect())) == [(1, "a"), (2, "B")]
    with pytest.raises(Exception, match="second time"):
        dml.merge(target, twice, ["k"], [dml.When("matched", "update", {"v": F.col("s.v")})]).table.collect()
    with pytest.raises(Exception, match="second time"):
        dml.upsert(target, twice.where("k = 3"), ["k"], {"v": F.col("s.v")}).table.collect()
    assert dml.merge(target, twice.where("k = 3"), ["k"], [dml.When("matched", "delete")]).table.count() == 2
    nulls = frame(spark, [(None, "x"), (None, "y"), (1, "z"), (1, "z")], "k int, v string")
    assert sorted(map(repr, map(tuple, dml.upsert(target, nulls, ["k"]).table.collect()))) == ["(1, 'a')", "(2, 'b')", "(None, 'x')", "(None, 'y')"]
    assert dml.upsert(target, nulls.limit(2), ["k"], {"v": F.col("s.v")}).table.count() == 4
    assert sorted(map(tuple, dml.upsert(target, source.limit(0), ["k"]).table.collect())) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: math.div(F.lit(-7), F.lit(2)), -3),
        (lambda: math.trunc(F.lit(-2.567), 1).cast("double"), -2.5),
        (lambda: math.trunc(F.lit(0.29), 2).cast("double"), 0.29),
        (lambda: math.trunc(F.lit(-1e300)), -1e300),
        (lambda: math.div(F.lit(9007199254740993), F.lit(1)), 9007199254740993),
        (lambda: math.to_int(F.lit(2.5)), 2),
        (lambda: math.gcd(F.lit(12), F.lit(18)), 6),
        (lambda: math.factorial(F.lit(25)), "15511210043330985984000000"),
        (lambda: math.width_bucket_of(F.lit(5.0), [1, 3, 5, 9]), 3),
        (lambda: math.trim_scale(F.lit("8.4100")), "8.41"),
        (lambda: string.substring(F.lit("thomas"), -1, 4), "th"),
        (lambda: string.left(F.lit("abc"), -5), ""),
        (lambda: string.regexp_replace(F.lit("abcabc"), "b", "$X"), "a$Xcabc"),
        (lambda: string.regexp_replace(F.lit("ABC"), "b", "x", "gi"), "AxC"),
        (lambda: string.regexp_replace(F.lit("none"), "z", "x"), "none"),
        (lambda: string.regexp_replace(F.lit("foobarbaz"), "b(..)", r"X\1Y", "g"), "fooXarYXazY"),
        (lambda: string.regexp_replace(F.lit("foobarbaz"), "b(..)", r"<\&|\1>"), "foo<bar|ar>baz"),
        (lambda: string.regexp_replace(F.lit("xaabb"), r"(a)\1", r"\\"), "x\\bb"),
        (lambda: string.similar_to(F.lit("abc"), "(a|b)%"), True),
        (lambda: string.similar_to(F.lit("abc"), "[[:alpha:]]+"), True),
        (lambda: string.similar_to(F.lit("a]c"), "[]a[:digit:]]+c"), True),
        (lambda: string.substring_similar(F.lit("foobar"), '%#"o_b#"%'), "oob"),
        (lambda: string.quote_ident(F.lit("select")), '"select"'),
        (lambda: string.unistr(F.lit(r"d\0061t\+000061 \u0061\U00000061\\")), "data aa\\".replace(" ", " ")),
        (lambda: string.chr_(F.lit(8364)), "€"),
        (lambda: string.regexp_instr(F.lit("number of your street, 52"), "[0-9]+"), 24),
        (lambda: json.exists(F.lit(None).cast("string"), "a"), None),
        (lambda: json.set_(F.lit('{"n": 1.10}'), ["k"], 1), '{"n": 1.10, "k": 1}'),
        (lambda: string.similar_to(F.lit("abc"), "a.c"), False),
        (lambda: string.quote_ident(F.lit('We "x"')), '"We ""x"""'),
        (lambda: string.quote_nullable(F.lit(None).cast("string")), "NULL"),
        (lambda: string.quote_literal(F.lit("O'Reilly")), "'O''Reilly'"),
        (lambda: string.format_("%s=%L (%I)%% %1$s", F.lit("a"), F.lit(None).cast("string"), F.lit("A b")), 'a=NULL ("A b")% a'),
        (lambda: string.initcap(F.lit("hello wORLD-foo")), "Hello World-Foo"),
        (lambda: string.unaccent(F.lit("Hôtel")), "Hotel"),
        (lambda: string.string_to_array(F.lit("a.b.NULL"), ".", "NULL"), ["a", "b", None]),
        (lambda: string.trigrams(F.lit("cat")), ["  c", " ca", "at ", "cat"]),
        (lambda: F.round(string.similarity(F.lit("word"), F.lit("two words")), 6), 0.363636),
        (lambda: arrays.array_positions(F.array(F.lit(1), F.lit(2), F.lit(1)), F.lit(1)), [1, 3]),
        (lambda: arrays.array_replace(F.array(F.lit(1), F.lit(None)), F.lit(None), F.lit(9)), [1, 9]),
        (lambda: arrays.any_of(F.lit(3), "=", F.array(F.lit(1), F.lit(None))), None),
        (lambda: arrays.all_of(F.lit(3), ">", F.array(F.lit(1), F.lit(5), F.lit(None))), False),
        (lambda: json.set_(F.lit('{"a": [1]}'), ["a", "0"], 5), '{"a": [5]}'),
        (lambda: json.delete_path(F.lit('{"a": {"b": 1, "c": 2}}'), ["a", "b"]), '{"a": {"c": 2}}'),
        (lambda: json.strip_nulls(F.lit('{"a": null, "b": [null]}')), '{"b": [null]}'),
        (lambda: json.contains(F.lit('{"a": [1, {"b": 2}]}'), F.lit('{"a": [{"b": 2}]}')), True),
        (lambda: json.concat(F.lit("[1]"), F.lit("2")), "[1, 2]"),
        (lambda: json.typeof(F.lit(" -1")), "number"),
        (lambda: json.is_json(F.lit("{a"), "object"), False),
        (lambda: ranges.text(ranges.make(F.lit(1), F.lit(3), "(]", discrete=True)), "[2,4)"),
        (lambda: ranges.text(ranges.make(F.lit(1), F.lit(1))), "empty"),
        (lambda: ranges.adjacent(ranges.make(F.lit(1), F.lit(3)), ranges.make(F.lit(3), F.lit(5))), True),
        (lambda: ranges.overlaps(ranges.make(F.lit(1), F.lit(3)), ranges.make(F.lit(3), F.lit(5))), False),
        (lambda: ranges.contains(ranges.make(F.lit(None).cast("int"), F.lit(3)), F.lit(-99)), True),
        (lambda: ranges.text(ranges.intersection(ranges.make(F.lit(1), F.lit(5)), ranges.make(F.lit(3), F.lit(9)))), "[3,5)"),
        (lambda: geometry.polygon_area(F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 3))])), 6.0),
        (lambda: geometry.closest_point(geometry.lseg(geometry.point(F.lit(0), F.lit(0)), geometry.point(F.lit(4), F.lit(0))), geometry.point(F.lit(1), F.lit(5)))["x"], 1.0),
        (lambda: network.network(F.lit("192.168.5.77/20")), "192.168.0.0/20"),
        (lambda: network.hostmask(F.lit("10.1.2.3/12")), "0.15.255.255"),
        (lambda: network.inet_merge(F.lit("192.168.1.5/24"), F.lit("192.168.2.5/24")), "192.168.0.0/22"),
        (lambda: binary.uuid_v3("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("python.org")), "6fa459ea-ee8a-3ca4-894e-db77e160355e"),
        (lambda: binary.uuid_v5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("python.org")), "886313e1-3b8a-5372-9b90-0c9aee199e5d"),
        (lambda: binary.crc32c(F.lit(b"123456789")), 0xE3069283),
        (lambda: F.hex(binary.set_byte(F.lit(b"\x01\x02\x03"), 1, 255)), "01FF03"),
        (lambda: F.lower(F.hex(binary.hmac(F.lit("what do ya want for nothing?"), b"Jefe"))), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
        (lambda: binary.xml_is_well_formed(F.lit("<a><b></a>")), False),
        (lambda: binary.xpath(F.lit("<a><b>1</b><b>2</b></a>"), "a/b/text()"), ["1", "2"]),
    ],
)
def test_functions(spark, make, want):
    assert one(spark, make()) == want


def test_dates(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert tuple(one(spark, datetime.age(ts("2024-03-15 10:00:00"), ts("2023-01-20 12:00:00")))) == (13, 25, 79_200_000_000)
    assert tuple(one(spark, datetime.age(ts("2001-04-10"), ts("1957-06-13")))) == (43 * 12 + 9, 27, 0)
    assert tuple(one(spark, datetime.age(ts("2023-01-20"), ts("2024-01-20")))) == (-12, 0, 0)
    assert tuple(one(spark, datetime.justify_hours(datetime.age(ts("2024-01-03"), ts("2024-01-01"))))) == (0, 2, 0)
    assert one(spark, timeseries.date_bin(900, ts("2024-01-01 10:07:30"))) == dt.datetime(2024, 1, 1, 10, 0)
    assert one(spark, datetime.to_char(ts("2024-02-03 14:05:06"), "DD Mon YYYY HH12:MI AM")) == "03 Feb 2024 02:05 PM"
    assert one(spark, datetime.to_timestamp(F.lit("2024/02/03 14"), "YYYY/MM/DD HH24")) == dt.datetime(2024, 2, 3, 14)
    assert one(spark, datetime.overlaps(ts("2024-01-01"), ts("2024-01-02"), ts("2024-01-02"), ts("2024-01-03"))) is False


def test_text_search(spark):
    df = frame(spark, [(1, "The quick brown foxes jumped"), (2, "a lazy dog; the fox"), (3, "")], "id int, t string")
    docs = df.select("id", textsearch.to_tsvector(F.col("t")).alias("v"))
    ids = lambda q: [r.id for r in docs.where(q.match(F.col("v"))).orderBy("id").collect()]
    assert docs.where("id = 1").first().v == {"quick": [2], "brown": [3], "fox": [4], "jump": [5]}
    assert ids(textsearch.to_tsquery("jumping & !dog")) == [1]
    assert ids(textsearch.to_tsquery("fo:*")) == [1, 2]
    assert ids(textsearch.phraseto_tsquery("quick brown")) == [1] and ids(textsearch.to_tsquery("brown <-> quick")) == []
    assert ids(textsearch.websearch_to_tsquery('"lazy dog" or jumps -fox')) == [2]
    q = textsearch.to_tsquery("a1 & (b1 | !c1)")
    assert q.numnode() == 6 and str(q) == "'a1' & ( 'b1' | !'c1' )"
    assert str(q.replace(textsearch.to_tsquery("b1"), textsearch.to_tsquery("x <2> y"))) == "'a1' & ( 'x' <2> 'y' | !'c1' )"
    assert ids(textsearch.to_tsquery("quick <2> foxes")) == [1] and ids(textsearch.to_tsquery("quick <3> foxes")) == []
    assert textsearch.ts_lexize("foxes") == ["fox"] and textsearch.ts_lexize("the") == []
    both = docs.where("id = 1").select(textsearch.tsvector_concat(F.col("v"), textsearch.array_to_tsvector(F.array(F.lit("new"))))).first()[0]
    assert both["jump"] == [5] and both["new"] == []


def test_copy_round_trip(spark, tmp_path):
    schema = StructType.fromDDL("a int, b string, c timestamp_ntz")
    rows = [(1, "tab\there\nline \\t \\ end", dt.datetime(2024, 1, 1)), (None, None, None), (2, "", None), (3, "\\N", None)]
    df = spark.createDataFrame(rows, schema)
    copy.copy_to(df, f"{tmp_path}/t")
    back = [tuple(r) for r in copy.copy_from(spark, f"{tmp_path}/t", schema).collect()]
    assert sorted(map(repr, back)) == sorted(map(repr, rows))
    lines = [r.value for r in copy.to_text(df).collect()]
    assert "\\N\t\\N\t\\N" in lines
    copy.copy_to(df.drop("c").where("b is null or b <> ''"), f"{tmp_path}/c", "csv")
    again = copy.copy_from(spark, f"{tmp_path}/c", StructType.fromDDL("a int, b string"), "csv")
    assert again.count() == 3


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = event_time.events_stream(spark, f"{tmp_path}/in", 1)
    plan = lambda df: event_time.tumbling(df, "ts", "1 day", ["event_type"], F.count("*").alias("n"), late="60 days")
    run = plan(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, plan(events).collect()))
    assert event_time.session(events, "ts", "2 hours", ["user_id"], F.count("*").alias("n")).agg(F.sum("n")).first()[0] == events.count()


def test_definitions(spark):
    from tarn.operators import ddl

    mood = ddl.Enum("mood", ("sad", "ok", "happy"))
    assert one(spark, mood.compare(F.lit("sad"), F.lit("happy"))) == -1 and one(spark, mood.range("ok")) == ["ok", "happy"]
    assert mood.added("fine", before="happy").labels == ("sad", "ok", "fine", "happy") and mood.renamed("ok", "fair").labels == ("sad", "fair", "happy")
    with pytest.raises(Exception, match="invalid input value for enum"):
        one(spark, mood.cast(F.lit("angry")))
    positive = ddl.Domain("positive", "int", lambda v: v > 0)
    assert one(spark, positive.cast(F.lit("7"))) == 7 and one(spark, positive.cast(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="violates a constraint"):
        one(spark, positive.cast(F.lit(-1)))
    df = frame(spark, [(1, "a"), (1, "a"), (None, "b")], "k int, v string")
    assert sorted(r.i for r in ddl.identity(df, "i", 10, -2).collect()) == [6, 8, 10]
    child = frame(spark, [(1, 1), (2, 2), (3, None)], "id int, p int")
    parent = frame(spark, [(1,), (2,)], "k int")
    with pytest.raises(Exception, match="foreign key"):
        ddl.delete_cascading(parent, child, [("k", "p")], F.col("k") == 1, "restrict")[1].collect()
    assert sorted((r.id, r.p) for r in ddl.delete_cascading(parent, child, [("k", "p")], F.col("k") == 1)[1].collect()) == [(2, 2), (3, None)]


def test_json_paths():
    from tarn.functions import jsonpath

    doc = {"a": [1, 2, {"b": "x"}], "s": "abc", "n": None, "t": True}
    for path, want in [
        ("$.a[*]", [1, 2, {"b": "x"}]),
        ("$.a[last].b", ["x"]),
        ("$.a[0 to 1]", [1, 2]),
        ("$.a.b", ["x"]),
        ("$.a ? (@ > 1)", [2]),
        ("$.a[*] ? (@ > 1 || @ < 0)", [2]),
        ("$.** ? (@.b == \"x\").b", ["x", "x"]),
        ("$.a.size()", [3]),
        ("$.*.type()", ["array", "string", "null", "boolean"]),
        ("$.a[0] + $.a[1] * 2", [5]),
        ("-$.a[0]", [-1]),
        ("$.s starts with \"ab\"", [True]),
        ("$.s like_regex \"^A\" flag \"i\"", [True]),
        ("$.missing", []),
        ("$.n == null", [True]),
        ("exists($.a ? (@ == 9))", [False]),
        ("$.a[*] ? (@ == $x)", [2]),
        ("!($.t == true)", [False]),
        ("$.s > 1", [None]),
    ]:
        assert jsonpath.select(doc, path, {"x": 2}) == want, path
    with pytest.raises(jsonpath.PathError):
        jsonpath.select(doc, "$.a[")
