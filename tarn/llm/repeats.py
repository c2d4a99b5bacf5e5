"""Repeated windows of a corpus, found in buckets of super-k-mers.

1. Every text becomes super-k-mers (runs of windows that share a minimiser), as narrow rows of
   position, minimiser and digest (64 bits of each, so 128 of content). Equal ones collapse in an aggregate with map-side combine,
   so a group of copies costs a row per task.
2. Only where one minimiser has several distinct strings, one packed string for each travels
   to the minimiser's bucket, which finds the windows that they share.
3. A minimiser with more than HOT strings doesn't travel whole: its strings are parted by more of
   their surroundings first, and where still more than HOT agree, windows are dealt out by
   their own 128-bit hash instead and counted there. The result is the same.
4. Covered positions go back to the documents, and each text is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import windows
from tarn.llm.common import Scratch, packed, stage, strings_of, text_hash

#: Distinct strings of a minimiser beyond which its windows are dealt out one by one.
HOT = 256
#: Windows in a block of those.
BLOCK = 16
CHUNK_BYTES = 1 << 20
ROWS_OUT = 100_000

#: A packed string: the bucket it goes to, what it came from, its windows, and at which of its origin's they begin.
PIECE = ["key", "minimiser", "digest", "low", "count", "n", "off", "string"]
PIECES = ", ".join(f"{c} long" for c in PIECE[:-1]) + ", string binary"

Resolver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Rule:
    """What counts as a repeat: `window` units (words or bytes), minimisers of `gram` units.

    earlier: only windows that also start in a document with a smaller id are removed, else
    all that start anywhere else. resolve(strings, windows, groups, lows, counts) gives a flag
    for each window of the strings, in order.
    """

    window: int
    gram: int
    words: bool
    earlier: bool
    resolve: Resolver


def units(text: memoryview | bytes, words: bool) -> bytes:
    return b" ".join(bytes(text).split()) if words else bytes(text)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, pa.int64()))


def positions(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs(id, th, text) to rows (id, th, first, n, minimiser, digest), one a super-k-mer."""
    window, gram, words = rule.window, rule.gram, rule.words

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, buf = strings_of(batch.column(2))
            texts = [units(buf[a:b], words) for a, b in zip(starts.tolist(), ends.tolist())]
            found, held = [], 0

            def flush(found=found, batch=batch):
                text, first, n, minimiser, digest = (np.concatenate(x) for x in zip(*found))
                at = pa.array(text)
                found_at = [pa.array(x, pa.int64()) for x in (first, n, minimiser, digest)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *found_at], ["id", "th", "first", "n", "minimiser", "digest"])

            for text, first, n, minimiser, digest in windows.superkmers(texts, window, gram, words):
                found.append((np.full(len(first), text), first, n, minimiser, digest))
                held += len(first)
                if held >= ROWS_OUT:
                    yield flush()
                    found.clear()
                    held = 0
            if found:
                yield flush()

    return docs.mapInArrow(extract, f"id {docs.schema['id'].dataType.simpleString()}, th long, first long, n long, minimiser long, digest long")


def strings(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """wanted(id, th, first, n, minimiser, digest, low, count, hot) with the packed string of each instead of its place."""
    window, words = rule.window, rule.words
    per = wanted.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "n", "minimiser", "digest", "low", "count", "hot"))).alias("w"))
    per = per.select(F.col("id").alias("w_id"), F.col("th").alias("w_th"), "w")
    joined = docs.join(per, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th"))).select("w", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, buf = strings_of(batch.column(1))
            want, at = batch.column(0), batch.column(0).offsets.to_numpy()
            flat = want.values
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                text = units(buf[a:b], words)
                mine = flat.slice(at[i], at[i + 1] - at[i])
                first, n = mine.field("first").to_numpy(), mine.field("n").to_numpy()
                last = first + n + window - 1
                if words:
                    s, e = windows.word_bounds(np.frombuffer(text, np.uint8))
                    first, last = s[first], e[last - 1]
                for lo in range(0, len(first), 20_000):
                    hi = lo + 20_000
                    part = [text[x:y] for x, y in zip(first[lo:hi].tolist(), last[lo:hi].tolist())]
                    rest = mine.slice(lo, len(part))
                    columns = [*(rest.field(c) for c in ("minimiser", "minimiser", "digest", "low", "count", "n")), pa.array(np.zeros(len(part), np.int64)), pa.array(part, pa.binary()), rest.field("hot")]
                    yield pa.RecordBatch.from_arrays(columns, [*PIECE, "hot"])

    return joined.mapInArrow(cut, f"{PIECES}, hot boolean")


def anchor(text: bytes, starts: np.ndarray, ends: np.ndarray, n: int, minimiser: int, gram: int) -> int:
    """Unit at which the minimiser that all n windows of a packed string share begins."""
    grams = windows.mixed(windows.PrefixHash(np.frombuffer(text, np.uint8)).ranges(starts[n - 1 : len(starts) - gram + 1], ends[n + gram - 2 :]))
    return n - 1 + int(np.argmax(grams.view(np.int64) == minimiser))


def unit_bounds(text: bytes, words: bool) -> tuple[np.ndarray, np.ndarray]:
    if words:
        return windows.word_bounds(np.frombuffer(text, np.uint8))
    starts = np.arange(len(text))
    return starts, starts + 1


def refined(found: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Pieces of minimisers with many strings, under finer keys.

    Every window reaches at least half of what it has besides the minimiser to the left of it, or
    more than half to the right; the minimiser with that much of its surroundings is the new
    key. Strings that share no more than the minimiser part here.
    """
    gram, words = rule.gram, rule.words
    half = -(-(rule.window - gram) // 2)
    right = rule.window - gram - half + 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, keys, lengths, offsets, texts = [], [], [], [], []
            for i, (minimiser, n, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(7).to_pylist())):
                starts, ends = unit_bounds(text, words)
                at = anchor(text, starts, ends, n, minimiser, gram)
                turn = min(n, max(0, at - half + 1))  # windows before it reach `half` or more to the left
                for a, b, x, y in ((0, turn, at - half, at + gram - 1), (turn, n, at, at + gram + right - 1)):
                    if a < b:
                        of.append(i)
                        keys.append(xxhash.xxh3_64_intdigest(b"%d %d " % (minimiser, a == 0 and b == turn) + text[starts[x] : ends[y]]))
                        lengths.append(b - a)
                        offsets.append(a)
                        texts.append(text[starts[a] : ends[b + rule.window - 2]])
            if of:
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), *(batch.column(c).take(rows) for c in range(1, 5)), pa.array(lengths, pa.int64()), pa.array(offsets, pa.int64()), pa.array(texts, pa.binary())], PIECE)

    pieces = scratch.stage(found.select(*PIECE).mapInArrow(split, PIECES), "finer")
    several = pieces.groupBy("key").agg(F.count("*").alias("strings"), F.min("low").alias("a"), F.max("low").alias("b")).where("strings > 1" + (" and a < b" if rule.earlier else ""))
    return pieces.join(several.select("key", (F.col("strings") > HOT).alias("hot")), "key")


def in_buckets(found: DataFrame, rule: Rule) -> DataFrame:
    """(minimiser, digest, starts, ends): runs of removed windows in each packed string, bucket by bucket."""
    resolve, earlier = rule.resolve, rule.earlier

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        key, minimiser, digest, low, count, n, off = (t.column(c).to_numpy() for c in range(7))
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        flags = resolve(t.column(7).to_pylist(), n, group, low, count)
        if not earlier:
            flags = flags & np.repeat(count == 1, n)
        edge = np.concatenate(([0], np.cumsum(n)))
        padded = np.zeros(len(flags) + len(n), bool)  # a gap after each string, so that no run spans two
        piece = np.repeat(np.arange(len(n)), n)
        padded[np.arange(len(flags)) + piece] = flags
        s, e = runs(padded)
        if not len(s):
            return None
        of = np.searchsorted(edge + np.arange(len(edge)), s, side="right") - 1
        s, e = s - (edge[of] + of) + off[of], e - (edge[of] + of) + off[of]
        mine, lengths = np.unique(of, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(minimiser[mine]), pa.array(digest[mine]), lists(s, lengths), lists(e, lengths)], ["minimiser", "digest", "starts", "ends"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            m = batch.column(0).to_numpy()
            weight = pc.binary_length(batch.column(7)).to_numpy()
            ends = np.concatenate((np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]))
            if held and len(m) and held[-1].column(0)[-1].as_py() != m[0] and size >= CHUNK_BYTES:
                if (out := settle(held)) is not None:
                    yield out
                held, size = [], 0
            at = 0
            total = np.concatenate(([0], np.cumsum(weight)))
            for i, end in enumerate(ends.tolist()):
                if size + total[end] - total[at] >= CHUNK_BYTES and i + 1 < len(ends):
                    held.append(batch.slice(at, end - at))
                    if (out := settle(held)) is not None:
                        yield out
                    held, size, at = [], 0, end
            if at < len(m):
                held.append(batch.slice(at))
                size += int(total[-1] - total[at])
        if held and (out := settle(held)) is not None:
            yield out

    dealt = found.repartition(F.col("key")).sortWithinPartitions("key", "minimiser", "digest")
    return dealt.mapInArrow(walk, "minimiser long, digest long, starts array<long>, ends array<long>")


def by_window(found: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The same as in_buckets, for minimisers with any number of strings: their windows are dealt out by own hash.

    Up to BLOCK windows that lie alike around the minimiser go as one block at first. Blocks that
    are repeats as a whole are settled by that. So are blocks whose core, the units that all windows
    of such a block share, lies in no other block: then none of their windows does. Only the
    rest, and one of each of the whole repeats, are dealt out window by window.
    """
    window, gram, words = rule.window, rule.gram, rule.words
    width = max(1, min(BLOCK, window // 2))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (minimiser, n, base, text) in enumerate(zip(batch.column(1).to_pylist(), *(batch.column(c).to_pylist() for c in (5, 6, 7)))):
                starts, ends = unit_bounds(text, words)
                side = ((at := anchor(text, starts, ends, n, minimiser, gram)) - np.arange(n)) // width
                first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
                for s, e in zip(first.tolist(), [*first[1:].tolist(), n]):
                    begin = at - int(side[s]) * width  # equal windows lie alike, so their blocks have equal cores
                    core = b"%d " % side[s] + text[starts[begin] : ends[begin + window - width]]
                    out.append((i, base + s, e - s, text[starts[s] : ends[e + window - 2]], core))
            if out:
                of, off, n, texts, cores = zip(*out)
                h, c = (np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, x)), np.int64).reshape(-1, 2) for x in (texts, cores))
                at = pa.array(of)
                own = [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(off, pa.int64()), *(batch.column(c).take(at) for c in range(1, 5))]
                own += [pa.array(n, pa.int64()), pa.array(texts, pa.binary()), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(own, ["h1", "h2", "off", "minimiser", "digest", "low", "count", "n", "string", "c1", "c2"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 2000):
                hashes = []
                for text, k in zip(texts[lo : lo + 2000], n[lo : lo + 2000].tolist()):
                    starts, ends = unit_bounds(text, words)
                    hashes += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(starts[:k].tolist(), ends[window - 1 :].tolist())]
                h, k = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2), n[lo : lo + 2000]
                at = pa.array(np.repeat(np.arange(lo, lo + len(k)), k))
                off = batch.column(2).take(at).to_numpy() + np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(off, pa.int64()), *(batch.column(c).take(at) for c in range(3, 7))], ["w1", "w2", "off", "minimiser", "digest", "low", "count"])

    pieces = scratch.stage(found.select(*PIECE).mapInArrow(blocks, "h1 long, h2 long, off long, minimiser long, digest long, low long, count long, n long, string binary, c1 long, c2 long"), "blocks")
    same = pieces.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("low").alias("most"), F.sum("count").alias("total"), F.count("*").alias("strings"), F.first("n").alias("one_n"), F.first("string").alias("one"), F.first("c1").alias("c1"), F.first("c2").alias("c2"))
    same = scratch.stage(same.where("least < most" if rule.earlier else "total > 1"), "same-blocks")
    whole = pieces.drop("string").join(same.select("h1", "h2", "least"), ["h1", "h2"]).where("low > least" if rule.earlier else "count = 1")
    whole = whole.select("minimiser", "digest", "off", (F.col("off") + F.col("n")).alias("end"))
    columns = ["n", "string", "off", "minimiser", "digest", "low", "count", "c1", "c2"]
    cores = pieces.groupBy("c1", "c2").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("low", "h1", "h2") for f in (F.min, F.max)), F.sum("count").alias("total"))
    cores = cores.where("min_low < max_low" if rule.earlier else "total > 1").where("min_h1 < max_h1 or min_h2 < max_h2").select("c1", "c2")
    # what is left: blocks that aren't repeats, and one of each that is, for others to be held against
    alone = pieces.join(same.select("h1", "h2"), ["h1", "h2"], "left_anti").select(*columns)
    none = F.lit(None).cast("long")
    if rule.earlier:  # the lowest of equal blocks may itself repeat a still lower one, window by window
        lowest = pieces.join(same.select("h1", "h2", "least"), ["h1", "h2"]).where("low = least").select(*columns)
        held = alone.unionByName(lowest)
    else:
        held = alone.unionByName(same.select(F.col("one_n").alias("n"), F.col("one").alias("string"), F.lit(0).cast("long").alias("off"), none.alias("minimiser"), none.alias("digest"), F.col("least").alias("low"), F.col("total").alias("count"), "c1", "c2"))
    held = held.join(cores, ["c1", "c2"], "left_semi").select(*columns)
    rows = scratch.stage(held.mapInArrow(explode, "w1 long, w2 long, off long, minimiser long, digest long, low long, count long"), "windows")
    counted = rows.groupBy("w1", "w2").agg(F.min("low").alias("least"), F.max("low").alias("most"), F.sum("count").alias("total"))
    counted = scratch.stage(counted.where("least < most" if rule.earlier else "total > 1").select("w1", "w2", "least"), "repeated-windows")  # written, so that Spark can split a hot window
    hit = rows.join(counted, ["w1", "w2"]).where("low > least" if rule.earlier else "count = 1")
    hit = hit.select("minimiser", "digest", "off", (F.col("off") + 1).alias("end")).unionByName(whole)
    hit = hit.groupBy("minimiser", "digest").agg(F.collect_list(F.struct("off", "end")).alias("r"))
    return hit.select("minimiser", "digest", F.col("r.off").alias("starts"), F.col("r.end").alias("ends"))


def removed(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs(id, th, text) to (id, th, spans): unit ranges to remove, for the texts that have any; spans may overlap."""
    rows = stage(positions(docs, rule), "positions")
    keys = rows.groupBy("minimiser", "digest").agg(F.max("id").alias("high"), F.count("*").alias("count"), F.min(F.struct("id", "th", "first", "n")).alias("at"))
    keys = stage(keys.withColumn("low", F.col("at.id")), "digests")
    several = keys.groupBy("minimiser").agg(F.count("*").alias("strings"), F.min("low").alias("a"), F.max("high").alias("b")).where("strings > 1" + (" and a < b" if rule.earlier else ""))
    wanted = keys.join(several.select("minimiser", (F.col("strings") > HOT).alias("hot")), "minimiser")
    wanted = wanted.select("at.*", "minimiser", "digest", "low", "count", "hot")
    scratch = Scratch(docs.sparkSession)
    found = scratch.stage(strings(docs, wanted, rule), "strings")
    finer = scratch.stage(refined(found.where("hot"), rule, scratch), "finer-strings")
    cold = found.where("not hot").select(*PIECE).unionByName(finer.where("not hot").select(*PIECE))
    shared = stage(in_buckets(cold, rule).unionByName(by_window(finer.where("hot"), rule, scratch)), "shared")
    scratch.drop()
    # the two halves of a string may each have runs
    shared = shared.groupBy("minimiser", "digest").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))

    last = rule.window - 1
    one = F.col("low") < F.col("high") if rule.earlier else F.col("count") > 1
    info = keys.select("minimiser", "digest", "low", "high", "count").join(shared, ["minimiser", "digest"], "left").where(one | F.col("starts").isNotNull())
    info = stage(info.drop("high"), "repeated")  # both sides of the next join are then dealt by it alone, so Spark can split a hot digest
    hit = rows.join(info, ["minimiser", "digest"])
    whole = F.col("id") > F.col("low") if rule.earlier else F.col("count") > 1
    ranges = F.zip_with("starts", "ends", lambda s, e: F.struct((F.col("first") + s).alias("a"), (F.col("first") + e + last).alias("b")))
    spans = F.when(whole, F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n") + last).alias("b")))).otherwise(ranges)
    hit = hit.select("id", "th", "first", spans.alias("s")).where("s is not null")
    hit = hit.groupBy("id", "th", "first").agg(F.first("s").alias("s"))  # rows that repeat have the same spans
    return hit.groupBy("id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def identified(id_col: str, text_col: str) -> list[Column]:
    """id (a rank; null comes after all others), th (a content hash, which tells apart rows of one id) and text (never null)."""
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return [rank.alias("id"), text_hash(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]


def cut(docs: DataFrame, id_col: str, text_col: str, rule: Rule, layout: bool = False) -> DataFrame:
    """docs packed as `row`, with units, removed, spans (merged) and kept (binary).

    Words are kept joined by one space; with `layout` each kept run keeps its own white space.
    """
    spans = removed(docs.select(*identified(id_col, text_col)), rule)
    base = docs.select(packed(docs), *identified(id_col, text_col)[:2])
    joined = base.join(spans.withColumnsRenamed({"id": "s_id", "th": "s_th"}), (F.col("id") == F.col("s_id")) & (F.col("th") == F.col("s_th")), "left").select("row", "spans")
    words, place_of_text = rule.words, docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, buf = strings_of(batch.column(0).field(place_of_text))
            column = batch.column(1)
            n_units, n_removed, kept, pairs, counts = [], [], [], [], []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                raw, s, e = bytes(buf[a:b]), (), ()
                if column[i].is_valid:
                    mine = column[i].values
                    s, e = windows.merged(mine.field("a").to_numpy(), mine.field("b").to_numpy())
                    s, e = s.tolist(), e.tolist()
                if words and not s:
                    parts = raw.split()
                    n_units.append(len(parts))
                    kept.append(raw if layout else b" ".join(parts))
                else:
                    n_units.append(len(raw))
                    place = [0, *(x for pair in zip(s, e) for x in pair)]
                    if words:
                        ws, we = windows.word_bounds(np.frombuffer(raw, np.uint8))
                        n_units[-1] = len(ws)
                    place.append(n_units[-1])
                    keep = [(x, y) for x, y in zip(place[::2], place[1::2]) if x < y]
                    if not words:
                        kept.append(b"".join(raw[x:y] for x, y in keep))
                    else:
                        parts = [raw[ws[x] : we[y - 1]] for x, y in keep]
                        kept.append(b" ".join(parts if layout else [b" ".join(p.split()) for p in parts]))
                n_removed.append(sum(e) - sum(s))
                counts.append(len(s))
                pairs += zip(s, e)
            flat = np.array(pairs, np.int64).reshape(-1, 2)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            structs = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["a", "b"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(kept, pa.binary())], ["row", "units", "removed", "spans", "kept"])

    row = base.schema["row"].dataType.simpleString()
    return joined.mapInArrow(apply, f"row {row}, units long, removed long, spans array<struct<a:long,b:long>>, kept binary")

