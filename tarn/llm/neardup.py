"""SimHash near-dedup at a Jaccard similarity of word shingles, verified.

Each set of shingles gets several independent 64-bit fingerprints. A generalised pigeonhole index of
each (as in `simhash`) finds all pairs within DISTANCE bits on any one of them; what meets
there is held against two more fingerprints and the sizes, and then exactly: only pairs whose whole
sets share `similarity` are links. At a similarity of 0.8 fingerprints differ in 9.7 of 64 bits on
average, but with four partitions of 16 bits a pair meets by one fingerprint with a chance of about
0.25, hence by WORDS of them with one of about 0.97 (0.996 at 0.85).

A bucket with few candidates gives all of them. One with many (a group of copies) first gives each row's nearest
neighbour. When these are verified and connected, buckets that still hold several components get the sets
themselves, and compare in place: each pair in the first bucket where it meets, unless its components have been
joined meanwhile. So no group of copies is written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import simhash, windows
from tarn.llm.common import Scratch, connected_components, maybe_broadcast, stage, strings_of

#: Fingerprints of a set; bits by which pairs that the index has to find may differ on one of them.
WORDS, DISTANCE = 14, 3
#: Bits of 128 by which a candidate may differ on two other fingerprints (at 0.8: 19.4 on average, standard deviation 4.1).
FAR = 34
#: Bits by which a pair of a crowded bucket may differ on all fingerprints, in standard deviations above the mean at the similarity.
SPREAD = 4.5
#: Candidates for each row beyond which a bucket gives nearest neighbours first.
MANY = 4
PAYLOAD = ["node", "n", "a", "b"]


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of all word shingles of a text, as in simhash.shingle_hashes."""
    parts = list(simhash.shingle_hashes(text, words, 42))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def fingerprints_of(sets: list[np.ndarray], count: int = WORDS) -> np.ndarray:
    """`count` fingerprints of each set, a row each: a bit is 1 if set in over half of its hashes, mixed anew for each fingerprint."""
    out = np.zeros((len(sets), count), np.uint64)
    lengths = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(lengths)
    if len(some):
        h = np.concatenate([sets[i] for i in some])
        for w in range(count):
            ones = simhash.bit_counts(windows.mixed(h + np.uint64(w * windows.BASE % (1 << 64))), lengths[some])
            out[some, w] = np.packbits(2 * ones > lengths[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def texts_of(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    starts, ends, buf = strings_of(column)
    for lo in range(0, len(starts), 256):
        yield lo, [bytes(buf[a:b]) for a, b in zip(starts[lo : lo + 256].tolist(), ends[lo : lo + 256].tolist())]


def fingerprinted(base: DataFrame, words: int) -> DataFrame:
    """(id, th, node, n, fps) for each row: a digest of its set of shingles, the size and the fingerprints of that."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(2)):
                sets = [shingle_set(t, words) for t in texts]
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                fps = fingerprints_of(sets).view(np.int64)
                offsets = pa.array(np.arange(len(sets) + 1) * fps.shape[1], pa.int32())
                own = [batch.column(c).slice(lo, len(texts)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(fps.ravel()))], ["id", "th", "node", "n", "fps"])

    return base.mapInArrow(apply, "id long, th long, node long, n long, fps array<long>")


def candidates(cols: list[np.ndarray], similarity: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows i, rows j, distances) that meet in dealt rows and may be similar enough."""
    num, den = similarity.numerator, similarity.denominator
    node, n, a, b = cols[4], cols[5], cols[6].view(np.uint64), cols[7].view(np.uint64)
    for i, j in simhash.meetings(cols):
        far = np.bitwise_count(a[i] ^ a[j]).astype(np.int64) + np.bitwise_count(b[i] ^ b[j])
        ok = (far <= FAR) & (node[i] != node[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
        at = np.flatnonzero(ok)
        if len(at):
            yield i[at], j[at], far[at]


def similar(x: np.ndarray, y: np.ndarray, similarity: Fraction) -> bool:
    """Whether two sets share at least `similarity` of their union."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * similarity.denominator >= similarity.numerator * (len(x) + len(y) - common)


def met(dealt: DataFrame, similarity: Fraction) -> DataFrame:
    """(u, v) for candidates, all of a bucket or of its rows' nearest; (part, key) instead for buckets that have more."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in simhash.chunks(batches):
            rows, node = len(cols[0]), cols[4]
            new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)))
            bucket = np.cumsum(new) - 1
            size, count = np.bincount(bucket), np.zeros(int(bucket[-1]) + 1, np.int64)
            nearest, partner = np.full(rows, 1 << 20), np.full(rows, -1)
            few: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j, far in candidates(cols, similarity):
                of = bucket[i]
                np.add.at(count, of, 1)
                for x, y in ((i, j), (j, i)):  # each row occurs once in either
                    nearer = (far < nearest[x]) | ((far == nearest[x]) & (node[y] < node[partner[x]]))
                    nearest[x[nearer]], partner[x[nearer]] = far[nearer], y[nearer]
                still = count[of] <= MANY * size[of]
                few.append((i[still], j[still]))
            if not few:
                continue
            i, j = (np.concatenate(x) for x in zip(*few))
            many = count > MANY * size
            stay = ~many[bucket[i]]
            u, v = node[i[stay]], node[j[stay]]
            x = np.flatnonzero(many[bucket] & (partner >= 0))
            u, v = np.concatenate((u, node[x])), np.concatenate((v, node[partner[x]]))
            pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)
            first = np.flatnonzero(new)[many]
            none, blank = pa.nulls(pairs.shape[1], pa.int32()), pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].copy()), pa.array(pairs[1].copy()), none, none.cast(pa.int64())], ["u", "v", "part", "key"])
            if len(first):
                yield pa.RecordBatch.from_arrays([blank, blank, pa.array(cols[0][first]), pa.array(cols[1][first])], ["u", "v", "part", "key"])

    return dealt.mapInArrow(apply, "u long, v long, part int, key long")


def joined_in_place(dealt: DataFrame, plans: list[list[tuple[list[int], int]]], similarity: Fraction) -> DataFrame:
    """(u, v): links of dealt rows (with c, a component, fps and s, the set itself) that connect whatever the buckets' similar pairs connect."""
    parts = [(w, np.uint64(sum(1 << b for b in bits)), t) for w, used in enumerate(plans) for bits, t in used]
    odds = np.arccos(2 * float(similarity) / (1 + float(similarity))) / np.pi
    all_bits = 64 * len(plans)
    most = all_bits * odds + SPREAD * np.sqrt(all_bits * odds * (1 - odds))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in simhash.chunks(batches):
            node, c = cols[4], cols[8]
            fps = np.frombuffer(b"".join(cols[9]), ">u8").astype(np.uint64).reshape(len(node), -1)
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while (y := above.get(x, x)) != x:
                    above[x] = above.get(y, y)
                    x = y
                return x

            u, v = [], []
            for i, j, _ in candidates(cols, similarity):
                apart = np.flatnonzero(c[i] != c[j])
                differ = fps[i[apart]] ^ fps[j[apart]]
                ok = np.bitwise_count(differ).sum(axis=1) <= most
                own = cols[0][i[apart]]
                for number, (w, mask, t) in enumerate(parts):  # met before: settled there
                    ok &= (own <= number) | (np.bitwise_count(differ[:, w] & mask) > t)
                for x, y in zip(i[apart[ok]].tolist(), j[apart[ok]].tolist()):
                    a, b = root(int(c[x])), root(int(c[y]))
                    if a != b and similar(*(np.frombuffer(cols[10][k], np.uint64) for k in (x, y)), similarity):
                        above[a] = b
                        u.append(node[x])
                        v.append(node[y])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(apply, "u long, v long")


def whole_sets(asked: DataFrame, base: DataFrame, rows: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(node, s): the sets of the nodes asked for, from one text of each, which is read again."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in texts_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary())], ["node", "s"])

    one = rows.groupBy("node").agg(F.min(F.struct("th", "id")).alias("at")).join(maybe_broadcast(asked), "node", "left_semi")
    one = scratch.stage(one.select("node", F.col("at.th").alias("o_th"), F.col("at.id").alias("o_id")), "near-asked")
    texts = base.join(maybe_broadcast(one), (F.col("th") == F.col("o_th")) & F.col("id").eqNullSafe(F.col("o_id")))
    return scratch.stage(texts.select("node", "text").mapInArrow(sets_of, "node long, s binary").dropDuplicates(["node"]), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in both), similarity) for both in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"node": "u", "s": "x"}), "u").join(sets.withColumnsRenamed({"node": "v", "s": "y"}), "v")
    return both.select("u", "v", "x", "y").mapInArrow(compare, "u long, v long")


def links(base: DataFrame, rows: DataFrame, words: int, similarity: Fraction, scratch: Scratch) -> DataFrame:
    """(u, v): similar pairs of nodes that connect whatever all similar candidates connect."""
    nodes = scratch.stage(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("fps").alias("fps")), "near-nodes")
    n, both = simhash.pair_counts(nodes)
    if n < 2:
        return base.sparkSession.createDataFrame([], "u long, v long")
    # the two fingerprints that candidates are held against are not indexed themselves
    nodes = nodes.select("node", "n", F.get("fps", F.lit(0)).alias("a"), F.get("fps", F.lit(1)).alias("b"), "fps")
    plans = [[], [], *(simhash.plan(n, one, DISTANCE) for one in both[2:])]
    index = simhash.indexed(nodes, plans, PAYLOAD)
    found = scratch.stage(met(simhash.dealt(index, PAYLOAD), similarity), "near-met")
    pairs = scratch.stage(found.where("u is not null").select("u", "v").distinct(), "near-pairs")
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = whole_sets(asked, base, rows, words, scratch)
    first = scratch.stage(verified(pairs, sets, similarity), "near-links")

    crowded = scratch.stage(found.where("u is null").select("part", "key").distinct(), "near-crowded")
    if crowded.isEmpty():
        return first
    joined = connected_components(first).withColumnsRenamed({"component": "c"})
    index = index.join(maybe_broadcast(crowded), ["part", "key"], "left_semi").join(maybe_broadcast(joined), "node", "left")
    index = scratch.stage(index.select("part", "key", "probe", *PAYLOAD, F.coalesce("c", "node").alias("c")), "near-crowd")
    apart = index.groupBy("part", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("part", "key")
    index = scratch.stage(index.join(maybe_broadcast(apart), ["part", "key"], "left_semi"), "near-apart")
    # a row without any candidate in its crowded buckets has no set, and no pair either
    bits = nodes.select("node", F.unhex(F.array_join(F.transform("fps", lambda x: F.lpad(F.hex(x), 16, "0")), "")).alias("bits"))
    wide = scratch.stage(bits.join(sets, "node"), "near-wide")
    return first.unionByName(joined_in_place(simhash.dealt(index.join(wide, "node"), [*PAYLOAD, "c", "bits", "s"], index), plans, similarity))


def components(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: Fraction) -> DataFrame:
    """(id, th, component, component_id) for each row; component is a node."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select(*simhash.identity(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    rows = scratch.stage(fingerprinted(base, words), "near-rows")
    nodes = connected_components(links(base, rows, words, similarity, scratch))
    mine = rows.select("id", "th", "node").join(maybe_broadcast(nodes), "node", "left").select("id", "th", F.coalesce("component", "node").alias("component"))
    mine = stage(mine, "near-components")
    scratch.drop()
    lows = stage(mine.groupBy("component").agg(F.min("id").alias("component_id")), "near-lows")  # written, so that Spark can split a hot component
    return mine.join(lows, "component")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row of docs for each component of texts linked by `similarity` or more of their shingles, as in simhash.first_of_each.

    No text below the similarity is a link; chains of links make one component. Texts without words
    are all alike. Null ids come after all others; rows may repeat; an empty table gives an empty one.
    """
    return simhash.kept_rows(docs, components(docs, id_col, text_col, words, similarity), id_col, text_col)
