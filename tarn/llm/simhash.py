"""SimHash near-dedup by a generalised pigeonhole index.

Fingerprints are compared, not documents: equal ones collapse first. Correlated bits are grouped
into partitions; a pair at distance d or less must agree to within t_i bits on some partition i
if the sum of (t_i + 1) is d + 1. The thresholds t_i (-1: partition not used) are allotted by
dynamic programming on candidate counts estimated from the joint counts of bits over all fingerprints; these
are then indexed by their value on each used partition, probed with all values within
t_i bits, and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import connected_components, local_components, maybe_broadcast, packed, stage, strings_of, text_hash, unpacked

SHINGLES_AT_ONCE = 1 << 17
#: Bit j of a byte in byte j of a word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
#: Cost of verifying a candidate against that of shuffling an index or probe row.
CANDIDATE_COST = 0.002
#: Rows of a bucket held at once; larger buckets are dealt out in blocks. Rows of a block compared at once.
BLOCK, AT_ONCE = 2048, 1 << 15


def shingle_hashes(text: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of a text, repeats included, in slices.

    A-Z count as a-z. Fewer words than a shingle takes make one shingle; no words make none.
    """
    digest = xxhash.xxh64_intdigest
    parts = text.split()
    n = max(len(parts) - words + 1, 1 if parts else 0)
    if not n:
        return
    flat = b" ".join(parts).lower()
    if n == 1:
        starts, ends = [0], [len(flat)]
    else:
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        starts = [0, *(gaps[: n - 1] + 1).tolist()]
        ends = [*gaps[words - 1 :].tolist(), len(flat)]
    for lo in range(0, n, SHINGLES_AT_ONCE):
        hi = lo + SHINGLES_AT_ONCE
        yield np.array([digest(flat[a:b], seed) for a, b in zip(starts[lo:hi], ends[lo:hi])], np.uint64)


def bit_counts(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each of the stretches of h, none of them empty."""
    first = np.cumsum(lengths) - lengths
    edges = np.flatnonzero((np.arange(len(h)) - np.repeat(first, lengths)) % 255 == 0)
    lanes = np.empty((len(edges), 8), np.uint64)  # a byte a bit
    for lo in range(0, len(edges), 512):
        some = edges[lo : lo + 513]
        part = h[some[0] : some[512] if len(some) > 512 else len(h)]
        lanes[lo : lo + 512] = np.add.reduceat(SPREAD[part.view(np.uint8).reshape(-1, 8)], some[:512] - some[0], axis=0)
    return np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64), np.searchsorted(edges, first), axis=0, dtype=np.int64)


def fingerprint(texts: list[bytes], words: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if set in over half the XXH64 of all word shingles (repeats included); no words give 0."""
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[np.ndarray] = []
    owners: list[int] = []

    def count() -> None:
        if hashes:
            lengths = np.array([len(h) for h in hashes])
            np.add.at(ones, owners, bit_counts(np.concatenate(hashes), lengths))
            np.add.at(totals, owners, lengths)
            hashes.clear()
            owners.clear()

    held = 0
    for i, text in enumerate(texts):
        for h in shingle_hashes(text, words, seed):
            hashes.append(h)
            owners.append(i)
            held += len(h)
            if held >= SHINGLES_AT_ONCE:
                count()
                held = 0
    count()
    return np.packbits(2 * ones > totals[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def identity(id_col: str, text_col: str) -> list[Column]:
    """id (null stays) and th, the content hash: rows that agree in both are repeats of one row here."""
    return [F.col(f"`{id_col}`").cast("long").alias("id"), text_hash(f"`{text_col}`").alias("th")]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42) -> DataFrame:
    """(id, th, fp): the fingerprint of each row as a signed long. Only these come back from Python, no texts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, buf = strings_of(batch.column(2))
            fp = np.empty(len(starts), np.int64)
            for lo in range(0, len(starts), 256):
                part = slice(lo, lo + 256)
                fp[part] = fingerprint([bytes(buf[a:b]) for a, b in zip(starts[part].tolist(), ends[part].tolist())], words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["id", "th", "fp"])

    return docs.select(*identity(id_col, text_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(apply, "id long, th long, fp long")


def pair_counts(distinct: DataFrame, fps: str = "fps") -> tuple[int, np.ndarray]:
    """Number of rows, and for each of the fingerprints in their arrays `fps` how many have bits i and j both set, over all of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                all_fps = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                bits = np.unpackbits(np.ascontiguousarray(all_fps).view(np.uint8).reshape(*all_fps.shape, 8), axis=2, bitorder="little").astype(np.float32)
                now = np.stack([bits[:, w].T @ bits[:, w] for w in range(all_fps.shape[1])]).astype(np.int64)
                total = now if total is None else total + now
        if total is not None:
            w, i, j = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(i), pa.array(j), pa.array(total.ravel())], ["w", "i", "j", "n"])

    found = distinct.select(fps).mapInArrow(partial, "w long, i long, j long, n long").groupBy("w", "i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((max((r["w"] for r in found), default=-1) + 1, 64, 64), np.int64)
    for r in found:
        both[r["w"], r["i"], r["j"]] = r["n"]
    return distinct.count(), both


def correlated(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt into `parts` groups of about equal width, each grown by the bit most correlated with it."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(rho, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        group = [max(left, key=lambda b: rho[b, left].sum())]
        while len(group) < width:
            group.append(max((b for b in left if b not in group), key=lambda b: rho[b, group].sum()))
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def allot(costs: np.ndarray, budget: int) -> tuple[float, list[int]]:
    """Least total cost, and thresholds, with the sum of (t + 1) over partitions equal to budget; costs[i][t + 1]."""
    best = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t1 in range(min(budget - used, len(row) - 1) + 1):
                now = (cost + row[t1], [*chosen, t1 - 1])
                if used + t1 not in after or now[0] < after[used + t1][0]:
                    after[used + t1] = now
        best = after
    return best[budget]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def agreement(both: np.ndarray, n: int, bits: list[int]) -> float:
    """Estimated share of pairs that agree on all bits: each bit given the one before it that it depends on most."""
    p = np.diag(both) / n
    both = both / n
    neither = 1 - p[:, None] - p[None, :] + both
    joint = both**2 + (p[:, None] - both) ** 2 + (p[None, :] - both) ** 2 + neither**2
    alone = p**2 + (1 - p) ** 2
    share = alone[bits[0]]
    for k, b in enumerate(bits[1:], 1):
        share *= max(alone[b], *(joint[a, b] / alone[a] for a in bits[:k]))
    return max(float(share), 1 / n / n)


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to use, of the cheapest scheme with 1 to distance + 1 partitions."""
    if n < 2:
        return []
    p = np.diag(both) / n
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    best = None
    for m in range(1, distance + 2):
        groups = correlated(both, n, m)
        costs = np.zeros((len(groups), distance + 2))
        for i, bits in enumerate(groups):
            odds = differ[bits] / (1 - differ[bits])
            symmetric = np.zeros(distance + 1)
            symmetric[0] = 1
            for x in odds:  # elementary symmetric sums: odds of differing in exactly t bits
                symmetric[1:] += x * symmetric[:-1]
            probes = np.cumsum([comb(len(bits), t) for t in range(distance + 1)])
            pairs = np.minimum(1, agreement(both, n, bits) * np.cumsum(symmetric)) * n * n / 2
            costs[i, 1:] = n * probes + n + CANDIDATE_COST * pairs
        cost, thresholds = allot(costs, distance + 1)
        if best is None or cost < best[0]:
            best = cost, [(bits, t) for bits, t in zip(groups, thresholds) if t >= 0]
    return best[1]


#: What a row is dealt by: partition, value of its bits there, block; whether it only asks.
DEALT = ["part", "key", "block", "probe"]


def indexed(nodes: DataFrame, plans: list[list[tuple[list[int], int]]], payload: list[str]) -> DataFrame:
    """(part, key, probe, payload): a row for each partition and each value to look up there; plans: one for each fingerprint in the array `fps`."""
    entries, number = [], 0
    for w, used in enumerate(plans):
        for bits, t in used:
            for c in (c for k in range(t + 1) for c in combinations(bits, k)):
                entries.append(F.struct(F.lit(number).alias("part"), F.lit(w).alias("w"), F.lit(mask_of(bits)).cast("long").alias("mask"), F.lit(signed(sum(1 << b for b in c))).cast("long").alias("flip")))
            number += 1

    def entry(e: Column) -> Column:
        key = F.get("fps", e["w"]).bitwiseAND(e["mask"]).bitwiseXOR(e["flip"])
        return F.struct(e["part"].alias("part"), key.alias("key"), (e["flip"] != 0).alias("probe"))

    return nodes.select(F.inline(F.transform(F.array(*entries), entry)), *payload)


def dealt(rows: DataFrame, payload: list[str], counted: DataFrame | None = None) -> DataFrame:
    """indexed rows, dealt out by bucket and sorted, index rows before those that ask; counted: rows to count instead where these take joins to make.

    A bucket over BLOCK index rows is dealt out: these to blocks by hash of the first column of payload, and
    all that ask, index rows among them, to every block.
    """
    held = (rows if counted is None else counted).where("not probe").groupBy("part", "key").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK)
    held = maybe_broadcast(held.select(F.col("part").alias("p"), F.col("key").alias("k"), F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")))
    rows = rows.join(held, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")), "left")
    own = F.pmod(F.xxhash64(payload[0]), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("probe")))
    alone = F.array(F.struct(F.lit(0).alias("block"), F.col("probe").alias("probe")))
    index = F.array(F.struct(own.alias("block"), F.lit(False).alias("probe")))
    places = F.when(F.col("blocks").isNull(), alone).when(F.col("probe"), every).otherwise(F.concat(index, every))
    out = rows.select("part", "key", *payload, places.alias("at")).select("part", "key", *payload, F.inline("at"))
    return out.select(*DEALT, *payload).repartition("part", "key", "block").sortWithinPartitions(*DEALT)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets of dealt rows; of a bucket with more than AT_ONCE rows, its index rows with stretches of those that ask."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
        held = [np.concatenate(x) for x in zip(held, now)] if held else now
        last = np.flatnonzero(np.any([x != x[-1] for x in held[:3]], axis=0))
        at = int(last[-1]) + 1 if len(last) else 0  # where the last bucket begins
        if at:
            yield [x[:at] for x in held]
            held = [x[at:] for x in held]
        if len(held[0]) > AT_ONCE and held[3][-1]:
            yield held
            held = [x[~held[3]] for x in held]
    if held:
        yield held


def meetings(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) that meet in a bucket, i an index row, in pieces."""
    n = len(cols[0])
    new = np.ones(n + 1, bool)
    new[1:-1] = np.any([x[1:] != x[:-1] for x in cols[:3]], axis=0)
    edge = np.flatnonzero(new)
    left = np.repeat(edge[1:], np.diff(edge)) - np.arange(n)
    active, d = np.flatnonzero(~cols[3] & (left > 1)), 1
    while len(active):
        yield active, active + d
        d += 1
        active = active[left[active] > d]


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """(u, v): a spanning forest, bucket by bucket, of all pairs of fingerprints (fp) at `distance` or less.

    No pair is lost: each meets in some bucket, and every bucket's links connect what its pairs connect.
    """
    nodes = distinct.select("fp", F.array("fp").alias("fps"))
    n, both = pair_counts(nodes)
    if n < 2:
        return distinct.sparkSession.createDataFrame([], "u long, v long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in chunks(batches):
            fp = cols[4].view(np.uint64)
            u, v, held = [], [], 0

            def forest(u: list[np.ndarray], v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
                label = local_components(len(fp), np.concatenate(u), np.concatenate(v))
                child = np.flatnonzero(label != np.arange(len(label)))
                return label[child], child

            for i, j in meetings(cols):
                x = fp[i] ^ fp[j]
                near = np.flatnonzero((np.bitwise_count(x) <= distance) & (x != 0))
                u.append(i[near])
                v.append(j[near])
                held += len(near)
                if held > 1 << 21:
                    a, b = forest(u, v)
                    u, v, held = [a], [b], len(a)
            if held:
                a, b = forest(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[4][a]), pa.array(cols[4][b])], ["u", "v"])

    return dealt(indexed(nodes, [plan(n, both[0], distance)], ["fp"]), ["fp"]).mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """docs with fingerprint (16 lowercase hex digits) and component_id.

    component_id: the smallest id reachable over pairs of fingerprints that differ in `distance`
    bits or fewer, the row itself included. Null and empty texts have fingerprint zero, which
    links like any other. Rows may repeat. Null ids are larger than all others; a component of
    only such has a null component_id. An empty table gives an empty one. Columns of docs with
    these names are replaced.
    """
    found = components(docs, id_col, text_col, words, distance, seed).groupBy("id", "th").agg(F.min("fp").alias("fp"), F.min("component_id").alias("component_id"))
    found = found.withColumnsRenamed({"id": "f_id", "th": "f_th"})
    base = docs.select(packed(docs), *identity(id_col, text_col))
    out = base.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")))
    return unpacked(out, hex16(F.col("fp")).alias("fingerprint"), F.col("component_id"))


def components(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int, seed: int) -> DataFrame:
    """(id, th, fp, component, component_id) for each row; component is a fingerprint."""
    rows = stage(fingerprints(docs, id_col, text_col, words, seed), "simhash")
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    nodes = connected_components(links(distinct, distance))
    whole = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    whole = stage(whole, "simhash-nodes")
    lows = stage(whole.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-lows")  # written, so that Spark can split a hot component
    whole = stage(whole.join(lows, "component").select("fp", "component", "component_id"), "simhash-components")
    return rows.join(whole, "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row of docs for each component of near duplicates, unchanged.

    It is the one with the smallest id; of rows that repeat it, any. Where only null ids are
    linked, one of these stays.
    """
    return kept_rows(docs, components(docs, id_col, text_col, words, distance, seed), id_col, text_col)


def kept_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of docs that stays of each component in found (id, th, component, component_id)."""
    mine = found.where(F.col("id").eqNullSafe(F.col("component_id")))
    first = mine.groupBy("component").agg(F.min("th").alias("f_th"), F.first("id").alias("f_id"))
    repeated = mine.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("r_id"), F.col("th").alias("r_th"), F.lit(True).alias("again"))
    first = stage(first.join(repeated, F.col("f_id").eqNullSafe(F.col("r_id")) & (F.col("f_th") == F.col("r_th")), "left").select("f_id", "f_th", F.coalesce("again", F.lit(False)).alias("again")), "simhash-first")
    base = docs.select(packed(docs), *identity(id_col, text_col))
    same = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th"))
    out = base.join(first.where("not again"), same, "left_semi").select("row")
    if not first.where("again").isEmpty():  # only of such rows one has to be picked
        out = out.unionByName(base.join(first.where("again"), same, "left_semi").dropDuplicates(["id", "th"]).select("row"))
    return out.select("row.*")
