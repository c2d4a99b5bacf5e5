"""Variable-capacity best-fit packing of documents into training sequences.

Full pieces of documents longer than the largest capacity are bins by themselves. The rest is
dealt by hash into groups that one task packs: items in falling size go to the open bin that
they leave the least room in; if none has room, each capacity is filled on trial with what is left to
pack, and the one whose bin, downsized to its contents, costs least for each word is opened; at
last every bin is downsized to the smallest capacity that holds it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import copies, stage

#: Permitted sequence lengths in words, and what a sequence costs besides them.
CAPACITIES, OVERHEAD = (512, 1024, 2048, 4096), 16
#: Documents in a group, about.
GROUP = 4096


class Rest:
    """Sizes still to pack, with their numbers, in falling order."""

    def __init__(self, sizes: list[int]) -> None:
        count = Counter(sizes)
        self.sizes = sorted(count, reverse=True)
        self.count = [count[s] for s in self.sizes]
        self.falling = [-s for s in self.sizes]

    def drop(self, size: int) -> None:
        self.count[bisect_left(self.falling, -size)] -= 1

    def filled(self, room: int) -> int:
        """Words that go into `room` if the largest that fits is put in again and again."""
        at, used = 0, 0
        while (at := max(at, bisect_left(self.falling, used - room))) < len(self.sizes) and used < room:
            if size := self.sizes[at]:
                used += size * min(self.count[at], (room - used) // size)
            at += 1
        return used


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, keys: list | None = None) -> list[list[int]]:
    """Bins as lists of item numbers; sizes must fall and not exceed the largest capacity. No bin holds two items of one key."""
    bins: list[list[int]] = []
    held: list[set] = []
    rooms: list[tuple[int, int]] = []  # (room left, bin), in order
    rest = Rest(sizes)
    for item, size in enumerate(sizes):
        rest.drop(size)
        at = bisect_left(rooms, (size, -1))
        while keys and at < len(rooms) and keys[item] in held[rooms[at][1]]:
            at += 1
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            cost = {}
            for c in sorted(c for c in capacities if c >= size):
                used = size + rest.filled(c - size)
                cost[c] = (fitting(used, capacities) + overhead) / max(1, used)
            room, k = min(cost, key=cost.get), len(bins)
            bins.append([])
            held.append(set())
        bins[k].append(item)
        if keys:
            held[k].add(keys[item])
        insort(rooms, (room - size, k))
    return bins


def fitting(used: int, capacities: tuple[int, ...]) -> int:
    return next(c for c in sorted(capacities) if c >= used)


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def with_texts(bins: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """bins with `texts`, the words of each item joined by one space; docs has the columns that were packed and `text_col`."""
    items = bins.select("bin_id", F.posexplode("items").alias("place", "item")).select("bin_id", "place", F.col("item.h").alias("p_h"), "item.start", "item.end")
    wanted = items.groupBy("p_h").agg(F.collect_list(F.struct("bin_id", "place", "start", "end")).alias("wanted"))
    whole = docs.select(F.col(f"`{text_col}`").alias("text"), row_hash(docs.drop(text_col)).alias("h")).dropDuplicates(["h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                out += [(w["bin_id"], w["place"], b" ".join(words[w["start"] : w["end"]]).decode()) for w in wanted.as_py()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.string()))], ["bin_id", "place", "piece"])

    pieces = whole.join(wanted, F.col("h") == F.col("p_h")).select("text", "wanted").mapInArrow(cut, "bin_id long, place int, piece string")
    texts = pieces.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
    return bins.join(texts, "bin_id").select(*bins.columns, F.col("pieces.piece").alias("texts"))


def pack(docs: DataFrame, size: Column, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Bins of docs: bin_id, capacity, used, n_items, items (doc_id, h, start, end in words) and doc_ids; h is a hash of the whole row.

    Every word of every row is in exactly one item. Rows longer than the largest capacity are
    cut at its multiples; rows without words (null, empty) make one item of no length; rows that
    repeat make items of their own, in different groups and never in one bin; ids may be null. bin_id is unique and the
    same in every run. An empty table gives no bins.
    """
    largest, kind = max(capacities), docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size.cast("long").alias("size"), row_hash(docs).alias("h"))
    base = stage(base.groupBy("doc_id", "size", "h").agg(F.count("*").alias("n")), "pack-items")
    groups = max(1, -(-(base.agg(F.sum("n")).first()[0] or 0) // GROUP))
    base = copies(base, "n").withColumn("group", F.pmod(F.xxhash64("h", "copy"), F.lit(groups))).drop("n", "copy")

    def group_bins(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("h", "ascending")])
        sizes = table.column("size").to_numpy()
        starts = sizes // largest * largest
        full = [(i, at, at + largest) for i in np.flatnonzero(starts) for at in range(0, int(starts[i]), largest)]
        tail = np.flatnonzero((sizes > starts) | (sizes == 0))
        tail = tail[np.argsort(-(sizes - starts)[tail], kind="stable")]
        packed = best_fit((sizes - starts)[tail].tolist(), capacities, overhead, table.column("h").to_numpy()[tail].tolist())
        bins = [[x] for x in full] + [[(int(i), int(starts[i]), int(sizes[i])) for i in tail[b]] for b in packed]
        used = [sum(e - s for _, s, e in b) for b in bins]
        flat = [x for b in bins for x in b]
        ids = table.column("doc_id").combine_chunks().take(pa.array([i for i, _, _ in flat], pa.int64()))
        rows = pa.array([i for i, _, _ in flat], pa.int64())
        items = pa.StructArray.from_arrays([ids, table.column("h").combine_chunks().take(rows), pa.array([s for _, s, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())], ["doc_id", "h", "start", "end"])
        edge = pa.array(np.cumsum([0, *map(len, bins)]), pa.int32())
        number = (int(key[0].as_py()) << 32) + np.arange(len(bins))
        return pa.table(
            {
                "bin_id": number,
                "capacity": pa.array([fitting(u, capacities) for u in used], pa.int64()),
                "used": pa.array(used, pa.int64()),
                "n_items": pa.array(list(map(len, bins)), pa.int64()),
                "items": pa.ListArray.from_arrays(edge, items),
                "doc_ids": pa.ListArray.from_arrays(edge, ids),
            }
        )

    return base.groupBy("group").applyInArrow(group_bins, f"bin_id long, capacity long, used long, n_items long, items array<struct<doc_id:{kind},h:long,start:long,end:long>>, doc_ids array<{kind}>")
