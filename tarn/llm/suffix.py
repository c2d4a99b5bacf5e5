"""Suffix-array dedup: byte strings that occur more than once, by a run-length index in each bucket.

The strings of a bucket are concatenated and suffix-sorted; the Burrows-Wheeler transform is
kept as runs with the suffix positions at both ends of each run. Between two sampled positions
the length of the longest other match falls by one for each byte, so matching statistics of the
text are streamed from the samples alone: repetitive text has few runs, hence few comparisons.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import repeats, windows
from tarn.llm.common import unpacked

#: Never a byte of UTF-8; ends each string of a bucket.
END = 0xFF


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling over the groups that are still tied."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j : j + n]
    sa = np.argsort(key)
    key = key[sa]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = np.flatnonzero(~head | ~np.concatenate((head[1:], [True])))
    k = 8
    while len(tied):
        p = sa[tied]
        both = rank[p] * (n + 2) + rank[np.minimum(p + k, n)] + 1
        order = np.argsort(both)
        p, both = p[order], both[order]
        sa[tied] = p
        head = np.concatenate(([True], both[1:] != both[:-1]))
        rank[p] = tied[np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))]
        tied = tied[~head | ~np.concatenate((head[1:], [True]))]
        k *= 2
    return sa


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, with the suffix positions at the ends of its runs."""

    def __init__(self, strings: list[bytes]) -> None:
        self.text = np.frombuffer(bytes([END]).join([*strings, b""]), np.uint8)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.stops = np.cumsum(self.lengths + 1) - 1
        sa = suffix_array(self.text)
        bwt = self.text[sa - 1]
        # each string starts afresh: ends are unlike each other, so its first position is always a sample
        change = (bwt[1:] != bwt[:-1]) | (bwt[1:] == END)
        above = np.flatnonzero(np.concatenate(([False], change)))
        below = np.flatnonzero(np.concatenate((change, [False])))
        self.run_bytes = bwt[np.concatenate(([True], change))]
        self.run_lengths = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], change))), [len(bwt)])))
        #: (suffix at a run's first row, suffix above it); (suffix at a run's last row, suffix below it)
        self.above, self.below = (sa[above], sa[above - 1]), (sa[below], sa[below + 1])
        self.edge = sa[0], sa[-1]

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest match that starts elsewhere, within its string."""
        n = len(self.text)
        room = np.repeat(self.stops, self.lengths + 1) - np.arange(n)
        best = np.zeros(n, np.int64)
        for (p, q), none in ((self.above, self.edge[0]), (self.below, self.edge[1])):
            low = windows.common_prefix(self.text, p, q, np.minimum(room[p], n - q))
            sample = np.full(n, -1, np.int64)
            sample[p] = low
            sample[none] = 0  # the first or last suffix has no neighbour there
            place = np.maximum.accumulate(np.where(sample >= 0, np.arange(n), 0))
            best = np.maximum(best, np.where(sample[place] >= 0, sample[place] - (np.arange(n) - place), 0))
        return np.minimum(best, room)


def repeated_windows(window: int) -> repeats.Resolver:
    def resolve(strings: list[bytes], n: np.ndarray, group: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        index = RunIndex(strings)
        of = np.repeat(np.arange(len(n)), n)
        begin = (index.stops - index.lengths)[of]
        at = begin + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return index.matching_statistics()[at] >= window

    return resolve


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 64) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (byte ranges removed) and kept_bytes (binary).

    A byte of the UTF-8 text goes if a string of `window` bytes over it also starts anywhere
    else: in another row, in a repeated row or elsewhere in its own. Null texts are empty; short
    ones lose nothing; ids only tell rows apart and may be null; an empty table gives an empty
    one. Columns of docs with these names are replaced.
    """
    rule = repeats.Rule(window, gram, False, False, repeated_windows(window))
    cut = repeats.cut(docs, id_col, text_col, rule)
    return unpacked(cut, F.col("units").alias("n_bytes"), F.col("removed").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("spans"), F.col("kept").alias("kept_bytes"))
