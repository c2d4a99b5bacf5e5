"""Substring dedup: long word sequences that an earlier document has already, by super-k-mer partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import repeats, windows
from tarn.llm.common import unpacked


def earlier_windows(window: int) -> repeats.Resolver:
    def resolve(strings: list[bytes], n: np.ndarray, group: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Windows sorted by bucket and content: one is removed if a lower id has an equal one."""
        text = b"\n".join(strings)
        data = np.frombuffer(text, np.uint8)
        starts, ends = windows.word_bounds(data)
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of)) + of * (window - 1)
        first, last = starts[at], ends[at + window - 1]
        same = windows.told_apart(text, first, last, group[of], windows.PrefixHash(data).ranges(first, last))
        lows = low[of]
        least = np.full(int(same.max()) + 1 if len(same) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, same, lows)
        return lows > least[same]

    return resolve


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 16, layout: bool = False) -> DataFrame:
    """docs with n_words, n_removed, spans (word ranges removed) and kept_text.

    A word goes if a window of `window` words over it also starts in a document with a smaller
    id. Words are runs of other than ASCII white space, compared as they are; kept words are
    joined by one space (with `layout`, kept runs keep their white space, and a text that loses
    nothing stays as it is). Null and short texts have no windows; a null id is larger than any
    other; rows of equal id don't remove each other's words; an empty table gives an empty one.
    Columns of docs with these names are replaced.
    """
    rule = repeats.Rule(window, gram, True, True, earlier_windows(window))
    cut = repeats.cut(docs, id_col, text_col, rule, layout)
    return unpacked(cut, F.col("units").alias("n_words"), F.col("removed").alias("n_removed"), F.col("spans"), F.col("kept").cast("string").alias("kept_text"))
