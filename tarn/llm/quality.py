"""Quality rules: counts within a text, and lines that too many documents of a host share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import windows
from tarn.llm.common import Scratch, packed, stage, strings_of, text_hash, unpacked

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
#: A line is above limits if over LINE_DOCS documents of its host have it, and over LINE_MOST or over 1 in LINE_SHARE of them do.
LINE_DOCS, LINE_MOST, LINE_SHARE = 10, 100, 50
#: Lines above limits (32 bytes each) that are sent to every task; more are joined to their documents instead.
BROADCAST_LINES = 50_000
#: A document is depleted if, without such lines, fewer words than these are left, or less than this share.
WORDS_LEFT, SHARE_LEFT = 20, 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_digits = re.compile("[0-9]+")


def line_hash(line: bytes) -> int:
    """Signed hash of a line in lower case, with single spaces and with 0 for every number."""
    flat = _digits.sub("0", b" ".join(line.split()).decode("utf-8", "replace").lower())
    return xxhash.xxh3_64_intdigest(flat.encode()) - (1 << 63)


def counts(texts: list[bytes]) -> np.ndarray:
    """COUNTS of each text, a row each; in slices of about a megabyte."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= windows.SLICE_BYTES):
            size += len(texts[hi])
            hi += 1
        out[lo:hi] = _counts(texts[lo:hi])
        lo = hi
    return out


def _counts(texts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends = windows.word_bounds(data)
    first = np.searchsorted(starts, edge)
    n_words = np.diff(first)

    def between(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[edge])

    space = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    dup_lines = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))

    repeated = np.zeros(len(texts), np.int64)
    n, w = len(starts), REPEAT_WINDOW
    if n >= w:
        word = windows.mixed(windows.PrefixHash(data).ranges(starts, ends))
        window = np.zeros(n - w + 1, np.uint64)
        for j in range(w):
            window = window * np.uint64(windows.BASE) + word[j : n - w + 1 + j]
        text = np.repeat(np.arange(len(texts)), n_words)
        inside = np.flatnonzero(text[: n - w + 1] == text[w - 1 :])
        order = inside[np.lexsort((window[inside], text[inside]))]
        same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
        again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + w, -1)
        repeated = np.bincount(text, weights=np.cumsum(cover)[:n] > 0, minlength=len(texts)).astype(np.int64)
    return np.stack([n_words, between(~space & ((data & 0xC0) != 0x80)), between(symbol[data]), dup_lines, repeated], axis=1)


def document_lines(docs: DataFrame) -> DataFrame:
    """docs(host, id, th, text) to (host, id, th, line): hashes of the normalised lines with a word, each once for a document."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, buf = strings_of(batch.column(3))
            rows, hashes = [], []
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                mine = {line_hash(x) for x in bytes(buf[a:b]).split(b"\n") if x.strip()}
                rows += [i] * len(mine)
                hashes += mine
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(hashes, pa.int64())], ["host", "id", "th", "line"])

    return docs.select("host", "id", "th", "text").mapInArrow(lines, "host long, id long, th long, line long").distinct()


def common_lines(docs: DataFrame, lines: DataFrame, least: int = LINE_DOCS, most: int = LINE_MOST, share: int = LINE_SHARE) -> DataFrame:
    """(host, line, id, th): the lines above limits, and the first document of the host that has each."""
    totals = docs.select("host", "id", "th").distinct().groupBy("host").agg(F.count("*").alias("documents")).withColumnRenamed("host", "t_host")
    found = lines.groupBy("host", "line").agg(F.count("*").alias("n"), F.min(F.struct("id", "th")).alias("first")).where(F.col("n") > least)
    above = found.join(totals, F.col("host") == F.col("t_host")).where((F.col("n") > most) | (F.col("n") * share > F.col("documents")))
    return above.select("host", "line", "first.id", "first.th")


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with COUNTS, base_failed, kept, n_lines_removed, n_words_left and kept_text.

    base_failed: under 20 words, or over 30 % of them in windows of REPEAT_WINDOW words found
    twice or more. Lines that too many documents of a host have (common_lines) are removed from all
    but the first of these, so one of a group of copies keeps its text; kept is false if base_failed
    or if the document is depleted by that. Documents are told apart by id and text: rows that agree
    in both are one document. Null texts have no words and fail; a null host is a host like others, hosts are
    told apart by 64-bit hashes; null ids come after all others; an empty table gives an empty one. Columns of docs
    with these names are replaced.
    """
    host = F.xxhash64(F.col(f"`{host_col}`"), F.col(f"`{host_col}`").isNull()).alias("host")
    own = [host, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)).alias("id"), text_hash(f"`{text_col}`").alias("th")]
    scratch = Scratch(docs.sparkSession)
    base = docs.select(*own, F.col(f"`{text_col}`").alias("text"))
    lines = scratch.stage(document_lines(base), "document-lines")
    above = stage(common_lines(base, lines), "lines")
    packed_docs = docs.select(packed(docs), *own)
    few = above.limit(BROADCAST_LINES + 1).collect()
    if len(few) <= BROADCAST_LINES:
        sent = np.array([tuple(r) for r in few], np.int64).reshape(-1, 4)
        joined = packed_docs.withColumn("lines", F.lit(None).cast("array<long>"))
    else:
        sent = np.zeros((0, 4), np.int64)
        first = above.select(F.col("host").alias("a_host"), F.col("line").alias("a_line"), F.col("id").alias("a_id"), F.col("th").alias("a_th"))
        bad = lines.join(first, (F.col("host") == F.col("a_host")) & (F.col("line") == F.col("a_line"))).where("id <> a_id or th <> a_th")
        lists = bad.groupBy("host", "id", "th").agg(F.collect_list("line").alias("lines"))  # each holds lines of one document
        lists = stage(lists.withColumnsRenamed({"host": "l_host", "id": "l_id", "th": "l_th"}), "bad-lines")
        joined = packed_docs.join(lists, (F.col("host") == F.col("l_host")) & (F.col("id") == F.col("l_id")) & (F.col("th") == F.col("l_th")), "left")
    scratch.drop()
    joined = joined.select("row", "lines", "host", "id", "th")
    place_of_text = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[int, set[int]] = {}
        own: dict[tuple[int, int, int], set[int]] = {}  # lines that a document is the first to have
        for h, line, i, t in sent.tolist():
            common.setdefault(h, set()).add(line)
            own.setdefault((h, i, t), set()).add(line)
        for batch in batches:
            starts, ends, buf = strings_of(batch.column(0).field(place_of_text))
            texts = [bytes(buf[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            n_removed, left, kept = [], [], []
            for text, lines, *me in zip(texts, batch.column(1), *(batch.column(c).to_pylist() for c in (2, 3, 4))):
                bad = set(lines.values.to_numpy().tolist()) if lines.is_valid else common.get(me[0], set())
                if mine := own.get(tuple(me)):
                    bad = bad - mine
                split = text.split(b"\n") if bad else [text]
                stay = [x for x in split if not x.strip() or line_hash(x) not in bad] if bad else split
                n_removed.append(len(split) - len(stay))
                after = b"\n".join(stay) if len(stay) < len(split) else text
                kept.append(None if after is text else after)
                left.append(len(after.split()))
            c = counts(texts)
            left = np.array(left, np.int64)
            failed = (c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0])
            fine = ~failed & (left >= WORDS_LEFT) & (left >= SHARE_LEFT * c[:, 0])
            made = [pa.array(failed), pa.array(fine), pa.array(n_removed, pa.int64()), pa.array(left), pa.array(kept, pa.binary())]
            names = ["row", *COUNTS, "base_failed", "kept", "n_lines_removed", "n_words_left", "kept_text"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k].copy()) for k in range(len(COUNTS))), *made], names)

    row = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(apply, f"row {row}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, n_lines_removed long, n_words_left long, kept_text binary")
    return unpacked(out, *(F.col(c) for c in (*COUNTS, "base_failed", "kept", "n_lines_removed", "n_words_left")), F.coalesce(F.col("kept_text").cast("string"), F.col(f"row.`{text_col}`"), F.lit("")).alias("kept_text"))
