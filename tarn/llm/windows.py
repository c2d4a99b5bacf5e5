"""Super-k-mers: runs of consecutive windows that share the position of their minimiser.

Units are words of a text whose words are joined by one space, or single bytes. All
hashing is vectorised over slices of about a megabyte, so memory doesn't follow text length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Multiplier of the polynomial prefix hash (odd, so that it has an inverse modulo 2^64).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20
POSITION_BITS = 22

_pow = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    if _pow["n"] < n:
        up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _pow.update(n=n, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _pow["up"], _pow["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of h counts in comparisons."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class PrefixHash:
    """Hashes of any byte range of a buffer in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.h = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.h[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.h[ends] - self.h[starts]) * self.down[starts]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    word = np.ones(len(data) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def slices(texts: list[bytes], window: int, words: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]], bytes]]:
    """(unit starts, unit ends, data, pieces, buffer) for texts in slices; pieces: (text, first unit in it, first unit here, units).

    A long text is dealt over several slices that overlap by one window less a unit.
    """

    def emit(parts, pieces):
        buf = b"\n".join(parts)
        data = np.frombuffer(buf, np.uint8)
        if words:
            starts, ends = word_bounds(data)
        else:
            starts = np.arange(len(data))
            ends = starts + 1
        return starts, ends, data, pieces, buf

    parts, pieces, total, units = [], [], 0, 0
    for i, text in enumerate(texts):
        if words:
            if len(text) > 2 * SLICE_BYTES:
                starts, ends = word_bounds(np.frombuffer(text, np.uint8))
                n, step = len(starts), SLICE_BYTES // 8
            else:
                n = text.count(b" ") + 1 if text else 0
                starts, step = None, n
        else:
            n, step, starts = len(text), SLICE_BYTES, None
            step = n if n <= 2 * SLICE_BYTES else step
        if n < window:
            continue
        for a in range(0, max(1, n - window + 1), max(1, step)):
            b = min(n, a + step + window - 1)
            if words:
                part = text if starts is None else text[starts[a] : ends[b - 1]]
            else:
                part = text if step == n else text[a:b]
            if parts and total + len(part) > SLICE_BYTES:
                yield emit(parts, pieces)
                parts, pieces, total, units = [], [], 0, 0
            pieces.append((i, a, units, b - a))
            parts.append(part)
            total += len(part) + 1
            units += b - a + (0 if words else 1)
            if step == n:
                break
    if parts:
        yield emit(parts, pieces)


def superkmers(texts: list[bytes], window: int, gram: int, words: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first window, windows, minimiser, digest of the packed string) for each text with a window.

    texts: normalised word texts, or plain bytes. Equal windows always get equal minimisers
    at equal distances, so two super-k-mers that share a window share their minimiser.
    """
    w = window - gram + 1
    low = np.uint64((1 << POSITION_BITS) - 1)
    for starts, ends, data, pieces, buf in slices(texts, window, words):
        n = len(starts)
        grams = mixed(PrefixHash(data).ranges(starts[: n - gram + 1], ends[gram - 1 :]))
        key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        best = (sliding_min(key, w) & low).astype(np.int64)
        view = memoryview(buf)
        for text, first, at, units in pieces:
            own = best[at : at + units - window + 1]
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            s = np.concatenate(([0], cut))
            e = np.concatenate((cut, [len(own)]))
            a, b = starts[at + s].tolist(), ends[at + e + window - 2].tolist()
            digest = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(a, b)), np.uint64, len(s))
            yield text, first + s, e - s, grams[own[s]].view(np.int64), digest.view(np.int64)


def told_apart(data: bytes, starts: np.ndarray, ends: np.ndarray, groups: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each string data[start:end], equal in a group for equal strings only: strings of equal hash are compared byte by byte."""
    order = np.lexsort((hashes, groups))
    new = np.concatenate(([True], (groups[order][1:] != groups[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])))[: len(order)]
    a, b = starts[order].tolist(), ends[order].tolist()
    unlike = [k for k in np.flatnonzero(~new).tolist() if data[a[k - 1] : b[k - 1]] != data[a[k] : b[k]]]
    number = np.cumsum(new) - 1
    if unlike:  # strings that collide
        edge, after = np.append(np.flatnonzero(new), len(order)), int(number[-1]) + 1
        for run in np.unique(number[unlike]).tolist():
            seen: dict[bytes, int] = {}
            for k in range(edge[run], edge[run + 1]):
                number[k] = after + seen.setdefault(data[a[k] : b[k]], len(seen))
            after += len(seen)
    out = np.empty(len(order), np.int64)
    out[order] = number
    return out


def common_prefix(data: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of data[p:] and data[q:], `most` at most, byte by byte."""
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    wide = np.lib.stride_tricks.sliding_window_view(wide, 8)
    out, active, k = most.copy(), np.flatnonzero(most > 0), 0
    while len(active):
        x, y = wide[p[active] + k], wide[q[active] + k]
        differ = x != y
        unlike = differ.any(axis=1)
        at = active[unlike]
        out[at] = np.minimum(out[at], k + np.argmax(differ[unlike], axis=1))
        active, k = active[~unlike], k + 8
        active = active[most[active] > k]
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal disjoint ranges in order (touching ones are joined)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(e) - 1]))]
