"""Periodic run detection: the maximal stretches of consecutive words with a
smallest period q that are at least three periods (and ``least`` words) long.

String synchronising sets: at every dyadic scale t, windows of t words get a
hash, and a position is chosen when the least hash of the t + 1 windows from it on
is that of the first or the last of them.  Which positions are chosen depends on the
2 t words after them alone, so copies of a passage are chosen alike.  Windows with a
period of t / 3 or less (highly periodic regions) are left out; at least one position
is chosen in any t others.

* Equal-context pairs propose periods: a chosen position and the next chosen one
  with the same context, 2 t words for distances up to 2 t and 3 t words beyond, up
  to 3 t.  In a run of period q between 1.5 t and 3 t a chosen position lies early
  enough for its context and the one q words on to fit in the run, and a context of q
  words or more recurs inside a run at multiples of q only: each run is proposed.
* Highly periodic regions are detected separately: periods up to 5 by comparing each
  word with the one so many words on, longer ones as runs of the smaller scales.  They
  give the windows that a scale leaves out and supply the small periods.

A proposed stretch is extended both ways over hashes of 2^k words, the largest k
first.  All texts of a lot (``WORDS_AT_ONCE`` words, or one text) are one sequence
with a different separator after each, worked on as arrays, in one ``mapInArrow`` over
the scan without a shuffle: about 8 log2(n) bytes a word of the longest text.  Rows are
read and given ``BYTES_AT_ONCE`` at a time, so a worker never holds the words or runs of
a whole Arrow batch.

Defined cases: a null, empty or blank text has no words and no runs; runs of the same
text may overlap and all are given; ties of the strongest run go to the smallest start,
then period; repeated rows give their rows each; columns other than id and text play
no part; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least length of a run in words.
LEAST = 24
WORDS_AT_ONCE = 1 << 15
#: Bytes of text of the rows that are read and given at once.
BYTES_AT_ONCE = 1 << 19
SMALL_PERIODS = range(1, 6)
FIRST_SCALE = 4

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order (multiply and shift, not linear)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _window_hashes(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of all windows of 1, 2, 4 ... words, up to ``longest``."""
    h = codes.astype(np.uint64)
    levels = [_mixed(h, h)]
    while (size := 1 << (len(levels) - 1)) * 2 <= min(longest, len(codes)):
        levels.append(_mixed(levels[-1][:-size], levels[-1][size:]))
    return levels


def _extended(levels, a, b):
    """Words that agree from positions a and b on, and before them."""
    n = len(levels[0])
    right, left = np.zeros_like(a), np.zeros_like(a)
    for k in range(len(levels) - 1, -1, -1):
        h, size = levels[k], 1 << k
        at = np.minimum(b + right, n - size)
        near = np.maximum(a + at - b, 0)             # a + right wherever the window ends in the sequence
        right += np.where((b + right <= n - size) & (h[near] == h[at]), size, 0)
        at = np.maximum(a - left - size, 0)
        left += np.where((a - left >= size) & (h[at] == h[np.maximum(b - left - size, 0)]), size, 0)
    return left, right


def _direct(codes: np.ndarray, period: int):
    """(start, length) of the stretches of a period of three periods or more."""
    same = np.zeros(max(len(codes) - period, 0) + 2, np.int8)
    same[1:-1] = codes[:-period] == codes[period:] if len(codes) > period else 0
    edge = np.diff(same)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stop - start >= 2 * period
    return start[long], (stop - start)[long] + period


def _periodic_windows(n: int, size: int, start, length, period) -> np.ndarray:
    """Whether the ``size`` words from each of ``n`` positions on lie in a
    stretch with a period of a third of them or less."""
    some = (3 * period <= size) & (length >= size)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start[some], 1)
    np.add.at(edge, start[some] + length[some] - size + 1, -1)
    return np.cumsum(edge)[:n] > 0


def synchronising_set(h: np.ndarray, size: int, left_out: np.ndarray) -> np.ndarray:
    """Positions chosen at scale ``size`` (a power of two) among windows hashed to ``h``."""
    ids = np.where(left_out, _NONE, h)
    least, width = ids, 1
    while width < size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])                # of size + 1 windows
    chosen = (least != _NONE) & ((ids[:len(least)] == least) | (ids[size:size + len(least)] == least))
    return np.flatnonzero(chosen)


def _proposals(levels, scale: int, chosen: np.ndarray):
    """(position, distance) of chosen positions and the next of equal context."""
    k, n = scale.bit_length() - 1, len(levels[0])
    for context, low, high in ((2 * scale, 3 * scale // 2, 2 * scale), (3 * scale, 2 * scale, 3 * scale)):
        pos = chosen[chosen <= n - context]
        h = levels[k + 1][pos]
        if context > 2 * scale:
            h = _mixed(h, levels[k][pos + 2 * scale])
        order = np.argsort(h, kind="stable")
        h, pos = h[order], pos[order]
        gap = pos[1:] - pos[:-1]
        good = (h[1:] == h[:-1]) & (gap >= low) & (gap <= high)
        yield pos[:-1][good], gap[good]


def find_runs(codes: np.ndarray, longest: int, least: int = LEAST):
    """(start, length, period) arrays, by start and period, of all runs in a
    sequence of word codes whose texts, at most ``longest`` words each, are
    followed by codes that occur once."""
    # a window that is looked at never needs to be longer than a text
    levels = _window_hashes(codes, max(longest, 1))
    found = []
    for q in SMALL_PERIODS:
        start, length = _direct(codes, q)
        found.append((start, length, np.full(len(start), q, np.int64)))
    runs = _distinct([np.concatenate(x) for x in zip(*found)])
    scale = FIRST_SCALE
    while 9 * scale // 2 <= longest and scale.bit_length() < len(levels):
        h = levels[scale.bit_length() - 1]
        chosen = synchronising_set(h, scale, _periodic_windows(len(h), scale, *runs))
        pairs = list(_proposals(levels, scale, chosen))
        a, q = (np.concatenate(x) for x in zip(*pairs))
        left, right = _extended(levels, a, a + q)
        keep = left + right >= 2 * q
        runs = _distinct([np.concatenate(x) for x in zip(
            runs, (a[keep] - left[keep], (left + right + q)[keep], q[keep]))])
        scale *= 2
    start, length, period = runs
    keep = length >= least
    return start[keep], length[keep], period[keep]


def _distinct(runs):
    """By start and period, each stretch once, with its smallest period: a stretch
    of three periods that has a smaller one too is the run of that one."""
    start, length, period = runs
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _lots(texts):
    """Lots of texts of similar length as (place, words): a short text is not
    taken through the scales of a long one."""
    words = [(k, (t or "").encode().split()) for k, t in enumerate(texts)]
    words.sort(key=lambda x: len(x[1]))
    lot, size = [], 0
    for k, w in words:
        if lot and (size + len(w) > WORDS_AT_ONCE or len(w) > 4 * len(lot[0][1]) + 64):
            yield lot
            lot, size = [], 0
        lot.append((k, w))
        size += len(w)
    if lot:
        yield lot


def _slices(batch: pa.RecordBatch):
    """Consecutive rows of about ``BYTES_AT_ONCE`` bytes of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        n = max(int(np.searchsorted(sizes, before + BYTES_AT_ONCE, "right")) - at, 1)
        yield batch.slice(at, n)
        at += n


def _of_texts(texts, least: int):
    """(number of words, runs, collapsed text) of every text."""
    out = [None] * len(texts)
    for lot in _lots(texts):
        ids: dict[bytes, int] = {}
        parts, starts, at = [], [], 0
        for k, (_, w) in enumerate(lot):
            parts.append(np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, len(w)))
            parts.append(np.array([-1 - k], np.int64))
            starts.append(at)
            at += len(w) + 1
        start, length, period = find_runs(np.concatenate(parts), max(len(w) for _, w in lot), least)
        edge = np.zeros(at + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        kept = np.cumsum(edge)[:at] == 0
        cut = np.searchsorted(start, np.array([*starts, at]))
        for (k, w), s, lo, hi in zip(lot, starts, cut[:-1], cut[1:]):
            runs = list(zip((start[lo:hi] - s).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist()))
            rest = w if not runs else compress(w, kept[s:s + len(w)].tolist())
            out[k] = (len(w), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(rest).decode())
    return out


def find(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs array<struct<start, length, period>>, collapsed) per row:
    runs by start, then period, in words from 0; ``collapsed`` has the words that no run
    holds behind its first period, joined by a space."""
    def run(batches):
        for b in chain.from_iterable(map(_slices, batches)):
            rows = _of_texts(b.column(1).to_pylist(), least)
            yield pa.record_batch(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], RUNS),
                 pa.array([r[2] for r in rows], pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    cols = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = cols.schema[0].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, n_words long, "
                                "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties by
    smallest start, then period; null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
