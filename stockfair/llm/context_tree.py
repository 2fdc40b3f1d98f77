"""Language-model scores of texts by context-tree weighting over bytes.

A text is its UTF-8 bytes with A-Z lowered and one end mark.  Every byte is eight
binary decisions, most significant first.  A decision has a node at each depth d from
0 to ``DEPTH``: the d bytes before it and the bits of the byte so far.  A node's counts of
zeros and ones in the training texts give its Krichevsky-Trofimov estimate and evidence
Pe; its weighted evidence is Pw = Pe at the greatest depth and
Pw = Pe / 2 + (product of Pw of the nodes one byte further back) / 2 elsewhere.  So the
estimates of all depths mix with the weights Pe / 2Pw on the way down; the mix ends with
the deepest context that the training texts hold, and a decision without any is even.
``score`` is the log10 probability of the text, so -score / log10(2) bits is its code length.

On Spark:

1. texts are dealt by hash into blocks of about ``BLOCK_BYTES``; a block's task finds its
   distinct (context, byte) grams and words with their counts in training texts.  A gram that
   fills a third of the corpus leaves each block once;
2. the blocks' lists are cut into parts by a hash of the two latest context bytes (words: of
   the word), written once, and merged per part; all nodes below depth 1 lie in one part.
   Depths 0 and 1 have at most 256 * 255 nodes, an alphabet's bound: their sums go to the
   driver and back as two small tables;
3. each part answers the blocks' lists in order, and a block scores its texts with the answers.

Lists are sorted, written as differences by byte planes, and answered without sending keys
again.  Part tasks hold one part's merged list and one block's list at a time; beyond
``BLOCKS_PER_TASK`` blocks, the lists of a part are merged and answered by several tasks.  A
block's task holds its texts, about 5 bytes for each of their bytes, and about 40 for each
byte of ``BYTES_AT_ONCE`` or of the longest text.

Defined cases: a null text is empty and has the end mark alone; a null id is a training
text; without training texts every decision is even and no token is known; rows equal in id
and text give their rows each and share a block; other columns play no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockfair.llm.common import stored

#: Greatest number of context bytes.
DEPTH = 5
#: Bytes of text in a block, and of those worked on at once.
BLOCK_BYTES = 8 << 20
BYTES_AT_ONCE = 2 << 20
#: Lists that one task merges or answers.
BLOCKS_PER_TASK = 512

#: The end mark: a byte that UTF-8 does not use.
END = 0xFF
GRAM, WORD = 0, 1
_U8 = np.uint64(8)
#: No key: keys have at most seven bytes (``depth`` is 2 to 6).
_NO_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- lists --------------------------------------------------------------------

def _packed(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if n == 0:
        return np.zeros(0, kind)
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, n, np.uint64), dtype=np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray):
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = _firsts(keys)
    return keys[first], (np.add.reduceat(counts[order], first) if len(keys) else counts)


# -- a block of texts -----------------------------------------------------------

def _grams(texts: list[bytes], depth: int):
    """(key of every position, first position and length of every text): a key is
    the ``depth`` bytes before, the latest highest, then the byte; ``_NO_KEY`` between
    the texts.  Eight bytes read from each byte on hold the latest one highest."""
    gap = bytes([END]) * depth
    data = np.frombuffer(bytes([END]) * 8 + gap.join(texts) + gap[:1], np.uint8)
    before = np.ndarray((len(data) - 8,), "<u8", data, 0, (1,))
    keys = ((before >> np.uint64(64 - 8 * depth)) << _U8) | data[8:]
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    starts = np.append(0, np.cumsum(sizes + (depth - 1))[:-1])
    keys[((starts + sizes)[:-1, None] + np.arange(depth - 1)).ravel()] = _NO_KEY
    return keys, starts, sizes


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[:len(x)])


def _lots(texts: list[bytes]):
    """(first, last + 1) of consecutive texts of about ``BYTES_AT_ONCE``."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + DEPTH
        if size >= BYTES_AT_ONCE or k == len(texts) - 1:
            yield first, k + 1
            first, size = k + 1, 0


def _distinct_grams(texts: list[bytes], train: np.ndarray, depth: int):
    """The block's distinct keys, sorted, with their counts in training texts."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for learnt in (True, False):
        some = [t for t, use in zip(texts, train.tolist()) if use is learnt]
        for lo, hi in _lots(some):
            codes = np.sort(_grams(some[lo:hi], depth)[0])
            first = _firsts(codes)
            n = np.diff(np.append(first, len(codes)))
            real = slice(0, len(first) - int(codes[-1] == _NO_KEY))
            keys, counts = _summed(np.concatenate([keys, codes[first][real]]),
                                   np.concatenate([counts, n[real] if learnt else np.zeros_like(n[real])]))
    return keys, counts


def _distinct_words(texts: list[bytes], train: np.ndarray):
    """The block's distinct words in byte order with their counts in training texts."""
    seen: Counter[bytes] = Counter()
    others: set[bytes] = set()
    for t, use in zip(texts, train.tolist()):
        (seen if use else others).update(t.split())
    words = sorted(others.union(seen))
    return words, np.fromiter((seen[w] for w in words), np.int64, len(words))


def _gram_parts(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    heads = keys >> np.uint64(8 * max(depth - 1, 0))
    return (((heads * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _word_parts(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))


def _by_part(part: np.ndarray):
    """(part, places of its members in order) of every part that has some."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = _firsts(part)
    for lo, hi in zip(cut, np.append(cut[1:], len(part))):
        yield int(part[lo]), order[lo:hi]


def _texts(table: pa.Table):
    return [t.lower() for t in table.column("text").to_pylist()], np.array(
        table.column("train").to_pylist(), bool)


LIST = "part int, kind int, block long, salt int, n long, keys binary, counts binary"


def _lists(depth: int, parts: int, salts: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        texts, train = _texts(table)
        rows = []
        keys, counts = _distinct_grams(texts, train, depth)
        for p, at in _by_part(_gram_parts(keys, depth, parts)):
            rows.append((p, GRAM, len(at), _pack_keys(keys[at]), _packed(counts[at])))
        words, counts = _distinct_words(texts, train)
        for p, at in _by_part(_word_parts(words, parts)):
            rows.append((p, WORD, len(at), _join(words[k] for k in at), _packed(counts[at])))
        return _list_table([(p, kind, block, block % salts, n, k, c) for p, kind, n, k, c in rows])
    return run


def _join(words) -> bytes:
    raw = b"\n".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _split(data: bytes) -> list[bytes]:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")


_LIST_TYPES = [("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("salt", pa.int32()),
               ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]


def _list_table(rows) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(_LIST_TYPES)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, _LIST_TYPES)], names=[n for n, _ in _LIST_TYPES])


# -- merging lists into the model's -----------------------------------------------

class _GramSum:
    """Sum of sorted lists of grams; only those that training texts hold stay."""

    def __init__(self):
        self.keys, self.counts, self.more, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, n, keys, counts):
        counts = _unpacked(counts, n, np.int64)
        keys = _unpack_keys(keys, n)[counts > 0]
        self.more.append((keys, counts[counts > 0]))
        self.size += len(keys)
        if self.size > len(self.keys) + (1 << 20):
            self._merge()

    def _merge(self):
        keys, counts = zip((self.keys, self.counts), *self.more)
        self.keys, self.counts = _summed(np.concatenate(keys), np.concatenate(counts))
        self.more, self.size = [], 0

    def row(self):
        self._merge()
        return len(self.keys), _pack_keys(self.keys), _packed(self.counts)


class _WordSum:
    def __init__(self):
        self.counts: dict[bytes, int] = {}

    def add(self, n, keys, counts):
        have = self.counts
        for w, c in zip(_split(keys), _unpacked(counts, n, np.int64).tolist()):
            if c:
                have[w] = have.get(w, 0) + c

    def row(self):
        words = sorted(self.counts)
        return len(words), _join(words), _packed(np.fromiter((self.counts[w] for w in words), np.int64, len(words)))


def _merged(lists: DataFrame, by: list[str]) -> DataFrame:
    """One list for each value of ``by`` (part, kind and perhaps salt)."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        key, total = None, None
        for b in batches:
            for r in b.to_pylist():
                now = (r["part"], r["kind"], r["salt"] if "salt" in by else 0)
                if now != key:
                    if key is not None:
                        yield _list_table([(key[0], key[1], -1, key[2], *total.row())]).to_batches()[0]
                    key, total = now, (_GramSum if r["kind"] == GRAM else _WordSum)()
                total.add(r["n"], r["keys"], r["counts"])
        if key is not None:
            yield _list_table([(key[0], key[1], -1, key[2], *total.row())]).to_batches()[0]

    return lists.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, LIST)


# -- the trees --------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma(x) for x >= 1/2 by Stirling's series, eight steps further on."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    inv = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) \
        + (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y - shift


def _evidence(n0, n1):
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _decisions(key: np.ndarray):
    """(node, bit) of the eight decisions of the bytes at the keys' ends."""
    byte = key & np.uint64(0xFF)
    for j in range(8):
        yield (byte >> np.uint64(8 - j)) | np.uint64(1 << j), (byte >> np.uint64(7 - j)) & np.uint64(1)


def _at_depth(keys: np.ndarray, depth: int, d: int) -> np.ndarray:
    """The contexts' latest d bytes, shifted for a node or byte."""
    return (keys >> np.uint64(8 * (depth - d) + 8)) << _U8


def _nodes(keys, counts, depth: int, d: int):
    """(node keys, zeros, ones) of depth d, sorted."""
    leaf, n = _summed(_at_depth(keys, depth, d) | (keys & np.uint64(0xFF)), counts)
    context = (leaf >> _U8) << _U8
    node, ones = zip(*[(context | k, n * b.astype(np.int64)) for k, b in _decisions(leaf)])
    node, ones, n = np.concatenate(node), np.concatenate(ones), np.tile(n, 8)
    found, total = _summed(node, n)
    _, ones = _summed(node, ones)
    return found, (total - ones).astype(float), ones.astype(float)


def _weigh(n0, n1, below):
    """(log Pw, weight of the node's own estimate) given log of the product of the
    nodes further back (None at the greatest depth)."""
    own = _evidence(n0, n1)
    if below is None:
        return own, np.ones_like(own)
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


class Trees:
    """The nodes from depth ``DEPTH`` to ``top`` of one part's training grams."""

    def __init__(self, keys, counts, depth: int, top: int = 2):
        self.depth, self.levels, below = depth, [], None
        for d in range(depth, top - 1, -1):
            node, n0, n1 = _nodes(keys, counts, depth, d)
            log_pw, weight = _weigh(n0, n1, None if below is None else _children(node, *below))
            self.levels.append((d, node, weight, (n1 + 0.5) / (n0 + n1 + 1)))
            below = node, log_pw
        self.below = below

    def log10(self, keys: np.ndarray, upper) -> np.ndarray:
        """log10 probability of the keys' bytes in their contexts; ``upper`` are the
        (depth, weights, estimates, seen) tables above these trees, deepest first."""
        total = np.zeros(len(keys))
        for k, bit in _decisions(keys):
            bit = bit.astype(bool)
            p = np.full(len(keys), np.nan)
            for d, node, weight, one in self.levels:
                want = _at_depth(keys, self.depth, d) | k
                at = np.minimum(np.searchsorted(node, want), max(len(node) - 1, 0))
                if len(node):
                    p = _mix(p, node[at] == want, weight[at], one[at], bit)
            for d, weight, one, seen in upper:
                at = (_at_depth(keys, self.depth, d) | k).astype(np.int64)
                p = _mix(p, seen[at], weight[at], one[at], bit)
            total += np.log10(np.where(np.isnan(p), 0.5, p))
        return total


def _children(node, child, log_pw):
    """Sum of the log Pw of the nodes one byte further back."""
    parent = ((child >> np.uint64(16)) << _U8) | (child & np.uint64(0xFF))
    return np.bincount(np.searchsorted(node, parent), weights=log_pw, minlength=len(node))


def _mix(p, seen, weight, one, bit):
    own = np.where(bit, one, 1 - one)
    return np.where(seen, np.where(np.isnan(p), own, weight * own + (1 - weight) * p), p)


def _upper_tables(rows):
    """Tables of depths 1 and 0 from summed (node, n0, n1, below) of depth 1."""
    node, n0, n1, below = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, float, float, float)))
    tables = []
    for d in (1, 0):
        log_pw, weight = _weigh(n0, n1, below)
        size = 1 << (8 * (d + 1))
        w, one, seen = np.zeros(size), np.zeros(size), np.zeros(size, bool)
        w[node], one[node], seen[node] = weight, (n1 + 0.5) / (n0 + n1 + 1), True
        tables.append((d, w, one, seen))
        if d:
            up, at = np.unique(node & 0xFF, return_inverse=True)
            n0, n1, below = (np.bincount(at, weights=x, minlength=len(up)) for x in (n0, n1, log_pw))
            node = up
    return tables


def _near_root(depth: int):
    """Rows (node, n0, n1, below, words, tokens): a part's share of the depth 1 nodes,
    or of the number of distinct words and of their tokens (node null)."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                counts = _unpacked(r["counts"], r["n"], np.int64)
                if r["kind"] == WORD:
                    cols = [[None], [0.0], [0.0], [0.0], [len(counts)], [int(counts.sum())]]
                else:
                    keys = _unpack_keys(r["keys"], r["n"])
                    tree = Trees(keys, counts, depth)
                    node, n0, n1 = _nodes(keys, counts, depth, 1)
                    cols = [node.astype(np.int64), n0, n1, _children(node, *tree.below), [0] * len(node), [0] * len(node)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(
                    cols, (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))],
                    names=["node", "n0", "n1", "below", "words", "tokens"])
    return run


# -- answers and scores --------------------------------------------------------------

class _GramModel:
    """A part's trees, with the values of its training grams worked out once."""

    def __init__(self, keys, counts, depth: int, upper):
        self.trees, self.upper, self.keys = Trees(keys, counts, depth), upper, keys
        self.values = self.trees.log10(keys, upper).astype(np.float32)

    def row(self, n, keys):
        keys = _unpack_keys(keys, n)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(n, bool)
        out = np.empty(n, np.float32)
        out[known] = self.values[at[known]]
        out[~known] = self.trees.log10(keys[~known], self.upper)
        return _packed(out)


class _WordModel:
    def __init__(self, words, counts):
        self.counts = dict(zip(words, counts.tolist()))

    def row(self, n, keys):
        return _packed(np.fromiter((self.counts.get(w, 0) for w in _split(keys)), np.int64, n))


def _answers(depth: int, upper):
    """The answers to a part's lists, which come after the part's merged one (block
    -1); without one, no training text has a gram or word of the part."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def run(batches):
        key, model = None, None
        for b in batches:
            for r in b.to_pylist():
                now, gram = (r["part"], r["kind"], r["salt"]), r["kind"] == GRAM
                if r["block"] == -1:
                    counts = _unpacked(r["counts"], r["n"], np.int64)
                    model = _GramModel(_unpack_keys(r["keys"], r["n"]), counts, depth, upper) if gram \
                        else _WordModel(_split(r["keys"]), counts)
                    key = now
                    continue
                if now != key:
                    key, model = now, _GramModel(*none, depth, upper) if gram else _WordModel([], none[1])
                yield pa.record_batch([pa.array([x], t) for x, t in (
                    (r["block"], pa.int64()), (r["part"], pa.int32()), (r["kind"], pa.int32()),
                    (model.row(r["n"], r["keys"]), pa.binary()))], names=["block", "part", "kind", "answer"])
    return run


def _scores(depth: int, parts: int, id_col: str, tokens: int, distinct: int, ends: int):
    """Rows of a block's texts.  ``tokens`` and ``distinct`` count training tokens with
    the end, ``ends`` the training texts."""
    each = math.log10(tokens + distinct + 1)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, train = _texts(docs)
        given = {(r["part"], r["kind"]): r["answer"] for r in answers.to_pylist()}
        lots = []
        for lo, hi in _lots(texts):
            codes, starts, sizes = _grams(texts[lo:hi], depth)
            order = np.argsort(codes)
            codes = codes[order]
            first = _firsts(codes)
            place = np.empty(len(codes), np.int32)
            place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(codes))))
            lots.append((lo, hi, codes[first], place, starts, sizes))
        keys = np.sort(np.concatenate([x[2] for x in lots]))
        keys = keys[_firsts(keys)]
        keys = keys[:len(keys) - int(keys[-1] == _NO_KEY)]
        value = np.zeros(len(keys) + 1, np.float32)              # the last one's for what is no key
        for p, at in _by_part(_gram_parts(keys, depth, parts)):
            value[at] = _unpacked(given[p, GRAM], len(at), np.float32)
        score = np.zeros(len(texts))
        for lo, hi, own, place, starts, sizes in lots:
            total = np.append(0, np.cumsum(value[np.searchsorted(keys, own)][place], dtype=np.float64))
            score[lo:hi] = total[starts + sizes] - total[starts]

        ids: dict[bytes, int] = {}
        found = [np.fromiter((ids.setdefault(w, len(ids)) for w in t.split()), np.int64) for t in texts]
        words = sorted(ids)
        times = np.zeros(len(words), np.int64)
        place = np.fromiter((ids[w] for w in words), np.int64, len(words))
        for p, at in _by_part(_word_parts(words, parts)):
            times[place[at]] = _unpacked(given[p, WORD], len(at), np.int64)
        share = np.log10(times + 1.0)
        n_tokens = [len(x) + 1 for x in found]
        n_known = [int(np.count_nonzero(times[x])) + (ends > 0) for x in found]
        base = [float(share[x].sum()) + math.log10(ends + 1) - n * each for x, n in zip(found, n_tokens)]
        return pa.table([docs.column(id_col), pa.array(~train), pa.array(n_tokens, pa.int64()),
                         pa.array(n_known, pa.int64()), pa.array([tokens] * len(texts), pa.int64()),
                         pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                        names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def held_out_ids(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text is 2 modulo 7; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, held_out: Column | None = None, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row: the
    model learns from the rows that are not ``held_out`` and scores all.  ``base_score`` is
    the add-one unigram model of words and end.  ``depth`` is 2 to 6."""
    spark = docs.sparkSession
    held = held_out_ids(F.col(id_col)) if held_out is None else F.coalesce(held_out, F.lit(False))
    cols = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
                       (~held).alias("train"))
    total = cols.agg(F.sum(F.octet_length("text").cast("long") + 1), F.count_if("train")).first()
    ends = total[1] or 0
    blocks = max(1, -(-(total[0] or 0) // block_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = 1 + blocks // BLOCKS_PER_TASK
    dealt = cols.withColumn("block", F.pmod(F.xxhash64(id_col, "text"), F.lit(blocks)))
    lists = stored(dealt.groupBy("block").applyInArrow(_lists(depth, parts, salts), LIST))
    merged = lists if salts == 1 else _merged(lists, ["part", "kind", "salt"])
    merged = stored(_merged(merged, ["part", "kind"]))
    near = merged.mapInArrow(_near_root(depth), "node long, n0 double, n1 double, below double, words long, tokens long")
    near = near.groupBy("node").agg(*[F.sum(c) for c in ("n0", "n1", "below", "words", "tokens")]).collect()
    upper = _upper_tables(sorted(r for r in near if r[0] is not None))
    distinct, tokens = next(((r[4], r[5]) for r in near if r[0] is None), (0, 0))
    every = merged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = every.unionByName(lists).repartition(parts, "part", "kind", "salt") \
        .sortWithinPartitions("part", "kind", "salt", "block")
    answers = asked.mapInArrow(_answers(depth, upper), "block long, part int, kind int, answer binary")
    kind = cols.schema[0].dataType.simpleString()
    run = _scores(depth, parts, id_col, tokens + ends, distinct + (ends > 0), ends)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double")
