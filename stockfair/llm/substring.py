"""Removal of long repeated passages by de Bruijn compaction.

Windows of ``WINDOW`` consecutive words are the edges of a de Bruijn graph over
words.  Three rounds find the passages that occur more than once:

1. edges: which windows start in more than one place;
2. links: for each repeated edge, whether all its places have the same edge
   before and after it; a link between neighbours that holds on both sides is
   nonbranching, and chains of such links are compacted paths: every place of
   one of its edges lies in a place of the whole path;
3. paths: their places are joined on path, length and a 128-bit digest of the
   words at the source coordinates; paths found there twice or more are
   verified, and the words they cover are removed.

How it spreads: documents are dealt into batches of about ``BATCH_BYTES`` (one
shuffle of the texts, reused by all rounds).  In rounds 1 and 2 a batch asks
about its distinct edges, sorted and packed by range of the edge's hash (a few
bytes per edge); each range is answered by one task, and answers go back to the
batch.  An edge that a third of all documents hold is asked once per batch, not
once per place.  Ranges hold about ``RANGE_EDGES`` edges at any size of input.
Path rows, too, are one per path and batch.

Round 1 goes by 48 bits of an edge's hash and so lets a few single edges pass;
round 2 by 64 bits, neighbours by 40 bits of theirs; equal hashes of different
words end at the digest of the words.

Defined cases: null or empty texts have no words and nothing is removed; texts
shorter than a window are kept whole; a document may repeat itself; repeated
rows (equal id and text) are places of their own, so such texts go if they are
long enough; ids may be null; an empty table gives an empty result; columns
besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WINDOW = 35
BATCH_BYTES = 4_000_000
RANGE_EDGES = 1_000_000
#: Bytes per word assumed when the number of ranges is set; no limit.
WORD_BYTES = 6
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NONE, SEVERAL = np.uint64(1), np.uint64(0)
LINK_BITS = np.uint64((1 << 40) - 1)
#: Round 1 asks with the highest bits of a hash: a few more edges go on to round 2.
COARSE_BITS = 48
COARSE_SHIFT = np.uint64(64 - COARSE_BITS)


def _words(raw: bytes | None) -> list[bytes]:
    return raw.split() if raw else []  # bytes: \x20 and \x09-\x0D only


def _edges(docs: list[list[bytes]], window: int):
    """(hashes, doc, start) of all windows, in document order."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    sizes = np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    h = np.fromiter((one(w) for d in docs for w in d), np.uint64, total)
    # hash of m words by doubling: H(a + b) at i = H(a) at i * M^b + H(b) at i + a
    with np.errstate(over="ignore"):
        acc, acc_len, cur, cur_len, power, k = None, 0, h, 1, MULTIPLIER, window
        while k:
            if k & 1:
                if acc is None:
                    acc, acc_len = cur, cur_len
                else:
                    m = max(0, total - acc_len - cur_len + 1)
                    acc = acc[:m] * power + cur[acc_len:acc_len + m]
                    acc_len += cur_len
            k >>= 1
            if k:
                m = max(0, total - 2 * cur_len + 1)
                cur = cur[:m] * power + cur[cur_len:cur_len + m]
                cur_len, power = 2 * cur_len, power * power
        # spread over all bits: ranges go by the highest
        acc = (acc ^ (acc >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        acc = (acc ^ (acc >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        acc = acc ^ (acc >> np.uint64(31))
    doc = np.repeat(np.arange(len(docs)), sizes)[:len(acc)]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(docs) else np.zeros(0, np.int64)
    start = np.arange(len(acc)) - first[doc]
    inside = start + window <= sizes[doc]
    return acc[inside], doc[inside], start[inside]


def _range_starts(n: int, bits: int = 64) -> np.ndarray:
    """Least hash of ``bits`` bits of each of ``n`` ranges."""
    return np.array([-(-(b << bits) // n) for b in range(n)], np.uint64)


def _pack(v: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers by place, so empty high places compress."""
    return v.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _pack_sorted(v: np.ndarray) -> bytes:
    return _pack(np.diff(v, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def _slices(sorted_keys: np.ndarray, starts: np.ndarray):
    """(range, from, to) of the ranges that have keys."""
    cut = np.append(np.searchsorted(sorted_keys, starts), len(sorted_keys))
    for b in np.flatnonzero(cut[1:] > cut[:-1]):
        yield int(b), int(cut[b]), int(cut[b + 1])


def _runs(keys: list[np.ndarray]):
    """Entries of all askers sorted by key: (order, first of each run, run of
    each sorted entry)."""
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _back(values: np.ndarray, order: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """``values`` of sorted entries, dealt back to their askers."""
    out = np.empty(len(values), values.dtype)
    out[order] = values
    return np.split(out, np.cumsum(sizes)[:-1])


class _Batch:
    """Documents of one batch: words, edges and, once, distinct edges."""

    def __init__(self, table: pa.Table, window: int, hashed: bool = True):
        self.ids = table.column("id").to_pylist()
        self.keys = table.column("text_key").to_pylist()
        self.docs = [_words(r) for r in table.column("text").cast(pa.binary()).to_pylist()]
        if hashed:
            self.edge, self.doc, self.start = _edges(self.docs, window)


def _answers(table: pa.Table, column: str) -> dict[int, bytes]:
    return dict(zip(table.column("range").to_pylist(), table.column(column).to_pylist()))


def repeated_passages(docs: DataFrame, n_batches: int, n_ranges: int, window: int = WINDOW) -> DataFrame:
    """Verified paths: (batch, path, edges, digest, places), one row for each
    path and batch; ``places`` are (id, text_key, start in words), and the
    passage has ``edges + window - 1`` words.  ``docs`` is what ``_dealt``
    returns."""
    id_type = docs.schema["id"].dataType.simpleString()

    def ask_edges(table):
        b, batch = _Batch(table, window), table.column("batch")[0]
        own, count = np.unique(b.edge >> COARSE_SHIFT, return_counts=True)
        rows = [(r, _pack_sorted(own[i:j]), np.packbits(count[i:j] > 1).tobytes())
                for r, i, j in _slices(own, _range_starts(n_ranges, COARSE_BITS))]
        r, keys, twice = zip(*rows) if rows else ((), (), ())
        return pa.table({"range": pa.array(r, pa.int32()), "batch": pa.array([batch.as_py()] * len(r), pa.int32()),
                         "keys": pa.array(keys, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def answer_edges(table):
        keys = [_unpack_sorted(k) for k in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        order, first, run = _runs(keys)
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in
                                zip(table.column("twice").to_pylist(), sizes)])[order]
        many = (np.diff(np.append(first, len(order))) > 1) | (np.maximum.reduceat(twice, first) > 0)
        bits = [np.packbits(x).tobytes() for x in _back(many[run], order, sizes)]
        return pa.table({"batch": table.column("batch"), "range": table.column("range"),
                         "bits": pa.array(bits, pa.binary())})

    def ask_links(table, answers):
        if not table.num_rows or not answers.num_rows:
            return _EMPTY_LINKS
        b, batch = _Batch(table, window), table.column("batch")[0].as_py()
        own, inverse = np.unique(b.edge >> COARSE_SHIFT, return_inverse=True)
        bits, many = _answers(answers, "bits"), np.zeros(len(own), bool)
        for r, i, j in _slices(own, _range_starts(n_ranges, COARSE_BITS)):
            many[i:j] = np.unpackbits(np.frombuffer(bits[r], np.uint8), count=j - i).astype(bool)
        at = np.flatnonzero(many[inverse])
        if not len(at):
            return _EMPTY_LINKS
        same = b.doc[1:] == b.doc[:-1] if len(b.doc) else np.zeros(0, bool)
        link = np.maximum(b.edge & LINK_BITS, np.uint64(2))
        before, after = np.full(len(link), NONE), np.full(len(link), NONE)
        before[1:][same] = link[:-1][same]
        after[:-1][same] = link[1:][same]
        at = at[np.argsort(b.edge[at], kind="stable")]
        keys = b.edge[at]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))

        def one(v):
            v = v[at]
            low, high = np.minimum.reduceat(v, new), np.maximum.reduceat(v, new)
            return np.where(low == high, low, SEVERAL)

        keys, before, after = keys[new], one(before), one(after)
        rows = [(r, _pack_sorted(keys[i:j]), _pack(before[i:j]), _pack(after[i:j]))
                for r, i, j in _slices(keys, _range_starts(n_ranges))]
        r, k, p, s = zip(*rows)
        return pa.table({"range": pa.array(r, pa.int32()), "batch": pa.array([batch] * len(r), pa.int32()),
                         "keys": pa.array(k, pa.binary()), "before": pa.array(p, pa.binary()),
                         "after": pa.array(s, pa.binary())})

    def answer_links(table):
        keys = [_unpack_sorted(k) for k in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        order, first, run = _runs(keys)
        flags = np.zeros(len(first), np.uint8)
        for name, bit in (("before", 1), ("after", 2)):
            v = np.concatenate([_unpack(x) for x in table.column(name).to_pylist()])[order]
            low, high = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
            flags |= np.where((low == high) & (low > NONE), np.uint8(bit), np.uint8(0))
        return pa.table({"batch": table.column("batch"), "range": table.column("range"),
                         "keys": table.column("keys"),
                         "flags": pa.array([x.tobytes() for x in _back(flags[run], order, sizes)], pa.binary())})

    def compact(table, answers):
        import xxhash

        if not table.num_rows or not answers.num_rows:
            return _EMPTY_PATHS
        b, batch = _Batch(table, window), table.column("batch")[0].as_py()
        keys, flags = _answers(answers, "keys"), _answers(answers, "flags")
        ranges = sorted(keys)
        known = np.concatenate([_unpack_sorted(keys[r]) for r in ranges])
        flag = np.concatenate([np.frombuffer(flags[r], np.uint8) for r in ranges])
        at = np.minimum(np.searchsorted(known, b.edge), len(known) - 1)
        many = known[at] == b.edge
        place = np.flatnonzero(many)
        flag = flag[at[place]]
        # a place goes on with the next one if neither side of their link branches
        joined = (place[1:] == place[:-1] + 1) & (b.doc[place[1:]] == b.doc[place[:-1]]) \
            & (flag[:-1] & 2 > 0) & (flag[1:] & 1 > 0)
        first = np.flatnonzero(np.concatenate(([True], ~joined)))
        length = np.diff(np.append(first, len(place)))
        found: dict[tuple[int, int, bytes], list[tuple[int, int]]] = {}
        for p, n in zip(place[first].tolist(), length.tolist()):
            d, s = int(b.doc[p]), int(b.start[p])
            digest = xxhash.xxh3_128_digest(b" ".join(b.docs[d][s:s + n + window - 1]))
            found.setdefault((int(b.edge[p].view(np.int64)), n, digest), []).append((d, s))
        places = [[{"id": b.ids[d], "text_key": b.keys[d], "start": s} for d, s in v] for v in found.values()]
        path, n, digest = zip(*found)
        return pa.table({"batch": pa.array([batch] * len(path), pa.int32()), "path": pa.array(path, pa.int64()),
                         "edges": pa.array(n, pa.int32()), "digest": pa.array(digest, pa.binary()),
                         "places": pa.array(places, _PLACES)})

    _PLACES = pa.list_(pa.struct([("id", _arrow(docs, "id")), ("text_key", pa.int64()), ("start", pa.int32())]))
    _EMPTY_LINKS = pa.table({"range": pa.array([], pa.int32()), "batch": pa.array([], pa.int32()),
                             **{c: pa.array([], pa.binary()) for c in ("keys", "before", "after")}})
    _EMPTY_PATHS = pa.table({"batch": pa.array([], pa.int32()), "path": pa.array([], pa.int64()),
                             "edges": pa.array([], pa.int32()), "digest": pa.array([], pa.binary()),
                             "places": pa.array([], _PLACES)})

    batches = docs.groupBy("batch")
    edges = batches.applyInArrow(ask_edges, "range int, batch int, keys binary, twice binary") \
        .groupBy("range").applyInArrow(answer_edges, "batch int, range int, bits binary")
    links = batches.cogroup(edges.groupBy("batch")).applyInArrow(
        ask_links, "range int, batch int, keys binary, before binary, after binary") \
        .groupBy("range").applyInArrow(answer_links, "batch int, range int, keys binary, flags binary")
    paths = batches.cogroup(links.groupBy("batch")).applyInArrow(
        compact, "batch int, path long, edges int, digest binary, "
                 f"places array<struct<id:{id_type},text_key:bigint,start:int>>")
    # a row per batch that has the path: no hot group, however many places there are
    own = W.partitionBy("path", "edges", "digest")
    return paths.withColumn("n", F.sum(F.size("places")).over(own)).where("n > 1").drop("n")


def _arrow(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Documents with their batch, the number of batches and of ranges."""
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_batches = max(1, -(-size // BATCH_BYTES))
    n_ranges = max(1, -(-size // (RANGE_EDGES * WORD_BYTES)))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    batch = F.pmod(F.xxhash64("id", "text_key"), F.lit(n_batches)).cast("int")
    return d.withColumn("batch", batch), n_batches, n_ranges


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text): ``text`` is the words kept, joined by
    one space."""
    d, n_batches, n_ranges = _dealt(docs, id_col, text_col)
    paths = repeated_passages(d, n_batches, n_ranges, window).select("batch", "edges", "places")

    def remove(table, paths):
        b = _Batch(table, window, hashed=False)
        cover: dict[tuple, list[tuple[int, int]]] = {}
        for n, places in zip(paths.column("edges").to_pylist(), paths.column("places").to_pylist()):
            for p in places:
                cover.setdefault((p["id"], p["text_key"]), []).append((p["start"], p["start"] + n + window - 1))
        n_words, n_removed, kept = [], [], []
        for i, key, words in zip(b.ids, b.keys, b.docs):
            total = len(words)
            if spans := cover.get((i, key)):
                out, end = [], 0
                for s, e in sorted(spans):
                    if s > end:
                        out += words[end:s]
                    end = max(end, e)
                words = out + words[end:]
            n_words.append(total)
            n_removed.append(total - len(words))
            kept.append(b" ".join(words))
        return pa.table({id_col: table.column("id"), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "text": pa.array(kept, pa.binary()).cast(pa.string())})

    id_type = d.schema["id"].dataType.simpleString()
    return d.groupBy("batch").cogroup(paths.groupBy("batch")).applyInArrow(
        remove, f"`{id_col}` {id_type}, n_words long, n_removed long, text string")
