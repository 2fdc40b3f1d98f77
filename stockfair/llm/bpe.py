"""Byte-level BPE encoding and decoding of whole texts.

A word (the pre-tokenizer's piece) is held as a contiguous array of parts with
the ranks of adjacent pairs beside it: the smallest rank is found by a scan,
its right boundary is deleted and the two neighbouring ranks are refreshed,
until no pair has a rank.  Words repeat a lot, so each Python worker keeps a
bounded table of stretches of text already encoded: their places in one flat array of
ids.  Ids, their decimal digits and their bytes are gathered from flat arrays, and rows
are read and given a few at a time, so a worker's memory is that of a batch and some
``CHARS_AT_ONCE`` characters, or of one text.

Defined cases: null text = empty text = no ids; texts of any length are encoded
whole; a word above ``SCAN_LIMIT`` bytes takes the same merges in the same
order from a heap, since scans would grow with the square of its length;
repeated rows give repeated rows; an empty table gives an empty table; columns
of the input other than the id and the text are not carried over.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a word up to which the smallest rank is found by a scan.
SCAN_LIMIT = 400
#: Bytes of a word up to which words of one length are merged side by side.
ROW_LIMIT = 40
#: Characters of text whose new stretches are merged side by side.
CHARS_AT_ONCE = 700_000
#: Stretches of text (a word with what touches it) kept by each Python worker,
#: and the longest that is kept.
CACHE_RUNS = 80_000
CACHE_CHARS = 48
NO_RANK = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others take code points
    from 256 on, in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Flat:
    """Sequences of one type behind each other in one array."""

    def __init__(self, parts: list[bytes], dtype=np.uint8):
        self.values = np.frombuffer(b"".join(parts), dtype)
        self._at(np.fromiter(map(len, parts), np.int64, len(parts)))

    def _at(self, sizes: np.ndarray):
        self.sizes = sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, values: np.ndarray, sizes: np.ndarray) -> Flat:
        out = cls([], values.dtype)
        out.values = values
        out._at(sizes)
        return out

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.values[self.starts[k]:self.starts[k] + self.sizes[k]]

    def take(self, at: np.ndarray) -> np.ndarray:
        """The sequences numbered ``at``, one after the other."""
        sizes = self.sizes[at]
        return self.values[np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def plus(self, other: Flat) -> Flat:
        return Flat.of(np.concatenate([self.values, other.values]), np.concatenate([self.sizes, other.sizes]))


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE, JSON)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") \
                or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or need word borders are not supported")
        vocab: dict[str, int] = model["vocab"]
        byte_of = {c: b for b, c in _byte_alphabet().items()}
        #: fixed value: the byte-level pre-tokenizer's pattern
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.byte_ids = [vocab[c] for c in _byte_alphabet().values()]
        order = list(_byte_alphabet())
        self.byte_ids = [i for _, i in sorted(zip(order, self.byte_ids))]
        keys, made = np.empty(len(model["merges"]), np.int64), np.empty(len(model["merges"]), np.int64)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys[rank], made[rank] = vocab[a] << 32 | vocab[b], vocab[a + b]
        #: pairs (first id, second id), as one int, with the first rank of each; rank to the new id
        self.pair_keys, self.pair_ranks = np.unique(keys, return_index=True)
        self.made_array, self.byte_array = made, np.array(self.byte_ids)
        both = np.repeat(self.byte_array, 256), np.tile(self.byte_array, 256)
        self.byte_ranks = self._ranks(*both).reshape(256, 256)
        bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        for t in added:
            # the byte-level decoder maps characters of its alphabet back to bytes
            s = t["content"]
            bytes_of[t["id"]] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.known = np.zeros(max(bytes_of) + 1, bool)
        self.known[list(bytes_of)] = True
        self.bytes_of = Flat([bytes_of.get(i, b"") for i in range(len(self.known))])
        #: decimal digits and a comma
        self.names = Flat([b"%d," % i for i in range(len(self.known))])
        self.special = {t["content"]: t["id"] for t in added}
        # the file's own objects go before the lasting ones are made
        del spec, model, vocab, bytes_of
        self.rank_of: dict[int, int] = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        self.made: list[int] = made.tolist()
        #: a space that touches white space or an end of the text
        self.loose = re.compile(r"^ |\s |\s$| \s")
        self.split_special = regex.compile(
            "(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")") \
            if self.special else None
        #: stretches kept, their numbers in ``kept``
        self.cache: dict[str | int, int] = {}
        self.kept = Flat([], np.int32)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        own = self.byte_ids
        ids = [own[b] for b in word]
        if len(ids) > SCAN_LIMIT:
            return self._merge_long(ids)
        get, made = self.rank_of.get, self.made
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            k = ranks.index(low)
            new = ids[k] = made[low]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(new << 32 | ids[k + 1], NO_RANK)
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | new, NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """As ``merge`` for long words: parts in a linked list, pairs in a heap
        by (rank, place), entries that no longer hold skipped."""
        n, get, made = len(ids), self.rank_of.get, self.made
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            new = ids[i] = made[rank]
            ids[j] = -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := get(new << 32 | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := get(ids[p] << 32 | new)) is not None:
                heapq.heappush(heap, (r, p, ids[p], new))
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO_RANK where a pair has none."""
        want = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == want, self.pair_ranks[at], NO_RANK)

    def merge_many(self, words: list[bytes | int]) -> Flat:
        """``merge`` of many words, in their order.  Words of one length are the rows of a
        matrix of parts with a matrix of adjacent ranks; a step scans each row
        for its smallest rank, deletes that boundary and refreshes the ranks
        beside it, so all rows that go on have the same width."""
        done: list[tuple[np.ndarray, np.ndarray]] = []     # numbers of words, a row of ids each
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if isinstance(w, int):                          # a special token
                done.append((np.array([i]), np.array([[w]], np.int32)))
            else:
                by_len.setdefault(len(w), []).append(i)
        for size, at in by_len.items():
            if size > ROW_LIMIT or len(at) < 8:
                done += [(np.array([i]), np.array([self.merge(words[i])], np.int32)) for i in at]
                continue
            raw = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, size)
            parts, ranks = self.byte_array[raw], self.byte_ranks[raw[:, :-1], raw[:, 1:]]
            rows = np.array(at)
            while len(rows):
                n, w = parts.shape
                if w > 1:
                    k = ranks.argmin(1)
                    each = np.arange(n)
                    low = ranks[each, k]
                    go = low < NO_RANK
                else:
                    go = np.zeros(n, bool)
                if not go.all():
                    done.append((rows[~go], parts[~go].astype(np.int32)))
                    if not go.any():
                        break
                    rows, parts, ranks, k, low = rows[go], parts[go], ranks[go], k[go], low[go]
                    each = np.arange(len(rows))
                col = np.arange(w - 1)
                parts = np.take_along_axis(parts, col + (col > k[:, None]), 1)
                parts[each, k] = self.made_array[low]
                col = np.arange(w - 2)
                ranks = np.take_along_axis(ranks, col + (col >= k[:, None]), 1)
                if w > 2:
                    r = each[k > 0]
                    ranks[r, k[r] - 1] = self._ranks(parts[r, k[r] - 1], parts[r, k[r]])
                    r = each[k < w - 2]
                    ranks[r, k[r]] = self._ranks(parts[r, k[r]], parts[r, k[r] + 1])
        sizes = np.zeros(len(words), np.int64)
        for at, ids in done:
            sizes[at] = ids.shape[1]
        out = Flat.of(np.empty(sizes.sum(), np.int32), sizes)
        for at, ids in done:
            out.values[out.starts[at][:, None] + np.arange(ids.shape[1])] = ids
        return out

    def learn(self, runs: list[str | int]) -> Flat:
        """Ids of stretches of text that start and end where words do (and of special
        tokens, given as ids)."""
        number: dict[str | int, int] = {}
        which, sizes, find = [], [], self.pattern.findall
        for r in runs:
            if isinstance(r, int) or r.isascii() and (r[1:] if r[0] == " " else r).isalpha():
                which.append(number.setdefault(r, len(number)))     # one word
                sizes.append(1)
            else:
                ws = find(r)
                which += [number.setdefault(w, len(number)) for w in ws]
                sizes.append(len(ws))
        ids = self.merge_many([w if isinstance(w, int) else w.encode("utf-8", "surrogatepass") for w in number])
        which, sizes = np.array(which, np.int64), np.array(sizes, np.int64)
        ends = np.concatenate([[0], np.cumsum(ids.sizes[which])])
        last = np.cumsum(sizes)
        return Flat.of(ids.take(which), ends[last] - ends[last - sizes])

    def _keep(self, runs: list[str | int], ids: Flat):
        """Keeps short stretches while there is room."""
        room = CACHE_RUNS - len(self.cache)
        if room <= 0:
            return
        some = [k for k, r in enumerate(runs) if isinstance(r, int) or len(r) <= CACHE_CHARS][:room]
        at = np.array(some, np.int64)
        self.cache.update(zip([runs[k] for k in some], range(len(self.kept), len(self.kept) + len(some))))
        self.kept = self.kept.plus(Flat.of(ids.take(at), ids.sizes[at]))

    def runs(self, text: str) -> list[str]:
        """Cut a text without special tokens into stretches.  A word begins at
        every space between two characters that aren't white space."""
        if not text:
            return []
        parts = text.split(" ")
        if self.loose.search(text) is None:
            return [parts[0], *[" " + p for p in parts[1:]]]
        cut, last = [], parts[0]
        for p in parts[1:]:
            if last and p and not last[-1].isspace() and not p[0].isspace():
                cut.append(last)
                last = " " + p
            else:
                last = last + " " + p
        cut.append(last)
        return cut

    def _cut(self, text: str) -> list[str | int]:
        """Stretches of a text, and ids where special tokens stand."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.runs(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            i = self.special.get(part)
            out += self.runs(part) if i is None else [i]
        return out

    def encode_many(self, texts: list[str]) -> Flat:
        """Ids of each text; stretches that aren't kept yet are merged side by side."""
        cut = [self._cut(t) for t in texts]
        runs = list(chain.from_iterable(cut))
        at = list(map(self.cache.get, runs))
        table = self.kept
        if None in at:
            new = list(dict.fromkeys([r for r, k in zip(runs, at) if k is None]))
            ids = self.learn(new)
            of_new = dict(zip(new, range(len(table), len(table) + len(new))))
            at = [of_new[r] if k is None else k for r, k in zip(runs, at)]
            table = table.plus(ids)
            self._keep(new, ids)
        at = np.array(at, np.int64)
        ends = np.concatenate([[0], np.cumsum(table.sizes[at])])
        last = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return Flat.of(table.take(at), np.diff(ends[last], prepend=0))

    def pieces(self, texts: list[str]) -> list[list[tuple[str, list[int]]]]:
        """Of each text, one pair (decimal ids joined by commas, ids)."""
        many = self.encode_many(texts)
        return [[(self.digits(ids).decode(), ids.tolist())] for ids in map(many.__getitem__, range(len(many)))]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text or ""])[0].tolist()

    def digits(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.names.take(ids).tobytes()[:-1]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise KeyError("an id that the tokenizer does not have")
        return self.bytes_of.take(ids).tobytes().decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of consecutive rows, about ``CHARS_AT_ONCE`` bytes or one text at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        n = max(int(np.searchsorted(sizes, before + CHARS_AT_ONCE, "right")) - at, 1)
        part = batch.slice(at, n)
        yield part.column(0), [t or "" for t in part.column(1).to_pylist()]
        at += n


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
           text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """(id, ids array<int>) per row of ``docs``."""
    def run(batches):
        c = codec(path or default_path())
        for b in batches:
            for some, texts in _by_size(b):
                many = c.encode_many(texts)
                ends = np.concatenate([[0], np.cumsum(many.sizes)]).astype(np.int32)
                yield pa.record_batch([some, pa.ListArray.from_arrays(ends, pa.array(many.values, pa.int32()))],
                                      names=[id_col, out_col])

    cols = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = cols.schema[0].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id",
           ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """(id, text) per row of ``encoded``; null ids decode to empty text."""
    def run(batches):
        c = codec(path or default_path())
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(
                [c.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())],
                names=[id_col, out_col])

    cols = encoded.select(F.col(id_col), F.col(ids_col))
    kind = cols.schema[0].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again in one pass: (id, n_tokens,
    ids_sha256, decoded_sha256, exact).  ``exact`` tells whether the decoded
    text is the input."""
    def run(batches):
        c = codec(path or default_path())
        sha = hashlib.sha256
        for b in batches:
            for some, texts in _by_size(b):
                many = c.encode_many(texts)
                ids_hex, text_hex, same = [], [], []
                for k, t in enumerate(texts):
                    ids = many[k]
                    back = c.decode(ids)
                    ids_hex.append(sha(c.digits(ids)).hexdigest())
                    text_hex.append(sha(back.encode("utf-8", "surrogatepass")).hexdigest())
                    same.append(back == t)
                yield pa.record_batch(
                    [some, pa.array(many.sizes, pa.int64()), pa.array(ids_hex, pa.string()),
                     pa.array(text_hex, pa.string()), pa.array(same, pa.bool_())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    cols = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = cols.schema[0].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, "
                                "decoded_sha256 string, exact boolean")
