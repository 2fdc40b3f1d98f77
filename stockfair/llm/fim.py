"""Fill-in-middle transformation: a text is cut at two unit borders into
prefix, middle and suffix and rearranged behind the marks ``<P>``, ``<S>``, ``<M>``.

A unit is white space with the word after it, or white space at the end:
``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``.  Borders are found
in words of 64 bits: the UTF-8 of an Arrow batch is viewed as uint64, the bytes
that end a unit are marked in all eight lanes arithmetically, ``bitwise_count``
gives the marks of each word, a binary search in their running sum finds the word
of the k-th mark, and the mark is resolved inside it by clearing lower ones.  No
text is split, and both borders of all texts of a lot (``BYTES_AT_ONCE``, or one text)
are found at once.

Hashing, rearranging and rebuilding are column functions of Spark; one
``mapInArrow`` over the scan finds the borders, nothing is shuffled.

Defined cases: a null text is empty, an empty text is plain with n = 0; a text that
holds a mark is plain; a null id hashes as the empty string; repeated rows give
their rows each; a very long text is a lot of its own, ten times its bytes in memory; columns
other than id and text play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks, seed and shares of 100.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FORMED, SUFFIX_FIRST = 42, 50, 80

#: Bytes of text worked on at once.
BYTES_AT_ONCE = 2 << 20

_LANES = 0x0101010101010101
_HIGH, _LOW7 = np.uint64(0x80 * _LANES), np.uint64(0x7F * _LANES)


def unit_marks(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 words of ``data`` (uint8) with 0x80 in every byte that ends a unit;
    ``ends`` are the last bytes of the texts in ``data``, each of which ends one."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[:len(data)] = data
    x = padded.view("<u8")
    low = x & _LOW7
    apart = (x ^ np.uint64(0x20 * _LANES))
    blank = ~(((apart & _LOW7) + _LOW7) | apart)            # 0x80 where the byte is 0x20
    control = (low + np.uint64((0x80 - 0x09) * _LANES)) & ~(low + np.uint64((0x80 - 0x0E) * _LANES)) & ~x
    space = (blank | control) & _HIGH
    after = space >> np.uint64(8)
    after[:-1] |= space[1:] << np.uint64(56)
    marks = ~space & after
    marks.view(np.uint8)[ends] = 0x80
    return marks


def select(marks: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Byte of the mark number ``rank`` (from 0); ``before`` has the number of
    marks up to the end of each word."""
    at = np.searchsorted(before, rank, side="right")
    word = marks[at]
    inside = rank - (before[at] - np.bitwise_count(word))
    for k in range(7):
        word = np.where(inside > k, word & (word - np.uint64(1)), word)
    lowest = word & (~word + np.uint64(1))
    return at * 8 + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """(units, first cut, second cut) of every text ``data[offsets[i]:offsets[i + 1]]``,
    cuts in bytes of the text: after h1 and h2 modulo units + 1 units, in order."""
    start, stop = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    marks = unit_marks(data, (stop - 1)[stop > start])
    before = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(byte):
        word, lanes = marks[byte >> 3], (8 * (byte & 7)).astype(np.uint64)
        below = word & ((np.uint64(1) << lanes) - np.uint64(1))
        return before[byte >> 3] - np.bitwise_count(word) + np.bitwise_count(below)

    first = rank(start)
    n = rank(stop) - first
    a, b = h1 % (n + 1), h2 % (n + 1)

    def byte_after(units):
        some = units > 0
        out = np.zeros(len(units), np.int64)
        out[some] = select(marks, before, (first + units - 1)[some]) + 1 - start[some]
        return out

    return n, byte_after(np.minimum(a, b)), byte_after(np.maximum(a, b))


def _lots(offsets: np.ndarray):
    """(first, last + 1) of consecutive texts of about ``BYTES_AT_ONCE``, or of one."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BYTES_AT_ONCE, side="right")) - 1)
        yield first, last
        first = last


def _borders(batches):
    for batch in batches:
        texts = batch.column("text")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        h1, h2 = batch.column("_h1").to_numpy(), batch.column("_h2").to_numpy()
        found = [cuts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], h1[lo:hi], h2[lo:hi])
                 for lo, hi in _lots(offsets)]
        n, a, b = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        yield pa.record_batch([batch.column(0), texts, pa.array(n), pa.array(a), pa.array(b)],
                              names=[batch.schema.names[0], "text", "n", "_a", "_b"])


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:id``, unsigned."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
              formed: int = FORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row: ``formed`` of 100
    texts are rearranged, ``suffix_first`` of 100 of those with the suffix first."""
    h = hashes(F.col(id_col), seed)
    cols = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       h[0].alias("_h1"), h[1].alias("_h2"))
    kind = cols.schema[0].dataType.simpleString()
    found = cols.mapInArrow(_borders, f"`{id_col}` {kind}, text string, n long, _a long, _b long")
    text, raw = F.col("text"), F.col("text").cast("binary")
    prefix = F.substring(raw, F.lit(1), F.col("_a").cast("int")).cast("string")
    middle = F.substring(raw, (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")).cast("string")
    suffix = F.substring(raw, (F.col("_b") + 1).cast("int"), F.octet_length(text)).cast("string")
    h = hashes(F.col(id_col), seed)
    plain = (text == "") | (h[2] % 100 >= formed)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | text.contains(mark)
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    parts = found.select(id_col, "n", text, form.alias("form"), prefix.alias("_p"), middle.alias("_m"), suffix.alias("_s"))
    as_is = F.col("form") == "plain"
    return parts.select(
        id_col, "n", "form", F.when(~as_is, F.length("_p")).cast("long").alias("prefix_chars"),
        F.when(~as_is, F.length("_m")).cast("long").alias("middle_chars"),
        F.when(as_is, text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "_p", F.lit(SUFFIX), "_s", F.lit(MIDDLE), "_m"))
        .otherwise(F.concat(F.lit(SUFFIX), "_s", F.lit(PREFIX), "_p", F.lit(MIDDLE), "_m")).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given.  Its parts hold no marks and marks
    start with ``<``, so the first place of each mark is its own."""
    def after(mark):
        return F.substring_index(output, mark, -1)

    def between(left, right):
        tail = output.substr(F.locate(left, output) + F.lit(len(left)), F.length(output))
        return F.substring_index(tail, right, 1)

    middle = after(MIDDLE)
    return F.when(form == "plain", output) \
        .when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))) \
        .otherwise(F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
