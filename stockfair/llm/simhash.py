"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a
small Hamming distance, grouped by reachability.

Candidates come from the pigeonring principle.  A fingerprint is a ring of
``max_bits + 1`` segments; two fingerprints within ``max_bits`` bits have some
segment from which every chain of consecutive segments keeps its cumulative
difference within its proportional share of the budget: with four segments and
three bits 0, 1, 2, 3.  The join key is the chain of length two: the first
segment as it is, the second with up to its one allowed bit flipped on the
probing side.  So candidates per fingerprint grow with N / 2^32 and no bucket
holds all fingerprints that share 16 bits.  Longer chains are checked in the
join condition, the full Hamming distance last.

Equal fingerprints meet in one class row before the join, so copies are never
expanded into pairs; links exist between different fingerprints only.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; a text of fewer words than a shingle is one shingle; ids may repeat
or be null (a class of nulls only has a null component); an empty table gives
an empty result; only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockfair.llm.common import connected_components, stored

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 15


def _fingerprint(raw: bytes | None, width: int) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = raw.lower().split() if raw else []  # bytes: A-Z and ASCII spaces only
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for k in range(0, n, AT_ONCE):
        m = min(n, k + AT_ONCE)
        first, last = starts[k:m].tolist(), ends[min(k + width, len(words)) - 1:][:m - k].tolist()
        h = np.fromiter([digest(text[a:b], SEED) for a, b in zip(first, last)], np.uint64, m - k)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    value = int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS, text_hash: Column | None = None) -> DataFrame:
    """(id, fp long) per row, and ``text_hash`` as hash where given."""
    more = [] if text_hash is None else [text_hash.alias("hash")]

    def run(batches):
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            fp = pa.array([_fingerprint(r.as_py(), width) for r in raw], pa.int64())
            yield pa.record_batch([b.column(0), fp, *b.columns[2:]], names=[id_col, "fp", "hash"][:b.num_columns])

    cols = docs.select(F.col(id_col), F.col(text_col).cast("string"), *more)
    kind = cols.schema[0].dataType.simpleString()
    return cols.mapInArrow(run, f"`{id_col}` {kind}, fp long" + (", hash long" if more else ""))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: distinct values of ``fp`` that differ in 1 to
    ``max_bits`` bits.  ``fps`` has one row per value."""
    m = max_bits + 1
    if not 1 <= max_bits <= 7:
        raise ValueError("max_bits from 1 to 7")
    # borders of the ring's segments, as even as 64 bits allow
    border = [64 * k // m for k in range(m + 1)]
    width = [border[k + 1] - border[k] for k in range(m)]

    def segment(fp, i):
        i %= m
        mask = (1 << width[i]) - 1
        return F.shiftrightunsigned(fp, border[i]).bitwiseAND(F.lit(mask))

    fp = F.col("fp")
    spare = 2 * max_bits // m  # bits in which a chain of two may differ: 0 or 1
    flips = {i: [0] + ([1 << k for k in range(width[i])] if spare else []) for i in range(m)}

    def with_flip(i, head, tail):
        return lambda x: F.struct(F.lit(i).alias("seg"),
                                  head.bitwiseOR(tail.bitwiseXOR(x)).alias("key"))

    def keys(side, flip):
        per = []
        for i in range(m):
            j = (i + 1) % m
            head = F.shiftleft(segment(fp, i), width[j])
            near = F.array(*[F.lit(x).cast("long") for x in (flips[j] if flip else [0])])
            per.append(F.transform(near, with_flip(i, head, segment(fp, j))))
        return fps.select(fp.alias(side), F.explode(F.concat(*per)).alias("k")) \
            .select(side, "k.seg", "k.key")

    probe, index = keys("a", True), keys("b", False)
    diff = F.col("a").bitwiseXOR(F.col("b"))
    within = F.bit_count(diff) <= max_bits
    for i in range(m):
        for length in range(3, m):  # chains of one and two hold by the key
            chain = sum((F.bit_count(segment(diff, i + k)) for k in range(1, length)),
                        F.bit_count(segment(diff, i)))
            within &= (F.col("seg") != i) | (chain <= length * max_bits // m)
    return probe.join(index, ["seg", "key"]).where((F.col("a") < F.col("b")) & within) \
        .select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, fingerprint, component_id): component_id is the smallest id
    reachable through links, the row's own included."""
    fps = stored(fingerprints(docs, id_col, text_col, width))
    classes = _classes(fps, F.min(id_col), max_bits).withColumnRenamed("low", "component_id")
    return fps.join(classes, "fp").select(
        id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _classes(fps: DataFrame, least: Column, max_bits: int) -> DataFrame:
    """(fp, low) per fingerprint: the minimum ``least`` over its component."""
    classes = stored(fps.groupBy("fp").agg(least.alias("low")))
    roots = stored(connected_components(links(classes.select("fp"), max_bits)))
    named = roots.join(classes, roots.node == classes.fp) \
        .groupBy("root").agg(F.min("low").alias("component_low"))
    linked = roots.join(named, "root").select(F.col("node").alias("fp"), "component_low")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("component_low", "low").alias("low"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per component: the smallest (id, hash of the text),
    null ids last.  Of rows equal in both any one stays."""
    text = F.xxhash64(F.col(text_col).cast("string"))
    fps = stored(fingerprints(docs, id_col, text_col, width, text))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("hash"))
    marked = fps.join(_classes(fps, F.min(key), max_bits), "fp") \
        .groupBy(F.col(id_col).alias("__llm_id"), F.col("hash").alias("__llm_hash")) \
        .agg(F.first(key == F.col("low")).alias("own"), F.count("*").alias("n"))
    marked = stored(marked.where("not own or n > 1"))
    here = F.col(id_col).eqNullSafe(F.col("__llm_id")) & (text == F.col("__llm_hash"))
    out = docs.join(marked.select("__llm_id", "__llm_hash"), here, "left_anti")
    again = marked.where("own").select("__llm_id", "__llm_hash")
    if again.isEmpty():
        return out
    # repeated rows of the one that stays
    twice = docs.join(again, here, "left_semi").withColumn("__llm_hash", text) \
        .dropDuplicates([id_col, "__llm_hash"])
    return out.unionByName(twice.drop("__llm_hash"))
