"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (``WINDOW`` consecutive words; a shorter item is one window)
are sets of word shingles.  A window is contained in a document only if all its
shingles are, so for containment the necessary prefix of its shingles, ordered
by rarity in the documents, is the rarest one alone.  Documents' shingles meet
the benchmark's shingles; their hits, counted, give the rarity; hits on a
window's prefix shingle give a place, bounded by the document's length and the
shingle's position in the window; the words at that place are compared last, so
hash collisions cannot pass.

Main path: DataFrame functions only.  The benchmark's distinct shingles are
broadcast up to ``BROADCAST_ROWS`` (counted first) and joined by a shuffle
beyond that.  Hot windows stay rows of single documents; nothing is paired.

Defined cases: null or empty texts have no words; items without words have no
windows; equal items each count; repeated document rows get equal results; ids
may be null; an empty benchmark leaves everything clean; an empty document
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockfair.llm.common import ascii_lower, stored

WINDOW = 10
SHINGLE = 3
#: Distinct benchmark shingles (one long each) up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
#: What separates words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    """array<struct<at, h>> of the shingles of ``width`` words."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.struct(
        i.alias("at"),
        F.xxhash64(F.lit(width), w, *[F.get(words, i + k) for k in range(1, width)]).alias("h")))


def _windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(window, words, items): distinct windows and the items that have them."""
    own = items.select(F.col(item_col).alias("item"), _words(F.col(text_col)).alias("w")) \
        .where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    own = own.select("item", "w", "len", F.explode(
        F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("s"))
    return own.select("item", F.slice("w", F.col("s"), F.col("len")).alias("words")) \
        .withColumn("window", F.array_join("words", " ")) \
        .groupBy("window").agg(F.first("words").alias("words"),
                               F.collect_set(F.col("item").cast("string")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_key, n_words, n_hit, n_items, items, spans, contaminated) per
    row of ``docs``; spans are the occurrences (start, len) in words, and
    (id, text_key) names a row (equal rows share it)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    windows = stored(_windows(benchmark, window, item_col, item_text_col)
                     .withColumn("width", F.least(F.size("words"), F.lit(shingle))))
    widths = sorted(r[0] for r in windows.select("width").distinct().collect())  # at most `shingle`
    parts = None
    for width in widths:
        w = windows.where(F.col("width") == width)
        w = w.select("window", "words", "items", F.explode(_shingles(F.col("words"), width)).alias("x"))
        w = w.select("window", F.size("words").alias("len"), "items", "x.at", "x.h")
        parts = w if parts is None else parts.unionByName(w)
    if parts is None:
        words = docs.withColumn("w", _words(F.col("text")))
        return words.select(F.col("id").alias(id_col), "text_key",
                            F.size("w").cast("long").alias("n_words"), *_verdict(F.array().cast(_FOUND)))
    parts = stored(parts)

    known = parts.select("h").distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    cut = docs.withColumn("w", _words(F.col("text")))
    places = F.concat(*[_shingles(F.col("w"), width) for width in widths])
    hits = cut.select("id", "text_key", F.size("w").alias("n"), F.explode(places).alias("x")) \
        .select("id", "text_key", "n", "x.at", "x.h")
    hits = stored(hits.join(known, "h"))

    # order a window's shingles by rarity; without a hit on each it cannot occur
    rarity = hits.groupBy("h").agg(F.count("*").alias("f"))
    prefix = parts.join(rarity, "h", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "h", "at")).alias("x"),
        F.first("len").alias("len"), F.first("items").alias("items"))
    prefix = prefix.where("x.f > 0").select("window", "len", "items", "x.h", F.col("x.at").alias("off"))

    start = F.col("at") - F.col("off")
    found = hits.join(prefix, "h").where((start >= 0) & (start + F.col("len") <= F.col("n"))) \
        .groupBy("id", "text_key") \
        .agg(F.collect_set(F.struct(start.alias("start"), "len", "window", "items")).alias("found"))

    both = docs.alias("d").join(
        found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id"))
        & (F.col("d.text_key") == F.col("f.text_key")), "left")
    both = both.select("d.id", "d.text_key", "found", _words(F.col("d.text")).alias("w"))
    sure = F.filter(F.coalesce("found", F.array().cast(_FOUND)), lambda x: F.array_join(
        F.slice(F.col("w"), x["start"] + 1, x["len"]), " ") == x["window"])
    both = both.select("id", "text_key", F.size("w").cast("long").alias("n_words"),
                       F.when(F.col("found").isNotNull(), sure)
                       .otherwise(F.array().cast(_FOUND)).alias("sure"))
    return both.select(F.col("id").alias(id_col), "text_key", "n_words", *_verdict(F.col("sure")))


_FOUND = "array<struct<start:int,len:int,window:string,items:array<string>>>"


def _verdict(sure: Column) -> list[Column]:
    spans = F.sort_array(F.array_distinct(F.transform(
        sure, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["len"]).alias("end")))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n")))
    items = F.sort_array(F.array_distinct(F.flatten(F.transform(sure, lambda x: x["items"]))))
    return [covered["n"].alias("n_hit"), F.size(items).cast("long").alias("n_items"),
            items.alias("items"), spans.alias("spans"), (F.size(sure) > 0).alias("contaminated")]


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
          text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, columns unchanged."""
    marked = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    bad = marked.where("contaminated").select(F.col(id_col).alias("__llm_id"), F.col("text_key").alias("__llm_key")) \
        .distinct()
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__llm_id")) & (key == F.col("__llm_key")), "left_anti")
