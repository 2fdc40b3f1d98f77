"""Quality rules by distribution divergence.

A document's character-class histogram and its common-word histogram are held
against its language's reference, the same histograms summed over all documents
of that language, by Jensen-Shannon distance (base 2, 0 to 1).  Minimum lengths
guard both: a histogram of too few characters or words says nothing, and a
language without a word list has no reference; then that distance is null and
passes.

Main path: DataFrame functions only.  Words, windows and lines are arrays of a
row; nothing is exploded, and the reference is one pre-aggregated row for each
of the ``COMMON_WORDS`` languages.

Defined cases: null or empty texts have no words, fail the base rule and have
null distances; null or unknown languages are judged by the base rule alone;
repeated rows count each time in the reference and are judged alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockfair.llm.common import stored, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Least code points and words for the two distances to count.
MIN_CHARS_JS, MIN_WORDS_JS = 200, 100
#: Largest distances of a document that is kept.
MAX_CHAR_JS, MAX_WORD_JS = 0.36, 0.27

#: fixed values: very common words per language
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "on", "are", "this", "be"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con"),
}
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punct", "wide")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Base measures and histograms per row: (id, lang, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, chars, common); ``chars`` counts
    code points by ``CLASSES``, ``common`` the language's words and, last, all
    other words."""
    lists = F.create_map(*[x for lang, ws in COMMON_WORDS.items()
                           for x in (F.lit(lang), F.array(*map(F.lit, ws)))])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col), F.col(lang_col).cast("string").alias("lang"), text.alias("t"),
                    words_of(text).alias("w"), lists[F.col(lang_col).cast("string")].alias("list"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))
    grams = F.sort_array(F.transform(starts, lambda w, i: F.struct(
        F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))
    d = d.select(id_col, "lang", "t", "list", F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 lines.alias("lines"), grams.alias("g"),
                 F.when(F.col("list").isNotNull(),
                        F.filter("w", lambda w: F.array_contains("list", w))).alias("hits"))
    again = F.filter("g", lambda x, k: (F.get("g", k - 1)["h"] == x["h"])
                     | F.coalesce(F.get("g", k + 1)["h"] == x["h"], F.lit(False)))
    symbols, wide = F.regexp_count("t", F.lit(r"[#*$%&|<>]")), F.regexp_count("t", F.lit(r"[^\x00-\x7F]"))
    ascii_punct = F.regexp_count("t", F.lit(r"[!-/:-@\[-`{-~]"))
    d = d.select(id_col, "lang", "n_words", "word_chars", "list", "hits",
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.sort_array(F.transform(again, lambda x: x["i"])).alias("at"),
                 F.length("t").cast("long").alias("n"), symbols.cast("long").alias("n_symbols"),
                 wide.cast("long").alias("wide"), ascii_punct.cast("long").alias("ascii_punct"),
                 F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("upper"),
                 F.regexp_count("t", F.lit("[0-9]")).cast("long").alias("digit"))
    # a repeated window covers three words, fewer where the next one begins earlier
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    n = {"space": F.col("n") - F.col("word_chars"), "symbol": F.col("n_symbols"),
         "punct": F.col("ascii_punct") - F.col("n_symbols")}
    n |= {k: F.col(k) for k in ("upper", "digit", "wide")}
    n["lower"] = F.col("n") - sum(n.values(), F.lit(0).cast("long"))
    common = F.concat(
        F.transform("list", lambda c: F.size(F.filter("hits", lambda h: h == c)).cast("long")),
        F.array(F.col("n_words") - F.size("hits")))
    return d.select(id_col, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    covered.alias("n_repeat_words"),
                    F.array(*[n[c] for c in CLASSES]).alias("chars"), common.alias("common"))


def references(measured: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common): histograms summed over all documents of
    each language that has a word list, so at most one row per list."""
    size = {"chars": len(CLASSES), "common": max(map(len, COMMON_WORDS.values())) + 1}
    sums = [F.sum(F.get(c, F.lit(k))).alias(f"{c}_{k}") for c, n in size.items() for k in range(n)]
    return measured.where(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*sums).select(
        "lang", *[F.array(*[F.col(f"{c}_{k}") for k in range(n)]).alias(f"ref_{c}")
                  for c, n in size.items()])


def js_distance(p: str, q: str, size: int) -> Column:
    """Jensen-Shannon distance (base 2) of two histogram columns of ``size``
    counts; null where either is empty."""
    total_p = sum((F.get(p, F.lit(k)) for k in range(size)), F.lit(0).cast("long"))
    total_q = sum((F.get(q, F.lit(k)) for k in range(size)), F.lit(0).cast("long"))
    out = F.lit(0.0)
    for k in range(size):
        a = F.get(p, F.lit(k)).cast("double") / total_p
        b = F.get(q, F.lit(k)).cast("double") / total_q
        mean = (a + b) / 2
        out = out + F.when(a > 0, a * F.log2(a / mean)).otherwise(0.0) / 2 \
            + F.when(b > 0, b * F.log2(b / mean)).otherwise(0.0) / 2
    return F.when((total_p > 0) & (total_q > 0), F.sqrt(F.greatest(out, F.lit(0.0))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """Measures, distances and verdicts per row of ``docs``."""
    m = stored(measures(docs, id_col, text_col, lang_col))
    both = m.join(F.broadcast(references(m)), "lang", "left")  # a row per word list
    size = max(map(len, COMMON_WORDS.values())) + 1
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    both = both.withColumns({
        "char_js": F.when(n_chars >= MIN_CHARS_JS, js_distance("chars", "ref_chars", len(CLASSES))),
        "word_js": F.when(F.col("n_words") >= MIN_WORDS_JS, js_distance("common", "ref_common", size)),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))})
    near = (F.coalesce(F.col("char_js"), F.lit(0.0)) <= MAX_CHAR_JS) \
        & (F.coalesce(F.col("word_js"), F.lit(0.0)) <= MAX_WORD_JS)
    return both.withColumn("kept", ~F.col("base_failed") & near).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_js", "word_js")
