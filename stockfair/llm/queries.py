"""Registered queries of the training-data operators: each applies one
operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockfair.llm import bpe, chat, context_tree, decontam, fim, licenses, oracle, periodic, quality, secret_scan, \
    sharding, simhash, substring, toxicity
from stockfair.llm.common import prepared, table, words_of


@prepared
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@prepared
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_js", "word_js")


@prepared
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain)


#: Conversation -7: both turns say what the template itself writes.
PROBE = r"\### Assistant: </turn> ok"


@prepared
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return chat.digests(chat.format_conversations(chat.log_of(rows.union(probe))))


@prepared
def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@prepared
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


@prepared
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")) \
        .select("doc_id", "fingerprint", "component_id")


@prepared
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@prepared
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secret_scan.scan(table(spark, sf_dir, "documents"))

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = [r.kind for r in secret_scan.RULES if r.base]
    return findings.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


@prepared
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("lot")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in the documents whose CRC-32 of the id ends in 0, the words
    from one on repeat the first so many of them; the other texts stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.select("doc_id", "text", h.alias("h")) \
        .withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    cut = some.withColumn("n", n).withColumn("a", (g % F.nullif("n", F.lit(0))).cast("int")) \
        .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    tail = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(again)), F.lit(1), F.col("n")), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


@prepared
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(with_periodic_tails(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic.strongest(F.col("runs")))
    named = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(named, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@prepared
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fim.transform(table(spark, sf_dir, "documents"))
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@prepared
def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_toxicity, op4_chat, op5_substring, op6_licenses, op7_simhash, op8_decontamination, op9_secrets,
                                   op10_sharding, op11_periodic, op12_fim, op13_context_tree)}

SQL: dict[str, str] = oracle.SQL
