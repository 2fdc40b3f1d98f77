"""The pipeline against a brute-force run of its own decisions."""


import corpus_pipeline
import pytest
from odd import docs, texts, words
from test_operators import brute_components, brute_fingerprint, brute_hits, brute_secrets


@pytest.fixture
def tables(spark, tmp_path):
    import random

    rng = random.Random(2)
    t = texts(n=60)
    t += [f"you idiot {w} moron {' '.join(words(rng, 40, 3000))}" for w in "abcdefghijklmnopqrst"]
    item = " ".join(words(rng, 25, 3000))
    t += [f"{' '.join(words(rng, 30, 3000))} {item} end", f"password = {'x' * 12} and {'0f' * 20} end"]
    d = docs(spark, t)
    d.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    y = [(i, 1, int("idiot" in (s or ""))) for i, s in enumerate(t)]
    spark.createDataFrame(y, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), t, item


def test_stages_keep_the_columns(spark, tables):
    path, t, _ = tables
    d = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "decontamination", "secrets", "bpe"]
    out = d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, path)
        assert out.columns == d.columns and dict(out.dtypes) == dict(d.dtypes)


def test_pipeline_equals_brute_force(spark, tables):
    from stockfair.llm import bpe

    path, t, item = tables
    rest = {i: s for i, s in enumerate(t) if "idiot" not in (s or "")}
    parts = brute_components({i: brute_fingerprint(s) for i, s in rest.items()})
    rest = {i: s for i, s in rest.items() if parts[i] == i}
    hits = dict(zip(rest, brute_hits(rest.values(), [(1, item)])))
    rest = {i: s for i, s in rest.items() if not hits[i][3]}
    want, codec = {}, bpe.Codec(bpe.default_path())
    for i, s in rest.items():
        out, end = "", 0
        for a, _, _, z in brute_secrets(s):
            if a >= end:
                out += s[end:a] + "[SECRET]"
            end = max(end, z)
        want[i] = codec.encode(out + (s or "")[end:])
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, path).collect()}
    assert got == want


def test_empty_tables(spark, tables, tmp_path):
    path, _, _ = tables
    d = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, path).count() == 0


def test_few_labels_drop_few_documents(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.reject_toxic(spark, d, sf)
    assert kept.count() >= 0.7 * d.count()
    assert kept.join(labels.where("toxic = 0"), "doc_id").count() >= labels.where("toxic = 0").count() - 1
    assert corpus_pipeline.run(spark, sf).count() > 0
