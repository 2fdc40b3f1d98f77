"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockfair.session import ensure_checkpoint_dir, ship_package

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java class.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(fn):
    """Ship the package to the Python workers before a query is planned."""
    @functools.wraps(fn)
    def run(spark, *args, **kw):
        ship_package(spark)
        return fn(spark, *args, **kw)
    return run


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back:
    lineage is cut, lost executors cost nothing that is already written, and
    later reads prune columns.  The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none), as an array."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII texts take the byte-wise
    ``lower``; others, where ``lower`` would fold more, go by code point."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)) \
        .otherwise(F.translate(text, upper, low))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest
    node reachable.  Large-star and small-star rounds, each an aggregate and a
    join, until the edge set stops changing; every round is written to the
    checkpoint folder.  Only the edge count and one checksum reach the driver."""
    cur = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
        .where("a <> b").distinct()
    cur = stored(cur)
    last = None
    while True:
        both = cur.union(cur.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(low, "a") \
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(low.select("a", "m").toDF("a", "b")).distinct()
        cur = stored(small)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").toDF("node", "root").distinct())
