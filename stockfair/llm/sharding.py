"""Sharding by vector bin packing.

Items are groups of equal texts with a vector (bytes, tokens, rows); a shard's
capacity is an even share of each dimension's total.  A group goes to the shard
whose residual capacity has the highest dot product with the group's vector,
both in units of the shard's capacity.

Packing in one place would need every group there, so it runs on two levels:

* heavy groups, those above ``capacity / HEAVY_SHARE`` in some dimension, are
  cut into pieces of at most that much (a group that holds a third of all rows
  would fit no shard).  There are at most ``3 * shards * HEAVY_SHARE`` pieces
  by construction plus one remainder each; they are placed one by one on the
  driver, and the bound is checked;
* light groups are dealt by hash into lots of about ``LOT_ROWS`` rows; each lot
  has its share of the residual capacities that the heavy pieces leave, and is
  packed by one task, largest group first.  Lots depend on the data only, not
  on Spark's partitions, so the result does not change with them.

The law that holds is ``bytes``: sizes of shards are near equal; a lot's last
groups are its smallest, and where lots begin alternates over the shards.

Slots: rows of a shard are numbered by (lot, order in the lot); counts per lot
and shard give each lot's first slot, so no task numbers a whole shard.

Defined cases: null text counts as empty (size 1, CRC 0, one group with empty
texts); ids may be null or repeat, each row gets its own slot; an empty table
gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stockfair.llm.common import SPACES, stored

SHARDS = 8
#: A group above capacity / HEAVY_SHARE in some dimension is cut into pieces.
HEAVY_SHARE = 256
LOT_ROWS = 20_000
DIMENSIONS = ("bytes", "tokens", "rows")


def _pack(items: np.ndarray, residual: np.ndarray, turn: int = 0) -> list[int]:
    """Shards of ``items`` (n x 3, in placing order, in units of a shard's
    capacity); ``residual`` (shards x 3) is changed.  Ties go round from
    ``turn``."""
    n = len(residual)
    order = (np.arange(n) + turn) % n
    out = []
    for item in items:
        best = int(order[np.argmax(residual[order] @ item)])
        residual[best] -= item
        out.append(best)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, lot) per row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))
    rows = stored(docs.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
        tokens.cast("long").alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group")))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    n_rows = total[2] or 0
    capacity = np.maximum(np.array([t or 0 for t in total], float) / shards, 1.0)
    piece = capacity / HEAVY_SHARE
    lots = max(1, -(-n_rows // LOT_ROWS))

    # rows of one group have one size and one number of tokens
    groups = rows.groupBy("group").agg(
        F.first("size").alias("size"), F.first("tokens").alias("tokens"),
        F.count("*").alias("n")).withColumn(
        "lot", F.pmod(F.xxhash64("group"), F.lit(lots)).cast("int"))
    per_piece = F.greatest(F.lit(1), F.floor(F.least(
        F.lit(float(piece[0])) / F.col("size"), F.lit(float(piece[1])) / F.greatest(F.col("tokens"), F.lit(1)),
        F.lit(float(piece[2]))))).cast("long")
    groups = stored(groups.withColumn("per_piece", per_piece))
    is_heavy = (F.col("n") * F.col("size") > float(piece[0])) \
        | (F.col("n") * F.col("tokens") > float(piece[1])) | (F.col("n") > float(piece[2]))

    heavy = groups.where(is_heavy)
    pieces = heavy.agg(F.sum(F.ceil(F.col("n") / F.col("per_piece")))).first()[0] or 0
    if pieces > 8 * shards * HEAVY_SHARE:
        raise ValueError(f"{pieces} heavy pieces, more than their bound")
    residual = np.ones((shards, 3))
    placed: list[tuple] = []
    todo = []
    for g in heavy.orderBy(F.desc(F.col("n") * F.col("size")), "group").collect():
        for k in range(-(-g["n"] // g["per_piece"])):
            m = min(g["per_piece"], g["n"] - k * g["per_piece"])
            todo.append((g["group"], k, g["per_piece"], np.array([g["size"], g["tokens"], 1.0]) * m / capacity))
    todo.sort(key=lambda t: (-t[3].max(), t[0], t[1]))
    if todo:
        for (name, k, per, _), s in zip(todo, _pack(np.array([t[3] for t in todo]), residual)):
            placed.append((name, k, per, s))

    # a lot's share of what is left, by its share of what is still to place
    light = groups.where(~is_heavy)
    left = light.agg(F.sum(F.col("size") * F.col("n")), F.sum(F.col("tokens") * F.col("n")),
                     F.sum("n")).first()
    left = np.maximum(np.array([x or 0 for x in left], float), 1.0)
    unit = capacity.tolist()
    rest = residual.tolist()

    def pack_lot(key, data):
        lot = key[0].as_py()
        n, size, tok = (np.array(data.column(c).to_pylist(), float) for c in ("n", "size", "tokens"))
        items = np.stack([n * size, n * tok, n], 1)
        mine = np.array(rest) * (items.sum(0) / left)  # residuals sum to what is left
        items = items / np.array(unit)
        names = data.column("group").to_pylist()
        order = sorted(range(len(names)), key=lambda i: (-items[i].max(), names[i]))
        got = _pack(items[order], mine, lot)
        return pa.table({"group": [names[i] for i in order], "shard": pa.array(got, pa.int32())})

    light_at = light.select("lot", "group", "n", "size", "tokens").groupBy("lot") \
        .applyInArrow(pack_lot, "group string, shard int") \
        .select("group", F.lit(0).cast("long").alias("piece"), "shard")
    schema = "group string, piece long, per_piece long, shard int"
    heavy_at = spark.createDataFrame(placed, schema)  # at most the checked bound of rows
    at = light_at.union(heavy_at.select("group", "piece", "shard"))

    # the rows of a cut group are numbered within lots of rows, then dealt to its pieces
    key = F.xxhash64(F.col(id_col), "group")
    lot = F.pmod(key, F.lit(lots)).cast("int")
    cut = heavy_at.select("group", "per_piece").distinct()
    rows = rows.withColumn("lot", lot)
    in_cut = F.broadcast(cut)  # at most 8 * shards * HEAVY_SHARE rows, checked above
    heavy_rows = rows.join(in_cut, "group")
    first = heavy_rows.groupBy("group", "lot").agg(F.count("*").alias("c")).withColumn(
        "before", F.sum("c").over(W.partitionBy("group").orderBy("lot")) - F.col("c"))
    heavy_rows = heavy_rows.withColumn("k", F.row_number().over(
        W.partitionBy("group", "lot").orderBy(id_col)) - 1).join(first.drop("c"), ["group", "lot"]) \
        .withColumn("piece", F.floor((F.col("before") + F.col("k")) / F.col("per_piece")).cast("long"))
    light_rows = rows.join(in_cut, "group", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    cols = [id_col, "size", "text_crc32", "group", "lot", "piece"]
    # heavy placements are few: a broadcast of a checked size keeps their rows spread
    dealt = heavy_rows.select(*cols).join(F.broadcast(heavy_at.drop("per_piece")), ["group", "piece"]) \
        .unionByName(light_rows.select(*cols).join(light_at, ["group", "piece"]))
    dealt = stored(dealt.select(id_col, "size", "text_crc32", "group", "lot", "shard"))
    counts = dealt.groupBy("shard", "lot").agg(F.count("*").alias("c"))
    # one row per shard and lot, LOT_ROWS times fewer than documents
    first = counts.withColumn("before", F.sum("c").over(W.partitionBy("shard").orderBy("lot"))
                              - F.col("c")).drop("c")
    slot = F.row_number().over(W.partitionBy("shard", "lot").orderBy("group", id_col)) - 1
    return dealt.withColumn("k", slot).join(first, ["shard", "lot"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("k")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "lot")
