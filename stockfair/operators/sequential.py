"""Building blocks for order-dependent operators.

* ``running_sum``: an exact prefix sum per key that does not put a key's rows
  in one window partition.  Rows are cut into (key, bucket of the order
  column) blocks; block totals are summed over the (much smaller) block table;
  each row adds its block's offset to a running sum inside its block.  A key
  holding a third of all rows is spread over many tasks.

* ``numbered``: one dense total order (1, 2, 3 ...) over the rows, ties in the
  given order broken by all other columns.  Blocks cut from it hold a bounded
  number of rows whatever the order column's values are.

* ``neighbours`` / ``carried``: the row before or behind, and the nearest known value,
  over the same blocks.

* ``block_fold``: a sequential rule whose state is one number, over blocks of a
  key's rows in parallel.  Every block is walked from a guessed start; a block
  whose start turns out to differ from the end of the block before it is walked
  again, until all starts and ends agree.  That is the walk's own result (the
  first block's start is given, so blocks become right from the front), and a
  key that holds a third of all rows is spread over many tasks.

* ``apart`` / ``side_by_side``: most keys have few rows and need no blocks: one window over
  the rows of a key, after one shuffle by it.  Only keys with many rows take the blocks.

* ``sorted_fold``: the last resort for genuinely sequential rules (a rejected
  stock movement must not consume stock; a duplicate scan does not move the
  anchor).  Rows are hash-partitioned by key, sorted within partitions, and a
  Python step function walks them through ``mapInArrow``, keeping only the
  per-key state (a few scalars).  Batches stream through Arrow: a key's rows
  are never collected into one frame or one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockfair.session import stored

DEFAULT_BUCKET = 1 << 16

#: Hash buckets of keys that are counted to find keys with many rows.
KEY_BUCKETS = 1 << 16

#: Rows of a task that sorts the rows of its keys.
TASK_ROWS = 500_000

ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(),
         T.DoubleType(): pa.float64()}


def parts_for(df: DataFrame, rows: int) -> int:
    """Shuffle partitions for ``rows`` rows: as configured, more when a task would get
    more than ``TASK_ROWS`` (the memory of its sort does not grow with the table)."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def apart(df: DataFrame, keys: list[str], block_rows: int = DEFAULT_BUCKET,
          counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(light, heavy): the rows of ``df``, which should be stored, parted by ``keys`` (NULL
    is a key of its own): ``light`` has keys of at most four blocks and is dealt out by
    them, so windows within a key need no further shuffle; ``heavy`` (None when empty) has
    those in hash buckets of more rows.  Counting buckets costs no shuffle of rows; the
    driver gets the heavy buckets' numbers alone.  ``counted``: stored rows to count in place
    of ``df``, when that is joined to them and not stored."""
    rows = df if counted is None else counted
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    many = [r[0] for r in rows.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > 4 * block_rows).select("_b").collect()]
    light = df.where(~bucket.isin(many)) if many else df
    light = light.repartition(parts_for(df, rows.count()), *keys)
    return light, df.where(bucket.isin(many)) if many else None


def side_by_side(light: DataFrame, heavy: DataFrame | None) -> DataFrame:
    return light if heavy is None else light.unionByName(heavy.select(*light.columns))


def sums_by_key(df: DataFrame, keys: list[str], order: str, values: dict[str, str],
                bucket_width: int = DEFAULT_BUCKET) -> DataFrame:
    """``running_sums`` of a stored ``df``: blocks only for keys with many rows."""
    light, heavy = apart(df, keys, bucket_width)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    light = light.withColumns({o: F.sum(v).over(upto) for v, o in values.items()})
    return side_by_side(light, None if heavy is None else running_sums(heavy, keys, order, values, bucket_width))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys of ``left`` stay."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_right_{k}"))
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                bucket_width: int = DEFAULT_BUCKET, tie: str | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same ``keys`` with
    ``(order, tie)`` up to and including the current row.  ``order`` must be
    an integral column."""
    return running_sums(df, keys, order, {value: out}, bucket_width, tie)


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, str],
                 bucket_width: int = DEFAULT_BUCKET, tie: str | None = None) -> DataFrame:
    """``running_sum`` of several columns ({value: out}) in one pass."""
    order_cols = [order] + ([tie] if tie else [])
    b = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket_width)).cast("long"))
    totals = b.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_total_{o}") for v, o in values.items()])
    wb = (Window.partitionBy(*keys).orderBy("_bucket")
          .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_total_{o}").over(wb), F.lit(0)).alias(f"_offset_{o}") for o in values.values()])
    wr = (Window.partitionBy(*keys, "_bucket").orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = b.withColumns({f"_inner_{o}": F.sum(v).over(wr) for v, o in values.items()})
    # NULL keys are a key of their own: no row is lost
    joined = null_safe_join(inner, offsets, [*keys, "_bucket"], "inner")
    return joined.withColumns({o: F.col(f"_inner_{o}") + F.col(f"_offset_{o}") for o in values.values()}) \
        .drop("_bucket", *[f"_{k}_{o}" for k in ("inner", "offset") for o in values.values()])


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with its rows numbered 1, 2, 3 ... by ``order`` (NULLs first), then by
    its other columns: rows that tie are equal in every column, so any order of
    them gives the same result."""
    from stockfair.operators.fairs import dense_ids

    rest = [f.name for f in df.schema.fields
            if f.name not in order and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return dense_ids(df, [*order, *rest], out)


def neighbours(df: DataFrame, keys: list[str], order: str, cols: list[str], prefix: str, after: bool = False,
               block_rows: int = DEFAULT_BUCKET) -> DataFrame:
    """Add the struct ``prefix`` of ``cols`` of the row of the same ``keys`` before
    (``after``: behind) this one by the dense ``order``; NULL where there is none.
    Found per block of numbers; only the blocks' edge rows meet in one window per key."""
    number = -F.col(order) if after else F.col(order)
    b = df.withColumn("_turn", number).withColumn("_block", F.floor(number / F.lit(block_rows)).cast("long"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_turn")
    row = F.struct(*cols)
    b = b.withColumn("_near", F.lag(row).over(inside))
    edges = b.groupBy(*keys, "_block").agg(F.max_by(row, "_turn").alias("_edge"))
    carried = edges.select(*keys, "_block", F.lag("_edge").over(
        Window.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    out = null_safe_join(b, carried, [*keys, "_block"], "inner")
    return out.withColumn(prefix, F.coalesce("_near", "_carry")).drop("_turn", "_block", "_near", "_carry")


def carried(df: DataFrame, keys: list[str], order: str, value: str, out: str, after: bool = False,
            block_rows: int = DEFAULT_BUCKET) -> DataFrame:
    """Add ``out``: the nearest non-NULL ``value`` of the same ``keys`` at or before
    (``after``: at or behind) the row by the dense ``order``, found as in ``neighbours``."""
    number = -F.col(order) if after else F.col(order)
    b = df.withColumn("_turn", number).withColumn("_block", F.floor(number / F.lit(block_rows)).cast("long"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    edges = b.groupBy(*keys, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_turn"))).alias("_edge"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*keys, "_block", F.last("_edge", ignorenulls=True).over(before).alias("_carry"))
    joined = null_safe_join(b, edges, [*keys, "_block"], "inner")
    return joined.withColumn(out, F.coalesce("_near", "_carry")).drop("_turn", "_block", "_near", "_carry")


def block_fold(df: DataFrame, key: str, order: str, start: str, guess: str, step: StepFn,
               out_schema: T.StructType, inputs: list[str], outputs: list[str], end: str,
               block_rows: int = DEFAULT_BUCKET) -> DataFrame:
    """Fold ``step`` over the rows of each ``key`` in the dense ``order`` (see
    ``numbered``; equal keys numbered next to each other), ``block_rows`` numbers to
    a block.  The state is one integer: ``start`` at a key's first row, the output
    ``end`` of the row before elsewhere.  ``guess`` is a change of the state per row
    that later blocks' first starts are guessed from.  ``df`` is read in every round, so
    it should be stored.  Each round's rows are stored; only blocks whose start was
    wrong are walked again.  Output rows are as in ``sorted_fold``."""
    rows = df.withColumn("_block", F.floor(F.col(order) / F.lit(block_rows)).cast("long"))
    blocks = rows.groupBy(key, "_block").agg(
        F.min_by(start, order).alias("_first"), F.sum(guess).alias("_net"))
    turn = Window.partitionBy(key).orderBy("_block")
    before = F.sum("_net").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    blocks = stored(blocks.select(
        key, "_block", F.greatest(F.first("_first").over(turn) + F.coalesce(before, F.lit(0)), F.lit(0)).alias("_from"),
        (F.row_number().over(turn) == 1).alias("_given"), F.lit(0).alias("_round"), F.lit(None).cast("long").alias("_end")))
    walked_schema = T.StructType([*out_schema.fields, T.StructField("_block", T.LongType()),
                                  T.StructField("_at", T.LongType())])
    runs = []
    while True:
        now = len(runs)
        open_blocks = blocks.where(F.col("_round") == now).select(key, "_block", "_from")
        part = null_safe_join(rows.withColumn("_at", F.col(order)), open_blocks, [key, "_block"], "inner")
        walked = stored(sorted_fold(
            part, [key, "_block"], [order], lambda v: int(v[-1]), step, walked_schema,
            inputs=[*inputs, "_from"], outputs=outputs))
        runs.append(walked)
        ends = walked.groupBy(key, "_block").agg(F.max_by(end, "_at").alias("_new_end"))
        blocks = null_safe_join(blocks, ends, [key, "_block"], "left")
        blocks = blocks.withColumn("_end", F.coalesce("_new_end", "_end")).drop("_new_end")
        before = F.lag("_end").over(turn)
        wrong = ~F.col("_given") & (before != F.col("_from"))
        blocks = stored(blocks.withColumn("_was", before).select(
            key, "_block", F.when(wrong, F.col("_was")).otherwise(F.col("_from")).alias("_from"), "_given",
            F.when(wrong, F.lit(now + 1)).otherwise(F.col("_round")).alias("_round"), "_end"))
        if blocks.where(F.col("_round") == now + 1).limit(1).count() == 0:
            break
    out = None
    for k, walked in enumerate(runs):
        last = blocks.where(F.col("_round") == k).select(key, "_block")
        part = walked if len(runs) == 1 else null_safe_join(walked, last, [key, "_block"], "inner")
        part = part.drop("_block", "_at")
        out = part if out is None else out.unionByName(part)
    return out


StepFn = Callable[[object, tuple], tuple[object, tuple]]


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], init: Callable[[tuple], object],
                step: StepFn, out_schema: T.StructType, inputs: list[str],
                outputs: list[str], num_partitions: int | None = None,
                skip_if_empty: bool = False) -> DataFrame:
    """Fold ``step`` over the rows of each key in ``order``.

    ``init(values)`` gives the state for the first row of a key and
    ``step(state, values)`` returns ``(new_state, out_values)``; ``values``
    holds the row's ``inputs`` columns in order, ``out_values`` the
    ``outputs`` columns.  Output rows carry the input columns named in
    ``out_schema`` plus the outputs.  With ``skip_if_empty`` (for inputs that
    are already materialised) an empty input returns an empty result without
    starting Python workers."""
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if skip_if_empty and df.limit(1).count() == 0:
        # nothing to walk: no Python stage at all
        spark = df.sparkSession
        return spark.createDataFrame(spark.sparkContext.emptyRDD(), out_schema)
    ordered = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    names = [f.name for f in out_schema.fields]
    carried = [n for n in names if n not in outputs]
    n_keys = len(keys)

    types = {f.name: ARROW[f.dataType] for f in out_schema.fields if f.name in outputs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur_key, state = None, None
        for batch in batches:
            # columns that are only carried stay as they are
            cols = [x.to_pylist() if x.null_count or not pa.types.is_integer(x.type) else x.to_numpy().tolist()
                    for x in (batch.column(c) for c in keys + inputs)]
            outs: list[list] = [[] for _ in outputs]
            for vals in zip(*cols):
                k = vals[:n_keys]
                args = vals[n_keys:]
                if k != cur_key:
                    cur_key, state = k, init(args)
                state, res = step(state, args)
                for lst, v in zip(outs, res):
                    lst.append(v)
            made = {name: pa.array(lst, types[name]) for name, lst in zip(outputs, outs)}
            made.update((c, batch.column(c)) for c in carried)
            yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

    return ordered.mapInArrow(run, out_schema)
