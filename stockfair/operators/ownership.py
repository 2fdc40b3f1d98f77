"""Who holds a code when: the price-list import's matching in file order.

Every row may change the codes of the product it lands on, so a row has to be
matched against the codes as they are when its turn comes.  Sequentially that is one
state; here it is ownership intervals.  A product holds a code from the row that wrote
it (or from the start) to the row that writes another one over it.  Given a target for
every row, the intervals of all codes follow from the rows sorted by product, and every
row is matched as of its own position; a match is kept as a link to the row that started
the interval, so that rows follow when that row turns out to belong elsewhere.  Links are
followed by pointer jumping, which gives new targets; this repeats until no target
changes.  Then each row agrees with all rows before it, which is the sequential result.
The rows right after one round include the first wrong one, and usually all: rounds grow
with the moves of codes that depend on each other, not with rows.

Rows are numbered once; products that no code of the import touches are never read
beyond one join.  A product that most rows land on is cut into blocks of numbers, and a
code that many products hold is matched over dyadic blocks of row numbers instead of
pairs.  Every round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockfair.operators import sequential
from stockfair.session import cut_lineage

#: Holders of a code up to which its rows are matched pair by pair.
HOLDERS_AS_PAIRS = 16
#: Row numbers stay below two to this power.
LEVELS = 48


def intervals(writes: DataFrame, last: int, block_rows: int = sequential.DEFAULT_BUCKET) -> DataFrame:
    """(kind, code, own, start, lo, hi): the row numbers lo <= n < hi at which the
    product ``own`` holds ``code``, from ``writes`` (kind, own, n, code); n = 0 is the
    state before the import, ``start`` the n of the write.  Writing the code that is
    there already starts nothing."""
    w = sequential.neighbours(writes, ["own", "kind"], "n", ["code"], "_old", block_rows=block_rows)
    starts = w.where(F.col("_old").isNull() | ~F.col("_old.code").eqNullSafe(F.col("code"))).drop("_old")
    s = sequential.neighbours(starts, ["own", "kind"], "n", ["n"], "_next", after=True, block_rows=block_rows)
    return s.where(F.col("code").isNotNull()).select(
        "kind", "code", "own", F.col("n").alias("start"), (F.col("n") + 1).alias("lo"),
        (F.coalesce("_next.n", F.lit(last)) + 1).alias("hi"))


def _block_size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def dyadic_blocks(lo: Column, hi: Column) -> Column:
    """The blocks (level, index) of 2^level numbers that make up lo <= n < hi, two
    a level at most."""
    def at_level(k):
        size = _block_size(k)
        left, right = F.floor((lo + size - 1) / size), F.floor(hi / size)
        some = left < right
        return F.array(F.when(some & (left % 2 == 1), F.struct(k.alias("level"), left.alias("index"))),
                       F.when(some & (right % 2 == 1), F.struct(k.alias("level"), (right - 1).alias("index"))))
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    return F.filter(F.flatten(F.transform(levels, at_level)), lambda x: x.isNotNull())


def holder_at(asked: DataFrame, held: DataFrame, as_pairs: int = HOLDERS_AS_PAIRS) -> DataFrame:
    """(n, own, start) of the smallest ``own`` that holds the asked (n, kind, code) at
    n; no row where nobody does.  Codes of up to ``as_pairs`` intervals are joined as
    pairs; others meet in blocks, each of which keeps its smallest holder."""
    key = ["kind", "code"]
    best = F.min(F.struct("own", "start")).alias("_best")
    many = held.groupBy(*key).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > as_pairs).select(*key)
    many = cut_lineage(many)
    few_held, few_asked = held, asked
    out = None
    if many.limit(1).count() > 0:
        few_held, few_asked = held.join(many, key, "left_anti"), asked.join(many, key, "left_anti")
        blocks = held.join(many, key, "left_semi").select(*key, "own", "start", F.explode(
            dyadic_blocks(F.col("lo"), F.col("hi"))).alias("_b")).groupBy(*key, "_b").agg(best)
        at = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(
            k.alias("level"), F.floor(F.col("n") / _block_size(k)).alias("index")))
        out = asked.join(many, key, "left_semi").select(*key, "n", F.explode(at).alias("_b")) \
            .join(blocks, [*key, "_b"]).groupBy("n").agg(F.min("_best").alias("_best"))
    pairs = few_asked.join(few_held, key).where((F.col("lo") <= F.col("n")) & (F.col("n") < F.col("hi")))
    pairs = pairs.groupBy("n").agg(best)
    out = pairs if out is None else pairs.unionByName(out)
    return out.select("n", "_best.own", "_best.start")


def followed(links: DataFrame) -> DataFrame:
    """(n, own) from links (n, own, to): a row without ``own`` has that of row
    ``to`` < n, and so on.  Every round doubles the links followed."""
    links = cut_lineage(links)
    while links.where("own IS NULL").limit(1).count() > 0:
        far = links.select(F.col("n").alias("to"), F.col("own").alias("_own"), F.col("to").alias("_to"))
        links = cut_lineage(links.join(far, "to", "left").select(
            "n", F.coalesce("own", "_own").alias("own"), F.when(F.col("own").isNull(), F.col("_to")).alias("to")))
    return links.select("n", "own")


def targets(products: DataFrame, rows: DataFrame, as_pairs: int = HOLDERS_AS_PAIRS,
            block_rows: int = sequential.DEFAULT_BUCKET) -> tuple[DataFrame, int]:
    """((n, own), top): the product every row lands on.  ``products`` has (id,
    ean_upc, sku); ``rows`` n = 1, 2, 3 ... in import order, ean_upc and sku (NULL
    matches nothing) and ``writes_ean`` / ``writes_sku`` (whether the row's sheet has that
    column: then the product's code becomes the row's, NULL too).  A row lands on the
    smallest product with its barcode at its turn, else the smallest with its sku, else
    on a new one: ``own`` is the product's id, or top + n of the row that makes it."""
    top = products.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    last = rows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    kinds = (("e", "ean_upc", "writes_ean"), ("s", "sku", "writes_sku"))

    def both(df, *more):
        return df.select(*more, F.explode(F.array(*[F.struct(
            F.lit(k).alias("kind"), F.col(c).alias("code"), (F.col(w) if w in df.columns else F.lit(True)).alias("written"))
            for k, c, w in kinds])).alias("x")).select(*more, "x.kind", "x.code", "x.written")

    codes = both(rows, "n")
    asked = codes.where(F.col("code").isNotNull()).drop("written")
    have = both(products.select(F.col("id").alias("own"), "ean_upc", "sku"), "own").drop("written")
    # products that hold a code of the import, with both their codes
    touched = have.join(asked.select("kind", "code").distinct(), ["kind", "code"], "left_semi").select("own").distinct()
    before = cut_lineage(have.join(touched, "own", "left_semi").withColumn("n", F.lit(0).cast("long")))

    # first guess: as if no product lost a code, and the first row with a code kept it
    first_owner = before.where(F.col("code").isNotNull()).groupBy("kind", "code").agg(F.min("own").alias("o"))
    first_row = asked.groupBy("kind", "code").agg(F.min("n").alias("r"))
    seen = asked.join(first_owner, ["kind", "code"], "left").join(first_row, ["kind", "code"]).groupBy("n").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}") for k, _, _ in kinds for c in ("o", "r")])
    guess = rows.select("n").join(seen, "n", "left")
    own = F.coalesce("o_e", "o_s")
    to = F.coalesce(*[F.when(F.col(f"r_{k}") < F.col("n"), F.col(f"r_{k}")) for k, _, _ in kinds])
    now = followed(guess.select("n", F.when(own.isNotNull(), own).when(to.isNull(), F.lit(top) + F.col("n")).alias("own"),
                                F.when(own.isNull(), to).alias("to")))
    written = codes.where("written").select("n", "kind", "code")
    while True:
        writes = before.select("own", "kind", "n", "code").unionByName(written.join(now, "n").select("own", "kind", "n", "code"))
        held = cut_lineage(intervals(writes, last, block_rows))
        by_ean = holder_at(asked.where("kind = 'e'"), held.where("kind = 'e'"), as_pairs)
        rest = asked.where("kind = 's'").join(by_ean, "n", "left_anti")
        hit = by_ean.unionByName(holder_at(rest, held.where("kind = 's'"), as_pairs))
        links = now.select("n", F.col("own").alias("_was")).join(hit, "n", "left").select(
            "n", "_was", F.when(F.col("own").isNull(), F.lit(top) + F.col("n"))
            .when(F.col("start") == 0, F.col("own")).alias("own"),
            F.when(F.col("start") > 0, F.col("start")).alias("to"))
        new = followed(links.drop("_was"))
        moved = new.join(now.withColumnRenamed("own", "_was"), "n").where(F.col("own") != F.col("_was"))
        if moved.limit(1).count() == 0:
            return new, top
        now = new
