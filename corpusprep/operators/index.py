"""Positions in a total order, without a single-task window.

Rows are cut into ordered buckets. Bucket totals are summed first, which is a
small table, and every bucket then counts on from the total of those before it.
The result depends on the data alone, so lost executors cannot change it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKET_BITS = 18
RANGE_BUCKETS = 2048


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient, exact for every bigint."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def running_total(
    df: DataFrame,
    value: Column,
    name: str,
    bucket: Column,
    order_by: list[str],
    by: tuple[str, ...] = (),
    total: str | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same ``by`` group.

    ``bucket`` must rise with ``order_by``. ``total`` names a column for the
    group's whole sum. Nulls in ``by`` are a group. Rows move once, by group and
    bucket; the sums join them where they are.
    """
    by = list(by)
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("bigint"))
    # Equality of structs takes nulls as equal, and the same key serves window and join.
    rows = rows.withColumn("_place", F.struct(*by, "_bucket"))
    # An order inside the group only: the number of buckets bounds these rows.
    before = (
        Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*by)
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    bases = sums.select(
        F.struct(*by, "_bucket").alias("_place"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
        *([F.sum("_sum").over(whole).alias(total)] if total else []),
    )
    inside = (
        Window.partitionBy("_place").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = counted.join(bases, "_place")
    return joined.withColumn(name, F.col("_base") + F.col("_inside")).drop(
        "_place", "_bucket", "_value", "_base", "_inside"
    )


def range_bucket(df: DataFrame, key: str, buckets: int = RANGE_BUCKETS) -> Column:
    """Bucket number of a numeric key, from approximate quantiles of the data.

    The driver receives at most ``buckets`` bounds. They only balance the work:
    any bounds give the same positions. A bucket is looked up in two steps, among
    the first bounds of each run and then in the run.
    """
    shares = F.lit([i / buckets for i in range(1, buckets)])
    row = df.agg(F.percentile_approx(key, shares, 4 * buckets).alias("bounds")).first()
    bounds = sorted(set(row["bounds"] or []))
    if not bounds:
        return F.lit(0)
    size = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col(key)))
    run = below(F.lit([r[0] for r in runs]))
    nested = F.array(*[F.lit(r) for r in runs])
    inside = below(F.element_at(nested, F.greatest(run, F.lit(1))))
    return F.when(run == 0, F.lit(0)).otherwise((run - 1) * size + inside)


def row_index(
    df: DataFrame, key: str, name: str = "index", by: tuple[str, ...] = ()
) -> DataFrame:
    """Contiguous positions 0, 1, ... in the order of a unique numeric key."""
    return running_total(df, F.lit(1), name, range_bucket(df, key), [key], by)


def feed_batches(stories: DataFrame, batch_size: int, key: str = "story_id") -> DataFrame:
    """Number rows in fixed-size batches in key order; the last may be short."""
    indexed = row_index(stories, key, "_index")
    return indexed.select(
        *stories.columns,
        int_div(F.col("_index"), batch_size).alias("batch_no"),
        (F.col("_index") % batch_size).alias("pos"),
    )


def first_stories(
    stories: DataFrame, max_stories: int | None, key: str = "story_id"
) -> DataFrame:
    """The first ``max_stories`` of each split in key order; None or 0 keeps all.

    Only keys are put in order. The last key of each split then filters the
    stories where they are; that is a row per split. Keys are unique.
    """
    if not max_stories:
        return stories
    indexed = row_index(stories.select("split", key), key, "_index", by=("split",))
    last = indexed.where(F.col("_index") < max_stories).groupBy("split").agg(F.max(key).alias("_last"))
    last = F.broadcast(last.withColumnRenamed("split", "_split"))
    kept = stories.join(last, F.col("split").eqNullSafe(F.col("_split")) & (F.col(key) <= F.col("_last")))
    return kept.select(*stories.columns)


def shuffle_key(seed: Column, ids: list[str]) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), *[F.col(c).cast("string") for c in ids]))


def shuffle_order(
    df: DataFrame,
    ids: list[str],
    seed: int | Column = 0,
    name: str = "idx",
    by: tuple[str, ...] = (),
    total: str | None = None,
) -> DataFrame:
    """Positions in a repeatable random order of rows with unique ``ids``.

    The sort key is a digest, so equal ranges of its leading bits are equal
    shares of the rows whatever the ids look like.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(MAX_BUCKET_BITS, max(6, (16 * partitions - 1).bit_length()))
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    leading = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint")
    keyed = df.withColumn("_key", shuffle_key(seed, ids))
    return running_total(
        keyed, F.lit(1), name, F.shiftright(leading, 32 - bits), ["_key", *ids], by, total
    ).drop("_key")
