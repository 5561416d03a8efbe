"""Arrays of JSON objects, read by byte ranges: one large array keeps every task busy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusprep.sources.scratch import materialize

CLOSE = "}"
STRING = r'"[^"]*("|\z)'
BLOCK = ["file", "block"]


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def depth_change(text: Column) -> Column:
    """Brackets opened less brackets closed, outside strings."""
    bare = F.regexp_replace(text, STRING, "")
    return count_of(bare, "{[") - count_of(bare, "]")


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``no``, ``value`` and what each piece does to the parser's state.

    A piece ends before a closing brace, so the scan is split at any byte range as for
    lines, and no escape reaches over its end. ``quotes`` tells whether a string is
    open behind it; the depth changes by ``outside`` or ``inside``, as it starts
    outside a string or within one. A byte-order mark is no part of the text.
    """
    raw = spark.read.text(path, lineSep=CLOSE).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("no"),
        "value",
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    return raw.select(
        *BLOCK,
        "no",
        "value",
        count_of(bare, '"').alias("quotes"),
        depth_change(bare).alias("outside"),
        depth_change(F.concat(F.lit('"'), bare)).alias("inside"),
    )


def before(rows: DataFrame, name: str, total: Column, blocks_total: Column, inner: Column) -> DataFrame:
    """``rows`` with ``name`` over the rows of its block that come before, and ``start``, over earlier blocks.

    Rows are ordered inside their block, where one task read them; blocks are few
    and meet as a row each.
    """
    blocks = rows.groupBy(*BLOCK).agg(total.alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*BLOCK, blocks_total.over(earlier).alias("start"))
    here = Window.partitionBy(*BLOCK).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, inner.over(here)).join(blocks, BLOCK)


def sum_before(rows: DataFrame, name: str, value: str) -> DataFrame:
    out = before(rows, name, F.sum(value), F.sum("total"), F.sum(value))
    both = F.coalesce(name, F.lit(0)) + F.coalesce("start", F.lit(0))
    return out.withColumn(name, both).drop("start")


def last_before(rows: DataFrame, name: str, value: str) -> DataFrame:
    out = before(rows, name, F.max(value), F.max("total"), F.max(value))
    return out.withColumn(name, F.coalesce(name, "start")).drop("start")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON files that each hold an array of them, as rows of ``schema``.

    Files are cut into byte ranges like text files. Which closing braces end an object
    of the array follows from the quotes and brackets before them, as sums over the
    pieces of a range and over ranges; only then the pieces of an object meet. Strings,
    escapes and nested objects may hold any bracket. Text must be UTF-8. A file that is
    no array of objects is an error, an empty one gives no rows. Compressed files are
    not cut. Fields that ``schema`` does not name are ignored.
    """
    pieces = materialize(pieces_of(spark, path), "pieces")
    state = sum_before(pieces.drop("value"), "quoted", "quotes")
    open_after = F.pmod(F.col("quoted") + F.col("quotes"), F.lit(2))
    change = F.when(F.pmod("quoted", F.lit(2)) == 1, F.col("inside")).otherwise(F.col("outside"))
    state = state.select(*BLOCK, "no", open_after.alias("open"), (change - F.when(open_after == 0, 1).otherwise(0)).alias("change"))
    depth = sum_before(state, "depth", "change")
    ends = (F.col("open") == 0) & (F.col("depth") + F.col("change") == 1)
    # The number of a piece that ends an object, which is the name of the next object too.
    at = F.when(ends, F.struct("block", "no"))
    named = last_before(depth.select(*BLOCK, "no", ends.alias("ends"), at.alias("at")), "object", "at")
    named = named.select(*BLOCK, "no", "ends", "object")
    whole = pieces.select(*BLOCK, "no", "value").join(named, [*BLOCK, "no"]).groupBy("file", "object").agg(
        F.array_sort(F.collect_list(F.struct("block", "no", "value"))).alias("parts"), F.max("ends").alias("ends")
    )
    text = F.array_join(F.transform("parts", lambda x: x["value"]), CLOSE)
    first = F.when(F.col("object").isNull(), r"^\x{FEFF}?\s*\[\s*").otherwise(r"^\s*,\s*")
    objects = whole.where("ends").select("file", F.concat(text, F.lit(CLOSE)).alias("text"), first.alias("opening"))
    broken = F.raise_error(F.concat(F.lit("not an array of JSON objects: "), F.col("file"))).cast("string")
    starts = F.expr("regexp_like(text, concat(opening, '\\\\{'))")
    body = F.when(starts, F.expr("regexp_replace(text, opening, '')")).otherwise(broken)
    parsed = objects.select(F.from_json(body, schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    # What follows the last object has to close the array; a file without that is cut off.
    closing = F.when(F.col("object").isNull(), r"^\x{FEFF}?\s*\[\s*\]\s*\z").otherwise(r"^\s*\]\s*\z")
    rest = whole.where("not ends").select("file", text.alias("text"), closing.alias("closing"))
    closed = rest.select("file", F.expr("regexp_like(text, closing)").alias("ok"))
    files = closed.unionByName(pieces.select("file", F.lit(None).cast("boolean").alias("ok")))
    wrong = files.groupBy("file").agg(F.coalesce(F.min("ok"), F.lit(False)).alias("ok")).where(
        F.when(~F.col("ok"), broken.cast("boolean"))
    )
    nothing = wrong.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in parsed.schema.fields])
    return parsed.unionByName(nothing)
