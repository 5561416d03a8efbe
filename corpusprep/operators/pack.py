"""Packing chunks into blocks of exactly ``context_length`` tokens.

Blocks are cut by token offsets inside a group, so no row is ever longer than a
block, even if a group holds a third of all chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.config import PackConfig
from corpusprep.functions.bytelevel import id_symbols, symbol_ids
from corpusprep.operators.index import MAX_BUCKET_BITS, int_div, running_total, shuffle_order

SEGMENT_ROWS = 4096


def epoch_seed(seed: int, epoch: int, reload: bool, shuffle_data: bool) -> int:
    """Seed of an epoch: data that is reloaded shuffled gets a new order."""
    return seed + epoch if reload and shuffle_data else seed


def pack_groups(chunks: DataFrame, cfg: PackConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Shuffle chunks and deal them to groups: adds ``idx, groups, group_id, rank``.

    ``rows_per_group`` makes groups of about ``num_workers`` chunks,
    ``n_groups`` makes ``num_workers`` groups.
    """
    ordered = shuffle_order(
        chunks.where(F.col("length") > 0), ["story_id", "chunk_no"], cfg.seed, by=by, total="_n"
    )
    if cfg.group_mode == "rows_per_group":
        groups = F.greatest(
            F.lit(1), int_div(F.col("_n") + (cfg.num_workers - 1), cfg.num_workers)
        ).cast("bigint")
    elif cfg.group_mode == "n_groups":
        groups = F.lit(cfg.num_workers).cast("bigint")
    else:
        raise ValueError(f"unknown group_mode {cfg.group_mode!r}")
    return (
        ordered.withColumn("groups", groups)
        .withColumn("group_id", F.col("idx") % F.col("groups"))
        .withColumn("rank", int_div(F.col("idx"), F.col("groups")))
        .drop("_n")
    )


def token_offsets(groups: DataFrame, cfg: PackConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Add each chunk's first token offset in its group and the group's tokens."""
    keys = [*by, "group_id"]
    if cfg.group_mode == "rows_per_group" and cfg.num_workers <= SEGMENT_ROWS:
        whole = Window.partitionBy(*keys)
        earlier = whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        return groups.withColumn(
            "start", F.coalesce(F.sum("length").over(earlier), F.lit(0))
        ).withColumn("group_tokens", F.sum("length").over(whole))
    return running_total(
        groups,
        F.col("length"),
        "start",
        int_div(F.col("rank"), SEGMENT_ROWS),
        ["rank"],
        tuple(keys),
        total="group_tokens",
    )


def first_block_ids(groups: DataFrame, cfg: PackConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, group_id, first_block)``: the blocks in all earlier groups."""
    sizes = groups.groupBy(*by, "group_id").agg(
        int_div(F.sum("length"), cfg.context_length).alias("blocks"),
        F.first("groups").alias("groups"),
    )
    buckets = 2**MAX_BUCKET_BITS
    bucket = int_div(F.col("group_id") * buckets, F.col("groups"))
    return running_total(
        sizes, F.col("blocks"), "first_block", bucket, ["group_id"], by
    ).select(*by, "group_id", "first_block")


def group_blocks(groups: DataFrame, cfg: PackConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """``first_block_ids``, to be joined to every chunk of a group."""
    first = first_block_ids(groups, cfg, by)
    # ``num_workers`` groups are as many rows per split, whatever the data's size. A
    # shuffle by group would put all chunks into as many tasks.
    return F.broadcast(first) if cfg.group_mode == "n_groups" else first


def block_pieces(
    chunks: DataFrame,
    cfg: PackConfig,
    by: tuple[str, ...] = (),
    wanted: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Which tokens of which chunk go where: narrow rows, no token moves.

    ``(*by, story_id, chunk_no, group_id, block_no, block_id, at, skip, take)``;
    ``wanted`` chooses blocks by their id.
    """
    length = cfg.context_length
    groups = pack_groups(chunks.select(*by, "story_id", "chunk_no", "length"), cfg, by)
    keys = [*by, "group_id"]
    placed = token_offsets(groups, cfg, by).join(group_blocks(groups, cfg, by), keys)
    end = F.col("start") + F.col("length")
    last = F.least(int_div(end - 1, length), int_div(F.col("group_tokens"), length) - 1)
    touched = placed.where(int_div(F.col("start"), length) <= last).select(
        *keys,
        "story_id",
        "chunk_no",
        "first_block",
        "start",
        end.alias("end"),
        F.explode(F.sequence(int_div(F.col("start"), length), last)).alias("block_no"),
    )
    low = F.greatest(F.col("start"), F.col("block_no") * length)
    high = F.least(F.col("end"), (F.col("block_no") + 1) * length)
    block_id = F.col("first_block") + F.col("block_no")
    return touched.where(wanted(block_id) if wanted else F.lit(True)).select(
        *keys,
        "story_id",
        "chunk_no",
        "block_no",
        block_id.alias("block_id"),
        low.alias("at"),
        (low - F.col("start")).alias("skip"),
        (high - low).alias("take"),
    )


def as_symbols(chunks: DataFrame) -> DataFrame:
    """Tokens as strings in ``symbols``: they are moved and written at a byte or two each."""
    if "symbols" in chunks.columns:
        return chunks.drop("input_ids")
    return chunks.withColumn("symbols", id_symbols(F.col("input_ids"))).drop("input_ids")


def with_ids(chunks: DataFrame) -> DataFrame:
    """``input_ids`` of the tokens in ``symbols``."""
    return chunks.withColumn("input_ids", symbol_ids(F.col("symbols")))


def pack_blocks(
    chunks: DataFrame,
    cfg: PackConfig,
    by: tuple[str, ...] = (),
    wanted: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Full blocks ``(*by, block_id, group_id, block_no, input_ids)``.

    Chunks of a group are joined in shuffle order; what is left after the last
    full block of a group is dropped. Block ids are contiguous per ``by``. Places
    come from narrow rows alone; tokens join them once, and only those of
    ``wanted`` blocks.
    """
    if cfg.row_limit is not None:
        limit, chosen = cfg.row_limit, wanted
        wanted = lambda b: (b < limit) & (chosen(b) if chosen else F.lit(True))
    pieces = block_pieces(chunks, cfg, by, wanted)
    payload = as_symbols(chunks).select(*by, "story_id", "chunk_no", "symbols")
    cut = F.substring("symbols", (F.col("skip") + 1).cast("int"), F.col("take").cast("int"))
    block = [*by, "block_id", "group_id", "block_no"]
    rows = payload.join(pieces, [*by, "story_id", "chunk_no"]).select(
        *block, F.struct("at", cut.alias("ids")).alias("piece")
    )
    pieces_in_order = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])
    whole = rows.groupBy(*block).agg(F.array_join(pieces_in_order, "").alias("symbols"))
    return with_ids(whole).drop("symbols")


def block_ids(chunks: DataFrame, cfg: PackConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, block_id)`` of all blocks, from the group sizes alone."""
    narrow = chunks.select(*by, "story_id", "chunk_no", "length")
    sizes = pack_groups(narrow, cfg, by).groupBy(*by, "group_id").agg(F.sum("length").alias("tokens"))
    totals = sizes.groupBy(*by, F.pmod(F.xxhash64("group_id"), F.lit(64)).alias("_part")).agg(
        F.sum(int_div(F.col("tokens"), cfg.context_length)).alias("n")
    )
    whole = totals.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0")
    step = 1 << 16  # two steps, so that no row holds all ids
    ranges = whole.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), int_div(F.col("n") - 1, step))).alias("r"))
    ids = F.sequence(F.col("r") * step, F.least((F.col("r") + 1) * step, F.col("n")) - 1)
    return ranges.repartition(*by, "r").select(*by, F.explode(ids).alias("block_id"))


def first_blocks(blocks: DataFrame, limit: int) -> DataFrame:
    """The blocks of a table with the lowest ids; ids are contiguous, so no sort is needed."""
    return blocks.where(F.col("block_id") < limit)


def block_lookup(blocks: DataFrame, positions: list[int]) -> DataFrame:
    """Blocks of a table by position."""
    return blocks.where(F.col("block_id").isin(*positions))


def packing_yield(chunks: DataFrame, cfg: PackConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Tokens that go in, stay in full blocks and are dropped at group ends."""
    groups = pack_groups(chunks.select(*by, "story_id", "chunk_no", "length"), cfg, by)
    tokens = groups.groupBy(*by, "group_id").agg(F.sum("length").alias("tokens"))
    kept = int_div(F.col("tokens"), cfg.context_length) * cfg.context_length
    return tokens.groupBy(*by).agg(
        F.sum("tokens").alias("tokens_in"),
        F.sum(kept).alias("tokens_kept"),
        F.sum(F.col("tokens") - kept).alias("tokens_dropped"),
        F.sum(int_div(F.col("tokens"), cfg.context_length)).alias("blocks"),
    )
