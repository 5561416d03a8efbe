"""Which block goes into which minibatch and optimizer step, and its targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.config import TrainingConfig
from corpusprep.operators.index import int_div, shuffle_order


def epoch_positions(
    blocks: DataFrame, epochs: int, seed: int = 0, shuffle: bool = True, by: tuple[str, ...] = ()
) -> DataFrame:
    """``(*by, epoch, block_id, at)``: the place of every block in every epoch.

    Unshuffled data, as for validation, keeps the contiguous block order.
    """
    if epochs <= 0:
        blocks = blocks.where(F.lit(False))
    ids = blocks.select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(max(0, epochs - 1)))).alias("epoch"), "block_id"
    )
    if not shuffle:
        return ids.withColumn("at", F.col("block_id"))
    return shuffle_order(ids, ["block_id"], F.col("epoch") + seed, "at", (*by, "epoch"))


def epochs_for(blocks: int, cfg: TrainingConfig) -> int:
    """Epochs until ``max_steps`` steps are done over so many blocks; 0 without blocks."""
    batches = -(-blocks // cfg.batch_size)
    steps = -(-batches // cfg.accumulate_batches)
    return -(-cfg.max_steps // steps) if steps else 0


def batch_plan(positions: DataFrame, cfg: TrainingConfig) -> DataFrame:
    """Replace positions by minibatch number and place; the last batch may be short."""
    others = [c for c in positions.columns if c != "at"]
    return positions.select(
        *others,
        int_div(F.col("at"), cfg.batch_size).alias("batch_no"),
        (F.col("at") % cfg.batch_size).alias("pos"),
    )


def step_plan(plan: DataFrame, cfg: TrainingConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """Add the optimizer step of each minibatch, up to ``max_steps``.

    Gradients of ``accumulate_batches`` minibatches make a step; an epoch's last
    step takes what is left, and steps count on over the epochs.
    """
    keys = [*by, "epoch"]
    sizes = plan.groupBy(*keys).agg(F.max("batch_no").alias("_last"))
    per_epoch = int_div(F.col("_last"), cfg.accumulate_batches) + 1
    step = F.col("epoch") * per_epoch + int_div(F.col("batch_no"), cfg.accumulate_batches)
    # One row of sizes per epoch and ``by`` group.
    return (
        plan.join(F.broadcast(sizes), keys)
        .withColumn("optimizer_step", step.cast("bigint"))
        .where(F.col("optimizer_step") < cfg.max_steps)
        .drop("_last")
    )


def next_token_pairs(blocks: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Inputs and their next tokens, inside a block only."""
    pairs = F.size(ids) - 1
    return blocks.where(F.size(ids) > 1).select(
        *[c for c in blocks.columns if c != ids],
        F.slice(ids, F.lit(1), pairs).alias("inputs"),
        F.slice(ids, F.lit(2), pairs).alias("targets"),
    )
