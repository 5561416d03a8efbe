"""Immutable job settings. Every default is a value that decides results."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Fixed values.
EOS = "<|endoftext|>"
STORY_ENDING = " \n<|endoftext|>\n"
SPLITTER = "<|SPLIT|>\n"
SPLITS = ("train", "valid")


@dataclass(frozen=True)
class CorpusConfig:
    accepted_sources: tuple[str, ...] = ("GPT-4",)
    train_ratio: float = 0.99
    seed: int = 0
    max_stories: int | None = None
    keep_empty: bool = True


@dataclass(frozen=True)
class TokenizerConfig:
    eos_token: str = EOS
    vocab_size: int = 8192
    exclude_eos: bool = False


@dataclass(frozen=True)
class PackConfig:
    context_length: int = 512
    num_workers: int = 3
    group_mode: str = "rows_per_group"
    seed: int = 0
    row_limit: int | None = None
    partitions: int | None = None


@dataclass(frozen=True)
class TrainingConfig:
    batch_size: int = 128
    accumulate_batches: int = 8
    max_steps: int = 6400


@dataclass(frozen=True)
class PrepConfig:
    corpus: CorpusConfig = field(default_factory=CorpusConfig)
    tokenizer: TokenizerConfig = field(default_factory=TokenizerConfig)
    pack: PackConfig = field(default_factory=PackConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)


def split_path(root: str, split: str, suffix: str = ".parquet") -> str:
    """Path of one split of a dataset kept as separate files per split."""
    return f"{root}-{split}{suffix}"


def dataset_url(path: str, cwd: str | None = None) -> str:
    """A path as a URL: URLs stay as they are, relative paths start at ``cwd``."""
    if "://" in path:
        return path
    if not os.path.isabs(path):
        path = os.path.normpath(os.path.join(cwd or os.getcwd(), path))
    return f"file://{path}"
