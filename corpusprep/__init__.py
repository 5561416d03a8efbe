"""Distributed preparation of story corpora for language-model training."""

from corpusprep.config import CorpusConfig, PackConfig, PrepConfig, TokenizerConfig, TrainingConfig

__all__ = ["CorpusConfig", "PackConfig", "PrepConfig", "TokenizerConfig", "TrainingConfig"]
