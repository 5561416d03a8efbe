"""Tokenizer artifacts: vocabulary and merge tables, and the library's JSON form."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from corpusprep.functions.bytelevel import EOS_ID, PRINTED
from corpusprep.operators.bpe import Merge, Tokenizer, merges_table, vocab_table


def save_tokenizer(spark: SparkSession, tokenizer: Tokenizer, path: str) -> None:
    """Write ``vocab`` and ``merges`` tables and ``json``, one text file."""
    vocab_table(spark, tokenizer).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    merges_table(spark, tokenizer).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    text = spark.createDataFrame([(library_json(tokenizer),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/json")


def load_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """Read an artifact; both tables have at most ``vocab_size`` small rows."""
    eos = spark.read.parquet(f"{path}/vocab").where("special").first()["token"]
    rows = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    merges = tuple(Merge(r["left_id"], r["right_id"], r["new_id"], r["freq"]) for r in rows)
    return Tokenizer(merges, bytes(eos).decode())


def tokenizer_from_json(text: str) -> Tokenizer:
    """A tokenizer from the library's JSON; the file is as large as a vocabulary."""
    document = json.loads(text)
    vocab = document["model"]["vocab"]
    eos = next(t["content"] for t in document["added_tokens"] if t["id"] == EOS_ID)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in document["model"]["merges"]]
    return Tokenizer(tuple(Merge(vocab[a], vocab[b], vocab[a + b], 0) for a, b in pairs), eos)


def library_json(tokenizer: Tokenizer) -> str:
    """The tokenizer in the JSON format of the public ``tokenizers`` library."""
    # Keys and values of this layout are fixed by the library's file format.
    names = ["".join(PRINTED[b] for b in token) for token in tokenizer.token_bytes()]
    names[EOS_ID] = tokenizer.eos
    byte_level = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    special = {
        "id": EOS_ID,
        "content": tokenizer.eos,
        "single_word": False,
        "lstrip": False,
        "rstrip": False,
        "normalized": False,
        "special": True,
    }
    document = {
        "version": "1.0",
        "truncation": None,
        "padding": None,
        "added_tokens": [special],
        "normalizer": {"type": "NFKC"},
        "pre_tokenizer": byte_level,
        "post_processor": None,
        "decoder": byte_level,
        "model": {
            "type": "BPE",
            "dropout": None,
            "unk_token": None,
            "continuing_subword_prefix": None,
            "end_of_word_suffix": None,
            "fuse_unk": False,
            "byte_fallback": False,
            "ignore_merges": False,
            "vocab": {name: i for i, name in enumerate(names)},
            "merges": [[names[m.left_id], names[m.right_id]] for m in tokenizer.merges],
        },
    }
    return json.dumps(document, ensure_ascii=False)
