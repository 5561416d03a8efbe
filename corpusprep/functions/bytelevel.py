"""The 256-symbol byte alphabet, and words written as strings of symbols.

Inside the engine a token is one character: token ``i`` is the code point
``SYMBOL_BASE + i``. A word is then a plain string, joining two neighbouring
tokens everywhere in it is ``replace``, and the binary order of strings is the
order of token ids. Whole-stage JVM string functions do all the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprep.functions.arrow import small_arrays

# The byte ranges that print as themselves in the byte alphabet,
# and the id of the end-of-story token.
PRINTABLE_RANGES = ((33, 126), (161, 172), (174, 255))
EOS_ID = 0

_PRINTABLE = [b for first, last in PRINTABLE_RANGES for b in range(first, last + 1)]
_SHIFTED = sorted(set(range(256)) - set(_PRINTABLE))

# Ids follow the code points of the printed characters: bytes that print as
# themselves first, then the others, which print as 256, 257, ...
BYTE_OF_ID = dict(enumerate(_PRINTABLE + _SHIFTED, start=1))
ID_OF_BYTE = {b: i for i, b in BYTE_OF_ID.items()}
PRINTED = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(_SHIFTED)}

# Code point 0 stands between words and the tokens follow, so that most byte
# tokens take one byte in UTF-8. Surrogates are no characters and are skipped.
WORD_BREAK = "\0"
SYMBOL_BASE = 1
SURROGATES = range(0xD800, 0xE000)
MAX_TOKENS = 0x110000 - len(SURROGATES) - SYMBOL_BASE
EOS_SYMBOL = chr(SYMBOL_BASE + EOS_ID)

_BYTE_CHARS = "".join(chr(b) for b in range(256))
_BYTE_SYMBOLS = "".join(chr(SYMBOL_BASE + ID_OF_BYTE[b]) for b in range(256))


def symbol(token_id: int) -> str:
    code = SYMBOL_BASE + token_id
    return chr(code if code < SURROGATES.start else code + len(SURROGATES))


def token_id(sym: str) -> int:
    code = ord(sym)
    return (code if code < SURROGATES.start else code - len(SURROGATES)) - SYMBOL_BASE


def symbol_id(sym: Column) -> Column:
    """``token_id`` of the first character of a string column."""
    code = F.ascii(sym)
    skipped = F.when(code >= SURROGATES.stop, F.lit(len(SURROGATES))).otherwise(F.lit(0))
    return (code - skipped - SYMBOL_BASE).cast("bigint")


def byte_symbols(word: Column) -> Column:
    """The UTF-8 bytes of a text as a string of byte symbols."""
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, _BYTE_CHARS, _BYTE_SYMBOLS)


def ids_of(symbols: pa.Array) -> pa.Array:
    """Strings of symbols as lists of token ids, without the word breaks."""
    filled = pc.fill_null(symbols, "")
    lengths = pc.utf8_length(filled).to_numpy(zero_copy_only=False)
    codes = np.frombuffer("".join(filled.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    kept = codes != ord(WORD_BREAK)
    ends = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))]
    codes = codes[kept]
    codes[codes >= SURROGATES.stop] -= len(SURROGATES)
    offsets = pa.array(ends.astype(np.int32), mask=np.append(pc.is_null(symbols).to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(codes - SYMBOL_BASE))


def symbols_of(ids: pa.Array) -> pa.Array:
    """Lists of token ids as strings of symbols."""
    flat = ids.flatten()
    codes = flat.to_numpy(zero_copy_only=False) + SYMBOL_BASE
    if len(codes) and (flat.null_count or codes.min() < SYMBOL_BASE or codes.max() >= SYMBOL_BASE + MAX_TOKENS):
        raise ValueError("token ids out of range")
    codes = np.where(codes >= SURROGATES.start, codes + len(SURROGATES), codes).astype("<u4")
    whole = codes.tobytes().decode("utf-32-le")
    counts = pc.list_value_length(ids).to_pylist()
    at, texts = 0, []
    for count in counts:
        texts.append(None if count is None else whole[at : at + count])
        at += count or 0
    return pa.array(texts, pa.string())


def symbol_ids(symbols: Column) -> Column:
    """A string of symbols as an array of token ids; word breaks give none."""

    @F.arrow_udf("array<bigint>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in small_arrays(batches):
            yield ids_of(texts)

    return ids(symbols)


def id_symbols(ids: Column) -> Column:
    """An array of token ids as a string of symbols: a byte or two a token, not eight."""

    @F.arrow_udf("string")
    def symbols(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in small_arrays(batches):
            yield symbols_of(lists)

    return symbols(ids)
