"""Splitting text into words, the units inside which tokens are built."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprep.config import EOS
from corpusprep.functions.bytelevel import (
    EOS_SYMBOL,
    ID_OF_BYTE,
    WORD_BREAK,
    byte_symbols,
    symbol,
)

# Fixed value: the published byte-level word pattern, with Unicode classes on.
WORD_PATTERN = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# A code point that is no character, and its bytes as symbols.
WORD_MARK = "\uffff"
MARK_SYMBOLS = "".join(symbol(ID_OF_BYTE[b]) for b in WORD_MARK.encode())


def with_prefix_space(text: Column) -> Column:
    return F.when(text.startswith(" "), text).otherwise(F.concat(F.lit(" "), text))


def words(text: Column) -> Column:
    """The words of a normalised text, in order; an empty text has none."""
    found = F.regexp_extract_all(with_prefix_space(text), F.lit(WORD_PATTERN), F.lit(0))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(found)


def segments(text: Column, eos: str = EOS) -> Column:
    """The pieces of a text between end-of-story markers."""
    return F.split(text, r"\Q" + eos + r"\E", -1)


def segment_symbols(segment: Column) -> Column:
    """A normalised text as byte symbols, with breaks between words.

    Words are marked in the text and the whole text is put into symbols at once,
    unless it holds the mark itself.
    """
    marked = F.regexp_replace(with_prefix_space(segment), WORD_PATTERN, "$0" + WORD_MARK)
    at_once = F.replace(byte_symbols(marked), F.lit(MARK_SYMBOLS), F.lit(WORD_BREAK))
    by_word = F.array_join(F.transform(words(segment), byte_symbols), WORD_BREAK)
    return (
        F.when(segment == "", "").when(segment.contains(WORD_MARK), by_word).otherwise(at_once)
    )


def unbroken_symbols(segment: Column) -> Column:
    """``segment_symbols`` without the breaks; every character lies in a word, so none is looked for."""
    return F.when(segment == "", "").otherwise(byte_symbols(with_prefix_space(segment)))


def join_segments(parts: Column, word_break: str = WORD_BREAK) -> Column:
    """Segments' symbols with the end-of-story symbol back between them."""
    return F.array_join(parts, word_break + EOS_SYMBOL + word_break)
