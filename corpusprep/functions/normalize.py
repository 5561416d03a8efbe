"""Compatibility normalisation (NFKC) of text columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprep.functions.arrow import small_arrays

# Fixed value: texts made of these characters only are already normalised
# (ASCII, Latin letters without compatibility forms, common punctuation).
UNCHANGED = (
    r"^[\x00-\x7F¡-§©«-®°±¶·»"
    r"¿-ıĴ-ľŁ-ňŊ-ž"
    r"‐‒-‖‘-‣]*$"
)


def is_plain(text: Column) -> Column:
    """Whether normalisation leaves a text as it is; ASCII is seen by its length alone."""
    return (F.octet_length(text) == F.length(text)) | text.rlike(UNCHANGED)


def nfkc(text: Column) -> Column:
    """Normalised text. Only texts that could change are sent to Python."""

    @F.arrow_udf("string")
    def normalize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from unicodedata import normalize as form

        for texts in small_arrays(batches):
            done = [t if t is None else form("NFKC", t) for t in texts.to_pylist()]
            yield pa.array(done, pa.string())

    return F.coalesce(normalize(F.when(~is_plain(text), text)), text)


def nfkc_parts(text: Column, parts: Column) -> Column:
    """The parts of a text, each normalised by itself."""

    @F.arrow_udf("array<string>")
    def normalize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from unicodedata import normalize as form

        for rows in small_arrays(batches):
            done = [row if row is None else [form("NFKC", p) for p in row] for row in rows.to_pylist()]
            yield pa.array(done, pa.list_(pa.string()))

    return F.coalesce(normalize(F.when(~is_plain(text), parts)), parts)
