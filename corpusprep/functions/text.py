"""Column functions on story text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusprep.config import EOS, STORY_ENDING

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NEWLINES = r"\r\n|\r|\n"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def stripped_lines(text: Column) -> Column:
    """All lines of a text, each stripped, blank ones included."""
    return F.transform(F.split(text, NEWLINES, -1), strip)


def clean_lines(text: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.filter(stripped_lines(text), lambda line: line != "")


def story_record(lines: Column, eos: str = EOS) -> Column:
    """Lines joined by newlines and closed by the end-of-story line."""
    return F.concat(F.array_join(lines, "\n"), F.lit("\n" + eos))


def delimited_story(text: Column) -> Column:
    """A story followed by its ending, as it stands in a delimited text file."""
    return F.concat(text, F.lit(STORY_ENDING))


def parse_int_list(text: Column) -> Column:
    """``'[1, 2]'`` as an array of bigint; an empty list gives an empty array."""
    inner = F.btrim(F.regexp_replace(text, r"[\[\]]", ""))
    numbers = F.transform(F.split(inner, ", "), lambda x: x.cast("bigint"))
    return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(numbers)
