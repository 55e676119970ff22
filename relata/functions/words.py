"""Words of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks between words, and the word pattern with its leading consonants.
BLANKS = r"[ \t\n\r\f]+"
WORD = r"([bcdfghjklmnpqrstvwxz]*)([A-Za-z0-9_']+)"
# A word begins where a letter, digit or underscore of ASCII follows something else.
BORDER = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"


def tokens(text: Column) -> Column:
    """Pieces between blanks, empty ones left out."""
    return F.filter(F.split(text, BLANKS), lambda t: t != "")


def pig_latin(text: Column) -> Column:
    """Each word with its leading consonants moved behind it and "ay" added, joined by blanks.

    A word without leading lower-case consonants gets a "w". A result that begins with a capital
    is capitalised, any other is lower case.
    """
    pattern = F.lit(BORDER + WORD)
    heads = F.regexp_extract_all(text, pattern, F.lit(1))
    tails = F.regexp_extract_all(text, pattern, F.lit(2))

    def turn(head: Column, tail: Column) -> Column:
        word = F.concat(tail, F.when(head == "", "w").otherwise(head), F.lit("ay"))
        small = F.lower(word)
        return F.when(
            word.rlike("^[A-Z]"), F.concat(F.upper(F.substring(small, 1, 1)), F.substring(small, 2, 1 << 30))
        ).otherwise(small)

    return F.array_join(F.zip_with(heads, tails, turn), " ")
