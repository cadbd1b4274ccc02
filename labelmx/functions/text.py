"""Text expressions: natural order, quoting, name joining, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def unquote(name: Column) -> Column:
    """Strip double quotes from both ends."""
    return F.regexp_replace(name, r'^"+|"+$', "")


def natural_key(text: Column) -> Column:
    """Text that sorts naturally: digit runs compare as numbers (``a2`` < ``a10``).

    A digit run is written as its length then its digits, a text run ends in a
    zero character, and the original text breaks ties such as ``a2`` / ``a02``.
    """
    parts = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def written(t):
        bare = F.regexp_replace(t, "^0+(?=.)", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 6, "0"), bare)
        return F.when(t.rlike("^[0-9]+$"), number).otherwise(F.concat(F.lit("1"), t, F.lit("\0")))

    return F.concat(F.array_join(F.transform(parts, written), ""), F.lit("\0"), text)


def suffixed(name: Column, sep: str, key: str) -> Column:
    """``name + sep + key``."""
    return F.concat(name, F.lit(sep), F.lit(key))


def draw(seed: int, *cols: Column) -> Column:
    """Pseudo-random 60-bit number that depends only on ``cols`` and ``seed``.

    A pure function of the row, so a lost task redraws the same numbers.
    """
    text = F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
