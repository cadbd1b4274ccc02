"""Quality rules: a table of thresholds compiled into one projection, in DataFrame functions only.

Every rule bounds a share: so many of ``part`` per hundred of ``whole``. The
measures it names are array expressions over the words and lines of a text, all
in one struct that is computed once per row; a verdict is the conjunction of
the compiled bounds. Nothing is shuffled and no row leaves the JVM.

Measures: ``n_words`` (runs of other than blank, tab to carriage return),
``word_chars`` (code points in them), ``n_symbols`` (characters of
``#*$%&|<>``), ``n_stop_words`` (words of ``STOP_WORDS``, A-Z lower-cased),
``n_lines`` (lines with a word), ``n_dup_lines`` (those equal to an earlier
one), ``n_bullet_lines`` and ``n_ellipsis_lines`` (that begin with a bullet, end
with dots), ``n_repeat_words`` (words in windows of three words that occur twice
or more in the text, the first occurrence included).

Windows are compared as whole words: a text's windows are sorted, neighbours
that are equal give the places that repeat, and each such place adds the words
that the place before it did not cover. So a text costs the sort of its windows.

Defined cases: null, empty and blank texts have zeros for all measures and fail
the bound on words; a share of nothing passes every bound; texts of any length
are measured whole; rows stay rows, repeated or not, in an empty table none;
extra columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import column, fresh

_SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "\u2022", "\u2023", "\u25cf")

# Very frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "and", "be", "for", "have", "in", "is", "it", "of", "that", "the", "this", "to", "was", "with",
    "de", "des", "du", "en", "est", "et", "la", "le", "les", "pour", "que", "un", "une",
    "das", "den", "der", "die", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "con", "del", "el", "las", "los", "no", "para", "por", "se", "una", "y",
)


class Rule(NamedTuple):
    """``part`` per hundred ``whole`` must be ``least`` or more and ``most`` or less; no ``whole`` bounds ``part`` itself."""

    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None


#: What a text must pass before other rules count.
BASE = (Rule("n_words", least=50), Rule("n_repeat_words", "n_words", most=50))
#: Bounds as they are usual for web text.
RULES = (
    Rule("word_chars", "n_words", least=300, most=1000),
    Rule("n_symbols", "n_words", most=10),
    Rule("n_stop_words", "n_words", least=2),
    Rule("n_dup_lines", "n_lines", most=30),
    Rule("n_bullet_lines", "n_lines", most=90),
    Rule("n_ellipsis_lines", "n_lines", most=30),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+", -1))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")


def _chars_of(text: Column, chars: str) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.length(whole) - F.length(F.translate(whole, chars, ""))


def _repeated(w: Column) -> Column:
    """How many words lie in windows of three words that occur again."""
    places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("words"), i.alias("at"))
    again = lambda s: F.filter(s, lambda x, k: (x["words"] == F.get(s, k + 1)["words"]) | (x["words"] == F.get(s, k - 1)["words"]))
    at = let(F.sort_array(F.transform(places, window)), lambda s: F.sort_array(F.transform(again(s), lambda x: x["at"])))
    # a place covers three words, less where the next such place begins sooner
    new = lambda d: F.transform(d, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - x, F.lit(3))))
    return let(at, lambda d: F.aggregate(new(d), F.lit(0), lambda a, x: a + x))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    is_stop = lambda x: F.translate(x, upper, upper.lower()).isin(*STOP_WORDS)
    begins = lambda x: reduce(lambda a, b: a | b, [F.ltrim(x).startswith(c) for c in BULLETS])
    ends = lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("\u2026")
    blank = F.translate(F.coalesce(text, F.lit("")), _SPACE, "")

    def of(w: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(w), "word_chars": F.length(blank), "n_symbols": _chars_of(text, SYMBOLS),
            "n_stop_words": F.size(F.filter(w, is_stop)), "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_bullet_lines": F.size(F.filter(lines, begins)), "n_ellipsis_lines": F.size(F.filter(lines, ends)),
            "n_repeat_words": _repeated(w),
        }
        return F.struct(*[c.cast("bigint").alias(name) for name, c in counts.items()])

    return let(words(text), lambda w: let(_lines(text), lambda lines: of(w, lines)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")


def passes(rules: Sequence[Rule], measure: Callable[[str], Column] = column) -> Column:
    """The table compiled: true where every bound holds."""
    held = [F.lit(True)]
    for r in rules:
        part, whole = (100 * measure(r.part), measure(r.whole)) if r.whole else (measure(r.part), F.lit(1))
        if r.least is not None:
            held.append(part >= r.least * whole)
        if r.most is not None:
            held.append(part <= r.most * whole)
    return reduce(and_, held)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, *, text: str = "text") -> DataFrame:
    """``docs`` with all measures, ``base_failed`` and ``kept``."""
    out = (*MEASURES, "base_failed", "kept")
    given = [c for c in docs.columns if c.lower() not in out]
    name = fresh(docs, "measures")
    measured = docs.select(*[column(c) for c in given], measures(column(text)).alias(name))
    m = lambda c: F.col(f"`{name}`.{c}")
    return measured.select(
        *[column(c) for c in given], *[m(c).alias(c) for c in MEASURES],
        (~passes(base, m)).alias("base_failed"), (passes(base, m) & passes(rules, m)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass both tables, with their columns."""
    m = fresh(docs, "measures")
    rows = docs.withColumn(m, measures(column(text)))
    return rows.where(passes([*base, *rules], lambda c: F.col(f"`{m}`.{c}"))).drop(m)
