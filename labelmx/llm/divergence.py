"""Source divergence audit: how far the word use of the sources of a language lies apart.

Every (lang, source) group and every language gives each of the language's kept
terms a share of 10**9, smoothed: ``p = 1 + floor(10**9 * (n + 2) / (N + 2 * V))``
for ``n`` occurrences out of ``N`` of ``V`` kept terms. Two shares lie
``floor((p - q)**2 / (p + q))`` apart; two sources the sum of that over all terms.

Pair-task sparse merge. A group's terms are sorted (term id, count) arrays, cut
into blocks of ``BLOCK`` neighbouring ids, so no array grows with the corpus. A
task co-groups the two arrays of one unordered pair and block, intersects them by
galloping, and prices terms of both, of the one and of the other; what neither
holds has one price a pair and is added once, as many times as there are such
terms. The result goes to both directions.

Shares are computed by long division in steps of a thousand, so all arithmetic
is exact for up to ``LARGEST`` occurrences in a language.

Defined cases: null texts, languages and sources are empty ones, an empty
language or source is a value like any other; a group without kept terms has only
smoothed shares, a language without kept terms has sums of 0 and no terms;
repeated rows and equal texts count again; a null or repeated ``doc_id`` makes no
difference, as every row is a document; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import stored
from ..plans.ranks import numbered
from .base import column
from .terms import byte_table, gathered, mapped, word_codes

BLOCK = 1 << 16
LEAST_DOCS = 10
LARGEST = 9 * 10**15
_GATHER = 8 << 20
_LETTERS = byte_table(digits=False)


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.fill_null("").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _count(batches):
    """Occurrences and documents of every term per group, a few megabytes of text at a time."""
    for b in gathered(batches, _GATHER):
        dictionary, term, first = word_codes(mapped(b.column(2), _LETTERS))
        lang, langs = _codes(b.column(0))
        source, sources = _codes(b.column(1))
        group, size = lang * max(len(sources), 1) + source, max(len(dictionary), 1)
        row = np.repeat(np.arange(b.num_rows), np.diff(first))
        key, n = np.unique(group[row] * size + term, return_counts=True)
        once = np.unique(row * size + term)
        _, docs = np.unique(group[once // size] * size + once % size, return_counts=True)
        g = key // size
        yield pa.RecordBatch.from_arrays([
            langs.take(pa.array(g // max(len(sources), 1))).cast(pa.string()), sources.take(pa.array(g % max(len(sources), 1))).cast(pa.string()),
            dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(n), pa.array(docs),
        ], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term of each group."""
    given = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], column(text).cast("string").alias("text"))
    found = given.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10**9 * (n + 2) / (total + 2 * kept))`` by long division."""
    over = total + 2 * kept
    out, rest = F.lit(0).cast("bigint"), n + 2
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, over)
        rest = (rest * 1000) % over
    return out + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares_of(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    over = total + 2 * kept
    if over > LARGEST:
        raise OverflowError("too many occurrences for exact shares")
    out, rest = np.zeros(len(n), np.int64), n + 2
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // over, rest * 1000 % over
    return out + 1


def _apart(p, q):
    return (p - q) ** 2 // (p + q)


def gallop(needles: np.ndarray, ids: np.ndarray, stride: int = 64) -> np.ndarray:
    """Where each needle is, or would be, in ``ids``; both ascending.

    Every ``stride``-th needle is searched from the start; the others gallop from
    the place of the one before them, in steps that double until they are passed,
    and end with a search inside the last step.
    """
    if not len(needles) or not len(ids):
        return np.zeros(len(needles), np.int64)
    low = np.searchsorted(ids, needles[::stride])[np.arange(len(needles)) // stride].astype(np.int64)
    step, high, last = np.ones(len(needles), np.int64), low.copy(), len(ids) - 1
    ahead = np.flatnonzero((high <= last) & (ids[np.minimum(high, last)] < needles))
    while len(ahead):
        low[ahead] = high[ahead] + 1
        high[ahead] = np.minimum(high[ahead] + step[ahead], last + 1)
        step[ahead] *= 2
        ahead = ahead[(high[ahead] <= last) & (ids[np.minimum(high[ahead], last)] < needles[ahead])]
    while True:
        wide = np.flatnonzero(low < high)
        if not len(wide):
            return low
        middle = (low[wide] + high[wide]) // 2
        less = ids[middle] < needles[wide]
        low[wide[less]], high[wide[~less]] = middle[less] + 1, middle[~less]


def merged(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], kept: int) -> tuple[int, int]:
    """Summed distance over the terms that ``a`` or ``b`` (ids, counts, total) holds, and how many these are."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = gallop(a[0], b[0])
    both = np.flatnonzero(b[0][np.minimum(at, len(b[0]) - 1)] == a[0]) if len(a[0]) else np.zeros(0, np.int64)
    none = np.zeros(1, np.int64)
    p, q = shares_of(a[1], a[2], kept), shares_of(b[1], b[2], kept)
    only_a, only_b = np.ones(len(p), bool), np.ones(len(q), bool)
    only_a[both] = only_b[at[both]] = False
    total = _apart(p[both], q[at[both]]).sum() + _apart(p[only_a], shares_of(none, b[2], kept)).sum() + _apart(q[only_b], shares_of(none, a[2], kept)).sum()
    return int(total), len(p) + len(q) - len(both)


def _side(rows: pa.Table, total: str) -> tuple[np.ndarray, np.ndarray, int]:
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    ids, counts = rows.column("ids")[0].values.to_numpy(), rows.column("counts")[0].values.to_numpy()
    return ids, counts, rows.column(total)[0].as_py()


def _priced(left: pa.Table, right: pa.Table) -> pa.Table:
    """One pair and block: a side without an array still has its total on the other's row."""
    rows = left if left.num_rows else right
    lang, a, b = (rows.column(c)[0].as_py() for c in ("lang", "a", "b"))
    kept, of_a, of_b = (rows.column(c)[0].as_py() for c in ("kept", "total_a", "total_b"))
    x, y = _side(left, "total_a"), _side(right, "total_b")
    value, terms = merged((x[0], x[1], of_a), (y[0], y[1], of_b), kept)
    return pa.table({"lang": [lang], "a": [a], "b": [b], "value": [value], "terms": [terms]})


class Divergence:
    """One audit over ``docs``; see the module's text."""

    def __init__(self, docs: DataFrame, *, least_docs: int = LEAST_DOCS, block: int = BLOCK, text: str = "text"):
        self.block = block
        counts = stored(term_counts(docs, text=text), "terms")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        # ids follow the order of (lang, term): unique everywhere, sorted inside a language
        self.kept = stored(numbered(kept.select("lang", "term", "all"), "lang", "term", out="id"), "kept")
        self.langs = self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("all"))
        self.counts = stored(counts.select("lang", "source", "term", "n").join(self.kept, ["lang", "term"]), "counted")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        seen = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        groups = seen.join(totals, ["lang", "source"], "left").join(self.langs, "lang", "left")
        self.groups = stored(groups.select("lang", "source", zero("total"), zero("kept"), zero("all")), "groups")

    def pairs(self) -> DataFrame:
        """``(lang, a, b, value)`` of every unordered pair of sources of a language."""
        block = F.call_function("div", F.col("id"), F.lit(self.block))
        entry = F.sort_array(F.collect_list(F.struct("id", "n")))
        arrays = self.counts.groupBy("lang", "source", block.alias("block")).agg(entry.alias("e"))
        arrays = stored(arrays.select("lang", "source", "block", F.col("e.id").alias("ids"), F.col("e.n").alias("counts")), "arrays")
        g = self.groups
        side = lambda name: g.select("lang", F.col("source").alias(name), F.col("total").alias(f"total_{name}"), *(["kept"] if name == "a" else []))
        pairs = stored(side("a").join(side("b"), "lang").where("a < b"), "pairs")  # as many as the result has

        def mine(name):
            rows = arrays.withColumnRenamed("source", name).join(pairs, ["lang", name])
            return rows.select(*[F.col(c).alias(c) for c in rows.columns])  # the two sides share no column

        key = ["lang", "a", "b", "block"]
        priced = mine("a").groupBy(*key).cogroup(mine("b").groupBy(*key)).applyInArrow(_priced, "lang string, a string, b string, value bigint, terms bigint")
        summed = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
        zero = F.lit(0).cast("bigint")
        absent = apart(share(zero, F.col("total_a"), F.col("kept")), share(zero, F.col("total_b"), F.col("kept"))) * (F.col("kept") - F.coalesce("terms", zero))
        value = F.when(F.col("kept") == 0, zero).otherwise(F.coalesce("value", zero) + absent)
        return pairs.join(summed, ["lang", "a", "b"], "left").select("lang", "a", "b", value.alias("value"))

    def excess(self) -> DataFrame:
        """``(lang, source, item, value)``: the terms that a group uses more than its language."""
        rows = self.counts.withColumnRenamed("all", "in_lang").join(self.groups, ["lang", "source"])
        shares = rows.select(
            "lang", "source", F.col("term").alias("item"),
            share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("in_lang"), F.col("all"), F.col("kept")).alias("q"),
        )
        return shares.where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, most: int = 10, block: int = BLOCK, text: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: ``pair`` rows for every other source, ``term`` rows for ``most`` terms in excess."""
    run = Divergence(docs, least_docs=least_docs, block=block, text=text)
    pairs = run.pairs()
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(ranks).alias("rank"))
    return ranked(both.select("lang", "x.source", "x.item", "value"), "pair").unionByName(ranked(run.excess(), "term").where(F.col("rank") <= most))
