"""Toxicity: a weighted lexicon learned from labels, matched by Aho-Corasick on folded text.

Folding lower-cases, undoes homoglyphs and digit substitutions and drops
zero-width characters, so ``1d10t`` and ``idiot`` are one word. Entries are whole
words or word beginnings (inflected forms share one). A word counts once, with
its heaviest entry, unless an exception phrase covers it. The summed weight is
divided by the number of words and mapped to 0..1 by a logistic curve.

Defined cases: null, empty and blank texts have no words and score like a text
without matches; labels that are null, repeated or without a document are
ignored, merged (toxic wins) or unused; with no labelled documents of both kinds the
lexicon is empty and every score is 0; equal texts have equal scores; rows stay
rows, repeated or not; existing columns named like the outputs are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import column, fold

# Look-alike characters and the letter they stand for; i, l, 1 and | are one class.
LOOKALIKES = {
    "a": "аαａ@4", "b": "ｂвЬ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ3", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іιｉl1|ｌӏ",
    "j": "јｊ", "k": "кκｋ", "m": "мｍ", "n": "пｎ", "o": "оοｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ5$",
    "t": "тτｔ7", "u": "υｕ", "v": "νｖ", "w": "ԝｗ", "x": "хχｘ", "y": "уｙ", "z": "ｚ",
}
ZERO_WIDTH = "​‌‍﻿­"
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish")
PREFIXES = range(4, 9)
MAX_LABELLED = 50_000
MAX_ENTRIES = 5_000
_FLUSH = 200_000
_BINS_PER_UNIT = 50

_FOLD = {ord(x): letter for letter, like in LOOKALIKES.items() for x in like} | {ord(x): None for x in ZERO_WIDTH}
_WORD = re.compile(r"[^\W\d_]+")


class Entry(NamedTuple):
    term: str
    whole: bool  # else it matches any word that begins with it
    weight: float


class Lexicon(NamedTuple):
    entries: tuple[Entry, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 0.0
    intercept: float = -math.inf


def folded(text: str) -> str:
    return text.lower().translate(_FOLD)


class Matcher:
    """An automaton over the entries and exception phrases."""

    def __init__(self, lexicon: Lexicon):
        found: dict[str, list] = {}
        for e in lexicon.entries:
            found.setdefault(folded(e.term), []).append((e.whole, e.weight))
        for phrase in lexicon.exceptions:
            found.setdefault(folded(phrase), []).append((True, None))
        self.automaton = ahocorasick.Automaton()
        for term, kinds in found.items():
            self.automaton.add_word(term, (term, kinds))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str) -> dict[int, tuple[float, str]]:
        """Per beginning of a matched word its heaviest entry, exceptions taken out."""
        if self.empty:
            return {}
        hits, spared, n = {}, [], len(text)
        for end, (term, kinds) in self.automaton.iter(text):
            start = end - len(term) + 1
            if start and text[start - 1].isalpha():
                continue
            closed = end + 1 == n or not text[end + 1].isalpha()
            for whole, weight in kinds:
                if whole and not closed:
                    continue
                if weight is None:
                    spared.append((start, end))
                elif weight > hits.get(start, (-math.inf,))[0]:
                    hits[start] = (weight, term)
        if spared:
            hits = {s: h for s, h in hits.items() if not any(a <= s <= b for a, b in spared)}
        return hits


def _density(text: str | None, matcher: Matcher) -> tuple[int, float, list[str]]:
    plain = folded(text or "")
    n_words = len(plain.split())
    hits = matcher.matches(plain) if n_words else {}
    total = sum(w for w, _ in hits.values())
    return n_words, math.log1p(1000.0 * total / n_words) if total > 0 else 0.0, sorted({t for _, t in hits.values()})


def _features(text: str | None) -> set[str]:
    """Distinct words (``word$``) and word beginnings of a folded text."""
    out = set()
    for w in set(_WORD.findall(folded(text or ""))):
        if len(w) >= 3:
            out.add(w + "$")
            out.update(w[:k] for k in PREFIXES if k <= len(w))
    return out


def _count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def flush():
        keys = list(counts)
        both = list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([x[1] for x in both], pa.int64()), pa.array([x[0] for x in both], pa.int64())], ["feature", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for f in _features(text):
                counts.setdefault(f, [0, 0])[toxic] += 1
            if len(counts) >= _FLUSH:
                yield flush()
    if counts:
        yield flush()


def labelled(docs: DataFrame, labels: DataFrame, *, held_out: int | None = 1, folds: int = 3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(text, toxic)`` of at most ``max_labelled`` training documents, chosen by a hash of their ids."""
    known = labels.select(column("doc_id").alias("id"), column("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    if held_out is not None:
        known = known.where(fold(F.col("id"), folds) != held_out)
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(column("doc_id").alias("id"), column("text").alias("text"))
    return texts.join(F.broadcast(known), "id").select("text", "toxic")  # at most max_labelled pairs of numbers


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, *, held_out: int | None = 1, folds: int = 3, min_weight: float = 3.0,
    max_labelled: int = MAX_LABELLED, max_entries: int = MAX_ENTRIES, exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Weigh words and word beginnings by labels, then fit the curve on the same documents.

    A weight is a lower bound (one standard error) of the log odds ratio between
    toxic and clean documents. ``max_labelled`` and ``max_entries`` bound what is
    broadcast. Documents whose crc32(doc_id) modulo ``folds`` is ``held_out`` are
    not used.
    """
    train = labelled(docs, labels, held_out=held_out, folds=folds, max_labelled=max_labelled)
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon((), exceptions)
    counted = train.mapInArrow(_count_features, "feature string, toxic bigint, clean bigint")
    counted = counted.where("toxic > 0 OR clean > 0").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    weight = F.log(t / (toxic + 1.0)) - F.log(c / (clean + 1.0)) - F.sqrt(1.0 / t + 1.0 / c)
    best = counted.where("t >= 2").withColumn("weight", F.round(weight, 6)).where(F.col("weight") >= min_weight)
    rows = best.orderBy(F.desc(F.col("weight") * F.col("t")), "feature").limit(max_entries).collect()
    entries = tuple(Entry(r.feature.rstrip("$"), r.feature.endswith("$"), r.weight) for r in rows)
    lexicon = Lexicon(entries, exceptions)

    def densities(batches):
        matcher = Matcher(lexicon)
        for b in batches:
            bins = [round(_density(x, matcher)[1] * _BINS_PER_UNIT) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), b.column(1)], ["bin", "toxic"])

    seen = train.mapInArrow(densities, "bin bigint, toxic int").groupBy("bin", "toxic").count().collect()
    slope, intercept = _logistic([(r.bin / _BINS_PER_UNIT, r.toxic, r["count"]) for r in seen])
    return lexicon._replace(slope=slope, intercept=intercept)


def _logistic(points: list[tuple[float, int, int]], ridge: float = 0.05) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps; the ridge keeps separable data finite."""
    a = b = 0.0
    loss = lambda a, b: ridge * a * a / 2 + sum(n * (math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z) for x, y, n in points for z in [a * x + b])
    for _ in range(100):
        ga, gb, haa, hab, hbb = ridge * a, 0.0, ridge, 0.0, 1e-9
        for x, y, n in points:
            z = a * x + b
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            d, h = n * (p - y), n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + d * x, gb + d, haa + h * x * x, hab + h * x, hbb + h
        det = haa * hbb - hab * hab
        if det <= 0 or abs(ga) + abs(gb) < 1e-9:
            break
        da, db, step, now = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * da, b - step * db) > now:
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-10 or step <= 1e-6:
            break
    return a, b


def _score(density: float, lexicon: Lexicon) -> float:
    z = lexicon.slope * density + lexicon.intercept
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def score(docs: DataFrame, lexicon: Lexicon, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``terms`` (matched entries) and ``score``; one pass, no shuffle."""
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "terms", "score")]
    rows = docs.select(*[column(c) for c in kept], column(text).cast("string").alias("terms"))
    schema = rows.drop("terms").schema.add("n_words", T.LongType()).add("terms", T.ArrayType(T.StringType())).add("score", T.DoubleType())

    def run(batches):
        matcher = Matcher(lexicon)
        for b in batches:
            found = [_density(x, matcher) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x[0] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([_score(x[1], lexicon) for x in found], pa.float64())],
                [*b.schema.names[:-1], "n_words", "terms", "score"],
            )

    return rows.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The documents scored under ``threshold``, with their own columns."""
    marked = score(docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), learn_lexicon(docs, labels), text=f"c{docs.columns.index('text')}")
    return marked.where(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
