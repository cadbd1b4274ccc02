"""Mixing to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier over hashed words, fitted on a labelled table, gives
each document posteriors p over domains; the sum of a document's word evidence
is divided by the square root of its word count, which keeps memberships soft.
Document rates r >= 0 then minimise the squared distance between the expected
domain token totals ``sum_d r_d * n_d * p_dk`` and the targets, by gradient steps
from r = 1 with projections onto r >= 0. Steps add up before the projection, so
after any number of them

    r_d = max(0, 1 - sum_k p_dk * shift_k)

and the whole state is one number per domain. Of all rates of least distance those
nearest to 1 are wanted: ``CLOSENESS`` weighs the distance to 1 against the squares,
so little that totals are right to about as many digits, and makes the problem convex
in the shift with one solution, also where targets cannot be met. At it the shift is
the rest that stays, divided by the weight. A step is one pass that sums as many
numbers as there are pairs of domains; it is scaled by the inverse of
``sum n_d * p_d p_d'`` over the documents with r > 0 and, if it goes too far, replaced
by the longest of ``SHORTER`` shorter ones that does not, all tried in one pass.

Defined cases: null, empty and blank texts have no words, posteriors equal to
the priors, and no influence; labels that are null, repeated or without a
document are unused, merged (smallest domain name) or unused; domains without
labelled documents get no membership and their targets are shared out by weight among the others;
with no labelled documents at all every rate is 1; rows stay rows, repeated or
not, and equal texts have equal posteriors and rates; extra columns are kept,
those named like the outputs are replaced. ``copies`` of null ids are drawn
like any others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored
from .base import column, fresh

BUCKETS = 4096
SMOOTHING = 0.1
MAX_LABELLED = 50_000
MAX_STEPS = 200
CLOSENESS = 1e-9
SHORTER = 20  # step lengths 1/3, 1/9, …
_SPACE = " \t\n\x0b\f\r"


class Classifier(NamedTuple):
    domains: tuple[str, ...]
    priors: tuple[float, ...]
    evidence: tuple[tuple[float, ...], ...]  # per domain, per bucket


def words(text: Column) -> Column:
    """Words of a text; a blank or null text gives no word."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(inner), "[ \\t-\\r]+", -1))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def label_domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of a labels table: toxic, else low or good quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL")


def fit_classifier(docs: DataFrame, labelled: DataFrame, *, max_labelled: int = MAX_LABELLED, text: str = "text") -> Classifier:
    """Count hashed words per domain over at most ``max_labelled`` labelled documents, chosen by a hash."""
    known = labelled.groupBy(column("doc_id").alias("id")).agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(column("doc_id").alias("id"), column(text).alias("text"))
    train = texts.join(F.broadcast(known), "id")  # at most max_labelled short rows
    seen = train.select("domain", F.explode_outer(words(F.col("text"))).alias("word"))
    counted = seen.groupBy("domain", _bucket(F.col("word")).alias("bucket"), F.col("word").isNull().alias("none")).count().collect()
    sizes = {r.domain: r["count"] for r in known.join(texts.select("id").distinct(), "id", "left_semi").groupBy("domain").count().collect()}
    domains = tuple(sorted(sizes))
    total = sum(sizes.values())
    counts = {d: [SMOOTHING] * BUCKETS for d in domains}
    for r in counted:
        if not r.none:
            counts[r.domain][r.bucket] += r["count"]
    evidence = [[math.log(x / sum(counts[d])) for x in counts[d]] for d in domains]
    middle = [sum(x) / len(x) for x in zip(*evidence)]
    return Classifier(domains, tuple(math.log(sizes[d] / total) for d in domains), tuple(tuple(x - m for x, m in zip(e, middle)) for e in evidence))


def _listed(values) -> Column:
    """Nested numbers as one literal; the optimizer folds the parsed text."""
    kind = "array<array<double>>" if values and isinstance(values[0], (list, tuple)) else "array<double>"
    return F.from_json(F.lit(json.dumps([list(v) for v in values] if kind.startswith("array<array") else list(values))), kind)


def _with_memberships(docs: DataFrame, model: Classifier, n: str, p: str, text: str) -> DataFrame:
    """``docs`` with the word count and the posteriors, in the order of ``model.domains``."""
    first, rest = model.evidence[0], model.evidence[1:]
    names = [fresh(docs, f"evidence_{i}") for i in range(len(rest))]
    found = docs.withColumn(p, F.transform(words(column(text)), _bucket)).withColumn(n, F.size(column(p)).cast("bigint"))
    for name, e in zip(names, rest):
        table = _listed([x - y for x, y in zip(e, first)])
        found = found.withColumn(name, F.aggregate(column(p), F.lit(0.0), lambda a, b: a + F.get(table, b)))
    size = F.sqrt(F.greatest(column(n), F.lit(1)))
    odds = [F.lit(0.0), *[column(name) / size + F.lit(q - model.priors[0]) for name, q in zip(names, model.priors[1:])]]
    found = found.withColumn(p, F.array(*odds)).drop(*names)
    found = found.withColumn(p, F.transform(column(p), lambda x: F.exp(x - F.array_max(column(p)))))
    total = F.aggregate(column(p), F.lit(0.0), lambda a, x: a + x)
    return found.withColumn(p, F.transform(column(p), lambda x: x / total))


def _solve(m: list[list[float]], b: list[float]) -> list[float]:
    """Solve a small symmetric system; directions without mass are left out."""
    n = len(b)
    rows = [[*r, x] for r, x in zip(m, b)]
    used: list[int] = []
    scale = max((abs(m[i][i]) for i in range(n)), default=0.0)
    for c in range(n):
        left = [r for r in range(n) if r not in used]
        p = max(left, key=lambda r: abs(rows[r][c]), default=None)
        if p is None or abs(rows[p][c]) <= 1e-15 * scale:
            continue
        used.append(p)
        rows[p] = [x / rows[p][c] for x in rows[p]]
        for r in range(n):
            if r != p:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[p])]
    out = [0.0] * n
    for p in used:
        lead = next(c for c in range(n) if abs(rows[p][c] - 1) < 1e-9)
        out[lead] = rows[p][n]
    return out


def rate_of(posteriors: Column, shift: Sequence[float]) -> Column:
    """A document's rate under the given shift."""
    moved = F.lit(1.0)
    for i, x in enumerate(shift):
        moved = moved - F.get(posteriors, F.lit(i)) * x
    return F.greatest(F.lit(0.0), moved)


def fit_shift(profile: DataFrame, domains: tuple[str, ...], weights: Mapping[str, float], *, total: float | None = None, tolerance: float = 1e-9) -> list[float]:
    """The shift whose rates bring ``profile(n_tokens, posteriors)`` nearest to the targets.

    Targets are ``weights`` (any positive scale) times ``total`` tokens (the
    input's own total unless given). Stops when the slope of the problem is within
    ``tolerance`` of the targets: then no rate can change to bring the totals nearer.
    """
    k = len(domains)
    if not k:
        return []
    p = [F.get("posteriors", F.lit(i)) for i in range(k)]
    ends = [(i, j) for i in range(k) for j in range(i, k)]
    n = F.col("n_tokens").cast("double")
    rated = lambda shift: rate_of(F.col("posteriors"), shift)

    def passed(shift):
        """Token total, expected totals, and ``sum n p p'`` over the documents with a rate above 0."""
        active = F.when(F.col("r") > 0, n).otherwise(0.0)
        rows = profile.select(rated(shift).alias("r"), "n_tokens", "posteriors")
        row = rows.agg(F.sum(n), *[F.sum(F.col("r") * n * x) for x in p], *[F.sum(active * p[i] * p[j]) for i, j in ends]).first()
        m = dict(zip(ends, row[1 + k :]))
        return row[0], list(row[1 : 1 + k]), [[m[min(i, j), max(i, j)] for j in range(k)] for i in range(k)]

    shift = [0.0] * k
    size, sums, m = passed(shift)
    if not size:
        return []
    given = sum(max(0.0, weights.get(d, 0.0)) for d in domains)
    if given <= 0:
        raise ValueError(f"no positive target weight for any of {domains}")
    want = [max(0.0, weights.get(d, 0.0)) / given * (size if total is None else total) for d in domains]
    close = CLOSENESS * sum(m[i][i] for i in range(k))
    slope_of = lambda shift, sums: [t - x + close * s for t, x, s in zip(want, sums, shift)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    along = lambda v, w: sum(a * b for a, b in zip(v, w))
    moved = lambda step, a: [s + a * x for s, x in zip(shift, step)]
    slope = slope_of(shift, sums)
    for _ in range(MAX_STEPS):
        if norm(slope) <= tolerance * norm(want):
            break
        step = _solve([[m[i][j] + (close if i == j else 0.0) for j in range(k)] for i in range(k)], [-x for x in slope])
        down = along(slope, step)
        if down >= 0:
            break  # only rounding is left
        _, sums, next_m = passed(moved(step, 1.0))
        if along(slope_of(moved(step, 1.0), sums), step) > -0.1 * down:
            # too far: the slope along the step only rises, so the longest that keeps it low is safe
            lengths = [3.0 ** -(i + 1) for i in range(SHORTER)]
            tried = profile.agg(*[F.sum(rated(moved(step, a)) * n * x) for a in lengths for x in p]).first()
            safe = [a for i, a in enumerate(lengths) if along(slope_of(moved(step, a), tried[i * k : i * k + k]), step) <= -0.1 * down]
            if not safe:
                break
            step = [safe[0] * x for x in step]
            _, sums, next_m = passed(moved(step, 1.0))
        before, shift, m = norm(slope), moved(step, 1.0), next_m
        slope = slope_of(shift, sums)
        if before <= 1e-6 * norm(want) and norm(slope) > before / 2:
            break  # as near as doubles get
    return shift


def profile(docs: DataFrame, model: Classifier, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``posteriors``."""
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "posteriors")]
    return _with_memberships(docs.select(*[column(c) for c in kept]), model, "n_tokens", "posteriors", text)


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], *, total: float | None = None, text: str = "text") -> tuple[DataFrame, Classifier, list[float]]:
    """``(doc_id, n_tokens, posteriors, rate)`` per row of ``docs``, the classifier and the shift."""
    model = fit_classifier(docs, labelled, text=text)
    if not model.domains:
        blank = docs.select(column("doc_id").alias("doc_id"), F.size(words(column(text))).cast("bigint").alias("n_tokens"), F.array().cast("array<double>").alias("posteriors"), F.lit(1.0).alias("rate"))
        return blank, model, []
    rows = stored(profile(docs.select(column("doc_id").alias("doc_id"), column(text).alias("text")), model).drop("text"), "profile")
    shift = fit_shift(rows, model.domains, weights, total=total)
    return rows.withColumn("rate", rate_of(F.col("posteriors"), shift)), model, shift


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], *, seed: int = 0, text: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and one more by a hash of id, text and seed."""
    model = fit_classifier(docs, labelled, text=text)
    if not model.domains:
        return docs
    size, copies = fresh(docs, "n_words"), fresh(docs, "copies")
    # written once: expressions over posteriors that are not stored would compute them at every use
    rows = stored(_with_memberships(docs, model, size, copies, text), "memberships")
    shift = fit_shift(rows.select(column(size).alias("n_tokens"), column(copies).alias("posteriors")), model.domains, weights)
    if not shift:
        return docs
    draw = F.pmod(F.xxhash64(F.lit(seed), column("doc_id"), column(text)), F.lit(1 << 30)) / float(1 << 30)
    whole = rows.withColumn(copies, rate_of(column(copies), shift))
    number = (F.floor(copies) + (draw < column(copies) - F.floor(copies)).cast("int")).cast("int")
    repeated = whole.withColumn(copies, F.array_repeat(F.lit(0), number))
    return repeated.select(*[column(c) for c in docs.columns], F.explode(column(copies)).alias(copies)).drop(copies)
